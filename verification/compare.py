"""Row-by-row comparison of a Spark result with the checking engine's."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with every given table as a view."""
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


# Type names that stand for the same values in both engines.
SAME_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None when columns and rows agree."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    types = {column[0]: str(column[1]) for column in result.description}
    for name, kind in frame.dtypes:
        if SAME_TYPES.get(kind, kind) != types[name]:
            return f"type of {name}: {kind} != {types[name]}"
    ours = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    theirs = _rows(names, result.fetchall())
    if ours == theirs:
        return None
    extra, missing = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"{sum(ours.values())} rows vs {sum(theirs.values())}; ours {extra}; theirs {missing}"
