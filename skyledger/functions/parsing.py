"""Text to values, where unreadable text becomes null instead of an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """Decimal text as double.

    A failing ``try_cast`` costs an exception per row, so text that ends in a
    letter (``NaN``, ``N/A``, ``null``, ``5d``) is turned into null before it
    gets there. One short comparison keeps the generated code small.
    """
    return F.when(F.substring(text, -1, 1) <= "9", text.try_cast("double"))


def whole_number(text: Column) -> Column:
    """Decimal text as int, truncating. ``1.00`` has to go through double."""
    return number(text).try_cast("int")


def flag(text: Column) -> Column:
    """``1.00`` and ``0.00`` as boolean. Missing or unreadable stays null."""
    return whole_number(text).cast("boolean")


def strict_flag(text: Column) -> Column:
    """True only for numeric 1. Missing or unreadable is false."""
    return F.coalesce(number(text) == 1, F.lit(False))


def iso_date(text: Column, extra_formats: Sequence[str] = ()) -> Column:
    """``yyyy-MM-dd`` as date, then any extra formats, else null.

    The shape test keeps out the shorter forms a date cast also takes, and
    leaves the cast itself to Spark's fast ISO reader.
    """
    shaped = (
        (F.length(text) == 10)
        & (F.substring(text, 5, 1) == "-")
        & (F.substring(text, 8, 1) == "-")
    )
    parsed = F.when(shaped, text.try_cast("date"))
    if not extra_formats:
        return parsed
    return F.coalesce(parsed, *[F.try_to_date(text, fmt) for fmt in extra_formats])


PARSERS = {
    "int": whole_number,
    "date": iso_date,
    "boolean": flag,
    "string": lambda text: text.cast("string"),
}
