"""Readers, writers and monthly loads on small files."""

import csv
import io
import os
import zipfile
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skyledger.operators.silver import build_silver
from skyledger.plans import monthly
from skyledger.schema import LANDING_COLUMNS, SILVER_COLUMNS
from skyledger.sources import landing as files
from skyledger.sources import tables
from skyledger.sources.lookups import Lookups, publish_lookups, read_lookup
from skyledger.streaming import landing as arriving
from skyledger.streaming.landing import load_new_files
from tests import edge_rows
from verification import fixture, registry


def text_of(rows, extra=True, header=LANDING_COLUMNS):
    """CSV text with the columns of a full landing file around the known ones."""
    columns = [*header[:5], "Tail_Number", *header[5:], "Div5TailNum"] if extra else list(header)
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(columns + [""] if extra else columns)
    for change in rows:
        row = {**edge_rows.USUAL, **change}
        writer.writerow([row.get(c) or "" for c in columns] + ([""] if extra else []))
    return out.getvalue()


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def month_rows(year, month, n, **change):
    return [{"Year": str(year), "Month": str(month), "FlightDate": f"{year}-{month:02d}-15", **change}] * n


@pytest.fixture()
def lists(spark):
    return edge_rows.lookups(spark).counted()


def counts(df):
    return {(r.year, r.month): r["count"] for r in df.groupBy("year", "month").count().collect()}


def test_landing_is_read_by_name(spark, tmp_path):
    put(tmp_path / "a.csv", text_of([{"ArrDelay": "7.00", "Origin": "NA", "AirTime": None}]))
    df = files.read_landing(spark, str(tmp_path / "a.csv"))
    row = df.first()
    assert df.columns == LANDING_COLUMNS
    assert (row.ArrDelay, row.Origin, row.AirTime) == ("7.00", "NA", None)
    assert row.OriginCityName == "New York, NY"


def test_missing_months(spark, tmp_path):
    put(tmp_path / "2023" / "2023_1.csv", text_of(month_rows(2023, 1, 2)))
    put(tmp_path / "2023" / "2023_10.csv", text_of(month_rows(2023, 10, 3)))
    root = str(tmp_path)
    months = [(2023, 1), (2023, 2)]
    with pytest.raises(FileNotFoundError):
        files.read_landing_months(spark, root, months)
    assert files.read_landing_months(spark, root, months, "skip").count() == 2
    assert files.read_landing_months(spark, root, [(2022, 1)], "skip").count() == 0
    assert files.landing_months(spark, root) == {(2023, 1), (2023, 10)}


def test_row_of_another_month_is_refused(spark, tmp_path):
    put(tmp_path / "2023" / "2023_1.csv", text_of(month_rows(2023, 1, 2) + month_rows(2023, 2, 1)))
    with pytest.raises(PySparkException, match="month not being loaded"):
        files.read_landing_months(spark, str(tmp_path), [(2023, 1)]).collect()


def test_archives(spark, tmp_path):
    for month in (1, 2):
        with zipfile.ZipFile(tmp_path / f"m{month}.zip", "w") as archive:
            archive.writestr("readme.html", "<p>")
            archive.writestr("flights.csv", text_of(month_rows(2023, month, month, AirTime=None)))
            archive.writestr("other.csv", "x\n1\n")
    df = files.read_archives(spark, str(tmp_path))
    assert df.columns == LANDING_COLUMNS
    got = df.groupBy("Month").agg(F.count("*").alias("n"), F.count("AirTime").alias("a")).collect()
    assert {(r.Month, r.n, r.a) for r in got} == {("1", 1, 0), ("2", 2, 0)}


def test_lookups(spark, tmp_path):
    for name in ("L_UNIQUE_CARRIERS.csv", "L_AIRPORT.csv", "L_CANCELLATION.csv"):
        put(tmp_path / "codes" / name, 'Code,Description\nAA,"American, Inc."\nNA,Some\n')
    lists = Lookups.read(spark, str(tmp_path / "codes")).counted()
    assert (lists.carriers.rows, lists.carriers.repeated) == (2, 0)
    assert lists.carriers.frame.columns == ["carrier_code", "airline_name"]
    assert {r.carrier_code for r in lists.carriers.frame.collect()} == {"AA", "NA"}
    target = str(tmp_path / "published")
    written = publish_lookups(spark, str(tmp_path / "codes"), target)
    assert written == ["carriers", "airports", "cancellation"]
    assert spark.read.parquet(f"{target}/airports").count() == 2


def test_bronze_months(spark, tmp_path):
    put(tmp_path / "in" / "2023" / "2023_1.csv", text_of(month_rows(2023, 1, 2)))
    put(tmp_path / "in" / "2023" / "2023_2.csv", text_of(month_rows(2023, 2, 3)))
    bronze, raw, staging = (str(tmp_path / n) for n in ("bronze", "raw", "staging"))
    months = monthly.months_between((2022, 12), (2023, 2))
    for _ in range(2):
        monthly.ingest(spark, str(tmp_path / "in"), months, bronze, raw, staging)
    assert tables.stored_months(spark, bronze) == {(2023, 1), (2023, 2)}
    one = tables.read_bronze_month(spark, bronze, 2023, 2)
    assert one.columns == LANDING_COLUMNS and one.count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert tables.read_raw_text(spark, raw, 2023, 1).count() == 2
    staged = tables.read_text_staging(spark, staging)
    assert staged.count() == 5 and staged.first().Year == "2023"
    assert staged.columns == [*LANDING_COLUMNS, "delay_category"]


def test_drifting_bronze(spark, tmp_path):
    root = str(tmp_path / "bronze")
    texts = edge_rows.landing(spark, [1]).drop("Year", "Month")
    texts.withColumn("CarrierDelay", F.lit("3.00")).write.parquet(f"{root}/year=2023/month=1")
    texts.withColumn("CarrierDelay", F.lit(4.0)).write.parquet(f"{root}/year=2023/month=2")
    df = tables.read_drifting_bronze(spark, root, [(2023, 1), (2023, 2)])
    assert {(r.Month, float(r.CarrierDelay)) for r in df.collect()} == {("1", 3.0), ("2", 4.0)}


def test_stored_months(spark, tmp_path, lists):
    path = str(tmp_path / "silver")
    assert tables.stored_months(spark, path) == set()
    (tmp_path / "silver").mkdir()
    assert tables.stored_months(spark, path) == set()
    tables.replace_months(build_silver(edge_rows.landing(spark), lists), path)
    assert tables.stored_months(spark, path) == {(2023, 1)}


def test_rerun_and_append(spark, tmp_path, lists):
    silver = build_silver(edge_rows.landing(spark), lists)
    path = str(tmp_path / "silver")
    for _ in range(2):
        tables.replace_months(silver, path)
    stored = tables.read_silver(spark, path)
    assert stored.columns == SILVER_COLUMNS
    assert counts(stored) == {(2023, 1): len(edge_rows.EDGES)}
    tables.append_months(silver, path)
    assert tables.read_silver(spark, path).count() == 2 * len(edge_rows.EDGES)


@pytest.mark.parametrize("name", ["raw_text_table", "backfill", "stream_landing"])
def test_months_are_gathered_while_rows_are_narrow(spark, tmp_path, monkeypatch, name):
    days = [f"2023-{1 + k % 3:02d}-05" for k in range(60)]
    rows = [(k, k, k % 9, 1 + k % 7, float(k), "RAN"[k % 3], day) for k, day in enumerate(days)]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, day string"
    lines = spark.createDataFrame(rows, kind).withColumn("l_shipdate", F.col("day").cast("timestamp")).drop("day")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    for table, key in (("supplier", "s_suppkey"), ("part", "p_partkey")):
        spark.range(1, 50).withColumnRenamed("id", key).write.parquet(str(tmp_path / f"{table}.parquet"))
    frame, widths = type(lines), []
    hint = frame.hint
    monkeypatch.setattr(frame, "hint", lambda df, *of: widths.append(len(df.columns)) or hint(df, *of))
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 60
    # The 28 columns of a flight were shuffled before.
    assert widths and max(widths) < 10


def test_landing_files_hold_the_rows_as_they_are(spark, tmp_path):
    rows = edge_rows.landing(spark)
    odd = rows.withColumn("OriginCityName", F.lit('a "b", c')).withColumn("DestCityName", F.lit(None).cast("string"))
    monthless = odd.withColumn("Month", F.lit(None).cast("string"))
    fixture.write_landing_files(odd.unionByName(monthless), str(tmp_path))
    assert {p.name.rsplit("_", 1)[0] for p in tmp_path.rglob("*.csv")} == {"2023_1"}
    found = files.read_landing_months(spark, str(tmp_path), [(2023, 1)])

    def as_read(df):
        return Counter(tuple(v or None for v in r) for r in df.select(*LANDING_COLUMNS).collect())

    assert as_read(found) == as_read(odd)


def test_a_month_too_big_for_one_task_is_split(spark, tmp_path, lists):
    one = build_silver(edge_rows.landing(spark), lists)
    many = one.crossJoin(spark.range(0, 2000, 1, 8).select("id")).drop("id")
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        tables.replace_months(many, str(tmp_path / "hot"), gather=True)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(list((tmp_path / "hot").rglob("*.parquet"))) > 1
    assert tables.read_silver(spark, str(tmp_path / "hot")).count() == 2000 * len(edge_rows.EDGES)


def test_clustered_table(spark, tmp_path, lists):
    silver = build_silver(edge_rows.landing(spark), lists)
    path = str(tmp_path / "clustered")
    for _ in range(2):
        tables.write_clustered(silver, path)
    assert tables.read_silver(spark, path).count() == len(edge_rows.EDGES)
    files_written = list((tmp_path / "clustered").rglob("*.parquet"))
    assert len(files_written) == 1
    keys = [(r.reporting_airline, r.origin) for r in spark.read.parquet(str(files_written[0])).collect()]
    assert keys == sorted(keys)


def test_load_months(spark, tmp_path, lists):
    bronze, silver = str(tmp_path / "bronze"), str(tmp_path / "silver")
    rows = [(1, 2), (2, 3), (3, 1)]
    for month, n in rows:
        put(tmp_path / "in" / "2023" / f"2023_{month}.csv", text_of(month_rows(2023, month, n)))
    monthly.ingest(spark, str(tmp_path / "in"), [(2023, m) for m, _ in rows], bronze)
    assert monthly.load_months(spark, bronze, silver, lists, end=(2023, 2)) == [(2023, 1), (2023, 2)]
    assert monthly.load_months(spark, bronze, silver, lists) == [(2023, 3)]
    assert monthly.load_months(spark, bronze, silver, lists) == []
    assert counts(tables.read_silver(spark, silver)) == {(2023, m): n for m, n in rows}
    put(tmp_path / "in" / "2023" / "2023_2.csv", text_of(month_rows(2023, 2, 5)))
    monthly.ingest(spark, str(tmp_path / "in"), [(2023, 2)], bronze)
    monthly.load_months(spark, bronze, silver, lists, (2023, 2), (2023, 2), reload=True)
    assert counts(tables.read_silver(spark, silver)) == {(2023, 1): 2, (2023, 2): 5, (2023, 3): 1}


def test_refresh_marts(spark, tmp_path, lists):
    silver, folder = str(tmp_path / "silver"), str(tmp_path / "marts")
    landing = edge_rows.landing(spark)
    tables.replace_months(build_silver(landing, lists), silver)
    monthly.refresh_marts(spark, silver, folder)
    later = landing.withColumn("Month", F.lit("2"))
    tables.replace_months(build_silver(later, lists), silver)
    monthly.refresh_marts(spark, silver, folder, [(2023, 2)])
    n = len(edge_rows.EDGES)
    mart = monthly.read_marts(spark, folder)["delay_by_carrier"]
    totals = mart.groupBy("flight_month").agg(F.sum("total_flights").alias("n")).collect()
    assert {r.flight_month: r.n for r in totals} == {1: n, 2: n}


def test_new_and_corrected_files(spark, tmp_path, lists):
    root, silver, ledger = (str(tmp_path / n) for n in ("in", "silver", "ledger"))
    put(tmp_path / "in" / "2023" / "2023_1.csv", text_of(month_rows(2023, 1, 2)))
    put(tmp_path / "in" / "2023" / "2023_2.csv", text_of(month_rows(2023, 2, 3)))

    def run():
        return load_new_files(spark, root, silver, lists, ledger)

    assert run() == [(2023, 1), (2023, 2)]
    assert run() == []
    assert counts(tables.read_silver(spark, silver)) == {(2023, 1): 2, (2023, 2): 3}
    # A second file of a month, with a time long past.
    late = tmp_path / "in" / "2023" / "2023_1_late.csv"
    put(late, text_of(month_rows(2023, 1, 4)))
    os.utime(late, (late.stat().st_mtime - 30 * 86400,) * 2)
    assert run() == [(2023, 1)]
    assert counts(tables.read_silver(spark, silver)) == {(2023, 1): 6, (2023, 2): 3}
    # A correction under the same name, then one without rows.
    put(tmp_path / "in" / "2023" / "2023_2.csv", text_of(month_rows(2023, 2, 5)))
    assert run() == [(2023, 2)]
    assert counts(tables.read_silver(spark, silver)) == {(2023, 1): 6, (2023, 2): 5}
    put(tmp_path / "in" / "2023" / "2023_2.csv", text_of([]))
    assert run() == [(2023, 2)]
    assert counts(tables.read_silver(spark, silver)) == {(2023, 1): 6}


def test_file_that_changes_during_the_load(spark, tmp_path, lists, monkeypatch):
    """The ledger holds the states that were found, so the change is found by the next run."""
    root, silver, ledger = (str(tmp_path / n) for n in ("in", "silver", "ledger"))
    file = tmp_path / "in" / "2023" / "2023_1.csv"
    put(file, text_of(month_rows(2023, 1, 2)))
    write = arriving.replace_months

    def replaced(*given):
        write(*given)
        put(file, text_of(month_rows(2023, 1, 7)))

    monkeypatch.setattr(arriving, "replace_months", replaced)
    assert load_new_files(spark, root, silver, lists, ledger) == [(2023, 1)]
    assert counts(tables.read_silver(spark, silver)) == {(2023, 1): 2}
    monkeypatch.setattr(arriving, "replace_months", write)
    assert load_new_files(spark, root, silver, lists, ledger) == [(2023, 1)]
    assert counts(tables.read_silver(spark, silver)) == {(2023, 1): 7}
    assert load_new_files(spark, root, silver, lists, ledger) == []


QUOTED = 'Say "Hi", NY \\ end'


def test_quotes_commas_and_backslashes(spark, tmp_path):
    text = text_of([{"OriginCityName": QUOTED, "DestCityName": '"', "ArrDelay": "7.00"}])
    put(tmp_path / "a.csv", text)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("flights.csv", text)
    put(tmp_path / "L.csv", 'Code,Description\nAA,"Say ""Hi"", Inc \\ x"\n')
    for df in (files.read_landing(spark, str(tmp_path / "a.csv")), files.read_archives(spark, str(tmp_path))):
        row = df.first()
        assert (row.OriginCityName, row.DestCityName, row.ArrDelay) == (QUOTED, '"', "7.00")
    name = read_lookup(spark, str(tmp_path / "L.csv"), "code", "name").first().name
    assert name == 'Say "Hi", Inc \\ x'


def test_files_of_different_column_order_meet_by_name(spark, tmp_path):
    put(tmp_path / "2023" / "2023_1.csv", text_of(month_rows(2023, 1, 2)))
    put(tmp_path / "2023" / "2023_2.csv", text_of(month_rows(2023, 2, 3), header=LANDING_COLUMNS[::-1]))
    rows = files.read_landing_months(spark, str(tmp_path), [(2023, 1), (2023, 2)])
    assert {(r.Month, r.n) for r in rows.groupBy("Month").agg(F.count("ArrDelay").alias("n")).collect()} == {
        ("1", 2),
        ("2", 3),
    }


def test_every_spelling_of_a_month_is_read(spark, tmp_path):
    put(tmp_path / "2023" / "2023_1.csv", text_of(month_rows(2023, 1, 2)))
    put(tmp_path / "2023" / "2023_01_b.csv", text_of(month_rows(2023, 1, 3)))
    assert files.read_landing_months(spark, str(tmp_path), [(2023, 1)]).count() == 5


@pytest.mark.parametrize("name", ["2023/january.csv", "2023/2024_1_x.csv", "2023/2023_13.csv", "stray.csv"])
def test_unnamed_files_are_refused(spark, tmp_path, name):
    put(tmp_path / "2023" / "2023_1.csv", text_of(month_rows(2023, 1, 2)))
    put(tmp_path / name, text_of(month_rows(2023, 1, 4)))
    root = str(tmp_path)
    with pytest.raises(ValueError, match=name.split("/")[-1]):
        files.landing_months(spark, root)
    assert files.landing_months(spark, root, ignore=name) == {(2023, 1)}


def test_rows_of_no_month_are_refused(spark, tmp_path):
    landing = edge_rows.landing(spark, [1]).withColumn("Month", F.lit("June"))
    with pytest.raises(PySparkException, match="row of no month"):
        tables.to_bronze(landing, str(tmp_path / "bronze"))


def test_text_table_keeps_the_text(spark, tmp_path):
    one = edge_rows.landing(spark, [1, 1]).limit(2)
    path = str(tmp_path / "raw")
    tables.load_raw_text(one.unionByName(one.withColumn("Month", F.lit("01"))), path)
    assert Counter(r.Month for r in tables.read_raw_text(spark, path).collect()) == {"1": 2, "01": 2}
    month = tables.read_raw_text(spark, path, 2023, 1)
    assert month.count() == 2
    assert "PartitionFilters: [isnotnull(load_year" in month._jdf.queryExecution().executedPlan().toString()


def test_month_sent_without_rows_is_emptied(spark, tmp_path, lists):
    bronze, raw, staging, silver = (str(tmp_path / n) for n in ("bronze", "raw", "staging", "silver"))
    months = [(2023, 1), (2023, 2)]
    for month in (1, 2):
        put(tmp_path / "in" / "2023" / f"2023_{month}.csv", text_of(month_rows(2023, month, 2)))
    monthly.ingest(spark, str(tmp_path / "in"), months, bronze, raw, staging)
    monthly.load_months(spark, bronze, silver, lists)
    monthly.refresh_marts(spark, silver, str(tmp_path / "marts"))
    put(tmp_path / "in" / "2023" / "2023_1.csv", text_of([]))
    monthly.ingest(spark, str(tmp_path / "in"), months, bronze, raw, staging)
    for read, path in ((tables.read_bronze, bronze), (tables.read_raw_text, raw), (tables.read_text_staging, staging)):
        assert {r.Month for r in read(spark, path).collect()} == {"2"}
    monthly.load_months(spark, bronze, silver, lists, reload=True)
    assert counts(tables.read_silver(spark, silver)) == {(2023, 2): 2}

    def mart_months():
        mart = monthly.read_marts(spark, str(tmp_path / "marts"))["delay_by_carrier"]
        return {r.flight_month for r in mart.collect()}

    monthly.refresh_marts(spark, silver, str(tmp_path / "marts"), [(2023, 1)])
    assert mart_months() == {2}


def test_full_refresh_forgets_months_silver_lost(spark, tmp_path, lists):
    landing = edge_rows.landing(spark)
    both = landing.unionByName(landing.withColumn("Month", F.lit("2")))
    for name, rows in (("a", both), ("b", landing)):
        tables.replace_months(build_silver(rows, lists), str(tmp_path / name))
        monthly.refresh_marts(spark, str(tmp_path / name), str(tmp_path / "marts"))
    mart = monthly.read_marts(spark, str(tmp_path / "marts"))["delay_by_carrier"]
    assert {r.flight_month for r in mart.collect()} == {1}


def test_shuffled_joins_leave_few_files(spark, tmp_path):
    bronze, silver = str(tmp_path / "bronze"), str(tmp_path / "silver")
    for month in range(1, 7):
        put(tmp_path / "in" / "2023" / f"2023_{month}.csv", text_of(month_rows(2023, month, 3)))
    monthly.ingest(spark, str(tmp_path / "in"), monthly.months_between((2023, 1), (2023, 6)), bronze)
    lists = edge_rows.lookups(spark).counted()
    large = replace(lists, carriers=replace(lists.carriers, rows=10**9))
    assert lists.fit and not large.fit
    monthly.load_months(spark, bronze, silver, large)
    assert len(list((tmp_path / "silver").rglob("*.parquet"))) == 6


def test_files_of_a_split_month_have_disjoint_ranges(spark, tmp_path, lists):
    one = build_silver(edge_rows.landing(spark), lists)
    many = one.crossJoin(spark.range(400).select("id")).withColumn(
        "reporting_airline", F.format_string("C%03d", F.col("id"))
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_clustered(many.drop("id"), str(tmp_path / "c"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    ranges = sorted(
        (min(found), max(found))
        for f in (tmp_path / "c").rglob("*.parquet")
        if (found := [r.reporting_airline for r in spark.read.parquet(str(f)).collect()])
    )
    assert len(ranges) > 1 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_work_folder_is_the_shared_one(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = tables.work_folder(spark, "x")
    assert path.rsplit("/", 1)[1].startswith("x-")
    assert shared is None or path.startswith(shared)
    assert tables.work_folder(spark, "x") != path


def test_archive_rows_do_not_pass_through_pandas(spark, tmp_path):
    rows = month_rows(2023, 1, 3, OriginCityName='two\nlines, "NY"', AirTime=None)
    short = text_of(rows) + "2023,1\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("flights.csv", text_of(rows))
    df = files.read_archives(spark, str(tmp_path))
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.OriginCityName, r.AirTime) for r in df.collect()} == {('two\nlines, "NY"', None)}
    # A short line is still a row, and no row before it is given twice.
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("flights.csv", short)
    assert files.read_archives(spark, str(tmp_path)).count() == 4
