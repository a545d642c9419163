"""What the jobs read, shuffle and store, beside their results."""

import math
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skyledger.operators import marts, profile, quality, sampling
from skyledger.operators.silver import build_silver
from skyledger.operators.staging import staging_view
from skyledger.plans import base, cells, moments, monthly, sketches
from skyledger.sources import tables
from tests import edge_rows

KEY = lambda row: repr(tuple(row))


@pytest.fixture(scope="module")
def silver(spark, tmp_path_factory):
    """The edge rows as a stored silver table."""
    path = str(tmp_path_factory.mktemp("plans") / "silver")
    rows = build_silver(edge_rows.landing(spark), edge_rows.lookups(spark).counted())
    tables.replace_months(rows, path, gather=True)
    return path


@pytest.fixture(scope="module")
def staging(spark, silver):
    return staging_view(tables.read_silver(spark, silver))


def plan(df):
    """The initial physical plan as text, before anything runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node):
    return len(re.findall(rf"[-+:] (?:\*\(\d+\) )?{node}\b", plan(df)))


# --- airport marts ----------------------------------------------------------


@pytest.mark.parametrize("name", ["airport_bottlenecks", "airport_detail"])
def test_airport_marts_read_once(staging, name):
    mart = marts.MARTS[name](staging)
    assert count(mart, "FileScan") == 1
    # Partial sums, then finished sums of one airport; no flight is shuffled.
    exchanges = re.findall(r"Exchange hashpartitioning\((.*), \d+\), ENSURE", plan(mart))
    keys = {"airport_bottlenecks": 4, "airport_detail": 4}[name] + 1  # and the number of the grouping
    assert [len(re.findall(r"#\d+", x)) for x in exchanges] == [1, keys]
    assert count(mart, "SortMergeJoin") == count(mart, "BroadcastHashJoin") == 0
    after = plan(mart).split("Exchange")[-1]
    assert "functions=[partial_" in after and count(mart, "Expand") == 1


def test_airports_without_a_code_meet_nothing(spark):
    rows = [(None, "X", None, "Y", 1), ("A", "X", None, "Y", 2), (None, "X", "A", "X", 3), ("A", "X2", "A", None, 4)]
    names = ["origin", "origin_city_name", "dest", "dest_city_name", "taxi_out"]
    flights = spark.createDataFrame(rows, "origin string, origin_city_name string, dest string, dest_city_name string, taxi_out int")
    flights = flights.select(
        *names, F.lit("AA").alias("reporting_airline"), F.lit(False).alias("diverted"),
        *[F.lit(1).alias(c) for c in ("taxi_in", "dep_delay", "arr_delay")],
    )
    got = Counter((r.airport_code, r.city_name, r.total_departures, r.total_arrivals) for r in marts.airport_bottlenecks(flights).collect())
    assert got == Counter(
        [(None, "X", 2, 0), (None, "Y", 0, 2), ("A", "X", 1, 1), ("A", "X", 1, 1), ("A", "X2", 1, 1), ("A", "X2", 1, 1)]
    )
    detail = {(r.airport_code, r.city_name, r.total_departures, r.total_arrivals, r.top_carrier) for r in marts.airport_detail(flights).collect()}
    assert detail == {(None, "X", 2, 0, None), (None, None, 0, 2, None), ("A", "X", 1, 2, "AA"), ("A", "X2", 1, 2, "AA")}


def test_top_carrier_of_a_hub(spark):
    """The lower code wins a tie, over all spellings of the city."""
    rows = [("A", f"city {k % 3}", "B", "b", c) for c, n in (("Z", 6), ("M", 6), ("C", 5)) for k in range(n)]
    flights = spark.createDataFrame(rows, "origin string, origin_city_name string, dest string, dest_city_name string, reporting_airline string")
    flights = flights.withColumns({c: F.lit(1) for c in ("taxi_out", "taxi_in", "dep_delay", "arr_delay")}).withColumn("diverted", F.lit(False))
    got = {r.top_carrier for r in marts.airport_detail(flights).where("airport_code = 'A'").collect()}
    assert got == {"M"}


# --- grouping sets ----------------------------------------------------------


def test_cells_read_once(staging):
    built = cells.mart_cells(staging)
    assert count(built, "FileScan") == 1 and count(built, "Expand") == 1 and count(built, "Exchange") == 1


@pytest.mark.parametrize("name", list(marts.MARTS))
def test_marts_from_cells(staging, name):
    direct, shared = marts.MARTS[name](staging), cells.MARTS[name](cells.mart_cells(staging))
    assert direct.schema.simpleString() == shared.schema.simpleString()
    assert sorted(direct.collect(), key=KEY) == sorted(shared.collect(), key=KEY)


def test_null_keys_are_no_missing_keys(spark, staging):
    """A null airline is a group of its own, not the total over airlines."""
    torn = staging.withColumn("reporting_airline", F.when(F.col("arr_delay") > 0, F.col("reporting_airline")))
    torn = torn.withColumn("dest", F.when(F.col("dest") != "LAX", F.col("dest")))
    for name in marts.MARTS:
        direct, shared = marts.MARTS[name](torn), cells.MARTS[name](cells.mart_cells(torn))
        assert sorted(direct.collect(), key=KEY) == sorted(shared.collect(), key=KEY), name


def test_rebuilt_marts_are_the_refreshed_ones(spark, silver, tmp_path):
    monthly.refresh_marts(spark, silver, str(tmp_path / "a"))
    monthly.rebuild_marts(spark, silver, str(tmp_path / "b"))
    one, two = (monthly.read_marts(spark, str(tmp_path / x)) for x in "ab")
    for name in marts.MARTS:
        assert sorted(one[name].collect(), key=KEY) == sorted(two[name].collect(), key=KEY)


# --- checks on the write ----------------------------------------------------


def test_checks_ride_on_the_write(spark, silver, staging, tmp_path):
    built = {"staging": staging, **{n: b(staging) for n, b in marts.MARTS.items()}}
    want = {(r.check_name, r.table_name, r.column_name): r.failures for r in quality.suite(built).collect()}
    for k, write in enumerate((monthly.refresh_marts, monthly.rebuild_marts)):
        checks = quality.WriteChecks()
        write(spark, silver, str(tmp_path / f"marts{k}"), checks=checks)
        got = checks.report(spark).collect()
        assert {(r.check_name, r.table_name, r.column_name): r.failures for r in got} == want
    assert len(want) == 18 and want["unique", "airport_detail", "airport_code"] == 1


def test_checks_see_bad_values(spark, tmp_path):
    checks = quality.WriteChecks()
    rows = spark.createDataFrame(
        [("Late", None, "x"), ("Late", "AA", "x"), (None, "AA", None)],
        "delay_category string, reporting_airline string, origin string",
    ).withColumns({"flight_date": F.lit("2023-01-01"), "dest": F.lit("y")})
    checks.watch(rows, "staging").write.parquet(str(tmp_path / "s"))
    checks.watch(rows.limit(0), "root_causes").write.parquet(str(tmp_path / "r"))
    got = {(c, t, k): n for c, t, k, n in checks.failures()}
    assert got["accepted_values", "staging", "delay_category"] == 1
    assert got["not_null", "staging", "reporting_airline"] == 1 and got["not_null", "staging", "origin"] == 1
    assert got["unique", "root_causes", "reporting_airline"] == 0


# --- samples of stored rows -------------------------------------------------


def test_sample_of_stored_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("x"), F.lit(1).alias("same")).repartition(5).write.parquet(path)
    drawn = sampling.with_draw(spark.read.parquet(path))
    sample = sampling.lowest_draws(drawn, ["id"], 500)
    assert count(sample, "Exchange") == 0 and "TakeOrderedAndProject" in plan(sample)
    first = sorted(r.id for r in sample.collect())
    assert len(set(first)) == 500
    # However the files are split, a row has the same draw.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        again = sampling.lowest_draws(sampling.with_draw(spark.read.parquet(path)), ["id"], 500)
        assert sorted(r.id for r in again.collect()) == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    other = sampling.lowest_draws(sampling.with_draw(spark.read.parquet(path), seed=1), ["id"], 500)
    assert sorted(r.id for r in other.collect()) != first
    # Rows that are alike are rows of their own, and the mean is near that of all.
    assert sampling.lowest_draws(drawn, ["same"], 800).count() == 800
    assert sampling.lowest_draws(drawn, ["same"], 9000).count() == 5000
    assert abs(sum(first) / 500 - 2500) < 5 * 1443 / math.sqrt(500)


def test_sample_leaves_out_nulls(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("x"), "id").write.parquet(path)
    drawn = sampling.with_draw(spark.read.parquet(path))
    assert {r.x is None for r in sampling.lowest_draws(drawn, ["x", "id"], 100).collect()} == {False}
    assert sampling.lowest_draws(drawn, ["x", "id"], 100, keep_nulls=True).count() == 100


# --- histograms -------------------------------------------------------------


def test_histogram_sends_bins_not_values(spark):
    rows = spark.range(20_000, numPartitions=4).select((F.col("id") * 0.37 + 1e-7).alias("x"))
    hist = profile.histogram(rows, F.col("x"), 8)
    sums = [line for line in plan(hist).splitlines() if "functions=[partial_count" in line]
    # Grouped by the bin, an expression over the value, and never by the value.
    assert len(sums) == 1 and "keys=[_groupingexpression" in sums[0]
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", plan(hist))
    assert dealt and set(dealt) == {"_groupingexpression"}
    got = [r.flight_count for r in hist.orderBy("bin").collect()]
    assert sum(got) == 20_000 and len(got) == 8 and max(got) - min(got) <= 2


# --- distinct counts and moments that merge ---------------------------------


def months_of(spark, n, distinct):
    """Rows of twelve months over two years; every month sees part of the values."""
    return spark.range(n).select(
        (F.lit(2023) + F.floor(F.col("id") % 24 / 12)).cast("int").alias("year"),
        (F.col("id") % 12 + 1).cast("int").alias("month"),
        F.when(F.col("id") % 10 > 0, F.col("id") * 7919 % distinct).alias("code"),
        (F.col("id") * 31 % 1009 - 300).cast("int").alias("a"),
        F.when(F.col("id") % 3 > 0, (F.col("id") * 17 % 503).cast("int")).alias("b"),
    )


def test_sketches_are_near_the_exact_count(spark, tmp_path):
    path, rows = str(tmp_path / "sketches"), months_of(spark, 120_000, 50_000).cache()
    sketches.refresh_sketches(rows, path, columns=["code"])
    assert spark.read.parquet(path).count() == 24
    error = 1.04 / math.sqrt(1 << sketches.LOG_SIZE)
    for year, part in ((None, rows), (2024, rows.where("year = 2024"))):
        exact = part.agg(F.count_distinct("code")).first()[0]
        found = sketches.distinct_estimates(spark, path, year, ["code"]).first().code_count
        assert abs(found - exact) <= 4 * error * exact
    merged = sketches.distinct_estimates(spark, path, 2024, ["code"])
    assert "PartitionFilters: [isnotnull(year" in plan(merged)


def test_a_changed_month_replaces_its_sketch(spark, tmp_path):
    path = str(tmp_path / "sketches")
    sketches.refresh_sketches(months_of(spark, 2400, 100), path, columns=["code"])
    changed = months_of(spark, 2400, 100).where("year = 2024").withColumn("code", F.concat(F.lit("n"), F.col("code")))
    sketches.refresh_sketches(changed, path, [(2024, 1), (2023, 5)], columns=["code"])
    stored = spark.read.parquet(path)
    assert stored.count() == 23 and stored.where("year = 2023 and month = 5").count() == 0
    assert sketches.distinct_estimates(spark, path, 1999, ["code"]).first().code_count == 0


def test_moments_are_the_direct_figures(spark, tmp_path):
    path, rows = str(tmp_path / "moments"), months_of(spark, 9_000, 50).cache()
    moments.refresh_moments(rows.where("month < 6"), path, described=["a", "b"], correlated=["a", "b"])
    moments.refresh_moments(rows, path, [(y, m) for y in (2023, 2024) for m in range(6, 13)], ["a", "b"], ["a", "b"])
    for year, part in ((None, rows), (2024, rows.where("year = 2024")), (1999, rows.limit(0))):
        assert moments.describe(spark, path, year, ["a", "b"]).collect() == profile.describe(part, ["a", "b"]).collect()
        got = {(r.column_a, r.column_b): r.correlation for r in moments.correlation(spark, path, year, ["a", "b"]).collect()}
        want = {(r.column_a, r.column_b): r.correlation for r in profile.delay_corr(part, ["a", "b"]).collect()}
        assert got == want


# --- interleaved layout -----------------------------------------------------


def files_to_read(path, **wanted):
    """Files whose ranges hold all wanted values, of all."""
    held = total = 0
    for file in sorted(path.rglob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        names = [meta.schema.column(k).name for k in range(meta.num_columns)]
        groups = [meta.row_group(g) for g in range(meta.num_row_groups)]

        def may_hold(group, key, value):
            stats = group.column(names.index(key)).statistics
            return stats.min <= value <= stats.max

        total += 1
        held += any(all(may_hold(g, k, v) for k, v in wanted.items()) for g in groups)
    return held, total


def test_interleaved_files_serve_either_key(spark, tmp_path):
    rows = spark.range(64_000).select(
        F.lit(2023).alias("year"),
        F.format_string("C%02d", (F.col("id") * 7919 % 32).cast("int")).alias("reporting_airline"),
        F.format_string("A%02d", (F.floor(F.col("id") / 32) * 104729 % 64).cast("int")).alias("origin"),
        "id",
    )
    tables.write_interleaved(rows, str(tmp_path / "z"), ["year"], files=64)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        ranged = rows.repartitionByRange(64, "reporting_airline", "origin")
        ranged.sortWithinPartitions("reporting_airline", "origin").write.partitionBy("year").parquet(str(tmp_path / "line"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    both = {"reporting_airline": "C05", "origin": "A40"}
    z = {keys: files_to_read(tmp_path / "z", **{k: both[k] for k in keys}) for keys in (("origin",), ("reporting_airline",), tuple(both))}
    line = files_to_read(tmp_path / "line", origin="A40")
    total = z["origin",][1]
    assert total >= 48 and line[0] >= 0.45 * line[1]
    assert z["origin",][0] <= 0.3 * total and z["reporting_airline",][0] <= 0.3 * total
    assert z[tuple(both)][0] <= total / 10
    back = spark.read.parquet(str(tmp_path / "z"))
    assert back.count() == 64_000 and "layout" not in back.columns
    assert back.where("origin = 'A40'").agg(F.sum("id")).first() == rows.where("origin = 'A40'").agg(F.sum("id")).first()
    meta = pq.ParquetFile(next((tmp_path / "z").rglob("*.parquet"))).metadata
    assert meta.num_rows




def test_interleaved_table_of_nulls_and_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(2023, None, "A"), (2023, "C", None), (2023, None, None)], "year int, reporting_airline string, origin string")
    tables.write_interleaved(rows, str(tmp_path / "z"), ["year"])
    assert spark.read.parquet(str(tmp_path / "z")).count() == 3
    tables.write_interleaved(rows.limit(0), str(tmp_path / "empty"), ["year"])


def test_only_slices_of_many_copies_are_dealt_out(spark, monkeypatch):
    rows = spark.range(0, 500, 1, 4).select((F.col("id") % 400).alias("a"))
    deal, dealt = type(rows).repartition, []

    def note(self, *args):
        dealt.append(self.count())
        return deal(self, *args)

    monkeypatch.setattr(type(rows), "repartition", note)
    assert sampling.sample_rows(rows, ["a"], 40).count() == 40
    assert dealt == [0]
    monkeypatch.setattr(sampling, "COPIES_PER_TASK_ROW", 1)
    again = sampling.sample_rows(rows, ["a"], 500)
    assert dealt[1] == 200 and again.count() == 500
