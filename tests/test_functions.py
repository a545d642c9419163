"""Expressions, profile, reports and sampling on small frames."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyledger.functions import figures, parsing
from skyledger.operators import marts, profile, reports, sampling


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_numbers(spark):
    texts = ["1.00", "-5", " 7 ", "1e2", "0.9", "-0.9", "abc", "NaN", "5d", "", "N/A", None, "1e99"]
    rows = [(t,) for t in texts]
    whole = values(spark, rows, "t string", parsing.whole_number(F.col("t")))
    assert whole == [1, -5, 7, 100, 0, 0, *[None] * 7]


def test_dates(spark):
    rows = [(t,) for t in ["2023-01-15", "20230115", "2023", "2023-02-30", "2023-1-1T0", None]]
    day = dt.date(2023, 1, 15)
    assert values(spark, rows, "t string", parsing.iso_date(F.col("t"))) == [day, *[None] * 5]
    more = values(spark, rows, "t string", parsing.iso_date(F.col("t"), ["yyyyMMdd"]))
    assert more == [day, day, *[None] * 4]


def test_flags(spark):
    rows = [("1.00",), ("0.00",), (None,), ("x",), ("2",)]
    assert values(spark, rows, "t string", parsing.flag(F.col("t"))) == [True, False, None, None, True]
    strict = values(spark, rows, "t string", parsing.strict_flag(F.col("t")))
    assert strict == [True, False, False, False, False]


def test_rounding(spark):
    rows = [(0.125,), (1.005,), (-0.125,), (2.5,), (float("nan"),), (None,)]
    got = values(spark, rows, "x double", figures.round_half_up(F.col("x"), 2))
    assert got == [0.13, 1.01, -0.13, 2.5, None, None]
    assert values(spark, [(1, 0)], "a int, b int", figures.percent(F.col("a"), F.col("b"))) == [None]


def test_clock(spark):
    day = dt.date(2023, 1, 31)
    rows = [(day, h) for h in (0, 935, 2359, 2400, 2401, 1260, None)] + [(None, 900)]
    got = values(spark, rows, "d date, h int", figures.clock_time(F.col("d"), F.col("h")))
    assert got == [
        dt.datetime(2023, 1, 31),
        dt.datetime(2023, 1, 31, 9, 35),
        dt.datetime(2023, 1, 31, 23, 59),
        dt.datetime(2023, 2, 1),
        *[None] * 4,
    ]


def test_clip_keeps_null(spark):
    got = values(spark, [(-100,), (7,), (500,), (None,)], "x int", figures.clip(F.col("x"), -60, 180))
    assert got == [-60, 7, 180, None]


def test_labels(spark):
    got = values(spark, [("A",), ("Z",), (None,)], "c string",
                 figures.label(F.col("c"), figures.CANCELLATION_LABELS))
    assert got == ["Carrier (A)", None, None]


def test_hour_drops_2400(spark):
    df = spark.createDataFrame([(2400,), (2359,), (5,), (None,)], "crs_dep_time int")
    assert {(r.dep_hour, r.flight_count) for r in profile.departures_by_hour(df).collect()} == {
        (23, 1),
        (0, 1),
    }


@pytest.mark.parametrize("data", [[0, 1, 2, 3, 10], [4, 4, 4], [-60, 180, 0, 0, 179, None]])
def test_histogram_against_brute_force(spark, data):
    df = spark.createDataFrame([(v,) for v in data], "x int")
    known = [v for v in data if v is not None]
    low, high = min(known), max(known)
    if low == high:
        low, high = low - 0.5, high + 0.5
    expected = Counter(min(int((v - low) * 8 // (high - low)), 7) for v in known)
    got = {r.bin: r.flight_count for r in profile.histogram(df, F.col("x"), 8).collect()}
    assert got == {b: expected.get(b, 0) for b in range(8)}


def test_histogram_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x int")
    assert profile.histogram(df, F.col("x"), 8).count() == 0


def test_sample_is_exact_and_repeatable(spark):
    rows = [(i % 50, None if i % 7 == 0 else i % 3) for i in range(5000)]
    df = spark.createDataFrame(rows, "a int, b int")
    known = Counter(r for r in rows if r[1] is not None)
    first = Counter(tuple(r) for r in sampling.sample_rows(df, ["a", "b"], 300).collect())
    again = Counter(
        tuple(r) for r in sampling.sample_rows(df.repartition(3), ["a", "b"], 300).collect()
    )
    assert sum(first.values()) == 300 and first == again
    assert not first - known
    other = sampling.sample_rows(df, ["a", "b"], 300, seed=7).collect()
    assert Counter(tuple(r) for r in other) != first
    everything = sampling.sample_rows(df, ["a", "b"], 10_000).collect()
    assert Counter(tuple(r) for r in everything) == known


def test_sample_with_one_row_copied_many_times(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPIES_PER_TASK_ROW", 64)
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).cast("int").alias("a")
    )
    got = Counter(r.a for r in sampling.sample_rows(df, ["a"], 900).collect())
    assert sum(got.values()) == 900
    assert 200 < got[-1] < 400
    assert all(n == 1 for a, n in got.items() if a != -1)


def test_distinct_counts(spark):
    df = spark.createDataFrame(
        [("A", "X", "Y"), ("A", "X", "Z"), (None, "W", "Y")],
        "reporting_airline string, origin string, dest string",
    )
    assert tuple(profile.distinct_counts(df).first()) == (1, 2, 2)
    assert tuple(profile.distinct_counts(df, rsd=0.05).first()) == (1, 2, 2)


def test_category_shares_lists_absent_tiers(spark):
    df = spark.createDataFrame([(1,), (None,)], "arr_delay int")
    got = [(r.category, r.flight_count) for r in profile.category_shares(df).orderBy("place").collect()]
    assert got == [
        ("No Delay", 0),
        ("Minor (1-15 dk)", 1),
        ("Major (16-60 dk)", 0),
        ("Severe (60+ dk)", 0),
        ("Unknown", 1),
    ]


def marts_frame(spark, rows):
    return spark.createDataFrame(
        rows,
        "flight_year int, flight_month int, reporting_airline string, total_flights long,"
        "total_cancelled_flights long, avg_arr_delay_mins double, total_minor_delayed long,"
        "total_major_delayed long, total_severe_delayed long",
    )


def names_frame(spark):
    return spark.createDataFrame(
        [("AA", "American", 3), ("BB", None, 2)],
        "reporting_airline string, airline_name string, total_flights long",
    )


def test_kpi(spark):
    mart = marts_frame(
        spark,
        [
            (2023, 1, "AA", 8, 1, 1.0, 1, 0, 0),
            (2023, 2, "AA", 2, 0, 9.0, 0, 1, 0),
            (2023, 1, "BB", 10, 0, 5.0, 0, 0, 2),
            (2024, 1, "CC", 1, 0, None, 0, 0, 0),
        ],
    )
    row = reports.kpi(mart, names_frame(spark), 2023).first()
    assert tuple(row) == (20, 20.0, 5.0, "American")
    assert reports.worst_airline(mart, names_frame(spark)).first().reporting_airline == "AA"
    assert tuple(reports.kpi(mart, names_frame(spark), 2024).first())[3] is None
    assert tuple(reports.kpi(mart, names_frame(spark), 1990).first()) == (0, 0.0, 0.0, None)
    trend = reports.monthly_trend(mart, 2023).collect()
    assert [(r.month_name, r.total_flights, r.delay_rate_pct) for r in trend] == [
        ("Jan", 18, 16.7),
        ("Feb", 2, 50.0),
    ]


def test_label_falls_back_to_the_code(spark):
    df = spark.createDataFrame([("AA",), ("BB",), ("ZZ",)], "reporting_airline string")
    got = reports.with_airline_label(df, names_frame(spark)).collect()
    assert {(r.reporting_airline, r.airline_label) for r in got} == {
        ("AA", "American"),
        ("BB", "BB"),
        ("ZZ", "ZZ"),
    }


def test_order_and_preview(spark):
    df = spark.createDataFrame(
        [("B", "n", 2), ("A", "n", 2), ("C", "n", 9)],
        "reporting_airline string, airline_name string, total_flights long",
    )
    shown = [r.reporting_airline for r in marts.ordered(df, "flights_by_carrier").collect()]
    assert shown == ["C", "A", "B"]
    assert shown == [r.reporting_airline for r in reports.carrier_chart(df).collect()]
    first = profile.preview(df, ["reporting_airline"], 2).collect()
    assert [r.reporting_airline for r in first] == ["A", "B"]
