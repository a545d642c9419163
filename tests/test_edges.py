"""Silver, staging, marts and checks on the hand-written rows."""

import pytest
from pyspark.sql import functions as F

from skyledger.operators import marts, quality
from skyledger.operators.silver import build_silver
from skyledger.operators.staging import register_staging, staging_view, text_staging
from skyledger.plans import base
from skyledger.schema import (
    CAUSES,
    LANDING_COLUMNS,
    SILVER_COLUMNS,
    STAGING_COLUMNS,
    silver_schema,
    staging_schema,
)
from tests import edge_rows


@pytest.fixture(scope="module")
def lists(spark):
    return edge_rows.lookups(spark).counted()


@pytest.fixture(scope="module")
def silver(spark, lists):
    return build_silver(edge_rows.landing(spark), lists).persist()


@pytest.fixture(scope="module")
def rows(silver):
    return {row.crs_arr_time: row for row in silver.collect()}


def test_schema(silver):
    assert silver.columns == SILVER_COLUMNS and len(SILVER_COLUMNS) == 33
    assert [(f.name, f.dataType) for f in silver.schema] == [
        (f.name, f.dataType) for f in silver_schema()
    ]


def test_no_row_is_lost(rows):
    assert sorted(rows) == sorted(edge_rows.EDGES)


@pytest.mark.parametrize("number", edge_rows.EDGES)
def test_delay_columns(rows, number):
    _, late, category = edge_rows.EDGES[number]
    assert (rows[number].is_delayed, rows[number].delay_category) == (late, category)


def test_cancelled_row(rows):
    row = rows[8]
    assert row.cancelled is True and row.cancellation_reason == "Weather"
    assert row.dep_delay is None and row.arr_time is None
    assert [row[c] for c in CAUSES] == [0] * 5


def test_fills_and_misses(rows):
    assert [rows[10][c] for c in CAUSES] == [0] * 5
    assert rows[12].cancellation_code == "N/A" and rows[12].cancellation_reason is None
    assert rows[13].airline_name is None
    assert rows[14].arr_delay is None
    assert rows[15].flight_date is None
    assert rows[16].cancelled is None


def test_options(spark, lists):
    landing = edge_rows.landing(spark)
    other = build_silver(landing, lists, fill_causes=False, strict_flags=True, null_as=None)
    found = {row.crs_arr_time: row for row in other.collect()}
    assert found[10].carrier_delay is None
    assert found[16].cancelled is False
    assert found[8].delay_category is None
    unknown = build_silver(landing, lists, null_as="Unknown")
    assert unknown.where("crs_arr_time = 8").first().delay_category == "Unknown"


def test_staging_view(spark, silver):
    view = register_staging(silver, "edges_view")
    assert view.columns == STAGING_COLUMNS and len(STAGING_COLUMNS) == 30
    assert spark.table("edges_view").count() == len(edge_rows.EDGES)


def test_text_staging(spark):
    staged = text_staging(edge_rows.landing(spark))
    assert staged.columns == [*LANDING_COLUMNS, "delay_category"]
    types = [(f.name, f.dataType) for f in staged.schema][:-1]
    assert types == [(f.name, f.dataType) for f in staging_schema(LANDING_COLUMNS)]
    found = {row.CRSArrTime: row for row in staged.collect()}
    assert found["8"].delay_category is None and found["8"].CarrierDelay is None
    assert found["16"].Cancelled is False
    assert found["4"].ArrDelay == 15.0


def test_root_cause_shares(silver):
    row = marts.root_causes(staging_view(silver.where("crs_arr_time = 11"))).first()
    shares = [row[f"{c}_pct"] for c in CAUSES]
    assert shares == [50.0, 0.0, 25.0, 0.0, 25.0]
    without = marts.root_causes(staging_view(silver.where("crs_arr_time in (1, 2, 9)")))
    assert without.count() == 0


def test_airports(silver):
    staging = staging_view(silver)
    detail = {(r.airport_code, r.city_name): r for r in marts.airport_detail(staging).collect()}
    assert detail["SEA", None].total_departures == 0
    assert detail["SEA", None].top_carrier is None
    assert {city for code, city in detail if code == "BOS"} == {"Boston", "Boston, MA"}
    assert detail["BOS", "Boston"].top_carrier == "AA"
    crowded = {(r.airport_code, r.city_name) for r in marts.airport_bottlenecks(staging).collect()}
    assert ("SEA", "Seattle, WA") in crowded


def test_diverted_is_counted(silver):
    mart = marts.flights_by_carrier(staging_view(silver)).where("reporting_airline = 'AA'").first()
    assert mart.total_diverted_flights == 1


@pytest.mark.parametrize("name", marts.MARTS)
def test_base_gives_the_same_marts(silver, name):
    staging = staging_view(silver)
    direct = marts.MARTS[name](staging)
    shared = base.MARTS[name](base.flight_base(staging))
    assert direct.columns == shared.columns
    key = lambda row: repr(tuple(row))
    assert sorted(direct.collect(), key=key) == sorted(shared.collect(), key=key)


def test_invariants(silver):
    staging = staging_view(silver)
    flights = silver.count()
    totals = [
        marts.MARTS[m](staging).agg(F.sum("total_flights")).first()[0]
        for m in ("delay_by_carrier", "flights_by_carrier", "route_performance")
    ]
    assert totals == [flights] * 3
    tiers = marts.delay_by_carrier(staging).agg(*[F.sum(c) for c in marts.TIER_COUNTS]).first()
    assert sum(tiers) == flights
    assert marts.departures(staging).agg(F.sum("total_departures")).first()[0] == flights
    assert marts.arrivals(staging, by_city=True).agg(F.sum("total_arrivals")).first()[0] == flights


def test_checks_find_planted_faults(silver):
    staging = staging_view(silver)
    tables = {"staging": staging, **{n: b(staging) for n, b in marts.MARTS.items()}}
    found = {
        (r.check_name, r.table_name, r.column_name): r.failures
        for r in quality.suite(tables).collect()
    }
    assert len(found) == 18
    assert found["not_null", "staging", "flight_date"] == 1
    assert found["unique", "airport_detail", "airport_code"] == 1
    assert found["unique", "airport_bottlenecks", "airport_code"] == 1
    assert sum(found.values()) == 3


def test_clean_rows_pass_all_checks(spark, lists):
    staging = staging_view(build_silver(edge_rows.landing(spark, [1, 2, 3, 4, 5, 6]), lists))
    tables = {"staging": staging, **{n: b(staging) for n, b in marts.MARTS.items()}}
    assert quality.suite(tables).agg(F.sum("failures")).first()[0] == 0


def test_accepted_values_and_nulls(spark):
    df = spark.createDataFrame([("Minor",), ("Late",), ("Late",), (None,)], "c string")
    assert quality.accepted_values(df, "t", "c", ["Minor"]).first().failures == 1
    strict = quality.accepted_values(df, "t", "c", ["Minor"], allow_null=False)
    assert strict.first().failures == 2


def test_repeated_lookup_code(spark):
    twice = edge_rows.lookups(spark, [("JFK", "John F. Kennedy"), ("JFK", "Idlewild")]).counted()
    assert twice.airports.repeated == 1
    doubled = build_silver(edge_rows.landing(spark, [1]), twice)
    assert doubled.count() == 2


def test_big_lookup_is_not_broadcast(spark):
    from dataclasses import replace

    lists = edge_rows.lookups(spark).counted()
    assert lists.carriers.fits and not replace(lists.carriers, rows=10**7).fits
    assert not edge_rows.lookups(spark).carriers.fits
    df = edge_rows.landing(spark).withColumnRenamed("Reporting_Airline", "reporting_airline")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        hinted = lists.carriers.join_to(df, "reporting_airline")
        plain = replace(lists.carriers, rows=10**7).join_to(df, "reporting_airline")
        assert "BroadcastHashJoin" in hinted._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" not in plain._jdf.queryExecution().toString()
        assert hinted.count() == plain.count() == len(edge_rows.EDGES)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
