"""The same results as plain SQL, for an independent engine."""

from __future__ import annotations

from skyledger.functions.delays import PROFILE_LABELS, PROFILE_ORDER
from skyledger.functions.figures import CANCELLATION_LABELS, MONTH_NAMES, WEEKDAY_LABELS
from skyledger.operators.marts import SHOWN_BY
from skyledger.operators.profile import FLAGS, NUMERIC
from skyledger.operators.quality import NOT_NULL, UNIQUE
from skyledger.plans.moments import DESCRIBED
from skyledger.schema import CAUSES, FLIGHT_COLUMNS, STAGING_COLUMNS, staging_type
from verification.fixture import ORACLE_MARKS, flights_sql
from verification.registry import AIRPORT, MONTH, SAMPLE_SIZE, SAMPLES, STORED_SAMPLES, VOLUMES, YEAR


def rnd(value: str, places: int = 2) -> str:
    return f"cast(round(cast({value} as decimal(28,10)), {places}) as double)"


def big(value: str) -> str:
    return f"cast({value} as bigint)"


def pct(part: str, whole: str, places: int = 2) -> str:
    return rnd(f"cast({part} as double) / nullif({whole}, 0) * 100", places)


def case_label(code: str, labels: dict) -> str:
    whens = " ".join(f"when {code} = {k!r} then '{v}'" for k, v in labels.items())
    return f"case {whens} end"


def tier(null_as: str, labels: dict | None = None) -> str:
    names = labels or {}
    n = lambda t: f"'{names.get(t, t)}'"
    return (
        f"case when arr_delay is null then {null_as} when arr_delay <= 0 then {n('No Delay')} "
        f"when arr_delay <= 15 then {n('Minor')} when arr_delay <= 60 then {n('Major')} "
        f"else {n('Severe')} end"
    )


LATE = "coalesce(arr_delay > 15, false)"
CAUSE_FILLS = ", ".join(f"coalesce(f.{c}, 0) as {c}" for c in CAUSES)
KEPT = ", ".join(
    f"f.{n}" for _, n, _ in FLIGHT_COLUMNS if n not in CAUSES and n != "cancellation_code"
)
CODES = """
carriers as (select distinct 'C' || lpad(cast(s_suppkey % 15 as varchar), 2, '0') as code,
  'Carrier ' || cast(s_suppkey % 15 as varchar) as name from supplier where s_suppkey % 15 <> 14),
airports as (select distinct 'A' || lpad(cast(p_partkey % 42 as varchar), 2, '0') as code,
  'Airport ' || cast(p_partkey % 42 as varchar) as name from part where p_partkey % 42 <> 7),
reasons as (select * from (values ('A', 'Carrier'), ('B', 'Weather'), ('C', 'NAS'),
  ('D', 'Security')) v(code, name))
"""
F = f"flights as ({flights_sql(ORACLE_MARKS, 'lineitem')})"
SILVER = f"""{F}, {CODES},
silver as (
  select {KEPT}, {CAUSE_FILLS}, coalesce(f.cancellation_code, 'N/A') as cancellation_code,
    c.name as airline_name, a.name as origin_airport_name, r.name as cancellation_reason,
    {LATE} as is_delayed, {tier("'Severe'")} as delay_category
  from flights f
  left join carriers c on f.reporting_airline = c.code
  left join airports a on f.origin = a.code
  left join reasons r on coalesce(f.cancellation_code, 'N/A') = r.code)
"""
_staged = ", ".join(
    {"flight_year": "year as flight_year", "flight_month": "month as flight_month"}.get(c, c)
    for c in STAGING_COLUMNS
)
STG = f"{SILVER}, stg as (select {_staged} from silver)"


def over(prelude: str, select: str) -> str:
    return f"with {prelude} {select}"


def text_of(name: str, kind: str, alias: str) -> str:
    decimal_text = {"taxi_out", "taxi_in", "air_time", "distance"}
    if kind == "boolean":
        return f"case when {name} then '1.00' else '0.00' end as {alias}"
    if name in decimal_text or name.endswith("_delay"):
        return f"cast({name} as varchar) || '.00' as {alias}"
    return f"cast({name} as varchar) as {alias}"


LANDING = "select " + ", ".join(text_of(n, k, f'"{s}"') for s, n, k in FLIGHT_COLUMNS) + " from flights"


def ranked_sql(name: str) -> str:
    """A mart with the place of each row in the order it is shown."""
    volume, *ties = SHOWN_BY[name]
    return over(
        f"{STG}, mart as ({MARTS[name]})",
        f"""select *, cast(row_number() over (order by {volume} desc,
        {", ".join(f"{c} asc nulls first" for c in ties)}) as int) as place from mart""",
    )


def sample_sql(name: str) -> str:
    """The lowest draws: digests of the values, the number of the copy and the seed."""
    columns = SAMPLES[name]
    listed = ", ".join(columns)
    parts = [f"coalesce(cast({c} as varchar), '-')" for c in columns]
    kept = "true" if name == "sample_flights" else " and ".join(f"{c} is not null" for c in columns)
    return over(
        F,
        f"""select {listed} from (
          select *, md5({" || '|' || ".join([*parts, "cast(copy as varchar)", "'42'"])}) as draw
          from (select {listed}, row_number() over (partition by {listed}) - 1 as copy
                from flights where {kept}))
        order by draw, copy limit {SAMPLE_SIZE}""",
    )


def stored_sample_sql(name: str) -> str:
    """The lowest draws: digests of the file's name, the row's place in it and the seed."""
    columns = SAMPLES[name]
    kept = "true" if name == "sample_flights" else " and ".join(f"{c} is not null" for c in columns)
    placed = """(select *, md5('lineitem.parquet|' || cast(place as varchar) || '|42') as draw
      from (select *, row_number() over () - 1 as place from lineitem))"""
    return f"""select {", ".join(columns)} from ({flights_sql(ORACLE_MARKS, placed, "draw")})
      where {kept} order by draw limit {SAMPLE_SIZE}"""


def figures_sql(columns: list[str], where: str = "") -> str:
    """Minimum, mean, maximum and deviation of each column, one row each."""
    return each(
        [
            f"""select '{name}' as column_name, {rnd(f"min({c})")} as min_value,
            {rnd(f"avg({c})")} as mean_value, {rnd(f"max({c})")} as max_value,
            {rnd(f"stddev_samp({c})")} as std_value from flights {where}"""
            for name, c in {n: f"cast({n} as int)" for n in columns}.items()
        ]
    )


def corr_sql(where: str = "") -> str:
    """Correlation of every two chosen columns."""
    return each(
        [
            f"""select '{a}' as column_a, '{b}' as column_b,
            {rnd(f"corr({a}, {b})", 6)} as correlation from flights {where}"""
            for a in CHOSEN
            for b in CHOSEN
        ]
    )


MARTS = {
    "delay_by_carrier": f"""select flight_year, flight_month, reporting_airline,
      count(*) as total_flights, {big("sum(cast(cancelled as bigint))")} as total_cancelled_flights,
      {pct("sum(cast(cancelled as bigint))", "count(*)")} as cancellation_rate_pct,
      {big("sum(cast(diverted as bigint))")} as total_diverted_flights,
      {pct("sum(cast(diverted as bigint))", "count(*)")} as diverted_rate_pct,
      {rnd("avg(dep_delay)")} as avg_dep_delay_mins, {rnd("avg(arr_delay)")} as avg_arr_delay_mins,
      {big("sum(case when delay_category = 'No Delay' then 1 else 0 end)")} as total_on_time_flights,
      {big("sum(case when delay_category = 'Minor' then 1 else 0 end)")} as total_minor_delayed,
      {big("sum(case when delay_category = 'Major' then 1 else 0 end)")} as total_major_delayed,
      {big("sum(case when delay_category = 'Severe' then 1 else 0 end)")} as total_severe_delayed
      from stg group by all""",
    "root_causes": f"""select reporting_airline, airline_name, count(*) as total_delayed_flights,
      {big("sum(arr_delay)")} as total_delay_minutes,
      {", ".join(f'{pct(f"sum({c})", "sum(arr_delay)")} as {c}_pct' for c in CAUSES)}
      from stg where arr_delay > 0 group by reporting_airline, airline_name""",
    "flights_by_carrier": f"""select reporting_airline, airline_name, count(*) as total_flights,
      {big("sum(cast(diverted as bigint))")} as total_diverted_flights,
      {pct("sum(cast(diverted as bigint))", "count(*)")} as diverted_rate_pct
      from stg group by reporting_airline, airline_name""",
    "route_performance": f"""select origin, origin_city_name, dest, dest_city_name,
      count(*) as total_flights, {rnd("avg(air_time)")} as avg_air_time_mins,
      {big("sum(cast(cancelled as bigint))")} as total_cancelled,
      {pct("sum(cast(cancelled as bigint))", "count(*)")} as cancellation_rate_pct,
      {rnd("avg(dep_delay)")} as avg_dep_delay_mins, {rnd("avg(arr_delay)")} as avg_arr_delay_mins
      from stg group by origin, origin_city_name, dest, dest_city_name""",
    "airport_bottlenecks": f"""select coalesce(d.code, a.code) as airport_code,
      coalesce(d.city, a.city) as city_name, coalesce(d.n, 0) as total_departures,
      coalesce(a.n, 0) as total_arrivals, coalesce(d.n, 0) + coalesce(a.n, 0) as total_traffic,
      d.taxi as avg_taxi_out_mins, d.delay as avg_dep_delay_mins,
      a.taxi as avg_taxi_in_mins, a.delay as avg_arr_delay_mins
      from (select origin as code, origin_city_name as city, count(*) as n,
              {rnd("avg(taxi_out)")} as taxi, {rnd("avg(dep_delay)")} as delay
            from stg group by 1, 2) d
      full outer join (select dest as code, dest_city_name as city, count(*) as n,
              {rnd("avg(taxi_in)")} as taxi, {rnd("avg(arr_delay)")} as delay
            from stg group by 1, 2) a on d.code = a.code""",
    "airport_detail": f"""select coalesce(d.code, a.code) as airport_code, d.city as city_name,
      coalesce(d.n, 0) as total_departures, coalesce(a.n, 0) as total_arrivals,
      coalesce(d.n, 0) + coalesce(a.n, 0) as total_traffic,
      d.taxi as avg_taxi_out_mins, a.taxi as avg_taxi_in_mins,
      d.delay as avg_dep_delay_mins, a.delay as avg_arr_delay_mins,
      coalesce(d.diverted, 0) as total_diverted, t.airline as top_carrier
      from (select origin as code, origin_city_name as city, count(*) as n,
              {rnd("avg(taxi_out)")} as taxi, {rnd("avg(dep_delay)")} as delay,
              {big("sum(cast(diverted as bigint))")} as diverted from stg group by 1, 2) d
      full outer join (select dest as code, count(*) as n,
              {rnd("avg(taxi_in)")} as taxi, {rnd("avg(arr_delay)")} as delay
            from stg group by 1) a on d.code = a.code
      left join (select origin as code, reporting_airline as airline from
              (select origin, reporting_airline, count(*) as n from stg group by 1, 2)
            qualify row_number() over (partition by origin order by n desc, reporting_airline) = 1) t
        on coalesce(d.code, a.code) = t.code""",
}

# Marts as named subqueries for what is built on them.
DBC = f"{STG}, dbc as ({MARTS['delay_by_carrier']})"
FBC = f"fbc as ({MARTS['flights_by_carrier']})"
NAMES = "names as (select reporting_airline as code, max(airline_name) as name from fbc group by 1)"
MEANS = f"""means as (select reporting_airline,
  {rnd("cast(sum(cast(avg_arr_delay_mins as decimal(18,2))) as double) / nullif(count(avg_arr_delay_mins), 0)", 6)} as mean_arr_delay_mins
  from picked group by 1)"""


def kpi_sql(where: str) -> str:
    delayed = "total_minor_delayed + total_major_delayed + total_severe_delayed"
    return over(
        f"{DBC}, {FBC}, {NAMES}, picked as (select * from dbc {where}), {MEANS}",
        f"""select {big("coalesce(sum(total_flights), 0)")} as total_flights,
          coalesce({pct(f"sum({delayed})", "sum(total_flights)", 1)}, 0) as delay_rate_pct,
          coalesce({pct("sum(total_cancelled_flights)", "sum(total_flights)", 1)}, 0) as cancel_rate_pct,
          (select coalesce(name, reporting_airline) from means left join names on reporting_airline = code
           where mean_arr_delay_mins is not null
           order by mean_arr_delay_mins desc, reporting_airline limit 1) as worst_airline
        from picked""",
    )


def trend_sql(where: str) -> str:
    delayed = "total_minor_delayed + total_major_delayed + total_severe_delayed"
    sums = {
        "total_flights": "total_flights",
        "total_minor": "total_minor_delayed",
        "total_major": "total_major_delayed",
        "total_severe": "total_severe_delayed",
        "total_cancelled": "total_cancelled_flights",
    }
    return over(
        DBC,
        f"""select flight_month, {", ".join(f"{big(f'sum({c})')} as {n}" for n, c in sums.items())},
        {pct(f"sum({delayed})", "sum(total_flights)", 1)} as delay_rate_pct,
        {pct("sum(total_cancelled_flights)", "sum(total_flights)", 2)} as cancel_rate_pct,
        {case_label("flight_month", MONTH_NAMES)} as month_name
        from dbc {where} group by flight_month""",
    )


def tiers_sql(null_as: str, labels: dict | None = None) -> str:
    return over(
        F,
        f"""select arr_delay, {LATE} as is_delayed, {tier(null_as, labels)} as delay_category,
        count(*) as flight_count from flights group by all""",
    )


def each(parts: list[str]) -> str:
    return " union all ".join(parts)


def histogram_sql(value: str, known: str, bins: int) -> str:
    return over(
        f"""{F}, v as (select cast({value} as double) as x from flights where {known} is not null),
        b as (select min(x) as lo, max(x) as hi from v),
        n as (select least(cast(floor((x - lo) * {bins} / (hi - lo)) as int), {bins - 1}) as bin,
                count(*) as c from v, b group by 1),
        e as (select cast(unnest(range({bins})) as int) as bin)""",
        f"""select e.bin, {rnd(f"lo + e.bin * (hi - lo) / {bins}", 6)} as bin_start,
          {rnd(f"lo + e.bin * (hi - lo) / {bins} + (hi - lo) / {bins}", 6)} as bin_end,
          coalesce(n.c, 0) as flight_count
        from e cross join b left join n on e.bin = n.bin""",
    )


def null_rows(where: str = "") -> str:
    return each(
        [
            f"select '{n}' as column_name, count(*) filter ({n} is null) as null_count, "
            f"{pct(f'count(*) filter ({n} is null)', 'count(*)')} as null_pct from flights {where}"
            for _, n, _ in FLIGHT_COLUMNS
        ]
    )


def not_null_rows() -> str:
    return each(
        [
            f"select 'not_null' as check_name, '{t}' as table_name, '{c}' as column_name, "
            f"count(*) filter ({c} is null) as failures from {'stg' if t == 'staging' else t}"
            for t, columns in NOT_NULL.items()
            for c in columns
        ]
    )


def unique_rows() -> str:
    return each(
        [
            f"select 'unique' as check_name, '{t}' as table_name, '{c}' as column_name, "
            f"count(*) filter (n > 1) as failures from "
            f"(select {c}, count(*) as n from {t} where {c} is not null group by 1)"
            for t, columns in UNIQUE.items()
            for c in columns
        ]
    )


ALL_MARTS = f"{STG}, " + ", ".join(f"{n} as ({s})" for n, s in MARTS.items())
CHOSEN = [*CAUSES, "arr_delay"]
NULL_GROUPS = [*CAUSES, "cancellation_code", "dep_time", "arr_time"]


ACCEPTED_ROWS = """select 'accepted_values' as check_name, 'staging' as table_name,
  'delay_category' as column_name, count(distinct delay_category) filter
  (delay_category not in ('No Delay', 'Minor', 'Major', 'Severe')) as failures from stg"""


def clock(hhmm: str) -> str:
    return (
        f"case when {hhmm} >= 0 and {hhmm} <= 2400 and {hhmm} % 100 < 60 then cast(flight_date as timestamp)"
        f" + to_hours({hhmm} // 100) + to_minutes({hhmm} % 100) end"
    )


_bad_number = "case when day_of_week in (1, 2, 3) then null else distance end"
_no_flag = "case when day_of_week = 4 then null else cancelled end"
_late_cause = ", ".join(
    f"{big(f'sum(case when arr_delay > 0 then {c} end)')} as late_{c}" for c in CAUSES
)
_averaged = ["dep_delay", "arr_delay", "taxi_out", "taxi_in", "air_time"]
_base_tiers = {
    "total_on_time_flights": "No Delay",
    "total_minor_delayed": "Minor",
    "total_major_delayed": "Major",
    "total_severe_delayed": "Severe",
}


def oracle_sql() -> dict[str, str]:
    """SQL per query name."""
    sql = {name: over(STG, text) for name, text in MARTS.items()}
    sql |= {f"{name}_{way}": text for way in ("from_base", "from_cells") for name, text in sql.items()}
    sql |= {
        "bronze_roundtrip": over(F, LANDING),
        "scan_month": over(F, f"{LANDING} where year = {YEAR} and month = {MONTH}"),
        "landing_csv": over(F, LANDING),
        "lookup_publish": over(
            f"{F}, {CODES}",
            f"""select 'carriers' as list, code, name as description from carriers
            union all select 'airports', * from airports union all select 'cancellation', * from reasons
            union all select distinct 'months', cast(month as varchar),
              {case_label("month", MONTH_NAMES)} from flights
            union all select distinct 'weekdays', cast(day_of_week as varchar),
              {case_label("day_of_week", WEEKDAY_LABELS)} from flights
            union all select distinct 'yes_no', case when cancelled then '1' else '0' end,
              case when cancelled then 'Yes' else 'No' end from flights""",
        ),
        "raw_text_table": over(F, LANDING),
        "scan_text_month": over(F, f"{LANDING} where year = {YEAR} and month = {MONTH}"),
        "ingest_targets": over(
            F,
            f"""select layer, cast(month as varchar) as month_text, count(*) as flight_count,
            count(arr_delay) as known_delays, {big("sum(length(origin_city_name))")} as letters
            from flights, (values ('bronze'), ('raw'), ('staging')) t(layer)
            where year = {YEAR} group by all""",
        ),
        "scan_all_months": over(
            F,
            f"""select year, month, count(*) as flight_count, {big("sum(distance)")} as miles
            from flights group by all""",
        ),
        "silver_rerun": over(SILVER, "select * from silver"),
        "clustered_scan": over(
            SILVER,
            f"select * from silver where reporting_airline = 'C03' and origin = '{AIRPORT}'",
        ),
        "interleaved_scan": over(
            SILVER, f"select * from silver where year = {YEAR} and origin = '{AIRPORT}'"
        ),
        "clustered_day": over(
            SILVER, f"select * from silver where flight_date = date '{YEAR}-03-15'"
        ),
        "backfill": over(SILVER, "select *, cast(0 as int) as left_over from silver"),
        "stream_landing": over(SILVER, "select *, cast(0 as int) as left_over from silver"),
        "archive_landing": over(F, LANDING),
        "silver": over(SILVER, "select * from silver"),
        "stg_view": over(STG, "select * from stg"),
        "staging_pandas_rules": over(
            F,
            "select "
            + ", ".join(
                {
                    "DATE": f'{n} as "{s}"',
                    "DOUBLE": f'cast({n} as double) as "{s}"',
                    "BOOLEAN": f'coalesce({n}, false) as "{s}"',
                    "STRING": f'cast({n} as varchar) as "{s}"',
                }[staging_type(s)]
                for s, n, _ in FLIGHT_COLUMNS
            )
            + f", {tier('null')} as delay_category from flights",
        ),
        "tolerant_cast": over(
            F,
            f"""select cast(day_of_week as varchar) as dow,
            case when month <> 2 then flight_date end as flight_date, flight_date as flight_date_any,
            count({_bad_number}) as distances, {big(f"sum({_bad_number})")} as miles,
            cast(sum({_bad_number}) as double) as miles_exact, count({_no_flag}) as known_flags,
            count(*) filter (coalesce({_no_flag}, false)) as cancelled_flights
            from flights group by all""",
        ),
        "delay_flags": tiers_sql("'Severe'"),
        "delay_category_null": tiers_sql("null"),
        "delay_category_unknown": tiers_sql("'Unknown'", PROFILE_LABELS),
        "hhmm_to_ts": over(
            F,
            f"""select {clock("crs_dep_time")} as scheduled_at, {clock("dep_time")} as departed_at,
            count(*) as flight_count from flights group by all""",
        ),
        "code_labels": over(
            F,
            f"""select {case_label("cancellation_code", CANCELLATION_LABELS)} as reason,
            {case_label("day_of_week", WEEKDAY_LABELS)} as weekday,
            {case_label("month", MONTH_NAMES)} as month_name, count(*) as flight_count
            from flights group by all""",
        ),
        "flight_base": over(
            STG,
            f"""select flight_year, flight_month, reporting_airline, airline_name,
            origin, origin_city_name, dest, dest_city_name, count(*) as flights,
            {big("sum(cast(cancelled as bigint))")} as cancelled,
            {big("sum(cast(diverted as bigint))")} as diverted,
            {", ".join(f"{big(f'sum({c})')} as {c}_sum, count({c}) as {c}_n" for c in _averaged)},
            {", ".join(f"count(*) filter (delay_category = '{t}') as {n}" for n, t in _base_tiers.items())},
            count(*) filter (arr_delay > 0) as late_flights,
            {big("sum(case when arr_delay > 0 then arr_delay end)")} as late_minutes, {_late_cause}
            from stg group by all""",
        ),
        "top_carrier": over(
            STG,
            """select origin as airport_code, reporting_airline as top_carrier, n as flight_count
            from (select origin, reporting_airline, count(*) as n from stg group by 1, 2)
            qualify row_number() over (partition by origin order by n desc, reporting_airline) = 1""",
        ),
        "mart_ranked": over(
            f"{STG}, {FBC}",
            """select *, cast(row_number() over (order by total_flights desc, reporting_airline,
            airline_name) as int) as place from fbc""",
        ),
        "root_causes_ranked": ranked_sql("root_causes"),
        "airport_detail_ranked": ranked_sql("airport_detail"),
        **dict.fromkeys(
            ("mart_refresh", "mart_rebuild"),
            over(
                STG,
                " union all ".join(
                    f"""select '{name}' as mart, count(*) as row_count,
                    {big(f"sum({volume})")} as volume from ({MARTS[name]})"""
                    for name, volume in VOLUMES.items()
                ),
            ),
        ),
        "kpi": kpi_sql(""),
        "kpi_year": kpi_sql(f"where flight_year = {YEAR}"),
        "worst_airline": over(
            f"{DBC}, {FBC}, {NAMES}, picked as (select * from dbc), {MEANS}",
            """select reporting_airline, mean_arr_delay_mins,
            coalesce(name, reporting_airline) as airline_label
            from means left join names on reporting_airline = code
            where mean_arr_delay_mins is not null
            order by mean_arr_delay_mins desc, reporting_airline limit 1""",
        ),
        "monthly_trend": trend_sql(""),
        "monthly_trend_year": trend_sql(f"where flight_year = {YEAR}"),
        "airline_label": over(
            f"{STG}, {FBC}, {NAMES}, rc as ({MARTS['root_causes']})",
            """select rc.*, coalesce(name, reporting_airline) as airline_label
            from rc left join names on reporting_airline = code""",
        ),
        "top_routes": over(
            f"{STG}, rp as ({MARTS['route_performance']})",
            f"""select cast(row_number() over (order by total_flights desc, origin, origin_city_name,
              dest, dest_city_name) as int) as place, origin, dest, total_flights,
              avg_air_time_mins, cancellation_rate_pct
            from rp where origin = '{AIRPORT}' qualify place <= 20""",
        ),
        "top_airports": over(
            f"{STG}, ab as ({MARTS['airport_bottlenecks']}), best as (select *, cast(row_number() over "
            "(order by total_traffic desc, airport_code, city_name) as int) as place from ab qualify place <= 10)",
            """select place, cast(row_number() over (order by avg_arr_delay_mins nulls last,
            airport_code, city_name) as int) as place_by_delay, airport_code, city_name,
            total_traffic, avg_taxi_out_mins, avg_arr_delay_mins from best""",
        ),
        "airport_card": over(
            f"{STG}, {FBC}, {NAMES}, ad as ({MARTS['airport_detail']})",
            f"""select airport_code, city_name, total_traffic, total_departures, total_arrivals,
            {rnd("avg_taxi_out_mins", 1)} as avg_taxi_out_mins,
            {rnd("avg_taxi_in_mins", 1)} as avg_taxi_in_mins,
            {rnd("avg_dep_delay_mins", 1)} as avg_dep_delay_mins,
            {rnd("avg_arr_delay_mins", 1)} as avg_arr_delay_mins, total_diverted,
            coalesce(name, top_carrier) as top_carrier
            from ad left join names on top_carrier = code
            where airport_code = '{AIRPORT}' order by total_traffic desc, city_name limit 1""",
        ),
        "selection_lists": over(
            F,
            """select origin as airport_code from flights union select dest from flights""",
        ),
        "row_counts": over(
            F, "select count(*) as row_count, cast(28 as int) as column_count from flights"
        ),
        "describe": over(F, figures_sql(NUMERIC + FLAGS)),
        "describe_merged": over(F, figures_sql(DESCRIBED, f"where year = {YEAR}")),
        "null_profile": over(F, f"select * from ({null_rows()}) where null_count > 0"),
        "critical_nulls": over(
            F,
            f"select column_name, null_pct from ({null_rows('where not cancelled')}) where null_pct > 5",
        ),
        "null_by_cancelled": over(
            F,
            "select cancelled, count(*) as flights, "
            + ", ".join(
                f"{pct(f'count(*) filter ({c} is null)', 'count(*)')} as {c}_null_pct"
                for c in NULL_GROUPS
            )
            + " from flights where cancelled is not null group by cancelled",
        ),
        "all_null_share": over(
            F,
            f"""select count(*) as cancelled_flights,
            {pct("count(*) filter (" + " and ".join(f"{c} is null" for c in CAUSES) + ")", "count(*)", 1)}
              as all_null_pct from flights where cancelled""",
        ),
        "distinct_values": over(
            F,
            " union ".join(
                f"select '{c}' as column_name, cast({c} as varchar) as value from flights"
                for c in ("year", "month", "origin")
            ),
        ),
        "distinct_counts_merged": over(
            F,
            " union all ".join(
                f"""select count(distinct reporting_airline) as reporting_airline_count,
                count(distinct origin) as origin_count, count(distinct dest) as dest_count,
                cast({year} as int) as year from flights {where}"""
                for year, where in (("null", ""), (YEAR, f"where year = {YEAR}"))
            ),
        ),
        "preview": over(
            F, f"select * from flights order by {', '.join(f'{n} nulls first' for _, n, _ in FLIGHT_COLUMNS)} limit 5"
        ),
        "missing_months": over(
            F,
            f"""select cast(month as varchar) as month_text, count(*) as flight_count, true as refused
            from flights where year = {YEAR} and month <> {MONTH} group by month""",
        ),
        "distinct_counts": over(
            F,
            """select count(distinct reporting_airline) as reporting_airline_count,
            count(distinct origin) as origin_count, count(distinct dest) as dest_count from flights""",
        ),
        "flights_by_weekday": over(
            F,
            f"""select day_of_week, count(*) as flight_count,
            {case_label("day_of_week", WEEKDAY_LABELS)} as weekday from flights group by day_of_week""",
        ),
        "flights_by_day": over(
            F, "select flight_date, count(*) as flight_count from flights group by flight_date"
        ),
        "top_airlines": over(
            F,
            """select reporting_airline, count(*) as flight_count from flights
            group by 1 order by 2 desc, 1 limit 10""",
        ),
        "top_origins": over(
            F,
            """select origin, count(*) as flight_count from flights
            group by 1 order by 2 desc, 1 limit 10""",
        ),
        "distance_stats": over(
            F,
            f"""select min(distance) as min_distance, max(distance) as max_distance,
            {rnd("avg(distance)", 0)} as mean_distance from flights""",
        ),
        "hist_distance": histogram_sql("distance", "distance", 60),
        "hist_arr_delay": histogram_sql("least(greatest(arr_delay, -60), 180)", "arr_delay", 80),
        "departures_by_hour": over(
            F,
            """select cast(crs_dep_time // 100 as int) as dep_hour, count(*) as flight_count
            from flights where crs_dep_time // 100 <= 23 group by 1""",
        ),
        "flag_rates": over(
            F,
            f"""select {pct("sum(cast(diverted as int))", "count(diverted)")} as diverted_pct,
            {pct(f"count(*) filter ({LATE})", "count(*)")} as late_pct_of_all,
            {pct("count(*) filter (arr_delay < 0)", "count(arr_delay)")} as early_pct_of_known
            from flights""",
        ),
        "cancel_reasons": over(
            F,
            f"""select {case_label("cancellation_code", CANCELLATION_LABELS)} as reason,
            count(*) as flight_count from flights where cancellation_code in ('A', 'B', 'C', 'D')
            group by 1""",
        ),
        "cancel_rate_top": over(
            F,
            f"""select reporting_airline, {big("sum(cast(cancelled as bigint))")} as cancelled_flights,
            count(cancelled) as flights,
            {pct("sum(cast(cancelled as bigint))", "count(cancelled)", 6)} as cancel_rate
            from flights group by 1 order by cancel_rate desc nulls last, 1 limit 10""",
        ),
        "avg_delay_top": over(
            F,
            f"""select reporting_airline, {rnd("avg(arr_delay)", 6)} as avg_arr_delay
            from flights group by 1 order by 2 desc nulls last, 1 limit 10""",
        ),
        "category_shares": over(
            f"{F}, t as (select {tier(chr(39) + 'Unknown' + chr(39), PROFILE_LABELS)} as tier from flights)",
            each(
                [
                    f"""select cast({i + 1} as int) as place, '{name}' as category,
                    count(*) filter (tier = '{name}') as flight_count,
                    {pct(f"count(*) filter (tier = '{name}')", "count(*)")} as pct from t"""
                    for i, name in enumerate(PROFILE_ORDER)
                ]
            ),
        ),
        "cause_shares": over(
            F,
            each(
                [
                    f"""select '{c}' as cause, {big(f"coalesce(sum({c}), 0)")} as minutes,
                    {pct(f"sum({c})", "(" + " + ".join(f"sum({o})" for o in CAUSES) + ")")} as pct
                    from flights"""
                    for c in CAUSES
                ]
            ),
        ),
        "delay_corr": over(F, corr_sql()),
        "delay_corr_merged": over(F, corr_sql(f"where year = {YEAR}")),
        **{name: stored_sample_sql(like) for name, like in STORED_SAMPLES.items()},
        **{name: sample_sql(name) for name in SAMPLES},
        "outlier_counts": over(
            F,
            each(
                [
                    f"select '{n}' as rule, count(*) filter ({w}) as row_count from flights"
                    for n, w in {
                        "distance_not_positive": "distance <= 0",
                        "arrival_too_early": "arr_delay < -120",
                        "arrival_too_late": "arr_delay > 600",
                    }.items()
                ]
            ),
        ),
        "taxi_time": over(
            F,
            """select actual_elapsed_time - air_time as taxi_time, count(*) as flight_count
            from flights group by 1""",
        ),
        "dq_not_null": over(ALL_MARTS, not_null_rows()),
        "dq_unique": over(ALL_MARTS, unique_rows()),
        "dq_accepted": over(STG, ACCEPTED_ROWS),
        "dq_on_write": over(
            ALL_MARTS,
            f"""select * from ({not_null_rows()}) union all select * from ({unique_rows()})
            union all {ACCEPTED_ROWS}""",
        ),
        "dq_row_counts": over(
            F,
            """select year, month, count(*) as raw_rows, count(*) as bronze_rows,
            count(*) as silver_rows, true as agree from flights group by all""",
        ),
    }
    return sql
