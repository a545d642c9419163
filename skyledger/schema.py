"""The data model: landing, silver and staging columns."""

from pyspark.sql import types as T

# Landing name, silver name, silver type, in landing order.
FLIGHT_COLUMNS = [
    ("Year", "year", "int"),
    ("Month", "month", "int"),
    ("DayOfWeek", "day_of_week", "int"),
    ("FlightDate", "flight_date", "date"),
    ("Reporting_Airline", "reporting_airline", "string"),
    ("Origin", "origin", "string"),
    ("OriginCityName", "origin_city_name", "string"),
    ("Dest", "dest", "string"),
    ("DestCityName", "dest_city_name", "string"),
    ("CRSDepTime", "crs_dep_time", "int"),
    ("DepTime", "dep_time", "int"),
    ("DepDelay", "dep_delay", "int"),
    ("TaxiOut", "taxi_out", "int"),
    ("TaxiIn", "taxi_in", "int"),
    ("CRSArrTime", "crs_arr_time", "int"),
    ("ArrTime", "arr_time", "int"),
    ("ArrDelay", "arr_delay", "int"),
    ("Cancelled", "cancelled", "boolean"),
    ("CancellationCode", "cancellation_code", "string"),
    ("Diverted", "diverted", "boolean"),
    ("ActualElapsedTime", "actual_elapsed_time", "int"),
    ("AirTime", "air_time", "int"),
    ("Distance", "distance", "int"),
    ("CarrierDelay", "carrier_delay", "int"),
    ("WeatherDelay", "weather_delay", "int"),
    ("NASDelay", "nas_delay", "int"),
    ("SecurityDelay", "security_delay", "int"),
    ("LateAircraftDelay", "late_aircraft_delay", "int"),
]

LANDING_COLUMNS = [source for source, _, _ in FLIGHT_COLUMNS]
SILVER_NAMES = {source: silver for source, silver, _ in FLIGHT_COLUMNS}
FLIGHT_TYPES = {silver: kind for _, silver, kind in FLIGHT_COLUMNS}

# The five causes an arrival delay is split into.
CAUSES = [
    "carrier_delay",
    "weather_delay",
    "nas_delay",
    "security_delay",
    "late_aircraft_delay",
]

# Columns that the text path turns into another type; the rest stays text.
STAGING_TYPES = {
    "FlightDate": "DATE",
    "Cancelled": "BOOLEAN",
    "Diverted": "BOOLEAN",
    "DepDelay": "DOUBLE",
    "TaxiOut": "DOUBLE",
    "TaxiIn": "DOUBLE",
    "ArrDelay": "DOUBLE",
    "ActualElapsedTime": "DOUBLE",
    "AirTime": "DOUBLE",
    "Distance": "DOUBLE",
    "CarrierDelay": "DOUBLE",
    "WeatherDelay": "DOUBLE",
    "NASDelay": "DOUBLE",
    "SecurityDelay": "DOUBLE",
    "LateAircraftDelay": "DOUBLE",
}

# Columns the silver step adds to the 28 of the landing files.
ADDED_TYPES = {
    "airline_name": "string",
    "origin_airport_name": "string",
    "cancellation_reason": "string",
    "is_delayed": "boolean",
    "delay_category": "string",
}

SILVER_COLUMNS = [silver for _, silver, _ in FLIGHT_COLUMNS] + list(ADDED_TYPES)

# Columns of the staging view, in its order.
STAGING_COLUMNS = [
    "flight_date",
    "reporting_airline",
    "origin",
    "origin_city_name",
    "dest",
    "dest_city_name",
    "airline_name",
    "crs_dep_time",
    "crs_arr_time",
    "dep_time",
    "arr_time",
    "actual_elapsed_time",
    "air_time",
    "arr_delay",
    "dep_delay",
    "carrier_delay",
    "weather_delay",
    "nas_delay",
    "security_delay",
    "late_aircraft_delay",
    "delay_category",
    "cancelled",
    "cancellation_code",
    "diverted",
    "taxi_out",
    "taxi_in",
    "distance",
    "flight_year",
    "flight_month",
    "day_of_week",
]

# The month a row belongs to is the directory it is stored in.
MONTH_KEYS = ["year", "month"]
# Rows are sorted by these inside each file of the clustered table.
CLUSTER_KEYS = ["reporting_airline", "origin"]

# Keys and file names of the published lookups.
LOOKUP_FILES = {
    "months": "L_MONTHS.csv",
    "weekdays": "L_WEEKDAYS.csv",
    "carriers": "L_UNIQUE_CARRIERS.csv",
    "airports": "L_AIRPORT.csv",
    "yes_no": "L_YESNO_RESP.csv",
    "cancellation": "L_CANCELLATION.csv",
}


def landing_schema() -> T.StructType:
    """Every landing column as text."""
    return T.StructType([T.StructField(name, T.StringType()) for name in LANDING_COLUMNS])


def silver_schema() -> T.StructType:
    """The 33 typed silver columns."""
    fields = ", ".join(f"{name} {kind}" for name, kind in {**FLIGHT_TYPES, **ADDED_TYPES}.items())
    return T.StructType.fromDDL(fields)


def staging_type(column: str) -> str:
    """Type of a column on the text path."""
    return STAGING_TYPES.get(column, "STRING")


def staging_schema(columns: list[str]) -> T.StructType:
    """Schema of the text path's staging table for the given columns."""
    return T.StructType.fromDDL(", ".join(f"`{c}` {staging_type(c)}" for c in columns))
