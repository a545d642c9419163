"""Hand-written landing rows: every boundary and odd value once."""

from skyledger.schema import CAUSES, LANDING_COLUMNS, SILVER_NAMES, landing_schema
from skyledger.sources.lookups import Lookups

USUAL = {
    "Year": "2023",
    "Month": "1",
    "DayOfWeek": "7",
    "FlightDate": "2023-01-15",
    "Reporting_Airline": "AA",
    "Origin": "JFK",
    "OriginCityName": "New York, NY",
    "Dest": "LAX",
    "DestCityName": "Los Angeles, CA",
    "CRSDepTime": "930",
    "DepTime": "935",
    "DepDelay": "5.00",
    "TaxiOut": "12.00",
    "TaxiIn": "6.00",
    "CRSArrTime": "1230",
    "ArrTime": "1235",
    "ArrDelay": "5.00",
    "Cancelled": "0.00",
    "CancellationCode": None,
    "Diverted": "0.00",
    "ActualElapsedTime": "360.00",
    "AirTime": "342.00",
    "Distance": "2475.00",
    "CarrierDelay": "0.00",
    "WeatherDelay": "0.00",
    "NASDelay": "0.00",
    "SecurityDelay": "0.00",
    "LateAircraftDelay": "0.00",
}
NO_CAUSES = dict.fromkeys(source for source, name in SILVER_NAMES.items() if name in CAUSES)
NOT_FLOWN = dict.fromkeys(
    ["DepTime", "DepDelay", "TaxiOut", "TaxiIn", "ArrTime", "ArrDelay", "ActualElapsedTime", "AirTime"]
)

# number: (change, is_delayed, delay_category)
EDGES = {
    1: ({"ArrDelay": "-5.00"}, False, "No Delay"),
    2: ({"ArrDelay": "0.00"}, False, "No Delay"),
    3: ({"ArrDelay": "1.00"}, False, "Minor"),
    4: ({"ArrDelay": "15.00"}, False, "Minor"),
    5: ({"ArrDelay": "16.00"}, True, "Major"),
    6: ({"ArrDelay": "60.00"}, True, "Major"),
    7: ({"ArrDelay": "61.00"}, True, "Severe"),
    8: ({"Cancelled": "1.00", "CancellationCode": "B", **NO_CAUSES, **NOT_FLOWN}, False, "Severe"),
    9: ({"Diverted": "1.00", "ArrDelay": None, "DepDelay": "10.00"}, False, "Severe"),
    10: ({**NO_CAUSES, "ArrDelay": "5.00"}, False, "Minor"),
    11: (
        {**dict(zip(NO_CAUSES, ["10.00", "0.00", "5.00", "0.00", "5.00"])), "ArrDelay": "20.00"},
        True,
        "Major",
    ),
    12: ({"CancellationCode": None}, False, "Minor"),
    13: ({"Reporting_Airline": "ZZ"}, False, "Minor"),
    14: ({"ArrDelay": "abc"}, False, "Severe"),
    15: ({"FlightDate": "20230115"}, False, "Minor"),
    16: ({"Cancelled": None}, False, "Minor"),
    17: ({"Origin": "BOS", "OriginCityName": "Boston, MA", "Dest": "SEA", "DestCityName": "Seattle, WA"}, False, "Minor"),
    18: (
        {"Origin": "BOS", "OriginCityName": "Boston", "Reporting_Airline": "DL"},
        False,
        "Minor",
    ),
}


def landing(spark, numbers=None):
    """The edge rows; their number travels in CRSArrTime."""
    rows = [
        tuple({**USUAL, **EDGES[n][0], "CRSArrTime": str(n)}[c] for c in LANDING_COLUMNS)
        for n in numbers or EDGES
    ]
    return spark.createDataFrame(rows, landing_schema())


def lookups(spark, airports=(("JFK", "John F. Kennedy"), ("BOS", "Logan"))):
    return Lookups.of(
        spark.createDataFrame(
            [("AA", "American"), ("DL", "Delta")], "carrier_code string, airline_name string"
        ),
        spark.createDataFrame(list(airports), "airport_code string, origin_airport_name string"),
        spark.createDataFrame(
            [("A", "Carrier"), ("B", "Weather"), ("C", "NAS"), ("D", "Security")],
            "cancel_code string, cancellation_reason string",
        ),
    )
