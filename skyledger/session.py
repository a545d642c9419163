"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The JVM does not compile methods over 8000 bytes of code but interprets
# them, many times slower. The wide row steps (28 parsed columns and three
# joins in one stage) exceed that, so such stages are generated per operator,
# in methods that are compiled; narrower stages stay whole.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session and return it."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
