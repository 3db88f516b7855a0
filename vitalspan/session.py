"""Session helper for tests, benchmarks and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "vitalspan", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Larger generated methods are never compiled by the JVM's JIT.
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    for name, value in {**base, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
