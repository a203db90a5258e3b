"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A contract with many rules compiles to large methods.  The JVM never
    # optimises a method beyond 8000 bytes of code; above that limit Spark's
    # split expressions are several times faster than one fused method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call-site capture for every Python column expression slows down the
    # building of plans with hundreds of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
