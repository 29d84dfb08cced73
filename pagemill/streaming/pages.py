"""The row-local path over a stream of files or pages.

Every step is stateless, so the batch functions apply unchanged; repeated deliveries are dropped within a watermark and
summaries are windowed by event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import health, script
from ..session import ship


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream of parquet files as they arrive in a folder."""
    ship(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(pages: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once; a delivery later than ``late`` after the newest seen may pass again, state stays bounded by it."""
    return pages.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def judged(pages: DataFrame, text: str = "markdown") -> DataFrame:
    d = health.assessed(pages, text, "_h")
    return d.withColumn("verdict", F.col("_h.verdict")).withColumn("lang", script.dominant(F.col("_h.letters"))).drop("_h")


def verdicts(pages: DataFrame, time: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Pages by verdict and language in tumbling windows of event time."""
    return judged(pages).withWatermark(time, late).groupBy(F.window(time, width), "verdict", "lang").agg(F.count("*").alias("pages"))
