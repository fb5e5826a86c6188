"""Running bests over trace files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def running_best(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Streaming table of each run's best objective so far, from a folder of trace CSVs."""
    return spark.readStream.schema(schema).csv(path, header=True).groupBy("run_id").agg(F.min("best").alias("best"), F.max("epoch").alias("epoch"))
