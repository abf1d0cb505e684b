"""Streams of files.  Row-local operators, joins with a fixed table and keyed aggregates of
this package take a streaming DataFrame as it is; operators that depend on row order
refuse one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet folder as a stream: files already there, then those that arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(df: DataFrame, time_col: str, length: str, late: str, *keys: str, slide: str | None = None, **values: Column) -> DataFrame:
    """Aggregates by time window and keys; a window closes ``late`` after its end, which
    bounds the state."""
    at = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    found = df.withWatermark(time_col, late).groupBy(at.alias("w"), *keys).agg(*(v.alias(n) for n, v in values.items()))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *values)


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there by now to a Parquet folder, once for each input row over all
    calls with the same checkpoint."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
