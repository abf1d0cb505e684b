"""Union and distinct rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import sort_keys


def concat(*frames: DataFrame, part: str | None = None) -> DataFrame:
    """All rows of frames with the same columns; ``part`` numbers the frames, for order."""
    if not frames:
        raise ValueError("nothing to concatenate")
    named = [f.withColumn(part, F.lit(i)) for i, f in enumerate(frames)] if part else list(frames)
    return reduce(DataFrame.unionByName, named)


def concat_tables(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows; columns are matched by name, and one that a frame lacks is blank there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def distinct_by(df: DataFrame, *keys: str, order) -> DataFrame:
    """The first row of each key in the given order; null is a key like any other."""
    if not keys:
        raise ValueError("distinct_by needs at least one key")
    at = Window.partitionBy(*keys).orderBy(*sort_keys(order))
    return df.withColumn("__n", F.row_number().over(at)).filter("__n = 1").drop("__n")
