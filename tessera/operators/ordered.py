"""Operators that depend on row order: index, running sum, rolling mean, shift, fill.

Order is always named by the caller (``order``: column names or sort expressions that
together are unique).  With ``partition_by`` each operator is one window.  Without it a
plain window would put all rows in one task, so the rows are cut into ranges of all order
keys, as many as the table's size asks for: what a range needs from those before it (a
count, a sum, a last value) is worked out on a table of one row per range, and frames of
bounded width run over fixed-size blocks that take their neighbours' last rows along.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sampled keys that place the bounds of ranges (a table of fewer rows is one range), the
#: rows a range should have, and the most ranges there may be.
SAMPLED, ROWS, MOST = 16_384, 1_000_000, 4_096
#: Rows of a block for frames of bounded width.
BLOCK = 65_536

_RANGE, _INDEX, _BLOCK = "__range", "__index", "__block"


def sort_keys(order: str | Column | Sequence[str | Column]) -> list[Column]:
    given = [order] if isinstance(order, (str, Column)) else list(order)
    if not given:
        raise ValueError("an order needs at least one key")
    return [F.col(k) if isinstance(k, str) else k for k in given]


class Key(NamedTuple):
    """A sort expression taken apart."""

    value: Column
    descending: bool
    nulls_first: bool


def sort_key(spark: SparkSession, key: Column) -> Key:
    node = key._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return Key(key, False, True)
    child = Column(spark._jvm.org.apache.spark.sql.Column(node.child()))
    return Key(child, "Descending" in node.sortDirection().toString(), "First" in node.nullOrdering().toString())


def _reaches(keys: Sequence[Key], bound: Sequence[Any]) -> Column:
    """Whether a row is at ``bound`` or after it in the order of ``keys``."""
    out = F.lit(True)
    for (value, descending, nulls_first), b in reversed(list(zip(keys, bound, strict=True))):
        if b is None:
            after, same = F.lit(False) if not nulls_first else value.isNotNull(), value.isNull()
        else:
            after = F.coalesce(value < F.lit(b) if descending else value > F.lit(b), F.lit(not nulls_first))
            same = F.coalesce(value == F.lit(b), F.lit(False))
        out = after | (same & out)
    return out


def _reject_stream(df: DataFrame) -> None:
    if df.isStreaming:
        raise ValueError("operators that depend on row order need a bounded table")


def _bounds(df: DataFrame, order, ranges: int | None) -> tuple[list[Key], list[tuple]]:
    """Where ranges begin.  Of the keys, those with the smallest hashes are drawn in one
    pass; how small they are also tells how many rows there are."""
    given = sort_keys(order)
    keys = [sort_key(df.sparkSession, k) for k in given]
    names = [f"k{i}" for i in range(len(keys))]
    drawn = df.select(*(k.value.alias(n) for k, n in zip(keys, names, strict=True)), F.xxhash64(*(k.value for k in keys)).alias("h"))
    rows = drawn.orderBy("h").limit(SAMPLED)
    sorts = [{(False, True): F.asc_nulls_first, (False, False): F.asc_nulls_last, (True, True): F.desc_nulls_first, (True, False): F.desc_nulls_last}[k[1:]](n) for k, n in zip(keys, names, strict=True)]
    found = rows.orderBy(*sorts).collect()
    if ranges is None:
        if len(found) < SAMPLED:
            return keys, []
        share = (max(r.h for r in found) + (1 << 63) + 1) / (1 << 64)
        ranges = min(MOST, max(df.sparkSession.sparkContext.defaultParallelism, ceil(len(found) / share / ROWS)))
    step = max(1, len(found) // ranges)
    return keys, list(dict.fromkeys(tuple(r[:-1]) for r in found[step::step]))


def _ranged(df: DataFrame, order, ranges: int | None) -> DataFrame:
    """``df`` with the number of its range; ranges follow the order."""
    keys, bounds = _bounds(df, order, ranges)

    def place(low: int, high: int) -> Column:  # by halves, so that few bounds are compared
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(_reaches(keys, bounds[middle]), place(middle + 1, high)).otherwise(place(low, middle))

    return df.withColumn(_RANGE, place(0, len(bounds)))


def _before(ranged: DataFrame, value: Column, name: str) -> DataFrame:
    """For each range the sum of ``value`` over all ranges before it.  One row per range."""
    per = ranged.groupBy(_RANGE).agg(value.alias("v"))
    ahead = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(_RANGE, F.coalesce(F.sum("v").over(ahead), F.lit(0)).alias(name))


def with_index(df: DataFrame, order, name: str = "index", partition_by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """A dense row number from 0 in the given order."""
    _reject_stream(df)
    if partition_by:
        at = Window.partitionBy(*partition_by).orderBy(*sort_keys(order))
        return df.withColumn(name, F.row_number().over(at).cast("long") - 1)
    ranged = _ranged(df, order, ranges)
    ahead = _before(ranged, F.count(F.lit(1)), "__ahead")
    at = Window.partitionBy(_RANGE).orderBy(*sort_keys(order))
    numbered = ranged.withColumn("__own", F.row_number().over(at).cast("long") - 1)
    return numbered.join(F.broadcast(ahead), _RANGE).withColumn(name, F.col("__own") + F.col("__ahead")).drop(_RANGE, "__own", "__ahead")


def cum_sum(df: DataFrame, col: str, order, name: str = "cum_sum", partition_by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Running sum; nulls add nothing.  Integers are summed as 64 bits."""
    _reject_stream(df)
    running = Window.unboundedPreceding, Window.currentRow
    if partition_by:
        at = Window.partitionBy(*partition_by).orderBy(*sort_keys(order)).rowsBetween(*running)
        return df.withColumn(name, F.sum(col).over(at))
    ranged = _ranged(df, order, ranges)
    ahead = _before(ranged, F.sum(col), "__ahead")
    at = Window.partitionBy(_RANGE).orderBy(*sort_keys(order)).rowsBetween(*running)
    summed = ranged.withColumn("__own", F.sum(col).over(at)).join(F.broadcast(ahead), _RANGE)
    return summed.withColumn(name, F.coalesce("__own", F.lit(0)) + F.col("__ahead")).drop(_RANGE, "__own", "__ahead")


def forward_fill(df: DataFrame, col: str, order, name: str | None = None, partition_by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """The last value that is not null, up to and including this row; leading nulls stay."""
    _reject_stream(df)
    name = name or col
    running = Window.unboundedPreceding, Window.currentRow
    if partition_by:
        at = Window.partitionBy(*partition_by).orderBy(*sort_keys(order)).rowsBetween(*running)
        return df.withColumn(name, F.last(col, ignorenulls=True).over(at))
    ranged = _ranged(df, order, ranges)
    at = Window.partitionBy(_RANGE).orderBy(*sort_keys(order))
    own = ranged.withColumn("__own", F.last(col, ignorenulls=True).over(at.rowsBetween(*running)))
    whole = own.withColumn("__n", F.row_number().over(at)).filter(F.col("__own").isNotNull())
    last = whole.groupBy(_RANGE).agg(F.max_by("__own", "__n").alias("__last"))
    numbers = df.sparkSession.range(max(MOST, ranges or 0) + 1).select(F.col("id").cast("int").alias(_RANGE))
    every = numbers.join(F.broadcast(last), _RANGE, "left")
    ahead = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(_RANGE, F.last("__last", ignorenulls=True).over(ahead).alias("__carried"))
    return own.join(F.broadcast(carried), _RANGE).withColumn(name, F.coalesce("__own", "__carried")).drop(_RANGE, "__own", "__carried")


def _blocked(df: DataFrame, order, before: int, after: int, value, name: str) -> DataFrame:
    """``value(window)`` for a frame that reaches at most ``before`` rows back and ``after``
    ahead.  Each block also holds the rows of its neighbours within reach."""
    size = max(BLOCK, before, after, 1)
    indexed = with_index(df, order, _INDEX)
    own = F.floor(F.col(_INDEX) / size)
    places = F.array(own)
    if before:
        places = F.when(F.pmod(_INDEX, F.lit(size)) >= size - before, F.array(own, own + 1)).otherwise(places)
    if after:
        places = F.when(F.pmod(_INDEX, F.lit(size)) < after, F.concat(places, F.array(own - 1))).otherwise(places)
    spread = indexed.withColumn(_BLOCK, F.explode(places))
    at = Window.partitionBy(_BLOCK).orderBy(_INDEX)
    return spread.withColumn(name, value(at)).filter(F.col(_BLOCK) == own).drop(_BLOCK, _INDEX)


def shift(df: DataFrame, col: str, n: int, order, name: str = "shifted", partition_by: Sequence[str] = ()) -> DataFrame:
    """The value ``n`` rows earlier (later for negative ``n``); null where there is none."""
    _reject_stream(df)

    def value(at):
        return F.lag(col, n).over(at) if n >= 0 else F.lead(col, -n).over(at)

    if partition_by:
        return df.withColumn(name, value(Window.partitionBy(*partition_by).orderBy(*sort_keys(order))))
    return _blocked(df, order, max(n, 0), max(-n, 0), value, name)


def rolling_mean(df: DataFrame, col: str, window: int, order, name: str = "rolling_mean", partition_by: Sequence[str] = ()) -> DataFrame:
    """Mean of this row and the ``window - 1`` before it; null until there are that many."""
    _reject_stream(df)
    if window < 1:
        raise ValueError("a window holds at least one row")

    def value(at):
        frame = at.rowsBetween(1 - window, 0)
        return F.when(F.count(F.lit(1)).over(frame) >= window, F.avg(col).over(frame))

    if partition_by:
        return df.withColumn(name, value(Window.partitionBy(*partition_by).orderBy(*sort_keys(order))))
    return _blocked(df, order, window - 1, 0, value, name)
