"""Sorting, limits and sampling.  Sorts are made stable by the caller's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import sort_keys, with_index
from tessera.operators.project import as_column


def sort_by(df: DataFrame, key: str | Column, order=(), descending: bool = False, nulls_last: bool = False) -> DataFrame:
    """Sorted by a key, ties in the given order."""
    k = as_column(key)
    if descending:
        first = k.desc_nulls_last()
    else:
        first = k.asc_nulls_last() if nulls_last else k.asc()
    return df.orderBy(first, *(sort_keys(order) if order else ()))


def sort_by_desc(df: DataFrame, key: str | Column, order=()) -> DataFrame:
    return sort_by(df, key, order, descending=True)


def sort_table(df: DataFrame, column: str, order=()) -> DataFrame:
    """Ascending with blanks last."""
    return sort_by(df, column, order, nulls_last=True)


def head(df: DataFrame, n: int, order) -> DataFrame:
    if n < 0:
        raise ValueError("n can't be negative")
    return df.orderBy(*sort_keys(order)).limit(n)


def tail(df: DataFrame, n: int, order) -> DataFrame:
    """The last n rows, in order."""
    keys = sort_keys(order)
    return df.orderBy(*(k.desc_nulls_last() for k in keys)).limit(max(n, 0)).orderBy(*(k.asc_nulls_first() for k in keys))


def slice_rows(df: DataFrame, start: int, stop: int, order) -> DataFrame:
    """Rows from ``start`` up to before ``stop``; both are brought into range."""
    start, stop = max(start, 0), max(stop, 0)
    return df.orderBy(*sort_keys(order)).offset(start).limit(max(stop - start, 0))


def slice_deep(df: DataFrame, start: int, stop: int, order) -> DataFrame:
    """As :func:`slice_rows` for offsets deep in a large table: by a distributed row
    number, since an offset passes all rows before it through one task."""
    at = F.col("__at")
    return with_index(df, order, "__at").filter((at >= max(start, 0)) & (at < max(stop, 0))).drop("__at")


def sample(df: DataFrame, n: int, order, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), drawn by a keyed hash of the order columns: the same rows
    for the same seed, however the table is partitioned."""
    keys = sort_keys(order)
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(max(n, 0))
