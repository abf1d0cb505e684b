"""Global and grouped aggregation.

A sum over no rows is 0, a mean, minimum or maximum over none is null; integers are
summed as 64 bits.  Distinct counts take null as a value.  Ties go to the first row in
the given order.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ordered import sort_keys
from tessera.operators.project import as_column


def sum_of(col: str | Column) -> Column:
    value = F.sum(as_column(col))
    return F.coalesce(value, F.lit(0))


def mean_of(col: str | Column) -> Column:
    return F.avg(as_column(col))


def max_of(col: str | Column) -> Column:
    return F.max(as_column(col))


def min_of(col: str | Column) -> Column:
    return F.min(as_column(col))


def distinct_of(*cols: str | Column) -> Column:
    """Distinct values or combinations, null counted as a value."""
    return F.count_distinct(F.struct(*(as_column(c).alias(f"k{i}") for i, c in enumerate(cols))))


def total(df: DataFrame, name: str, value: Column) -> DataFrame:
    """One aggregate over the whole table."""
    return df.agg(value.alias(name))


def stats(df: DataFrame, col: str | Column) -> DataFrame:
    """Count, sum, minimum, mean and maximum in one pass."""
    c = as_column(col)
    return df.agg(F.count(c).alias("count"), sum_of(c).alias("sum"), F.min(c).alias("min"), F.avg(c).alias("avg"), F.max(c).alias("max"))


def max_by(df: DataFrame, key: str | Column, order) -> DataFrame:
    """The row with the largest key, the first of those that tie."""
    return n_largest(df.filter(as_column(key).isNotNull()), 1, key, order)


def min_by(df: DataFrame, key: str | Column, order) -> DataFrame:
    return n_smallest(df.filter(as_column(key).isNotNull()), 1, key, order)


def n_largest(df: DataFrame, n: int, key: str | Column, order) -> DataFrame:
    """The n rows with the largest keys; ties in the given order."""
    return df.orderBy(as_column(key).desc_nulls_last(), *sort_keys(order)).limit(n)


def n_smallest(df: DataFrame, n: int, key: str | Column, order) -> DataFrame:
    return df.orderBy(as_column(key).asc_nulls_last(), *sort_keys(order)).limit(n)


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


class Grouped:
    """Rows grouped by one or more keys.  Nothing is gathered: each method is one
    aggregation, with partial sums before the shuffle."""

    def __init__(self, df: DataFrame, *keys: str | Column):
        if not keys:
            raise ValueError("a grouping needs at least one key")
        self.df, self.keys = df, [as_column(k) for k in keys]

    def _grouped(self) -> GroupedData:
        return self.df.groupBy(*self.keys)

    def agg(self, **values: Column) -> DataFrame:
        return self._grouped().agg(*(v.alias(n) for n, v in values.items()))

    def counts(self, name: str = "count") -> DataFrame:
        return self.agg(**{name: F.count(F.lit(1))})

    def size(self) -> int:
        return self.keys_table().count()

    def keys_table(self) -> DataFrame:
        return self.df.select(*self.keys).distinct()

    def mean(self, col: str, name: str = "mean") -> DataFrame:
        return self.agg(**{name: mean_of(col)})

    def sum(self, col: str, name: str = "sum") -> DataFrame:
        return self.agg(**{name: sum_of(col)})

    def max(self, col: str, name: str = "max") -> DataFrame:
        return self.agg(**{name: max_of(col)})

    def min(self, col: str, name: str = "min") -> DataFrame:
        return self.agg(**{name: min_of(col)})

    def count_distinct(self, *cols: str, name: str = "distinct") -> DataFrame:
        return self.agg(**{name: distinct_of(*cols)})

    def compute(self, **values: Column) -> DataFrame:
        """One value per key."""
        return self.agg(**values)

    def transform(self, **values: Column) -> DataFrame:
        """A group's value on each of its rows."""
        at = Window.partitionBy(*self.keys)
        return self.df.withColumns({n: v.over(at) for n, v in values.items()})

    def top(self, n: int, *by: Column) -> DataFrame:
        """The first n rows of each group in the given order."""
        at = Window.partitionBy(*self.keys).orderBy(*by)
        return self.df.withColumn("__n", F.row_number().over(at)).filter(F.col("__n") <= n).drop("__n")

    def apply(self, fn: Callable, schema: str | T.StructType | None = None, order=None) -> DataFrame:
        """Rows made from each group by a function of a pandas frame, in the given order;
        a group must fit in one task.  Prefer :meth:`top` or :meth:`transform` where they will do.

        Frames are those of ``applyInPandas``, which spends more on handing over a small
        group than most functions spend on it; here whole batches are handed over.  It still
        serves nested columns and functions of key or iterator, which take no order."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or self.df.schema
        if not _in_batches(fn, self.df.schema):
            if order is not None:
                raise ValueError("an order needs flat columns and a function of a frame alone")
            return self._grouped().applyInPandas(fn, schema)
        at = Window.partitionBy(*self.keys).orderBy(*([F.lit(1)] if order is None else sort_keys(order)))
        first = F.row_number().over(at) == 1
        kinds = [f.dataType for f in self.df.schema]
        # in pandas, an integer or boolean column with nulls is of another type: over a whole
        # batch, the nulls of one group would round the large integers of the others
        gaps = [i for i, k in enumerate(kinds) if isinstance(k, (T.IntegralType, T.BooleanType))]
        rows = self.df.select("*", first).toDF(*(f"c{i}" for i in range(len(kinds))), "first")
        given = [F.coalesce(f"c{i}", F.lit(0).cast(k)).alias(f"c{i}") if i in gaps else F.col(f"c{i}") for i, k in enumerate(kinds)]
        marks = [F.col(f"c{i}").isNull().alias(f"n{i}") for i in gaps]
        return rows.select(*given, *marks, "first").mapInPandas(_per_group(fn, self.df.columns, gaps, len(schema)), schema)

    def get(self, *values) -> DataFrame:
        """The rows of one group; none for a key that isn't there."""
        test = None
        for key, value in zip(self.keys, values, strict=True):
            same = key.eqNullSafe(F.lit(value))
            test = same if test is None else test & same
        return self.df.filter(test)

    def groups(self) -> Iterator[tuple[Row, DataFrame]]:
        """Key and rows of each group, lazily, for a few groups."""
        for key in self.keys_table().toLocalIterator():
            yield key, self.get(*key)


def _in_batches(fn: Callable, schema: T.StructType) -> bool:
    """Whether the function takes a frame alone, and no column is converted with regard to
    other rows (nested ones are: by the nulls in them)."""
    spec = inspect.getfullargspec(fn)
    flat = not any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.UserDefinedType, T.VariantType)) for f in schema)
    return flat and len(spec.args) == 1 and "Iterator" not in repr(spec.annotations)


def _per_group(fn: Callable, names: Sequence[str], gaps: Sequence[int], width: int, rows: int = 10_000) -> Callable:
    """The function on each group of a partition whose groups follow each other.  A batch has
    the columns, a mark of nulls for each of the gaps, and whether a row is its group's first."""

    def whole(batches):
        """Frames of whole groups, with the places where these begin."""
        import numpy as np
        import pandas as pd

        open_ = []  # parts of a group that may go on
        for batch in batches:
            at = np.flatnonzero(batch.iloc[:, -1].to_numpy())
            if not len(at):
                open_.append(batch)
                continue
            if at[0]:
                open_.append(batch.iloc[: at[0]])
            if open_:
                yield pd.concat(open_, ignore_index=True), np.array([0])
            if len(at) > 1:
                yield batch.iloc[at[0] : at[-1]], at[:-1] - at[0]
            open_ = [batch.iloc[at[-1] :]]
        if open_:
            yield pd.concat(open_, ignore_index=True), np.array([0])

    def results(batches):
        import numpy as np

        for frame, at in whole(batches):
            holes = [frame.iloc[:, len(names) + j].to_numpy() for j in range(len(gaps))]
            holed = [np.logical_or.reduceat(h, at) for h in holes]
            any_holed = np.logical_or.reduce(holed) if holed else np.zeros(len(at), bool)
            given = frame.iloc[:, : len(names)].set_axis(names, axis=1)
            for g, (a, b) in enumerate(zip(at, [*at[1:], len(frame)], strict=True)):
                group = given.iloc[a:b].reset_index(drop=True)
                for j in (j for j in range(len(gaps)) if any_holed[g] and holed[j][g]):
                    column = group.iloc[:, gaps[j]]
                    kind, null = (object, None) if column.dtype == bool else (float, np.nan)
                    column = column.astype(kind)
                    column[holes[j][a:b]] = null
                    group.isetitem(gaps[j], column)
                yield fn(group)

    def run(batches):
        import pandas as pd

        kept, n = {}, 0  # frames by names and types, as putting together must not change these
        for frame in results(batches):
            if not isinstance(frame, pd.DataFrame) or len(frame.columns) > width:
                raise TypeError(f"the function has to give a pandas frame of {width} columns, not {frame!r}")
            kept.setdefault((*frame.columns, *frame.dtypes), []).append(frame)
            n += max(1, len(frame))
            if n >= rows:
                yield from (pd.concat(f, ignore_index=True) for f in kept.values())
                kept, n = {}, 0
        yield from (pd.concat(f, ignore_index=True) for f in kept.values())

    return run


def group_by(df: DataFrame, *keys: str | Column) -> Grouped:
    return Grouped(df, *keys)


def key_order(df: DataFrame, keys: Sequence[str], order) -> DataFrame:
    """Keys by first appearance in the given order."""
    first = F.min(F.struct(*sort_keys(order)))
    return df.groupBy(*keys).agg(first.alias("__first")).orderBy("__first").drop("__first")
