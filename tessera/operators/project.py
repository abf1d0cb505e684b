"""Projection, filters, predicates and row access."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.functions import coerce
from tessera.operators.ordered import sort_keys, with_index


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def keep(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate is true."""
    return df.filter(predicate)


def reject(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate is not true; an unknown predicate keeps the row."""
    held = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.filter(~F.coalesce(held, F.lit(False)))


def where_in(df: DataFrame, col: str | Column, values: Iterable[Any]) -> DataFrame:
    """Rows whose value is among ``values``; null is there if None is among them."""
    given = list(values)
    value = as_column(col)
    known = [v for v in given if v is not None]
    test = value.isin(known) if known else F.lit(False)
    return df.filter(test | value.isNull() if len(known) < len(given) else test)


def drop_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def map_rows(df: DataFrame, **exprs: Column) -> DataFrame:
    """New rows made of the given expressions only."""
    return df.select(*(e.alias(n) for n, e in exprs.items()))


def replace_columns(df: DataFrame, **exprs: Column) -> DataFrame:
    """The same columns, some with new values; names that aren't there are refused."""
    _known(df, exprs)
    return df.withColumns(exprs)


def map_indexed(df: DataFrame, order, fn: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """Rows made from a 0-based dense index and the row's columns."""
    indexed = with_index(df, order, "__at")
    return indexed.select(*(e.alias(n) for n, e in fn(F.col("__at")).items()))


def flat_map(df: DataFrame, items: Column, name: str = "value", keep_cols: Sequence[str] = ()) -> DataFrame:
    """One row per item of an array; an empty or null array gives none."""
    return df.select(*keep_cols, F.explode(items).alias(name))


def _known(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def select_columns(df: DataFrame, *names: str) -> DataFrame:
    _known(df, names)
    return df.select(*names)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Without the given columns; names that aren't there are passed over."""
    return df.drop(*names)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    _known(df, [old])
    return df.withColumnRenamed(old, new)


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """With one more column; one of that name is replaced."""
    return df.withColumn(name, value)


def typed_column(df: DataFrame, name: str, kind: str | None = None, strict: bool = False) -> Column:
    """One column as values of ``kind`` by the rules of :mod:`tessera.functions.coerce`: what
    can't be coerced is null, or with ``strict`` stops the query.  Without a kind, as it is."""
    _known(df, [name])
    value = F.col(f"`{name}`")
    if kind is None:
        return value
    source = dict(df.dtypes)[name]
    if kind.startswith("decimal"):
        return coerce.as_decimal(value, source, int(re.search(r",\s*(\d+)", kind)[1]) if "," in kind else 0, strict)
    if kind not in coerce.AS:
        raise ValueError(f"no coercion to {kind}; there are {', '.join(coerce.AS)}")
    return coerce.AS[kind](value, source, strict=strict)


def column_values(df: DataFrame, name: str, order=None, kind: str | None = None, strict: bool = False) -> list:
    """One column as a list on the driver, coerced to ``kind`` if given."""
    value = typed_column(df, name, kind, strict)
    rows = df.orderBy(*sort_keys(order)) if order is not None else df
    return [r[0] for r in rows.select(value).collect()]


def index_by(df: DataFrame, key: str | Sequence[str], order) -> DataFrame:
    """One row per key: the last in the given order."""
    keys = [key] if isinstance(key, str) else list(key)
    at = Window.partitionBy(*keys).orderBy(*(_reversed(k) for k in sort_keys(order)))
    return df.withColumn("__n", F.row_number().over(at)).filter("__n = 1").drop("__n")


def _reversed(key: Column) -> Column:
    return key.desc_nulls_last()


def any_of(df: DataFrame, predicate: Column, name: str = "any") -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(predicate), F.lit(False)).alias(name))


def all_of(df: DataFrame, predicate: Column, name: str = "all") -> DataFrame:
    """Whether the predicate is true for every row (true for no rows; unknown is not true)."""
    return df.agg(F.coalesce(F.bool_and(F.coalesce(predicate, F.lit(False))), F.lit(True)).alias(name))


def count_if(df: DataFrame, predicate: Column, name: str = "count") -> DataFrame:
    return df.agg(F.count_if(predicate).alias(name))


def for_each_indexed(df: DataFrame, order, visit: Callable[[int, Row], None]) -> None:
    """Visit rows in order on the driver, one partition in memory at a time."""
    for at, row in enumerate(iterate(df, order)):
        visit(at, row)


def iterate(df: DataFrame, order=None) -> Iterator[Row]:
    rows = df.orderBy(*sort_keys(order)) if order is not None else df
    return rows.toLocalIterator()


def pipe(df: DataFrame, fn: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    return df.transform(fn, *args, **kwargs)


def size(df: DataFrame) -> int:
    return df.count()


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def row_at(df: DataFrame, at: int, order) -> DataFrame:
    """The row at a 0-based place; nothing beyond the end."""
    if at < 0:
        raise IndexError(at)
    return df.orderBy(*sort_keys(order)).offset(at).limit(1)


def first_row(df: DataFrame, order) -> DataFrame:
    return df.orderBy(*sort_keys(order)).limit(1)


def last_row(df: DataFrame, order) -> DataFrame:
    return df.orderBy(*(_reversed(k) for k in sort_keys(order))).limit(1)


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def column_count(df: DataFrame) -> int:
    return len(df.columns)


def column_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def cell(df: DataFrame, at: int, name: str, order) -> Any:
    """One value on the driver."""
    _known(df, [name])
    rows = row_at(df, at, order).select(name).collect()
    if not rows:
        raise IndexError(at)
    return rows[0][0]


def copy(df: DataFrame) -> DataFrame:
    """A frame never changes: its copy is the frame."""
    return df
