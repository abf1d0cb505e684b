"""Wide to long, and lists to rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.project import _known


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """One row per row and value column; blanks are kept, other columns are dropped.
    Value columns of different types are turned into text."""
    _known(df, [*ids, *values])
    kinds = {t for n, t in df.dtypes if n in values}
    if len(kinds) > 1:
        df = df.withColumns({n: F.col(n).cast("string") for n in values})
    return df.unpivot(list(ids), list(values), variable, value)


def explode(df: DataFrame, column: str, items: Callable[[Column], Column]) -> DataFrame:
    """One row per item, in place.  A blank keeps its one blank row; a value without items
    (an empty or null list) gives none."""
    _known(df, [column])
    listed = items(F.col(column))
    blank = F.array(F.lit(None))
    spread = F.explode(F.when(F.col(column).isNull(), blank).otherwise(listed)).alias(column)
    return df.select(*(spread if c == column else F.col(c) for c in df.columns))
