"""Equi-joins.  The side that a join may leave empty is packed into a struct before the
join, so that an unmatched side is null itself and not a struct of nulls.

``pairs`` gives columns ``left`` and ``right``; a ``joiner`` maps the two to new columns.
No side is broadcast by hand: Spark picks that by the measured size, and AQE splits
skewed partitions of a shuffled join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Joiner = Callable[[Column, Column], dict[str, Column]]
HOW = ("inner", "left", "right", "full")


def on(*names: str | Column) -> tuple[Column, ...]:
    """A key of one or more columns or expressions."""
    if not names:
        raise ValueError("a key needs at least one part")
    return tuple(F.col(n) if isinstance(n, str) else n for n in names)


def _parts(key) -> tuple[Column, ...]:
    if isinstance(key, (str, Column)):
        return on(key)
    return on(*key)


def pairs(left: DataFrame, right: DataFrame, left_key, right_key, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Matching rows as structs ``left`` and ``right``.

    With ``null_safe`` null parts of a key match each other, as parts of a composite key
    do; otherwise a null key matches nothing.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {', '.join(HOW)}")
    lk, rk = _parts(left_key), _parts(right_key)
    if len(lk) != len(rk):
        raise ValueError("both keys need the same number of parts")
    a = left.select(F.struct(*(left[f"`{c}`"] for c in left.columns)).alias("left"), *(k.alias(f"__l{i}") for i, k in enumerate(lk)))
    b = right.select(F.struct(*(right[f"`{c}`"] for c in right.columns)).alias("right"), *(k.alias(f"__r{i}") for i, k in enumerate(rk)))
    test = None
    for i in range(len(lk)):
        x, y = F.col(f"__l{i}"), F.col(f"__r{i}")
        same = x.eqNullSafe(y) if null_safe else x == y
        test = same if test is None else test & same
    return a.join(b, test, how).select("left", "right")


def _joined(left, right, left_key, right_key, how, joiner: Joiner | None, null_safe: bool) -> DataFrame:
    both = pairs(left, right, left_key, right_key, how, null_safe)
    if joiner is None:
        return both
    return both.select(*(c.alias(n) for n, c in joiner(F.col("left"), F.col("right")).items()))


def inner_join(left, right, left_key, right_key, joiner: Joiner | None = None) -> DataFrame:
    return _joined(left, right, left_key, right_key, "inner", joiner, False)


def left_join(left, right, left_key, right_key, joiner: Joiner | None = None) -> DataFrame:
    return _joined(left, right, left_key, right_key, "left", joiner, False)


def right_join(left, right, left_key, right_key, joiner: Joiner | None = None) -> DataFrame:
    return _joined(left, right, left_key, right_key, "right", joiner, False)


def full_join(left, right, left_key, right_key, joiner: Joiner | None = None) -> DataFrame:
    return _joined(left, right, left_key, right_key, "full", joiner, False)


def join_multi(left, right, left_key: Sequence, right_key: Sequence, how: str = "inner", joiner: Joiner | None = None) -> DataFrame:
    """A join on a composite key of any number of parts; null parts match each other."""
    return _joined(left, right, left_key, right_key, how, joiner, True)


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs, for small tables: the size is the product of both."""
    a = left.select(F.struct(*(left[f"`{c}`"] for c in left.columns)).alias("left"))
    b = right.select(F.struct(*(right[f"`{c}`"] for c in right.columns)).alias("right"))
    return a.crossJoin(b)


def semi_join(left: DataFrame, right: DataFrame, left_key, right_key, anti: bool = False) -> DataFrame:
    """Rows of the left side with a match on the right (without one for ``anti``)."""
    lk, rk = _parts(left_key), _parts(right_key)
    keys = right.select(*(k.alias(f"__r{i}") for i, k in enumerate(rk)))
    named = left.withColumns({f"__l{i}": k for i, k in enumerate(lk)})
    test = None
    for i in range(len(lk)):
        same = F.col(f"__l{i}") == F.col(f"__r{i}")
        test = same if test is None else test & same
    return named.join(keys, test, "left_anti" if anti else "left_semi").select(*left.columns)


def has_left(side: str = "left") -> Column:
    return F.col(side).isNotNull()


def has_right(side: str = "right") -> Column:
    return F.col(side).isNotNull()


def map_left(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """The left side mapped, the right kept; a null side reaches ``fn`` as null."""
    return df.select(fn(F.col("left")).alias("left"), "right")


def map_right(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return df.select("left", fn(F.col("right")).alias("right"))


def composite(*parts: str | Column) -> Column:
    """A composite key as one struct value; its parts are ``k0, k1, ...``."""
    return F.struct(*(k.alias(f"k{i}") for i, k in enumerate(on(*parts))))


def part(key: Column, at: int, kind: str | None = None) -> Column:
    """One part of a composite key, cast to ``kind`` if given."""
    value = key.getField(f"k{at}")
    return value if kind is None else value.cast(kind)


def key_text(key: Column, parts: int) -> Column:
    """A composite key as text, nulls shown."""
    shown = [F.coalesce(part(key, i).cast("string"), F.lit("null")) for i in range(parts)]
    return F.concat(F.lit("("), F.concat_ws(", ", *shown), F.lit(")"))
