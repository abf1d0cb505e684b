"""Tables from values in the program."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Spark types of Python values, for columns that hold one kind.
KINDS = ((bool, "boolean"), (int, "bigint"), (float, "double"), (Decimal, "decimal(38,10)"), (str, "string"), (dt.datetime, "timestamp_ntz"), (dt.date, "date"), (bytes, "binary"))


def of(spark: SparkSession, rows: Iterable[Any], schema: StructType | str) -> DataFrame:
    """Rows with a fixed schema; a null row is refused."""
    given = list(rows)
    if any(r is None for r in given):
        raise ValueError("a table holds no null rows")
    return spark.createDataFrame(given, schema)


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def kind_of(values: Sequence[Any]) -> str:
    """The type of a column: of its values if they agree, wider numbers for numbers, else text."""
    found = {next((k for t, k in KINDS if isinstance(v, t)), "string") for v in values if v is not None}
    if len(found) == 1:
        return found.pop()
    return "double" if found and found <= {"bigint", "double"} else "string"


class TableBuilder:
    """Columns first, then rows of as many values."""

    def __init__(self, *columns: str):
        self.names: list[str] = list(columns)
        self.rows: list[tuple] = []

    def columns(self, *names: str) -> TableBuilder:
        if self.rows:
            raise ValueError("columns come before rows")
        self.names = list(names)
        return self

    def row(self, *values: Any) -> TableBuilder:
        if len(values) != len(self.names):
            raise ValueError(f"{len(self.names)} values are needed, {len(values)} were given")
        self.rows.append(values)
        return self

    def build(self, spark: SparkSession) -> DataFrame:
        kinds = [kind_of([r[i] for r in self.rows]) for i in range(len(self.names))]
        cast = {"string": str, "double": float}
        rows = [tuple(v if v is None or k not in cast else cast[k](v) for v, k in zip(r, kinds, strict=True)) for r in self.rows]
        return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(self.names, kinds, strict=True)))
