"""Readers and writers by format.

    from tessera import sources
    sources.of("csv").from_file(spark, path, separator=";").read(spec)
    sources.of("parquet").to_file(path, compression="ZSTD").write(df)
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field
from types import ModuleType
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Reader:
    """A file to be read, as a table of its own columns or by a specification."""

    module: ModuleType
    spark: SparkSession
    path: str
    options: dict[str, Any] = field(default_factory=dict)

    def table(self) -> DataFrame:
        return self.module.read_table(self.spark, self.path, **self.options)

    def read(self, spec, **more: Any) -> DataFrame:
        return self.module.read(self.spark, self.path, spec, **self.options, **more)


@dataclass(frozen=True)
class Writer:
    """A file to be written."""

    module: ModuleType
    path: str
    options: dict[str, Any] = field(default_factory=dict)

    def write(self, df: DataFrame, spec=None, **more: Any) -> None:
        self.module.write(df, self.path, spec, **self.options, **more)


@dataclass(frozen=True)
class Format:
    name: str

    @property
    def module(self) -> ModuleType:
        return importlib.import_module(f"tessera.sources.{self.name}")

    def from_file(self, spark: SparkSession, path: str, **options: Any) -> Reader:
        return Reader(self.module, spark, path, options)

    def to_file(self, path: str, **options: Any) -> Writer:
        return Writer(self.module, path, options)


def of(name: str) -> Format:
    """``excel``, ``csv`` or ``parquet``."""
    if name not in ("excel", "csv", "parquet"):
        raise ValueError(f"there is no format {name}")
    return Format(name)
