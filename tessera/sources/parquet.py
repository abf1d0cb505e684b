"""Parquet: typed reading with defaults, tables as they are, and writing with codecs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.plans.schema import FieldSelector, TableSpec, conform
from tessera.sources.paths import guarded

CODECS = {"UNCOMPRESSED": "none", "SNAPPY": "snappy", "GZIP": "gzip", "LZ4": "lz4_raw", "ZSTD": "zstd"}


def _limited(spark: SparkSession, path: str, max_size: int | None) -> str:
    """The path, if its files are no larger than allowed.  Sizes come from the store."""
    guarded(path)
    if max_size is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        size = store.getContentSummary(at).getLength()
        if size > max_size:
            raise ValueError(f"{path} holds {size} bytes; at most {max_size} are allowed")
    return path


def read_table(spark: SparkSession, path: str, max_size: int | None = None) -> DataFrame:
    return spark.read.parquet(_limited(spark, path, max_size))


def read(
    spark: SparkSession,
    path: str,
    spec: TableSpec,
    defaults: dict[str, Any] | None = None,
    type_defaults: dict[str, Any] | None = None,
    max_size: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Columns of the specification only (the scan reads no others), with defaults for
    those that are missing or null, and text parsed where a type differs.  With ``strict``
    a value that can't be read stops the query, with its field and row in the file."""
    rows = read_table(spark, path, max_size)
    return conform(rows, spec, defaults, type_defaults, strict, row=F.col("_metadata.row_index") if strict else None)


def for_each(df: DataFrame, visit: Callable[[Row], None]) -> None:
    """Visit rows on the driver, one partition in memory at a time."""
    for row in df.toLocalIterator(prefetchPartitions=False):
        visit(row)


def schema_info(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """Name, type and whether a value is required, from the footer only.  (Spark shows
    every file column as optional; what a specification says is required is kept in its
    metadata.)"""
    return [(f.name, f.dataType.simpleString(), bool((f.metadata or {}).get("required", not f.nullable))) for f in spark.read.parquet(guarded(path)).schema.fields]


def can_read(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(guarded(path)).columns)
    except AnalysisException:
        return False


def write(
    df: DataFrame,
    path: str,
    spec: TableSpec | None = None,
    select: FieldSelector | None = None,
    compression: str = "SNAPPY",
    row_group_bytes: int | None = None,
    metadata: dict[str, str] | None = None,
    decimals_as_text: bool = False,
    mode: str = "overwrite",
    row_group_rows: int | None = None,
    allow_empty: bool = False,
) -> None:
    """Write under field names.  A null in a required column stops the write; an unknown
    codec is refused, and so is a table without rows unless ``allow_empty``; ``metadata``
    stands in the schema that the footer holds, with its first field."""
    guarded(path)
    codec = CODECS.get(compression.upper())
    if codec is None:
        raise ValueError(f"codec {compression} is none of {', '.join(CODECS)}")
    if not allow_empty and df.isEmpty():
        raise ValueError("there is no row to write")
    spec = spec or TableSpec.of(df.schema)
    chosen = select.select() if select else list(spec.columns)
    struct = TableSpec(chosen).struct() if chosen else None
    out = []
    for at, c in enumerate(chosen):
        value = F.col(f"`{c.field}`")
        if c.required:
            value = F.coalesce(value, F.raise_error(F.lit(f"{c.field} is required but null")).cast(c.kind))
        if decimals_as_text and c.kind.startswith("decimal"):
            value = value.cast("string")
        known = dict(struct[c.field].metadata) | ({f"file.{k}": v for k, v in metadata.items()} if metadata and not at else {})
        out.append(value.alias(c.field, metadata=known))
    writer = df.select(*out).write.mode(mode).option("compression", codec)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    if row_group_rows:
        writer = writer.option("parquet.block.row.count.limit", row_group_rows)
    writer.parquet(path)


def metadata_of(spark: SparkSession, path: str) -> dict[str, str]:
    """The ``metadata`` that a table was written with."""
    fields = spark.read.parquet(guarded(path)).schema.fields
    return {k.removeprefix("file."): v for f in fields[:1] for k, v in (f.metadata or {}).items() if k.startswith("file.")}
