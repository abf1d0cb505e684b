"""CSV: all values read as text, empty cells as null; typed reading by a specification."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.schema import FieldSelector, TableSpec, conform
from tessera.sources.paths import guarded


def read_table(
    spark: SparkSession,
    path: str,
    headers: bool = True,
    separator: str = ",",
    quote: str = '"',
    escape: str = "\\",
    skip_lines: int = 0,
    intern_values: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """A CSV file (or folder of them) as text columns.

    Header names are trimmed, an empty one becomes ``ColumnN``; without a header all are
    ``Column1..N`` by the first line.  Short rows are padded with null, further cells
    dropped; of a name that occurs twice the last cell counts.  ``skip_lines`` lines of
    each file are left out before its header; then a quoted cell may not hold a line break,
    since lines are numbered apart.  Lines without any character are passed over.
    ``multi_line`` allows line breaks in quoted cells, for which a file must be read by one
    task; turn it off for large files without them, which are then read in pieces.
    ``intern_values`` changes nothing: rows are binary here.
    """
    guarded(path)
    options = {"sep": separator, "quote": quote, "escape": escape, "mode": "PERMISSIVE"}
    if skip_lines:
        top = skip_lines + headers
        lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
        order = Window.partitionBy("file").orderBy("at")  # of each file its first block
        heads = lines.filter("start = 0").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= skip_lines + 1)
        first = heads.filter(F.col("n") == skip_lines + 1).orderBy("file").limit(1).collect()
        names = _first_cells(spark, first[0].value if first else "", options)
        gone = F.broadcast(heads.filter(F.col("n") <= top).select("at"))  # a few lines of each file
        body = lines.join(gone, "at", "left_anti").filter("value <> ''")
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        parsed = body.select(F.from_csv("value", schema, options).alias("r")).select("r.*")
    else:
        read = spark.read.options(**options, multiLine=multi_line)
        shown = read.option("header", False).csv(path)
        first = shown.limit(1).collect()
        names = list(first[0]) if first else []
        schema = ", ".join(f"c{i} string" for i in range(len(names))) or "c0 string"
        parsed = read.option("header", headers).option("enforceSchema", True).schema(schema).csv(path)
    names = header_names(names) if headers else [f"Column{i + 1}" for i in range(len(names))]
    last = {n: i for i, n in enumerate(names)}
    cells = [F.nullif(F.col(f"c{last[n]}"), F.lit("")).alias(n) for n in dict.fromkeys(names)]
    return parsed.select(*cells) if cells else spark.createDataFrame([], "Column1 string")


def _first_cells(spark: SparkSession, line: str, options: dict) -> list:
    import csv

    return next(csv.reader([line], delimiter=options["sep"], quotechar=options["quote"], escapechar=options["escape"]), [])


def header_names(cells: Sequence[str | None]) -> list[str]:
    return [(c or "").strip() or f"Column{i + 1}" for i, c in enumerate(cells)]


def read(spark: SparkSession, path: str, spec: TableSpec, defaults: dict[str, Any] | None = None, strict: bool = False, **options) -> DataFrame:
    """Typed reading: each column by its display or field name, text parsed by its formats."""
    return conform(read_table(spark, path, **options), spec, by_field=defaults, strict=strict)


def write(
    df: DataFrame,
    path: str,
    spec: TableSpec | None = None,
    select: FieldSelector | None = None,
    headers: bool = True,
    separator: str = ",",
    quote: str = '"',
    escape: str = '"',
    line_end: str = "\n",
    single_file: bool = True,
    mode: str = "overwrite",
) -> None:
    """Write with display names; every cell is quoted, null as an empty one.

    The file lies in the folder ``path``.  ``single_file`` gathers the rows in one task,
    for exports of a size that one file suits; a large table is written with it off.
    """
    guarded(path)
    spec = spec or TableSpec.of(df.schema)
    chosen = select.select() if select else FieldSelector(spec).exportable_only().select()
    shown = df.select(*(F.col(f"`{c.field}`").cast("string").alias(c.effective_name) for c in chosen))
    if single_file:
        shown = shown.coalesce(1)
    writer = shown.write.mode(mode).options(sep=separator, quote=quote, escape=escape, lineSep=line_end, header=headers)
    writer.options(quoteAll=True, emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
