"""Session helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_KEPT: dict[tuple, object] = {}
_USED: set[tuple] = set()


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only in local mode, where the cluster names none (tests), a temporary folder is
    taken and set as the checkpoint folder of the session; elsewhere executors could not
    see it, and the call is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        own = context._jsc.sc().getCheckpointDir()
    return str(own.get()).rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold for what is run inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and
    what it holds outlives any executor."""
    spark = df.sparkSession
    df.write.option("compression", codec).parquet(path := folder(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`stored` that is no longer needed."""
    _delete(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def clean(spark: SparkSession) -> None:
    """Delete all that the operators of this application have stored, once their results
    are written elsewhere."""
    _delete(spark, f"{scratch(spark)}/tessera/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for at in paths:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="tessera-"), f"tessera-{app}.zip")
    with zipfile.ZipFile(to, "w") as out:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.join("tessera", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(to)
    _SHIPPED.add(app)


def pieces(batch: pa.RecordBatch, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and, but for single rows, ``most`` bytes."""
    n = batch.num_rows
    if n <= 1 or n <= rows and batch.nbytes <= most:
        if n:
            yield batch
        return
    yield from pieces(batch.slice(0, n // 2), rows, most)
    yield from pieces(batch.slice(n // 2), rows, most)


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in a Python worker for its next tasks; :func:`lean` drops
    it as soon as a task doesn't ask for it."""
    if key not in _KEPT:
        _KEPT[key] = make()
    _USED.add(key)
    return _KEPT[key]


def lean(rows: Callable[[], Callable]) -> Callable:
    """``rows()``, after which the worker keeps only what was asked for in it.  Workers are
    used again by later operators, beside whose memory the tables of earlier ones stay."""
    _USED.clear()
    apply = rows()
    if others := _KEPT.keys() - _USED:
        for key in others:
            del _KEPT[key]
        spare()
    return apply


def spare() -> None:
    """Give memory that is free in a Python worker, which may idle from now on, back to the
    system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(
    df: DataFrame,
    rows: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: str,
    chunk: int = 256,
    most: int = 8 << 20,
) -> DataFrame:
    """Apply a batch function in Python to slices of ``chunk`` rows or ``most`` bytes.

    ``rows()`` is called once per task and returns the function that maps a dict
    of column lists to a dict of columns (lists or arrays).  Batches are sliced so that a
    worker holds a few megabytes of text at most, or one longer text, however large
    Spark's batches are.
    """
    ship(df.sparkSession)
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = lean(rows)
        for batch in batches:
            for part in pieces(batch, chunk, most):
                out = apply({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in target], schema=target)
        spare()

    return df.mapInArrow(run, schema)


def _column(values: pa.Array | list, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, parts: int = 2_048) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row for each key) where ``count`` says how many
    rows have the key.  Keys with more than one in ``parts`` of all rows, of which there
    can be ``parts`` at most, are broadcast; the others are shuffled, none of them large.
    Both frames are read several times and should be stored."""
    bar = max(1_000, rows.count() // parts)
    hot = F.broadcast(keyed.filter(F.col(count) > bar))  # at most `parts` rows
    cold = rows.join(hot.select(key), key, "left_anti").join(keyed.filter(F.col(count) <= bar), key)
    return rows.join(hot, key).unionByName(cold)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
