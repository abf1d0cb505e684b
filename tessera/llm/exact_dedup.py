"""Exact deduplication as a stateful stream, in DataFrame operations only.

Rows arrive as a stream of (digest, identifier, locator).  Keyed state on disk (RocksDB,
checkpointed to a folder that may outlive the call) holds for each digest, without expiry,
the smallest identifier seen, the locator of its content (file and row in it) and a count.
A hit, that is a digest with more than one row, is settled on the texts themselves: they
are fetched by locator, those of earlier calls too, and compared in full; a digest that
stands for several texts is split by text.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import folder, fresh, join_counted, settings, stored

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store lays aside 4 MB
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a store takes memory only while its task runs
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Let the scan of texts be thinned by a Bloom filter of the hits at any size.
_THIN = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g",
}
_PLACE = "struct<file:string,row:bigint,column:string>"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, at`` for each row; the locator ``at`` is file, row in it and column.  A
    frame that isn't a plain scan of Parquet files is written to the shared folder first."""
    try:
        if "_metadata" not in docs.columns:
            return _placed(docs, text_col, docs[id_col].alias("id"))
    except AnalysisException:  # no such column: not a scan
        pass
    return _placed(stored(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "documents"), "text", F.col("id"))


def _placed(scan: DataFrame, text_col: str, *more: Column) -> DataFrame:
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    return scan.select(*more, scan[text_col].alias("text"), F.struct(file.alias("file"), row.alias("row"), F.lit(text_col).alias("column")).alias("at"))


def fetch(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows ``wanted`` (with ``at``) beside their ``text``, from rows of ``text, at``."""
    spot = F.xxhash64("at.file", "at.row", "at.column")
    a, b = texts.select("text", "at", spot.alias("spot")).alias("a"), wanted.select("*", spot.alias("spot")).alias("b")
    return a.join(b, (F.col("a.spot") == F.col("b.spot")) & (F.col("a.at") == F.col("b.at"))).select("b.*", "a.text").drop("spot")


def update_state(spark: SparkSession, source: str, schema, checkpoint: str, sink: str, files_per_batch: int = 100_000) -> None:
    """Take all files that are new in ``source`` into the state kept at ``checkpoint``.

    Can be called again as files arrive: what is known stays, and each run writes the
    changed keys to ``sink/run=N``.  Each file holds ``digest, id, at``.
    """
    seen = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first"), F.count(F.lit(1)).alias("size"))
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/run={number:09d}")

    with settings(spark, _STATE):
        query = (
            seen.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def _latest(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    """What the state holds: for each digest its last change."""
    changes = spark.read.schema(schema + ", run int").option("basePath", sink).parquet(sink)
    return changes.groupBy("digest").agg(F.max_by(F.struct("first", "size"), "run").alias("last")).select("digest", "last.*")


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, state: str | None = None) -> DataFrame:
    """One row for each input row: ``id, digest, at, keep_id, size, kept``.

    ``digest`` is an expression from text to key; any will do, since equal keys are
    compared in full.  Null texts count as empty.  Of equal texts the row with the
    smallest identifier stays (a null identifier counts as the largest; of rows that
    repeat the identifier too, one stays).  An empty table gives an empty table.

    With ``state``, a folder that driver and executors share, the state lasts: rows of
    earlier calls on it count too.  Their decisions stand as they were returned; a row
    that comes later with a smaller identifier becomes its group's first from then on.
    Their files must still be there, since texts under one digest are fetched from them
    by locator and compared.  Without ``state`` a new folder is taken.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    state = state or folder(spark, "state")
    rows = located(docs, id_col, text_col)
    earlier = _earlier(spark, f"{state}/arrived/*")
    lot = f"{state}/arrived/{uuid.uuid4().hex}"
    rows.select(digest(normalised(F.col("text"))).alias("digest"), "id", "at").write.parquet(lot)
    arrived = spark.read.parquet(lot)
    if arrived.isEmpty():  # a stream needs a file to read
        return arrived.select("id", "digest", "at", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"))
    key = arrived.schema["digest"].dataType.simpleString()
    update_state(spark, f"{state}/arrived/*", arrived.schema, f"{state}/checkpoint", f"{state}/changes")
    known = stored(_latest(spark, f"{state}/changes", f"digest {key}, first struct<none:boolean,id:{kind},at:{_PLACE}>, size bigint"), "known")
    found = stored(
        join_counted(arrived, known, "digest", "size").select(
            "id", "digest", "at", F.col("first.id").alias("keep_id"), "size", (F.col("at") == F.col("first.at")).alias("kept")
        ),
        "resolved",
    )
    hits = _hits(rows, found, earlier)
    several = _several_texts(hits)
    if several.isEmpty():
        return found
    split = stored(hits.join(several, "digest", "left_semi").withColumn("text", normalised(F.col("text"))), "split")
    ones = split.groupBy("text").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    again = split.filter("now").join(ones, "text").select("id", "digest", "at", F.col("first.id").alias("keep_id"), F.col("n").alias("size"), (F.col("at") == F.col("first.at")).alias("kept"))
    return found.join(several, "digest", "left_anti").unionByName(again)


def _earlier(spark: SparkSession, lots: str) -> DataFrame | None:
    """What arrived in earlier calls on the same state."""
    try:
        return spark.read.parquet(lots)
    except AnalysisException:  # nothing yet
        return None


def _hits(rows: DataFrame, found: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """``digest, id, at, now, text`` of the rows under digests with more than one, with those
    of earlier calls (not ``now``), fetched by locator."""
    spark = found.sparkSession
    hits = found.filter("size > 1").select("digest", "id", "at", F.lit(True).alias("now"))
    texts = fetch(rows, hits)
    if earlier is None:
        return texts
    before = stored(earlier.join(hits.select("digest").distinct(), "digest", "left_semi").select("digest", "id", "at", F.lit(False).alias("now")), "earlier")
    files: dict[str, list[str]] = {}
    for r in before.select("at.file", "at.column").distinct().collect():  # names of files
        files.setdefault(r.column, []).append(r.file)
    for column, names in files.items():
        texts = texts.unionByName(fetch(_placed(spark.read.parquet(*names), column), before))
    return texts


def _several_texts(hits: DataFrame) -> DataFrame:
    """Digests that stand for more than one text.  Copies fold into one row before they are
    shuffled, since the full bytes are the grouping key."""
    texts = hits.groupBy("digest", normalised(F.col("text")).alias("text")).agg(F.lit(1).alias("one"))
    several = texts.groupBy("digest").agg(F.count("one").alias("texts")).filter("texts > 1").select("digest")
    with settings(hits.sparkSession, _THIN):
        return stored(several, "several")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Same rules as :func:`dedup_documents`.  An empty table stays empty.
    """
    found = resolve(docs, id_col, text_col, state=state)
    dropped = found.filter(~F.col("kept")).select("id", "digest").distinct()
    stay = found.filter("kept").select("id", "digest")
    both = dropped["id"].eqNullSafe(stay["id"]) & (dropped["digest"] == stay["digest"])
    twice = stored(dropped.join(stay, both, "left_semi"), "twice")
    key, a, b = fresh(docs, "digest"), docs.alias("a"), stay.alias("b")
    digest = sha256(normalised(docs[text_col]))
    out = a.join(b, docs[id_col].eqNullSafe(F.col("b.id")) & (digest == F.col("b.digest")), "left_semi")
    if not twice.isEmpty():  # rows that repeat identifier and text
        out = out.withColumn(key, sha256(normalised(F.col(f"a.{text_col}")))).dropDuplicates([id_col, key])
    return out.select(*docs.columns)


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: str | None = None) -> DataFrame:
    """Which rows stay: ``doc_id, keep_id, group_size, kept, text_sha256``, one row for
    each input row.

    Texts are equal when identical after :func:`normalised`.  A null text counts as
    empty.  The smallest identifier of a group stays; null identifiers come last, and
    of rows that repeat an identifier with its text one stays.  An empty table gives an
    empty table.  Other columns are not read.  ``state`` as in :func:`resolve`.
    """
    found = resolve(docs, id_col, text_col, state=state)
    return found.select(
        F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
