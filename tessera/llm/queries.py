"""The registered queries of this package and their SQL."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, language, licenses, media, mixing, simhash, substring_dedup, surrogates, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Path of a rank file of the installed vocabularies (``TESSERA_VOCABULARY`` overrides it)."""
    import public_tokenizers

    return os.environ.get("TESSERA_VOCABULARY") or public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_documents(table(spark, sf_dir, "documents"))
    return found.withColumn("n_blocks", F.size("blocks").cast("long")).drop("blocks")


def remainder(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the identifier as text, modulo n: which rows are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs, remainder(3) != 1))
    held = F.coalesce(remainder(3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_documents(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)


#: Share of all tokens that each quality label is to have.
QUALITY_WEIGHTS = {"0": 0.08, "1": 0.92}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.mix_documents(docs, labels, "quality", QUALITY_WEIGHTS)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a secret of the owner of the data (``TESSERA_KEY``).  Without one, a key
    is drawn for this run and kept nowhere, so its surrogates can't be made again."""
    return surrogates.replace_entities(table(spark, sf_dir, "documents"), os.environ.get("TESSERA_KEY") or secrets.token_hex(32))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    held = F.coalesce(remainder(5) == 0, F.lit(False))
    return toxicity.score_documents(docs, machine).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"), with_media=False)


#: Of equal normalised texts the smallest identifier stays.
EXACT_DEDUP_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


#: A word goes if a 20-word window over it has an earlier start elsewhere.
SUBSTRING_DEDUP_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p, len(ws) AS n FROM w
), k AS (
  SELECT t.doc_id, t.word, t.p, CASE WHEN t.p + 19 <= t.n THEN array_to_string(w.ws[t.p : t.p + 19], ' ') END AS window_words
  FROM t JOIN w USING (doc_id)
), a AS (
  SELECT doc_id, word, p, window_words IS NOT NULL AND row_number() OVER (PARTITION BY window_words ORDER BY doc_id, p) > 1 AS again FROM k
), c AS (
  SELECT doc_id, word, p, max(again::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM a
), s AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, coalesce(s.n_removed, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_licenses": op2_licenses,
        "op3_language": op3_language,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_mixing": op6_mixing,
        "op7_surrogates": op7_surrogates,
        "op8_simhash": op8_simhash,
        "op9_toxicity": op9_toxicity,
        "op10_media": op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": EXACT_DEDUP_SQL,
        "op5_substring_dedup": SUBSTRING_DEDUP_SQL,
    }
