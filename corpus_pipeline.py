"""A corpus pipeline: five stages, each applying one operator to what the last one kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result to the shared
folder and reads it again as the next one's input, so a lost executor costs one stage
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, language, mixing, simhash
from tessera.llm.queries import QUALITY_WEIGHTS, remainder, table, vocabulary
from tessera.llm.shared import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject; null, empty and letterless
    texts are rejected.  Repeated rows and null identifiers pass through; an empty table
    stays empty."""
    return language.keep_identified(docs, language.train(docs, remainder(3) != 1))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts, the smallest doc_id; a null
    text counts as empty, a null identifier as the largest; an empty table stays empty."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the smallest doc_id: texts link at a
    Jaccard similarity of 0.8 or more on five-word shingles.  Rows that repeat the smallest
    doc_id with its text all stay, as do rows of a group without any identifier; null and
    empty texts are equal to each other; an empty table stays empty."""
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that bring the quality labels to their target weights: a
    document stands as often as its rate says, or goes.  Without labelled rows every rate
    is one; an empty table stays empty."""
    mixture = mixing.train(docs, table(spark, sf_dir, "labels"), "quality")
    members = stored(mixing.membership(docs, mixture), "membership")
    mixing.solve(members, mixture, QUALITY_WEIGHTS)
    return mixing.drawn(docs, members, mixture)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left; small tables, since the workers of the
    other stages are still there.  A null text counts as empty; one row for each row."""
    return bpe.encode_documents(docs, vocabulary(), with_ids=False, max_pieces=100_000, max_states=80_000)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL can't express trained models, fingerprints or tokenisers; the tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
