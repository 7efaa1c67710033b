"""The corpus pipeline: five stages, each one of the operators of ``stratiq.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again before the next.  All stages but the last return the columns of
``documents``.

Defined results
---------------
* Null and empty texts, and texts without a letter, leave in the first stage.
* Null ids, languages and sources are values like others; rows without a language
  do not train the first stage.  If no row has one, all documents leave.
* An empty table gives an empty result with the same columns.
* Further columns stay; one that is named like an output of the last stage (ids,
  n_tokens, ids_sha256, decoded_sha256) raises ValueError there.
* Ids are whole numbers, or texts that are numbers, as the third stage asks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiq.llm import exact_dedup, language, mixing, near_dedup, pieces
from stratiq.llm.common import documents, saved
from stratiq.llm.queries import piece_model


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier names with a posterior of a half or more; ``und`` goes."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text").alias("_text"))
    found = language.annotate(packed, language.fit(docs), "_text", "_lang", "_score")
    return found.filter((F.col("_lang") != "und") & (F.col("_score") >= 0.5)).select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text that is the same but for white space."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by a similarity of 0.8 on five-word shingles."""
    return near_dedup.deduplicate(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, shard after shard."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids and the digests of ids and decoded text."""
    return pieces.encode(docs, piece_model(), ids=True, decoded=False, digests=True)


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: Learned and hashed stages: SQL can't express them.  tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
