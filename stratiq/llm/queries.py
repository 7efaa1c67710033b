"""The registered queries of this package; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, exact_dedup, language, line_dedup, mixing, near_dedup, pieces, quality_rules, site_quality, suffix_dedup, token_counts, toxicity, twins, vector_codes
from .common import documents, fold, labels

#: The vocabulary of op 5; the file's place is a parameter of the operator.
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    machine = toxicity.fit(docs, labels(spark, sf_dir).filter(fold("doc_id", 5) != 0))
    return toxicity.annotate(docs.withColumn("held_out", fold("doc_id", 5) == 0), machine).select("doc_id", "held_out", "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(documents(spark, sf_dir).select("doc_id", "text"), piece_model()).select("doc_id", "n_pretokens", "n_tokens")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(documents(spark, sf_dir), width=2)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(documents(spark, sf_dir), piece_model())


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 4) == 2)
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.annotate(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The source is the host; its languages are the paths.
    return site_quality.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.apply(docs, quality_rules.train(docs, labels(spark, sf_dir)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.audit(turns, present=F.col("present"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(documents(spark, sf_dir))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id NULLS LAST)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_token_counts": op2_token_counts,
        "op3_mixing": op3_mixing,
        "op4_near_dedup": op4_near_dedup,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_language": op6_language,
        "op7_site_quality": op7_site_quality,
        "op8_quality_rules": op8_quality_rules,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_vector_codes": op11_vector_codes,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": OP9_SQL, "op11_vector_codes": twins.OP11, "op12_conversation_repair": twins.OP12, "op13_line_dedup": twins.OP13}
