"""A training corpus from raw documents: five operators, each working on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.llm import byte_bpe, decontaminate, jaccard_join, language_id, line_dedup
from certloom.llm.common import durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter; a missing lang becomes the predicted one."""
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs, model).where(F.col("lang_pred") != "und")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that recur in three documents or more from all but one of them."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard_join.one_of_each(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    found = decontaminate.contaminated_words(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.col("n_hit") == 0).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with digests of the ids and of the decoded bytes."""
    encoded = byte_bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), byte_bpe.public_encoder())
    return encoded.select("doc_id", "lang", "source", "ids", *byte_bpe.digests())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]

#: Sampled paths, context trees and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result checkpointed before the next reads it."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
