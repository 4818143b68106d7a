"""Documents to packed sequences: each stage reads what its predecessor kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents. Rows are told
apart by their place in the table, so documents without an id and rows that share an id are judged
one by one. Of repeated rows and of exact copies without id one stays. An empty table passes through
all stages. The result has the token ids of every piece beside its place.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import table
from logsift.llm.decontam import contamination
from logsift.llm.language import held_out, in_known_language, language_counts
from logsift.llm.near_dedup import near_duplicates
from logsift.llm.packing import pack_documents
from logsift.llm.secrets import redacted
from logsift.scratch import join_counted, materialize

# Least share of the text in its main language; below it, without a letter, or with more than
# MOST_BACKGROUND of the text in no learned language, a document goes.
LEAST_LANGUAGE = 0.3
# Similarity in percent from which documents on five-word shingles are near duplicates.
NEAR = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language learned from the labelled ones."""
    return in_known_language(docs, language_counts(docs.where(~held_out(5))), LEAST_LANGUAGE)


def _free_name(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that ``docs`` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _by_row(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(docs with a row number, (doc_id, text) with that number as the id, its name in the first)."""
    row = _free_name(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered, numbered.select(F.col(row).alias("doc_id"), "text"), row


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group the row with the smallest doc_id (one without only if all are)."""
    numbered, named, row = _by_row(docs)
    groups = materialize(near_duplicates(named, NEAR).select(F.col("doc_id").alias(row), "component_id"), "groups")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    ranked = numbered.select("doc_id", row).join(groups, row).groupBy("component_id")
    first = ranked.agg(F.min(rank).getField(row).alias("first"), F.count("*").alias("_rows"))
    several = materialize(first.where("_rows > 1"), "several")
    gone = join_counted(groups, several, ["component_id"], "_rows").where(F.col(row) != F.col("first")).select(row)
    return numbered.join(gone, row, "left_anti").drop(row)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    numbered, named, row = _by_row(docs)
    hit = contamination(named, table(spark, sf_dir, "benchmark")).where("contaminated")
    return numbered.join(hit.select(F.col("doc_id").alias(row)), row, "left_anti").drop(row)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, its secrets replaced by a mark; n_chars follows the text."""
    chars = _free_name(docs, "_chars")
    before = F.length("text")
    clean = redacted(docs.withColumn(chars, before))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.col("n_chars") + F.coalesce(before - F.col(chars), F.lit(0)))
    return clean.select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids (little-endian 32-bit), sequence and place in it."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_dedup", one_of_each_group),
    ("decontaminate", uncontaminated),
    ("secrets", without_secrets),
    ("pack", packed_sequences),
]

# Similarity groups, tokenizers and packing have no SQL; tests hold the run against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
