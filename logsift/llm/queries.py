"""The numbered queries over the given tables and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.llm.chat import fold_events, read_back, render
from logsift.llm.common import table
from logsift.llm.decontam import contamination
from logsift.llm.language import held_out, language_counts, predict_languages
from logsift.llm.manifest import SQL as MANIFEST_SQL
from logsift.llm.manifest import manifest
from logsift.llm.near_dedup import near_duplicates
from logsift.llm.packing import pack_documents
from logsift.llm.periodic import made_periodic, periodic_runs
from logsift.llm.quality import judged
from logsift.llm.secrets import BASE, find_secrets, kind_count, span_text
from logsift.llm.suffix_tree import scored
from logsift.llm.token_files import read_token_files, write_token_files
from logsift.llm.url_filter import judged_urls
from logsift.llm.word_bpe import decoded, encoded
from logsift.scratch import materialize, scratch_path


def op1_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token_files")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary, end_id=1)
    return read_token_files(spark, folder)


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "votes", "quality",
    )


def op3_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary, end_id=0).drop("ids")


PROBE = "\\### Assistant: </turn> ok"


def op4_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``conversations`` is the event that opens a message; rows keep their turn order."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    events = rows.union(probe).select(
        "conv_id", nth.cast("long").alias("seq"), F.lit("message").alias("kind"),
        nth.cast("string").alias("message"), "role", "text",
    )
    return read_back(materialize(render(fold_events(events)), "chat"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[kind_count("spans", kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(span_text("spans", BASE).cast("binary"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
    )


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs.select("doc_id", "text", held_out(10).alias("held_out")))


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = language_counts(docs.where(~held_out(5)))
    found = predict_languages(docs, counts)
    return found.select(
        "doc_id", held_out(5).alias("held_out"), "lang_pred", "score",
        F.to_json("proportions").alias("mixture"), "background",
    )


def op9_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(table(spark, sf_dir, "pages"))


def op10_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.withColumn("items_sha256", digest).drop("items")


def op11_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    back = decoded(encoded(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_block_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), made_periodic)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def greater(best: Column, run: Column) -> Column:
        more = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(more, run).otherwise(best)

    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("best", F.aggregate("runs", none, greater)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_recursive_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simple8b": op1_simple8b,
    "op2_weak_supervision": op2_weak_supervision,
    "op3_min_bin_slack": op3_min_bin_slack,
    "op4_event_sourced_chat": op4_event_sourced_chat,
    "op5_secret_scan": op5_secret_scan,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_superminhash": op7_superminhash,
    "op8_language_mixture": op8_language_mixture,
    "op9_boosted_urls": op9_boosted_urls,
    "op10_positional_index": op10_positional_index,
    "op11_merge_rounds": op11_merge_rounds,
    "op12_block_convolution": op12_block_convolution,
    "op13_recursive_climb": op13_recursive_climb,
}

# SQL has no byte-pair merges, transforms, tokenizers or similarity groups; the others have tests.
ORACLES: dict[str, str] = {"op13_recursive_climb": MANIFEST_SQL}
