"""The registered queries of the text operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgauge.llm.decontamination import contamination
from opsgauge.llm.line_dedup import without_repeated_lines
from opsgauge.llm.mixing import mixed
from opsgauge.llm.near_duplicates import near_duplicates
from opsgauge.llm.pii import KINDS as PII_KINDS
from opsgauge.llm.pii import pseudonymized
from opsgauge.llm.prefix_trie import prefix_trie, turn_sequences, with_ends_digest, with_shared_heads
from opsgauge.llm.quality_classifier import resample
from opsgauge.llm.quality_rules import quality_rules
from opsgauge.llm.secret_scan import listed, secrets
from opsgauge.llm.sharding import SHARDS, sharded
from opsgauge.llm.substring_dedup import remove_repeats
from opsgauge.llm.token_alignment import align_tokens
from opsgauge.llm.url_filter import url_verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    hits = F.col("contamination")
    return found.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        (hits["n_hit"] > 0).alias("contaminated"),
    )


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    return sharded(rows, SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("char_distance", 6).alias("char_distance"),
        F.round("word_distance", 6).alias("word_distance"),
    )


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resample(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_grams", F.round("log_weight", 6).alias("log_weight"), "kept")


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")

    def count(kind: str):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(spans, ("assign", "access", "hex")), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_verdicts(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "alias_of")


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), key="example key")
    counts = [F.get("pii", F.lit(at))["n"].alias(f"n_{kind}") for at, kind in enumerate(PII_KINDS)]
    return found.select("doc_id", "text", *counts)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = mixed(docs)
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source"
    )


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    # How many turns a conversation shares with the first one of its hundred: 0 to 5, by its id.
    shared = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 6
    sequences = turn_sequences(table(spark, sf_dir, "conversations"))
    nodes, ends = prefix_trie(with_shared_heads(sequences, block=100, shared=shared, most=5))
    return with_ends_digest(nodes, ends).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
