"""Named queries of the operators over the standard tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import (
    conversation_trie, decontamination, lm, ngram_join, periodic_runs as periodic, pieces, pii, quality, secret_scan, sharding, suffix_dedup, token_output, url_filters,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op1_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf, "pages"), table(spark, sf, "labels"))


@query()
def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query()
def op3_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf, "documents")).drop("node")


@query()
def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


@query()
def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_private(table(spark, sf, "documents"))


@query()
def op6_training_order(spark: SparkSession, sf: str) -> DataFrame:
    return token_output.training_files(table(spark, sf, "documents"))


@query()
def op7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    both = pieces.encode(table(spark, sf, "documents").select("doc_id", "text"), decoded="decoded")
    return both.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query()
def op8_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return lm.score(table(spark, sf, "documents"), least=1)


@query()
def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents"))


@query()
def op11_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf, "conversations"))


@query()
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf, "documents"))


@query()
def op13_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf, "documents"))
