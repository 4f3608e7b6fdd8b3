"""Registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .block_neighbours import block_neighbours
from .chat_tree import format_conversations, read_packs
from .common import materialize
from .decontaminate import decontaminate
from .language_id import language_id
from .licences import scan_licences
from .line_dedup import dedup_lines, without_lines
from .mixing import mix_sources
from .ngram_jaccard import ngram_jaccard
from .secrets import scan_secrets
from .sql import ORACLES
from .warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_gone, lines_gone and the digest of what is left of every document."""
    docs = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("lines_gone", "gone")
    return docs.select(
        "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_gone"),
        F.concat_ws(",", F.col("gone").cast("array<string>")).alias("lines_gone"),
        F.sha2(without_lines(F.col("text"), F.col("gone")), 256).alias("text_sha256"),
    )


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents")).drop("spans")


def op7_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_neighbours(_table(spark, sf_dir, "embeddings"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    return read_packs(materialize(format_conversations(rows)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_ngram_jaccard, op2_secret_scan, op3_warc, op4_language_id, op5_line_dedup, op6_licence_scan,
        op7_block_neighbours, op8_mix_sources, op9_decontaminate, op10_chat_tree,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
