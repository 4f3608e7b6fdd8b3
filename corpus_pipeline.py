"""A corpus cleaning pipeline of the training-data operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents that go on, in the columns of ``documents``, but for the
last, which also numbers the copies that the mix takes. ``run`` writes every
stage as Parquet to the shared folder and reads it as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import join_by_id, materialize, release
from tessera.llm.decontaminate import clean
from tessera.llm.language_id import UNKNOWN, fit, predict
from tessera.llm.line_dedup import dedup_lines, without_lines
from tessera.llm.mixing import emit, mix_sources
from tessera.llm.ngram_jaccard import ngram_jaccard

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if the network gives its language less than this.
LEAST_SCORE = 0.3
#: Lines of as many characters take part in line dedup; a document that loses lines and keeps none of them goes.
LEAST_LINE = 32


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the network knows: those without a letter, or scored too low, go.

    Null and empty texts have no letter. Repeated rows are judged alike, a very long text by all its windows.
    """
    found = predict(docs, fit(docs), keep=COLUMNS, carry="text")
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier in the corpus, equal or nearly; those left with short lines only go.

    Documents that lose no line stay as they are, null and empty texts and rows without doc_id among them.
    """
    kept = dedup_lines(docs.select(*COLUMNS), least=LEAST_LINE)
    text = without_lines(F.col("text"), F.col("lines_gone"))
    return (
        kept.withColumn("text", text).withColumn("n_chars", F.when(F.size("lines_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .where((F.size("lines_gone") == 0) | F.exists(F.split("text", "\n"), lambda line: F.length(line) >= LEAST_LINE)).select(*COLUMNS)
    )


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates.

    Texts without a word are in no group, nor are rows without doc_id. Rows that repeat a doc_id stay or go together.
    """
    groups = ngram_jaccard(docs.select("doc_id", "text"))
    gone = groups.where("doc_id <> component_id").select("doc_id")
    return join_by_id(docs.select(*COLUMNS), gone, "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Rows without doc_id are judged one by one.

    Rows that repeat a doc_id go together if any of them holds a window. Null and empty texts hold none.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return clean(docs.select(*COLUMNS), benchmark).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, numbered by copy; those without a word are not taken."""
    return emit(mix_sources(docs.select(*COLUMNS))).select(*COLUMNS, "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixture),
]

#: The network and the edit join have no SQL form; a test checks the invariants of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
