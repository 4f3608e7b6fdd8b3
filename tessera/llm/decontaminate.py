"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

One pass over the training documents stores the postings (document, position,
term) of every word that a benchmark has, and the word count of every
document. Benchmark items are cut into windows of ``window`` consecutive words.
The rarest terms of a window, by the length of their posting lists, are looked
up first; a posting less the term's offset in the window is a place where the
window would start, and only starts that the lists of the rarest terms agree on
stay. All other terms of the window are then intersected the same way, in the
documents that are left. ``proximity`` finds terms near one another in the same
index. The documents are never broadcast or gathered; the tables of benchmark
terms and windows are sized by the benchmark, and are broadcast only below a
counted bound, else joined by shuffle, salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_id, join_salted, materialize, release

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; the empty pieces that a split leaves at its ends go."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), GAPS), lambda w: w != "")


def row_key() -> Column:
    """A 64-bit key of a row, by its doc_id and text: rows that repeat a doc_id are searched one by one, those without one too."""
    return F.xxhash64("doc_id", "text")


def build_index(documents: DataFrame, vocabulary: DataFrame, small: int = 1_000_000) -> DataFrame:
    """The stored index: doc_id, row, pos, term of every word of ``vocabulary`` (term) in the documents.

    pos counts from 1 and term is the word's 64-bit hash. Each row also has an
    entry with pos 0, whose term is its number of words. One pass over the texts
    writes all of it.
    """
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = docs.select("doc_id", row_key().alias("row"), words(F.col("text")).alias("w"))
    # the count stands before the words, behind a blank, which no word has
    spread = F.concat(F.array(F.concat(F.lit(" "), F.size("w"))), F.col("w"))
    places = whole.select("doc_id", "row", F.posexplode(spread).alias("pos", "word"))
    known = vocabulary.select(F.col("term").alias("word"), F.lit(True).alias("known")).distinct()
    wanted = F.col("known") | (F.col("pos") == 0)
    if known.count() <= small:
        found = places.join(F.broadcast(known), "word", "left")
    else:
        found = join_salted(places, known, "word", "row", "left")
    term = F.when(F.col("pos") == 0, F.substring("word", 2, 20).cast("long")).otherwise(F.xxhash64("word"))
    return materialize(found.where(wanted).select("doc_id", "row", "pos", term.alias("term")))


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, at, off, term, size: the terms of every window of every item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = items.select(
        "item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("at")
    )
    part = starts.select("item_id", "at", F.slice("w", F.col("at") + 1, F.lit(window)).alias("w"))
    return part.select("item_id", "at", F.size("w").alias("size"), F.posexplode("w").alias("off", "term"))


def _told(rows: DataFrame, facts: DataFrame, key: str, small: int) -> DataFrame:
    """``rows`` with the ``facts`` of their key; facts go to all tasks if they have at most ``small`` rows."""
    return rows.join(F.broadcast(facts), key) if facts.count() <= small else join_salted(rows, facts, key, "row")


def find_windows(index: DataFrame, terms: DataFrame, *, rarest: int = 2, small: int = 200_000) -> DataFrame:
    """doc_id, row, start, size, item_id: every occurrence in ``index`` of every window of ``terms`` (see ``_windows``); words count from 0."""
    # equal windows of several items are searched once
    spelled = (
        terms.groupBy("item_id", "at", "size").agg(F.sort_array(F.collect_list(F.struct("off", "term"))).alias("w"))
        .select("item_id", "size", F.col("w.term").alias("w"))
    )
    owners = materialize(spelled.select(F.xxhash64("w").alias("win"), "item_id", "size", "w"))
    distinct = owners.groupBy("win").agg(F.first("size").alias("size"), F.first("w").alias("w"))
    slots = distinct.select("win", "size", F.posexplode("w").alias("off", "word")).select("win", "size", "off", F.xxhash64("word").alias("term"))
    postings = index.where("pos > 0")
    length = postings.groupBy("term").agg(F.count(F.lit(1)).alias("length"))
    ranked = materialize(
        slots.join(length, "term")  # a window with a term that no document has can't occur
        .groupBy("win", "size").agg(F.sort_array(F.collect_list(F.struct("length", "off", "term"))).alias("t"))
        .where(F.size("t") == F.col("size"))
    )
    anchors = ranked.select("win", "size", F.posexplode(F.slice("t", 1, rarest)).alias("k", "s")).select(
        "win", "size", "k", F.col("s.off").alias("off"), F.col("s.term").alias("term")
    )
    found = (
        _told(postings, anchors, "term", small)
        .select("doc_id", "row", (F.col("pos") - F.col("off")).alias("start"), "win", "size", "k").where("start >= 1")
    )
    starts = materialize(
        found.groupBy("row", "start", "win", "size").agg(F.first("doc_id").alias("doc_id"), F.count_distinct("k").alias("n"))
        .where(F.col("n") >= F.least(F.col("size"), F.lit(rarest))).select("doc_id", "row", "start", "win", "size")
    )
    # the whole phrase, in the rows that are left
    left = starts.select("row").distinct()
    left = F.broadcast(left) if left.count() <= small else left.hint("shuffle_hash")
    places = postings.join(left, "row", "left_semi").select("row", "pos", "term").distinct()
    slots = ranked.select("win", F.explode("t").alias("s"))
    wanted = _told(starts, slots, "win", small).select(
        "doc_id", "row", "start", "win", "size", (F.col("start") + F.col("s.off")).alias("pos"), F.col("s.term").alias("term")
    )
    whole = (
        wanted.join(places, ["row", "pos", "term"]).groupBy("row", "start", "win", "size")
        .agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n = size")
    )
    result = materialize(
        _told(whole, owners.select("win", "item_id").distinct(), "win", small).select("doc_id", "row", (F.col("start") - 1).alias("start"), "size", "item_id")
    )
    release(owners, ranked, starts)
    return result


def proximity(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """doc_id, row, start, stop: smallest spans of at most ``within`` words that hold all ``terms``, in any order; words count from 0.

    From the postings of the given terms: every posting is taken as the last
    word of a span, together with the latest posting of each other term
    before it, in pieces of a row that overlap by ``within`` words.
    """
    wanted = sorted(set(terms))
    if not wanted or within < 1:
        raise ValueError("needs terms and a span")
    posts = index.where("pos > 0").where(F.array_contains(F.array(*[F.xxhash64(F.lit(t)) for t in wanted]), F.col("term")))
    # a piece of a row is 64 spans long; its first words stand in the piece before as well, for spans that end there
    size = 64 * within
    home = F.floor(F.col("pos") / size)
    pieces = posts.select("doc_id", "row", "pos", "term", F.explode(F.array_distinct(F.array(home, F.floor((F.col("pos") + within) / size)))).alias("piece")).distinct()
    upto = Window.partitionBy("row", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = [F.max(F.when(F.col("term") == F.xxhash64(F.lit(t)), F.col("pos"))).over(upto).alias(f"p{i}") for i, t in enumerate(wanted)]
    spans = pieces.select("doc_id", "row", F.col("pos").alias("stop"), *latest)
    for i in range(len(wanted)):
        spans = spans.where(F.col(f"p{i}").isNotNull())
    start = F.least(*[F.col(f"p{i}") for i in range(len(wanted))]) if len(wanted) > 1 else F.col("p0")
    spans = spans.select("doc_id", "row", start.alias("start"), "stop").where(F.col("stop") - F.col("start") < within)
    return spans.groupBy("doc_id", "row", (F.col("start") - 1).alias("start")).agg((F.min("stop") - 1).alias("stop"))


def _searched(documents: DataFrame, benchmark: DataFrame, window: int, rarest: int, small: int) -> tuple[DataFrame, DataFrame]:
    """The index of the documents, and the windows found in it."""
    terms = materialize(_windows(benchmark.where("item_id is not null"), window))
    index = build_index(documents, terms.select("term"))
    found = find_windows(index, terms, rarest=rarest, small=small)
    release(terms)
    return index, found


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, rarest: int = 2, small: int = 200_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, of
    whole texts. A window is ``window`` consecutive words of an item; an item
    with fewer words, but not none, is one window. n_hit counts a document's
    words inside any occurrence of a window, n_items the items with a window
    that occurs, items_sha256 digests those item_ids, sorted as strings and
    comma-joined. Null and empty texts have no words and no hits; null items
    no windows. Items without item_id are left out, and documents without
    doc_id too. Rows that repeat a doc_id count as one document whose
    occurrences come from any of its rows, with the word count of the longest.
    Very long texts are searched whole. Extra columns are ignored; empty tables
    give empty results.
    """
    index, found = _searched(documents.where("doc_id is not null"), benchmark, window, rarest, small)
    hits = (
        found.select("doc_id", "start", "size").distinct()
        .select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos"))
        .distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    items = (
        found.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    counted = index.where("pos = 0").groupBy("doc_id").agg(F.max("term").alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return counted.join(hits, "doc_id", "left").join(items, "doc_id", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, *, window: int = 10, rarest: int = 2, small: int = 200_000) -> DataFrame:
    """``documents`` without those that hold a window of an item; of rows that repeat a doc_id all go, rows without one go alone."""
    index, found = _searched(documents, benchmark, window, rarest, small)
    gone = materialize(found.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row")).distinct())
    release(index, found)
    kept = join_by_id(documents, gone.where("doc_id is not null").select("doc_id"), "left_anti")
    # rows without doc_id by their own key
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    alone = gone.where("doc_id is null").select("row")
    own = kept.withColumn("__row", F.xxhash64("doc_id", text))
    without = own.where("doc_id is null").join(alone.withColumnRenamed("row", "__row").hint("shuffle_hash"), "__row", "left_anti")
    return own.where("doc_id is not null").drop("__row").unionByName(without.drop("__row"))
