"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every source gets a target number of words; a document of the source is
expected ``target / source_size`` times. The documents of a source stand in a
fixed order, each takes its expected copies on a line, and the line is cut at
``offset + 1, 2, 3 ...``: a document is emitted once for each cut inside its
piece. Within a source the order goes by size class and size, so that the
words taken follow the target about as closely as the documents do.

A source is one row in the windows that share out the targets and at most
about 100 rows and one for each ``cell_rows`` documents in those that add up its
cells; documents are only ever numbered inside a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_salted, materialize

GAPS = r"[\x20\x09-\x0D]+"
GAP_CHARACTERS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """The number of runs of other characters than blanks and \\x09-\\x0D; a null text has none."""
    inner = F.btrim(text, F.lit(GAP_CHARACTERS))
    return F.when(inner != "", F.size(F.split(inner, GAPS))).otherwise(0).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes to an octave, from the leading four bits; exact on integers."""
    bits = F.length(F.bin(size))
    low = F.greatest(bits - 4, F.lit(0))
    return (bits * 16 + F.call_function("shiftright", size, low)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float, share: float = 1.0) -> DataFrame:
    """source, source_size, target for (source, source_size) rows.

    Sources in code point order, null last, have the weights in turn. Targets
    share ``share`` of all sizes by weight; a target stops at ``most`` times
    its source's size and the excess is shared again by weight until none is
    above. That fixed point has a closed form: with sources ordered by cap for
    each unit of weight, the first ones stop at their cap for as long as their
    cap is below the level that what is left would reach. One row a source
    goes through the windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    values = F.array(*[F.lit(float(w)) for w in weights])
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    everything = Window.partitionBy(F.lit(0))
    by_level = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("all_weight") - F.col("weights") + F.col("weight"))
    return (
        sizes.withColumn("weight", F.element_at(values, turn + 1))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("caps", F.sum("cap").over(upto))
        .withColumn("weights", F.sum("weight").over(upto))
        .withColumn("level", level)
        # the first source below its cap sets the level for all after it; levels fall from there on
        .withColumn("open", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("open").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("weight") * F.col("open")))
        .select("source", "source_size", "weight", "target")
    )


def _named(source: Column) -> Column:
    """A source as a string that is never null."""
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))


def mix_sources(
    documents: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3,
    seed: str = "mix", cell_rows: int = 4096, text: bool = True, small: int = 200_000,
) -> DataFrame:
    """``documents`` with size, source_size, target, copies and taken (copies * size).

    Every input row is kept and copies may be 0: whoever wants the mix itself
    repeats a row ``copies`` times (see ``emit``). ``documents`` has doc_id,
    text and source; other columns pass through, but a column named like one
    of the new ones is replaced, and without ``text`` that column is left out.
    size counts ``[^\\x20\\x09-\\x0D]+`` in the whole text, null text 0. A null
    source is a source of its own, last in order. A source without words has
    target 0 and takes nothing. No row has more than ``most`` copies. The offset
    of a source comes from ``seed`` and its name, and the order from doc_id and
    text, so reruns agree; rows that repeat all of these are interchangeable. An
    empty table gives an empty result.

    One pass over the texts writes every row with its size. A source is dealt
    into cells, by size class and, in a class of more than ``cell_rows`` rows,
    by a hash of doc_id (of the text, where there is none); cells are counted
    first and then numbered on their own, so that no task holds a whole source
    and nothing but counts crosses cells. ``small`` bounds the counts of classes
    that go to all tasks.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    docs = documents.drop(*[c for c in documents.columns if c.lower() in made])
    kept = [c for c in docs.columns if text or c.lower() != "text"]
    spelled = F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*kept).alias("doc"), _named(F.col("source").cast("string")).alias("home"), word_count(F.col("text").cast("string")).alias("size"),
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), F.conv(F.substring(F.md5(spelled.cast("binary")), 1, 8), 16, 10).cast("long").alias("lot"),
    )
    rows = materialize(rows.withColumn("kind", F.struct("home", size_class(F.col("size")).alias("class"))))
    kinds = rows.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("buckets"))
    keyed = rows.join(F.broadcast(kinds), "kind") if kinds.count() <= small else join_salted(rows, kinds, "kind", "lot")
    keyed = keyed.select("doc", "home", "size", "id", "tie", F.col("kind.class").alias("class"), (F.col("lot") % F.col("buckets")).alias("bucket"))
    cell = ["home", "class", "bucket"]
    counts = keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy("home").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    sizes = counts.groupBy("home").agg(F.sum("words").alias("source_size"))
    sizes = sizes.select("source_size", F.when(F.col("home").startswith("0"), F.substring("home", 2, 1 << 30)).alias("source"))
    targets = source_targets(sizes, weights, float(most)).withColumn("home", _named(F.col("source")))
    # an offset in 2^-20 steps keeps the sums below exact
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("home")))
    offset = (F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20)))
    targets = targets.select(
        "home", "source_size", "target", offset.alias("offset"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )
    cells = counts.join(targets, "home").select(*cell, "before", "source_size", "target", "offset", "rate")
    own = Window.partitionBy(*cell).orderBy("size", F.col("id").asc_nulls_last(), "tie")
    rank = F.col("before") + F.col("rank")
    cuts = F.floor(F.col("offset") + rank * F.col("rate")) - F.floor(F.col("offset") + (rank - 1) * F.col("rate"))
    copies = F.least(cuts, F.lit(most)).cast("long")
    return (
        keyed.withColumn("rank", F.row_number().over(own)).join(cells, cell)
        .select("doc.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of ``mix_sources`` as often as its copies say, numbered by ``copy``."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
