"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_salted, materialize, release


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _in_one_task(table: pa.Table) -> pa.Table:
    """The components of few links, by taking the least neighbour's label until nothing changes."""
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    nodes, places = np.unique(np.r_[a, b], return_inverse=True)
    x, y, label = places[: len(a)], places[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        for ends in (x, y):
            np.minimum.at(after, label[ends], least)
            np.minimum.at(after, ends, least)
        while not np.array_equal(after, after[after]):  # each label is a node with a label of its own
            after = after[after]
        if np.array_equal(after, label):
            return pa.table({"a": nodes, "b": nodes[label]})
        label = after


def connected_components(links: DataFrame, small: int = 200_000) -> DataFrame:
    """(a, b): every node of ``links`` (a, b) and its component, the smallest node that it reaches.

    Each round hangs every node's larger neighbours, then every node's smaller
    neighbours, on the smallest node it knows, until nothing changes. All steps
    are aggregations and joins on the node; nothing is gathered on the driver
    but one checksum a round. A node may have a third of all links, so its least
    neighbour goes to the parts into which they are dealt. At most ``small`` links
    (16 bytes each), by count, are done in one task. Self links and repeated
    links are harmless. A result may be handed in again, with more links.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    given = materialize(links.select(high.alias("a"), low.alias("b")).distinct())
    # a node may come with a link to itself alone
    alone = given.where("a = b")
    edges, last = given.where("a <> b"), None
    if given.count() <= small:
        found = materialize(given.withColumn("job", F.lit(0)).groupBy("job").applyInArrow(_in_one_task, "a long, b long"))
        release(given)
        return found
    before = _signature(edges)
    done = not before[0]
    while not done:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            join_salted(both, least, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).where("a <> b").distinct()
        small_star = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = join_salted(large, small_star, "a", "b")
        after = materialize(
            hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small_star.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        now = _signature(after)
        release(last)
        edges, last, done, before = after, after, now == before, now
    inner = edges.groupBy("a").agg(F.min("b").alias("b"))
    roots = edges.select(F.col("b").alias("a")).unionByName(alone.select("a")).distinct().withColumn("b", F.col("a"))
    found = materialize(inner.unionByName(roots.join(inner, "a", "left_anti")))
    release(given, last)
    return found
