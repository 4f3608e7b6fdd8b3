"""Structured filters combined with vector search."""

from pyspark.sql import DataFrame, SparkSession

from ..catalogue import query, table
from ..operators.vector import filtered_search, l2_distance, shortlist_search

_NEAREST = """
    WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: pow(CAST(embedding[i] AS DOUBLE) - CAST(v[i] AS DOUBLE), 2)))), 6) AS dist
    FROM embeddings, q WHERE label IN (1, 2, 3) ORDER BY dist, vec_id LIMIT 20"""


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


@query(_NEAREST)
def vec_filtered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search in a filtered set."""
    return filtered_search(table(spark, sf_dir, "embeddings"), "label IN (1, 2, 3)", _probe(spark, sf_dir), k=20, digits=6)


@query(_NEAREST.replace("ORDER BY dist, vec_id LIMIT 20", "").replace("WHERE label IN (1, 2, 3)", ""))
def vec_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", l2_distance("embedding", _probe(spark, sf_dir), digits=6).alias("dist"))


@query()
def vec_shortlist_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search through a shortlist from random projections, with the rows that it can't rule out; distances aren't rounded, so without SQL."""
    return shortlist_search(table(spark, sf_dir, "embeddings"), "label IN (1, 2, 3)", _probe(spark, sf_dir), k=20)
