"""Vector search in a filtered set: exact, over all rows or those that a shortlist can't rule out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def l2_distance(vector: str | Column, probe: list[float], digits: int | None = None) -> Column:
    """Euclidean distance in double precision, inside generated code; null for a null vector."""
    v = F.col(vector) if isinstance(vector, str) else vector
    q = F.array(*[F.lit(x) for x in probe])
    squares = F.zip_with(v.cast("array<double>"), q, lambda a, b: (a - b) * (a - b))
    d = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    return d if digits is None else F.round(d, digits)


def filtered_search(rows: DataFrame, where: str, probe: list[float], *, k: int, id_col: str = "vec_id", vector: str = "embedding", digits: int | None = None) -> DataFrame:
    """The k rows nearest to the probe among those that satisfy ``where``; ties to the smaller id.

    The filter reaches the scan, and each task keeps k rows.
    """
    found = rows.where(where).select(id_col, l2_distance(vector, probe, digits).alias("dist"))
    return found.orderBy(F.col("dist").asc_nulls_last(), id_col).limit(k)


def shortlist_search(
    rows: DataFrame, where: str, probe: list[float], *, k: int, shortlist: int = 200, id_col: str = "vec_id", vector: str = "embedding", planes: int = 64,
) -> DataFrame:
    """The k nearest rows through a shortlist: the ``shortlist`` rows of the filtered set whose signs on random
    hyperplanes differ least from the probe's give a distance within which k rows lie. Of the others, those whose
    length differs from the probe's by more can't be nearer and are left out; the rest is scored exactly.
    The result is that of ``filtered_search``.
    """
    dim = len(probe)
    v = F.col(vector).cast("array<double>")
    signs = []
    for p in range(planes):
        plane = [1.0 if (((p * dim + j) * 2654435761 ^ (p * 40503)) >> 13) & 1 else -1.0 for j in range(dim)]
        own = sum(a * b for a, b in zip(plane, probe, strict=True)) >= 0
        dot = F.aggregate(F.zip_with(v, F.array(*[F.lit(x) for x in plane]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        signs.append(F.when((dot >= 0) != own, 1).otherwise(0))
    differ = signs[0]
    for s in signs[1:]:
        differ = differ + s
    near = rows.where(where).withColumn("__differ", differ).orderBy("__differ", id_col).limit(shortlist)
    found = [r["dist"] for r in filtered_search(near, "true", probe, k=k, id_col=id_col, vector=vector).collect()]
    rest = rows.where(where)
    if len(found) == k and k and found[-1] is not None and math.isfinite(found[-1]):
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        own = math.sqrt(sum(x * x for x in probe))
        rest = rest.where(F.abs(length - own) <= found[-1] + 1e-9 * (length + own + found[-1]))
    return filtered_search(rest, "true", probe, k=k, id_col=id_col, vector=vector)
