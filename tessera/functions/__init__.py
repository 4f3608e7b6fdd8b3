"""Functions whose meaning differs from Spark's default or that Spark lacks; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero that keeps integers; null for a null or zero divisor."""
    return F.call_function("div", a.cast("long"), F.when(b != 0, b.cast("long")))


def concat_or_empty(*parts: Column) -> Column:
    """Concatenation that takes null as the empty string."""
    return F.concat_ws("", *parts)


def trunc_number(x: Column, digits: int = 0) -> Column:
    """A number cut, not rounded, after so many digits."""
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two 64-bit integers, by 92 steps of Euclid's algorithm at most."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple of two integers; 0 if either is 0."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.call_function("div", F.abs(a).cast("long"), F.when(a != 0, gcd(a, b))) * F.abs(b))


def sort_key(column: str, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """A sort key with nulls last when ascending and first when descending, unless told otherwise."""
    first = descending if nulls_first is None else nulls_first
    c = F.col(column)
    if descending:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()
