"""A linear memory model of a plan, and what the nodes of an executed plan report.

The model follows one scan batch of N rows through the plan. Each node has a
peak (bytes alive for each scan row while it runs), a width and a ratio (its
rows for each scan row); a batch of ``budget / peak`` rows then fits the budget.
It informs; results never depend on it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VARIABLE = 32
_FIXED = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}


def row_width(schema: T.StructType) -> int:
    """Bytes of a row: fixed widths, 32 for anything of variable length, 1 at least."""
    return max(1, sum(_FIXED.get(type(f.dataType), VARIABLE) for f in schema))


def reader_batch_rows(budget: int, width: int = 4096, least: int = 1024, most: int = 65536) -> int:
    """Rows of a columnar reader batch whose rows of ``width`` bytes stay within the budget."""
    return max(least, min(most, budget // width))


@dataclass
class Estimate:
    """What the model says of one node, in bytes for each scan row but for the ratio."""

    kind: str
    width: int
    peak: float
    ratio: float
    read: float
    made: float
    children: list[Estimate] = field(default_factory=list)

    @property
    def cost(self) -> int:
        """Bytes read and made by this node and all below it, for each scan row."""
        return int(self.read) + int(self.made) + sum(c.cost for c in self.children)

    def batch_rows(self, budget: int) -> int | None:
        """Scan rows of a batch that stays within the budget; None if the plan needs no memory."""
        return max(1, budget // int(self.peak)) if int(self.peak) else None


def leaf(width: int) -> Estimate:
    return Estimate("leaf", width, width, 1.0, 0, width)


def node(kind: str, width: int, *children: Estimate, selectivity: float = 1.0, fanout: float = 1.0) -> Estimate:
    """One node over its children: filter, project, aggregate, join, cross, sort, union, or anything else."""
    below = max((c.peak for c in children), default=0)
    inputs = [c.ratio * c.width for c in children]
    read = sum(inputs)
    if kind == "filter":
        ratio = children[0].ratio * selectivity
    elif kind in ("project", "aggregate"):
        ratio = children[0].ratio
    elif kind == "join":
        ratio = max(c.ratio for c in children) * fanout
    elif kind == "cross":
        ratio = children[0].ratio * children[1].ratio * fanout
    elif kind == "sort":
        return Estimate(kind, width, max(below, 2 * read), children[0].ratio, read, read, list(children))
    elif kind == "union" and len(children) > 1:
        ratio = sum(c.ratio for c in children)
    else:
        return Estimate(kind, width, below, max([1.0, *(c.ratio for c in children)]), 0, 0, list(children))
    made = ratio * width
    return Estimate(kind, width, max(below, read + made), ratio, read, made, list(children))


_KINDS = {
    "Filter": "filter", "Project": "project", "Aggregate": "aggregate", "Distinct": "aggregate", "Sort": "sort", "Union": "union",
}


def analyse(df: DataFrame) -> Estimate:
    """The model over the optimised logical plan of a DataFrame (a classic session's, as it walks JVM objects)."""

    def width(plan) -> int:
        schema = T._parse_datatype_json_string(plan.schema().json())
        return row_width(schema)

    def walk(plan) -> Estimate:
        name = plan.nodeName()
        children = plan.children()
        below = [walk(children.apply(i)) for i in range(children.size())]
        if not below:
            return leaf(width(plan))
        if name == "Join":
            equi = plan.condition().isDefined() and " = " in plan.condition().get().toString()
            return node("join" if equi else "cross", width(plan), *below)
        return node(_KINDS.get(name, "other"), width(plan), *below)

    return walk(df._jdf.queryExecution().optimizedPlan())


@dataclass
class NodeStats:
    """One node of an executed plan, children first."""

    name: str
    depth: int
    metrics: dict[str, int]

    @property
    def rows(self) -> int | None:
        return self.metrics.get("numOutputRows")


def node_stats(df: DataFrame) -> list[NodeStats]:
    """Metrics of every node of the plan that ran last for ``df``, in post-order."""
    out: list[NodeStats] = []

    def values(plan) -> dict[str, int]:
        found, it = {}, plan.metrics().iterator()
        while it.hasNext():
            pair = it.next()
            found[pair._1()] = int(pair._2().value())
        return found

    def walk(plan, depth: int) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan(), depth)
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan(), depth)
        children = plan.children()
        for i in range(children.size()):
            walk(children.apply(i), depth + 1)
        out.append(NodeStats(plan.nodeName(), depth, values(plan)))
        return None

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return out
