"""The engine: SQL over a directory of Parquet files."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .plans.report import Estimate, NodeStats, analyse, node_stats
from .session import DEFAULT_BUDGET, build_session
from .sources.directory import register_dir


@dataclass
class Instrumented:
    """A result with its plan, the memory model of the plan and what its nodes report."""

    rows: pa.Table
    plan: str
    estimate: Estimate
    nodes: list[NodeStats]


class Engine:
    """``Engine(path).sql(text)``; the session is the caller's if one is given."""

    def __init__(self, path: str, *, target_partitions: int | None = None, memory_budget: int = DEFAULT_BUDGET, spark: SparkSession | None = None):
        self.spark = spark or build_session(target_partitions, memory_budget)
        self.memory_budget = memory_budget
        self.tables = register_dir(self.spark, path)

    def sql(self, text: str) -> DataFrame:
        """A lazy DataFrame of one SELECT; ``.toArrow()`` gives an Arrow table."""
        return self.spark.sql(text)

    def execute(self, text: str) -> pa.Table:
        return self.sql(text).toArrow()

    def execute_instrumented(self, text: str) -> Instrumented:
        df = self.sql(text)
        # the rows come from the very execution whose plan is walked
        rows = df.toArrow()
        return Instrumented(rows, df._jdf.queryExecution().executedPlan().toString(), analyse(df), node_stats(df))

    def explain(self, text: str) -> str:
        return self.sql(text)._jdf.queryExecution().executedPlan().toString()
