"""Sessions: settings that every query of the engine runs under."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .plans.report import reader_batch_rows

DEFAULT_BUDGET = 2 << 30


def build_session(target_partitions: int | None = None, memory_budget: int = DEFAULT_BUDGET, *, master: str | None = None, app: str = "tessera") -> SparkSession:
    """A session with adaptive execution, ANSI semantics and UTC.

    ``target_partitions`` sets the shuffle partitions, by default the number
    of local cores; on a cluster give a few for each core, adaptive execution
    coalesces them. ``memory_budget`` bounds a scan batch of a wide row (see
    ``plans.report``). The master comes from spark-submit unless given.
    """
    cores = os.cpu_count() or 1
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(target_partitions or cores),
        "spark.sql.parquet.columnarReaderBatchSize": str(reader_batch_rows(memory_budget)),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
