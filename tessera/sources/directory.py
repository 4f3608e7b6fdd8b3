"""A directory of Parquet files as a set of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def list_tables(spark: SparkSession, path: str) -> dict[str, str]:
    """Table name to path of every ``*.parquet`` entry, a file or a folder of files, through Spark's file systems.

    Other entries are skipped; two entries with one stem raise.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, str] = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        stem, dot, kind = name.rpartition(".")
        if not dot or kind != "parquet" or stem.startswith((".", "_")):
            continue
        if stem in found:
            raise ValueError(f"two files for table {stem}")
        found[stem] = status.getPath().toString()
    return dict(sorted(found.items()))


def register_dir(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Register every table of a directory as a temporary view; nothing but footers is read."""
    tables = {}
    for name, where in list_tables(spark, path).items():
        tables[name] = spark.read.parquet(where)
        tables[name].createOrReplaceTempView(name)
    return tables
