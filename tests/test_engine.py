"""The engine's API, its directory source, the memory model, the command line and streaming."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import __main__ as cli
from tessera.api import Engine
from tessera.plans.report import leaf, node, reader_batch_rows, row_width
from tessera.sources.directory import list_tables
from tessera.streaming import windowed_counts


@pytest.fixture(scope="module")
def engine(spark, sf_dir):
    return Engine(sf_dir, spark=spark)


def test_registers_every_table(engine):
    assert {"region", "nation", "lineitem", "orders"} <= set(engine.tables)


def test_other_files_are_skipped(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / ".hidden.parquet").write_text("x")
    assert list(list_tables(spark, str(tmp_path))) == ["t"]


def test_execute(engine):
    table = engine.execute("SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT 2")
    assert table.column("r_regionkey").to_pylist() == [0, 1]


def test_duplicate_output_names(engine):
    assert engine.sql("SELECT * FROM region a, region b").count() == 25


def test_instrumented(engine):
    found = engine.execute_instrumented("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey")
    assert found.rows.num_rows == 5
    assert found.nodes[-1].depth == 0 and max(n.rows or 0 for n in found.nodes) >= 5
    assert found.estimate.peak > 0 and found.estimate.batch_rows(2 << 30) > 1


def test_command_line(spark, sf_dir, capsys):
    assert cli.main(["--data-dir", sf_dir, "--query", "SELECT count(*) AS n FROM region"]) == 0
    assert "5" in capsys.readouterr().out


def test_row_width():
    schema = T.StructType().add("a", T.IntegerType()).add("b", T.DecimalType(15, 2)).add("c", T.StringType()).add("d", T.DateType())
    assert row_width(schema) == 4 + 16 + 32 + 4
    assert row_width(T.StructType()) == 1


def test_model():
    scan = leaf(32)
    kept = node("filter", 32, scan, selectivity=0.5)
    assert (kept.peak, kept.ratio, kept.read, kept.made) == (48, 0.5, 32, 16)
    crossed = node("cross", 140, leaf(68), leaf(72))
    assert crossed.peak == 280 and crossed.batch_rows(2800) == 10
    assert node("sort", 32, scan).peak == 64
    assert node("union", 32, scan, leaf(32)).ratio == 2
    assert node("other", 32, scan).peak == 32
    assert leaf(32).batch_rows(2 << 30) == 67_108_864


def test_small_budget_shrinks_batches():
    assert reader_batch_rows(10 << 10) == 1024 and reader_batch_rows(2 << 30) == 65536


def test_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    wanted = windowed_counts(events)
    got = spark.table("counts")
    assert got.count() == wanted.count() and got.agg(F.sum("n")).first()[0] == events.count()
