"""Decontamination where rows repeat a doc_id or have none."""

import corpus_pipeline

from tessera.llm.decontaminate import decontaminate

ITEM = "one two three four five six seven eight nine ten eleven"


def tables(spark, path=None):
    texts = [(1, f"a {ITEM}"), (1, f"a {ITEM}"), (2, f"x {ITEM}"), (2, "clean words"), (3, "one two three four five six"), (3, "a a a a a a seven eight nine ten eleven"),
             (4, "fine"), (None, f"b {ITEM}"), (None, "fine too"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")


def test_repeated_ids(spark):
    for options in ({}, {"small": 0, "rarest": 1}):
        found = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in decontaminate(*tables(spark), **options).collect()}
        # no window is put together from two rows
        assert found == {1: (11, True), 2: (11, True), 3: (0, False), 4: (0, False)}


def test_stage_searches_rows_without_id(spark, tmp_path):
    docs, benchmark = tables(spark)
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(3, "one two three four five six"), (3, "a a a a a a seven eight nine ten eleven"), (4, "fine"), (None, "fine too"), (None, None)], key=str)
