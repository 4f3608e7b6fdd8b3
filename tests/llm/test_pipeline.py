"""The pipeline: its stages' columns, what they drop, and that reruns agree."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    fine = docs.where("length(text) > 300").first()["text"]
    odd = [(10_000, "12 34", None, "s"), (10_001, None, None, "s"), (10_002, f"{fine[:200]} {passage} {fine[200:]}", "en", "s"), (10_003, fine, "en", "s")]
    more = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd], docs.schema)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{number}")
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
        assert now.columns[:5] == list(corpus_pipeline.COLUMNS)
    assert not {10_000, 10_001} & kept[0] and {10_002, 10_003} <= kept[0]
    assert 10_003 not in kept[1]  # each of its lines stands earlier
    assert 10_002 not in kept[3]
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False))
    assert len(kept[3]) > 0.8 * docs.count()
    again = corpus_pipeline.run(spark, str(tmp_path))
    count = lambda df: sorted(df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect())
    assert count(again) == count(now)
