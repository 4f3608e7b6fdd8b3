"""The pipeline's line dedup keeps documents with lines of their own."""

import corpus_pipeline


def test_own_lines_keep_a_document(spark):
    shared = "\n".join(f"a passage that many documents share, number {n * 7919}, word {'x' * n}" for n in range(30))
    own = "this line stands in no other document of the corpus"
    texts = [(1, shared), (2, f"{shared}\n{own}"), (3, f"{shared}\nshort"), (4, "short"), (5, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.distinct_lines(spark, docs, "").collect()}
    assert found[2] == own and set(found) == {1, 2, 4, 5}
