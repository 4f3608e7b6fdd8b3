"""Search through a shortlist finds what exact search finds, however small the shortlist is."""

import numpy as np

from tessera.operators.vector import filtered_search, shortlist_search


def test_shortlist_recall(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, i % 3, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(9000, 1, None)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").cache()
    for probe in (rows[0][2], rows[5][2], [4.0] * 16):
        wanted = filtered_search(table, "label > 0", probe, k=20).collect()
        assert shortlist_search(table, "label > 0", probe, k=20, shortlist=40).collect() == wanted
    assert shortlist_search(table, "vec_id > 2990", probe, k=20).count() == 10
