"""Nearest neighbours by clusters with bounds, against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import session
from lexmill.operators import vector, vector_index

ROW = "vec_id long, embedding array<float>, label string"


def made(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], ROW)


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1"])
def test_hits_are_those_of_a_full_scan(spark, metric):
    """Clustered vectors, ties, repeated ones, and some that no search finds; clustered ones need few of the clusters."""
    random = np.random.default_rng(0)
    centres = random.normal(size=(30, 8)) * 20
    rows = [(i, centres[i % 30] + random.normal(size=8) * 0.3) for i in range(900)]
    rows += [(900 + i, rows[i][1]) for i in range(40)] + [(990, None), (991, np.zeros(8)), (992, [1.0, 2.0]), (993, [None] * 8), (994, [float("nan")] * 8)]
    df = made(spark, rows)
    index = vector_index.build(df, session.scratch_path(spark, "vectors"), metric)
    again = vector_index.opened(spark, index.path)
    assert sorted(c[3] for c in again.clusters) == sorted(c[3] for c in index.clusters) and sum(c[3] for c in index.clusters) == (940 if metric == "cosine" else 941)
    usable = df.filter("vec_id NOT IN (990, 992, 993, 994)")
    for q in (rows[0][1], centres[3], random.normal(size=8) * 50):
        for k in (1, 45):
            got, want = [[(r.vec_id, round(r.distance, 9)) for r in x.collect()] for x in (vector_index.knn(index, list(q), k), vector.knn(usable, list(q), k, metric))]
            assert got == want
    read = vector_index.clusters_read(index, list(rows[0][1]), 5)
    assert index.rows(read).count() <= 0.25 * 940 and len(index.rows(read).inputFiles()) < len(index.rows([c[0] for c in index.clusters]).inputFiles())
    assert vector_index.knn(index, [1.0, 2.0], 3).count() == 0 and index.rows(read).columns == df.columns


def test_an_empty_table(spark):
    index = vector_index.build(made(spark, []), session.scratch_path(spark, "vectors"))
    assert index.clusters == [] and vector_index.knn(index, [1.0], 3).count() == 0
    assert vector_index.opened(spark, index.path).clusters == [] and vector_index.opened(spark, index.path + "x") is None
    assert vector_index.knn(index, [], 3).select(F.col("vec_id")).count() == 0
