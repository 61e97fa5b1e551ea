"""What a task of a nearest-neighbour search holds does not grow with the bank or the number of its cells."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from oddlens.operators import keyed
from oddlens.operators import vectors as ve


def test_distances_of_a_full_block():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(ve.BLOCK, 8)), r.normal(size=(ve.BLOCK, 8))
    for k in (1, 3):
        tracemalloc.start()
        d = ve._small(x, y, k)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 48e6  # one matrix of a block and another would be 134 MB
        for row in (0, 255, 256, ve.BLOCK - 1):
            assert np.allclose(d[row], np.sort(np.sqrt(((x[row] - y) ** 2).sum(1)))[:k])
    y[7] = np.nan
    assert np.allclose(ve._small(x[:5], y, 1)[:, 0], np.sqrt(((x[:5, None] - np.delete(y, 7, 0)[None]) ** 2).sum(2)).min(1))


def test_rows_met_by_many_rows_of_a_model(spark):
    """Every pair once, in portions, whichever way the model goes to the rows."""
    rows = spark.range(0, 5000, 1, 2).select((F.col("id") % 2).alias("key"), "id")
    model = spark.range(80).select((F.col("id") % 2).alias("key"), F.col("id").alias("m"))

    def work(part, own):
        return part.merge(own[["m"]], how="cross").assign(n=len(part) * len(own))

    for most in (None, 0):
        got = keyed.by_model(rows, model, ["key"], work, "key bigint, id bigint, m bigint, n bigint", most, 2000)
        assert got.agg(F.max("n"), F.count(F.lit(1)), F.count_distinct("id", "m")).first()[:] == (2000, 200_000, 200_000)


def test_searches_are_in_portions(spark, monkeypatch):
    """All three passes of vectors over a bank's cells, small portions with the same result."""
    r = np.random.default_rng(2)
    vectors = lambda n: spark.createDataFrame([(0, i, r.normal(size=4).tolist()) for i in range(n)], "key int, vec_id int, features array<double>")
    bank, queries = vectors(300), vectors(200)
    seen = []
    monkeypatch.setattr(ve, "MET", 100)
    monkeypatch.setattr(ve, "by_model", lambda *a, **k: seen.append(k.get("cells")) or keyed.by_model(*a, **k))
    got = ve.nearest_pruned(queries, bank, ["key"], ["vec_id"], cell=8)[0].toPandas().set_index("vec_id").score
    want = ve.nearest(queries, bank, ["key"], ["vec_id"]).toPandas().set_index("vec_id").score
    assert seen == [100] * 3 and np.allclose(got.sort_index(), want.sort_index())
