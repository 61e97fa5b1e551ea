"""Banks of more vectors than the reference's caps: a query lies on the vector that each cap would drop first."""

import hashlib
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from oddlens.operators import vectors as ve
from oddlens.plans import registry

#: 1002 times 200 ids have 100 training vectors each, 100,200 in all; they lie on an arc, STEP apart.
IDS, RADIUS = 1002 * 200, 1000.0
TRAIN = [i for i in range(IDS) if i // 20 % 10 < 5]
STEP = 5.5 / len(TRAIN)
VALIDATION, GOOD, ANOMALY, FAR = 100, 140, 160, 380


@pytest.fixture(scope="module")
def arc(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("arc")
    at = {v: k for k, v in enumerate(TRAIN)}
    order = sorted(TRAIN, key=lambda v: hashlib.md5(f"{v}#0".encode()).hexdigest())
    where = {v: float(k) for v, k in at.items()} | {GOOD: at[order[-1]], ANOMALY: at[order[0]] + 0.3, VALIDATION: at[order[1]] + 0.2, FAR: len(TRAIN) + 999}
    x = ((v, 0, [RADIUS * float(np.cos(k * STEP)), RADIUS * float(np.sin(k * STEP))]) for v, k in where.items())
    spark.createDataFrame(list(x), "vec_id bigint, label int, embedding array<double>").write.parquet(f"{out}/embeddings.parquet")
    return str(out)


def test_nearest_in_key(spark, arc):
    got = registry.QUERIES["j9_nearest_in_key_whole"](spark, arc).collect()
    assert [(r["category"], r["n"]) for r in got] == [("cat0", 3)]
    assert got[0]["mean_score"] == pytest.approx((0.3 * STEP + 2 * np.sin(1000 * STEP / 2)) * RADIUS / 3, abs=1.1e-5)


def test_one_bank_over_all(spark, arc):
    got = {r["item_id"]: r["score"] for r in registry.QUERIES["m3_global_memory"](spark, arc).collect()}
    want = {VALIDATION: 0.2 * STEP, GOOD: 0.0, ANOMALY: 0.3 * STEP, FAR: 2 * np.sin(1000 * STEP / 2)}
    assert got == pytest.approx({v // 20 * 5: x * RADIUS for v, x in want.items()}, abs=1.1e-5)


def test_dimension_study(spark, arc):
    """The good item lies on a vector of the bank, an anomaly beside one; without the former the order of these two turns."""
    got = registry.QUERIES["m11_axis_study"](spark, arc).collect()
    assert [r.asDict() for r in got] == [{"dims": 2, "mean_auroc": 1.0, "n_categories": 1, "pct_of_full": 100.0}]


def test_distances_between_pivots_of_many_cells():
    """They grow with the cells, not with their square."""
    x = np.random.default_rng(3).normal(size=(6000, 8))
    pivots, mine = pd.Series(list(x)), np.arange(5000, 5016)
    tracemalloc.start()
    d = ve._apart(pivots, mine)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6  # all to all would be 288 MB
    assert np.allclose(d, np.sqrt(((x[mine][:, None] - x[None]) ** 2).sum(2))) and (d[np.arange(16), mine] == 0).all()
    assert np.allclose(ve._apart(pivots[:100], np.array([3])), np.sqrt(((x[3] - x[:100]) ** 2).sum(1)))
