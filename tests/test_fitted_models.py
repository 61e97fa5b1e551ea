"""Sums that merge, searches that leave cells out, fitted words, forests and probes against NumPy, with models at hand and joined by key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlens.operators import keyed
from oddlens.operators import models as mo
from oddlens.operators import moments as mm
from oddlens.operators import vectors as ve
from oddlens.sources.shared import written

VECTORS = "category string, vec_id bigint, features array<double>"


@pytest.fixture(params=[64_000_000, 0], ids=["at hand", "joined"])
def model_bytes(request, monkeypatch):
    """The size up to which a model goes with the function; rows are cut into many parts beyond it."""
    monkeypatch.setattr(keyed, "MODEL_BYTES", request.param)
    if not request.param:
        monkeypatch.setattr(keyed, "PART_ROWS", 40)


def clusters(seed, n, dim=6, centres=20, spread=0.05):
    rng = np.random.default_rng(seed)
    at = np.random.default_rng(0).normal(size=(centres, dim)) * 10
    return at[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread


def frame(spark, x, keys=("a",), first=0):
    rows = [(keys[i % len(keys)], first + i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, VECTORS).repartition(5)


@pytest.mark.parametrize("keys", [["category"], []])
@pytest.mark.parametrize("k", [1, 3])
def test_pruned_search(spark, model_bytes, keys, k):
    bank, q = clusters(1, 900), np.vstack([clusters(2, 150), np.random.default_rng(3).normal(size=(30, 6)) * 10])
    bank[:300] = bank[0]  # a third of the bank is one vector
    b, qs = frame(spark, bank, "ab"), frame(spark, q, "ab", 5000).unionByName(frame(spark, q[:2], "z", 9000))
    s, report = ve.nearest_pruned(qs, b, keys, ["vec_id"], k, cell=32)
    got = {r["vec_id"]: r["score"] for r in s.collect()}
    d = np.sqrt(((q[:, None] - bank) ** 2).sum(2))
    for i in range(len(q)):
        own = d[i] if not keys else d[i, i % 2 :: 2]
        assert got[5000 + i] == pytest.approx(np.sort(own)[:k].mean(), abs=1e-9)
    assert len(got) == len(q) + 2 and (got[9000] is None) == bool(keys)
    r = report.agg(F.sum("n_pairs"), F.sum("n_compared"), F.sum("n_bank")).first()
    assert r[2] == 900 and 0 < r[1] < 0.6 * r[0]  # far clusters are left out


def test_search_with_few_and_equal_vectors(spark):
    b = frame(spark, np.zeros((1, 3)), "ab").unionByName(frame(spark, np.ones((7, 3)), "b", 10))
    s, _ = ve.nearest_pruned(frame(spark, np.array([[0.0, 0, 0], [2.0, 1, 1]]), "ab", 100), b, ["category"], ["vec_id"], 3)
    assert {r["vec_id"]: r["score"] for r in s.collect()} == {100: 0.0, 101: 1.0}
    s, report = ve.nearest_pruned(frame(spark, np.ones((2, 3))), b.limit(0), ["category"], ["vec_id"])
    assert {r["score"] for r in s.collect()} == {None} and report.collect() == []


def test_comoments_and_axes(spark, model_bytes):
    x = np.random.default_rng(0).normal(size=(301, 5)) @ np.random.default_rng(1).normal(size=(5, 5)) + 1e3
    d = frame(spark, x, "abc").unionByName(frame(spark, x[:1], "z", 900)).unionByName(spark.createDataFrame([(None, 1, [1.0] * 5), ("a", 2, None)], VECTORS))
    got = {r["category"]: r for r in mm.comoments(d, ["category"], "features").collect()}
    assert set(got) == set("abcz")
    for k, own in enumerate("abc"):
        y = x[k::3]
        r = got[own]
        assert r["n"] == len(y) and r["mean"] == pytest.approx(y.mean(0).tolist())
        assert np.array(r["m2"]).reshape(5, 5) / (len(y) - 1) == pytest.approx(np.cov(y.T), abs=1e-8)
    axes = mm.principal_axes(d, ["category"], "features")
    turned = {r["vec_id"]: r["features"] for r in mm.rotated(d.where("features is not null"), axes, ["category"], "features", [2]).where("category = 'b'").collect()}
    y = x[1::3]
    c = y - y.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    z = np.abs(c @ v[:2].T)
    z = z / np.linalg.norm(z, axis=1, keepdims=True)
    assert np.abs(np.array([turned[1 + 3 * i][:2] for i in range(len(y))])) == pytest.approx(z, abs=1e-6)
    fit = mm.inverse_covariances(d, ["category"], "features")
    dist = {r["vec_id"]: r["score"] for r in mm.mahalanobis(d.where("category = 'a' and features is not null"), fit, ["category"], "features").collect()}
    y = x[::3]
    inv = np.linalg.pinv(np.cov(y.T) + 1e-5 * np.eye(5))
    want = np.sqrt(np.einsum("ij,jk,ik->i", y - y.mean(0), inv, y - y.mean(0)))
    assert [dist[3 * i] for i in range(len(y))] == pytest.approx(want.tolist(), rel=1e-6)


def test_vocabulary_finds_the_clusters(spark, model_bytes):
    x = clusters(4, 400, 3, 6, 0.05)
    x[:140] = x[0]
    d = frame(spark, x, "ab").unionByName(frame(spark, x[:3] * 0 + np.arange(3)[:, None], "c", 900))
    words = written(mo.vocabulary(d, ["category"], 6))
    got = {c: np.stack(w.centre) for c, w in words.toPandas().groupby("category")}
    assert len(got["c"]) == 3
    for k, c in enumerate("ab"):
        y = x[k::2]
        assert len(got[c]) == 6 and np.sqrt(((y[:, None] - got[c]) ** 2).sum(2)).min(1).mean() < 0.3
    near = {r["vec_id"]: r["word"] for r in ve.nearest_word(d, words, ["category"], ["vec_id"]).collect()}
    order = words.toPandas().sort_values("word")
    for i in range(0, 400, 37):
        c = np.stack(order[order.category == "ab"[i % 2]].centre)
        assert near[i] == ((c - x[i]) ** 2).sum(1).argmin()
    step = mo.lloyd_step(d, words, ["category"]).toPandas().sort_values("word")
    y, c = x[::2], np.stack(order[order.category == "a"].centre)
    at = ((y[:, None] - c) ** 2).sum(2).argmin(1)
    want = np.stack([y[at == w].mean(0) if (at == w).any() else c[w] for w in range(6)])
    assert np.stack(step[step.category == "a"].centre) == pytest.approx(want)


def test_forest_draws_bounded_samples(spark):
    x = np.random.default_rng(5).normal(size=(4000, 3))
    d = frame(spark, x)
    forest = mo.fit_forest(d, "features", "vec_id", 10, 32).collect()
    assert sorted(r["tree"] for r in forest) == list(range(10)) and {r["n"] for r in forest} == {32}
    again = mo.fit_forest(d.repartition(3), "features", "vec_id", 10, 32).collect()
    assert sorted(map(str, forest)) == sorted(map(str, again))
    assert len({str(r["c"]) for r in forest}) == 10
    few = mo.fit_forest(d.limit(5), "features", "vec_id", 3, 32).collect()
    assert {r["n"] for r in few} == {5}


def test_probe(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for item, n in enumerate([1, 2, 6, 9, 9, 25]):
        x = rng.normal(size=(n, 5)) if item != 3 else np.tile([1.0, 2, 3, 4, 5], (n, 1))
        c = x - x.mean(0)
        _, _, v = np.linalg.svd(c, full_matrices=False)
        v = v[:3] * np.sign(v[:3][np.arange(min(3, len(v))), np.abs(v[:3]).argmax(1)])[:, None]
        y = c @ v.T
        rgb = np.zeros((n, 3))
        rgb[:, : y.shape[1]] = (y - y.min(0)) / (np.ptp(y, axis=0) + 1e-8)
        want[item] = (rgb, y[:, 0] > np.quantile(y[:, 0], 0.75), x)
        rows += [(item, k, k // 5, k % 5, v.tolist()) for k, v in enumerate(x)]
    cells = mo.probe(spark.createDataFrame(rows, "item_id bigint, patch_idx int, i int, j int, features array<double>").repartition(4))
    got = cells.toPandas().sort_values(["item_id", "patch_idx"])
    for item, own in got.groupby("item_id"):
        rgb, on, x = want[item]
        if item != 3:
            assert np.stack(own.rgb) == pytest.approx(rgb, abs=1e-6) and own.foreground.tolist() == on.tolist()
        w = own.word.to_numpy()
        centre = np.stack([x[w == k].mean(0) for k in np.unique(w)])
        near = ((x[:, None] - centre) ** 2).sum(2)
        assert (near[np.arange(len(x)), np.searchsorted(np.unique(w), w)] <= near.min(1) + 1e-9).all()  # settled
        assert len(np.unique(w)) == (1 if item == 3 else min(4, len(x)))
    n = {r["item_id"]: (r["n_cells"], r["n_words"]) for r in mo.probe_counts(cells).collect()}
    assert n == {0: (1, 1), 1: (2, 2), 2: (6, 4), 3: (9, 1), 4: (9, 4), 5: (25, 4)}


def test_region_banks_are_known_before_the_search(spark):
    rows = [("a", 0, i, [float(i)]) for i in range(4)] + [("b", 1, 9, [0.0])]
    train = spark.createDataFrame(rows, "category string, region int, vec_id bigint, features array<double>")
    q = spark.createDataFrame([("a", 0, 100, [0.0]), ("a", 5, 101, [0.0]), ("b", 1, 102, [0.0])], train.schema)
    to, bank = ve.region_banks(q, train, ["category"], 2, 3)
    assert {r["vec_id"]: r["bank"] for r in to.collect()} == {100: 0, 101: -1, 102: 1}
    n = {(r["category"], r["bank"]): r["count"] for r in bank.groupBy("category", "bank").count().collect()}
    assert n == {("a", 0): 2, ("a", -1): 3, ("b", 1): 1}  # b needs no bank of all regions
