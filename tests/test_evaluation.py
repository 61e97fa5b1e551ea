"""Hand-made cases of the evaluation, fusion and table operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlens.operators import evaluation as ev
from oddlens.operators import fusion as fu
from oddlens.operators import grids as gr
from oddlens.operators import models as mo
from oddlens.operators import tables as tb
from oddlens.operators import vectors as ve
from oddlens.sources import files


def scored(spark, scores, labels, method="m"):
    return spark.createDataFrame([(method, float(s), int(y)) for s, y in zip(scores, labels, strict=True)], "method string, score double, label int")


def test_auroc_ties_and_one_class(spark):
    assert ev.auroc(scored(spark, [1, 2, 2, 3], [0, 0, 1, 1]), ["method"]).first()["auroc"] == 0.875
    assert ev.auroc(scored(spark, [1, 2], [0, 0]), ["method"]).first()["auroc"] is None


def test_auroc_of_negated_scores(spark):
    rng = np.random.default_rng(0)
    s, y = np.round(rng.normal(size=300), 1), rng.integers(0, 2, 300)
    up, down = (ev.auroc(scored(spark, k * s, y), ["method"]).first()["auroc"] for k in (1, -1))
    assert up == pytest.approx(1 - down)
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert up == pytest.approx(np.mean(pairs))


def naive_sweep(s, y):
    best = None
    lo, hi = s.min(), s.max()
    for i in range(200):
        t = hi if i == 199 else lo + i * ((hi - lo) / 199.0)
        p = s >= t
        tp, fp, fn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
        f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
        if best is None or f1 > best[0]:
            best = (f1, t)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_f1_sweep(spark, seed):
    rng = np.random.default_rng(seed)
    s, y = rng.normal(size=200), rng.integers(0, 2, 200)
    got = ev.f1_sweep(scored(spark, s, y), ["method"]).first()
    assert (got["f1_max"], got["f1_threshold"]) == pytest.approx(naive_sweep(s, y))


@pytest.mark.parametrize("q", [0.0, 0.37, 0.9, 1.0])
def test_quantile(spark, q):
    rng = np.random.default_rng(6)
    s = np.round(rng.normal(size=157), 1)
    got = ev.quantile(scored(spark, s, s * 0), ["method"], "score", q, "t").first()["t"]
    assert got == pytest.approx(np.quantile(s, q))


def test_f1_all_equal(spark):
    got = ev.f1_sweep(scored(spark, [2, 2, 2], [0, 1, 1]), ["method"]).first()
    assert got["recall_at_f1"] == 1 and got["f1_threshold"] == 2


def test_missing_threshold_predicts_nothing(spark):
    rows = [("m", "a", "test", "good", 0, 1.0), ("m", "a", "test", "logical_anomalies", 1, 9.0)]
    s = spark.createDataFrame(rows, "method string, category string, split string, defect_type string, label int, score double")
    got = ev.at_threshold(s, ev.operating_threshold(s)).where("anomaly_type = 'overall'").first()
    assert got["f1"] == 0 and got["val_threshold"] is None


def test_rank_percent(spark):
    s = spark.createDataFrame([("m", i, float(x)) for i, x in enumerate([1, 2, 2, 3])], "method string, item_id int, score double")
    assert [r["pct"] for r in fu.rank_percent(s, ["method"]).orderBy("item_id").collect()] == [0.25, 0.625, 0.625, 1]


def test_constant_branch_is_finite(spark):
    rows = [("m", i, "a", "validation", "good", 0, 5.0) for i in range(3)]
    s = spark.createDataFrame(rows, "method string, item_id int, category string, split string, defect_type string, label int, score double")
    assert {r["z"] for r in fu.zscore(s, ["method"]).collect()} == {0.0}


def test_test_rows_do_not_move_the_fit(spark):
    rows = [("m", i, "a", "validation" if i < 5 else "test", "good", 0, float(i)) for i in range(9)]
    s = spark.createDataFrame(rows, "method string, item_id int, category string, split string, defect_type string, label int, score double")
    moved = s.withColumn("score", F.when(F.col("split") == "test", F.col("score") * 100).otherwise(F.col("score")))
    z = [[r["z"] for r in fu.zscore(d, ["method"]).where("split = 'validation'").orderBy("item_id").collect()] for d in (s, moved)]
    assert z[0] == z[1]
    assert ev.operating_threshold(s).collect() == ev.operating_threshold(moved).collect()


def test_top_fraction(spark):
    d = spark.createDataFrame([(1, float(x)) for x in range(101)] + [(2, 1.0), (2, 3.0), (2, None)], "item int, s double")
    got = {r["item"]: r for r in tb.top_fraction(d, "item", "s", {"a": 0.05, "m": "mean"}).collect()}
    assert got[1]["a"] == np.mean([100, 99, 98, 97, 96, 95]) and got[2]["a"] == 3 and got[2]["m"] == 2
    with pytest.raises(ValueError):
        tb.top_fraction(d, "item", "s", {"a": "median"})


def test_missing_content_does_not_leak(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "x", "a"), (4, "x", "b")], "id int, text string, split string")
    assert [r["leak"] for r in tb.leaks(d, "id", "text", "split").orderBy("id").collect()] == [False, False, True, True]


def test_mode_and_rounding(spark):
    assert spark.createDataFrame([(1,), (1,), (3,), (3,)], "x int").agg(F.mode("x", True)).first()[0] == 1
    g = gr.letterbox(F.lit(5), F.lit(1), 2)
    assert spark.range(1).select(g["resized_h"]).first()[0] == 0  # 0.4
    g = gr.letterbox(F.lit(4), F.lit(5), 10)
    assert spark.range(1).select(g["pad_left"], g["pad_right"]).first() == (1, 1)


def test_histogram_top_edge_and_region_edge(spark):
    h = spark.range(1).select(gr.histogram(F.array(F.lit(1.0), F.lit(0.0)), 32).alias("h")).first()["h"]
    assert h[31] == 16 and h[0] == 16 and sum(h) == 32
    assert spark.range(1).select(ve.region(F.lit(7), F.lit(7), 8, 8, 3)).first()[0] == 8


def test_diagonal_cells_are_two_parts(spark):
    d = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 0, 1), (2, 1, 1)], "item_id int, i int, j int")
    assert {r["item_id"]: r["n_parts"] for r in mo.connected_parts(d).collect()} == {1: 2, 2: 1}


def test_nearest_and_blocks_agree(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 3 else "b", i, rng.normal(size=5).tolist()) for i in range(90)]
    d = spark.createDataFrame(rows, "category string, vec_id long, features array<double>")
    q, b = d.where("vec_id < 40"), d.where("vec_id >= 40")
    for k in (1, 3, 500):
        one = {r["vec_id"]: r["score"] for r in ve.nearest(q, b, ["category"], ["vec_id"], k).collect()}
        two = {r["vec_id"]: r["score"] for r in ve.nearest_blocks(q, b, ["category"], ["vec_id"], k, block=7).collect()}
        assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i], abs=1e-6) for i in one)
    own = ve.nearest_blocks(b, b, ["category"], ["vec_id"]).agg(F.max("score")).first()[0]
    assert own == pytest.approx(0, abs=1e-9)
    lone = ve.nearest_blocks(q, b.where("category = 'a'"), ["category"], ["vec_id"]).where("category = 'b'")
    assert {r["score"] for r in lone.collect()} == {None}


def test_mahalanobis_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.dirichlet(np.ones(4), 30)
    d = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "category string, item_id long, hist array<double>")
    got = {r["item_id"]: r["score"] for r in mo.mahalanobis(d, d, ["category"]).collect()}
    inv, c = np.linalg.pinv(np.cov(x.T) + 1e-5 * np.eye(4)), x - x.mean(0)
    want = np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", c, inv, c)))
    assert [got[i] for i in range(30)] == pytest.approx(want.tolist())


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(200, 3)), [[9, 9, 9]]])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, features array<double>")
    got = mo.isolation_forest(d, d, "features", "vec_id", n_trees=20, sample=64).orderBy(F.desc("score")).first()
    assert got["vec_id"] == 200 and got["score"] > 0.6


def test_vocabulary_lowers_the_error(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.1, (30, 2)) for m in (0, 3, 6)])
    d = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "category string, vec_id long, features array<double>")
    error = []
    for rounds in (0, 6):
        c = np.array([r["centre"] for r in mo.vocabulary(d, ["category"], 3, rounds).collect()])
        error.append((((x[:, None] - c) ** 2).sum(2).min(1)).mean())
    assert error[1] <= error[0] and len(c) == 3


def test_reduction_keeps_distances_at_full_rank(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, features array<double>")
    got = np.array([r["features"] for r in mo.reduced(d, d, 3).orderBy("vec_id").collect()])
    c = x - x.mean(0)
    c /= np.linalg.norm(c, axis=1)[:, None]
    assert got @ got.T == pytest.approx(c @ c.T, abs=1e-9)


def test_backends(spark):
    d = spark.createDataFrame([([0.0] * 64,)], "grid array<double>")
    with pytest.raises(ValueError):
        ve.features_from(d, "dino", "grid")
    assert ve.features_from(d, "array_column", "grid").first()["feature_backend"] == "array_column"


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.png").write_bytes(b"123")
    (tmp_path / "a" / "y.txt").write_bytes(b"1")
    got = files.file_scan(spark, str(tmp_path)).collect()
    assert [r["length"] for r in got] == [3]
    assert files.optional_csv(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    files.publish(spark.createDataFrame([(1, "x")], "a int, m string"), str(tmp_path / "out"), "csv", ["m"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize("cells_of_a_task", [20_000, 170])
def test_connected_parts_of_long_ways(spark, cells_of_a_task, monkeypatch):
    """A spiral of over 200 cells is one part, and so are cells given twice; a far cell is another."""
    from oddlens.operators.models import connected_parts

    monkeypatch.setattr(mo, "CELLS", cells_of_a_task)
    at, step, cells, seen = (0, 0), (0, 1), [], set()
    for length in range(28, 0, -2):
        for _ in range(2):
            for _ in range(length):
                cells.append(at)
                at = (at[0] + step[0], at[1] + step[1])
            step = (step[1], -step[0])
        seen |= set(cells)
    rows = [(1, i, j) for i, j in cells[:240]] + [(1, *cells[0]), (2, 0, 0), (2, 5, 5)] + [(3, 0, j) for j in range(150)]
    got = {r["item_id"]: r["n_parts"] for r in connected_parts(spark.createDataFrame(rows, "item_id int, i int, j int")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
