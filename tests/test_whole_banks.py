"""Memory banks of more vectors a category than the short SQL takes, against brute force."""

import numpy as np
import pytest

from oddlens.operators import vectors as ve
from oddlens.plans import fixtures as fx
from oddlens.plans import registry
from oddlens.plans import vector_queries as vq


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("many")
    x = np.random.default_rng(1).normal(size=(1000, 40)).astype(float)
    spark.createDataFrame([(i, i * 7 % 5, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, label int, embedding array<double>").write.parquet(f"{out}/embeddings.parquet")
    return str(out)


def by_force(p, k, same):
    out = {}
    for q in p[p.split != "train"].itertuples():
        for keys in same:
            b = p[(p.split == "train") & np.logical_and.reduce([p[c] == getattr(q, c) for c in keys])]
            if len(b):
                break
        d = np.sort(np.sqrt(((np.stack(b.features) - np.array(q.features)) ** 2).sum(1)))
        out[q.vec_id] = d[:k].mean()
    return out


def test_whole_banks(spark, many):
    p = fx.item_patches(spark, many).toPandas()
    p["region"] = p.i.clip(upper=1) * 2 + p.j.clip(upper=1)
    item = p.set_index("vec_id").item_id
    run = lambda name: registry.QUERIES[name](spark, many).toPandas()
    one, three, regions = by_force(p, 1, [["category"]]), by_force(p, 3, [["category"]]), by_force(p, 1, [["category", "region"], ["category"]])
    near = lambda got, want: got == {k: pytest.approx(v, abs=2e-5) for k, v in want.items()}
    assert near(run("m1_nearest_whole").set_index("vec_id").score.to_dict(), one)
    assert near(run("m2_knn_blocks_whole").set_index("vec_id").score.to_dict(), three)
    for name, scores in (("m3_patch_memory_whole", three), ("m4_region_memory_whole", regions)):
        top = {i: max(scores[v] for v in g.index) for i, g in item.loc[list(scores)].to_frame().groupby("item_id")}  # 5 % of few patches is one
        assert near(run(name).set_index("item_id").score.to_dict(), top)
    test = p[p.split == "test"]
    assert near(run("j9_nearest_in_key_whole").set_index("category").mean_score.to_dict(), {c: np.mean([one[v] for v in g.vec_id]) for c, g in test.groupby("category")})
    assert run("e15_efficiency_whole").set_index("category").memory_bank_size.to_dict() == p[p.split == "train"].groupby("category").size().to_dict()


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def auroc(z, y):
    a, g = z[y == 1], z[y == 0]
    return np.mean((a[:, None] > g) + 0.5 * (a[:, None] == g)) if len(a) and len(g) else None


def test_pca_study(spark, many):
    """Axes, validation z and AUROC of each category, against NumPy."""
    p = fx.item_patches(spark, many).toPandas()
    want = {}
    for c, own in p.groupby("category"):
        bank = np.stack(own[own.split == "train"].features)
        mean = bank.mean(0)
        _, _, v = np.linalg.svd(bank - mean, full_matrices=False)
        for k in (8, 16, 32, 40):
            turn = (lambda x: unit(x)) if k == 40 else (lambda x, k=k: unit((x - mean) @ v[:k].T))
            score, b = {}, turn(bank)
            for i, rows in own[own.split != "train"].groupby("item_id"):
                d = np.sqrt(((turn(np.stack(rows.features))[:, None] - b) ** 2).sum(2)).min(1)
                top = np.sort(d)[-max(1, int(0.01 * len(d))) :].mean()
                score[i] = (rows.split.iloc[0], rows.label.iloc[0], top)
            val = np.array([s for w, _, s in score.values() if w == "validation"])
            test = [(y, (s - val.mean()) / (val.std() + 1e-8)) for w, y, s in score.values() if w == "test"]
            want[c, k] = auroc(np.array([z for _, z in test]), np.array([y for y, _ in test]))
    own = registry.QUERIES["m11_pca_categories"](spark, many).toPandas()
    assert {(r.category, r.dims): r.auroc for r in own.itertuples()} == pytest.approx(want)
    got = registry.QUERIES["m11_pca_study"](spark, many).toPandas().set_index("dims")
    mean = {k: np.mean([a for (_, d), a in want.items() if d == k]) for k in (8, 16, 32, 40)}
    assert got.mean_auroc.to_dict() == pytest.approx(mean) and set(got.n_categories) == {5}
    assert got.pct_of_full.to_dict() == pytest.approx({k: 100 * a / mean[40] for k, a in mean.items()})


def test_pca_variance(spark, many):
    p = fx.item_patches(spark, many).where("split = 'train'").toPandas()
    got = registry.QUERIES["m11_pca_variance"](spark, many).toPandas().sort_values("dims")
    for c, own in p.groupby("category"):
        share = np.sort(np.linalg.eigvalsh(np.cov(np.stack(own.features).T)))[::-1]
        share = share / share.sum()
        g = got[got.category == c]
        assert g.share.to_list() == pytest.approx(share.tolist(), abs=1e-9)
        for name, q in (("is_dims_90", 0.9), ("is_dims_95", 0.95)):
            assert g[g[name]].dims.to_list() == [int(np.searchsorted(np.cumsum(share), q) + 1)]


def test_fitted_histograms(spark, many):
    p = fx.item_patches(spark, many).toPandas()
    h = vq._fitted_hist(spark, many).toPandas()
    assert sorted(h.item_id) == sorted(set(p.item_id)) and {len(x) for x in h["hist"]} == {vq.N_WORDS}
    n = p.groupby("item_id").size()
    assert all(sum(x) == pytest.approx(1) and np.allclose(np.array(x) * n[i], np.round(np.array(x) * n[i])) for i, x in zip(h.item_id, h["hist"], strict=True))
