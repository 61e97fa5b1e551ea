"""Hard negatives and their tree against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlens.llm import hard_negatives as hn

ROWS = "vec_id bigint, label int, embedding array<float>"


def by_force(rows):
    own = []
    for i, y, v in dict.fromkeys((i, y, None if v is None else tuple(v)) for i, y, v in rows):
        if i is None or y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]))
    out = []
    for i, y, a in own:
        if i % 50:
            continue
        s = [(sum(p * q for p, q in zip(a, v, strict=False)), j, z) for j, z, v in own]
        pos = sorted((-p, j) for p, j, z in s if z == y and j != i)[:5]
        for p, j in pos:
            neg = sorted((-n, k) for n, k, z in s if z != y and 50 * -p <= 100 * n <= 95 * -p)[:3]
            out += [(i, j, r, k, -p, -n) for r, (n, k) in enumerate(neg, 1)]
    return sorted(out)


def odd_rows(seed, n=1200, dim=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[: n // 3] = x[0]  # a third of all rows are one vector
    x[n // 3 : n // 2] = np.round(x[n // 3 : n // 2])  # ties
    x[-50:] *= 0.01
    rows = [(i, int(i * 7 % 5), v.tolist()) for i, v in enumerate(x)]
    rows += [(None, 1, [1.0] * dim), (5000, None, [1.0] * dim), (5050, 2, None), (5100, 3, []), (5150, 1, [1.0, None]), (5200, 1, [float("nan")] * dim), (5250, 1, [float("inf")] * dim), (5300, 1, [0.5, 0.5])]
    return [*rows, *rows[:20], (50, 3, [2.0] * dim), (-50, 1, [0.3] * dim)]


@pytest.mark.parametrize(("seed", "limits"), [(0, {}), (1, {"SAMPLE": 100, "LEAF": 8, "ARITY": 4, "GROUP_ROWS": 90, "LEAST_GROUP": 1, "PART": 7, "CHUNK": 5, "BLOCK": 16})])
def test_hard_negatives(spark, tmp_path, seed, limits, monkeypatch):
    for k, v in limits.items():
        monkeypatch.setattr(hn, k, v)
    if limits:
        monkeypatch.setattr(hn.Tree.__init__, "__defaults__", (limits["ARITY"], limits["LEAF"]))
    rows = odd_rows(seed)
    df = spark.createDataFrame(rows, ROWS)
    for c in ("id", "vec", "leaf", "grp", "low", "akey", "rank"):
        df = df.withColumn(c, F.lit(c))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, hn.op11_hard_negatives(spark, str(tmp_path)).collect()))
    want = by_force(rows)
    assert len(want) > 50 and got == want


def test_large_numbers_and_empty(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, (rng.normal(size=4) * 4e5).tolist()) for i in range(300)]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert sorted(map(tuple, hn.op11_hard_negatives(spark, f"{tmp_path}/a").collect())) == by_force(rows)
    spark.createDataFrame(rows, ROWS).limit(0).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert hn.op11_hard_negatives(spark, f"{tmp_path}/b").collect() == []
    spark.createDataFrame(rows[1:], ROWS).where("vec_id % 50 != 0").write.parquet(f"{tmp_path}/c/embeddings.parquet")
    assert hn.op11_hard_negatives(spark, f"{tmp_path}/c").collect() == []


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_tree_visits_all_leaves_that_hold_answers_and_not_more(spread):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8)) * 100
    x = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 8)) * 100 * spread)
    tree = hn.Tree(x[:1000], 8, 16)
    leaf = tree.leaves(x, True)
    a = x[::100]
    s = a @ x.T
    low = np.sort(s, 1)[:, -20:-19]
    high = np.full_like(low, np.inf)
    seen = tree.visited(a, low, high)
    for i in range(len(a)):
        assert seen[i, leaf[s[i] >= low[i]]].all()
    mid = np.median(s, 1)[:, None]
    between = tree.visited(a, np.hstack([low, mid]), np.hstack([high, mid * 1.001 + 1]))
    assert (between >= seen).all() and between[np.arange(len(a))[:, None], leaf[None]][(s >= mid) & (s <= mid * 1.001 + 1)].all()
    if spread < 1:
        assert seen.mean() < 0.5  # clusters are far apart, so most leaves are eliminated
