"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlens.llm import periodic

DOCS = "doc_id bigint, text string"


def runs_by_force(w):
    out = []
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and w[end] == w[end + q]:
                end += 1
            length = end - i + q
            s = w[i : i + length]
            if length >= max(6, 4 * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = end
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = runs_by_force(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def odd_words(seed, n):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        unit = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31]))]
        times = rng.randint(1, 6)
        out += (unit * times)[: rng.randint(1, len(unit) * times)]
    return out[:n]


@pytest.mark.parametrize("seed", range(40))
def test_find_runs(seed):
    texts = [odd_words(seed * 100 + k, n) for k, n in enumerate([0, 1, 4, 5, 6, 7, 60, 150, 300, 9])]
    _, runs, _ = periodic._portion([" ".join(t) for t in texts])
    assert runs == [runs_by_force(t) for t in texts]


def test_periodic_query(spark, tmp_path):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(odd_words(i, 80))) for i in range(60)] + [(i, " ".join(f"w{k}" for k in range(n))) for n, i in enumerate(ids)]
    rows += [(None, "a " * 30), (None, None), (ids[0], None), (ids[1], " \t\n"), (ids[2], ""), (7, "A a A a A a Ü ü"), (7, "A a A a A a Ü ü"), (8, "x " * 25_000 + "y\x0bz " * 9), (9, "x\x00 " * 6)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("runs", "n_words", "collapsed", "start", "_b"):
        df = df.withColumn(c, F.lit(c))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op13_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted([(i, *expected(i, t)) for i, t in rows], key=key)


def test_portions_and_empty(spark, monkeypatch):
    monkeypatch.setattr(periodic, "PORTION", 50)
    rows = [(i, " ".join(odd_words(i, 40))) for i in range(30)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.periodic_runs(df).collect()}
    assert got == {i: runs_by_force(t.split()) for i, t in rows}
    assert periodic.periodic_runs(df.limit(0)).collect() == []
    assert np.array(periodic.find_runs(np.empty(0, np.int64))).size == 0
