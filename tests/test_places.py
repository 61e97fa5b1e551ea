"""Quantiles and middle rows by running counts, with ties, constant and missing scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlens.operators import evaluation as ev
from oddlens.operators import tables as tb


def test_quantiles(spark):
    groups = {"ties": [1.0, 2.0, 2.0, 2.0, 9.0, None], "one": [3.0], "same": [5.0] * 7, "wide": [float(x) for x in np.random.default_rng(0).normal(size=101)], "none": [None]}
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, x double")
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["k"]: [r[n] for n in qs] for r in ev.quantiles(df, ["k"], "x", qs).collect()}
    want = {k: pytest.approx(np.quantile([x for x in xs if x is not None], list(qs.values())).tolist()) for k, xs in groups.items() if k != "none"}
    assert got == want
    d = {r["k"]: r.asDict() for r in tb.describe(df, ["k"], "x").collect()}
    assert d["none"]["count"] == 0 and d["none"]["p50"] is None and d["ties"]["p50"] == 2.0


def test_representatives(spark):
    rng = np.random.default_rng(3)
    rows = [(i, c, d, float(rng.integers(0, 4))) for i, (c, d) in enumerate((c, d) for c in "ab" for d in ("good", "logical_anomalies", "structural_anomalies") for _ in range(int(rng.integers(1, 30))))]
    want = set()
    for c, d in {r[1:3] for r in rows}:
        own = sorted((r for r in rows if r[1:3] == (c, d)), key=lambda r: (r[3] if d == "good" else -r[3], r[0]))
        want.add((c, d, own[0 if d == "good" else len(own) // 2][0]))
    df = spark.createDataFrame([*rows, (999, "a", "good", None)], "item_id long, category string, defect_type string, score double")
    assert {(r["category"], r["defect_type"], r["item_id"]) for r in tb.representatives(df).collect()} == want
    assert tb.representatives(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [10**6, 0])
def test_running_sums_in_ranges_of_equal_counts(spark, few, monkeypatch):
    """Outliers do not gather the other scores in one range, and a key of most rows has most of the ranges."""
    monkeypatch.setattr(ev, "FEW", few)
    monkeypatch.setattr(ev, "RANGE_ROWS", 250)
    rng = np.random.default_rng(0)
    x = np.unique(np.append(rng.normal(size=9000), [1e12, -1e12]))
    rows = [("hot", float(v), i % 3) for i, v in enumerate(x)] + [("cold", float(v), 1) for v in range(40)]
    seen, merged = [], ev.beside
    monkeypatch.setattr(ev, "beside", lambda d: (seen.append(d.count()), merged(d))[1])
    r = ev.running(spark.createDataFrame(rows, "k string, s double, n bigint"), ["k"], "s", ["n"]).toPandas()
    for key, own in r.groupby("k"):
        own = own.sort_values("s")
        assert own.before_n.tolist() == (own.n.cumsum() - own.n).tolist() and set(own.all_n) == {own.n.sum()}
        assert len(own) == (len(x) if key == "hot" else 40)
    if not few:
        ranges = spark.createDataFrame(rows, "k string, s double, n bigint").repartitionByRange(37, "k", "s").groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert ranges.max() <= 4 * ranges.median() and 30 <= seen[0] <= 40
