"""Queries of thresholds, metrics, normalisation, fusion, ablation and selection."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddlens.operators import evaluation as ev
from oddlens.operators import fusion as fu
from oddlens.plans import fixtures as fx
from oddlens.plans.registry import query

METHODS = list(fx.METHODS)


def r6(*cols: str) -> list:
    """Rounded to 6; the nudge keeps exact halves, such as ratios of counts have, from falling either way."""
    return [F.round(F.col(c) + 1e-9, 6).alias(c) for c in cols]


SLICED = """
test AS (SELECT * FROM event_scores WHERE split = 'test' AND score IS NOT NULL),
sliced AS (SELECT *, unnest(CASE WHEN defect_type = 'good' THEN ['logical', 'structural', 'overall'] WHEN defect_type = 'logical_anomalies' THEN ['logical', 'overall'] ELSE ['structural', 'overall'] END) AS anomaly_type FROM test)
"""
AUROC = """
ranked AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0::DOUBLE AS r FROM {t}),
auc AS (SELECT {k}, count(*) FILTER (WHERE label = 0) AS n_good, count(*) FILTER (WHERE label = 1) AS n_anomaly,
  CASE WHEN count(*) FILTER (WHERE label = 0) > 0 AND count(*) FILTER (WHERE label = 1) > 0 THEN
  (sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE label = 1)::DOUBLE * count(*) FILTER (WHERE label = 0)) END AS auroc FROM ranked GROUP BY {k})
"""
SWEEP = """
edge AS (SELECT {k}, min(score) AS lo, max(score) AS hi, sum(label) AS pos FROM {t} GROUP BY {k}),
thr AS (SELECT *, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199.0::DOUBLE) END AS t FROM edge, range(200) AS u(i)),
cnt AS (SELECT {kt}, i, t, any_value(pos) AS pos, count(*) FILTER (WHERE score >= t AND label = 1) AS tp, count(*) FILTER (WHERE score >= t AND label = 0) AS fp FROM thr JOIN {t} AS s USING ({k}) GROUP BY {kt}, i, t),
f AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS p, CASE WHEN pos > 0 THEN tp / pos::DOUBLE ELSE 0.0 END AS r, CASE WHEN tp + fp + pos > 0 THEN 2 * tp / (tp + fp + pos)::DOUBLE ELSE 0.0 END AS f1 FROM cnt),
best AS (SELECT {k}, f1 AS f1_max, t AS f1_threshold, p AS precision_at_f1, r AS recall_at_f1 FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY f1 DESC, i) AS rn FROM f) WHERE rn = 1)
"""
K3 = "method, category, anomaly_type"
PER = f"WITH {SLICED.strip()}, {AUROC.format(k=K3, t='sliced').strip()}"


def _scores(spark, sf):
    return fx.event_scores(spark, sf)


@query("e1_auroc", fx.sql(PER + f" SELECT {K3}, n_good, n_anomaly, round(auroc + 1e-9, 6) AS auroc FROM auc"))
def e1_auroc(spark, sf):
    s = ev.with_slices(_scores(spark, sf).where("split = 'test'"))
    return ev.auroc(s, ["method", "category", "anomaly_type"]).select("method", "category", "anomaly_type", "n_good", "n_anomaly", *r6("auroc"))


@query("e2_f1_sweep", fx.sql(f"WITH {SLICED.strip()}, {SWEEP.format(k=K3, kt=K3, t='sliced').strip()} SELECT {K3}, round(f1_max + 1e-9, 6) AS f1_max, round(f1_threshold + 1e-9, 6) AS f1_threshold, round(precision_at_f1 + 1e-9, 6) AS precision_at_f1, round(recall_at_f1 + 1e-9, 6) AS recall_at_f1 FROM best"))
def e2_f1_sweep(spark, sf):
    s = ev.with_slices(_scores(spark, sf).where("split = 'test'"))
    return ev.f1_sweep(s, ["method", "category", "anomaly_type"]).select("method", "category", "anomaly_type", *r6("f1_max", "f1_threshold", "precision_at_f1", "recall_at_f1"))


@query("e3_per_category_metrics", fx.sql(f"{PER}, {SWEEP.format(k=K3, kt=K3, t='sliced').strip()} SELECT {K3}, n_good, n_anomaly, round(auroc + 1e-9, 6) AS auroc, round(f1_max + 1e-9, 6) AS f1_max FROM auc JOIN best USING ({K3})"))
def e3_per_category_metrics(spark, sf):
    return ev.per_category(_scores(spark, sf)).select("method", "category", "anomaly_type", "n_good", "n_anomaly", *r6("auroc", "f1_max"))


THR = "thr4 AS (SELECT method, category, quantile_cont(score, 0.9) AS val_threshold FROM event_scores WHERE split = 'validation' AND defect_type = 'good' GROUP BY method, category)"
AT = """
n4 AS (SELECT method, category, anomaly_type, sum(1 - label)::BIGINT AS n_good, sum(label)::BIGINT AS n_anomaly, any_value(val_threshold) AS val_threshold,
  count(*) FILTER (WHERE score >= val_threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= val_threshold AND label = 0) AS fp FROM sliced LEFT JOIN thr4 USING (method, category) GROUP BY method, category, anomaly_type),
m4 AS (SELECT method, category, anomaly_type, n_good, n_anomaly, val_threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN n_anomaly > 0 THEN tp / n_anomaly::DOUBLE ELSE 0 END AS recall,
  CASE WHEN tp + fp + n_anomaly > 0 THEN 2 * tp / (tp + fp + n_anomaly)::DOUBLE ELSE 0 END AS f1 FROM n4)
"""


@query("e4_operating_threshold", fx.sql(f"WITH {SLICED.strip()}, {THR}, {AT.strip()} SELECT method, category, anomaly_type, n_good, n_anomaly, round(val_threshold + 1e-9, 6) AS val_threshold, round(precision + 1e-9, 6) AS precision, round(recall + 1e-9, 6) AS recall, round(f1 + 1e-9, 6) AS f1 FROM m4"))
def e4_operating_threshold(spark, sf):
    s = _scores(spark, sf)
    return ev.at_threshold(s, ev.operating_threshold(s)).select("method", "category", "anomaly_type", "n_good", "n_anomaly", *r6("val_threshold", "precision", "recall", "f1"))


CONF = f"WITH {SLICED.strip()}, {SWEEP.format(k='method', kt='method', t='test').strip()}, conf AS (SELECT test.*, CASE WHEN score >= f1_threshold THEN CASE WHEN label = 1 THEN 'TP' ELSE 'FP' END WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM test JOIN best USING (method))"


@query("e5_confusion", fx.sql(f"{CONF} SELECT method, outcome, count(*) AS n FROM conf GROUP BY method, outcome"))
def e5_confusion(spark, sf):
    return ev.confusion(_scores(spark, sf)).groupBy("method", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("w5_confusion_cases", fx.sql(f"{CONF} SELECT method, outcome, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY method, outcome ORDER BY item_id) AS rn FROM conf) WHERE rn <= 3"))
def w5_confusion_cases(spark, sf):
    c = ev.confusion(_scores(spark, sf))
    rn = F.row_number().over(W.partitionBy("method", "outcome").orderBy("item_id"))
    return c.withColumn("rn", rn).where("rn <= 3").select("method", "outcome", "item_id", "score")


@query("e6_decisions", fx.sql(f"WITH {THR} SELECT method, item_id, category, label, (score >= val_threshold)::INT AS pred, (score >= val_threshold)::INT = label AS correct, round(score, 4) AS score, round(val_threshold, 4) AS threshold FROM event_scores JOIN thr4 USING (method, category) WHERE split = 'test'"))
def e6_decisions(spark, sf):
    s = _scores(spark, sf)
    return ev.decisions(s, ev.operating_threshold(s))


BOARD = "macro AS (SELECT method, anomaly_type, avg(auroc) AS m, count(DISTINCT category) AS n_categories FROM auc GROUP BY method, anomaly_type)"
PIV = "piv AS (SELECT method, max(m) FILTER (WHERE anomaly_type = 'logical') AS logical, max(m) FILTER (WHERE anomaly_type = 'overall') AS overall, max(m) FILTER (WHERE anomaly_type = 'structural') AS structural FROM macro GROUP BY method)"


@query("a5_macro_average", fx.sql(f"{PER}, {BOARD} SELECT method, anomaly_type, round(m + 1e-9, 6) AS mean_auroc, n_categories FROM macro"))
def a5_macro_average(spark, sf):
    s = ev.with_slices(_scores(spark, sf).where("split = 'test'"))
    return ev.macro(ev.auroc(s, ["method", "category", "anomaly_type"])).select("method", "anomaly_type", *r6("mean_auroc"), "n_categories")


RUNTIME = "rt AS (SELECT method, category, count(*) / 1000.0::DOUBLE AS ms, count(*) FILTER (WHERE split = 'train') AS bank FROM event_scores GROUP BY method, category)"
SUMMARY = f"{PER}, {SWEEP.format(k=K3, kt=K3, t='sliced').strip()}, {RUNTIME}, m AS (SELECT method, anomaly_type, avg(auroc) AS a, avg(f1_max) AS f, count(DISTINCT category) AS n_categories FROM auc JOIN best USING ({K3}) GROUP BY method, anomaly_type), r AS (SELECT method, avg(ms) AS ms, sum(bank)::BIGINT AS bank FROM rt GROUP BY method)"


@query("a5_summary", fx.sql(f"{SUMMARY} SELECT method, anomaly_type, round(a + 1e-9, 6) AS mean_auroc, round(f + 1e-9, 6) AS mean_f1_max, n_categories, round(ms, 6) AS mean_time_ms_per_image, bank AS memory_bank_size FROM m LEFT JOIN r USING (method)"))
def a5_summary(spark, sf):
    """Means over categories with the mean latency and the summed bank size of each method; rows and training rows stand for both here."""
    s = _scores(spark, sf)
    runtime = s.groupBy("method", "category").agg((F.count(F.lit(1)) / 1000.0).alias("time_ms_per_image"), F.count_if(F.col("split") == "train").alias("memory_bank_size"))
    d = ev.summary(ev.per_category(s), runtime)
    return d.select("method", "anomaly_type", *r6("mean_auroc", "mean_f1_max"), "n_categories", F.round("mean_time_ms_per_image", 6).alias("mean_time_ms_per_image"), "memory_bank_size")


@query("a6_pivot_board", fx.sql(f"{PER}, {BOARD}, {PIV} SELECT method, round(logical + 1e-9, 6) AS logical, round(overall + 1e-9, 6) AS overall, round(structural + 1e-9, 6) AS structural, round((logical + structural) / 2 + 1e-9, 6) AS mean_auroc FROM piv"))
def a6_pivot_board(spark, sf):
    s = ev.with_slices(_scores(spark, sf).where("split = 'test'"))
    b = ev.leaderboard(ev.auroc(s, ["method", "category", "anomaly_type"]))
    return b.select("method", *r6("logical", "overall", "structural", "mean_auroc"))


ORDERS = """
bag AS (SELECT item_id, price, row_number() OVER (PARTITION BY item_id ORDER BY price DESC) AS rn, count(*) OVER (PARTITION BY item_id) AS n FROM order_patches),
top AS (SELECT item_id, avg(price) FILTER (WHERE rn <= greatest(1, ceil(n * 0.05::DOUBLE))) AS top5, max(price) AS mx, avg(price) AS mean FROM bag GROUP BY item_id),
os AS (SELECT m AS method, i.*, CASE m WHEN 'top5' THEN top5 WHEN 'max' THEN mx ELSE mean END AS score FROM order_items i LEFT JOIN top USING (item_id), unnest(['top5', 'max', 'mean']) AS u(m)),
test AS (SELECT * FROM os WHERE split = 'test' AND score IS NOT NULL),
sliced AS (SELECT *, unnest(CASE WHEN defect_type = 'good' THEN ['logical', 'structural', 'overall'] WHEN defect_type = 'logical_anomalies' THEN ['logical', 'overall'] ELSE ['structural', 'overall'] END) AS anomaly_type FROM test)
"""


def order_scores(spark, sf):
    """Orders scored by their patches in three ways; orders without patches have no score."""
    from oddlens.operators.tables import top_fraction

    top = top_fraction(fx.order_patches(spark, sf), "item_id", "price", {"top5": 0.05, "max": "max", "mean": "mean"})
    wide = fx.order_items(spark, sf).join(top, "item_id", "left")
    return wide.unpivot(["item_id", "category", "split", "defect_type", "label"], ["top5", "max", "mean"], "method", "score")


@query("auroc_leaderboard", fx.sql(f"WITH {ORDERS.strip()}, {AUROC.format(k=K3, t='sliced').strip()}, {BOARD}, {PIV} SELECT method, round(logical + 1e-9, 6) AS logical, round(overall + 1e-9, 6) AS overall, round(structural + 1e-9, 6) AS structural, round((logical + structural) / 2 + 1e-9, 6) AS mean_auroc FROM piv"))
def auroc_leaderboard(spark, sf):
    s = ev.with_slices(order_scores(spark, sf).where("split = 'test'"))
    b = ev.leaderboard(ev.auroc(s, ["method", "category", "anomaly_type"]))
    return b.select("method", *r6("logical", "overall", "structural", "mean_auroc"))


@query("a13_best_method", fx.sql(f"{PER}, {BOARD}, {PIV} SELECT anomaly_type, arg_max(method, (m, method)) AS method, round(max(m) + 1e-9, 6) AS mean_auroc FROM macro GROUP BY anomaly_type"))
def a13_best_method(spark, sf):
    s = ev.with_slices(_scores(spark, sf).where("split = 'test'"))
    m = ev.macro(ev.auroc(s, ["method", "category", "anomaly_type"]))
    return m.groupBy("anomaly_type").agg(F.max_by("method", F.struct("mean_auroc", "method")).alias("method"), F.round(F.max("mean_auroc") + 1e-9, 6).alias("mean_auroc"))


@query("a14_category_board", fx.sql(f"{PER} SELECT {K3}, round(auroc + 1e-9, 6) AS auroc, rank() OVER (PARTITION BY category, anomaly_type ORDER BY round(auroc + 1e-9, 6) DESC, method) AS place FROM auc"))
def a14_category_board(spark, sf):
    s = ev.with_slices(_scores(spark, sf).where("split = 'test'"))
    a = ev.auroc(s, ["method", "category", "anomaly_type"]).select("method", "category", "anomaly_type", *r6("auroc"))
    return a.withColumn("place", F.rank().over(W.partitionBy("category", "anomaly_type").orderBy(F.col("auroc").desc(), "method")).cast("long"))


Z2 = """
st AS (SELECT method, category, avg(score) FILTER (WHERE split = 'validation' AND defect_type = 'good') AS m, stddev_samp(score) FILTER (WHERE split = 'validation' AND defect_type = 'good') AS s FROM event_scores GROUP BY method, category),
zs AS (SELECT e.*, (score - m) / (coalesce(s, 0) + 1e-8) AS z FROM event_scores e JOIN st USING (method, category)),
pr AS (SELECT method, item_id, (rank() OVER (PARTITION BY method, category ORDER BY score) + (count(*) OVER (PARTITION BY method, category, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY method, category) AS pct FROM event_scores WHERE split IN ('validation', 'test')),
w(method, wt) AS (VALUES ('value', 0.5::DOUBLE), ('k', 0.3::DOUBLE), ('hour', 0.2::DOUBLE)),
one AS (SELECT item_id, category, split, defect_type, label, avg(z) AS fusion_mean, max(z) AS fusion_max, avg(pct) AS fusion_rank, sum(z * wt) AS fusion_weighted FROM zs JOIN pr USING (method, item_id) JOIN w USING (method) GROUP BY ALL HAVING count(*) = 3),
fl AS (SELECT m AS method, item_id, category, split, defect_type, label, CASE m WHEN 'fusion_mean' THEN fusion_mean WHEN 'fusion_max' THEN fusion_max WHEN 'fusion_rank' THEN fusion_rank ELSE fusion_weighted END AS score FROM one, unnest(['fusion_mean', 'fusion_max', 'fusion_rank', 'fusion_weighted']) AS u(m))
"""
WEIGHTS = {"value": 0.5, "k": 0.3, "hour": 0.2}


def _fused(spark, sf):
    return fu.fused(_scores(spark, sf), METHODS, ["method", "category"], 1, WEIGHTS)


@query("f1_global_zscore", fx.sql("WITH st AS (SELECT method, avg(score) FILTER (WHERE split = 'validation' AND defect_type = 'good') AS m, stddev_pop(score) FILTER (WHERE split = 'validation' AND defect_type = 'good') AS s FROM event_scores GROUP BY method) SELECT method, item_id, round((score - m) / (s + 1e-8), 5) AS z FROM event_scores JOIN st USING (method)"))
def f1_global_zscore(spark, sf):
    return fu.zscore(_scores(spark, sf), ["method"], 0).select("method", "item_id", F.round(F.col("z") + 1e-9, 5).alias("z"))


@query("f2_category_zscore", fx.sql(f"WITH {Z2.strip()} SELECT method, item_id, category, round(z + 1e-9, 5) AS z FROM zs"))
def f2_category_zscore(spark, sf):
    return fu.zscore(_scores(spark, sf), ["method", "category"], 1).select("method", "item_id", "category", F.round(F.col("z") + 1e-9, 5).alias("z"))


def _one_fusion(name):
    def f(spark, sf):
        return _fused(spark, sf).where(F.col("method") == name).select("item_id", "category", "split", F.round(F.col("score") + 1e-9, 5).alias("score"))

    return f


for _name, _id in (("fusion_mean", "f3_mean_fusion"), ("fusion_max", "f4_max_fusion"), ("fusion_rank", "f5_rank_fusion"), ("fusion_weighted", "f6_weighted_fusion")):
    query(_id, fx.sql(f"WITH {Z2.strip()} SELECT item_id, category, split, round({_name} + 1e-9, 5) AS score FROM one"))(_one_fusion(_name))


@query("f7_fusion_table", fx.sql(f"WITH {Z2.strip()} SELECT method, item_id, label, round(score + 1e-9, 5) AS score FROM fl"))
def f7_fusion_table(spark, sf):
    return _fused(spark, sf).select("method", "item_id", "label", F.round(F.col("score") + 1e-9, 5).alias("score"))


@query("w1_rank_percent", fx.sql("SELECT method, item_id, round((rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY method) + 1e-9, 6) AS pct FROM event_scores WHERE split IN ('validation', 'test')"))
def w1_rank_percent(spark, sf):
    return fu.rank_percent(_scores(spark, sf).where("split in ('validation', 'test')"), ["method"]).select("method", "item_id", *r6("pct"))


@query("j1_branch_matrix", fx.sql("SELECT item_id, category, value, k, hour FROM event_items WHERE value IS NOT NULL AND k IS NOT NULL"))
def j1_branch_matrix(spark, sf):
    return fu.branch_matrix(_scores(spark, sf), METHODS).select("item_id", "category", *METHODS)


def _slice_auroc(spark, sf, sets, scores=None):
    """Macro AUROC by model and slice of the mean fusion of each set of methods, for all sets at once."""
    z = fu.zscore(_scores(spark, sf) if scores is None else scores, ["method"], 0).withColumn("score", F.col("z"))
    rows = spark.createDataFrame([(m, x) for m, xs in sets.items() for x in xs], "model string, method string")
    s = ev.subsets(spark.createDataFrame([(m,) for m in METHODS], "method string"), rows, z.where("split = 'test'"), fu.ITEM)
    a = ev.auroc(ev.with_slices(s.withColumnRenamed("model", "method")), ["method", "category", "anomaly_type"])
    return ev.macro(a)


SETS = {"all": METHODS, "without value": ["k", "hour"], "without k": ["value", "hour"], "without hour": ["value", "k"], "value": ["value"], "k": ["k"], "hour": ["hour"]}


def lattice(sets: dict[str, list[str]], scores: str = "event_scores") -> str:
    rows = ", ".join(f"('{m}', '{x}')" for m, xs in sets.items() for x in xs)
    return f"""
st AS (SELECT method, avg(score) FILTER (WHERE split = 'validation' AND defect_type = 'good') AS m, stddev_pop(score) FILTER (WHERE split = 'validation' AND defect_type = 'good') AS s FROM {scores} GROUP BY method),
sets(model, method) AS (VALUES {rows}), need AS (SELECT model, count(*) AS n FROM sets GROUP BY model),
fs AS (SELECT model AS method, item_id, category, defect_type, label, avg((score - m) / (s + 1e-8)) AS score FROM {scores} JOIN st USING (method) JOIN sets USING (method) JOIN need USING (model) WHERE split = 'test' GROUP BY model, item_id, category, defect_type, label, n HAVING count(*) = n),
sliced AS (SELECT *, unnest(CASE WHEN defect_type = 'good' THEN ['logical', 'structural', 'overall'] WHEN defect_type = 'logical_anomalies' THEN ['logical', 'overall'] ELSE ['structural', 'overall'] END) AS anomaly_type FROM fs),
{AUROC.format(k=K3, t="sliced").strip()}, {BOARD}
"""


LATTICE = lattice(SETS)


@query("e7_single_branch", fx.sql(f"WITH {LATTICE.strip()} SELECT method, anomaly_type, round(m + 1e-9, 5) AS mean_auroc FROM macro WHERE method IN ('value', 'k', 'hour')"))
def e7_single_branch(spark, sf):
    return _slice_auroc(spark, sf, {m: [m] for m in METHODS}).select("method", "anomaly_type", F.round(F.col("mean_auroc") + 1e-9, 5).alias("mean_auroc"))


LOO = "b AS (SELECT round(m, 4) AS base FROM macro WHERE method = 'all' AND anomaly_type = 'overall'), loo AS (SELECT replace(method, 'without ', '') AS branch, round(m, 4) AS without_branch, round(base - round(m, 4), 4) AS importance_delta FROM macro, b WHERE method LIKE 'without %' AND anomaly_type = 'overall')"


def _loo(spark, sf):
    m = _slice_auroc(spark, sf, {k: v for k, v in SETS.items() if k == "all" or k.startswith("without")}).where("anomaly_type = 'overall'")
    base = m.where("method = 'all'").select(F.col("mean_auroc").alias("_base"))
    d = m.where("method != 'all'").join(F.broadcast(base)).withColumn("without", F.col("mean_auroc"))  # one row
    d = ev.leave_one_out(d, F.col("_base"))
    return d.select(F.replace("method", F.lit("without "), F.lit("")).alias("branch"), F.round("without", 4).alias("without_branch"), "importance_delta")


@query("e8_leave_one_out", fx.sql(f"WITH {LATTICE.strip()}, {LOO} SELECT * FROM loo"))
def e8_leave_one_out(spark, sf):
    return _loo(spark, sf)


@query("e9_selection", fx.sql(f"WITH {LATTICE.strip()}, {LOO} SELECT branch, importance_delta, importance_delta > 0 AS selected, importance_delta <= 0 AS harmful FROM loo"))
def e9_selection(spark, sf):
    return _loo(spark, sf).select("branch", "importance_delta", (F.col("importance_delta") > 0).alias("selected"), (F.col("importance_delta") <= 0).alias("harmful"))


@query("e10_subset_comparison", fx.sql(f"WITH {LATTICE.strip()}, {PIV} SELECT method AS model, round(logical, 4) AS logical, round(structural, 4) AS structural, round(overall, 4) AS overall FROM piv"))
def e10_subset_comparison(spark, sf):
    m = _slice_auroc(spark, sf, SETS).groupBy("method").pivot("anomaly_type", ["logical", "overall", "structural"]).agg(F.first("mean_auroc"))
    return m.select(F.col("method").alias("model"), *[F.round(c, 4).alias(c) for c in ("logical", "structural", "overall")])


@query("e11_duplicate_branches", fx.sql("WITH s AS (SELECT * FROM event_scores UNION ALL SELECT 'value copy', item_id, category, split, defect_type, label, value FROM event_items) SELECT a.method AS first, b.method AS second, max(abs(a.score - b.score)) = 0 AS duplicate FROM s a JOIN s b ON a.item_id = b.item_id AND a.method < b.method GROUP BY a.method, b.method"))
def e11_duplicate_branches(spark, sf):
    """Pairs of methods with their largest difference: one array of scores an item, so that items are not joined with themselves."""
    return _equal_branches(_with_copy(spark, sf))


def _with_copy(spark, sf):
    s = _scores(spark, sf)
    return s.unionAll(s.where("method = 'value'").withColumn("method", F.lit("value copy")))


def _equal_branches(s):
    item = s.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("method", "score"))).alias("x"))
    pairs = item.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b")).where("a.method < b.method")
    return pairs.groupBy(F.col("a.method").alias("first"), F.col("b.method").alias("second")).agg((F.max(F.abs(F.col("a.score") - F.col("b.score"))) == 0).alias("duplicate"))


BRANCHES, PROXY, STRONG = [*METHODS, "value copy"], "hour", 0.7
CHOICE = {"all": BRANCHES} | {f"without {b}": [x for x in BRANCHES if x != b] for b in BRANCHES} | {b: [b] for b in BRANCHES}
CHOICE_SQL = f"""
WITH branch_scores AS (SELECT * FROM event_scores UNION ALL SELECT 'value copy', item_id, category, split, defect_type, label, value FROM event_items),
{lattice(CHOICE, "branch_scores").strip()},
o AS (SELECT method, round(m, 4) AS m FROM macro WHERE anomaly_type = 'overall'),
dup AS (SELECT DISTINCT b.method AS branch FROM branch_scores a JOIN branch_scores b ON a.item_id = b.item_id AND a.method < b.method GROUP BY a.method, b.method HAVING max(abs(a.score - b.score)) = 0),
r AS (SELECT s.method AS branch, s.m AS single, w.m AS without_branch, round(a.m - w.m, 4) AS importance_delta, s.method IN (SELECT branch FROM dup) AS duplicate FROM o s JOIN o w ON w.method = 'without ' || s.method JOIN o a ON a.method = 'all')
SELECT *, NOT duplicate AND importance_delta > 0 AS selected, NOT duplicate AND importance_delta <= 0 AS harmful, NOT duplicate AND single >= {STRONG} AND branch <> '{PROXY}' AS strong,
  row_number() OVER (ORDER BY single DESC, branch) = 1 AS best_single FROM r
"""


@query("e9_branch_choice", fx.sql(CHOICE_SQL))
def e9_branch_choice(spark, sf):
    """The branches with a copy among them: the copy is dropped, branches that help are selected, strong ones reach STRONG alone and are no proxy."""
    s = _with_copy(spark, sf)
    m = _slice_auroc(spark, sf, CHOICE, s).where("anomaly_type = 'overall'").select("method", F.round("mean_auroc", 4).alias("m"))
    left_out = F.startswith("method", F.lit("without "))
    one = m.groupBy(F.replace("method", F.lit("without "), F.lit("")).alias("branch")).agg(F.max(F.when(~left_out, F.col("m"))).alias("single"), F.max(F.when(left_out, F.col("m"))).alias("without_branch"))
    # windows over the few rows of one, a row a branch
    one = one.withColumn("base", F.max(F.when(F.col("branch") == "all", F.col("single"))).over(W.partitionBy())).where("branch != 'all'")
    twin = _equal_branches(s).where("duplicate").select(F.col("second").alias("branch"), "duplicate").distinct()
    r = one.join(ev.beside(twin), "branch", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    r = r.withColumn("importance_delta", F.round(F.col("base") - F.col("without_branch"), 4)).drop("base")
    own = ~F.col("duplicate")
    return r.withColumns({
        "selected": own & (F.col("importance_delta") > 0), "harmful": own & (F.col("importance_delta") <= 0), "strong": own & (F.col("single") >= STRONG) & (F.col("branch") != PROXY),
        "best_single": F.row_number().over(W.partitionBy().orderBy(F.desc("single"), "branch")) == 1,
    })


@query("e12_backend_check", "SELECT event_type AS category, bool_and(starts_with(event_type, 'c')) AS all_expected, count(*) FILTER (WHERE NOT starts_with(event_type, 'c')) AS n_other FROM events GROUP BY event_type")
def e12_backend_check(spark, sf):
    """Whether every row of a group carries the expected backend prefix."""
    ok = F.startswith("event_type", F.lit("c"))
    return fx.table(spark, sf, "events").groupBy(F.col("event_type").alias("category")).agg(F.bool_and(ok).alias("all_expected"), F.count_if(~ok).alias("n_other"))


@query("e16_fusion_stats", fx.sql(f"WITH {Z2.strip()} SELECT method, category, defect_type, count(*) AS n, round(avg(score) + 1e-9, 5) AS mean, round(stddev_samp(score) + 1e-9, 5) AS std, round(min(score) + 1e-9, 5) AS lo, round(quantile_cont(score, 0.5) + 1e-9, 5) AS p50, round(max(score) + 1e-9, 5) AS hi FROM fl GROUP BY method, category, defect_type"))
def e16_fusion_stats(spark, sf):
    f, by = _fused(spark, sf), ["method", "category", "defect_type"]
    g = f.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    g = g.join(ev.beside(ev.quantile(f, by, "score", 0.5, "p50")), by, "left")
    return g.select(*by, "n", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("mean", "std", "lo", "p50", "hi")])
