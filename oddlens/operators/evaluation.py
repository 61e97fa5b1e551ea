"""Detection quality: AUROC, F1 sweeps, operating thresholds, confusion, ablation and selection.

Undefined values are null: AUROC with one class, F1 of nothing, thresholds without validation rows. Null scores are
left out. Slices overlap: good rows count in logical, structural and overall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddlens.sources.shared import beside, written

STEPS = 200
SLICES = {"logical": "logical_anomalies", "structural": "structural_anomalies"}
#: Up to so many distinct scores of all slices, a slice is summed in one sorted window; beyond, ranges hold about so many each.
FEW, RANGE_ROWS = 200_000, 100_000


def with_slices(df: DataFrame, defect: str = "defect_type") -> DataFrame:
    """A row for each slice that a row belongs to: anomaly_type is logical, structural or overall."""
    own = F.when(F.col(defect) == "good", F.array(*map(F.lit, (*SLICES, "overall"))))
    for name, kind in SLICES.items():
        own = own.when(F.col(defect) == kind, F.array(F.lit(name), F.lit("overall")))
    return df.withColumn("anomaly_type", F.explode(own.otherwise(F.array(F.lit("overall")))))


def running(df: DataFrame, keys: list[str], by: str, sums: list[str]) -> DataFrame:
    """df (keys, by, sums; one row for each keys and by): with before_x, the sum of x over rows of smaller `by`, and all_x, that of all rows of the keys.

    Few rows are one window a key. Many are cut into ranges of equal counts by Spark's range partitioning of (keys, by), whatever the
    scores' distribution; sums run over the ranges and within each of them. df is written first, so that it is computed once.
    """
    d, whole = written(df, "running"), W.partitionBy(*keys)
    inside = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    n = d.count()
    if n <= FEW:
        return d.withColumns({f"before_{x}": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums} | {f"all_{x}": F.sum(x).over(whole) for x in sums})
    d = written(d.repartitionByRange(n // RANGE_ROWS + 1, *keys, by).withColumn("_range", F.spark_partition_id()), "ranges")
    part = d.groupBy(*keys, "_range").agg(*[F.sum(x).alias(f"_s_{x}") for x in sums])
    over = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    part = part.select(*keys, "_range", *[F.coalesce(F.sum(f"_s_{x}").over(over), F.lit(0)).alias(f"_b_{x}") for x in sums], *[F.sum(f"_s_{x}").over(whole).alias(f"all_{x}") for x in sums])
    inside = W.partitionBy(*keys, "_range").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    d = d.join(beside(part), [*keys, "_range"])
    return d.withColumns({f"before_{x}": F.col(f"_b_{x}") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums}).drop("_range", *[f"_b_{x}" for x in sums])


def auroc(df: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Exact AUROC with ties: the share of (anomaly, good) pairs in right order, ties half. Rows: keys, n_good, n_anomaly, auroc."""
    by_score = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(label).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    r = running(by_score, keys, score, ["neg"])
    out = r.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("_u"))
    value = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n")))
    return out.select(*keys, F.col("_n").cast("long").alias("n_good"), F.col("_p").cast("long").alias("n_anomaly"), value.alias("auroc"))


def _rates(tp: Column, fp: Column, pos: Column) -> dict[str, Column]:
    return {
        "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)),
        "recall": F.when(pos > 0, tp / pos).otherwise(F.lit(0.0)),
        "f1": F.when(2 * tp + fp + (pos - tp) > 0, 2 * tp / (2 * tp + fp + (pos - tp))).otherwise(F.lit(0.0)),
    }


def f1_sweep(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", steps: int = STEPS) -> DataFrame:
    """The best F1 over `steps` evenly spaced thresholds, the first on ties. An upper bound: it is chosen on the labels.

    A score is predicted positive by the thresholds up to its own place in the grid, so one count for each place is
    enough; scores and thresholds are never joined.
    """
    d = df.where(F.col(score).isNotNull())
    edge = beside(d.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi")))
    d = d.join(edge, keys)
    step = (F.col("_hi") - F.col("_lo")) / float(steps - 1)
    at = lambda i: F.when(i >= steps - 1, F.col("_hi")).otherwise(F.col("_lo") + i * step)
    guess = F.when(step > 0, F.least(F.lit(steps - 1), F.floor((F.col(score) - F.col("_lo")) / step))).otherwise(F.lit(steps - 1)).cast("int")
    d = d.withColumn("_g", guess)
    up, own = (F.col("_g") < steps - 1) & (at(F.col("_g") + 1) <= F.col(score)), at(F.col("_g")) <= F.col(score)
    d = d.withColumn("_i", F.when(up, F.col("_g") + 1).when(own, F.col("_g")).otherwise(F.col("_g") - 1))
    n = d.groupBy(*keys, "_i").agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    # the grid has a row for every threshold
    grid = edge.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_i"), "_lo", "_hi")
    n = grid.join(n.drop("_lo", "_hi").hint("merge"), [*keys, "_i"], "left")
    down = W.partitionBy(*keys).orderBy(F.col("_i").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    tp, fp = F.coalesce(F.sum("p").over(down), F.lit(0)), F.coalesce(F.sum("q").over(down), F.lit(0))
    n = n.withColumns({"tp": tp, "fp": fp, "pos": F.coalesce(F.sum("p").over(W.partitionBy(*keys)), F.lit(0)), "t": at(F.col("_i"))})
    n = n.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("pos")))
    best = n.groupBy(*keys).agg(F.max_by(F.struct("f1", "t", "precision", "recall"), F.struct("f1", -F.col("_i"))).alias("b"))
    return best.select(*keys, F.col("b.f1").alias("f1_max"), F.col("b.t").alias("f1_threshold"), F.col("b.precision").alias("precision_at_f1"), F.col("b.recall").alias("recall_at_f1"))


def per_category(scores: DataFrame) -> DataFrame:
    """Test rows by method, category and anomaly type: counts, AUROC and the F1 sweep."""
    keys = ["method", "category", "anomaly_type"]
    s = with_slices(scores.where("split = 'test'"))
    return auroc(s, keys).join(f1_sweep(s, keys).hint("merge"), keys)  # a row a slice


def macro(metrics: DataFrame, value: str = "auroc") -> DataFrame:
    """Mean over categories by method and anomaly type; null categories are skipped."""
    return metrics.groupBy("method", "anomaly_type").agg(F.avg(value).alias(f"mean_{value}"), F.count_distinct("category").alias("n_categories"))


def summary(metrics: DataFrame, runtime: DataFrame) -> DataFrame:
    """Means over categories of AUROC and best F1 by method and anomaly type, with the method's mean latency and summed bank size.

    runtime: method, category, time_ms_per_image, memory_bank_size; methods without runtime rows have nulls there.
    """
    m = metrics.groupBy("method", "anomaly_type").agg(F.avg("auroc").alias("mean_auroc"), F.avg("f1_max").alias("mean_f1_max"), F.count_distinct("category").alias("n_categories"))
    r = runtime.groupBy("method").agg(F.avg("time_ms_per_image").alias("mean_time_ms_per_image"), F.sum("memory_bank_size").alias("memory_bank_size"))
    return m.join(beside(r), "method", "left")


def leaderboard(metrics: DataFrame, value: str = "auroc") -> DataFrame:
    """A row for each method: macro means as columns logical, overall and structural; mean_auroc is the mean of logical and structural."""
    m = macro(metrics, value).groupBy("method").pivot("anomaly_type", ["logical", "overall", "structural"]).agg(F.first(f"mean_{value}"))
    return m.withColumn(f"mean_{value}", (F.col("logical") + F.col("structural")) / 2)


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """The exact quantiles (linear) of each group by name, from running counts of distinct values; no task holds a group."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    r = running(n, keys, value, ["n"])
    holds = lambda place: (F.col("before_n") <= place) & (F.col("before_n") + F.col("n") > place)
    out = []
    for name, q in qs.items():
        at = (F.col("all_n") - 1) * F.lit(q)
        lo, hi = F.max(F.when(holds(F.floor(at)), F.col(value))), F.max(F.when(holds(F.ceil(at)), F.col(value)))
        out.append((lo + (hi - lo) * F.max(at - F.floor(at))).alias(name))
    return r.groupBy(*keys).agg(*out)


def quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    return quantiles(df, keys, value, {name: q})


def operating_threshold(scores: DataFrame, q: float = 0.9) -> DataFrame:
    """The q quantile of validation good scores by method and category."""
    return quantile(scores.where("split = 'validation' and defect_type = 'good'"), ["method", "category"], "score", q, "val_threshold")


def at_threshold(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """F1, precision and recall of test slices at the validation threshold; a missing threshold predicts nothing."""
    t = with_slices(scores.where("split = 'test'")).join(beside(thresholds), ["method", "category"], "left")
    hit = F.coalesce(F.col("score") >= F.col("val_threshold"), F.lit(False))
    n = t.groupBy("method", "category", "anomaly_type").agg(
        F.sum(1 - F.col("label")).alias("n_good"), F.sum("label").alias("n_anomaly"), F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.first("val_threshold").alias("val_threshold")
    )
    return n.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("n_anomaly"))).drop("tp", "fp")


def confusion(scores: DataFrame) -> DataFrame:
    """Test rows with TP, TN, FP or FN at the F1 threshold of the method's whole test set."""
    t = scores.where("split = 'test' and score is not null")
    d = t.join(beside(f1_sweep(t, ["method"]).select("method", "f1_threshold")), "method")
    hit, bad = F.col("score") >= F.col("f1_threshold"), F.col("label") == 1
    return d.withColumn("outcome", F.when(hit & bad, "TP").when(hit, "FP").when(bad, "FN").otherwise("TN"))


def decisions(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Test rows with threshold, prediction and whether it is right; scores and thresholds rounded to 4."""
    d = scores.where("split = 'test'").join(beside(thresholds), ["method", "category"], "left")
    pred = F.coalesce(F.col("score") >= F.col("val_threshold"), F.lit(False)).cast("int")
    return d.select("method", "item_id", "category", "label", pred.alias("pred"), (pred == F.col("label")).alias("correct"), F.round("score", 4).alias("score"), F.round("val_threshold", 4).alias("threshold"))


def subsets(methods: DataFrame, sets: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean fusion of each named set of methods, for all sets in one aggregation. sets: model, method. Items that lack a method of a set are left out."""
    need = sets.groupBy("model").agg(F.count(F.lit(1)).alias("_need"))
    fused = scores.join(beside(sets), "method").groupBy("model", *keys).agg(F.avg("score").alias("score"), F.count("score").alias("_n"))
    return fused.join(beside(need), "model").where("_n = _need").drop("_n", "_need")


def leave_one_out(metrics: DataFrame, base: Column) -> DataFrame:
    """importance_delta: the score of all branches less the score without the branch, both rounded to 4 first."""
    return metrics.withColumn("importance_delta", F.round(F.round(base, 4) - F.round("without", 4), 4))
