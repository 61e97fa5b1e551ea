"""Normalisation of branch scores and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.operators.evaluation import running
from oddlens.sources.shared import beside

ITEM = ["item_id", "category", "split", "defect_type", "label"]
EPS = 1e-8


def zscore(scores: DataFrame, keys: list[str], ddof: int = 1) -> DataFrame:
    """scores with z, by the mean and standard deviation of validation good rows of each group, or of all its rows where there are none.

    ddof 0 takes the population deviation, 1 the sample deviation; a constant or single row gives z 0.
    """
    std = F.stddev_samp if ddof else F.stddev_pop
    v = F.when((F.col("split") == "validation") & (F.col("defect_type") == "good"), F.col("score"))
    stats = scores.groupBy(*keys).agg(F.avg(v).alias("_mv"), std(v).alias("_sv"), F.avg("score").alias("_ma"), std("score").alias("_sa"))
    has = F.col("_mv").isNotNull()
    stats = stats.select(*keys, F.when(has, F.col("_mv")).otherwise(F.col("_ma")).alias("_m"), F.coalesce(F.when(has, F.col("_sv")).otherwise(F.col("_sa")), F.lit(0.0)).alias("_s"))
    return scores.join(beside(stats), keys).withColumn("z", (F.col("score") - F.col("_m")) / (F.col("_s") + EPS)).drop("_m", "_s")


def rank_percent(scores: DataFrame, keys: list[str]) -> DataFrame:
    """scores with pct: rank / n with average ranks on ties. Ranks come from counts of distinct scores, not from one sorted task."""
    n = scores.where("score is not null").groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"))
    r = running(n, keys, "score", ["n"])
    r = r.select(*keys, "score", ((F.col("before_n") + (F.col("n") + 1) / 2.0) / F.col("all_n")).alias("pct"))
    return scores.join(beside(r), [*keys, "score"])  # a row of r a score: a score that many rows share is split as a skewed join


def branch_matrix(scores: DataFrame, methods: list[str], value: str = "score") -> DataFrame:
    """A row for each item that every method scored, a column for each method: one aggregation instead of a chain of joins."""
    wide = scores.groupBy(*ITEM).pivot("method", methods).agg(F.first(value))
    return wide.dropna(subset=methods)


def fused(scores: DataFrame, methods: list[str], keys: list[str], ddof: int = 1, weights: dict[str, float] | None = None) -> DataFrame:
    """Long rows (method, item, score) of mean, max, rank and weighted fusion over items that every method scored."""
    s = scores.where(F.col("method").isin(methods))
    z = zscore(s, keys, ddof).where("split in ('validation', 'test')")
    d = rank_percent(z, keys)
    w = weights or dict.fromkeys(methods, 1.0)
    total = sum(w.values())
    weight = F.element_at(F.create_map(*[F.lit(x) for m in methods for x in (m, w[m] / total)]), F.col("method"))
    one = d.groupBy(*ITEM).agg(F.avg("z").alias("fusion_mean"), F.max("z").alias("fusion_max"), F.avg("pct").alias("fusion_rank"), F.sum(F.col("z") * weight).alias("fusion_weighted"), F.count(F.lit(1)).alias("_n"))
    names = ["fusion_mean", "fusion_max", "fusion_rank", "fusion_weighted"]
    return one.where(F.col("_n") == len(methods)).drop("_n").unpivot(ITEM, names, "method", "score").select("method", *ITEM, "score")
