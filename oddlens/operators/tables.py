"""Sampling, deduplication, pivots, top fractions and cases over item tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddlens.operators.evaluation import quantiles, running
from oddlens.sources.shared import beside, written


def draw_order(key: Column, seed: int) -> Column:
    """A pseudo-random order that any engine reproduces: md5 of key and seed."""
    return F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed))))


def capped_sample(df: DataFrame, key: str, cap: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """At most cap rows, or cap rows for each group of `by`: exactly the first in md5 order.

    The order is cut before it is sorted: a row can only be among the first if its md5 prefix is among the least
    prefixes that hold cap rows, so each task sorts few more than cap rows.
    """
    by = by or []
    d = df.withColumn("_h", draw_order(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, 3))
    n = d.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = n.withColumn("_b", before).where(F.col("_b") < cap).groupBy(*by).agg(F.max("_p").alias("_last"))
    if by:
        d = d.join(last, by)
    else:
        d = d.join(F.broadcast(last))  # one row
    rn = F.row_number().over(W.partitionBy(*by).orderBy("_h", key))
    return d.where("_p <= _last").withColumn("_rn", rn).where(F.col("_rn") <= cap).drop("_h", "_p", "_last", "_rn")


def head(df: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    """The first n rows of each group in order of key. Groups are cut within tasks first, by the n least keys of each."""
    rn = F.row_number().over(W.partitionBy(*by).orderBy(key))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def top_fraction(patches: DataFrame, item: str, score: str, modes: dict[str, float | str], floor: bool = False) -> DataFrame:
    """A row for each item: for each name the mean of its top fraction of patch scores (at least one; ceil, or floor), `max` or `mean`.

    Unknown modes raise ValueError. Items without scores are not in the result.
    """
    for m in modes.values():
        if not isinstance(m, float) and m not in ("max", "mean"):
            raise ValueError(f"unknown aggregation {m!r}")
    bag = patches.where(F.col(score).isNotNull()).groupBy(item).agg(F.sort_array(F.collect_list(score), False).alias("_s"))
    size = F.size("_s")
    out = []
    for name, m in modes.items():
        if m == "max":
            out.append(F.get("_s", F.lit(0)).alias(name))
            continue
        k = size if m == "mean" else F.greatest(F.lit(1), (F.floor if floor else F.ceil)(size * F.lit(m)).cast("int"))
        part = F.slice("_s", F.lit(1), k)
        out.append((F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)).alias(name))
    return bag.select(item, *out)


def leaks(df: DataFrame, key: str, content: str, split: str) -> DataFrame:
    """df with its content's md5 and whether that occurs in more than one split; null content leaks nowhere."""
    d = df.withColumn("md5", F.md5(content))
    bad = d.where("md5 is not null").groupBy("md5").agg(F.min(split).alias("_lo"), F.max(split).alias("_hi")).where("_lo != _hi").select(F.col("md5").alias("_m"))
    return d.join(bad, d["md5"] == bad["_m"], "left").withColumn("leak", F.col("_m").isNotNull()).drop("_m")


def average_hash(grid: Column) -> Column:
    """16 hex digits of a 64-cell grid: bit set where a cell is at least the mean, row by row."""
    mean = F.aggregate(grid, F.lit(0.0), lambda a, x: a + x) / F.size(grid)
    nibble = lambda n: F.hex(sum(((F.get(grid, n * 4 + k) >= mean).cast("int") * (8 >> k) for k in range(4)), F.lit(0)))
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), nibble), ""))


def near_hashes(hashes: DataFrame, radius: int = 3, bucket: int = 256) -> DataFrame:
    """Pairs (hash_a, hash_b, distance) of different hashes (16 hex digits, each once) that differ in at most `radius` of 64 bits, hash_a the lesser.

    Two such hashes agree in one of radius + 1 bands of their bits, so hashes meet in the buckets of equal bands. A bucket of more than
    `bucket` hashes is not compared: as its hashes differ in the remaining bits only, it is cut again into the buckets of radius + 1 bands of
    those, and so on, until every bucket is small or no bits remain.
    """
    bits = F.lpad(F.conv("hash", 16, 2), 64, "0")
    open_ = hashes.select("hash", bits.alias("rest"), F.lit("").alias("key"))
    n, pairs = F.lit(radius + 1), []
    for _ in range(64):
        cut = open_.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("b"))
        lo, hi = (F.floor(F.length("rest") * (F.col("b") + x) / n).cast("int") for x in (0, 1))
        band = F.substring(F.col("rest"), lo + 1, hi - lo)
        rest = F.concat(F.substring(F.col("rest"), F.lit(1), lo), F.substring(F.col("rest"), hi + 1, F.length("rest") - hi))
        cut = written(cut.select("hash", rest.alias("rest"), F.concat("key", F.lit("/"), F.col("b").cast("string"), F.lit(":"), band).alias("key")), "bands")
        size = written(cut.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "buckets")
        few = cut.join(size.where(F.col("_n") <= bucket).hint("merge"), "key").select("key", "hash")
        d = few.withColumnRenamed("hash", "hash_a").join(few.withColumnRenamed("hash", "hash_b").hint("merge"), "key").where("hash_a < hash_b")
        number = lambda c: F.conv(c, 16, -10).cast("bigint")
        d = d.withColumn("distance", F.bit_count(number("hash_a").bitwiseXOR(number("hash_b")))).where(F.col("distance") <= radius)
        pairs.append(d.select("hash_a", "hash_b", "distance"))
        large = size.where(F.col("_n") > bucket)
        if large.isEmpty():
            break
        open_ = cut.join(large.select("key").hint("merge"), "key")
    return reduce(DataFrame.unionByName, pairs).distinct()


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, std (n - 1), min, quartiles (linear) and max by group."""
    qs = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    d = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return d.join(beside(quantiles(df, by, value, qs)), by, "left").select(*by, "count", "mean", "std", "min", *qs, "max")


def representatives(scores: DataFrame) -> DataFrame:
    """A row for each category and defect: the lowest good score, else the middle one from the top, the least item on ties.

    Running counts of distinct scores give the score that holds the wanted place; only its rows are ordered. Rows
    without a score, category or defect take no part.
    """
    by = ["category", "defect_type"]
    d = scores.where("score is not null").withColumn("_key", F.when(F.col("defect_type") == "good", F.col("score")).otherwise(-F.col("score")))
    n = d.groupBy(*by, "_key").agg(F.count(F.lit(1)).alias("n"))
    r = running(n, by, "_key", ["n"])
    want = F.when(F.col("defect_type") == "good", F.lit(0)).otherwise(F.floor(F.col("all_n") / 2)) - F.col("before_n")
    at = r.withColumn("_place", want).where((F.col("_place") >= 0) & (F.col("_place") < F.col("n"))).select(*by, "_key", "_place")
    rn = F.row_number().over(W.partitionBy(*by).orderBy("item_id")) - 1
    return d.join(beside(at), [*by, "_key"]).withColumn("_rn", rn).where(F.col("_rn") == F.col("_place")).drop("_key", "_place", "_rn")


def parsed_path(path: Column) -> dict[str, Column]:
    """Parts of an item path category/split/defect/name.ext or of a mask path category/ground_truth/defect/sample/name.ext."""
    part = F.split(path, "/")
    n = F.size(part)
    mask = F.get(part, F.lit(1)) == "ground_truth"
    stem = F.regexp_replace(F.element_at(part, -1), r"\.[^.]*$", "")
    defect = F.get(part, F.lit(2))
    return {
        "category": F.get(part, F.lit(0)), "split": F.get(part, F.lit(1)), "defect_type": defect,
        "sample_id": F.when(mask, F.get(part, F.lit(3))).otherwise(stem), "is_mask": F.coalesce(mask, F.lit(False)),
        "kind": F.when(mask, "mask").otherwise("product"), "label": F.when(n > 2, (defect != "good").cast("int")),
        "anomaly_group": F.regexp_replace(defect, "_anomalies$", ""),
    }
