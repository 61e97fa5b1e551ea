"""Queries of memory banks, vocabularies, grids and fitted models."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import functions as F

from oddlens.operators import evaluation as ev
from oddlens.operators import grids as gr
from oddlens.operators import models as mo
from oddlens.operators import moments as mm
from oddlens.operators import tables as tb
from oddlens.operators import vectors as ve
from oddlens.plans import fixtures as fx
from oddlens.plans.registry import query
from oddlens.sources.shared import beside, written

#: The reference's cap of a category's bank; regions share it, but for 1000 each at least.
CAP, LEAST_REGION = 100_000, 1000
BANK = f"bank AS (SELECT category, i, j, features FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(vec_id || '#0'), vec_id) AS rn FROM item_patches WHERE split = 'train') WHERE rn <= {CAP})"
WHOLE = "bank AS (SELECT category, i, j, features FROM item_patches WHERE split = 'train')"
DIST = "list_distance(q.features, b.features)"


def _bank(patches, keys=("category",), cap=CAP):
    """Normal training patches, capped by key; all of them without a cap."""
    train = patches.where("split = 'train'")
    return train if cap is None else tb.capped_sample(train, "vec_id", cap, 0, list(keys))


def _queries(patches):
    return patches.where("split != 'train'")


M1 = fx.sql(f"WITH {BANK} SELECT vec_id, category, round(min({DIST}), 5) AS score FROM item_patches q JOIN bank b USING (category) WHERE split <> 'train' GROUP BY vec_id, category")


def _search(p):
    return ve.nearest_pruned(_queries(p).select("category", "vec_id", "item_id", "features"), _bank(p), ["category"], ["vec_id", "item_id"])


@query("m1_nearest_whole", M1)
@query("m1_nearest", M1)
def m1_nearest(spark, sf):
    return _search(fx.item_patches(spark, sf))[0].select("vec_id", "category", F.round("score", 5).alias("score"))


@query("m1_search_report")
def m1_search_report(spark, sf):
    """How many of the pairs of queries and bank vectors were compared by category; the others were left out by distance bounds."""
    return _search(fx.item_patches(spark, sf))[1]


KNN = f"knn AS (SELECT vec_id, item_id, category, split, defect_type, label, avg(d) AS score FROM (SELECT q.*, {DIST} AS d, row_number() OVER (PARTITION BY vec_id ORDER BY {DIST}) AS rn FROM item_patches q JOIN bank b USING (category) WHERE split <> 'train') WHERE rn <= 3 GROUP BY ALL)"


M2 = fx.sql(f"WITH {BANK}, {KNN} SELECT vec_id, category, round(score, 5) AS score FROM knn")


@query("m2_knn_blocks_whole", M2)
@query("m2_knn_blocks", M2)
def m2_knn_blocks(spark, sf):
    p = fx.item_patches(spark, sf)
    return _scored(_queries(p), 3)(_bank(p)).select("vec_id", "category", F.round("score", 5).alias("score"))


COSINE = "sqrt(greatest(0.0::DOUBLE, 2 - 2 * list_dot_product(q.features, b.features) / (sqrt(list_dot_product(q.features, q.features)) * sqrt(list_dot_product(b.features, b.features)))))"


@query("m2_unit_knn", fx.sql(f"WITH d AS (SELECT q.vec_id, q.category, {COSINE} AS d FROM item_patches q JOIN item_patches b ON q.category = b.category AND b.split = 'train' WHERE q.split <> 'train') SELECT vec_id, category, round(avg(d), 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS rn FROM d) WHERE rn <= 3 GROUP BY vec_id, category"))
def m2_unit_knn(spark, sf):
    """Three nearest unit vectors of the whole bank of a category: sqrt(max(0, 2 - 2 cos)) is their Euclidean distance."""
    p = fx.item_patches(spark, sf).withColumn("features", ve.unit(F.col("features")))
    return _scored(_queries(p), 3)(_bank(p)).select("vec_id", "category", F.round("score", 5).alias("score"))


def _scored(patches, k=1):
    q = patches.select("category", "vec_id", "item_id", "features")
    return lambda bank: ve.nearest_blocks(q, bank, ["category"], ["vec_id", "item_id"], k)


TOP = "r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC) AS rn, count(*) OVER (PARTITION BY item_id) AS n FROM {of}) SELECT item_id, round(avg(score) FILTER (WHERE rn <= greatest(1, ceil(n * {share}::DOUBLE))), 5) AS score FROM r GROUP BY item_id"
M3 = fx.sql(f"WITH {BANK}, {KNN}, {TOP.format(of='knn', share=0.05)}")


@query("m3_patch_memory_whole", M3)
@query("m3_patch_memory", M3)
def m3_patch_memory(spark, sf):
    """Patch scores by the three nearest of the category's bank, the top 5 % of an item averaged."""
    p = fx.item_patches(spark, sf)
    return tb.top_fraction(_scored(_queries(p), 3)(_bank(p)), "item_id", "score", {"score": 0.05}).select("item_id", F.round("score", 5).alias("score"))


NN = f"nn AS (SELECT vec_id, item_id, min({DIST}) AS score FROM item_patches q JOIN bank b USING (category) WHERE split <> 'train' GROUP BY vec_id, item_id)"


@query("m3_nearest_memory", fx.sql(f"WITH {BANK}, {NN}, {TOP.format(of='nn', share=0.01)}"))
def m3_nearest_memory(spark, sf):
    """The other preset: patch scores by the nearest of the category's bank, the top 1 % of an item averaged."""
    p = fx.item_patches(spark, sf)
    return tb.top_fraction(_search(p)[0], "item_id", "score", {"score": 0.01}).select("item_id", F.round("score", 5).alias("score"))


@query("m3_global_memory", fx.sql(f"WITH g AS (SELECT features FROM item_patches WHERE split = 'train'), nn AS (SELECT vec_id, item_id, min({DIST}) AS score FROM item_patches q, g b WHERE split <> 'train' GROUP BY vec_id, item_id), {TOP.format(of='nn', share=0.05)}"))
def m3_global_memory(spark, sf):
    """One bank over all categories, as in the reference's first version, but of all training patches: the nearest vector of it, the top 5 % of an item averaged."""
    p = fx.item_patches(spark, sf)
    s, _ = ve.nearest_pruned(_queries(p).select("vec_id", "item_id", "features"), _bank(p, (), None), [], ["vec_id", "item_id"])
    return tb.top_fraction(s, "item_id", "score", {"score": 0.05}).select("item_id", F.round("score", 5).alias("score"))


REGIONS = (4, 6, 8)


def _region_sql(sizes):
    """Top patch scores of items by the banks of their regions, of the category where a region has no training patches, for some region sizes."""
    region = "(least(r - 1, floor(i / 2.0::DOUBLE * r))::INT * r + least(r - 1, floor(j / 2.0::DOUBLE * r))::INT)"
    values = ", ".join(f"({r}, {max(LEAST_REGION, CAP // r**2)})" for r in sizes)
    return f"""
WITH {BANK}, g AS (SELECT p.*, r, cap, {region} AS region FROM item_patches p, (VALUES {values}) AS v(r, cap)),
br AS (SELECT r, category, region, features FROM (SELECT *, row_number() OVER (PARTITION BY r, category, region ORDER BY md5(vec_id || '#0'), vec_id) AS rn FROM g WHERE split = 'train') WHERE rn <= cap),
fine AS (SELECT q.r, vec_id, min({DIST}) AS s FROM g q JOIN br b ON q.r = b.r AND q.category = b.category AND q.region = b.region WHERE split <> 'train' GROUP BY ALL),
wide AS (SELECT vec_id, min({DIST}) AS s FROM item_patches q JOIN bank b USING (category) WHERE split <> 'train' GROUP BY vec_id),
s AS (SELECT g.r, item_id, coalesce(fine.s, wide.s) AS score FROM g LEFT JOIN fine USING (r, vec_id) LEFT JOIN wide USING (vec_id) WHERE split <> 'train'),
t AS (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY score DESC) AS rn, count(*) OVER (PARTITION BY r, item_id) AS n FROM s)
SELECT r AS region_size, item_id, round(avg(score) FILTER (WHERE rn <= greatest(1, ceil(n * 0.05::DOUBLE))), 5) AS score FROM t GROUP BY ALL
"""


def _region_scores(p, sizes):
    """Rows (region_size, item_id, score) for all sizes in one search: the size is a key of the banks."""
    parts = []
    for r in sizes:
        g = p.withColumns({"region_size": F.lit(r), "region": ve.region(F.col("i"), F.col("j"), 2, 2, r)})
        keys = ["region_size", "category"]
        q = _queries(g).select(*keys, "region", "vec_id", "item_id", "features")
        parts.append(ve.region_banks(q, g.where("split = 'train'").select(*keys, "region", "vec_id", "features"), keys, max(LEAST_REGION, CAP // r**2), CAP))
    q, b = (reduce(lambda x, y: x.unionByName(y), [part[k] for part in parts]) for k in (0, 1))
    s = ve.nearest_blocks(q.drop("region"), b.drop("region"), ["region_size", "category", "bank"], ["vec_id", "item_id"])
    top = tb.top_fraction(s.select(F.struct("region_size", "item_id").alias("_i"), "score"), "_i", "score", {"score": 0.05})
    return top.select("_i.region_size", "_i.item_id", F.round("score", 5).alias("score"))


@query("m4_region_candidates", fx.sql(_region_sql(REGIONS)))
def m4_region_candidates(spark, sf):
    """Region-aware scores of the candidate layouts of 4 x 4, 6 x 6 and 8 x 8."""
    return _region_scores(fx.item_patches(spark, sf), REGIONS)


@query("m4_region_memory", f"SELECT item_id, score FROM ({fx.sql(_region_sql((6,)))})")
def m4_region_memory(spark, sf):
    """Banks by (category, region) in a layout of 6 x 6, and the category's bank for the queries whose region has none."""
    return _region_scores(fx.item_patches(spark, sf), (6,)).drop("region_size")


@query("m4_region_memory_whole", f"SELECT item_id, score FROM ({fx.sql(_region_sql((2,)))})")
def m4_region_memory_whole(spark, sf):
    """The same in a layout of 2 x 2."""
    return _region_scores(fx.item_patches(spark, sf), (2,)).drop("region_size")


J9 = f"SELECT category, count(*) AS n, round(avg(s), 5) AS mean_score FROM (SELECT vec_id, category, min({DIST}) AS s FROM item_patches q JOIN bank b USING (category) WHERE split = 'test' GROUP BY vec_id, category) GROUP BY category"


def _in_key(p, bank):
    n, _ = ve.nearest_pruned(p.where("split = 'test'").select("category", "vec_id", "features"), bank, ["category"], ["vec_id"])
    return n.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean_score"))


@query("j9_nearest_in_key", fx.sql(f"WITH {BANK} {J9}"))
def j9_nearest_in_key(spark, sf):
    p = fx.item_patches(spark, sf)
    return _in_key(p, _bank(p))


@query("j9_nearest_in_key_whole", fx.sql(f"WITH {WHOLE} {J9}"))
def j9_nearest_in_key_whole(spark, sf):
    """The same over all training patches of the category."""
    p = fx.item_patches(spark, sf)
    return _in_key(p, _bank(p, cap=None))


#: Words of a vocabulary, as in the reference. The given ones are the first training patches of a category.
K = 32
WORDS = f"words AS (SELECT category, features AS centre, row_number() OVER (PARTITION BY category ORDER BY vec_id) - 1 AS word FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(vec_id || '#5'), vec_id) AS rn FROM item_patches WHERE split = 'train') WHERE rn <= {K}), near AS (SELECT vec_id, item_id, category, split, arg_min(word, (list_distance(features, centre), word)) AS word FROM item_patches JOIN words USING (category) GROUP BY ALL)"
HIST = f"hist AS (SELECT category, item_id, split, list(n / t ORDER BY w) AS hist FROM (SELECT category, item_id, split, w, count(*) FILTER (WHERE word = w)::DOUBLE AS n, count(*)::DOUBLE AS t FROM near, range({K}) AS u(w) GROUP BY ALL) GROUP BY ALL)"


def _first_words(p):
    from pyspark.sql import Window as W

    f = tb.capped_sample(p.where("split = 'train'"), "vec_id", K, 5, ["category"])
    rn = F.row_number().over(W.partitionBy("category").orderBy("vec_id")) - 1
    return f.select("category", rn.alias("word"), F.col("features").alias("centre"))


def _hist(p):
    near = ve.nearest_word(p, _first_words(p), ["category"], ["vec_id", "item_id", "split"])
    split = p.select("item_id", "split").distinct()
    k = p.select("category").distinct().withColumn("k", F.lit(K))
    return ve.histograms(near, k, ["category"]).join(split, "item_id")


@query("m5_lloyd_step", fx.sql(f"WITH {WORDS}, w AS (SELECT category, word, features FROM near JOIN (SELECT vec_id, features FROM item_patches) USING (vec_id) WHERE split = 'train') SELECT category, word, p - 1 AS pos, round(avg(features[p]), 5) AS x, count(*) AS n FROM w, range(1, 65) AS u(p) GROUP BY category, word, p"))
def m5_lloyd_step(spark, sf):
    """One step of the vocabulary's k-means from given centres: all coordinates of the words that have vectors."""
    p = fx.item_patches(spark, sf).where("split = 'train'").select("category", "vec_id", "features")
    w = written(_first_words(p.withColumn("split", F.lit("train"))), "words")
    n = ve.nearest_word(p, w, ["category"], ["vec_id"]).groupBy("category", "word").agg(F.count(F.lit(1)).alias("n"))
    s = mo.lloyd_step(p, w, ["category"]).join(n.hint("merge"), ["category", "word"])
    return s.select("category", F.col("word").cast("long").alias("word"), "n", F.posexplode("centre").alias("pos", "x")).select("category", "word", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"), "n")


@query("m5_vocabulary")
def m5_vocabulary(spark, sf):
    p = fx.item_patches(spark, sf).where("split = 'train'").select("category", "vec_id", "features")
    return mo.vocabulary(p, ["category"], N_WORDS)


#: Words of a category's vocabulary and patches that an item gives to its fit, as in the reference.
N_WORDS, ITEM_PATCHES = 32, 80


def _fitted_hist(spark, sf):
    """Composition histograms by the fitted vocabulary of each category, with the items' split."""
    p = fx.item_patches(spark, sf)
    drawn = tb.capped_sample(p.where("split = 'train'"), "vec_id", ITEM_PATCHES, 0, ["category", "item_id"])
    words = mo.vocabulary(drawn.select("category", "vec_id", "features"), ["category"], N_WORDS)
    near = ve.nearest_word(p, words, ["category"], ["vec_id", "item_id"])
    k = words.groupBy("category").agg(F.count(F.lit(1)).cast("int").alias("k"))
    return written(ve.histograms(near, k, ["category"]).join(p.select("item_id", "split").distinct().hint("merge"), "item_id"))


@query("m6_composition", fx.sql(f"WITH {WORDS}, {HIST} SELECT item_id, category, w AS word, round(hist[w + 1], 6) AS share FROM hist, range({K}) AS u(w) WHERE hist[w + 1] IS NOT NULL"))
def m6_composition(spark, sf):
    """Shares of given words in each item's patches, zeros kept."""
    h = _hist(fx.item_patches(spark, sf)).select("item_id", "category", F.posexplode("hist").alias("word", "x"))
    return h.select("item_id", "category", F.col("word").cast("long").alias("word"), F.round("x", 6).alias("share"))


@query("m6_fitted_composition")
def m6_fitted_composition(spark, sf):
    """The same for the fitted words of each category."""
    return _fitted_hist(spark, sf).select("item_id", "category", F.posexplode("hist").alias("word", "share"))


@query("m7_mahalanobis")
def m7_mahalanobis(spark, sf):
    h = _fitted_hist(spark, sf)
    return mo.mahalanobis(h.where("split = 'train'"), h, ["category"])


ADJUGATE = """
f AS (SELECT item_id, category, list_sum(grid) / 64 AS x, list_stddev_pop(grid) AS y, {edge} AS z FROM grids),
m AS (SELECT category, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_samp(x) + 1e-5 AS a, covar_samp(x, y) AS b, covar_samp(x, z) AS c, var_samp(y) + 1e-5 AS d, covar_samp(y, z) AS e, var_samp(z) + 1e-5 AS f FROM f WHERE item_id % 10 < 5 GROUP BY category),
i AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m),
q AS (SELECT f.item_id, f.category, x - mx AS x, y - my AS y, z - mz AS z, a, b, c, d, e, i.f AS f, det FROM f JOIN i USING (category))
SELECT item_id, category, round(sqrt(greatest(0, (x * x * (d * f - e * e) + y * y * (a * f - c * c) + z * z * (a * d - b * b) + 2 * (x * y * (c * e - b * f) + x * z * (b * e - c * d) + y * z * (b * c - a * e))) / det)), 5) AS score FROM q
"""


@query("m8_cosine", fx.sql(f"WITH {WORDS}, {HIST}, mean AS (SELECT category, list(m ORDER BY p) AS mean FROM (SELECT category, p, avg(hist[p]) AS m FROM hist, range(1, {K + 1}) AS u(p) WHERE split = 'train' AND hist[p] IS NOT NULL GROUP BY category, p) GROUP BY category) SELECT item_id, round(1 - list_dot_product(hist, mean) / (sqrt(list_dot_product(hist, hist)) * sqrt(list_dot_product(mean, mean))), 6) AS score FROM hist JOIN mean USING (category)"))
def m8_cosine(spark, sf):
    h = _hist(fx.item_patches(spark, sf))
    return _cosines(h).select("item_id", F.round("score", 6).alias("score"))


def _cosines(h):
    """Distance of each histogram to the mean of the category's training ones."""
    m = mm.comoments(h.where("split = 'train'"), ["category"], "hist").select("category", "mean")
    return h.join(beside(m), "category").withColumn("score", ve.cosine_distance(F.col("hist"), F.col("mean"))).drop("mean", "hist")


@query("m8_composition_scores")
def m8_composition_scores(spark, sf):
    """The composition branch: Mahalanobis, cosine and forest scores of each item's histogram of its category's fitted words; score is the first."""
    h = _fitted_hist(spark, sf)
    fit = mm.inverse_covariances(h.where("split = 'train'"), ["category"], "hist")
    scored = mm.mahalanobis(h.withColumn("h", F.col("hist")), fit, ["category"], "hist", "score_mahalanobis").withColumnRenamed("h", "hist")
    cosine = _cosines(h).select("item_id", F.col("score").alias("score_cosine"))
    forest = m9_composition_forest(spark, sf, h).select("item_id", F.col("score").alias("score_isolation_forest"))
    out = scored.drop("hist").join(cosine.hint("merge"), "item_id").join(forest.hint("merge"), "item_id")
    return out.select("item_id", "category", "split", "score_mahalanobis", "score_cosine", "score_isolation_forest", F.col("score_mahalanobis").alias("score"))


@query("m9_isolation_forest")
def m9_isolation_forest(spark, sf):
    """Raw patches by a forest of training patches."""
    p = fx.item_patches(spark, sf)
    return mo.isolation_forest(p.where("split = 'train'"), p.select("vec_id", "features"), "features", "vec_id")


TREES = [
    (0, 256, [0, 1, -1, -1, 2, -1, -1], [0.0, 0.1, 2.0, 4.5, -0.05, 3.0, 9.25], [1, 2, 0, 0, 5, 0, 0], [4, 3, 0, 0, 6, 0, 0]),
    (1, 256, [63, -1, 10, -1, -1], [-0.1, 1.0, 0.2, 7.5, 2.25], [1, 0, 3, 0, 0], [2, 0, 4, 0, 0]),
    (2, 256, [-1], [5.0], [0], [0]),
]
DEPTHS = "CASE WHEN features[1] < 0.0 THEN CASE WHEN features[2] < 0.1::DOUBLE THEN 2.0 ELSE 4.5 END WHEN features[3] < -0.05::DOUBLE THEN 3.0 ELSE 9.25 END + CASE WHEN features[64] < -0.1::DOUBLE THEN 1.0 WHEN features[11] < 0.2::DOUBLE THEN 7.5 ELSE 2.25 END + 5.0"


@query("m9_given_forest", fx.sql(f"SELECT vec_id, round(2.0::DOUBLE ** (-({DEPTHS}) / 3.0::DOUBLE / {float(mo.path_average(256))}::DOUBLE), 6) AS score FROM item_patches"))
def m9_given_forest(spark, sf):
    """Scores by a forest that is given: three small trees."""
    trees = spark.createDataFrame(TREES, mo.FOREST)
    s = mo.forest_scores(fx.item_patches(spark, sf).select("vec_id", "features"), trees, "features")
    return s.select("vec_id", F.round("score", 6).alias("score"))


@query("m9_composition_forest")
def m9_composition_forest(spark, sf, h=None):
    """Items by a forest of the training items' histograms, filled up with zeros where a category has fewer words."""
    h = h or _fitted_hist(spark, sf)
    hist = F.concat("hist", F.array_repeat(F.lit(0.0), F.lit(N_WORDS) - F.size("hist")))
    h = h.withColumn("hist", hist)
    return mo.isolation_forest(h.where("split = 'train'"), h.select("item_id", "category", "split", "hist"), "hist", "item_id")


@query("m10_global_statistics", fx.sql("WITH s AS (SELECT category, p, avg(features[p]) AS m, stddev_pop(features[p]) AS s FROM item_patches, range(1, 65) AS u(p) WHERE split = 'train' GROUP BY category, p) SELECT category, vec_id AS item_id, round(sqrt(avg(((features[p] - m) / (s + 1e-6)) ** 2)), 5) AS score FROM item_patches JOIN s USING (category) WHERE split = 'test' GROUP BY category, vec_id"))
def m10_global_statistics(spark, sf):
    p = fx.item_patches(spark, sf).withColumn("item_id", F.col("vec_id"))
    s = ve.global_statistics(p.where("split = 'train'"), p.where("split = 'test'"), ["category"])
    return s.select("category", "item_id", F.round("score", 5).alias("score"))


PCA_DIMS, PCA_CAP = (8, 16, 32), 50_000


@query("m11_pca_variance")
def m11_pca_variance(spark, sf):
    """Variance of a category's training patches by number of principal axes, and the least numbers that hold 90 and 95 % of it."""
    p = fx.item_patches(spark, sf)
    return mm.variance(mm.principal_axes(_bank(p, cap=PCA_CAP), ["category"], "features"), ["category"])


def _study(p, axes):
    """The tables of the dimension study by category and over categories, for the axes that axes(bank) gives."""
    bank = written(_bank(p, cap=None), "bank")
    full = bank.agg(F.max(F.size("features"))).first()[0] or 0
    return mo.dimension_study(p, bank, axes(bank), [k for k in PCA_DIMS if k < full], full)


@query("m11_pca_study")
def m11_pca_study(spark, sf):
    """Mean AUROC over categories of the nearest-neighbour score on some numbers of each category's principal axes, and its percentage of that of whole vectors."""
    return _study(fx.item_patches(spark, sf), lambda bank: mm.principal_axes(bank, ["category"], "features"))[1]


@query("m11_pca_categories")
def m11_pca_categories(spark, sf):
    """The same by category."""
    return _study(fx.item_patches(spark, sf), lambda bank: mm.principal_axes(bank, ["category"], "features"))[0]


AXIS_STUDY = f"""
WITH m AS (SELECT category, list(m ORDER BY p) AS mean FROM (SELECT category, p, avg(features[p]) AS m FROM item_patches, range(1, 65) AS u(p) WHERE split = 'train' GROUP BY category, p) GROUP BY category),
v AS (SELECT vec_id, item_id, category, split, dims, CASE WHEN dims = 64 THEN features ELSE list_transform(range(1, dims + 1), lambda i: features[i] - mean[i]) END AS f FROM item_patches JOIN m USING (category), (VALUES {", ".join(f"({k})" for k in (*PCA_DIMS, 64))}) AS d(dims)),
u AS (SELECT *, list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) AS g FROM v),
nn AS (SELECT q.dims, q.category, q.item_id, q.vec_id, min(list_distance(q.g, b.g)) AS d FROM u q JOIN u b ON q.dims = b.dims AND q.category = b.category AND b.split = 'train' WHERE q.split <> 'train' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dims, item_id ORDER BY d DESC) AS rn, count(*) OVER (PARTITION BY dims, item_id) AS n FROM nn),
s AS (SELECT dims, category, item_id, avg(d) FILTER (WHERE rn <= greatest(1, floor(n * 0.01::DOUBLE))) AS score FROM r GROUP BY ALL),
i AS (SELECT DISTINCT item_id, split, label FROM item_patches WHERE split <> 'train'),
z AS (SELECT dims, category, split, label, (score - avg(score) FILTER (WHERE split = 'validation') OVER w) / (stddev_pop(score) FILTER (WHERE split = 'validation') OVER w + 1e-8) AS z FROM s JOIN i USING (item_id) WINDOW w AS (PARTITION BY dims, category)),
a AS (SELECT x.dims, x.category, avg(CASE WHEN x.z > y.z THEN 1.0::DOUBLE WHEN x.z = y.z THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS auroc FROM z x JOIN z y ON x.dims = y.dims AND x.category = y.category WHERE x.split = 'test' AND y.split = 'test' AND x.label = 1 AND y.label = 0 GROUP BY ALL),
t AS (SELECT dims, avg(auroc) AS mean_auroc, count(auroc) AS n_categories FROM a GROUP BY dims)
SELECT dims, round(mean_auroc, 6) AS mean_auroc, n_categories, round(100 * mean_auroc / (SELECT mean_auroc FROM t WHERE dims = 64), 5) AS pct_of_full FROM t
"""


@query("m11_axis_study", fx.sql(AXIS_STUDY))
def m11_axis_study(spark, sf):
    """The same study on axes that are given, those of the coordinates."""

    def given(bank):
        m = mm.comoments(bank, ["category"], "features")
        d = F.size("mean")
        eye = F.transform(F.sequence(F.lit(0), d * d - 1), lambda i: (i % (d + 1) == 0).cast("double"))
        return written(m.select("category", "n", "mean", eye.alias("axes")), "axes")

    s = _study(fx.item_patches(spark, sf), given)[1]
    return s.select("dims", F.round("mean_auroc", 6).alias("mean_auroc"), "n_categories", F.round("pct_of_full", 5).alias("pct_of_full"))


@query("m12_component_probe")
def m12_component_probe(spark, sf):
    """Words and connected foreground parts of each item's own small fits."""
    return mo.probe_counts(mo.probe(fx.item_patches(spark, sf)))


@query("m12_probe_summary")
def m12_probe_summary(spark, sf):
    """Count, mean, least and greatest number of foreground parts by category and defect."""
    p = fx.item_patches(spark, sf)
    items = p.select("item_id", "category", "defect_type").distinct()
    d = mo.probe_counts(mo.probe(p)).join(items.hint("merge"), "item_id")
    return d.groupBy("category", "defect_type").agg(F.count("n_parts").alias("count"), F.avg("n_parts").alias("mean"), F.min("n_parts").alias("min"), F.max("n_parts").alias("max"))


@query("m13_local_contrast", fx.sql("SELECT item_id, round(list_max(list_transform(grid, lambda x: abs(x - list_sum(grid) / 64))), 6) AS contrast FROM grids"))
def m13_local_contrast(spark, sf):
    return fx.grids(spark, sf).select("item_id", F.round(F.array_max(gr.local_contrast(F.col("grid"))), 6).alias("contrast"))


EDGE = "(SELECT avg(abs(grid[p] - grid[p - 1])) FROM range(1, 65) AS u(p) WHERE (p - 1) % 8 <> 0) + (SELECT avg(abs(grid[p] - grid[p - 8])) FROM range(9, 65) AS u(p))"


@query("m7_feature_mahalanobis", fx.sql("WITH " + ADJUGATE.strip().format(edge=EDGE)))
def m7_feature_mahalanobis(spark, sf):
    """Items by their mean, deviation and edge density, against those of the category's items of the first half of ten ids."""
    f = ve.features_from(fx.grids(spark, sf), "grid_stats", "grid").select("item_id", "category", "features")
    fit = mm.inverse_covariances(f.where("item_id % 10 < 5"), ["category"], "features")
    return mm.mahalanobis(f, fit, ["category"], "features").select("item_id", "category", F.round("score", 5).alias("score"))


@query("m14_feature_backends", fx.sql(f"SELECT item_id, 'grid_stats' AS feature_backend, round(list_sum(grid) / 64, 6) AS f0, round(list_stddev_pop(grid), 6) AS f1, round({EDGE}, 6) AS f2 FROM grids"))
def m14_feature_backends(spark, sf):
    f = ve.features_from(fx.grids(spark, sf), "grid_stats", "grid")
    return f.select("item_id", "feature_backend", *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(3)])


SIZE = 256


LETTERBOX = f"WITH p AS (SELECT p_partkey, p_size * 10 AS w, 1 + floor(p_retailprice % 400)::INT AS h, least({SIZE}.0::DOUBLE / (p_size * 10), {SIZE}.0::DOUBLE / (1 + floor(p_retailprice % 400)::INT)) AS s FROM part), r AS (SELECT *, round_even(w * s, 0)::INT AS rw, round_even(h * s, 0)::INT AS rh FROM p)"


@query("g1_letterbox", f"{LETTERBOX} SELECT p_partkey, round(s, 6) AS scale, rw AS resized_w, rh AS resized_h, ({SIZE} - rw) // 2 AS pad_left, {SIZE} - rw - ({SIZE} - rw) // 2 AS pad_right, ({SIZE} - rh) // 2 AS pad_top, {SIZE} - rh - ({SIZE} - rh) // 2 AS pad_bottom FROM r")
def g1_letterbox(spark, sf):
    p = fx.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10).alias("w"), (1 + F.floor(F.col("p_retailprice") % 400).cast("int")).alias("h"))
    g = gr.letterbox(F.col("w"), F.col("h"), SIZE)
    return p.select("p_partkey", F.round(g["scale"], 6).alias("scale"), *[g[c].alias(c) for c in g if c != "scale"])


BOX_SQL = f"""
{LETTERBOX}, side AS (SELECT p_brand, unnest(['left', 'top', 'right', 'bottom']) AS side, unnest([({SIZE} - rw) // 2, ({SIZE} - rh) // 2, {SIZE} - rw - ({SIZE} - rw) // 2, {SIZE} - rh - ({SIZE} - rh) // 2]) AS pad FROM r JOIN part USING (p_partkey)),
modal AS (SELECT p_brand, side, pad FROM (SELECT p_brand, side, pad, row_number() OVER (PARTITION BY p_brand, side ORDER BY count(*) DESC, pad) AS rn FROM side GROUP BY p_brand, side, pad) WHERE rn = 1)
SELECT p_brand AS category, (max(pad) FILTER (WHERE side = 'left'))::INT AS box_left, (max(pad) FILTER (WHERE side = 'top'))::INT AS box_top,
  ({SIZE} - max(pad) FILTER (WHERE side = 'right'))::INT AS box_right, ({SIZE} - max(pad) FILTER (WHERE side = 'bottom'))::INT AS box_bottom FROM modal GROUP BY p_brand
"""


@query("a11_content_box", BOX_SQL)
def a11_content_box(spark, sf):
    """The content box of a category from the most frequent padding of each side, the smallest on ties."""
    p = fx.table(spark, sf, "part").select(F.col("p_brand").alias("category"), (F.col("p_size") * 10).alias("w"), (1 + F.floor(F.col("p_retailprice") % 400).cast("int")).alias("h"))
    g = gr.letterbox(F.col("w"), F.col("h"), SIZE)
    pads = p.select("category", *[g[f"pad_{s}"].alias(s) for s in ("left", "top", "right", "bottom")])
    modal = {s: F.mode(s, True) for s in ("left", "top", "right", "bottom")}
    return pads.groupBy("category").agg(modal["left"].alias("box_left"), modal["top"].alias("box_top"), (SIZE - modal["right"]).alias("box_right"), (SIZE - modal["bottom"]).alias("box_bottom"))


@query("g2_output_check", fx.sql("SELECT item_id, len(grid) <> 64 AS wrong_size, len(list_filter(grid, lambda x: round(x, 1) NOT IN (0.4, 0.5, 0.6))) > 0 AS non_binary FROM grids"))
def g2_output_check(spark, sf):
    """Size and values outside a set, as for masks."""
    odd = F.array_except(F.array_distinct(F.transform("grid", lambda x: F.round(x, 1))), F.array(F.lit(0.4), F.lit(0.5), F.lit(0.6)))
    return fx.grids(spark, sf).select("item_id", (F.size("grid") != 64).alias("wrong_size"), (F.size(odd) > 0).alias("non_binary"))


@query("g3_edge_density", fx.sql(f"SELECT item_id, round({EDGE}, 6) AS edge FROM grids"))
def g3_edge_density(spark, sf):
    return fx.grids(spark, sf).select("item_id", F.round(gr.edge_density(F.col("grid"), 8), 6).alias("edge"))


@query("g4_global_features", fx.sql(f"SELECT item_id, round(list_sum(grid) / 64, 6) AS mean, round(list_stddev_pop(grid), 6) AS std, round({EDGE}, 6) AS edge, (SELECT max(c) FROM (SELECT count(*) AS c FROM unnest(grid) AS u(x) GROUP BY least(31, floor(x * 32)))) * 32.0::DOUBLE / 64 AS top_bin FROM grids"))
def g4_global_features(spark, sf):
    g = F.col("grid")
    return fx.grids(spark, sf).select("item_id", F.round(gr.mean_of(g), 6).alias("mean"), F.round(gr.std_of(g), 6).alias("std"), F.round(gr.edge_density(g, 8), 6).alias("edge"), F.array_max(gr.histogram(g, 32)).alias("top_bin"))


@query("g5_block_statistics", fx.sql("WITH c AS (SELECT item_id, grid, p, grid[p + 1] AS x, p // 8 AS r, p % 8 AS c, least(2, p // 8 // 2) * 3 + least(2, p % 8 // 2) AS block FROM grids, range(64) AS u(p)) SELECT item_id, block, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(coalesce(avg(abs(x - grid[p])) FILTER (WHERE c > 0 AND least(2, (c - 1) // 2) = least(2, c // 2)), 0) + coalesce(avg(abs(x - grid[p - 7])) FILTER (WHERE r > 0 AND least(2, (r - 1) // 2) = least(2, r // 2)), 0), 6) AS edge FROM c GROUP BY item_id, block"))
def g5_block_statistics(spark, sf):
    b = gr.block_statistics(fx.grids(spark, sf), "grid", 8, 3)
    return b.select("item_id", "block", *[F.round(c, 6).alias(c) for c in ("mean", "std", "edge")])


RGB = "(0.299::DOUBLE * grid[{p} + 1] + 0.587::DOUBLE * grid[{p} + 21] + 0.114::DOUBLE * grid[{p} + 41])"
PATCH = f"""
WITH c AS (SELECT item_id, least(1, p // 5 // 2) AS i, least(1, p % 5 // 2) AS j, grid[p + 1] AS a, grid[p + 21] AS b, grid[p + 41] AS d,
  CASE WHEN p % 5 > 0 AND least(1, (p % 5 - 1) // 2) = least(1, p % 5 // 2) THEN abs({RGB.format(p="p")} - {RGB.format(p="(p - 1)")}) END AS dx,
  CASE WHEN p // 5 > 0 AND least(1, (p // 5 - 1) // 2) = least(1, p // 5 // 2) THEN abs({RGB.format(p="p")} - {RGB.format(p="(p - 5)")}) END AS dy FROM grids, range(20) AS u(p))
SELECT item_id, i::INT AS i, j::INT AS j, round(avg(a), 6) AS f0, round(avg(b), 6) AS f1, round(avg(d), 6) AS f2, round(stddev_pop(a), 6) AS f3, round(stddev_pop(b), 6) AS f4, round(stddev_pop(d), 6) AS f5,
  round(coalesce(avg(dx), 0) + coalesce(avg(dy), 0), 6) AS f6, i::DOUBLE AS f7, j::DOUBLE AS f8 FROM c GROUP BY item_id, i, j
"""


@query("g5_patch_features", fx.sql(PATCH))
def g5_patch_features(spark, sf):
    """Statistics of 2 x 2 blocks of three channels of 5 x 4 cells, with the blocks' places."""
    g = fx.grids(spark, sf).select("item_id", *[F.slice("grid", 20 * k + 1, 20).alias(c) for k, c in enumerate("rgb")])
    f = gr.patch_features(g, ["r", "g", "b"], 5, 4, 2, xy=True)
    return f.select("item_id", "i", "j", *[F.round(F.get("features", F.lit(k)), 6).alias(f"f{k}") for k in range(9)])


@query("g6_position_moments", fx.sql("SELECT category, p AS pos, round(avg(grid[p + 1]), 6) AS mean, round(var_pop(grid[p + 1]), 6) AS var FROM grids, range(64) AS u(p) GROUP BY category, p"))
def g6_position_moments(spark, sf):
    return gr.position_moments(fx.grids(spark, sf), "grid", ["category"]).select("category", "pos", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query("g7_mean_histogram", fx.sql("WITH n AS (SELECT category, count(*) AS items FROM grids GROUP BY category), h AS (SELECT category, least(63, floor(x * 64))::INT AS bin, count(*) AS c FROM (SELECT category, unnest(grid) AS x FROM grids) GROUP BY 1, 2) SELECT category, bin, round(c::DOUBLE / items, 6) AS density FROM h JOIN n USING (category)"))
def g7_mean_histogram(spark, sf):
    h = fx.grids(spark, sf).select("category", F.posexplode(gr.histogram(F.col("grid"), 64)).alias("bin", "d"))
    return h.groupBy("category", "bin").agg(F.round(F.avg("d"), 6).alias("density")).where("density > 0")


@query("g8_mask_frequency", fx.sql("SELECT category, p AS pos, round(avg((grid[p + 1] > 0.55)::INT), 6) AS share FROM grids, range(64) AS u(p) GROUP BY category, p"))
def g8_mask_frequency(spark, sf):
    m = fx.grids(spark, sf).select("category", F.posexplode("grid").alias("pos", "x"))
    return m.groupBy("category", "pos").agg(F.round(F.avg((F.col("x") > F.lit(0.55)).cast("int")), 6).alias("share"))


@query("g9_region_id", fx.sql("SELECT item_id, p AS pos, least(2, floor(p // 8 / 8.0::DOUBLE * 3))::INT * 3 + least(2, floor(p % 8 / 8.0::DOUBLE * 3))::INT AS region FROM grids, range(64) AS u(p)"))
def g9_region_id(spark, sf):
    c = fx.grids(spark, sf).select("item_id", F.posexplode("grid").alias("pos", "x"))
    return c.select("item_id", "pos", ve.region(F.floor(F.col("pos") / 8), F.col("pos") % 8, 8, 8, 3).alias("region"))


@query("g10_unit_vectors", fx.sql("SELECT item_id, round(grid[1] / sqrt(list_dot_product(grid, grid)), 6) AS x0, round(grid[64] / sqrt(list_dot_product(grid, grid)), 6) AS x63 FROM grids"))
def g10_unit_vectors(spark, sf):
    u = ve.unit(F.col("grid"))
    return fx.grids(spark, sf).withColumn("u", u).select("item_id", F.round(F.get("u", F.lit(0)), 6).alias("x0"), F.round(F.get("u", F.lit(63)), 6).alias("x63"))


UP = "(least(7.0::DOUBLE, greatest(0.0::DOUBLE, ({v} - 2 + 0.5) * 8 / 10.0::DOUBLE - 0.5)))"


@query("g11_upsampled_map", fx.sql(f"WITH c AS (SELECT item_id, grid, p AS pos, p // 14 AS y, p % 14 AS x FROM grids, range(196) AS u(p)), f AS (SELECT *, {UP.format(v='y')} AS fy, {UP.format(v='x')} AS fx FROM c), g AS (SELECT *, floor(fy)::INT AS y0, floor(fx)::INT AS x0, least(7, floor(fy)::INT + 1) AS y1, least(7, floor(fx)::INT + 1) AS x1 FROM f) SELECT item_id, round(sum(CASE WHEN x BETWEEN 2 AND 11 AND y BETWEEN 2 AND 11 THEN (grid[y0 * 8 + x0 + 1] * (1 - fx + x0) + grid[y0 * 8 + x1 + 1] * (fx - x0)) * (1 - fy + y0) + (grid[y1 * 8 + x0 + 1] * (1 - fx + x0) + grid[y1 * 8 + x1 + 1] * (fx - x0)) * (fy - y0) ELSE 0 END), 5) AS mass, count(*) AS n_cells FROM g GROUP BY item_id"))
def g11_upsampled_map(spark, sf):
    m = gr.upsampled(F.col("grid"), 8, (2, 2, 12, 12), 14)
    return fx.grids(spark, sf).withColumn("m", m).select("item_id", F.round(gr.total(F.col("m")), 5).alias("mass"), F.size("m").cast("long").alias("n_cells"))


@query("g12_overlay", fx.sql("SELECT item_id, round(list_sum(list_transform(grid, lambda x: CASE WHEN x > 0.55 THEN least(1.0, greatest(0.0, 0.6::DOUBLE * x + 0.4::DOUBLE)) ELSE x END)), 5) AS mass FROM grids"))
def g12_overlay(spark, sf):
    mask = F.transform("grid", lambda x: (x > F.lit(0.55)).cast("int"))
    return fx.grids(spark, sf).select("item_id", F.round(gr.total(gr.overlay(F.col("grid"), mask)), 5).alias("mass"))


def _cells(g, array, name, digits=6):
    """A row for each cell of an array column: item_id, pos, and its rounded value."""
    d = g.select("item_id", F.posexplode(array).alias("pos", "_x"))
    return d.select("item_id", F.col("pos").cast("long").alias("pos"), F.round("_x", digits).alias(name))


@query("g4_histogram_bins", fx.sql("WITH b AS (SELECT item_id, least(31, floor(x * 32))::BIGINT AS pos, count(*) AS c FROM (SELECT item_id, unnest(grid) AS x FROM grids) GROUP BY ALL), a AS (SELECT item_id, p AS pos FROM grids, range(32) AS u(p)) SELECT item_id, pos, round(coalesce(c, 0) * 32.0::DOUBLE / 64, 6) AS density FROM a LEFT JOIN b USING (item_id, pos)"))
def g4_histogram_bins(spark, sf):
    """All 32 bins of the global features' histogram."""
    return _cells(fx.grids(spark, sf), gr.histogram(F.col("grid"), 32), "density")


@query("g10_unit_cells", fx.sql("SELECT item_id, p - 1 AS pos, round(grid[p] / CASE WHEN list_dot_product(grid, grid) = 0 THEN 1 ELSE sqrt(list_dot_product(grid, grid)) END, 6) AS x FROM grids, range(1, 65) AS u(p)"))
def g10_unit_cells(spark, sf):
    """All cells of the unit vectors; a zero vector stays."""
    return _cells(fx.grids(spark, sf), ve.unit(F.col("grid")), "x")


@query("g11_upsampled_cells", fx.sql(f"WITH c AS (SELECT item_id, grid, p AS pos, p // 14 AS y, p % 14 AS x FROM grids, range(196) AS u(p)), f AS (SELECT *, {UP.format(v='y')} AS fy, {UP.format(v='x')} AS fx FROM c), g AS (SELECT *, floor(fy)::INT AS y0, floor(fx)::INT AS x0, least(7, floor(fy)::INT + 1) AS y1, least(7, floor(fx)::INT + 1) AS x1 FROM f) SELECT item_id, pos, round(CASE WHEN x BETWEEN 2 AND 11 AND y BETWEEN 2 AND 11 THEN (grid[y0 * 8 + x0 + 1] * (1 - fx + x0) + grid[y0 * 8 + x1 + 1] * (fx - x0)) * (1 - fy + y0) + (grid[y1 * 8 + x0 + 1] * (1 - fx + x0) + grid[y1 * 8 + x1 + 1] * (fx - x0)) * (fy - y0) ELSE 0 END, 5) AS heat FROM g"))
def g11_upsampled_cells(spark, sf):
    """All cells of the maps laid back on their canvas, the empty border too."""
    return _cells(fx.grids(spark, sf), gr.upsampled(F.col("grid"), 8, (2, 2, 12, 12), 14), "heat", 5)


@query("g12_overlay_cells", fx.sql("SELECT item_id, p - 1 AS pos, round(CASE WHEN grid[p] > 0.55 THEN least(1.0, greatest(0.0, 0.6::DOUBLE * grid[p] + 0.4::DOUBLE)) ELSE grid[p] END, 5) AS x FROM grids, range(1, 65) AS u(p)"))
def g12_overlay_cells(spark, sf):
    """All cells of the blend with the mask."""
    mask = F.transform("grid", lambda x: (x > F.lit(0.55)).cast("int"))
    return _cells(fx.grids(spark, sf), gr.overlay(F.col("grid"), mask), "x", 5)


@query("m13_contrast_cells", fx.sql("SELECT item_id, p - 1 AS pos, round(abs(grid[p] - list_sum(grid) / 64), 6) AS contrast FROM grids, range(1, 65) AS u(p)"))
def m13_contrast_cells(spark, sf):
    """All cells of the local contrast."""
    return _cells(fx.grids(spark, sf), gr.local_contrast(F.col("grid")), "contrast")


G13 = """
WITH cell AS (SELECT item_id, p FROM grids, range(64) AS u(p) WHERE grid[p + 1] > list_aggregate(grid, 'quantile_cont', 0.75)),
near AS (SELECT a.item_id, a.p AS p, b.p AS q FROM cell a JOIN cell b ON a.item_id = b.item_id AND (a.p = b.p OR abs(a.p - b.p) = 8 OR abs(a.p - b.p) = 1 AND a.p // 8 = b.p // 8))
"""
STEP = "l{k} AS (SELECT n.item_id, n.p, min(l.lab) AS lab FROM near n JOIN l{j} l ON l.item_id = n.item_id AND l.p = n.q GROUP BY n.item_id, n.p)"
G13 = G13.strip() + ", l0 AS (SELECT item_id, p, p AS lab FROM cell), " + ", ".join(STEP.format(k=k, j=k - 1) for k in range(1, 17))


@query("g13_connected_parts", fx.sql(f"{G13} SELECT item_id, count(DISTINCT lab) AS n_parts FROM l16 GROUP BY item_id"))
def g13_connected_parts(spark, sf):
    """Parts of the cells above the grid's 75 % quantile (linear)."""
    g = F.array_sort("grid")
    q = F.get(g, F.lit(47)) + (F.get(g, F.lit(48)) - F.get(g, F.lit(47))) * 0.25
    on = fx.grids(spark, sf).withColumn("q", q)
    cells = on.select("item_id", "q", F.posexplode("grid").alias("p", "x")).where("x > q")
    return mo.connected_parts(cells.select("item_id", F.floor(F.col("p") / 8).cast("int").alias("i"), (F.col("p") % 8).cast("int").alias("j")))


E15 = fx.sql(f"SELECT category, least({CAP}, count(*) FILTER (WHERE split = 'train')) AS memory_bank_size, max(len(features))::INT AS memory_feature_dim, count(DISTINCT item_id) FILTER (WHERE split <> 'train') AS n_items, count(*) FILTER (WHERE split <> 'train') AS n_patches FROM item_patches GROUP BY category")


@query("e15_efficiency_whole", E15)
@query("e15_efficiency", E15)
def e15_efficiency(spark, sf):
    """Bank sizes, dimensions and queries by category; wall time is the driver's to add."""
    p = fx.item_patches(spark, sf)
    b = _bank(p).groupBy("category").agg(F.count(F.lit(1)).alias("memory_bank_size"), F.max(F.size("features")).alias("memory_feature_dim"))
    return b.join(_queries(p).groupBy("category").agg(F.count_distinct("item_id").alias("n_items"), F.count(F.lit(1)).alias("n_patches")), "category")


@query("e15_method_table")
def e15_method_table(spark, sf):
    """Milliseconds an item, bank size and dimensions by method: each method's scores are written, and the driver's clock is read around that."""
    p = written(fx.item_patches(spark, sf), "patches")
    bank = _bank(p).agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    n_items = _queries(p).select("item_id").distinct().count()
    top = lambda s, share: tb.top_fraction(s, "item_id", "score", {"score": share})
    one = _queries(p).select("vec_id", "item_id", "features")
    regions = p.where("split = 'train'").select("category", ve.region(F.col("i"), F.col("j"), 2, 2, 6)).distinct().count()
    runs = {
        "nearest_memory": (lambda: top(_search(p)[0], 0.01), bank[0], None),
        "patch_memory": (lambda: top(_scored(_queries(p), 3)(_bank(p)), 0.05), bank[0], None),
        "region_memory": (lambda: _region_scores(p, (6,)), bank[0], regions),
        "global_memory": (lambda: top(ve.nearest_pruned(one, _bank(p, (), None), [], ["vec_id", "item_id"])[0], 0.05), _bank(p, (), None).count(), None),
    }
    out = []
    for name, (run, size, region_memories) in runs.items():
        began = time.perf_counter()
        written(run(), "scores")
        d = spark.createDataFrame([(name, (time.perf_counter() - began) * 1000 / max(1, n_items), size, bank[1])], "method string, time_ms_per_image double, memory_bank_size long, memory_feature_dim int")
        out.append(d.withColumn("region_memories", F.lit(region_memories).cast("long")) if region_memories else d)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


TOPS = {"top1": 0.01, "top5": 0.05, "top10": 0.10, "mean": "mean", "max": "max"}
STABILITY = f"""
WITH cand AS ({_region_sql(REGIONS).strip()}),
x AS (SELECT 'region_size' AS source, region_size::VARCHAR AS candidate, region_size = 6 AS selected, item_id, score FROM cand
  UNION ALL SELECT 'topk', candidate, candidate = 'top5', item_id, score FROM (
    WITH {{bank}}, {{nn}}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC) AS rn, count(*) OVER (PARTITION BY item_id) AS n FROM nn)
    SELECT item_id, unnest([{", ".join(f"'{k}'" for k in TOPS)}]) AS candidate, unnest([{", ".join(f"avg(score) FILTER (WHERE rn <= greatest(1, ceil(n * {v}::DOUBLE)))" if isinstance(v, float) else ("avg(score)" if v == "mean" else "max(score)") for v in TOPS.values())}]) AS score FROM r GROUP BY item_id)),
i AS (SELECT DISTINCT item_id FROM item_patches WHERE split = 'validation')
SELECT source, candidate, selected, 'validation_good_stability' AS selection_basis, count(*) AS n_items, round(avg(score) + 1e-9, 4) AS score_mean, round(stddev_pop(score) + 1e-9, 4) AS score_std FROM x JOIN i USING (item_id) GROUP BY source, candidate, selected
"""


@query("e14_candidates", fx.sql(STABILITY.format(bank=BANK, nn=NN)))
def e14_candidates(spark, sf):
    """The registry of the ablations of region sizes and top fractions: every candidate with the mean and deviation of its validation scores, and which is selected."""
    p = written(fx.item_patches(spark, sf), "patches")
    region = _region_scores(p, REGIONS).select(F.lit("region_size").alias("source"), F.col("region_size").cast("string").alias("candidate"), (F.col("region_size") == 6).alias("selected"), "item_id", "score")
    tops = tb.top_fraction(_search(p)[0], "item_id", "score", TOPS).unpivot("item_id", list(TOPS), "candidate", "score")
    tops = tops.select(F.lit("topk").alias("source"), "candidate", (F.col("candidate") == "top5").alias("selected"), "item_id", "score")
    good = p.where("split = 'validation'").select("item_id").distinct()
    d = region.unionByName(tops).join(good.hint("merge"), "item_id").groupBy("source", "candidate", "selected")
    return d.agg(F.count(F.lit(1)).alias("n_items"), F.round(F.avg("score") + 1e-9, 4).alias("score_mean"), F.round(F.stddev_pop("score") + 1e-9, 4).alias("score_std")).withColumn("selection_basis", F.lit("validation_good_stability"))


SEEDS = (42, 7, 2026)
SEEDED = f"""
WITH draw AS (SELECT seed, category, features FROM item_patches, (VALUES {", ".join(f"({s})" for s in SEEDS)}) AS s(seed) WHERE split = 'train' AND substr(md5(vec_id || '#' || seed), 1, 1) < '8'),
d AS (SELECT seed, q.category, item_id, q.label, vec_id, min({DIST}) AS s FROM item_patches q JOIN draw b USING (category) WHERE split = 'test' GROUP BY ALL),
items AS (SELECT seed, category, item_id, label, max(s) AS score FROM d GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (PARTITION BY seed ORDER BY score) + (count(*) OVER (PARTITION BY seed, score) - 1) / 2.0::DOUBLE AS r FROM items),
n AS (SELECT seed, count(*) FILTER (WHERE label = 0) AS n_good, count(*) FILTER (WHERE label = 1) AS n_anomaly, sum(r) FILTER (WHERE label = 1) AS r FROM ranked GROUP BY seed)
SELECT seed, n_good, n_anomaly, CASE WHEN n_good > 0 AND n_anomaly > 0 THEN round((r - n_anomaly * (n_anomaly + 1) / 2.0::DOUBLE) / (n_anomaly::DOUBLE * n_good) + 1e-9, 5) END AS auroc FROM n
"""


@query("e13_seeded_scoring", fx.sql(SEEDED))
def e13_seeded_scoring(spark, sf):
    """The nearest-neighbour stage for several seeds in one job: each draws half of the training patches, and the seed is a key of the banks."""
    p = fx.item_patches(spark, sf).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    drawn = F.substring(F.md5(F.concat_ws("#", F.col("vec_id").cast("string"), F.col("seed").cast("string"))), 1, 1) < "8"
    q = p.where("split = 'test'").select("seed", "category", "vec_id", "item_id", "label", "features")
    s = ve.nearest_blocks(q, p.where("split = 'train'").where(drawn), ["seed", "category"], ["vec_id", "item_id"])
    items = s.groupBy("seed", "category", "item_id", "label").agg(F.max("score").alias("score"))
    return ev.auroc(items, ["seed"]).select("seed", "n_good", "n_anomaly", F.round(F.col("auroc") + 1e-9, 5).alias("auroc"))
