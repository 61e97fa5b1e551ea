"""Queries of scans, sampling, deduplication, joins, aggregates, pivots and cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddlens.operators import tables as tb
from oddlens.plans import fixtures as fx
from oddlens.plans.registry import query
from oddlens.sources import files
from oddlens.sources.shared import fresh, written

T = fx.table


PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def page_paths(spark, sf):
    """Pages as files: path is the URL without scheme, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return T(spark, sf, "pages").select("page_id", "url", "html", path.alias("path"))


@query("s1_item_scan", f"SELECT page_id, path, octet_length(encode(html))::BIGINT AS length FROM (SELECT page_id, html, {PATH} AS path FROM pages) WHERE path LIKE '%.html'")
def s1_item_scan(spark, sf):
    """The scan of item files with a suffix, on the page table."""
    return page_paths(spark, sf).where(F.endswith("path", F.lit(".html"))).select("page_id", "path", F.octet_length("html").cast("long").alias("length"))


@query("s1_binary_scan", f"SELECT coalesce(split_part(path, '/', 1), '') AS section, sum(octet_length(encode(coalesce(html, ''))) + 1)::BIGINT AS n_bytes FROM (SELECT html, {PATH} AS path FROM pages) GROUP BY 1")
def s1_binary_scan(spark, sf):
    """The pages of each host written as files in a folder of its own, and their bytes by a recursive scan of file names and lengths; no content is read."""
    path = fresh(spark, "pages")
    p = page_paths(spark, sf).select(F.coalesce("html", F.lit("")).alias("value"), F.coalesce(F.split("path", "/")[0], F.lit("")).alias("section"))
    p.write.partitionBy("section").text(path)
    section = F.url_decode(F.regexp_extract("path", "/section=([^/]*)/", 1))
    section = F.when(section == "__HIVE_DEFAULT_PARTITION__", "").otherwise(section)
    return files.file_scan(spark, path, "*.txt").groupBy(section.alias("section")).agg(F.sum("length").alias("n_bytes"))


@query("s2_optional_scan", "SELECT source AS method, count(*) AS n, CAST(NULL AS DOUBLE) AS auroc FROM documents GROUP BY source")
def s2_optional_scan(spark, sf):
    """A left join with a result file that may not be there."""
    n = T(spark, sf, "documents").groupBy(F.col("source").alias("method")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(files.optional_csv(spark, f"{sf}/no_such_results.csv", "method string, auroc double"), "method", "left")


@query("s3_csv_round_trip", "SELECT event_type AS method, event_id AS item_id, value AS score FROM events")
def s3_csv_round_trip(spark, sf):
    """Scores written as CSV by method, and read back."""
    e = T(spark, sf, "events").select(F.col("event_type").alias("method"), F.col("event_id").alias("item_id"), F.col("value").alias("score"))
    path = fresh(spark, "csv")
    files.publish(e, path, "csv", ["method"])
    return spark.read.schema("item_id bigint, score double, method string").option("header", True).csv(path).select("method", "item_id", "score")


@query("s4_json_payload", "SELECT nation, '[' || string_agg('{\"c_custkey\":' || c_custkey || ',\"seg\":\"' || c_mktsegment || '\"}', ',' ORDER BY c_custkey) || ']' AS payload FROM (SELECT c_custkey, c_mktsegment, c_nationkey AS nation FROM customer) GROUP BY nation")
def s4_json_payload(spark, sf):
    c = T(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_mktsegment").alias("seg"))
    return files.payload(c, ["nation"], ["c_custkey", "seg"], "c_custkey")


PARTS = f"SELECT page_id, string_split(path, '/') AS p FROM (SELECT page_id, {PATH} AS path FROM pages)"


@query("s5_path_columns", f"SELECT page_id, p[1] AS category, p[2] AS split, p[3] AS defect_type, regexp_replace(p[-1], '\\.[^.]*$', '') AS sample_id, coalesce(p[2] = 'ground_truth', false) AS is_mask FROM ({PARTS})")
def s5_path_columns(spark, sf):
    p = page_paths(spark, sf)
    c = tb.parsed_path(F.col("path"))
    return p.select("page_id", *[c[k].alias(k) for k in ("category", "split", "defect_type", "sample_id", "is_mask")])


@query("s6_item_table", f"SELECT kind, split, count(*) AS n FROM (SELECT CASE WHEN p[2] = 'ground_truth' THEN 'mask' ELSE 'product' END AS kind, p[2] AS split FROM ({PARTS})) GROUP BY kind, split")
def s6_item_table(spark, sf):
    c = tb.parsed_path(F.col("path"))
    return page_paths(spark, sf).select(c["kind"].alias("kind"), c["split"].alias("split")).groupBy("kind", "split").agg(F.count(F.lit(1)).alias("n"))


@query("p1_split_predicates", fx.sql("SELECT split, defect_type, count(*) AS n FROM order_items WHERE split IN ('validation', 'test') AND NOT (split = 'test' AND defect_type = 'good') GROUP BY split, defect_type"))
def p1_split_predicates(spark, sf):
    o = fx.order_items(spark, sf).where("split in ('validation', 'test') and not (split = 'test' and defect_type = 'good')")
    return o.groupBy("split", "defect_type").agg(F.count(F.lit(1)).alias("n"))


@query("p2_head_per_group", fx.sql("SELECT category, split, defect_type, item_id FROM (SELECT *, row_number() OVER (PARTITION BY category, split, defect_type ORDER BY item_id) AS rn FROM order_items) WHERE rn <= 3"))
def p2_head_per_group(spark, sf):
    by = ["category", "split", "defect_type"]
    return tb.head(fx.order_items(spark, sf), by, "item_id", 3).select(*by, "item_id")


@query("p3_capped_sample", fx.sql("SELECT item_id FROM order_items ORDER BY md5(item_id || '#42'), item_id LIMIT 500"))
def p3_capped_sample(spark, sf):
    return tb.capped_sample(fx.order_items(spark, sf).select("item_id"), "item_id", 500, 42)


@query("p4_sample_per_category", fx.sql("SELECT category, item_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(item_id || '#7'), item_id) AS rn FROM order_items WHERE split = 'train') WHERE rn <= 200"))
def p4_sample_per_category(spark, sf):
    o = fx.order_items(spark, sf).where("split = 'train'").select("category", "item_id")
    return tb.capped_sample(o, "item_id", 200, 7, ["category"])


@query("p5_profile_sample", fx.sql("SELECT category, defect_type, item_id FROM (SELECT *, row_number() OVER (PARTITION BY category, defect_type ORDER BY md5(item_id || '#1'), item_id) AS rn FROM order_items) WHERE rn <= 80"))
def p5_profile_sample(spark, sf):
    o = fx.order_items(spark, sf).select("category", "defect_type", "item_id")
    return tb.capped_sample(o, "item_id", 80, 1, ["category", "defect_type"])


@query("p6_split_leaks", "WITH d AS (SELECT doc_id, source, md5(text) AS md5 FROM documents), bad AS (SELECT md5 FROM d WHERE md5 IS NOT NULL GROUP BY md5 HAVING count(DISTINCT source) > 1) SELECT doc_id, md5, coalesce(md5 IN (SELECT md5 FROM bad), false) AS leak FROM d")
def p6_split_leaks(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "source", "text")
    return tb.leaks(d, "doc_id", "text", "source").select("doc_id", "md5", "leak")


HASH = "hs AS (SELECT item_id, lower(string_agg(printf('%x', (b[4*n+1]*8 + b[4*n+2]*4 + b[4*n+3]*2 + b[4*n+4])), '' ORDER BY n)) AS hash FROM (SELECT item_id, list_transform(grid, lambda x: (x >= list_sum(grid) / len(grid))::INT) AS b FROM grids), range(16) AS u(n) GROUP BY item_id, b)"


@query("p7_average_hash", fx.sql(f"WITH {HASH} SELECT item_id, hash FROM hs"))
def p7_average_hash(spark, sf):
    return fx.grids(spark, sf).select("item_id", tb.average_hash(F.col("grid")).alias("hash"))


@query("p8_equal_hashes", fx.sql(f"WITH {HASH} SELECT substr(hash, 1, 2) AS band, count(*) AS n, min(item_id) AS first_item FROM hs GROUP BY 1 HAVING count(*) > 1"))
def p8_equal_hashes(spark, sf):
    """Near-duplicate candidates: items that share the first band of their hash."""
    h = fx.grids(spark, sf).select("item_id", F.substring(tb.average_hash(F.col("grid")), 1, 2).alias("band"))
    return h.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item")).where("n > 1")


@query("p8_hash_classes", fx.sql(f"WITH {HASH} SELECT item_id, hash, min(item_id) OVER w AS class_id, count(*) OVER w AS n FROM hs WINDOW w AS (PARTITION BY hash)"))
def p8_hash_classes(spark, sf):
    """Every item with its whole hash, the class of the items with an equal one (their least id) and the size of the class."""
    h = fx.grids(spark, sf).select("item_id", tb.average_hash(F.col("grid")).alias("hash"))
    c = h.groupBy("hash").agg(F.min("item_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    return h.join(c, "hash").select("item_id", "hash", "class_id", "n")


NEAR = f"WITH {HASH}, d AS (SELECT DISTINCT hash, ('0x' || hash)::UBIGINT AS x FROM hs), p AS (SELECT a.hash AS hash_a, b.hash AS hash_b, bit_count(xor(a.x, b.x))::INT AS distance FROM d a JOIN d b ON a.hash < b.hash) SELECT d.hash AS hash_a, hash_b, distance FROM d LEFT JOIN p ON d.hash = hash_a AND distance <= 3"


@query("p8_near_hashes", fx.sql(NEAR))
def p8_near_hashes(spark, sf):
    """Pairs of distinct hashes that differ in at most 3 of 64 bits; hash_b is null beside a hash that is least of no pair."""
    h = written(fx.grids(spark, sf).select(tb.average_hash(F.col("grid")).alias("hash")).distinct(), "hashes")
    return h.select(F.col("hash").alias("hash_a")).join(tb.near_hashes(h).hint("merge"), "hash_a", "left")


@query("p9_error_rows", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.k') IS NULL OR TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NULL AS corrupted FROM events")
def p9_error_rows(spark, sf):
    raw = F.get_json_object("props", "$.k")
    k = raw.try_cast("int")
    return T(spark, sf, "events").select("event_id", k.alias("k"), k.isNull().alias("corrupted"))


@query("p10_projection", "SELECT 'price' AS method, o_orderkey AS image_id, o_totalprice AS score FROM orders")
def p10_projection(spark, sf):
    o = T(spark, sf, "orders").withColumnsRenamed({"o_orderkey": "image_id", "o_totalprice": "score"})
    return o.withColumn("method", F.lit("price")).select("method", "image_id", "score")


NAMES = {"click": "Click", "view": "View", "purchase": "Purchase"}


@query("p11_label_map", "SELECT event_id, coalesce(label, event_type) AS label, label IS NOT NULL AS mapped FROM events LEFT JOIN (VALUES ('click', 'Click'), ('view', 'View'), ('purchase', 'Purchase')) AS m(event_type, label) USING (event_type)")
def p11_label_map(spark, sf):
    m = spark.createDataFrame(list(NAMES.items()), "event_type string, label string")
    d = T(spark, sf, "events").join(F.broadcast(m), "event_type", "left")  # as many rows as names above
    return d.select("event_id", F.coalesce("label", "event_type").alias("label"), F.col("label").isNotNull().alias("mapped"))


@query("j2_outer_counts", "WITH o AS (SELECT o_orderpriority AS category, o_orderstatus AS defect, count(*) AS n_items FROM orders WHERE o_orderkey % 10 < 5 GROUP BY 1, 2), m AS (SELECT o_orderpriority AS category, o_orderstatus AS defect, count(*) AS n_masks FROM orders WHERE o_orderkey % 10 >= 5 AND o_orderstatus <> 'F' GROUP BY 1, 2) SELECT category, defect, coalesce(n_items, 0) AS n_items, coalesce(n_masks, 0) AS n_masks FROM o FULL JOIN m USING (category, defect)")
def j2_outer_counts(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("defect"), "o_orderkey")
    items = o.where("o_orderkey % 10 < 5").groupBy("category", "defect").agg(F.count(F.lit(1)).alias("n_items"))
    masks = o.where("o_orderkey % 10 >= 5 and defect != 'F'").groupBy("category", "defect").agg(F.count(F.lit(1)).alias("n_masks"))
    return items.join(masks, ["category", "defect"], "outer").na.fill(0)


@query("j3_pivot_join", fx.sql("SELECT a.method, a.mean_score, b.n_test::DOUBLE AS n_test FROM (SELECT method, round(avg(score), 6) AS mean_score FROM event_scores GROUP BY method) a LEFT JOIN (SELECT method, count(*) AS n_test FROM event_scores WHERE split = 'test' AND method <> 'k' GROUP BY method) b USING (method)"))
def j3_pivot_join(spark, sf):
    s = fx.event_scores(spark, sf)
    a = s.groupBy("method").agg(F.round(F.avg("score"), 6).alias("mean_score"))
    return a.join(s.where("split = 'test' and method != 'k'").groupBy("method").agg(F.count(F.lit(1)).cast("double").alias("n_test")), "method", "left")


@query("j4_accuracy_latency", "SELECT event_type AS method, round(avg(value), 6) AS accuracy, round(n / 1000.0::DOUBLE, 6) AS mean_latency FROM events JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) USING (event_type) GROUP BY event_type, n")
def j4_accuracy_latency(spark, sf):
    e = T(spark, sf, "events")
    a = e.groupBy(F.col("event_type").alias("method")).agg(F.round(F.avg("value"), 6).alias("accuracy"))
    return a.join(e.groupBy(F.col("event_type").alias("method")).agg(F.round(F.count(F.lit(1)) / 1000.0, 6).alias("mean_latency")), "method")


@query("j5_membership", "SELECT o_orderkey AS item_id, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) AS hit FROM orders")
def j5_membership(spark, sf):
    keys = T(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("item_id")).distinct().withColumn("_hit", F.lit(True))
    return T(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id")).join(keys, "item_id", "left").select("item_id", F.coalesce("_hit", F.lit(False)).alias("hit"))


@query("j6_optional_lookup", "SELECT d.doc_id, l.quality::DOUBLE AS mask FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND d.lang <> 'en'")
def j6_optional_lookup(spark, sf):
    d, lab = T(spark, sf, "documents").select("doc_id", "lang"), T(spark, sf, "labels").select(F.col("doc_id").alias("_d"), F.col("quality").cast("double").alias("mask"))
    return d.join(lab, (d["doc_id"] == lab["_d"]) & (d["lang"] != "en"), "left").select("doc_id", "mask")


@query("j7_fallback_lookup", "WITH r AS (SELECT o_orderpriority AS c, o_orderstatus AS s, avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 10 < 5 AND o_orderstatus <> 'P' GROUP BY 1, 2), g AS (SELECT o_orderpriority AS c, avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 10 < 5 GROUP BY 1) SELECT o_orderkey AS item_id, round(coalesce(r.m, g.m), 4) AS bank FROM orders LEFT JOIN r ON r.c = o_orderpriority AND r.s = o_orderstatus LEFT JOIN g ON g.c = o_orderpriority")
def j7_fallback_lookup(spark, sf):
    """The bank of (category, region), and the category's where there is none."""
    o = T(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("c"), F.col("o_orderstatus").alias("s"), "o_totalprice")
    t = o.where("item_id % 10 < 5")
    fine, coarse = t.where("s != 'P'").groupBy("c", "s").agg(F.avg("o_totalprice").alias("_f")), t.groupBy("c").agg(F.avg("o_totalprice").alias("_g"))
    return o.join(fine, ["c", "s"], "left").join(coarse, "c", "left").select("item_id", F.round(F.coalesce("_f", "_g"), 4).alias("bank"))


@query("j8_gain_table", fx.sql("WITH a AS (SELECT method, avg(score) AS v1 FROM event_scores WHERE split = 'train' GROUP BY method), b AS (SELECT method, avg(score) AS v2 FROM event_scores WHERE split = 'test' GROUP BY method), n(old, new) AS (VALUES ('value', 'value'), ('hour', 'k')) SELECT old, new, round(v2 - v1, 4) AS gain FROM n JOIN a ON a.method = old JOIN b ON b.method = new"))
def j8_gain_table(spark, sf):
    s = fx.event_scores(spark, sf)
    n = spark.createDataFrame([("value", "value"), ("hour", "k")], "old string, new string")
    a = s.where("split = 'train'").groupBy(F.col("method").alias("old")).agg(F.avg("score").alias("v1"))
    b = s.where("split = 'test'").groupBy(F.col("method").alias("new")).agg(F.avg("score").alias("v2"))
    return a.join(n, "old").join(b, "new").select("old", "new", F.round(F.col("v2") - F.col("v1"), 4).alias("gain"))


@query("a1_counts", fx.sql("SELECT category, split, defect_type, count(*) AS n FROM order_items GROUP BY ALL"))
def a1_counts(spark, sf):
    return fx.order_items(spark, sf).groupBy("category", "split", "defect_type").agg(F.count(F.lit(1)).alias("n"))


@query("a2_audit_scorecard", "SELECT count(*) AS n_items, count(*) FILTER (WHERE n_chars <> length(text)) AS n_wrong_size, count(*) FILTER (WHERE n_chars < 20) AS n_small, count(*) FILTER (WHERE text IS NULL) AS n_corrupted, count(*) <> 1000 AS discrepancy FROM documents")
def a2_audit_scorecard(spark, sf):
    n = F.count(F.lit(1))
    return T(spark, sf, "documents").agg(n.alias("n_items"), F.count_if(F.col("n_chars") != F.length("text")).alias("n_wrong_size"), F.count_if(F.col("n_chars") < 20).alias("n_small"), F.count_if(F.col("text").isNull()).alias("n_corrupted"), (n != 1000).alias("discrepancy"))


#: Rows that a table must have, and for tables with keys from 1 without gaps, the key whose largest value says how many.
EXPECTED_ROWS = {"region": 5, "nation": 25}
DENSE_KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
_AUDITED = [(t, f"{n}::BIGINT") for t, n in EXPECTED_ROWS.items()] + [(t, f"max({k})::BIGINT") for t, k in DENSE_KEYS.items()]


@query("a2_expected_counts", " UNION ALL ".join(f"SELECT '{t}' AS field, {n} AS expected, count(*) AS found, count(*) <> {n} AS discrepancy FROM {t}" for t, n in _AUDITED))
def a2_expected_counts(spark, sf):
    """Found rows of each table against expected ones, with a flag where they differ."""
    expected = {t: F.lit(n).cast("long") for t, n in EXPECTED_ROWS.items()} | {t: F.max(k).cast("long") for t, k in DENSE_KEYS.items()}
    n = F.count(F.lit(1))
    found = [T(spark, sf, t).agg(e.alias("expected"), n.alias("found")).select(F.lit(t).alias("field"), "expected", "found", (F.col("found") != F.col("expected")).alias("discrepancy")) for t, e in expected.items()]
    return reduce(DataFrame.unionAll, found)


@query("a3_describe", "SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM events GROUP BY event_type")
def a3_describe(spark, sf):
    d = tb.describe(T(spark, sf, "events"), ["event_type"], "value")
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query("a4_group_stats", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2")
def a4_group_stats(spark, sf):
    return T(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


SPLITS = ["train", "validation", "test"]


@query("a7_split_pivot", fx.sql("SELECT category, " + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}" for s in SPLITS) + " FROM order_items GROUP BY category"))
def a7_split_pivot(spark, sf):
    return fx.order_items(spark, sf).groupBy("category").pivot("split", SPLITS).agg(F.count(F.lit(1))).na.fill(0)


@query("a8_totals_row", fx.sql("SELECT coalesce(category, 'total') AS category, " + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}" for s in SPLITS) + " FROM order_items GROUP BY ROLLUP (category)"))
def a8_totals_row(spark, sf):
    r = fx.order_items(spark, sf).rollup("category").agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    return r.withColumn("category", F.coalesce("category", F.lit("total")))


SEEDS = [42, 7, 2026]


@query("e13_multi_seed", fx.sql("SELECT seed, category, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT seed, category, value, row_number() OVER (PARTITION BY seed, category ORDER BY md5(item_id || '#' || seed), item_id) AS rn FROM event_items, (VALUES (42), (7), (2026)) AS s(seed) WHERE split = 'train') WHERE rn <= 100 GROUP BY seed, category"))
def e13_multi_seed(spark, sf):
    """A sampled stage for several seeds in one job: the seed is a key of the sample."""
    e = fx.event_items(spark, sf).where("split = 'train'").select("item_id", "category", "value").withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    order = F.md5(F.concat_ws("#", F.col("item_id").cast("string"), F.col("seed").cast("string")))
    rn = F.row_number().over(W.partitionBy("seed", "category").orderBy(order, "item_id"))
    s = e.withColumn("rn", rn).where("rn <= 100")
    return s.groupBy("seed", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("a9_seed_summary", fx.sql("WITH r AS (SELECT seed, category, avg(value) AS v FROM (SELECT seed, category, value, row_number() OVER (PARTITION BY seed, category ORDER BY md5(item_id || '#' || seed), item_id) AS rn FROM event_items, (VALUES (42), (7), (2026)) AS s(seed) WHERE split = 'train') WHERE rn <= 100 GROUP BY seed, category) SELECT category, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(DISTINCT seed) AS n_seeds, '[' || string_agg(seed, ',' ORDER BY seed) || ']' AS seeds FROM r GROUP BY category"))
def a9_seed_summary(spark, sf):
    e = fx.event_items(spark, sf).where("split = 'train'").select("item_id", "category", "value").withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    order = F.md5(F.concat_ws("#", F.col("item_id").cast("string"), F.col("seed").cast("string")))
    rn = F.row_number().over(W.partitionBy("seed", "category").orderBy(order, "item_id"))
    r = e.withColumn("rn", rn).where("rn <= 100").groupBy("seed", "category").agg(F.avg("value").alias("v"))
    return r.groupBy("category").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.count_distinct("seed").alias("n_seeds"), F.to_json(F.array_sort(F.collect_list("seed"))).alias("seeds"))


@query("a10_distinct", "SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source")
def a10_distinct(spark, sf):
    return T(spark, sf, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count_distinct("lang").alias("n_langs"))


@query("a11_modal_value", "SELECT p_brand AS category, p_size AS size FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS rn FROM part GROUP BY p_brand, p_size) WHERE rn = 1")
def a11_modal_value(spark, sf):
    return T(spark, sf, "part").groupBy(F.col("p_brand").alias("category")).agg(F.mode("p_size", True).alias("size"))


@query("a12_tagged_union", "SELECT 'orders' AS source, o_orderkey AS id, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS lang FROM orders UNION ALL SELECT 'documents', doc_id, NULL, lang FROM documents")
def a12_tagged_union(spark, sf):
    a = T(spark, sf, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    b = T(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "lang")
    return a.unionByName(b, allowMissingColumns=True)


@query("e14_ablation_registry", "SELECT candidate, n, n = max(n) OVER () AS selected, 'most rows' AS policy FROM (SELECT event_type AS candidate, count(*) AS n FROM events GROUP BY event_type)")
def e14_ablation_registry(spark, sf):
    n = T(spark, sf, "events").groupBy(F.col("event_type").alias("candidate")).agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.max("n").alias("_top"))
    return n.join(F.broadcast(top)).select("candidate", "n", (F.col("n") == F.col("_top")).alias("selected"), F.lit("most rows").alias("policy"))  # top: one row


TOPS = {"top1": 0.01, "top5": 0.05, "top10": 0.1, "mx": "max", "mean": "mean"}
BAG = "bag AS (SELECT item_id, {s} AS s, row_number() OVER (PARTITION BY item_id ORDER BY {s} DESC) AS rn, count(*) OVER (PARTITION BY item_id) AS n FROM order_patches)"


@query("w2_top_fraction", fx.sql("WITH " + BAG.format(s="price") + " SELECT item_id, " + ", ".join(f"round(avg(s) FILTER (WHERE rn <= greatest(1, ceil(n * {p}::DOUBLE))) + 1e-6, 4) AS {k}" for k, p in TOPS.items() if isinstance(p, float)) + ", round(max(s) + 1e-6, 4) AS mx, round(avg(s) + 1e-6, 4) AS mean FROM bag GROUP BY item_id"))
def w2_top_fraction(spark, sf):
    return tb.top_fraction(fx.order_patches(spark, sf), "item_id", "price", TOPS).select("item_id", *[F.round(F.col(k) + 1e-6, 4).alias(k) for k in TOPS])


@query("w3_top_fraction_floor", fx.sql("WITH " + BAG.format(s="quantity") + " SELECT item_id, round(avg(s) FILTER (WHERE rn <= greatest(1, floor(n * 0.5::DOUBLE))), 6) AS top50 FROM bag GROUP BY item_id"))
def w3_top_fraction_floor(spark, sf):
    return tb.top_fraction(fx.order_patches(spark, sf), "item_id", "quantity", {"top50": 0.5}, floor=True).select("item_id", F.round("top50", 6).alias("top50"))


@query("w4_representatives", fx.sql("SELECT category, defect_type, item_id FROM (SELECT *, row_number() OVER (PARTITION BY category, defect_type ORDER BY CASE WHEN defect_type = 'good' THEN value ELSE -value END, item_id) AS rn, count(*) OVER (PARTITION BY category, defect_type) AS n FROM event_items WHERE split = 'test') WHERE rn = CASE WHEN defect_type = 'good' THEN 1 ELSE 1 + n // 2 END"))
def w4_representatives(spark, sf):
    e = fx.event_items(spark, sf).where("split = 'test'").withColumn("score", F.col("value"))
    return tb.representatives(e).select("category", "defect_type", "item_id")


@query("w6_map_budget", fx.sql("SELECT category, item_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY item_id) AS rn FROM order_items WHERE split = 'test') WHERE rn <= 25"))
def w6_map_budget(spark, sf):
    return tb.head(fx.order_items(spark, sf).where("split = 'test'"), ["category"], "item_id", 25).select("category", "item_id")
