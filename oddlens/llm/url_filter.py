"""URL filters as a temporal list join (DataFrame functions only).

List entries (kind, pattern, action, listed_at) say from when a host, a domain or a section of a host (host and first
path segment) is blocked or allowed. The entries of one pattern become validity intervals, each open until the next
entry. A capture asks for its section, its host, and the domains that it belongs to: the host itself, unless it has one
label only, and its parents down to two labels. Captures and intervals of a pattern are put in one order of time, and
the last interval before a capture is its as-of match. A pattern with many captures is dealt to several tasks, each of
which gets its intervals. The most specific match decides. Entries of one pattern and one time count once, and `block`
wins. A capture without a match is not blocked.

Null, empty or odd URLs have no host and match nothing; captures without a fetch time match nothing. An entry counts from
its very time. Repeated captures and repeated entries change nothing for others. URLs of any length are read whole.
Columns other than those named are not looked at. Empty lists block nothing; empty captures give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddlens.llm.common import with_few, written

#: From the least to the most specific.
KINDS = ("domain", "host", "section")
#: Captures of one pattern that one task orders by time.
RUN = 100_000
#: Query data: captures are fetched, and lists are dated, within a year from here.
EPOCH, SPAN = "2024-01-01 00:00:00", 365 * 86400


def host_of(url: Column) -> Column:
    """Lower-cased host without user and port; null if there is none."""
    raw = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(raw != "", raw)


def section_of(url: Column) -> Column:
    """Host and first path segment, such as `a.org/news`; null without either."""
    first = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)", 1)
    return F.when(first != "", F.concat(host_of(url), F.lit("/"), first))


def keys_of(url: Column) -> Column:
    """Array of (rank, kind, pattern) that a URL may match; domains are the host and its parents down to two labels."""
    labels = F.split(host_of(url), r"\.")
    parents = F.transform(
        F.when(F.size(labels) > 1, F.sequence(F.lit(1), F.size(labels) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct((-i).alias("rank"), F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")),
    )
    host = F.struct(F.lit(1).alias("rank"), F.lit("host").alias("kind"), host_of(url).alias("pattern"))
    section = F.struct(F.lit(2).alias("rank"), F.lit("section").alias("kind"), section_of(url).alias("pattern"))
    return F.filter(F.concat(F.coalesce(parents, F.array().cast("array<struct<rank:int,kind:string,pattern:string>>")), F.array(host, section)), lambda k: k["pattern"].isNotNull())


def intervals(entries: DataFrame) -> DataFrame:
    """Rows (kind, pattern, valid_from, valid_to, action); valid_to is null where no later entry of the pattern follows."""
    one = entries.where("kind is not null and pattern is not null and listed_at is not null").groupBy("kind", "pattern", "listed_at").agg(F.max("action").alias("action"))
    by = W.partitionBy("kind", "pattern").orderBy("listed_at")
    return one.select("kind", "pattern", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(by).alias("valid_to"), "action")


def url_filter(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """captures (key, url, fetched_at): each with blocked, kind, pattern and listed_at of the deciding entry. key must tell rows apart; rows with equal key, url and time share a row."""
    base = captures.groupBy(F.col(key).alias("_id"), "url", "fetched_at").agg(F.count(F.lit(1)).alias("_n"))
    spans = written(intervals(entries), "intervals")
    asked = base.select("_id", "url", "fetched_at", F.explode(keys_of(F.col("url"))).alias("k")).select("_id", "url", "fetched_at", "k.rank", "k.kind", "k.pattern").where("fetched_at is not null")
    listed = written(spans.select("kind", "pattern").distinct(), "patterns")
    asked = written(with_few(asked, listed, ["kind", "pattern"], "inner"), "asked")
    salts = written(asked.groupBy("kind", "pattern").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("_salts")), "salts")
    asked = with_few(asked, salts, ["kind", "pattern"]).withColumn("_salt", F.pmod(F.xxhash64("_id", "url", "fetched_at"), F.col("_salts")).cast("int"))
    spans = with_few(spans, salts, ["kind", "pattern"], "inner").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    span = F.struct("valid_from", "valid_to", "action")
    none = F.lit(None).cast(spans.select(span.alias("s")).schema["s"].dataType)
    line = spans.select("kind", "pattern", "_salt", F.col("valid_from").alias("_at"), F.lit(0).alias("_turn"), span.alias("s"), *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in ("_id", "url", "fetched_at")], F.lit(None).cast("int").alias("rank"))
    line = line.unionAll(asked.select("kind", "pattern", "_salt", F.col("fetched_at").alias("_at"), F.lit(1).alias("_turn"), none.alias("s"), "_id", "url", "fetched_at", "rank"))
    by = W.partitionBy("kind", "pattern", "_salt").orderBy("_at", "_turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = line.withColumn("s", F.last("s", ignorenulls=True).over(by)).where("_turn = 1 and s is not null and (s.valid_to is null or fetched_at < s.valid_to)")
    best = found.groupBy("_id", "url", "fetched_at").agg(F.max_by(F.struct("kind", "pattern", F.col("s.valid_from").alias("listed_at"), F.col("s.action").alias("action")), "rank").alias("b"))
    best = best.withColumnsRenamed({"_id": "_b_id", "url": "_b_url", "fetched_at": "_b_at"})
    same = base["_id"].eqNullSafe(best["_b_id"]) & base["url"].eqNullSafe(best["_b_url"]) & base["fetched_at"].eqNullSafe(best["_b_at"])
    out = base.join(best.hint("merge"), same, "left").withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return out.select(F.col("_id").alias(key), "url", "fetched_at", F.coalesce(F.col("b.action") == "block", F.lit(False)).alias("blocked"), "b.kind", "b.pattern", "b.listed_at")


def fetch_time(page_id: Column) -> Column:
    """The fetch time of a page, spread over the year by its id."""
    return F.timestamp_add("SECOND", F.pmod(page_id * 7919, F.lit(SPAN)), F.lit(EPOCH).cast("timestamp_ntz"))


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture of each page."""
    return pages.select("page_id", "url", fetch_time(F.col("page_id")).alias("fetched_at"))


def entries_of(captures: DataFrame) -> DataFrame:
    """Dated entries that follow the captured hosts: by the first hex digits of a pattern's md5, about half of all patterns get one entry or two."""
    day = lambda h, i: F.timestamp_add("DAY", F.conv(F.substring(h, i, 3), 16, 10).cast("int") % 365, F.lit(EPOCH).cast("timestamp_ntz"))
    patterns = captures.select(F.explode(keys_of(F.col("url"))).alias("k")).select("k.kind", "k.pattern").distinct().withColumn("h", F.md5(F.concat_ws(":", "kind", "pattern")))
    first = F.struct(F.when(F.substring("h", 1, 1) < "6", "block").otherwise("allow").alias("action"), day(F.col("h"), 3).alias("listed_at"))
    second = F.struct(F.when(F.substring("h", 2, 1) < "8", "allow").otherwise("block").alias("action"), day(F.col("h"), 6).alias("listed_at"))
    return patterns.where(F.substring("h", 1, 1) < "9").select("kind", "pattern", F.explode(F.array(first, second)).alias("e")).select("kind", "pattern", "e.action", "e.listed_at")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    captures = captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    entries = written(entries_of(captures), "entries")
    return url_filter(captures, entries).drop("fetched_at")


ORACLE = r"""
WITH c AS (SELECT page_id, url, make_timestamp((1704067200 + (page_id * 7919) % 31536000) * 1000000) AS t,
  nullif(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
  nullif(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)', 1), '') AS seg FROM pages),
k AS (SELECT page_id, url, t, 1 AS rank, 'host' AS kind, host AS pattern FROM c WHERE host IS NOT NULL
  UNION ALL SELECT page_id, url, t, 2, 'section', host || '/' || seg FROM c WHERE host IS NOT NULL AND seg IS NOT NULL
  UNION ALL SELECT page_id, url, t, -i, 'domain', array_to_string(string_split(host, '.')[i:], '.') FROM c, unnest(range(1, len(string_split(host, '.')))) AS u(i) WHERE host IS NOT NULL),
p AS (SELECT DISTINCT kind, pattern, md5(kind || ':' || pattern) AS h FROM k),
e AS (SELECT kind, pattern, CASE WHEN h[1:1] < '6' THEN 'block' ELSE 'allow' END AS action, make_timestamp((1704067200 + ('0x' || h[3:5])::BIGINT % 365 * 86400) * 1000000) AS f FROM p WHERE h[1:1] < '9'
  UNION ALL SELECT kind, pattern, CASE WHEN h[2:2] < '8' THEN 'allow' ELSE 'block' END, make_timestamp((1704067200 + ('0x' || h[6:8])::BIGINT % 365 * 86400) * 1000000) FROM p WHERE h[1:1] < '9'),
one AS (SELECT kind, pattern, f, max(action) AS action FROM e GROUP BY kind, pattern, f),
iv AS (SELECT *, lead(f) OVER (PARTITION BY kind, pattern ORDER BY f) AS until FROM one),
m AS (SELECT page_id, url, t, arg_max(struct_pack(kind := k.kind, pattern := k.pattern, f := f, action := action), rank) AS b
  FROM k JOIN iv ON k.kind = iv.kind AND k.pattern = iv.pattern AND f <= t AND (until IS NULL OR t < until) GROUP BY page_id, url, t)
SELECT c.page_id, c.url, coalesce(b.action = 'block', false) AS blocked, b.kind AS kind, b.pattern AS pattern, b.f AS listed_at
FROM c LEFT JOIN m ON c.page_id IS NOT DISTINCT FROM m.page_id AND c.url IS NOT DISTINCT FROM m.url
"""
