"""Mixing sources to target weights (DataFrame functions only).

Targets are found by filling by weight below each source's cap: every round gives the sources that are not full their
share of what is left, until none is above its cap.

Every document has a place u in a pseudo-random permutation of its source, and ranges of places are blocks. A source
whose target is r times its size draws all its blocks floor(r) times, and then blocks in order of place as long as they
fit; from the next block, its last, come the documents that still fit. So the target is an exact quota of blocks. A
splitting tree deals these quotas to the output shards: at every node the left half of the shards gets a multivariate
hypergeometric draw of the node's blocks, source by source. Its leaves say which blocks, in order of place, go to which
shard, so all shards hold the sources in nearly the target mix and no two draw the same copy of a block. A document is
taken as often as its block was drawn. Within a shard the documents are shuffled by a hash.

Sources stay rows of tables: the tree sees groups of about the root of their number, first as wholes, then one by one.
Numbers of blocks and shards follow from the counted documents and words.

Null and empty texts have size 0; they are taken as often as their block, and in a last block always. Null sources are
one source, ordered last. Rows with equal doc_id and text share a place and are taken alike, others with equal doc_ids
are not. Very long texts count as any other; a document that is larger than what is left of a target is not taken for it.
Ties of places go by size. Other columns do not matter to the mix. An empty table gives no rows. Equal inputs give equal
results: all choices are hashes of doc_id, text, source and seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddlens.llm.common import n_words, with_few, written

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
#: Shards at least, and words of a shard beyond that.
SHARDS, SHARD_WORDS = 16, 100_000_000
#: Blocks of all sources together, about, until a block has BLOCK_DOCS documents.
BLOCKS, BLOCK_DOCS = 4096, 512
SEED = 20240501
BITS = 62
#: Rows that one task orders: sources by name, blocks of a source.
RUN = 8192


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size), written: with weight and target. The total is TOTAL_SHARE of all sizes, shared by weight below the caps."""
    count, total = sizes.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    by_name = F.col("source").asc_nulls_last()
    # ranks over ranges of names: within each range, plus the sources of the ranges before
    ranged = written(sizes.repartitionByRange(count // RUN + 1, by_name).withColumn("_p", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each RUN sources
    rank = F.row_number().over(W.partitionBy("_p").orderBy(by_name)) - 1
    t = ranged.withColumn("_i", rank).join(before.hint("merge"), "_p").withColumn("_i", F.col("_i") + F.col("_before")).drop("_p", "_before")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_i") % len(WEIGHTS) + 1).cast("int")).cast("double")
    t = written(t.select("source", "source_size", weight.alias("weight"), (F.lit(float(MAX_REPEATS)) * F.col("source_size")).alias("cap")), "weights")
    level, last = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        n, caps, weights = t.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == last or not weights:
            break
        last, level = n, max(level, (TOTAL_SHARE * total - (caps or 0.0)) / weights)
    return t.select("source", "source_size", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def place(doc_id: Column, text: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 64 - BITS)


def _block(u: Column, n_blocks: Column) -> Column:
    return F.least(n_blocks - 1, F.floor(u / float(1 << BITS) * n_blocks)).cast("long")


def _whole_blocks(sums: DataFrame) -> DataFrame:
    """sums (source, block, extra, _s): rows (source, n_whole, left) with the number of first blocks whose sizes stay
    within extra, and what is left of it. Sums run over ranges of RUN blocks, then within the range where they pass."""
    d = sums.withColumn("_range", F.floor(F.col("block") / RUN))
    part = d.groupBy("source", "_range").agg(F.sum("_s").alias("_s"), F.first("extra").alias("extra"))
    up = F.sum("_s").over(W.partitionBy("source").orderBy("_range"))
    part = part.withColumn("_end", up).where(F.col("_end") - F.col("_s") <= F.col("extra"))
    at = part.groupBy("source").agg(F.max("_range").alias("_at"), F.max(F.col("_end") - F.col("_s")).alias("_start"))
    at = written(at.withColumnRenamed("source", "_source"), "ranges")
    d = d.join(at.hint("merge"), d["source"].eqNullSafe(at["_source"]) & (d["_range"] == at["_at"])).drop("_source")
    up = F.sum("_s").over(W.partitionBy("source").orderBy("block")) + F.col("_start")
    d = d.withColumn("_end", up)
    fits = F.col("_end") <= F.col("extra")
    return d.groupBy("source").agg(
        F.coalesce(F.max(F.when(fits, F.col("block") + 1)), F.min("block")).alias("n_whole"),
        (F.first("extra") - F.coalesce(F.max(F.when(fits, F.col("_end"))), F.first("_start"))).alias("left"),
    )


def _fitting(places: DataFrame) -> DataFrame:
    """places (source, left, u, _s) of last blocks, a few hundred rows a source: rows (source, u) of those that are taken,
    in order of place as long as they fit."""
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<bigint>").alias("us"))

    def step(s: Column, x: Column) -> Column:
        ok = x["s"] <= s["left"]
        return F.struct(F.when(ok, s["left"] - x["s"]).otherwise(s["left"]).alias("left"), F.when(ok, F.concat(s["us"], F.array(x["u"]))).otherwise(s["us"]).alias("us"))

    g = places.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.col("u").alias("u"), F.col("_s").alias("s")))).alias("c"), F.first("left").alias("left"))
    return g.select("source", F.explode(F.aggregate("c", start, step)["us"]).alias("u"))


def _hypergeometric(pop: Column, good: Column, draws: Column, u: Column) -> Column:
    """The draw at quantile u: how many of `draws` out of `pop` are among `good`. Weights are summed from their logarithms."""
    lo, hi = F.greatest(F.lit(0).cast("long"), draws + good - pop), F.least(draws, good)
    steps = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))

    def step(log_p: Column, k: Column) -> Column:
        up = (good - k) * (draws - k)
        down = (k + 1) * (pop - good - draws + k + 1)
        return log_p + F.log(up.cast("double") / down)

    top = F.aggregate(steps, F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("m")), lambda s, k: F.struct(step(s["l"], k).alias("l"), F.greatest(s["m"], step(s["l"], k)).alias("m")))["m"]

    def draw(peak: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("l"), F.exp(-peak).alias("t"))
        total = F.aggregate(steps, start, lambda s, k: F.struct(step(s["l"], k).alias("l"), (s["t"] + F.exp(step(s["l"], k) - peak)).alias("t")))["t"]
        start = F.struct(F.lit(0.0).alias("l"), F.exp(-peak).alias("t"), F.lit(0).cast("long").alias("n"))
        below = lambda s: s["n"] + F.when(s["t"] < u * total, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        done = F.aggregate(steps, start, lambda s, k: F.struct(step(s["l"], k).alias("l"), (s["t"] + F.exp(step(s["l"], k) - peak)).alias("t"), below(s).alias("n")))
        return F.least(hi, lo + done["n"])

    return F.transform(F.array(top), draw)[0]


def _tree(groups: DataFrame, shards: int, seed: int) -> DataFrame:
    """groups (g, c, q): c an array of (id, n), q the exact quota of each shard. Rows (g, shard, id, n): each level halves
    the shards of every node, and deals the node's blocks by a multivariate hypergeometric draw."""
    nodes = groups.select("g", F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "c", "q")
    for _ in range((shards - 1).bit_length()):
        mid = F.when(F.col("hi") - F.col("lo") > 1, F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")).otherwise(F.col("hi"))
        zero = F.lit(0).cast("long")
        nodes = nodes.withColumn("mid", mid).withColumns({"total": F.aggregate("c", zero, lambda a, x: a + x["n"]), "ql": F.slice("q", F.lit(1), F.col("mid") - F.col("lo"))})
        share = F.aggregate("ql", zero, lambda a, x: a + x)
        quantile = lambda s: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("g"), F.col("lo"), F.col("hi"), s), 12) / float(1 << 52)

        def drawn(s: Column, x: Column) -> Column:
            k = _hypergeometric(s["pop"], x["n"], s["draws"], quantile(x["id"]))
            return F.transform(F.array(k), lambda v: F.struct((s["pop"] - x["n"]).alias("pop"), (s["draws"] - v).alias("draws"), F.concat(s["left"], F.array(v)).alias("left")))[0]

        start = F.struct(F.col("total").alias("pop"), share.alias("draws"), F.array().cast("array<bigint>").alias("left"))
        nodes = nodes.withColumn("left", F.aggregate("c", start, drawn)["left"])
        some = lambda c: F.filter(c, lambda x: x["n"] > 0)
        halves = F.array(
            F.struct("lo", F.col("mid").alias("hi"), some(F.transform("c", lambda x, i: F.struct(x["id"].alias("id"), F.get(F.col("left"), i).alias("n")))).alias("c"), F.col("ql").alias("q")),
            F.struct(F.col("mid").alias("lo"), "hi", some(F.transform("c", lambda x, i: F.struct(x["id"].alias("id"), (x["n"] - F.get(F.col("left"), i)).alias("n")))).alias("c"), F.slice("q", F.col("mid") - F.col("lo") + 1, F.greatest(F.col("hi") - F.col("mid"), F.lit(0))).alias("q")),
        )
        nodes = nodes.select("g", F.explode(halves).alias("h")).select("g", "h.lo", "h.hi", "h.c", "h.q").where("hi > lo and size(c) > 0")
        nodes = written(nodes, "node")
    return nodes.select("g", F.col("lo").alias("shard"), F.explode("c").alias("x")).select("g", "shard", "x.id", "x.n")


def split_tree(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """counts (source, blocks), written: rows (shard, source, quota) of the quotas above 0. All shards get nearly equally
    many blocks."""
    n_sources, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocks"), F.lit(0)).cast("long")).first()
    n_groups = int(n_sources**0.5) // 8 + 1
    item = lambda name: F.struct(F.col(name).alias("id"), F.col("blocks").cast("long").alias("n"))
    groups = counts.where("blocks > 0").groupBy(F.pmod(F.xxhash64("source"), F.lit(n_groups)).alias("g")).agg(F.array_sort(F.collect_list(item("source"))).alias("c"), F.sum("blocks").cast("long").alias("blocks"))
    groups = written(groups, "groups")
    equal = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (F.floor(F.lit(total) * (s + 1) / shards) - F.floor(F.lit(total) * s / shards)).cast("long"))
    whole = groups.agg(F.array_sort(F.collect_list(item("g"))).alias("c")).select(F.lit(-1).cast("long").alias("g"), "c", equal.alias("q")).where("size(c) > 0")
    of_groups = _tree(whole, shards, seed).groupBy(F.col("id").alias("_g")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("_m"))
    quotas = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.try_element_at("_m", s), F.lit(0).cast("long")))
    groups = groups.join(of_groups.hint("merge"), groups["g"] == of_groups["_g"]).select("g", "c", quotas.alias("q"))
    return _tree(groups, shards, seed).select("shard", F.col("id").alias("source"), F.col("n").alias("quota"))


def mix_plan(sized: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """sized (source, size, u), written: the plan of each source (source_size, target, n_blocks), the shards of each drawn
    (source, block), the places (source, u) that are taken from last blocks with their shard, and the number of shards."""
    sizes = written(sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "sizes")
    n_docs, words = sizes.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    shards = max(SHARDS, int(TOTAL_SHARE * words) // SHARD_WORDS)
    t = with_few(targets(sizes.select("source", "source_size")), sizes.select("source", "n_docs"), ["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0))
    t = t.withColumn("copies", F.floor(ratio + 1e-9).cast("long")).withColumn("extra", F.when(F.col("copies") < MAX_REPEATS, extra).otherwise(F.lit(0.0)))
    t = written(t.withColumn("n_blocks", F.ceil(F.col("n_docs") / min(max(n_docs // BLOCKS, 4), BLOCK_DOCS)).cast("long")), "targets")
    placed = lambda few: with_few(sized, few, ["source"], "inner").withColumn("block", _block(F.col("u"), F.col("n_blocks")))
    some = t.where("extra > 0").select("source", "extra", "n_blocks")
    sums = written(placed(some).groupBy("source", "block").agg(F.sum("size").alias("_s"), F.first("extra").alias("extra")), "sums")
    last = written(_whole_blocks(sums), "last")
    t = with_few(t, last, ["source"]).withColumns({"n_whole": F.coalesce("n_whole", F.lit(0).cast("long")), "n_last": (F.col("n_whole") < F.col("n_blocks")).cast("long")})
    plan = written(t.withColumn("units", F.col("copies") * F.col("n_blocks") + F.col("n_whole") + F.when(F.col("left").isNotNull(), F.col("n_last")).otherwise(F.lit(0))), "plan")
    ends = plan.where("left is not null and n_last = 1").select("source", "n_blocks", "left", "n_whole")
    places = placed(written(ends, "ends")).where("block = n_whole").groupBy("source", "u").agg(F.sum("size").alias("_s"), F.first("left").alias("left"))
    fitting = written(_fitting(places), "fitting")
    # the leaves of the tree deal each source's blocks, copy after copy and in order of place
    quotas = split_tree(written(plan.select("source", F.col("units").alias("blocks")), "counts"), shards, seed)
    end = F.sum("quota").over(W.partitionBy("source").orderBy("shard"))  # at most a row a shard
    runs = quotas.withColumn("_end", end).select("source", "shard", F.explode(F.sequence(F.col("_end") - F.col("quota"), F.col("_end") - 1)).alias("unit"))
    drawn = with_few(written(runs, "runs"), plan.select("source", "n_blocks", "copies", "n_whole"), ["source"])
    epoch = F.floor(F.col("unit") / F.col("n_blocks"))
    drawn = written(drawn.withColumns({"_epoch": epoch, "block": F.pmod("unit", "n_blocks")}).withColumn("_last", F.col("unit") == F.col("copies") * F.col("n_blocks") + F.col("n_whole")), "drawn")
    table = drawn.where("not _last").groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("_epoch", "shard"))), lambda x: x["shard"]).alias("_shards"))
    chosen = with_few(fitting, drawn.where("_last").select("source", F.col("shard").alias("_more")), ["source"], "inner")
    return plan, written(table, "shards"), written(chosen, "chosen"), shards


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, text): rows (doc_id, source, size, u)."""
    return docs.select("doc_id", "source", n_words(docs["text"]).alias("size"), place(docs["doc_id"], docs["text"], seed).alias("u"))


def mixed(rows: DataFrame, plan: DataFrame, table: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, u, ...) with source_size, target, taken and the shards of their copies."""
    out = with_few(rows, plan.select("source", "source_size", "target", "n_blocks"), ["source"])
    out = with_few(out.withColumn("block", _block(F.col("u"), F.col("n_blocks"))), table, ["source", "block"])
    out = with_few(out, chosen, ["source", "u"])
    none = F.array().cast("array<int>")
    shards = F.concat(F.coalesce("_shards", none), F.when(F.col("_more").isNotNull(), F.array("_more")).otherwise(none))
    return out.withColumn("shards", shards).withColumn("taken", F.size("shards") * F.col("size")).drop("n_blocks", "_shards", "block", "_more")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = written(sized(docs), "sized")
    plan, table, chosen, _ = mix_plan(rows.select("source", "size", "u"))
    return mixed(rows, plan, table, chosen).select("doc_id", "size", "source_size", "target", "taken", "shards")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy taken: the columns of docs, then shard and shard_order (the place within the shard). Every
    partition holds its rows of a shard together and shuffled. Underscores follow the two names where docs has such columns."""
    rows = written(sized(docs), "sized")
    plan, table, chosen, _ = mix_plan(rows.select("source", "size", "u"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    slim = whole.select(F.col("_doc.source").alias("source"), n_words(F.col("_doc.text")).alias("size"), place(F.col("_doc.doc_id"), F.col("_doc.text"), SEED).alias("u"), "_doc")
    out = mixed(slim, plan, table, chosen).select("_doc", "u", F.posexplode("shards").alias("_epoch", "_shard"))
    out = out.withColumn("_order", F.xxhash64(F.lit(SEED), F.lit("order"), "u", "_epoch"))
    out = out.sortWithinPartitions("_shard", "_order")
    taken = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in taken else free(name + "_")
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns], F.col("_shard").alias(free("shard")), F.col("_order").alias(free("shard_order")))
