"""Scoring a stream of items against fixed normalisation and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout


def once(items: DataFrame, item: str = "item_id", time: str = "ts", late: int = 600, buckets: int = 1024) -> DataFrame:
    """Rows of a stream without those whose item came before.

    Items are dealt to buckets by hash. A bucket's state is the items whose time is at most `late` seconds before the newest time
    that the bucket has seen, so state grows with the items of such a span, not with the stream. Rows of any time pass,
    in whatever order they come; a copy of an item that the state no longer holds passes too. Of copies in one micro-batch
    any one stays. Rows with a null item are no copies of each other; an item with a null time is not remembered.
    Numbers that are NaN come out as null, and whole numbers beside nulls are exact up to 2**53 (the item's are exact always).
    items has no column `bucket`. Repeats within a batch of rows go before the shuffle, so an item with a
    third of all rows sends a row a batch.
    """
    kind, clock = items.schema[item].dataType, items.schema[time].dataType
    names = items.columns
    bucket = F.when(F.col(item).isNull(), F.xxhash64(*names)).otherwise(F.xxhash64(item))
    d = items.withColumn("bucket", F.pmod(bucket, F.lit(buckets))).withColumns({item: F.col(item).cast("string"), time: F.unix_micros(F.col(time).cast("timestamp"))})
    dealt = d.schema
    wide = d.select(*names).schema
    span = late * 1_000_000

    def lone(batches):
        for b in batches:
            yield b[b[item].isna() | ~b.duplicated(item)]

    def unseen(key, frames, state):
        ids, times = state.get if state.exists else ([], [])
        held = dict(zip(ids, times))
        for f in frames:
            f = f[names]
            new = f[f[item].isna() | ~(f.duplicated(item) | f[item].isin(held.keys()))]
            timed = new[new[item].notna() & new[time].notna()]
            held.update(zip(timed[item].tolist(), timed[time].astype("int64").tolist()))
            if held:
                oldest = max(held.values()) - span
                held = {k: t for k, t in held.items() if t >= oldest}
            if len(new):
                yield new.astype({time: "Int64"})
        state.update((list(held), list(held.values())))

    state = T.StructType([T.StructField("items", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.LongType()))])
    d = d.mapInPandas(lone, dealt).groupBy("bucket").applyInPandasWithState(unseen, wide, state, "append", GroupStateTimeout.NoTimeout)
    return d.withColumns({item: F.col(item).cast(kind), time: F.timestamp_micros(time).cast(clock)})


def scored_stream(items: DataFrame, stats: DataFrame, item: str = "item_id", time: str = "ts", late: int = 600, buckets: int = 1024) -> DataFrame:
    """items (item, time, category, score) as a stream: z, and whether it reaches the category's threshold.

    stats (category, mean, std, threshold) is a static table; items of a category without stats are normal. Of an item
    that comes again within `late` seconds of event time one row stays (`once`).
    """
    d = items.join(stats, "category", "left")
    z = (F.col("score") - F.col("mean")) / (F.coalesce("std", F.lit(0.0)) + 1e-8)
    return once(d.select(item, time, "category", "score", z.alias("z"), F.coalesce(z >= F.col("threshold"), F.lit(False)).alias("anomaly")), item, time, late, buckets)


def first_copies(scored: DataFrame, item: str = "item_id", time: str = "ts") -> DataFrame:
    """One row an item, its earliest, of a table that a stream wrote: copies too far apart for the stream's state go here.
    Rows with a null item all stay."""
    order = [time, *[c for c in scored.columns if c not in (item, time)]]
    key = F.when(F.col(item).isNull(), F.monotonically_increasing_id())
    d = scored.groupBy(item, key.alias("lone")).agg(F.min(F.struct(*order)).alias("r"))
    return d.select(*[item if c == item else F.col(f"r.{c}").alias(c) for c in scored.columns])


def windowed_rates(scored: DataFrame, time: str = "ts", width: str = "1 hour") -> DataFrame:
    """Anomaly counts by category in windows of event time; scored must carry a watermark when it is a stream."""
    w = F.window(time, width)
    return scored.groupBy(w.alias("w"), "category").agg(F.count(F.lit(1)).alias("n"), F.count_if("anomaly").alias("n_anomaly")).select(F.col("w.start").alias("window_start"), "category", "n", "n_anomaly")
