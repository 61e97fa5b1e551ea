"""Queries that run as streams over a table's files until all of it is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddlens.operators.evaluation import quantile
from oddlens.plans import fixtures as fx
from oddlens.plans.registry import query
from oddlens.sources.shared import beside, fresh, written
from oddlens.streaming.scoring import first_copies, scored_stream, windowed_rates

LATE = 3600


@query("x1_stream_scoring", fx.sql("WITH st AS (SELECT category, avg(value) AS m, stddev_samp(value) AS s FROM event_items WHERE split = 'validation' GROUP BY category), z AS (SELECT category, split, (value - m) / (s + 1e-8) AS z FROM event_items JOIN st USING (category)), t AS (SELECT category, quantile_cont(z, 0.9) AS t FROM z WHERE split = 'validation' GROUP BY category) SELECT date_trunc('hour', ts) AS window_start, event_type AS category, count(*) AS n, count(*) FILTER (WHERE (value - m) / (s + 1e-8) >= t) AS n_anomaly FROM events JOIN st ON st.category = event_type JOIN t ON t.category = event_type GROUP BY 1, 2"))
def x1_stream_scoring(spark, sf):
    """Events scored as a stream against validation statistics; hourly anomaly counts, written file by file.

    The statistics are written once. Sums of doubles differ in the last digit from run to run, and values equal to the threshold, which
    usually is a value that many events have, would fall on either side of it if mean and deviation were computed anew.
    """
    e = fx.event_items(spark, sf)
    v = written(e.where("split = 'validation'").groupBy("category").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")), "moments")
    z = e.where("split = 'validation'").join(v, "category").withColumn("z", (F.col("value") - F.col("mean")) / (F.col("std") + 1e-8))
    stats = written(v.join(beside(quantile(z, ["category"], "z", 0.9, "threshold")), "category"), "stats")
    out = fresh(spark, "stream")
    schema = fx.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/events*.parquet")
    items = stream.select(F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"), F.col("value").alias("score"))
    scored = scored_stream(items, stats, late=LATE)
    q = scored.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(scored.schema).parquet(f"{out}/rows")
    return windowed_rates(first_copies(rows)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
