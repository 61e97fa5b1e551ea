"""A table of more files than a micro-batch takes, in no order of time, replayed as a stream."""

import duckdb
from conftest import rows_of
from pyspark.sql import functions as F

from oddlens.operators.evaluation import quantile
from oddlens.plans import registry
from oddlens.streaming.scoring import first_copies, once, scored_stream


def test_replay_of_many_files(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").repartition(150).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for t in ("orders", "lineitem", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = registry.QUERIES["x1_stream_scoring"](spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(c.sql(registry.ORACLES["x1_stream_scoring"]).df())


def test_state_is_bounded(spark, tmp_path):
    """100 files in order of time, a second of 10 ids each: the state holds the ids of one span, copies inside it go, others pass."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    t0 = 1_700_000_000_000_000
    os.mkdir(tmp_path / "in")
    for n in range(100):
        ids = [n * 10 + k for k in range(10)] + [max(0, n - 1) * 10, None, None] + ([0] if n == 99 else [])
        micros = [t0 + n * 1_000_000] * len(ids)
        t = pa.table({"item_id": pa.array(ids, pa.int64()), "ts": pa.array(micros, pa.timestamp("us", "UTC")), "category": ["a"] * len(ids), "score": pa.array([2.0] * len(ids))})
        pq.write_table(t, tmp_path / "in" / f"{n:03}.parquet")
        os.utime(tmp_path / "in" / f"{n:03}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stats = spark.createDataFrame([("a", 0.0, 1.0, 1.5)], "category string, mean double, std double, threshold double")
    items = spark.readStream.schema("item_id bigint, ts timestamp, category string, score double").option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in")
    q = scored_stream(items, stats, late=5, buckets=8).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    n = {r["item_id"]: r["count"] for r in out.groupBy("item_id").count().collect()}
    assert n.pop(None) == 200 and n.pop(0) == 2 and set(n) == set(range(1, 1000)) and set(n.values()) == {1}
    assert out.where("anomaly").count() == out.count() == first_copies(out).count() + 1
    state = spark.read.format("statestore").load(f"{tmp_path}/state").select("value.groupState.*")
    # ten ids a second for five seconds; the newest time of a bucket is at most some seconds old
    assert state.count() == 8 and state.selectExpr("sum(size(items))").first()[0] <= 80


def test_once_odd_rows(spark, tmp_path):
    """Null items and times, strings as items, no rows, an item in a third of all rows."""
    rows = [("x", None, 1.0), ("x", "2024-01-01 00:00:00", 1.0), (None, None, None), (None, None, None)] + [("hot", "2024-01-01 00:00:00", float(k)) for k in range(50)]
    df = spark.createDataFrame(rows, "item_id string, ts string, score double").withColumn("ts", F.to_timestamp("ts"))
    for name, d in (("some", df.repartition(3)), ("none", df.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}")
        s = once(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}"), buckets=4)
        s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-state").option("path", f"{tmp_path}/{name}-out").trigger(availableNow=True).start().awaitTermination()
        got = [r[0] for r in spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}-out").collect()]
        assert sorted(map(str, got)) == (["None", "None", "hot", "x"] if name == "some" else [])


def test_statistics_are_fixed_before_the_stream(spark, small, monkeypatch):
    """Mean, deviation and threshold come from one computation: a table of their own, not events again with sums in another order."""
    from oddlens.plans import stream_queries as sq

    seen = []
    monkeypatch.setattr(sq, "quantile", lambda z, *a: seen.append(z) or quantile(z, *a))
    monkeypatch.setattr(sq, "scored_stream", lambda items, stats, **k: seen.append(stats) or scored_stream(items, stats, **k))
    sq.x1_stream_scoring(spark, small)
    z, stats = seen
    assert any("/moments-" in f for f in z.inputFiles())
    assert stats.inputFiles() and not any("events" in f for f in stats.inputFiles())
