"""Views of the driver's tables in the shape that the operators read, and the same views as SQL.

items: item_id, category, split, defect_type, label. Split and defect follow fixed rules of the key, so that every
row of a table takes part and nothing is drawn at random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

METHODS = ("value", "k", "hour")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key: Column) -> Column:
    """0-4 of ten train, 5-6 validation, 7-9 test."""
    d = key % 10
    return F.when(d < 5, "train").when(d < 7, "validation").otherwise("test")


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("label", (F.col("defect_type") != "good").cast("int"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    split = split_of(F.col("o_orderkey"))
    defect = F.when((split != "test") | (F.col("o_orderstatus") == "F"), "good").when(F.col("o_orderstatus") == "O", "logical_anomalies").otherwise("structural_anomalies")
    return labelled(o.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("category"), split.alias("split"), defect.alias("defect_type")))


def order_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch scores of the orders: item_id, price, quantity, discount."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("item_id"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with three branch scores: value, k (from props) and hour, the last two with many ties."""
    e = table(spark, sf_dir, "events")
    split = split_of(F.col("event_id"))
    u = F.col("user_id") % 3
    defect = F.when((split != "test") | (u == 0), "good").when(u == 1, "logical_anomalies").otherwise("structural_anomalies")
    return labelled(
        e.select(
            F.col("event_id").alias("item_id"), F.col("event_type").alias("category"), split.alias("split"), defect.alias("defect_type"),
            "value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.hour("ts").cast("double").alias("hour"),
        )
    )


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_items as a long score table: method, item_id, category, split, defect_type, label, score."""
    w = event_items(spark, sf_dir)
    keys = ["item_id", "category", "split", "defect_type", "label"]
    return w.unpivot(keys, list(METHODS), "method", "score").select("method", *keys, "score")


def item_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as patches of items: an item is the vectors of one category in a block of 20 ids, laid out two to a row."""
    e = table(spark, sf_dir, "embeddings")
    block, category = F.floor(F.col("vec_id") / 20), F.col("label") % 5
    d = block % 10
    split = split_of(block)
    defect = F.when(d == 8, "logical_anomalies").when(d == 9, "structural_anomalies").otherwise("good")
    p = e.select(
        (block * 5 + category).cast("long").alias("item_id"), F.concat(F.lit("cat"), category).alias("category"), split.alias("split"), defect.alias("defect_type"),
        "vec_id", F.col("embedding").cast("array<double>").alias("features"),
    )
    p = labelled(p.withColumn("patch_idx", F.row_number().over(W.partitionBy("item_id").orderBy("vec_id")) - 1))
    return p.withColumns({"i": F.floor(F.col("patch_idx") / 2).cast("int"), "j": (F.col("patch_idx") % 2).cast("int")})


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 grids with cells in [0, 1]: item_id, category, grid (row by row)."""
    e = table(spark, sf_dir, "embeddings")
    cells = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.least(F.greatest((x + 1) / 2, F.lit(0.0)), F.lit(1.0)))
    return e.select(F.col("vec_id").alias("item_id"), F.concat(F.lit("cat"), F.col("label") % 5).alias("category"), cells.alias("grid"))


#: The same views for the SQL that queries are held against; WITH ... of SQL follows.
SQL = """
order_items AS (SELECT *, (defect_type <> 'good')::INT AS label FROM (SELECT o_orderkey AS item_id, o_orderpriority AS category,
  CASE WHEN o_orderkey % 10 < 5 THEN 'train' WHEN o_orderkey % 10 < 7 THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN o_orderkey % 10 < 7 OR o_orderstatus = 'F' THEN 'good' WHEN o_orderstatus = 'O' THEN 'logical_anomalies' ELSE 'structural_anomalies' END AS defect_type FROM orders)),
order_patches AS (SELECT l_orderkey AS item_id, l_extendedprice AS price, l_quantity AS quantity, l_discount AS discount FROM lineitem),
event_items AS (SELECT *, (defect_type <> 'good')::INT AS label FROM (SELECT event_id AS item_id, event_type AS category,
  CASE WHEN event_id % 10 < 5 THEN 'train' WHEN event_id % 10 < 7 THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN event_id % 10 < 7 OR user_id % 3 = 0 THEN 'good' WHEN user_id % 3 = 1 THEN 'logical_anomalies' ELSE 'structural_anomalies' END AS defect_type,
  value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, hour(ts)::DOUBLE AS hour FROM events)),
event_scores AS (SELECT 'value' AS method, item_id, category, split, defect_type, label, value AS score FROM event_items
  UNION ALL SELECT 'k', item_id, category, split, defect_type, label, k FROM event_items WHERE k IS NOT NULL
  UNION ALL SELECT 'hour', item_id, category, split, defect_type, label, hour FROM event_items),
item_patches AS (SELECT *, (defect_type <> 'good')::INT AS label, patch_idx // 2 AS i, patch_idx % 2 AS j FROM (SELECT (vec_id // 20) * 5 + label % 5 AS item_id, 'cat' || (label % 5) AS category,
  CASE WHEN vec_id // 20 % 10 < 5 THEN 'train' WHEN vec_id // 20 % 10 < 7 THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN vec_id // 20 % 10 = 8 THEN 'logical_anomalies' WHEN vec_id // 20 % 10 = 9 THEN 'structural_anomalies' ELSE 'good' END AS defect_type,
  vec_id, embedding::DOUBLE[] AS features, row_number() OVER (PARTITION BY (vec_id // 20) * 5 + label % 5 ORDER BY vec_id) - 1 AS patch_idx FROM embeddings)),
grids AS (SELECT vec_id AS item_id, 'cat' || (label % 5) AS category, list_transform(embedding::DOUBLE[], lambda x: least(greatest((x + 1) / 2, 0.0), 1.0)) AS grid FROM embeddings)
"""


def sql(query: str) -> str:
    """query with the views before it; its own CTEs follow after a comma."""
    q = query.strip()
    return f"WITH {SQL.strip()}, {q[5:]}" if q.upper().startswith("WITH ") else f"WITH {SQL.strip()} {q}"
