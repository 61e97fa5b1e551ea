"""Reading item files and tables, and publishing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def file_scan(spark: SparkSession, root: str, pattern: str = "*.png", content: bool = False) -> DataFrame:
    """Files below root whose names match pattern: path, length, modified (and content). Sort where the order matters."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    cols = ["path", "length", F.col("modificationTime").alias("modified")]
    return df.select(*cols, *(["content"] if content else []))


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with header, or no rows of the same schema if there is no such file."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def publish(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Writes a stage's result, partitioned by `by`; an earlier result at path is replaced."""
    w = df.write.mode("overwrite").partitionBy(*by or [])
    (w.option("header", True).csv if kind == "csv" else w.parquet if kind == "parquet" else w.json)(path)


def payload(df: DataFrame, by: list[str], value_cols: list[str], order: str) -> DataFrame:
    """A JSON array of rows for each group, in order; groups are what one dashboard panel shows."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, *[c for c in value_cols if c != order]))), lambda x: F.struct(*[x[c].alias(c) for c in value_cols]))
    return df.groupBy(*by).agg(F.to_json(items).alias("payload"))
