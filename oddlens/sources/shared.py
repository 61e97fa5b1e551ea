"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests on one machine, one new folder for each application.
    ValueError where it is unset and executors may run on other machines, which would not see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="oddlens-")
        found = _own[app]
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not in use."""
    return f"{shared_dir(spark)}/oddlens/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and Spark knows the real size."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df as the right side of a join: written, then broadcast if it has at most so many rows of a few columns, else merged."""
    df = written(df, "beside")
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")
