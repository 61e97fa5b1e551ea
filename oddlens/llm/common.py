"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddlens.sources.shared import shared_dir, written

__all__ = ["BROADCAST_ROWS", "SPACE", "freed", "freed2", "freed_rows", "let", "lookup", "n_words", "partitions", "shared_dir", "spread", "with_few", "words", "written"]

#: White space that ends a word: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
#: A table of at most so many rows, and of so many bytes as JSON, may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16_000_000


def _release() -> None:
    """Gives memory that is no longer in use back to the system; Python workers live longer than their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def freed_rows(f):
    """f, a function of batches that yields batches, after which its memory is given back."""

    def run(batches):
        yield from f(batches)
        _release()

    return run


def freed(f):
    """f, a function of one group, after which its memory is given back."""

    def run(group):
        out = f(group)
        _release()
        return out

    return run


def freed2(f):
    """f, a function of two groups, after which its memory is given back."""

    def run(left, right):
        out = f(left, right)
        _release()
        return out

    return run


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.filter(F.split(trimmed, SPACE_RE), lambda w: w != "")


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RE))).cast("long")


def with_few(df: DataFrame, few: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """df joined (left or inner) with a written table that has one row a key. Null keys match null keys.

    The table is broadcast only when its counted rows and their bytes are within BROADCAST_ROWS and BROADCAST_BYTES.
    Beyond that lookup() joins it, by which a key with a third of df's rows stays even. df must be cheap to compute
    twice, or written.
    """
    right = few.withColumnsRenamed({c: f"_r_{c}" for c in on}).withColumn("_hit", F.lit(True))
    size = few.limit(BROADCAST_ROWS + 1).select(F.octet_length(F.to_json(F.struct(*few.columns))).alias("_b"))
    n, n_bytes = size.agg(F.count(F.lit(1)), F.coalesce(F.sum("_b"), F.lit(0))).first()
    if n <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES:
        out = df.join(F.broadcast(right), [df[c].eqNullSafe(right[f"_r_{c}"]) for c in on], how)
        return out.drop("_hit", *[f"_r_{c}" for c in on])
    right = right.withColumn("_on", F.struct(*[F.col(f"_r_{c}").alias(c) for c in on])).drop(*[f"_r_{c}" for c in on])
    out = lookup(df.withColumn("_on", F.struct(*on)), right, "_on")
    return (out.where("_hit") if how == "inner" else out).drop("_on", "_hit")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def lookup(rows: DataFrame, table: DataFrame, key: str, salts: int = 256) -> DataFrame:
    """rows left-joined with table, which has one row a key, where a key may hold a third of rows.

    The keys of rows are first cut to one row a key and salt, by partial aggregation; these meet the table, and
    then rows meet them by key and salt. No task gets more than `salts` rows of a key before, or its share after.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)).cast("int"))
    asked = salted.select(F.col(key).alias("_k"), F.col("_salt").alias("_s")).where("_k is not null").distinct()
    other = [c for c in table.columns if c != key]
    answers = asked.join(table.hint("merge"), asked["_k"] == table[key]).select("_k", "_s", *other)
    return salted.join(answers.hint("merge"), (salted[key] == answers["_k"]) & (salted["_salt"] == answers["_s"]), "left").drop("_k", "_s", "_salt")


def spread(rows: DataFrame, table: DataFrame, key: str, by: str, counted: DataFrame | None = None, most: int = 2000) -> DataFrame:
    """rows joined (inner) with table, which has one row a key. Rows of a key with more than `most` of them (in counted,
    a written table, such as rows) are dealt by a hash of column `by` to several tasks; each gets the key's row of table."""
    n = (rows if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    hot = written(n.select(key, F.ceil(F.col("_n") / most).cast("int").alias("_salts")), "hot")
    if hot.isEmpty():
        return rows.join(table.hint("merge"), key)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = with_few(rows, hot, [key]).withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    copied = with_few(table, hot, [key]).withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copied.hint("merge"), [key, "_salt"]).drop("_salt")
