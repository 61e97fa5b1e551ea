"""Work on rows by the model of their key, and sums that merge.

by_model() hands a function the rows of one key, a part at a time, and that key's model: axes, words, pivots, an inverse. A model
table of at most MODEL_BYTES goes to the tasks with the function, and rows are not moved. A larger one meets the rows by
key: rows are cut into parts of at most PART_ROWS by count, so that a key with a third of all rows is many parts, and the
key's model is copied to each. Both ways give the same rows.

merged() adds up partial results of tasks in two steps, first by key and slot and then by key, and holds one key's sum at a time.
Rows with a null key take no part in either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.sources.shared import beside, written

MODEL_BYTES, PART_ROWS, SLOTS = 64_000_000, 50_000, 32


def types(df: DataFrame, columns: list[str]) -> str:
    """The columns with their types, as a schema."""
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def by_model(rows: DataFrame, model: DataFrame, keys: list[str], work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, most: int | None = None, cells: int | None = None) -> DataFrame:
    """What work(rows, model) gives for parts of the rows of every key that has a model. model: a written table, some rows a key.

    cells: the most rows times rows of the model that go to work at once (but 16 rows at least), for work that gives a row for each such pair.
    """
    size = model.agg(F.sum(F.octet_length(F.to_json(F.struct(*model.columns))))).first()[0] or 0
    names = [c.split()[0].strip("`") for c in schema.replace("<", " ").split(", ")]

    def portions(part: pd.DataFrame, own: pd.DataFrame) -> Iterator[pd.DataFrame]:
        n = len(part) if cells is None else max(16, cells // len(own))
        for lo in range(0, len(part), n):
            yield work(part.iloc[lo : lo + n].reset_index(drop=True), own)[names]

    if size <= (MODEL_BYTES if most is None else most):
        own = {k: part.reset_index(drop=True) for k, part in model.toPandas().groupby(keys)}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k, part in b.groupby(keys, sort=False):
                    if k in own:
                        yield from portions(part, own[k])

        return rows.mapInPandas(run, schema)
    n = beside(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("_parts")))
    cut = rows.join(n, keys).withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.col("_parts")).cast("int")).drop("_parts")
    copied = model.join(n, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    copied = copied.toDF(*copied.columns)

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        return pd.concat(portions(left.drop(columns="_part"), right.drop(columns="_part")), ignore_index=True)

    return cut.groupBy(*keys, "_part").cogroup(copied.groupBy(*keys, "_part")).applyInPandas(pair, schema)


def merged(parts: DataFrame, keys: list[str], add: Callable[[dict, dict], dict]) -> DataFrame:
    """One row a key of parts (keys, slot, values): add(one, other) joins the values of two rows, as dicts by column."""
    kept = [c for c in parts.columns if c != "slot"]
    values = [c for c in kept if c not in keys]

    def step(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, total = None, None
            for b in batches:
                out = []
                for r in b.to_dict("records"):
                    k = tuple(r[c] for c in by)
                    if k == at:
                        total = add(total, r)
                    else:
                        if at is not None:
                            out.append(dict(zip(by, at, strict=True)) | {c: total[c] for c in values})
                        at, total = k, r
                if out:
                    yield pd.DataFrame(out)[columns]
            if at is not None:
                yield pd.DataFrame([dict(zip(by, at, strict=True)) | {c: total[c] for c in values}])[columns]

        return df.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, types(df, columns))

    d = parts.dropna(subset=keys).withColumn("slot", F.pmod("slot", F.lit(SLOTS)).cast("int"))
    return step(step(d, [*keys, "slot"], [*kept, "slot"]), keys, kept)


def in_tasks(rows: DataFrame, keys: list[str], of: Callable[[pd.DataFrame], dict], add: Callable[[dict, dict], dict], schema: str, values: str) -> DataFrame:
    """One row a key: of(rows of a key in a batch) joined over a task's batches, and then over tasks, by add. schema and values: types of the keys
    and of what `of` gives. A task tells its sums when it holds more than 256 keys, and at its end."""
    names = [c.split()[0] for c in schema.split(", ")] + [c.split()[0] for c in values.replace("<", " ").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        slot, held = TaskContext.get().partitionId(), {}

        def told() -> pd.DataFrame:
            return pd.DataFrame([dict(zip(keys, k, strict=True)) | v | {"slot": slot} for k, v in held.items()])[[*names, "slot"]]

        for b in batches:
            for k, part in b.groupby(keys, sort=False):
                got = of(part)
                held[k] = add(held[k], got) if k in held else got
            if len(held) > 256:
                yield told()
                held.clear()
        if held:
            yield told()

    return merged(rows.mapInPandas(run, f"{schema}, {values}, slot int"), keys, add)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, which by_model() reads more than once."""
    return written(df, name)
