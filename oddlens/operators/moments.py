"""Means and co-moments of vectors by key, and what follows from them: principal axes, inverse covariances.

A task adds up its batches as matrix products; its sums merge with those of other tasks by count, mean and centred products,
so all rows are read once and no vector is moved. What is left is one d x d matrix a key, decomposed in the key's own task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.operators.keyed import by_model, in_tasks, settled, types


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _of(x: np.ndarray) -> dict:
    m = x.mean(0)
    return {"n": len(x), "mean": m, "m2": ((x - m).T @ (x - m)).ravel()}


def _add(a: dict, b: dict) -> dict:
    n = a["n"] + b["n"]
    ma, mb = np.asarray(a["mean"]), np.asarray(b["mean"])
    d = mb - ma
    return {"n": n, "mean": ma + d * (b["n"] / n), "m2": np.asarray(a["m2"]) + np.asarray(b["m2"]) + np.outer(d, d).ravel() * (a["n"] * b["n"] / n)}


def comoments(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows (keys, n, mean, m2): m2 holds the sums of products of deviations, row by row. Null vectors take no part; a key's are of one length."""
    d = rows.where(F.col(column).isNotNull()).select(*keys, column)
    return in_tasks(d, keys, lambda part: _of(stacked(part[column])), _add, types(rows, keys), "n bigint, mean array<double>, m2 array<double>")


def principal_axes(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A written table (keys, n, mean, shares, axes): all axes of a key one after another, the one of most variance first, and their shares
    of the variance. An axis points to where its largest loading is positive."""

    def decompose(batches):
        for b in batches:
            out = []
            for n, mean, m2 in zip(b["n"], b["mean"], b["m2"], strict=True):
                d = len(mean)
                values, vectors = np.linalg.eigh(np.asarray(m2).reshape(d, d) / max(1, n - 1))
                values, axes = np.maximum(values[::-1], 0), vectors[:, ::-1].T
                axes = axes * np.sign(axes[np.arange(d), np.abs(axes).argmax(1)])[:, None]
                out.append((values / (values.sum() or 1.0), axes.ravel()))
            yield b[[*keys, "n", "mean"]].assign(shares=[s for s, _ in out], axes=[a for _, a in out])

    fit = comoments(rows, keys, column).mapInPandas(decompose, f"{types(rows, keys)}, n bigint, mean array<double>, shares array<double>, axes array<double>")
    return settled(fit, "axes")


def variance(axes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, dims, share, cumulative, is_dims_90, is_dims_95) of principal_axes(): what the first axes hold of the variance, and the least numbers that hold 90 and 95 %."""
    from pyspark.sql import Window as W

    d = axes.select(*keys, F.posexplode("shares").alias("dims", "share")).withColumn("dims", F.col("dims") + 1)
    upto = W.partitionBy(*keys).orderBy("dims")  # a row an axis
    d = d.withColumn("cumulative", F.sum("share").over(upto.rowsBetween(W.unboundedPreceding, 0)))
    last = F.coalesce(F.lag("cumulative").over(upto), F.lit(-1.0))
    return d.withColumns({f"is_dims_{q}": (F.col("cumulative") >= q / 100) & (last < q / 100) for q in (90, 95)})


def rotated(rows: DataFrame, axes: DataFrame, keys: list[str], column: str, dims: list[int]) -> DataFrame:
    """rows with `column` replaced by unit vectors laid end to end: of the first k coordinates on the key's axes for each k of dims, and of the vector itself."""
    other = [c for c in rows.columns if c != column]

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1.0, n)

    def work(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        x, mean = stacked(part[column]), np.asarray(model["mean"][0])
        z = (x - mean) @ np.asarray(model["axes"][0]).reshape(len(mean), -1).T
        return part.assign(**{column: list(np.hstack([*[unit(z[:, :k]) for k in dims], unit(x)]))})

    return by_model(rows, axes, keys, work, f"{types(rows, other)}, {column} array<double>")


def inverse_covariances(rows: DataFrame, keys: list[str], column: str, ridge: float = 1e-5) -> DataFrame:
    """A written table (keys, mean, inverse): of the covariance (n - 1; zero for one row) + ridge on its diagonal."""

    def invert(batches):
        for b in batches:
            out = []
            for n, mean, m2 in zip(b["n"], b["mean"], b["m2"], strict=True):
                d = len(mean)
                out.append(np.linalg.pinv(np.asarray(m2).reshape(d, d) / max(1, n - 1) + ridge * np.eye(d), hermitian=True).ravel())
            yield b[[*keys, "mean"]].assign(inverse=out)

    return settled(comoments(rows, keys, column).mapInPandas(invert, f"{types(rows, keys)}, mean array<double>, inverse array<double>"), "inverse")


def mahalanobis(rows: DataFrame, fit: DataFrame, keys: list[str], column: str, score: str = "score") -> DataFrame:
    """rows without `column`, with score: the root of the quadratic form of inverse_covariances(), never below 0."""
    other = [c for c in rows.columns if c != column]

    def work(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        d = stacked(part[column]) - np.asarray(model["mean"][0])
        q = ((d @ np.asarray(model["inverse"][0]).reshape(d.shape[1], -1)) * d).sum(1)
        return part[other].assign(**{score: np.sqrt(np.maximum(q, 0))})

    return by_model(rows, fit, keys, work, f"{types(rows, other)}, {score} double")
