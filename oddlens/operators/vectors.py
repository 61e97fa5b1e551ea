"""Memory banks and nearest-neighbour scores of patch vectors.

Patches are rows (item_id, category, i, j, features). A bank holds the patches of one key, such as (category) or
(category, region); a query meets only the bank of its own key. nearest() is the definition, as DataFrame functions
over a join on the key. nearest_blocks() is for banks that do not fit one row set a task: banks and queries are cut
into blocks of bounded size, each pair of blocks of a key is one task's matrix product, and the k smallest distances
of the blocks are merged. Both give the mean distance to the min(k, bank size) nearest vectors; a key without a bank
gives null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddlens.operators.keyed import by_model, types
from oddlens.operators.tables import capped_sample
from oddlens.sources.shared import beside, written

BLOCK = 4096
#: Distances that a task holds at once, and rows that it gives at once where a row goes to many cells.
CELLS, MET = 1 << 20, 1 << 15


def region(i: Column, j: Column, h: int, w: int, r: int) -> Column:
    """Cell (i, j) of an h x w grid in an r x r layout: min(r - 1, floor(i / h * r)) * r + the same of j."""
    row = F.least(F.lit(r - 1), F.floor(i / F.lit(float(h)) * r))
    return (row * r + F.least(F.lit(r - 1), F.floor(j / F.lit(float(w)) * r))).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its Euclidean norm; a zero vector stays as it is."""
    n = F.transform(F.array(norm(v)), lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x))
    return F.transform(F.arrays_zip(v.alias("v"), F.array_repeat(n[0], F.size(v)).alias("n")), lambda x: x["v"] / x["n"])


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(queries: DataFrame, bank: DataFrame, keys: list[str], ids: list[str], k: int = 1) -> DataFrame:
    """queries with score: the mean of the k smallest distances to the bank of the same keys (min for k = 1)."""
    b = bank.select(*keys, F.col("features").alias("_b"))
    d = queries.join(b, keys).select(*ids, *keys, euclid(F.col("features"), F.col("_b")).alias("d"))
    if k == 1:
        agg = F.min("d")
    else:
        small = F.slice(F.sort_array(F.collect_list("d")), 1, k)
        agg = F.aggregate(small, F.lit(0.0), lambda s, x: s + x) / F.size(small)
    s = d.groupBy(*ids, *[x for x in keys if x not in ids]).agg(agg.alias("score"))
    return queries.drop("features").join(s.hint("merge"), [*ids, *[x for x in keys if x not in ids]], "left")


def _small(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The min(k, len(y)) smallest distances of each row of x to the rows of y, in order. Rows of x go in portions, so that no matrix has more than CELLS numbers."""
    kk, rows, yy = min(k, len(y)), max(1, CELLS // len(y)), (y * y).sum(1)
    odd = ~np.isfinite(yy)
    out = np.empty((len(x), kk))
    for lo in range(0, len(x), rows):
        part = x[lo : lo + rows]
        sq = part @ y.T
        sq *= -2
        sq += yy  # a row's own square is the same for all of y
        sq[:, odd] = np.inf
        near = sq.argmin(1)[:, None] if kk == 1 else np.argpartition(sq, kk - 1, axis=1)[:, :kk]
        # the few that remain are measured directly, which near zero is more exact than the product form
        out[lo : lo + rows] = np.sort(np.sqrt(((part[:, None] - y[near]) ** 2).sum(2)), axis=1)
    return out


def block_distances(queries: DataFrame, bank: DataFrame, keys: list[str], ids: list[str], k: int, block: int = BLOCK, parts: list[int] | None = None) -> DataFrame:
    """Rows (keys, ids, d): the k smallest distances of each query to each block of the bank of its keys.

    parts: widths of vectors laid end to end in features; d then holds the distances of each part one after another, padded with infinity to k.
    """
    key_type = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in keys)
    id_type = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in ids if c not in keys)

    def cut(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(f"n_{name}"))
        n = beside(n)
        # equal vectors are spread by what else the row holds
        h = F.pmod(F.xxhash64(*df.columns), F.col(f"n_{name}")).cast("int")
        return df.join(n, keys).withColumn(name, h).drop(f"n_{name}"), n

    q, nq = cut(queries.select(*dict.fromkeys([*ids, *keys]), "features"), "qb")
    b, nb = cut(bank.select(*dict.fromkeys([*keys, *[c for c in bank.columns if c.endswith("_id")]]), "features"), "bb")
    q = q.join(nb, keys).withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("n_bb") - 1))).drop("n_bb")
    b = b.join(nq, keys).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("n_qb") - 1))).drop("n_qb")
    q, b = q.toDF(*q.columns), b.toDF(*b.columns)  # the two may come from one table
    own = [c for c in ids if c not in keys]

    def block_pair(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, *own]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in [*names, "d"]}, dtype=object)
        x, y = np.stack(left["features"].to_numpy()).astype(np.float64), np.stack(right["features"].to_numpy()).astype(np.float64)
        if parts is None:
            d = _small(x, y, k)
        else:
            ends = np.cumsum(parts)
            d = np.full((len(x), len(parts), k), np.inf)
            for p, (lo, hi) in enumerate(zip(ends - parts, ends, strict=True)):
                got = _small(x[:, lo:hi], y[:, lo:hi], k)
                d[:, p, : got.shape[1]] = got
            d = d.reshape(len(x), -1)
        return left[names].assign(d=list(d))

    schema = ", ".join(x for x in (key_type, id_type, "d array<double>") if x)
    return q.groupBy(*keys, "qb", "bb").cogroup(b.groupBy(*keys, "qb", "bb")).applyInPandas(block_pair, schema)


def _mean_of_least(d: DataFrame, by: list[str], k: int) -> DataFrame:
    """Rows (by, score): the mean of the k smallest of all distances in the arrays d."""
    small = F.slice(F.sort_array(F.flatten(F.collect_list("d"))), 1, k)
    return d.groupBy(*by).agg(small.alias("_d")).select(*by, (F.aggregate("_d", F.lit(0.0), lambda a, x: a + x) / F.size("_d")).alias("score"))


def nearest_blocks(queries: DataFrame, bank: DataFrame, keys: list[str], ids: list[str], k: int = 1, block: int = BLOCK) -> DataFrame:
    """The same as nearest(), by blocks. Block numbers follow from counts of each key, so skewed keys get more blocks."""
    own = [c for c in ids if c not in keys]
    s = _mean_of_least(block_distances(queries, bank, keys, ids, k, block), [*keys, *own], k)
    return queries.drop("features").join(s.hint("merge"), [*keys, *own], "left")


def pivots_of(bank: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Rows (keys, cell, pivot): about one vector in `cell` of each key's bank, at least one, chosen by hash; equal vectors once."""
    h = F.xxhash64("features")
    one = bank.groupBy(*keys).agg(F.min_by("features", F.abs(h)).alias("pivot"))
    some = bank.where(F.pmod(F.xxhash64("features", F.lit(1)), F.lit(cell)) == 0).select(*keys, F.col("features").alias("pivot"))
    return one.unionByName(some).select(*keys, F.xxhash64("pivot").alias("cell"), "pivot").dropDuplicates([*keys, "cell"])


def _apart(pivots: pd.Series, mine: np.ndarray) -> np.ndarray:
    """Distances of the pivots at the places `mine` to all; the distances of all to all would grow with the square of a bank."""
    if len(pivots) * len(mine) >= 1 << 16:
        return all_distances(pivots.iloc[mine], pivots)
    p = np.stack(pivots.to_numpy()).astype(np.float64)
    return np.sqrt(((p[mine][:, None] - p[None]) ** 2).sum(2))


def nearest_pruned(queries: DataFrame, bank: DataFrame, keys: list[str], ids: list[str], k: int = 1, cell: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The same as nearest(), without the cells of the bank that cannot hold a nearer vector; and a report of what was compared.

    Vectors of the bank belong to the cell of their nearest pivot, of which there is about one in `cell` vectors; a cell keeps the
    least and greatest distance to its pivot. A query first meets its own cell. With u the k-th smallest distance known by then, or
    the k-th smallest bound from all cells' distances and sizes, a cell is left out if by the triangle inequality all of it is farther than u
    (D - greatest > u or least - D > u, D the distance to the pivot), or if it lies beyond the plane between the two pivots by more
    than u. The others are compared by blocks, so large cells are split. keys may be empty: one bank for all queries.

    The report is a row a key: n_queries, n_bank, n_cells, n_pairs (queries times bank) and n_compared.
    """
    if not keys:
        s, report = nearest_pruned(queries.withColumn("_all", F.lit(0)), bank.withColumn("_all", F.lit(0)), ["_all"], ids, k, cell)
        return s.drop("_all"), report.drop("_all")
    own = [c for c in ids if c not in keys]
    names, key_types = [*keys, *own], types(queries, keys)
    bank = written(bank.select(*dict.fromkeys([*keys, *[c for c in bank.columns if c.endswith("_id")]]), "features"), "bank")
    pivots = written(pivots_of(bank, keys, cell), "pivots")
    other = [c for c in bank.columns if c != "features" and c not in keys]

    def lead(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        d = all_distances(part["features"], model["pivot"])
        at = d.argmin(1)
        return part.assign(cell=model["cell"].to_numpy()[at], _r=d[np.arange(len(d)), at])

    led = written(by_model(bank, pivots, keys, lead, ", ".join(x for x in (key_types, types(bank, other), "features array<double>, cell bigint, _r double") if x), cells=MET), "cells")
    # a pivot's cell holds the pivot itself, so each has rows
    cells = led.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("_r").alias("least"), F.max("_r").alias("most"))
    model = written(pivots.join(cells.hint("merge"), [*keys, "cell"]), "model")

    def aim(part: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        d = all_distances(part["features"], m["pivot"])
        far = d + m["most"].to_numpy()
        order = np.argsort(far, axis=1)
        enough = np.cumsum(m["n"].to_numpy()[order], axis=1) >= k
        first = np.where(enough.any(1), enough.argmax(1), 0)
        bound = np.where(enough.any(1), np.take_along_axis(far, order, 1)[np.arange(len(d)), first], np.inf)
        return part.assign(cell=m["cell"].to_numpy()[d.argmin(1)], _u=bound)

    q = written(queries.select(*names, "features"), "queries")
    q_types = ", ".join(x for x in (key_types, types(q, own)) if x)
    aimed = written(by_model(q, model, keys, aim, f"{q_types}, features array<double>, cell bigint, _u double", cells=MET), "aimed")
    home = written(block_distances(aimed, led, [*keys, "cell"], ids, k), "home")
    u = home.groupBy(*names).agg(F.slice(F.sort_array(F.flatten(F.collect_list("d"))), 1, k).alias("_d"))
    u = u.select(*names, F.when(F.size("_d") == k, F.get("_d", F.lit(k - 1))).alias("_h"))
    known = aimed.join(u.hint("merge"), names, "left").withColumn("_u", F.least("_u", "_h")).drop("_h")

    def rest(part: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        d = all_distances(part["features"], m["pivot"])
        at = {c: i for i, c in enumerate(m["cell"])}
        mine = part["cell"].map(at).to_numpy()
        u = part["_u"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9
        apart = _apart(m["pivot"], mine)
        own_d = d[np.arange(len(d)), mine][:, None]
        beyond = np.divide(d * d - own_d * own_d, 2 * apart, out=np.zeros_like(d), where=apart > 0)
        open_ = (d - m["most"].to_numpy() <= u) & (m["least"].to_numpy() - d <= u) & (beyond <= u)
        open_[np.arange(len(d)), mine] = False
        i, j = np.nonzero(open_)
        return part.iloc[i].drop(columns="cell").assign(cell=m["cell"].to_numpy()[j], _n=m["n"].to_numpy()[j])

    more = written(by_model(known, model, keys, rest, f"{q_types}, features array<double>, cell bigint, _n bigint", cells=MET), "more")
    d = home.select(*names, "d").unionByName(block_distances(more, led, [*keys, "cell"], ids, k).select(*names, "d"))
    s = queries.drop("features").join(_mean_of_least(d, names, k).hint("merge"), names, "left")
    at_home = aimed.join(cells.select(*keys, "cell", "n").hint("merge"), [*keys, "cell"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("_home"))
    sizes = cells.groupBy(*keys).agg(F.sum("n").alias("n_bank"), F.count(F.lit(1)).alias("n_cells"))
    report = at_home.join(sizes.hint("merge"), keys).join(more.groupBy(*keys).agg(F.sum("_n").alias("_more")).hint("merge"), keys, "left")
    return s, report.select(*keys, "n_queries", "n_bank", "n_cells", (F.col("n_queries") * F.col("n_bank")).alias("n_pairs"), (F.col("_home") + F.coalesce("_more", F.lit(0))).alias("n_compared"))


def all_distances(x: pd.Series, y: pd.Series) -> np.ndarray:
    """Distances of all vectors of x to all of y, measured well near zero too."""
    a, b = np.stack(x.to_numpy()).astype(np.float64), np.stack(y.to_numpy()).astype(np.float64)
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    low = sq < 1e-6 * ((a * a).sum(1)[:, None] + (b * b).sum(1)[None])
    i, j = np.nonzero(low)
    for lo in range(0, len(i), 65_536):
        ii, jj = i[lo : lo + 65_536], j[lo : lo + 65_536]
        sq[ii, jj] = ((a[ii] - b[jj]) ** 2).sum(1)
    return np.sqrt(np.maximum(sq, 0))


def region_banks(queries: DataFrame, train: DataFrame, keys: list[str], region_cap: int, cap: int, id_: str = "vec_id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(queries, bank), both with column bank: the region, or -1 for the bank of all regions where the query's region has no rows in train.

    train and queries: keys, region, id_, features. Which bank a query meets is known before any distance is measured, and banks of
    all regions are built only for the keys that need one. A region's bank is capped at region_cap, one of all regions at cap.
    """
    own = train.groupBy(*keys, "region").agg(F.lit(True).alias("_has"))
    to = queries.join(beside(own), [*keys, "region"], "left").withColumn("bank", F.when(F.col("_has"), F.col("region")).otherwise(F.lit(-1))).drop("_has")
    to = written(to, "aimed")
    need = to.where("bank = -1").select(*keys).distinct()
    fine = capped_sample(train, id_, region_cap, seed, [*keys, "region"]).withColumn("bank", F.col("region"))
    whole = capped_sample(train.join(beside(need), keys), id_, cap, seed, keys).withColumn("bank", F.lit(-1))
    return to, fine.unionByName(whole)


def global_statistics(train: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """items (keys, item_id, features) with score: root mean square of z by train mean and population deviation + 1e-6."""
    f = train.select(*keys, F.posexplode("features").alias("pos", "x"))
    stats = f.groupBy(*keys, "pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = items.select(*keys, "item_id", F.posexplode("features").alias("pos", "x")).join(beside(stats), [*keys, "pos"])
    z = z.withColumn("z", (F.col("x") - F.col("m")) / (F.col("s") + 1e-6))
    return z.groupBy(*keys, "item_id").agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("score"))


def nearest_word(patches: DataFrame, words: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Rows (keys, ids, word): the nearest of the words (keys, word, centre) of the same keys, the lowest on ties."""

    def work(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        model = model.sort_values("word")
        return part.assign(word=model["word"].to_numpy()[all_distances(part["features"], model["centre"]).argmin(1)])

    names = [*keys, *ids]
    return by_model(patches.select(*dict.fromkeys([*names, "features"])), written(words, "words"), keys, work, f"{types(patches, names)}, {types(words, ['word'])}")


def histograms(words: DataFrame, n_words: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of each word by item, zeros kept: rows (keys, item_id, hist), hist in order of word. n_words: keys, k."""
    n = words.groupBy(*keys, "item_id", "word").agg(F.count(F.lit(1)).alias("n"))
    h = n.groupBy(*keys, "item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("_m"), F.sum("n").alias("_t")).join(beside(n_words), keys)
    cell = lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0)) / F.col("_t")
    return h.select(*keys, "item_id", F.transform(F.sequence(F.lit(0), F.col("k") - 1), cell).alias("hist"))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def features_from(df: DataFrame, backend: str, column: str = "features", user=None) -> DataFrame:
    """df with features and feature_backend. Backends: `array_column` takes a column as it is, `grid_stats` mean, deviation
    and edge density of a 64-cell grid, `user` a given function of the column. Others raise ValueError; none falls back."""
    if backend == "array_column":
        f = F.col(column)
    elif backend == "grid_stats":
        from oddlens.operators.grids import edge_density, mean_of, std_of

        f = F.array(mean_of(F.col(column)), std_of(F.col(column)), edge_density(F.col(column), 8))
    elif backend == "user" and user is not None:
        f = user(F.col(column))
    else:
        raise ValueError(f"no feature backend {backend!r}")
    return df.withColumns({"features": f, "feature_backend": F.lit(backend)})
