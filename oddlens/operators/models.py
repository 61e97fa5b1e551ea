"""Models that are fitted: word vocabularies, Mahalanobis distance, isolation forest, PCA study, component probe."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddlens.operators import moments as mm
from oddlens.operators.evaluation import auroc
from oddlens.operators.fusion import zscore
from oddlens.operators.keyed import by_model, settled, types
from oddlens.operators.tables import top_fraction
from oddlens.operators.vectors import all_distances, block_distances
from oddlens.sources.shared import beside, written

ROUNDS = 10
#: Seeding draws about DRAW * k vectors of a key in each of DRAWS rounds.
DRAW, DRAWS = 2, 2


def vocabulary(patches: DataFrame, keys: list[str], k: int, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """Rows (keys, word, centre): k-means of all keys at once. patches: keys, vec_id, features.

    Seeding: the vector of least hash of each key, and then, in DRAWS rounds, vectors drawn by hash in proportion to their squared distance
    to those before; the candidates, weighted by the vectors nearest to them, are brought to k in the key's task. Then Lloyd rounds,
    in which tasks send sums by word and no vectors. Words that lose all their vectors keep their place. Ties go to the lower
    word. A key with at most k different vectors has a word for each.
    """
    d = written(patches.select(*keys, "vec_id", "features"), "patches")
    words = settled(_seeds(d, keys, k, seed), "words")
    for _ in range(rounds):
        words = settled(lloyd_step(d, words, keys), "words")
    return words


def _seeds(d: DataFrame, keys: list[str], k: int, seed: int) -> DataFrame:
    h = F.xxhash64("vec_id", "features", F.lit(seed))
    chosen = settled(d.groupBy(*keys).agg(F.min_by("features", h).alias("centre")), "seeds")
    cost = ", ".join([types(d, keys), "features array<double>", "_u double", "_c double"])

    def measure(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        return part.assign(_c=all_distances(part["features"], model["centre"]).min(1) ** 2)

    for r in range(DRAWS):
        u = F.pmod(F.xxhash64("vec_id", "features", F.lit(seed), F.lit(r + 1)), F.lit(1 << 53)) / float(1 << 53)
        far = written(by_model(d.select(*keys, "features", u.alias("_u")), chosen, keys, measure, cost), "far")
        total = beside(far.groupBy(*keys).agg(F.sum("_c").alias("_t")))
        drawn = far.join(total, keys).where((F.col("_c") > 0) & (F.col("_u") * F.col("_t") < F.lit(float(DRAW * k)) * F.col("_c")))
        chosen = settled(chosen.unionByName(drawn.select(*keys, F.col("features").alias("centre"))).dropDuplicates([*keys, "centre"]), "seeds")
    named = settled(chosen.withColumn("word", F.xxhash64("centre")), "seeds")
    weighed = _sums(d, named, keys).drop("s").withColumnRenamed("n", "_n")
    named = named.join(weighed.hint("merge"), [*keys, "word"], "left")

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word")
        x, w = np.stack(pdf["centre"].to_numpy()), pdf["_n"].fillna(0).to_numpy(np.float64)
        rng, at = np.random.default_rng(seed), [int(w.argmax())]
        gap = ((x - x[at[0]]) ** 2).sum(1)
        while len(at) < min(k, len(x)):
            p = gap * w if (gap * w).sum() > 0 else gap
            if p.sum() <= 0:
                break
            at.append(int(rng.choice(len(x), p=p / p.sum())))
            gap = np.minimum(gap, ((x - x[at[-1]]) ** 2).sum(1))
        return pd.DataFrame({c: [pdf[c].iloc[0]] * len(at) for c in keys} | {"word": np.arange(len(at), dtype=np.int32), "centre": list(x[at])})

    # a key has about DRAWS * DRAW * k candidates, whatever its size
    return named.groupBy(*keys).applyInPandas(reduce, f"{types(d, keys)}, word int, centre array<double>")


def _sums(patches: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, word, n, s): number and sum of the vectors nearest to each of the written words that has some."""

    def work(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        model = model.sort_values("word")
        x = np.stack(part["features"].to_numpy())
        near = all_distances(part["features"], model["centre"]).argmin(1)
        order = np.argsort(near, kind="stable")
        found, first, n = np.unique(near[order], return_index=True, return_counts=True)
        return pd.DataFrame({c: [part[c].iloc[0]] * len(found) for c in keys} | {"word": model["word"].to_numpy()[found], "n": n, "s": list(np.add.reduceat(x[order], first))})

    kind = f"{types(words, [*keys, 'word'])}, n bigint, s array<double>"
    parts = by_model(patches.select(*keys, "features"), words, keys, work, kind).withColumn("_slot", F.spark_partition_id() % 64)
    total = F.reduce(F.collect_list("s"), F.array_repeat(F.lit(0.0), F.size(F.first("s"))), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    for by in ([*keys, "word", "_slot"], [*keys, "word"]):  # a row a batch, then a row a slot
        parts = parts.groupBy(*by).agg(F.sum("n").alias("n"), total.alias("s"))
    return parts


def lloyd_step(patches: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of the vectors nearest to each of the written words; words without vectors stay. Tasks send sums by word."""
    moved = _sums(patches, words, keys).select(*keys, "word", F.transform("s", lambda x: x / F.col("n")).alias("_c"))
    return words.join(moved.hint("merge"), [*keys, "word"], "left").select(*keys, "word", F.coalesce("_c", "centre").alias("centre"))


def mahalanobis(train: DataFrame, items: DataFrame, keys: list[str], ridge: float = 1e-5) -> DataFrame:
    """items (keys, item_id, hist) with score: distance to the mean of train by its covariance (n - 1) + ridge, never below 0."""
    return mm.mahalanobis(items.select(*keys, "item_id", "hist"), mm.inverse_covariances(train, keys, "hist", ridge), keys, "hist")


def path_average(n: float) -> float:
    """Mean depth of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """A tree as rows (feature, cut, left, right); leaves are (-1, depth + mean depth of their size, 0, 0)."""
    nodes: list[tuple] = []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(())
        spread = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if len(rows) > 1 else ()
        if depth >= limit or not len(spread):
            nodes[at] = (-1, depth + path_average(len(rows)), 0, 0)
            return at
        f = int(rng.choice(spread))
        cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
        left = x[rows, f] < cut
        nodes[at] = (f, cut, node(rows[left], depth + 1), node(rows[~left], depth + 1))
        return at

    node(np.arange(len(x)), 0)
    return nodes


def fit_forest(train: DataFrame, column: str, key: str, n_trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """A written table (tree, n, f, c, a, b): a row a tree, grown from the `sample` rows of least hash of (key, tree).

    One scan: each batch is hashed for all trees at once, and only rows whose hash can be among a tree's least go on, about
    eight times the sample for each tree at any size of train; every tree is then grown in a task of its own.
    """
    total = train.count()
    limit = min(1.0, 8.0 * sample / max(1, total))
    h = train.select(F.xxhash64(F.col(key), F.lit(seed)).alias("_h"), F.col(column).alias("x")).where("x is not null")

    def draw(batches):
        salt = np.random.default_rng(seed).integers(0, 1 << 63, n_trees, np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            mixed = b["_h"].to_numpy(np.int64).astype(np.uint64)[:, None] ^ salt
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(by)
            mixed = (mixed ^ mixed >> np.uint64(31)) >> np.uint64(1)
            i, t = np.nonzero(mixed < np.uint64(min(limit * (1 << 63), (1 << 63) - 1)) if limit < 1 else np.ones(mixed.shape, bool))
            yield pd.DataFrame({"tree": t.astype(np.int32), "h": mixed[i, t].astype(np.int64), "x": b["x"].to_numpy()[i]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values("h", kind="stable")["x"].to_numpy()[:sample])
        nodes = grow(x, np.random.default_rng([seed, t]), int(np.ceil(np.log2(max(2, sample)))))
        f, c, a, b = zip(*nodes, strict=True)
        return pd.DataFrame({"tree": [t], "n": [len(x)], "f": [list(f)], "c": [list(map(float, c))], "a": [list(a)], "b": [list(b)]})

    drawn = h.mapInPandas(draw, "tree int, h bigint, x array<double>")
    return settled(drawn.groupBy("tree").applyInPandas(fit, FOREST), "forest")


FOREST = "tree int, n int, f array<int>, c array<double>, a array<int>, b array<int>"


def forest_scores(items: DataFrame, forest: DataFrame, column: str) -> DataFrame:
    """items without `column`, with score = 2 ** (-mean depth / c(rows of a tree)): higher is more anomalous.

    A node is (feature, cut, left, right); a row goes left below the cut. A leaf has feature -1 and its depth, lengthened by the mean depth of
    its rows, as cut. The forest is bounded by trees * rows of a tree and goes to the tasks with the function.
    """
    found = forest.collect()
    trees = [tuple(np.array(r[k]) for k in "fcab") for r in found]
    base = path_average(max((r["n"] for r in found), default=2)) or 1.0

    def score(batches):
        for p in batches:
            x = np.stack(p[column].to_numpy()) if len(p) else np.empty((0, 1))
            depth = np.zeros(len(x))
            for f, c, a, b in trees:
                at = np.zeros(len(x), np.int64)
                while (live := f[at] >= 0).any():
                    i = np.flatnonzero(live)
                    at[i] = np.where(x[i, f[at[i]]] < c[at[i]], a[at[i]], b[at[i]])
                depth += c[at]
            yield p.drop(columns=column).assign(score=2.0 ** (-depth / max(1, len(trees)) / base))

    names = [c for c in items.columns if c != column]
    return items.select(*names, column).mapInPandas(score, f"{types(items, names)}, score double")


def isolation_forest(train: DataFrame, items: DataFrame, column: str, key: str, n_trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """items with the score of a forest of train."""
    return forest_scores(items, fit_forest(train, column, key, n_trees, sample, seed), column)


def reduced(train: DataFrame, patches: DataFrame, k: int) -> DataFrame:
    """patches with features on the first k principal axes of train, centred, as unit vectors."""
    one = lambda df: df.withColumn("_all", F.lit(0))
    out = mm.rotated(one(patches), mm.principal_axes(one(train), ["_all"], "features"), ["_all"], "features", [k])
    return out.drop("_all").withColumn("features", F.slice("features", 1, k))


def dimension_study(patches: DataFrame, bank: DataFrame, axes: DataFrame, dims: list[int], full: int) -> tuple[DataFrame, DataFrame]:
    """What is lost by fewer axes, by category: rows (category, dims, n_good, n_anomaly, auroc), and their means (dims, mean_auroc, n_categories, pct_of_full).

    Vectors are put on their category's axes once; for each number of dims their first coordinates, and for `full` the vectors
    themselves, become unit vectors that meet the bank in one search. An item's score is the mean of its top 1 % (floor) of nearest
    distances, normalised by the population moments of the category's validation rows; AUROC is that of its test items.
    """
    ids = ["category", "vec_id", "item_id"]
    widths = [*dims, full]
    turned = lambda df: mm.rotated(df.select(*ids, "features"), axes, ["category"], "features", dims)
    d = block_distances(turned(patches.where("split != 'train'")), turned(bank), ["category"], ids, 1, parts=widths)
    least = d.select(*ids, F.posexplode("d").alias("_p", "x")).groupBy(*ids, "_p").agg(F.min("x").alias("score"))
    s = top_fraction(least.select(F.struct("item_id", "_p").alias("_i"), "score"), "_i", "score", {"score": 0.01}, floor=True)
    # written, as the normalisation reads the scores twice and would search twice
    s = written(s.select("_i.item_id", F.get(F.array(*map(F.lit, widths)), F.col("_i._p")).alias("dims"), "score"), "scores")
    items = patches.where("split != 'train'").select("item_id", "category", "split", "defect_type", "label").distinct()
    z = written(zscore(s.join(items.hint("merge"), "item_id"), ["category", "dims"], 0), "z")
    own = auroc(z.where("split = 'test'"), ["category", "dims"], "z")
    mean = own.groupBy("dims").agg(F.avg("auroc").alias("mean_auroc"), F.count("auroc").alias("n_categories"))
    top = F.max(F.when(F.col("dims") == full, F.col("mean_auroc"))).over(Window.partitionBy(F.lit(0)))  # a row a number of dims
    return own, mean.withColumn("pct_of_full", 100 * F.col("mean_auroc") / top)


N_PARTS = 4


def probe(patches: DataFrame) -> DataFrame:
    """Rows (item_id, patch_idx, i, j, rgb, word, foreground) of the cells of each item: small fits of an item's own patches.

    rgb: the first three principal components, each min-max scaled to [0, 1] (missing ones are 0; a component points to where its largest
    loading is positive). word: four means, started from the vector nearest to the item's mean and then the farthest from those
    before, the lowest on ties; an item with fewer different vectors has fewer words. foreground: the first component is above its 75 %
    quantile (linear). patches: item_id, patch_idx, i, j, features; an item's bag is one row, and items with equally many patches
    are fitted at once as stacked matrices.
    """
    bag = patches.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("patch_idx", "i", "j", "features"))).alias("p"))

    def fit(batches):
        for b in batches:
            size = b["p"].map(len)
            for n, part in b.groupby(size, sort=False):
                x = np.array([[c["features"] for c in p] for p in part["p"]], np.float64)
                rgb, first = components(x)
                words = small_means(x, N_PARTS)
                on = first > np.quantile(first, 0.75, axis=1, keepdims=True)
                cell = lambda c, part=part: np.array([r[c] for p in part["p"] for r in p])
                yield pd.DataFrame({"item_id": np.repeat(part["item_id"].to_numpy(), n), "patch_idx": cell("patch_idx"), "i": cell("i"), "j": cell("j"), "rgb": list(rgb.reshape(-1, 3)), "word": words.ravel(), "foreground": on.ravel()})

    return bag.mapInPandas(fit, f"{types(patches, ['item_id', 'patch_idx', 'i', 'j'])}, rgb array<double>, word int, foreground boolean")


def components(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stacked items (items, patches, length): the scaled first three components, and the first as it is."""
    x = x - x.mean(1, keepdims=True)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    v = v[:, :3]
    v = v * np.sign(np.take_along_axis(v, np.abs(v).argmax(2)[:, :, None], 2))
    y = x @ v.transpose(0, 2, 1)
    span = y.max(1, keepdims=True) - y.min(1, keepdims=True)
    rgb = np.zeros((*x.shape[:2], 3))
    rgb[:, :, : y.shape[2]] = (y - y.min(1, keepdims=True)) / (span + 1e-8)
    return rgb, y[:, :, 0]


def small_means(x: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Words (items, patches) of k-means of each of the stacked items; rounds stop when no word changes."""
    every = np.arange(len(x))
    first = ((x - x.mean(1, keepdims=True)) ** 2).sum(2).argmin(1)
    centre = x[every, first][:, None]
    gap = ((x - centre) ** 2).sum(2)
    for _ in range(1, min(k, x.shape[1])):
        new = x[every, gap.argmax(1)][:, None]
        centre, gap = np.concatenate([centre, new], 1), np.minimum(gap, ((x - new) ** 2).sum(2))
    words = np.full(x.shape[:2], -1)
    for _ in range(rounds):
        near = ((x[:, :, None] - centre[:, None]) ** 2).sum(3).argmin(2)
        if (near == words).all():
            break
        words = near
        own = np.eye(centre.shape[1])[words]
        n = own.sum(1)[:, :, None]
        centre = np.where(n > 0, own.transpose(0, 2, 1) @ x / np.maximum(n, 1), centre)
    return words.astype(np.int32)


def probe_counts(cells: DataFrame) -> DataFrame:
    """Rows (item_id, n_cells, n_words, n_parts) of probe(): different words, and 4-connected parts of the foreground (0 without any)."""
    n = cells.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("word").alias("n_words"))
    parts = connected_parts(cells.where("foreground").select("item_id", "i", "j"))
    return n.join(parts.hint("merge"), "item_id", "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(0)))


#: Cells up to which an item's parts are found in one task.
CELLS = 20_000


def connected_parts(cells: DataFrame) -> DataFrame:
    """cells (item_id, i, j): rows (item_id, n_parts) of 4-connected parts. Cells given twice count once.

    An item of at most CELLS different cells is one row, whose parts are found in its task; larger ones go by rounds of joins.
    """
    once = written(cells.select("item_id", "i", "j").distinct(), "cells")
    n = written(once.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CELLS), "large")
    if n.isEmpty():
        return _parts_of_bags(once)
    large = beside(n.select("item_id"))
    return _parts_of_bags(once.join(large, "item_id", "left_anti")).unionByName(_parts_by_rounds(once.join(large, "item_id", "left_semi")))


def _parts_of_bags(cells: DataFrame) -> DataFrame:
    bag = cells.groupBy("item_id").agg(F.collect_list(F.struct("i", "j")).alias("c"))

    def count(batches):
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "n_parts": [_n_parts({(r["i"], r["j"]) for r in c}) for c in b["c"]]})

    return bag.mapInPandas(count, f"{types(cells, ['item_id'])}, n_parts bigint")


def _n_parts(open_: set[tuple[int, int]]) -> int:
    n = 0
    while open_:
        n, edge = n + 1, [open_.pop()]
        while edge:
            i, j = edge.pop()
            near = open_ & {(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)}
            open_ -= near
            edge += near
    return n


def _parts_by_rounds(cells: DataFrame) -> DataFrame:
    """A cell's label is a cell of its part: every round takes the least label of its neighbours, and then that cell's own
    label, which shortens long ways by half; it ends when no label changes.
    """
    cell = F.shiftleft(F.col("i").cast("long"), 32) + F.col("j")
    lab = written(cells.select("item_id", "i", "j", cell.alias("cell"), cell.alias("lab")).distinct())
    steps = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    changed = True
    while changed:
        sent = lab.select("item_id", F.explode(steps).alias("s"), "i", "j", "lab").select("item_id", (F.col("i") + F.col("s.di")).alias("i"), (F.col("j") + F.col("s.dj")).alias("j"), F.col("lab").alias("_l"))
        low = sent.groupBy("item_id", "i", "j").agg(F.min("_l").alias("_l"))
        near = written(lab.join(low.hint("merge"), ["item_id", "i", "j"], "left").withColumn("_to", F.least("lab", "_l")))
        to = near.select("item_id", F.col("cell").alias("_to"), F.col("_to").alias("_next"))
        new = near.join(to.hint("merge"), ["item_id", "_to"])
        lab = written(new.select("item_id", "i", "j", "cell", F.least("_to", "_next").alias("lab"), (F.least("_to", "_next") < F.col("lab")).alias("changed")))
        changed = not lab.where("changed").isEmpty()
        lab = lab.drop("changed")
    return lab.groupBy("item_id").agg(F.count_distinct("lab").alias("n_parts"))
