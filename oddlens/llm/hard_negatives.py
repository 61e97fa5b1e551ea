"""Hard negatives of anchors by a multiway hyperplane tree whose split points know the distances of their siblings' rows.

The tree is fitted on a bounded sample (SAMPLE rows, those of least hash of the id): a node has up to ARITY split points, far
from one another, and a vector belongs to the nearest of them. Every row is then led down the tree to its leaf, and the index keeps of
all rows, for every two split points i and j of a node, the least and the greatest distance from i to the rows below j, and the range of
the norms below j.

An anchor looks for inner products within windows [low, high]. With |x - a|**2 = |a|**2 + |x|**2 - 2 a.x and the norms
below j, a window is an annulus around the anchor; its rows are from split point i at least max(0, D - outer, inner - D) and at
most D + outer away, D being the anchor's own distance. A sibling whose kept range misses that interval for some i is eliminated. What remains
are leaves, which are compared exactly, as matrix products. The rows of the sample give every window a lower bound beforehand, which
rises while a task goes through its leaves.

Leaves are dealt to groups of at most GROUP_ROWS rows (a large leaf to several, by hash of the id) and anchors to parts of at
most PART of them; a task takes one group and one part. So memory is bounded at any size, and rows and anchors move in
proportion to rows * parts + anchors * groups. Two searches are made: for the positives, with the window from the least
wanted score up, and for the negatives, with a window for each score of a positive.

Rows with a null id, label or vector, or a component that is null or not finite, take no part. Vectors of different
lengths are filled up with zeros; empty ones have score 0 with all. Components are whole numbers; sums of products beyond
2**53 are computed in extended precision, and beyond 2**63 the scores are undefined. Ties go to the smaller id. A row that occurs
again with the same id, label and vector counts once; rows of one id that differ are rows of their own, but never each other's
positives. Only id, label and vector are read, so other columns cannot clash. No rows or no anchors give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddlens.llm.common import freed2, freed_rows, partitions, written

#: Rows of the sample, split points of a node, sample rows of a leaf.
SAMPLE, ARITY, LEAF = 8192, 16, 64
#: Rows of a group, anchors of a part, anchors and rows of one matrix product.
GROUP_ROWS, PART, CHUNK, BLOCK = 250_000, 50_000, 256, 2048
LEAST_GROUP = 2048


def packed(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as 2, 4 or 8 bytes each, by the largest of them."""
    top = np.abs(x).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return [r.tobytes() for r in x.astype(kind)]


def unpacked(cells: list[bytes], dim: int) -> np.ndarray:
    """Rows of doubles, filled up with zeros to dim."""
    sizes = {len(c) for c in cells}
    kinds = {2 * dim: "<i2", 4 * dim: "<i4", 8 * dim: "<f8"}
    if len(sizes) == 1 and dim:
        return np.frombuffer(b"".join(cells), kinds[sizes.pop()]).reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(c, kinds[len(c)]) for c in cells], np.float64).reshape(len(cells), dim)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


@dataclass
class Node:
    points: np.ndarray
    children: list[int]  # a node, or -1 - leaf
    near: np.ndarray = field(default=None)  # least distance from point i to the rows below j
    far: np.ndarray = field(default=None)
    short: np.ndarray = field(default=None)  # least squared norm below j
    long: np.ndarray = field(default=None)

    def unmeasured(self) -> None:
        m = len(self.points)
        self.near, self.far = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        self.short, self.long = np.full(m, np.inf), np.full(m, -np.inf)


class Tree:
    def __init__(self, sample: np.ndarray, arity: int = ARITY, leaf: int = LEAF) -> None:
        self.nodes: list[Node] = []
        self.n_leaves = 0
        self._grow(sample, arity, leaf)

    def _grow(self, x: np.ndarray, arity: int, leaf: int) -> int:
        points = self._spread(x, arity) if len(x) > leaf else x[:1]
        if len(points) < 2 and self.nodes:
            self.n_leaves += 1
            return -self.n_leaves
        at = len(self.nodes)
        self.nodes.append(node := Node(points, []))
        node.unmeasured()
        own = squares(x, points).argmin(1) if len(points) else np.empty(0)
        for j in range(len(points)):
            below = x[own == j]
            if len(below) == len(x):  # no progress
                self.n_leaves += 1
                node.children.append(-self.n_leaves)
            else:
                node.children.append(self._grow(below, arity, leaf))
        return at

    @staticmethod
    def _spread(x: np.ndarray, arity: int) -> np.ndarray:
        """Up to arity different rows, each the farthest from those before, among a few rows of x."""
        few = x[:: max(1, len(x) // (4 * arity))]
        chosen, gap = [0], squares(few, few[:1])[:, 0]
        while len(chosen) < arity and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, squares(few, few[chosen[-1:]])[:, 0])
        return few[chosen]

    def leaves(self, x: np.ndarray, measure: bool = False) -> np.ndarray:
        """The leaf of each row; measure: the ranges of the nodes come to hold the rows."""
        out = np.zeros(len(x), np.int64)
        norm = (x * x).sum(1)
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            node = self.nodes[k]
            if not len(rows):
                continue
            d = squares(x[rows], node.points)
            own = d.argmin(1)
            for j, child in enumerate(node.children):
                below = own == j
                at = rows[below]
                if not len(at):
                    continue
                if measure:
                    dj = np.sqrt(d[below])
                    node.near[:, j], node.far[:, j] = np.minimum(node.near[:, j], dj.min(0)), np.maximum(node.far[:, j], dj.max(0))
                    node.short[j], node.long[j] = min(node.short[j], norm[at].min()), max(node.long[j], norm[at].max())
                if child < 0:
                    out[at] = -1 - child
                else:
                    todo.append((child, at))
        return out

    def visited(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which leaves (columns) can hold a row whose inner product with a is within one of its windows (low and high: a row an anchor, a column a window)."""
        out = np.zeros((len(a), self.n_leaves), bool)
        norm = (a * a).sum(1)
        todo = [(0, np.arange(len(a)))]
        while todo:
            k, rows = todo.pop()
            node = self.nodes[k]
            if not len(rows):
                continue
            d = np.sqrt(squares(a[rows], node.points))[:, None, :]
            for j, child in enumerate(node.children):
                if node.long[j] < 0:  # no rows
                    continue
                outer = (norm[rows] + node.long[j])[:, None] - 2 * low[rows]
                inner = (norm[rows] + node.short[j])[:, None] - 2 * high[rows]
                open_ = (low[rows] <= high[rows]) & (outer >= -1e-6)
                outer, inner = np.sqrt(np.maximum(outer, 0))[:, :, None], np.sqrt(np.maximum(inner, 0))[:, :, None]
                slack = 1e-6 * (1 + node.far[:, j] + node.long[j] ** 0.5)
                meets = (d + outer >= node.near[:, j] - slack) & (np.maximum(d - outer, inner - d) <= node.far[:, j] + slack)
                at = rows[(open_ & meets.all(2)).any(1)]
                if child < 0:
                    out[at, -1 - child] = True
                else:
                    todo.append((child, at))
        return out


class Best:
    """The k best (score, smaller id first) of each line, where a line is an anchor's window."""

    def __init__(self, n: int, k: int, kind: type) -> None:
        self.k, self.n, self.kind = k, n, kind
        self.line, self.score, self.id = np.empty(0, np.int64), np.empty(0, kind), np.empty(0, np.int64)
        #: A score below this, or this with a larger id, is not among the best.
        self.least, self.last = np.full(n, -np.inf, kind), np.full(n, np.iinfo(np.int64).max)

    def add(self, line: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = (score > self.least[line]) | ((score == self.least[line]) & (ids < self.last[line]))
        if not good.any():
            return
        line, score, ids = (np.concatenate(p) for p in ((self.line, line[good]), (self.score, score[good]), (self.id, ids[good])))
        order = np.lexsort((ids, -score, line))
        line, score, ids = line[order], score[order], ids[order]
        first = np.append(True, line[1:] != line[:-1])
        place = np.arange(len(line)) - np.maximum.accumulate(np.where(first, np.arange(len(line)), 0))
        keep = place < self.k
        self.line, self.score, self.id = line[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.least[line[full]], self.last[line[full]] = score[full], ids[full]


def compare(best: Best, a: np.ndarray, anchor: dict, b: np.ndarray, rows: dict, same: bool, low: np.ndarray, high: np.ndarray, sub: np.ndarray) -> None:
    """Adds to best what the rows b have for the anchors sub of a within their windows; same: equal labels and other ids, else other labels."""
    n_windows = low.shape[1]
    s = a[sub].astype(best.kind, copy=False) @ b.T.astype(best.kind, copy=False)
    equal = anchor["label"][sub, None] == rows["label"]
    fits = equal & (anchor["id"][sub, None] != rows["id"]) if same else ~equal
    floor = np.maximum(low[sub], best.least.reshape(-1, n_windows)[sub])
    fits &= (s >= floor.min(1)[:, None]) & (s <= high[sub].max(1)[:, None])
    i, j = np.nonzero(fits)
    s = s[i, j]
    for w in range(n_windows):
        hit = (s >= floor[i, w]) & (s <= high[sub[i], w])
        best.add(sub[i[hit]] * n_windows + w, s[hit], rows["id"][j[hit]])


def _columns(pdf: pd.DataFrame) -> dict:
    return {"id": pdf["id"].to_numpy(np.int64), "label": pdf["label"].to_numpy(np.int64)}


#: The ends of a window without a limit.
OPEN = np.iinfo(np.int64)


def _windows(low: pd.Series, high: pd.Series, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """low and high of each anchor, filled up with windows that hold nothing."""
    n = max([1, *map(len, low)])
    lows, highs = np.full((len(low), n), np.inf, kind), np.full((len(low), n), -np.inf, kind)
    for i, (lo, hi) in enumerate(zip(low, high, strict=True)):
        lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
        lows[i, : len(lo)], highs[i, : len(hi)] = np.where(lo == OPEN.min, -np.inf, lo.astype(kind)), np.where(hi == OPEN.max, np.inf, hi.astype(kind))
    return lows, highs


def _whole(x: np.ndarray) -> np.ndarray:
    """Ends of windows as whole numbers."""
    out = np.full(x.shape, OPEN.min)
    out[np.isfinite(x)] = x[np.isfinite(x)].astype(np.int64)
    out[x == np.inf] = OPEN.max
    return out


@dataclass
class Index:
    """rows: a written table (id, label, vec, leaf, grp); tree with its ranges; the sample and the groups of each leaf."""

    rows: DataFrame
    tree: Tree
    dim: int
    sample: dict
    vectors: np.ndarray
    groups: list[list[int]]
    sizes: list[int]
    kind: type  # of the scores


def build(rows: DataFrame) -> Index:
    """Index of rows (id bigint, label bigint, vec array<double> of whole numbers)."""
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0

    def pack(batches):
        for p in batches:
            x = np.zeros((len(p), dim))
            for i, v in enumerate(p["vec"]):
                x[i, : len(v)] = v
            yield p.assign(vec=packed(x))

    once = rows.mapInPandas(pack, "id bigint, label bigint, vec binary").dropDuplicates()
    table = written(once, "vectors")
    sample = table.orderBy(F.xxhash64("id"), "id", "label", "vec").limit(SAMPLE).toPandas()
    vectors = unpacked(sample["vec"].tolist(), dim)
    tree = Tree(vectors)

    def lead(batches):
        for p in batches:
            yield p.assign(leaf=tree.leaves(unpacked(p["vec"].tolist(), dim)).astype(np.int32) if len(p) else [])

    led = written(table.mapInPandas(lead, "id bigint, label bigint, vec binary, leaf int"), "leaves")

    def measure(batches):
        for node in tree.nodes:
            node.unmeasured()
        count = np.zeros(max(1, tree.n_leaves), np.int64)
        for p in batches:
            x = unpacked(p["vec"].tolist(), dim)
            count += np.bincount(tree.leaves(x, True), minlength=len(count))
        out = [(k, i, j, node.near[i, j], node.far[i, j], node.short[j], node.long[j], 0) for k, node in enumerate(tree.nodes) for i in range(len(node.points)) for j in range(len(node.points)) if node.long[j] >= 0]
        out += [(-1, leaf, 0, 0.0, 0.0, 0.0, 0.0, n) for leaf, n in enumerate(count.tolist()) if n]
        yield pd.DataFrame(out, columns=["k", "i", "j", "near", "far", "short", "long", "n"])

    ranges = led.select("vec").mapInPandas(measure, "k int, i int, j int, near double, far double, short double, long double, n bigint")
    ranges = ranges.groupBy("k", "i", "j").agg(*[f(c).alias(c) for f, c in ((F.min, "near"), (F.max, "far"), (F.min, "short"), (F.max, "long"), (F.sum, "n"))]).collect()  # bounded by the tree
    for node in tree.nodes:
        node.unmeasured()
    sizes = [0] * tree.n_leaves
    for k, i, j, near, far, short, long, n in ranges:
        if k < 0:
            sizes[i] = n
        else:
            node = tree.nodes[k]
            node.near[i, j], node.far[i, j], node.short[j], node.long[j] = near, far, short, long
    most = min(GROUP_ROWS, max(LEAST_GROUP, sum(sizes) // partitions(rows.sparkSession)))
    groups, at, held = [], 0, 0
    for n in sizes:
        salts = max(1, -(-n // most))
        if salts > 1 or held + n > most:
            at, held = at + (held > 0), 0
        groups.append(list(range(at, at + salts)))
        at, held = (at + salts, 0) if salts > 1 else (at, held + n)
    of_leaf = rows.sparkSession.createDataFrame([(leaf, g[0], len(g)) for leaf, g in enumerate(groups)], "leaf int, _first int, _salts int")
    led = led.join(F.broadcast(of_leaf), "leaf")  # a row a leaf of the tree
    led = led.select("id", "label", "vec", "leaf", (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_salts"))).cast("int").alias("grp"))
    longest = max((x for node in tree.nodes for x in node.long.tolist()), default=0)
    return Index(led, tree, dim, _columns(sample), vectors, groups, sizes, np.longdouble if longest >= 1 << 53 else np.float64)


def search(index: Index, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """Rows (akey, anchor_id, low, high, score, id, rank): the k best rows of each anchor and window. anchors: akey, id, label, vec, low and high (arrays).
    same: rows of the anchor's label with another id, else rows of other labels."""
    tree, dim, sample, vectors, groups, exact = index.tree, index.dim, index.sample, index.vectors, index.groups, index.kind
    n_parts = -(-max(1, anchors.count()) // PART)
    kind = "akey bigint, id bigint, label bigint, vec binary, low array<bigint>, high array<bigint>"

    def route(batches):
        for p in batches:
            for lo in range(0, len(p), CHUNK):
                c = p.iloc[lo : lo + CHUNK].reset_index(drop=True)
                a, (low, high), anchor = unpacked(c["vec"].tolist(), dim), _windows(c["low"], c["high"], exact), _columns(c)
                best = Best(low.size, k, exact)
                for b in range(0, len(vectors), BLOCK):
                    compare(best, a, anchor, vectors[b : b + BLOCK], {n: x[b : b + BLOCK] for n, x in sample.items()}, same, low, high, np.arange(len(c)))
                floor = np.maximum(low, best.least.reshape(low.shape))
                seen, floor = tree.visited(a, floor.astype(np.float64), high.astype(np.float64)), _whole(floor)
                sent = [(i, g) for i in range(len(c)) for g in sorted({g for leaf in np.flatnonzero(seen[i]) for g in groups[leaf]})]
                out = c.iloc[[i for i, _ in sent]].assign(grp=[g for _, g in sent])
                yield out.assign(floor=[floor[i, : len(c["low"][i])].tolist() for i, _ in sent])[[*c.columns, "floor", "grp"]]

    lines = anchors.mapInPandas(freed_rows(route), f"{kind}, floor array<bigint>, grp int")
    lines = lines.withColumn("part", F.pmod("akey", F.lit(n_parts)).cast("int"))
    rows = index.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values(["leaf", "id"])
            leaf, held = right["leaf"].to_numpy(), _columns(right)
            b = unpacked(right["vec"].tolist(), dim)
            cuts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
            ends = np.append(cuts[1:], len(leaf))
            for lo in range(0, len(left), CHUNK):
                c = left.iloc[lo : lo + CHUNK].reset_index(drop=True)
                a, (low, high), anchor = unpacked(c["vec"].tolist(), dim), _windows(c["low"], c["high"], exact), _columns(c)
                floor = _windows(c["floor"], c["high"], exact)[0]
                best = Best(low.size, k, exact)
                seen = tree.visited(a, floor.astype(np.float64), high.astype(np.float64))
                for s, e in zip(cuts, ends, strict=True):
                    sub = np.flatnonzero(seen[:, leaf[s]])
                    for x in range(s, e, BLOCK):
                        y = min(e, x + BLOCK)
                        if len(sub):
                            compare(best, a, anchor, b[x:y], {n: v[x:y] for n, v in held.items()}, same, floor, high, sub)
                line, w = np.divmod(best.line, low.shape[1])
                out.append(pd.DataFrame({"akey": c["akey"].to_numpy()[line], "anchor_id": anchor["id"][line], "low": _whole(low[line, w]), "high": _whole(high[line, w]), "score": best.score.astype(np.int64), "id": best.id}))
        cols = {"akey": np.int64, "anchor_id": np.int64, "low": np.int64, "high": np.int64, "score": np.int64, "id": np.int64}
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, t) for c, t in cols.items()})

    found = lines.groupBy("grp", "part").cogroup(rows.groupBy("grp", "part")).applyInPandas(freed2(find), "akey bigint, anchor_id bigint, low bigint, high bigint, score bigint, id bigint")
    rank = F.row_number().over(W.partitionBy("akey", "low", "high").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, vec).

    An anchor's positives are its n_positives other rows of its label with the greatest inner product; of each, the n_negatives rows of
    other labels with the greatest inner product within low to high hundredths of the positive's are returned.
    """
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    d = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vec").cast("array<double>"))
    index = build(d.where("id is not null and label is not null and vec is not null").where(F.forall("vec", number)))
    anchors = index.rows.where(is_anchor).select(F.xxhash64("id", "label", "vec").alias("akey"), "id", "label", "vec")
    up = [F.array(F.lit(int(OPEN.min))).alias("low"), F.array(F.lit(int(OPEN.max))).alias("high")]
    positives = written(search(index, anchors.select("*", *up), n_positives, True), "positives")
    p = F.col("score")
    share = lambda n: p.cast("decimal(20,0)") * F.lit(n).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)")
    window = F.struct(F.ceil(share(low)).cast("long").alias("low"), F.floor(share(high)).cast("long").alias("high"))
    windows = positives.select("akey", p.alias("positive_score"), F.col("id").alias("positive_id"), window.alias("w"))
    wanted = windows.where("w.low <= w.high").groupBy("akey").agg(F.array_sort(F.collect_set("w")).alias("w"))  # n_positives of an anchor at most
    asked = anchors.join(wanted.hint("merge"), "akey").select("akey", "id", "label", "vec", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    negatives = search(index, written(asked, "windows"), n_negatives, False)
    n = negatives.select("akey", "anchor_id", "low", "high", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = windows.select("*", "w.low", "w.high").join(n.hint("merge"), ["akey", "low", "high"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: whole(x * 256))
    return hard_negatives(e.select(F.col("vec_id").alias("id"), label.alias("label"), vec.alias("vec")), F.col("id") % 50 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.s AS ps, n.b AS n, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS rank FROM p JOIN s n ON n.a = p.a AND NOT n.same WHERE 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, rank::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""
