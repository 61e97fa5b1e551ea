"""Periodic runs of words by seeds and extended diagonals, and texts with the repeats taken out.

A run of period q is a maximal stretch of words of which those q apart are equal, q being its smallest period, with a
length of at least max(LEAST, COPIES * q) words. Words q apart are a diagonal of the comparison of a text with itself, on
which a run leaves a stretch of at least 3 q equal pairs. So lags are taken by octave: for lags from 2**m to below
2**(m + 1), every run holds an equal k-gram of k = 3 * 2**m words on its diagonal (5 for lag 1), the guaranteed overlap.
The k-grams of a text are indexed by exact ranks, by prefix doubling over those places only whose shorter gram repeats.
Two occurrences of a k-gram that follow one another make a pair; their lag is then the smallest period of the
stretch (as k >= lag, a smaller one would put an occurrence in between), and a run's first k-gram is such a pair, so
there are no more pairs than words an octave. A pair is extended to both sides along its diagonal, unless the table of the
furthest place covered of its lag is beyond it already.

The texts of a portion are laid end to end; words have numbers of their own in each text, so that no gram, pair or
extension crosses from one into another.

Null, empty and blank texts have no words and no runs; their collapsed text is empty. Texts of any length are handled whole; a
portion holds at most PORTION characters or one text. Runs may overlap; equal places cannot have two runs of one period.
Repeated rows and null ids are handled row by row. Only the id and the text are read, so other columns cannot
clash. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import freed_rows, let, words

LEAST, COPIES = 6, 4
#: Characters of texts that a task handles at once.
PORTION = 4_000_000


def _again(at: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Ranks by place of the keys that occur at least twice; -1 elsewhere."""
    out = np.full(n, -1, np.int64)
    _, rank, count = np.unique(keys, return_inverse=True, return_counts=True)
    more = count[rank] > 1
    out[at[more]] = rank[more]
    return out


def _joined(first: np.ndarray, second: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, and a key for each, of the grams that consist of one of `first` and, gap words on, one of `second`."""
    at = np.flatnonzero(first[:-gap] >= 0) if gap < len(first) else np.empty(0, np.int64)
    at = at[second[at + gap] >= 0]
    return at, first[at] * (len(first) + 1) + second[at + gap]


def _pairs(at: np.ndarray, keys: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of occurrences of a gram that follow one another at a lag from low to below high, by place."""
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    lag = at[1:] - at[:-1]
    hit = (keys[1:] == keys[:-1]) & (lag >= low) & (lag < high)
    place, lag = at[:-1][hit], lag[hit]
    order = np.argsort(place, kind="stable")
    return place[order], lag[order]


def _equal_after(w: np.ndarray, i: int, j: int) -> int:
    """How many words from i < j on are equal to those from j on."""
    n, done, step = len(w) - j, 0, 64
    while done < n:
        s = min(step, n - done)
        same = w[i + done : i + done + s] == w[j + done : j + done + s]
        if not same.all():
            return done + int(same.argmin())
        done, step = done + s, step * 2
    return n


def _equal_before(w: np.ndarray, i: int, j: int) -> int:
    """How many words before i < j are equal to those before j."""
    done, step = 0, 64
    while done < i:
        s = min(step, i - done)
        same = (w[i - done - s : i - done] == w[j - done - s : j - done])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, step = done + s, step * 2
    return i


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of word numbers, in no order. Equal numbers are equal words of one text."""
    n, runs = len(w), []
    rank = {1: _again(np.arange(n), w, n)}
    for size in (1, 2):
        rank[2 * size] = _again(*_joined(rank[size], rank[size], size), n)
    octave = 0
    while True:
        low = 1 << octave
        if octave == 0:
            k, grams = 5, _joined(rank[4], rank[1], 4)
        else:
            if 2 * low not in rank:
                rank[2 * low] = _again(*_joined(rank[low], rank[low], low), n)
            k, grams = 3 * low, _joined(rank[2 * low], rank[low], 2 * low)
        covered: dict[int, int] = {}
        for i, q in zip(*(x.tolist() for x in _pairs(*grams, low, 2 * low)), strict=True):
            if i < covered.get(q, 0):
                continue
            end = i + k + _equal_after(w, i + k, i + k + q)
            start = i - _equal_before(w, i, i + q)
            covered[q] = end
            if end - start + q >= max(LEAST, COPIES * q):
                runs.append((start, end - start + q, q))
        if octave and not len(grams[0]):
            return runs
        octave += 1


def _portion(texts: list[str | None]):
    """Of each text: its runs, by start and period, and the text of the words that stay."""
    parts = [t.encode().split() if t else [] for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(size) - size
    numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
    w = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(size.sum()))
    w += np.repeat(np.arange(len(parts)), size) * (len(numbers) + 1)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, q in find_runs(w):
        doc = int(np.searchsorted(first, start, "right")) - 1
        found.setdefault(doc, []).append((start - int(first[doc]), length, q))
    runs, kept = [], []
    for d, p in enumerate(parts):
        own = sorted(found.get(d, ()), key=lambda r: (r[0], r[2]))
        if own:
            stays = np.ones(len(p), bool)
            for start, length, q in own:
                stays[start + q : start + length] = False
            p = itertools.compress(p, stays.tolist())
        runs.append(own)
        kept.append(b" ".join(p))
    return size, runs, kept


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_words, runs, collapsed): runs of (start, length, period) in words from 0, and the words that stay, joined by one
    space: all but those that some run holds after its first period."""
    kind = docs.schema[key].dataType.simpleString()

    def search(batches):
        import pyarrow as pa

        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in batches:
            chars = np.cumsum(b.column(1).cast(pa.large_string()).to_pandas().str.len().fillna(0).to_numpy())
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(chars, (chars[lo - 1] if lo else 0) + PORTION, "right")))
                part = b.slice(lo, hi - lo)
                size, runs, kept = _portion(part.column(1).to_pylist())
                flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(own) for own in runs])]), pa.int32())
                cells = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(run))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.ListArray.from_arrays(ends, cells), pa.array(kept, pa.binary()).cast(pa.string())], names=[key, "n_words", "runs", "collapsed"])
                lo = hi

    return docs.select(key, text).mapInArrow(freed_rows(search), f"{key} {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def folded(text: Column, doc_id: Column) -> Column:
    """The text, where crc32(doc_id) is divisible by ten with its words from some place on replaced by repeats of the first of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))
        return F.when(n > 0, F.array_join(at, " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(words(text), repeat)).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", folded(F.col("text"), F.col("doc_id")).alias("text"))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q")))), 1)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    d = periodic_runs(docs).withColumn("_b", F.when(F.size("runs") > 0, best))
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.s").alias("start"), (-F.col("_b.l")).alias("length"), F.col("_b.q").alias("period"),
        F.floor(-1000 * F.col("_b.l") / F.col("_b.q")).alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
