"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read from memory-mapped hash arrays.

Counting. Tasks count the words and the bigrams of their texts in arrays and deal the partial counts to buckets by
hash. A bucket of bigrams belongs to the hash of the first word; bigrams of the few words that are more than one in
HOT_SHARE tokens go by both words, so that a frequent word does not gather in one bucket. Each bucket adds up its
counts and writes sorted arrays of 64-bit hashes to a file in the shared folder; continuation counts are dealt and
added once more. Only file names and sums return.

Scoring. Workers map the files into memory and look up the bigrams of a batch of texts, bucket by bucket.

    p(w | h) = (c(hw) - D(c)) / c(h) + g(h) p1(w),    p1(w) = (k(w) - D'(k)) / K + g' / (V + 1)

where k(w) counts the distinct words before w, K is their sum, D and D' are the three discounts of a level from its
counts of counts, and g and g' hold the discounted mass. An unknown word has the last term alone; after a word that
never came before another, p is p1. The probabilities of all V known words and one unknown word add up to 1.

Null and empty texts are one end token. Null doc_ids are never held out. Repeated rows count and are scored each. Texts
of any length are counted and scored whole; of equally frequent words none is preferred. Columns other than doc_id, text
and held_out are not looked at. An empty training set gives uniform probabilities, and an empty table no rows. The shared folder must be a mounted path (file:) on all machines,
since files elsewhere cannot be mapped into memory.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import freed, freed_rows, partitions, shared_dir, written
from oddlens.llm.jaccard import from_planes, mix64, planes

FOLDS, HELD_OUT = 7, 2
#: Bytes of text to a bucket of words, bigrams and continuation counts, and buckets to a Spark task.
BUCKET_BYTES, TASK_BUCKETS = 5_000_000, 2
#: Tokens that a task counts, or scores, at a time.
FLUSH, AT_ONCE = 1_000_000, 500_000
HOT_SHARE, HOT_OF_BUCKET = 2000, 64
#: Byte strings that cannot be words: the end token and the start, which is only ever a context.
END, START = b"\n", b" "


def fold(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False)))


class Words:
    """64-bit hashes of the tokens of texts; hashes of words are kept while the task runs, up to a bound."""

    KEPT = 300_000

    def __init__(self) -> None:
        import xxhash

        self.digest, self.known = xxhash.xxh3_64_intdigest, {}
        self.end, self.start = np.uint64(self.digest(END)), np.uint64(self.digest(START))

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if isinstance(text, str) else []
        if len(self.known) > self.KEPT:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.digest(w)
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        out[-1] = self.end
        return out

    def before(self, tokens: list[np.ndarray]) -> np.ndarray:
        """The word before each token of the texts end to end; START before the first of each."""
        flat = np.concatenate(tokens)
        first = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])[:-1]
        out = np.roll(flat, 1)
        out[first] = self.start
        return out


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[head], np.add.reduceat(counts[order], head)


def bigram_bucket(w1: np.ndarray, w2: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    h = mix64(w1)
    if len(hot):
        is_hot = found_at(hot, w1)[0]
        h = np.where(is_hot, mix64(h ^ w2), h)
    return (h % np.uint64(n)).astype(np.int64)


def bigram_hash(w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    return mix64(mix64(w1) ^ w2)


def found_at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from counts of counts; kept within their counts, and where a class is empty, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(x, 0.05 * k), 0.99 * k) for k, x in enumerate(d, 1))])


def local_path(folder: str) -> str:
    if "://" in folder and not folder.startswith("file://") or folder.startswith(("hdfs:", "s3")):
        raise ValueError(f"{folder}: the model's files must be on a mounted path to be memory-mapped")
    return folder.removeprefix("file://").removeprefix("file:")


def save(path: str, arrays: dict[str, np.ndarray]) -> str:
    """Arrays end to end in one file; returns where each lies, as name:dtype:offset:length."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    at, parts = 0, []
    with open(path, "wb") as f:
        for name, a in arrays.items():
            f.write(a.tobytes())
            parts.append(f"{name}:{a.dtype.str}:{at}:{len(a)}")
            at += a.nbytes
            f.write(bytes(-at % 8))
            at += -at % 8
    return ";".join(parts)


def mapped(path: str, layout: str) -> dict[str, np.ndarray]:
    raw = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8)
    out = {}
    for part in layout.split(";"):
        name, kind, at, n = part.split(":")
        size = int(n) * np.dtype(kind).itemsize
        out[name] = raw[int(at) : int(at) + size].view(kind)
    return out


_FILE = "kind string, bucket int, path string, layout string, sums array<bigint>, hot binary"


def _file(kind: str, bucket: int, path: str, arrays: dict, sums: list[int], hot: np.ndarray) -> dict:
    return {"kind": kind, "bucket": bucket, "path": path, "layout": save(path, arrays), "sums": sums, "hot": hot.astype("<u8").tobytes()}


def _dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> pd.DataFrame:
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    return pd.DataFrame({"bucket": [int(bucket[p[0]]) for p in parts]} | {f"c{k}": [planes(c[p], 8) for p in parts] for k, c in enumerate(columns)})


def train(docs: DataFrame) -> dict:
    """Counts docs (text) and writes the model; returns its files and sums, whose size follows the number of buckets, one for each BUCKET_BYTES of text."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = n_slots = max(int(total) // BUCKET_BYTES, partitions(spark))
    n_tasks = n // TASK_BUCKETS + 1
    folder = f"{local_path(shared_dir(spark))}/oddlens/kn-{uuid.uuid4().hex}"
    texts = docs.select("text")

    def count_words(batches):
        words, held, size = Words(), [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _dealt((mix64(keys) % np.uint64(n)).astype(np.int64), [keys, counts.astype(np.uint64)])

        for b in batches:
            for t in b["text"].tolist():
                held.append(words.of(t))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def add_words(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = added(*(np.concatenate([from_planes(x, 8) for x in pdf[c]]) for c in ("c0", "c1")))
        top = np.argsort(counts)[-HOT_OF_BUCKET:]
        b = int(pdf["bucket"].iloc[0])
        return pd.DataFrame([_file("word", b, f"{folder}/word-{b}-{uuid.uuid4().hex}", {"key": keys, "count": counts}, [int(counts.sum()), len(keys)], np.stack([keys[top], counts[top]]))])

    word_files = written(texts.mapInPandas(freed_rows(count_words), "bucket int, c0 binary, c1 binary").repartition(n_tasks, "bucket").groupBy("bucket").applyInPandas(freed(add_words), _FILE), "words").collect()
    n_tokens = sum(r["sums"][0] for r in word_files)
    tops = np.concatenate([np.frombuffer(r["hot"], "<u8").reshape(2, -1) for r in word_files], axis=1) if word_files else np.empty((2, 0), np.uint64)
    hot = np.sort(tops[0][tops[1] * np.uint64(HOT_SHARE) > n_tokens])

    def count_bigrams(batches):
        words, held, size = Words(), [], 0

        def flush():
            w2, w1 = np.concatenate(held), words.before(held)
            _, first, c = np.unique(bigram_hash(w1, w2), return_index=True, return_counts=True)
            w1, w2 = w1[first], w2[first]
            bucket = bigram_bucket(w1, w2, hot, n)
            order = np.lexsort((w1, bucket))
            w1, w2, c, bucket = w1[order], w2[order], c[order].astype(np.uint64), bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            rows = {"bucket": [], "c0": [], "c1": [], "c2": [], "c3": []}
            for lo, hi in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
                head = np.flatnonzero(np.append(True, w1[lo + 1 : hi] != w1[lo : hi - 1]))
                rows["bucket"].append(int(bucket[lo]))
                rows["c0"].append(planes(w1[lo:hi][head], 8))
                rows["c1"].append(planes(np.diff(np.append(head, hi - lo)).astype(np.uint64), 4))
                rows["c2"].append(planes(w2[lo:hi], 8))
                rows["c3"].append(planes(c[lo:hi], 4))
            return pd.DataFrame(rows)

        for b in batches:
            for t in b["text"].tolist():
                held.append(words.of(t))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def add_bigrams(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        w1 = np.concatenate([np.repeat(from_planes(x, 8), from_planes(y, 4).astype(np.int64)) for x, y in zip(pdf["c0"], pdf["c1"], strict=True)])
        w2 = np.concatenate([from_planes(x, 8) for x in pdf["c2"]])
        c = np.concatenate([from_planes(x, 4) for x in pdf["c3"]])
        order = np.lexsort((w2, w1))
        w1, w2 = w1[order], w2[order]
        head = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
        c = np.add.reduceat(c[order], head)
        w1, w2 = w1[head], w2[head]
        key = bigram_hash(w1, w2)
        arrays = {"one": np.sort(key[c == 1]), "two": np.sort(key[c == 2])}
        more = np.flatnonzero(c > 2)
        more = more[np.argsort(key[more])]
        arrays |= {"more": key[more], "count": c[more]}
        head = np.flatnonzero(np.append(True, w1[1:] != w1[:-1]))
        ctx = w1[head]
        stats = np.stack([np.add.reduceat(x.astype(np.uint64), head) for x in (c, c == 1, c == 2, c > 2)])
        is_hot = found_at(hot, ctx)[0]
        arrays |= {"ctx": ctx[~is_hot]} | {f"s{k}": stats[k][~is_hot] for k in range(4)}
        file = _file("bigram", b, f"{folder}/bigram-{b}-{uuid.uuid4().hex}", arrays, of_counts(c), np.vstack([ctx[is_hot], stats[:, is_hot]]))
        keys, counts = np.unique(w2, return_counts=True)
        out = _dealt((mix64(keys) % np.uint64(n_slots)).astype(np.int64), [keys, counts.astype(np.uint64)])
        out = out.rename(columns={"c0": "hot", "c1": "more"}).assign(kind="part")
        both = [file | {"slot": -1 - b}, *out.assign(slot=out["bucket"]).to_dict("records")]
        return pd.DataFrame({c: pd.Series([r.get(c) for r in both], dtype="int64" if c in ("bucket", "slot") else object) for c in [*(x.split()[0] for x in _FILE.split(", ")), "more", "slot"]})

    def add_before(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[pdf["kind"] == "bigram"][[x.split()[0] for x in _FILE.split(", ")]]
        part = pdf[pdf["kind"] == "part"]
        if len(part):
            keys, counts = added(*(np.concatenate([from_planes(x, 8) for x in part[c]]) for c in ("hot", "more")))
            b = int(part["bucket"].iloc[0])
            made = _file("before", b, f"{folder}/before-{b}-{uuid.uuid4().hex}", {"key": keys, "count": counts}, [int(counts.sum()), len(keys), *of_counts(counts), int((counts > 2).sum())], np.empty(0))
            out = pd.concat([out, pd.DataFrame([made])], ignore_index=True)
        return out

    dealt = texts.mapInPandas(freed_rows(count_bigrams), "bucket int, c0 binary, c1 binary, c2 binary, c3 binary").repartition(n_tasks, "bucket").groupBy("bucket")
    files = dealt.applyInPandas(freed(add_bigrams), f"{_FILE}, more binary, slot int").repartition(n_tasks, "slot").groupBy("slot").applyInPandas(freed(add_before), _FILE)
    files = written(files, "bigrams").collect()
    hot_stats = np.zeros((4, len(hot)), np.uint64)
    for r in files:
        if r["kind"] == "bigram":
            t = np.frombuffer(r["hot"], "<u8").reshape(5, -1)
            np.add.at(hot_stats, (slice(None), found_at(hot, t[0])[1]), t[1:]) if t.size else None
    total = lambda kind, k: sum(r["sums"][k] for r in files if r["kind"] == kind)
    before = [total("before", k) for k in range(7)]
    return {
        "n": n,
        "n_slots": n_slots,
        "n_tokens": n_tokens,
        "n_types": sum(r["sums"][1] for r in word_files),
        "hot": hot,
        "hot_stats": hot_stats,
        "files": {(r["kind"], r["bucket"]): (r["path"], r["layout"]) for r in [*word_files, *files]},
        "d2": discounts([total("bigram", k) for k in range(4)]),
        "d1": discounts(before[2:6]),
        "k": before[0],
        "k_classes": [before[2], before[3], before[6]],
    }


class Scorer:
    """The model as a worker sees it; files are mapped when first asked for."""

    def __init__(self, model: dict) -> None:
        self.m, self.open = model, {}
        d1, k = model["d1"], model["k"]
        rest = float(np.dot(d1[1:], model["k_classes"])) / k if k else 1.0
        self.floor = rest / (model["n_types"] + 1)

    def arrays(self, kind: str, b: int) -> dict | None:
        if (kind, b) not in self.open:
            at = self.m["files"].get((kind, b))
            self.open[kind, b] = mapped(*at) if at else None
        return self.open[kind, b]

    def _count(self, kind: str, w: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct words."""
        out = np.zeros(len(w), np.int64)
        bucket = (mix64(w) % np.uint64(self.m["n" if kind == "word" else "n_slots"])).astype(np.int64)
        for b, at in _by(bucket):
            if (a := self.arrays(kind, b)) is not None:
                ok, where = found_at(a["key"], w[at])
                out[at[ok]] = a["count"][where[ok]]
        return out

    def words(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, p1) of each word."""
        keys, back = np.unique(w, return_inverse=True)
        count, k = self._count("word", keys), self._count("before", keys)
        p = np.maximum(k - self.m["d1"][np.minimum(k, 3)], 0) / max(1, self.m["k"]) + self.floor
        return count[back], p[back]

    def bigrams(self, w1: np.ndarray, w2: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """p(w2 | w1) of each pair; p1: of w2."""
        key = bigram_hash(w1, w2)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        key, w1, p1, w2 = key[first], w1[first], p1[first], w2[first]
        c, stats = np.zeros(len(key), np.int64), np.zeros((4, len(key)))
        for b, at in _by(bigram_bucket(w1, w2, self.m["hot"], self.m["n"])):
            if (a := self.arrays("bigram", b)) is None:
                continue
            for name, value in (("one", 1), ("two", 2), ("more", 0)):
                ok, where = found_at(a[name], key[at])
                c[at[ok]] = value or a["count"][where[ok]]
            ok, where = found_at(a["ctx"], w1[at])
            for j in range(4):
                stats[j, at[ok]] = a[f"s{j}"][where[ok]]
        ok, where = found_at(self.m["hot"], w1)
        stats[:, ok] = self.m["hot_stats"][:, where[ok]]
        seen = stats[0] > 0
        total = np.where(seen, stats[0], 1)
        d = self.m["d2"]
        rest = np.where(seen, (d[1] * stats[1] + d[2] * stats[2] + d[3] * stats[3]) / total, 1.0)
        return (np.maximum(c - d[np.minimum(c, 3)], 0) / total + rest * p1)[back]


def _by(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(at):
            yield int(bucket[at[0]]), at


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text, held_out): rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    n_tokens, n_types = model["n_tokens"], model["n_types"]

    def score(batches):
        words, scorer = Words(), Scorer(model)
        for b in batches:
            texts, at = b["text"].tolist(), 0
            while at < len(texts):
                tokens, size, start = [], 0, at
                while at < len(texts) and size < AT_ONCE:
                    tokens.append(words.of(texts[at]))
                    size += len(tokens[-1])
                    at += 1
                first = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])[:-1]
                flat = np.concatenate(tokens)
                count, p1 = scorer.words(flat)
                p = scorer.bigrams(words.before(tokens), flat, p1)
                total = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731
                base = np.log10((count + 1) / (n_tokens + 1 * (n_types + 1)))
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].iloc[start:at].astype("Int64").reset_index(drop=True), "held_out": b["held_out"].iloc[start:at].to_numpy(bool), "n_tokens": [len(t) for t in tokens],
                    "n_known": total((count > 0).astype(np.int64)), "train_tokens": n_tokens, "base_score": total(base), "score": total(np.log10(p)),
                })

    return docs.select("doc_id", "text", "held_out").mapInPandas(freed_rows(score), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = fold(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return scored(docs, train(docs.where("not held_out")))
