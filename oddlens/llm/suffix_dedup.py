"""Suffix-array dedup: removes every byte that a string of MIN_LEN bytes covers which also starts in an earlier document.

Documents are dealt to batches by a hash, so that each batch fits a task, and batches ask buckets three questions. All
batches read one shuffle of the texts.

1. Which whole texts have an earlier copy (equal SHA-256)? Copies go as a whole and take no further part.
2. Which grams occur elsewhere? Every window of MIN_LEN bytes chooses one gram (suffixes.units); a batch sends the
   hash of each of its grams once and learns which are in other documents too, and which stand in very many strings.
   Other windows cannot repeat.
3. Which windows around shared grams stand in an earlier document? The batch sends each distinct string around such a
   gram once, with its least document, to the bucket of the gram. The bucket sorts the strings as suffixes
   (hash-compared mergesort, checked on the bytes), then the windows of those whose gram stands in several strings, and
   tells of each window whether it stands in an earlier document. Of a gram that stands in HOT strings or more, the
   windows go one by one to the bucket of the window, so that no bucket gathers the gram; they are judged alike.

A batch sends a string once however often it holds it, so a string that a third of the documents share costs a bucket
one entry a batch. Strings are equal if their bytes are: hashes only bring them together. The bytes of a batch grow
with the root of the input, so that the rows (batch, bucket) of a question grow in proportion to it.

Null and empty texts have no bytes. Rows with a null doc_id are neither earlier nor later than others, keep all and
are in no batch. Rows with one doc_id do not remove from each other; equal rows get equal results. Of equal strings
that of the least doc_id stays. Texts of any length are whole; one longer than a batch is a batch of its own, whose
hashes are computed in segments. Columns besides doc_id and text are carried in one struct, so their names cannot
clash. An empty table gives no rows. kept_sha256 is taken over the remaining bytes; where a cut splits a character,
the text given back leaves out its rest.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from oddlens.llm.common import freed, freed2, lookup, partitions, written
from oddlens.llm.jaccard import from_planes, mix64, planes
from oddlens.llm.suffixes import GRAM, SuffixSorter, distinct, powers, string_hashes, units

MIN_LEN = 50
#: A batch has at least so many bytes, and so many of the input for each of its rows to a bucket.
BATCH_BYTES, ROW_BYTES = 2_000_000, 1000
#: Batches that meet in one Spark task, on average.
TASK_BATCHES = 8
#: Different strings around one gram, as counted by batches, from which its windows are dealt one by one.
HOT = 20_000
#: Bytes of strings that a bucket sorts at a time.
CHUNK = 500_000
COPIES, GRAMS, STRINGS = range(3)
_ASK = "bucket bigint, kind int, batch bigint, p0 binary, p1 binary, p2 binary, p3 binary"
_TELL = "_batch bigint, kind int, bucket bigint, answer binary"
_WHOLE = (1 << 16) - 1


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _as_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Where a sorted array has a new value; its length comes last."""
    return np.append(np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])), len(sorted_values)) if len(sorted_values) else np.zeros(1, np.int64)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of n numbers each, one after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Batch:
    """The documents of a batch that are not copies, and what the answers so far say about them."""

    def __init__(self, docs: pa.Table, told: pa.Table, n_buckets: int, width: int) -> None:
        self.n, self.width = n_buckets, width
        self.told: dict[int, dict[int, bytes]] = {}
        for kind, bucket, answer in zip(*(told.column(c).to_pylist() for c in ("kind", "bucket", "answer")), strict=True):
            self.told.setdefault(kind, {})[bucket] = answer
        raw = self.told.pop(COPIES, {}).get(0) or b""
        copies = {raw[k : k + 40] for k in range(0, len(raw), 40)}
        ids, texts, digests = (docs.column(c) for c in ("_id", "_bytes", "_digest"))
        ids = ids.to_numpy()
        self.copy = np.array([i.tobytes() + d in copies for i, d in zip(ids, digests.to_pylist(), strict=True)], bool)
        self.place = np.flatnonzero(~self.copy)
        self.place = self.place[np.argsort(ids[self.place], kind="stable")]
        parts = [texts[k].as_buffer() for k in self.place.tolist()]
        # documents of one id in the order of their bytes, so that every round sees the same batch
        for lo, hi in zip(*(lambda c: (c[:-1].tolist(), c[1:].tolist()))(_cuts(ids[self.place])), strict=True):
            if hi - lo > 1:
                order = sorted(range(lo, hi), key=lambda k: bytes(parts[k]))  # noqa: B023
                self.place[lo:hi], parts[lo:hi] = self.place[order], [parts[k] for k in order]
        self.ids = ids[self.place]
        self.ends = np.cumsum([p.size for p in parts], dtype=np.int64)
        self.buf = np.frombuffer(b"".join(parts), np.uint8)
        self.first, self.last, self.gram, self.key = units(self.buf, self.ends, width)
        self.doc = self.ids[np.searchsorted(self.ends, self.first, side="right")] if len(self.first) else self.first

    def _rows(self, kind: int, bucket: np.ndarray, columns: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, list[dict]]:
        """One row a bucket of entries that are in order of bucket."""
        cut = _cuts(bucket)
        return cut, [
            {"bucket": int(bucket[lo]), "kind": kind} | {f"p{k}": planes(c[lo:hi].view(np.uint64), n) for k, (c, n) in enumerate(columns)}
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)
        ]

    def _answers(self, kind: int, bucket: np.ndarray, n: np.ndarray) -> list[tuple[bytes, int]]:
        """The answer of each bucket, in order, and the sum of n over its entries."""
        cut = _cuts(bucket)
        total = np.add.reduceat(n, cut[:-1]).tolist() if len(bucket) else []
        return [(self.told[kind][b], k) for b, k in zip(bucket[cut[:-1]].tolist(), total, strict=True)]

    # the second question

    def grams(self):
        """(bucket, rest, tag, back) of the distinct keys, in order of bucket, and the key of each unit. tag: whether this
        batch has it in several documents, and the logarithm of its distinct strings."""
        n = np.uint64(self.n)
        short = (self.key // n & np.uint64((1 << 40) - 1)) | self.key % n << np.uint64(40)
        keys, back = np.unique(short, return_inverse=True)
        if not len(keys):
            e = np.empty(0, np.int64)
            return e, e.astype(np.uint64), e.astype(np.uint64), e
        lo, hi = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(lo, back, self.doc)
        np.maximum.at(hi, back, self.doc)
        text = string_hashes(self.buf, self.first, self.last - self.first + self.width)
        order = np.lexsort((text, back))
        fresh = np.append(True, (back[order][1:] != back[order][:-1]) | (text[order][1:] != text[order][:-1]))
        count = np.bincount(back[order][fresh], minlength=len(keys))
        tag = (lo != hi).astype(np.uint64) << np.uint64(7) | np.log2(count).astype(np.uint64)
        return (keys >> np.uint64(40)).astype(np.int64), keys & np.uint64((1 << 40) - 1), tag, back

    def ask_grams(self) -> list[dict]:
        bucket, rest, tag, _ = self.grams()
        return self._rows(GRAMS, bucket, [(rest, 5), (tag, 1)])[1]

    # the third

    def strings(self):
        """Finds the distinct strings around shared grams: for each of them where it is, its size, document, gram (_WHOLE
        for a single window) and bucket, in order of bucket; and of each unit or window its first and last start,
        document and string."""
        bucket, _, _, back = self.grams()
        told = [_as_bits(raw, 2 * n).reshape(2, -1) for raw, n in self._answers(GRAMS, bucket, np.ones(len(bucket), np.int64))]
        shared, hot = np.concatenate(told, axis=1)[:, back] if told else np.empty((2, 0), bool)
        one = shared & ~hot
        n = (self.last - self.first + 1)[hot]
        at = np.concatenate([self.first[one], _ranges(self.first[hot], n)])
        last = np.concatenate([self.last[one], at[one.sum() :]])
        doc = np.concatenate([self.doc[one], np.repeat(self.doc[hot], n)])
        gram = np.concatenate([(self.gram - self.first)[one], np.full(n.sum(), _WHOLE)])
        key = np.concatenate([self.key[one], np.empty(n.sum(), np.uint64)])
        order = np.argsort(at, kind="stable")
        at, last, doc, gram, key = at[order], last[order], doc[order], gram[order], key[order]
        size = last - at + self.width
        text = string_hashes(self.buf, at, size)
        key = np.where(gram == _WHOLE, text, key)
        group, heads = distinct(self.buf, at, size, mix64(text ^ gram.astype(np.uint64)))
        least = np.full(len(heads), np.iinfo(np.int64).max)
        np.minimum.at(least, group, doc)
        bucket = (key[heads] % np.uint64(self.n)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        of = np.empty(len(by), np.int64)
        of[by] = np.arange(len(by))
        heads = heads[by]
        return (at[heads], size[heads], least[by], gram[heads], bucket[by]), (at, last, doc, of[group])

    def ask_strings(self) -> list[dict]:
        (at, size, doc, gram, bucket), _ = self.strings()
        cut, rows = self._rows(STRINGS, bucket, [(doc, 8), (size, 2), (gram, 2)])
        raw = self.buf.data
        for row, lo, hi in zip(rows, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            row["p3"] = b"".join([raw[a : a + n] for a, n in zip(at[lo:hi].tolist(), size[lo:hi].tolist(), strict=True)])
        return rows

    # the answer

    def removed(self) -> dict[int, np.ndarray]:
        """The spans (begin, end) to remove of each row of the batch that has any."""
        (at, size, least, _, bucket), (first, last, doc, of) = self.strings()
        out: dict[int, np.ndarray] = {}
        if not len(at):
            return out
        n = size - self.width + 1
        gone = np.concatenate([_as_bits(raw, k) for raw, k in self._answers(STRINGS, bucket, n)])
        base = np.cumsum(n) - n
        covered = doc > least[of]
        begin, end = [first[covered]], [last[covered]]
        open_ = np.flatnonzero(~covered)
        windows = last[open_] - first[open_] + 1
        hit = _ranges(first[open_], windows)[gone[_ranges(base[of[open_]], windows)]]
        begin, end = np.concatenate([*begin, hit]), np.concatenate([*end, hit]) + self.width
        if not len(begin):
            return out
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        row = np.searchsorted(self.ends, begin, side="right")
        far = np.maximum.accumulate(end)
        head = np.flatnonzero(np.append(True, (begin[1:] > far[:-1]) | (row[1:] != row[:-1])))
        stop = far[np.append(head[1:], len(begin)) - 1]
        begin, row = begin[head], row[head]
        start = np.concatenate([[0], self.ends[:-1]])[row]
        spans = np.stack([begin - start, stop - start], axis=1)
        cut = _cuts(row)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out[int(self.place[row[lo]])] = spans[lo:hi]
        return out


def _reply_grams(pdf: pd.DataFrame) -> list[bytes]:
    key = [from_planes(x, 5) for x in pdf["p0"]]
    cut = np.cumsum([len(k) for k in key])[:-1]
    _, back, batches = np.unique(np.concatenate(key), return_inverse=True, return_counts=True)
    tag = np.concatenate([from_planes(x, 1) for x in pdf["p1"]])
    several = np.bincount(back, weights=tag >> np.uint64(7)) > 0
    # a batch tells a power of two of its strings, at least half of them
    strings = np.bincount(back, weights=np.exp2((tag & np.uint64(127)).astype(float)))
    shared, hot = (batches > 1) | several, 2 * strings > HOT
    return [_bits(np.concatenate([shared[b], hot[b]])) for b in np.split(back, cut)]


def _reply_strings(pdf: pd.DataFrame, width: int) -> list[bytes]:
    """Which windows of the strings of a bucket stand in an earlier document."""
    doc, size, gram = (np.concatenate([from_planes(x, n) for x in pdf[c]]).view(np.int64) for c, n in (("p0", 8), ("p1", 2), ("p2", 2)))
    buf = np.frombuffer(b"".join(pdf["p3"]), np.uint8)
    at = np.cumsum(size) - size
    power = powers(int(size.max()) + 1)[0]
    key = np.empty(len(at), np.uint64)
    for lo in range(0, len(at), 20_000):
        hi = min(lo + 20_000, len(at))
        part = buf[at[lo] : at[hi - 1] + size[hi - 1]]
        begin = at[lo:hi] - at[lo] + np.where(gram[lo:hi] == _WHOLE, 0, gram[lo:hi])
        key[lo:hi] = _gram_keys(part, begin, np.where(gram[lo:hi] == _WHOLE, width, GRAM), power)
    n = size - width + 1
    base = np.cumsum(n) - n
    gone = np.zeros(int(n.sum()), bool)
    order = np.argsort(key, kind="stable")
    cut = _cuts(key[order])
    # whole keys, up to CHUNK bytes together
    total = np.cumsum(size[order])[cut[1:] - 1]
    lo = 0
    while lo < len(cut) - 1:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK, side="right")))
        _judge(buf, at, size, doc, key, order[cut[lo] : cut[hi]], n, base, gone, width)
        lo = hi
    ends = np.cumsum([len(x) // 2 for x in pdf["p1"]])[:-1]
    return [_bits(x) for x in np.split(gone, base[ends] if len(ends) else [])]


def _gram_keys(part: np.ndarray, begin: np.ndarray, n: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Hashes of the strings of n bytes at begin."""
    out = np.zeros(len(begin), np.uint64)
    for k in range(int(n.max())):
        here = np.flatnonzero(k < n)
        out[here] += (part[begin[here] + k].astype(np.uint64) + np.uint64(1)) * power[k]
    return out


def _judge(buf, at, size, doc, key, which, n, base, gone, width) -> None:
    """Sets gone for the windows of the strings in which that stand in an earlier document."""
    local = size[which]
    begin = np.cumsum(local) - local
    sorter = SuffixSorter(buf[_ranges(at[which], local)])
    order, same = sorter.sort(begin, local)
    group = np.empty(len(which), np.int64)
    group[order] = np.cumsum(~same) - 1
    heads = order[~same]
    least = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc[which])
    # windows can only repeat among different strings of one key
    of = key[which[heads]]
    _, back, count = np.unique(of, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[back] > 1)
    windows = n[which[heads]]
    bits = np.zeros(int(windows.sum()), bool)
    first = np.cumsum(windows) - windows
    for part in _portions(several, windows[several], of):
        start = _ranges(begin[heads[part]], windows[part])
        own = np.repeat(least[part], windows[part])
        order, same = sorter.sort(start, np.full(len(start), width))
        low = np.minimum.reduceat(own[order], np.flatnonzero(~same))[np.cumsum(~same) - 1]
        hit = np.empty(len(start), bool)
        hit[order] = low < own[order]
        bits[_ranges(first[part], windows[part])] = hit
    mine = bits[_ranges(first[group], n[which])]
    mine |= np.repeat(doc[which] > least[group], n[which])
    gone[_ranges(base[which], n[which])] = mine


def _portions(strings: np.ndarray, windows: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """The strings, dealt so that those of one key stay together and a portion has about 100,000 windows."""
    if not len(strings):
        return []
    order = np.argsort(of[strings], kind="stable")
    strings, total = strings[order], np.cumsum(windows[order])
    cut = _cuts(of[strings])[1:-1]
    step = total[cut - 1] // 100_000 if len(cut) else cut
    return np.split(strings, cut[np.flatnonzero(np.diff(np.append(0, step)))])


def _reply(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """Answers of a bucket to one kind of question."""
    kind = int(pdf["kind"].iloc[0])
    answer = _reply_grams(pdf) if kind == GRAMS else _reply_strings(pdf, width)
    return pd.DataFrame({"_batch": pdf["batch"], "kind": kind, "bucket": pdf["bucket"], "answer": answer})


_FOUND = T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("spans", T.ArrayType(T.StructType().add("begin", "long").add("end", "long")))


def removed_spans(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """docs (doc_id, text, ...): a row each of doc, a struct of all its columns with text cut, and n_bytes, n_removed, n_spans, kept_sha256 and spans (begin, end in bytes of the input)."""
    cols, spark = docs.columns, docs.sparkSession
    other = [c for c in cols if c not in ("doc_id", "text")]
    takes_part = F.col("doc_id").isNotNull() & (F.octet_length("text") >= min_len)
    total = int(docs.agg(F.sum(F.when(takes_part, F.octet_length("text").cast("long")))).first()[0] or 0)
    n_batches = total // max(BATCH_BYTES, math.isqrt(ROW_BYTES * total)) + 1
    n_tasks, n_buckets = max(n_batches // TASK_BATCHES, 1), max(n_batches, partitions(spark))
    digest = F.unhex(F.sha2("text", 256))
    rest = F.struct(*[docs[c] for c in other] or [F.lit(None).cast("int").alias("_none")])
    plain = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", rest.alias("_rest"), docs["doc_id"].alias("_own"))
    keep = plain.where(F.col("_id").isNull() | F.coalesce(F.octet_length("text") < min_len, F.lit(True)))
    data = plain.where(F.col("_id").isNotNull() & (F.octet_length("text") >= min_len)).withColumn("_digest", digest)
    batch = F.pmod(F.xxhash64("_id", "_digest"), F.lit(n_batches))
    # copies of whole texts
    whole = written(data.select("_id", "_digest"), "whole")
    least = written(whole.groupBy("_digest").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).where("_least < _most").select("_digest", "_least"), "texts")
    copies = lookup(whole, least, "_digest").where("_id > _least").select("_id", "_digest", batch.alias("_batch")).distinct()

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        raw = b"".join(i.tobytes() + bytes(d) for i, d in zip(p["_id"].to_numpy(np.int64), p["_digest"], strict=True))
        return pd.DataFrame({"_batch": p["_batch"].iloc[:1], "kind": COPIES, "bucket": 0, "answer": [raw]})

    copies = written(copies.groupBy("_batch").applyInPandas(pack, _TELL), "copies")
    slim = data.select("_id", "_digest", F.col("text").cast("binary").alias("_bytes"), "_rest", "_own", batch.alias("_batch")).repartition(n_tasks, "_batch")
    by_batch = slim.groupBy("_batch")
    ask_type = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("batch", pa.int64()), *((f"p{k}", pa.binary()) for k in range(4))])

    def ask(method: str):
        def f(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return ask_type.empty_table()
            rows = getattr(Batch(left, right, n_buckets, min_len), method)()
            b = left.column("_batch")[0].as_py()
            return pa.Table.from_pylist([r | {"batch": b} for r in rows], ask_type)

        return f

    told = copies
    for method in ("ask_grams", "ask_strings"):
        asked = by_batch.cogroup(told.repartition(n_tasks, "_batch").groupBy("_batch")).applyInArrow(freed2(ask(method)), _ASK)
        replies = asked.repartition(max(n_tasks, n_buckets // TASK_BATCHES), "bucket").groupBy("bucket", "kind").applyInPandas(freed(lambda pdf: _reply(pdf, min_len)), _TELL)
        told = told.unionAll(replies)
    given = T.StructType([T.StructField("_rest", slim.schema["_rest"].dataType), T.StructField("_own", slim.schema["_own"].dataType), T.StructField("text", T.StringType()), T.StructField("_found", _FOUND)])
    empty = to_arrow_schema(given).empty_table()

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        batch = Batch(left, right, n_buckets, min_len)
        spans = batch.removed()
        text, found = [], []
        for k, raw in enumerate(left.column("_bytes")):
            raw = raw.as_buffer()
            t = memoryview(raw)
            gone = [(0, len(t))] if batch.copy[k] else [(int(a), int(b)) for a, b in spans.get(k, ())]
            kept, at = [], 0
            for a, b in gone:
                kept.append(t[at:a])
                at = b
            rest = b"".join([*kept, t[at:]])
            text.append(rest.decode(errors="ignore"))
            found.append((len(t), len(t) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), [{"begin": a, "end": b} for a, b in gone]))
        found = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found, strict=True), empty.schema.field("_found").type, strict=True)], fields=list(empty.schema.field("_found").type))
        return pa.table([left.column("_rest"), left.column("_own"), pa.array(text, pa.string()), found], names=["_rest", "_own", "text", "_found"])

    out = by_batch.cogroup(told.repartition(n_tasks, "_batch").groupBy("_batch")).applyInArrow(freed2(cut), given)
    body = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    none = F.struct(F.octet_length(body).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))
    out = out.unionAll(keep.select("_rest", "_own", "text", none.alias("_found")))
    doc = F.struct(*[F.col("_own").alias(c) if c == "doc_id" else F.col("text").alias(c) if c == "text" else F.col("_rest").getField(c).alias(c) for c in cols])
    return out.select(doc.alias("doc"), *[F.col("_found").getField(f.name).alias(f.name) for f in _FOUND])


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed_spans(docs).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def suffix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with repeated strings cut out of their texts (n_chars follows, if it is a number); those of which nothing but white space is left go."""
    text, n_removed = F.col("doc").getField("text"), F.col("n_removed")
    out = removed_spans(docs).where(~((n_removed > 0) & ~text.rlike(r"[^\x20\x09-\x0D]")))
    cols = {c: F.col("doc").getField(c) for c in docs.columns}
    if "n_chars" in cols and isinstance(docs.schema["n_chars"].dataType, T.NumericType):
        cols["n_chars"] = F.when(n_removed > 0, F.length(text)).otherwise(cols["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[x.alias(c) for c, x in cols.items()])


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM d, unnest(range(0, n - 49)) AS u(p) WHERE n >= 50),
hit AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS fresh FROM hit)),
span AS (SELECT doc_id, k, min(p) AS b, max(p) + 50 AS e FROM run GROUP BY doc_id, k),
piece AS (SELECT doc_id, coalesce(lag(e) OVER w, 0) AS b, b AS e FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY b)
  UNION ALL SELECT d.doc_id, coalesce(max(span.e), 0), any_value(n) FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2 * (e - b)), '' ORDER BY b) AS k FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, (n - length(k) / 2)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS s FROM span GROUP BY doc_id) USING (doc_id)
"""
