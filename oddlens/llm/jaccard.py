"""N-gram Jaccard join with parity sketches.

A document's set holds its distinct 5-word shingles as 64-bit hashes. For sets of n shingles at most, links of
Jaccard 0.8 allow a symmetric difference of D = 2n // 9. Shingles toggle bits of a sketch (each is XORed into one of
2^16 bits of one of P pieces), so two sketches differ in at most as many bits, and hence pieces, as the sets do in
shingles: at least P - D pieces agree. Documents of one size band compare pieces for equality; a smaller partner may
lie in the band below, so each document enters its own band and the next. As P - D pieces agree, each document may
leave out its P - D - 1 most frequent pieces and a link still has a piece that both keep: pieces with fewer than two
toggled bits go first (and are not even sent, unless a document has too many), then those that most documents share.
A document with too many leaves out low pieces only: a partner may not have sent its own, so no ordinary piece may go in
their place.
A passage that many documents share fills few pieces of each and so makes no candidates. Equal pieces give candidate
pairs. Their whole sketches, folded into 4 to 8 bits a shingle, drop those that differ in more than D bits; the rest
are verified on the sets.

Equal sets form a class, and only its least document is joined. Each document is first verified against the candidate
with which it shares most pieces, then against the one with the nearest sketch, and then all pairs that still lie in
different components are. Sketches are compared among the documents that share a piece with the least document of that
piece: those outside the largest component among them with each other and with that component, in blocks of BLOCK
documents. Components come from alternating stars.

Null, empty and blank texts have an empty set and link with nothing. Texts with fewer words than a shingle have one
shingle. Very long texts are hashed one by one, whole. Equal sets share one component, whose number is the least
doc_id; among candidates with equally many shared pieces or bits the least doc_id is verified first, which does not
change the result. Rows with one doc_id are one node, also when their texts differ (rows then get numbers of their own,
in a written copy). Rows with a null doc_id are counted but join nothing (component null). Columns other than doc_id
and text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import BROADCAST_ROWS, freed, freed_rows, lookup, partitions, spread, with_few, written
from oddlens.llm.components import components

WIDTH = 5
NUM, DEN = 80, 100
#: Texts that are hashed together, and their characters; a longer text is hashed by itself.
AT_ONCE, AT_ONCE_CHARS = 128, 500_000
#: Entries that a task gathers before it deals them to buckets.
FLUSH = 250_000
#: A bucket of pieces gets the entries of so many bytes of text at least, and of so many for each of its rows from a task.
BUCKET_BYTES, ROW_BYTES = 8_000_000, 400
#: Buckets to a shuffle partition, for pairs of blocks.
BUCKETS = 4
#: Documents of one piece whose sketches meet in one task, at most about twice as many.
BLOCK = 4000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct shingle hashes of texts; word hashes are kept while the task runs, up to a bound."""

    KEPT = 100_000

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        import xxhash

        words = text.encode().lower().split() if isinstance(text, str) else []  # bytes: A-Z and the six white-space bytes only
        if len(self.known) > self.KEPT:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def _rolled(h: np.ndarray, n: int) -> np.ndarray:
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s = mix64(s ^ h[k : len(h) - n + 1 + k])
        return s

    def of(self, texts: list) -> list[np.ndarray]:
        """The sets of some texts; shingles are hashed over all of them end to end, and those across an end left out."""
        words = [self.words(t) for t in texts]
        flat = np.concatenate([*words, np.empty(0, np.uint64)])
        rolled = self._rolled(flat, WIDTH) if len(flat) >= WIDTH else flat
        out, at = [], 0
        for w in words:
            if len(w) >= WIDTH:
                out.append(np.unique(rolled[at : at + len(w) - WIDTH + 1]))
            else:
                out.append(self._rolled(w, len(w)) if len(w) else w)
            at += len(w)
        return out


def portions(texts: list):
    """Slices of texts that are hashed together."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if k > lo and (k - lo == AT_ONCE or size + n > AT_ONCE_CHARS):
            yield slice(lo, k)
            lo, size = k, 0
        size += n
    if lo < len(texts):
        yield slice(lo, len(texts))


def band_edges(largest: int = 1 << 40) -> np.ndarray:
    """The least size of each band; a partner of 0.8 times the size is in the same band or the one below."""
    lo = [1]
    while lo[-1] < largest:
        lo.append(max(lo[-1] + 1, -(-lo[-1] * DEN // NUM)))
    return np.array(lo)


EDGES = band_edges()


def allowed(hi: int) -> int:
    """Largest symmetric difference of two linked sets of at most hi shingles."""
    return 2 * hi * (DEN - NUM) // (DEN + NUM)


def pieces_of(diff: int) -> int:
    return diff + 1 + -(-3 * (diff + 1) // 10)


def sketch_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, place of the set in sets, tag) of the pieces by which each set may be found.

    tag holds, from its lowest bit: whether the band is the next one, whether the piece is low, and how many of the
    set's pieces of this band, as sent, are to be left out: of its low ones if it sends those (0 beside the others).
    """
    keys, owners, tags = [], [], []
    size = np.array([len(s) for s in sets])
    band = np.searchsorted(EDGES, size, side="right") - 1
    for up in (0, 1):
        diff = np.array([allowed(int(EDGES[b + up + 1]) - 1) for b in band], np.int64)
        use = np.flatnonzero((diff > 0) & (size > 0))
        if not len(use):
            continue
        p = np.array([pieces_of(int(d)) for d in diff], np.int64)
        own = np.repeat(use, size[use])
        x = mix64(np.concatenate([sets[i] for i in use]) ^ mix64((band[own] + up).astype(np.uint64)))
        piece = ((x >> np.uint64(20)) % p[own].astype(np.uint64)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(p[use])])
        slot = first[np.searchsorted(use, own)] + piece
        code = np.sort(slot.astype(np.uint64) << np.uint64(16) | x & np.uint64(0xFFFF))
        # toggled twice is not toggled
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        odd = np.diff(np.append(starts, len(code))) % 2 == 1
        code = code[starts[odd]]
        slot = (code >> np.uint64(16)).astype(np.int64)
        bits = np.bincount(slot, minlength=first[-1])
        own = np.repeat(np.arange(len(use)), p[use])
        inner = np.arange(first[-1]) - first[own]
        value = np.zeros(first[-1], np.uint64)
        if len(code):
            heads = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            value[slot[heads]] = np.bitwise_xor.reduceat(mix64(code & np.uint64(0xFFFF)), heads)
        low = bits < 2
        n_low, spare = np.bincount(own, weights=low, minlength=len(use)).astype(np.int64), (p - diff)[use] - 1
        sent = n_low > spare
        drop = np.where(sent, spare, spare - n_low)
        keep = ~low | sent[own]
        key = mix64(mix64(value ^ mix64(inner.astype(np.uint64))) ^ ((band[use] + up)[own].astype(np.uint64) << np.uint64(32) | bits.astype(np.uint64)))
        keys.append(key[keep])
        owners.append(use[own[keep]])
        drop = np.where(sent[own] & ~low, 0, drop[own])
        tags.append((drop << 2 | low << 1 | up)[keep])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(tags)


def planes(x: np.ndarray, n: int) -> bytes:
    """The n lowest bytes of 64-bit numbers, byte by byte, which compresses well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def from_planes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(n, -1).T
    return out.view("<u8").ravel()


def set_rows(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles and the digest of its set (null for the empty set)."""

    def rows(batches):
        shingles = Shingles()
        for b in batches:
            ids, texts = b["doc_id"].astype("Int64"), b["text"].tolist()
            for part in portions(texts):
                sets = shingles.of(texts[part])
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pd.DataFrame({"doc_id": ids.iloc[part].reset_index(drop=True), "n_shingles": [len(s) for s in sets], "digest": digest})

    return docs.select("doc_id", "text").mapInPandas(freed_rows(rows), "doc_id bigint, n_shingles bigint, digest binary")


def candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), a document for each distinct set: rows (key, doc) of the pieces that a document keeps and shares."""
    total = int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    n_buckets = max(total // max(BUCKET_BYTES, math.isqrt(ROW_BYTES * total)), partitions(docs.sparkSession))

    def deal(batches):
        shingles = Shingles()
        held, size = [], 0

        def flush():
            keys, owners, tags = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket, rest = keys % np.uint64(n_buckets), keys // np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
            columns = {"keys": (rest, 5), "docs": (owners.view(np.uint64), 8), "tags": (tags.view(np.uint64), 4)}
            return pd.DataFrame({"bucket": [int(bucket[p[0]]) for p in parts]} | {c: [planes(x[p], n) for p in parts] for c, (x, n) in columns.items()})

        for b in batches:
            ids, texts = b["doc_id"].to_numpy(np.int64), b["text"].tolist()
            for part in portions(texts):
                keys, owners, tags = sketch_keys(shingles.of(texts[part]))
                if len(keys):
                    held.append((keys, ids[part][owners], tags))
                    size += len(keys)
                if size >= FLUSH:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, ids, tags = (np.concatenate([from_planes(x, n) for x in pdf[c]]) for c, n in (("keys", 5), ("docs", 8), ("tags", 4)))
        order = np.argsort(keys, kind="stable")
        keys, ids, tags = keys[order], ids[order].view(np.int64), tags[order].view(np.int64)
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.diff(np.append(head, len(keys)))
        size = np.repeat(n, n)
        shared = size > 1
        # the bucket's number keeps its keys apart from those of other buckets
        key = keys * np.uint64(n_buckets) + np.uint64(pdf["bucket"].iloc[0])
        return pd.DataFrame({"key": key.view(np.int64)[shared], "doc": ids[shared], "n": size[shared], "tag": tags[shared]})

    dealt = docs.select("doc_id", "text").mapInPandas(freed_rows(deal), "bucket int, keys binary, docs binary, tags binary")
    found = dealt.groupBy("bucket").applyInPandas(freed(meet), "key bigint, doc bigint, n bigint, tag bigint")
    rank = F.struct((F.col("tag").bitwiseAND(2) > 0).alias("low"), "n", "key")
    by_doc = found.groupBy("doc", F.col("tag").bitwiseAND(1).alias("up")).agg(F.sort_array(F.collect_list(rank)).alias("x"), F.max(F.shiftright("tag", 2)).alias("drop"), F.count_if(F.col("tag").bitwiseAND(2) > 0).alias("low"))
    drop = F.when(F.col("low") > 0, F.least("drop", "low")).otherwise(F.col("drop"))
    kept = F.slice("x", F.lit(1), F.greatest(F.size("x") - drop, F.lit(0)).cast("int"))
    return by_doc.select("doc", F.explode(kept).alias("x")).select("x.key", "doc")


def whole_sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles in a power of two of bits, 64 at least."""
    m = max(64, 1 << int(4 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def arrays_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents in ids (doc): rows (doc, n, sketch, shingles), the last as bytes of sorted 64-bit numbers."""

    def arrays(batches):
        shingles = Shingles()
        for b in batches:
            texts, ids = b["text"].tolist(), b["doc_id"]
            for part in portions(texts):
                sets = shingles.of(texts[part])
                yield _arrays(ids.iloc[part], sets)

    def _arrays(ids, sets):
        return pd.DataFrame({"doc": ids, "n": [len(s) for s in sets], "sketch": [whole_sketch(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ids = ids.withColumnRenamed("doc", "doc_id")
    mine = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi")
    return mine.mapInPandas(freed_rows(arrays), "doc bigint, n bigint, sketch binary, shingles binary").dropDuplicates(["doc"])


def near_sketches(members: DataFrame, arrays: DataFrame) -> DataFrame:
    """members (pivot, doc, component), arrays (doc, n, sketch): pairs (a, b, bits) of a pivot and different components that may link.

    The largest component of a pivot is compared with the documents outside, and those with each other. Both are cut
    into blocks, each pair of blocks is compared by itself, and many small ones share a task's call.
    """
    n_buckets = BUCKETS * partitions(members.sparkSession)
    size = members.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("_n"))
    size = size.groupBy("pivot").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "component")).alias("_top")).where("_all > _top._n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    size = written(size.select("pivot", F.col("_top.component").alias("_main"), blocks(F.col("_all") - F.col("_top._n")).alias("_rest"), blocks(F.col("_top._n")).alias("_most")), "open")
    m = with_few(members, size, ["pivot"], "inner")
    main, h = F.col("component") == F.col("_main"), F.xxhash64("doc")
    # blocks of the rest come first; those of the largest component meet only them
    m = m.withColumn("_b", F.when(main, F.col("_rest") + F.pmod(h, F.col("_most"))).otherwise(F.pmod(h, F.col("_rest"))).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.when(main, F.col("_rest")).otherwise(F.col("_rest") + F.col("_most")) - 1)))
    m = m.select("pivot", F.least("_b", "_o").alias("lo"), F.greatest("_b", "_o").alias("hi"), "_b", "doc", "component")
    m = m.join(arrays.select("doc", "n", "sketch").hint("merge"), "doc")
    m = m.withColumn("bucket", F.pmod(F.xxhash64("pivot", "lo", "hi"), F.lit(n_buckets)).cast("int"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pivot", "lo", "hi"], kind="stable").reset_index(drop=True)
        group = pdf.groupby(["pivot", "lo", "hi"], sort=False).ngroup().to_numpy()
        nbytes = pdf["sketch"].map(len).to_numpy()
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        count = np.diff(np.append(head, len(group)))
        least = np.repeat(np.minimum.reduceat(nbytes, head), count)
        end = np.repeat(head + count, count)
        n, doc, comp, block = (pdf[c].to_numpy() for c in ("n", "doc", "component", "_b"))
        mixed = (pdf["lo"] != pdf["hi"]).to_numpy()
        row = np.zeros(len(group), np.int64)
        folded: dict[int, list[np.ndarray]] = {}
        for k, (raw, size) in enumerate(zip(pdf["sketch"], least.tolist(), strict=True)):
            w = np.frombuffer(raw, np.uint64)
            while w.nbytes > size:
                w = w[: len(w) // 2] ^ w[len(w) // 2 :]
            row[k] = len(folded.setdefault(size, []))
            folded[size].append(w)
        out = []
        for size, x in folded.items():
            x = np.stack(x)
            live = np.flatnonzero(least == size)
            for d in range(1, int(count.max())):
                live = live[live + d < end[live]]
                if not len(live):
                    break
                for at in range(0, len(live), step := max(1, 16_000_000 // size)):
                    i = live[at : at + step]
                    j = i + d
                    i, j = (v[(comp[i] != comp[j]) & (doc[i] != doc[j]) & (~mixed[i] | (block[i] != block[j])) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))] for v in (i, j))
                    bits = np.bitwise_count(x[row[i]] ^ x[row[j]]).sum(1, dtype=np.int64)
                    ok = bits * (DEN + NUM) <= (n[i] + n[j]) * (DEN - NUM)
                    a, b = doc[i[ok]], doc[j[ok]]
                    out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "bits": bits[ok]}))
        return pd.concat(out).drop_duplicates() if out else pd.DataFrame({"a": [], "b": [], "bits": []}, dtype=np.int64)

    return m.groupBy("bucket").applyInPandas(freed(compare), "a bigint, b bigint, bits bigint").groupBy("a", "b").agg(F.min("bits").alias("bits"))


def verified(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    # either may be the partner of very many others
    one = spread(pairs, arrays.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b", "a")
    two = spread(one, arrays.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a", "b", pairs)

    def check(batches):
        for p in batches:
            keep = []
            for x, y in zip(p["x"], p["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(DEN * both >= NUM * (len(x) + len(y) - both) and both > 0)
            yield p.loc[keep, ["a", "b"]]

    return two.select("a", "b", "x", "y").mapInPandas(freed_rows(check), "a bigint, b bigint")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less those in ids (doc_id), which is broadcast only if it is small."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_anti")


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose ends are in different components so far."""
    p = with_few(pairs, parts.select(F.col("node").alias("a"), F.col("component").alias("_ca")), ["a"])
    p = with_few(p, parts.select(F.col("node").alias("b"), F.col("component").alias("_cb")), ["b"])
    return p.where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).drop("_ca", "_cb")


def linked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): rows (doc_id, n_shingles, component_id), one for each row of docs."""
    sets = written(set_rows(docs), "sets")
    own = sets.where("digest is not null and doc_id is not null")
    twice = own.groupBy("doc_id").agg(F.min("digest").alias("_lo"), F.max("digest").alias("_hi")).where("_lo != _hi")
    if twice.isEmpty():
        return _linked(docs, sets)
    # rows get numbers of their own, and those of one doc_id are linked to their least
    rows = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")), "rows")
    node = F.when(F.col("doc_id").isNotNull(), F.col("_row"))
    numbered = rows.select(node.alias("doc_id"), "text")
    found = written(_linked(numbered, written(set_rows(numbered), "sets")).where("doc_id is not null"), "found")
    ids = rows.select(F.col("_row").alias("doc_id"), F.col("doc_id").alias("_own"))
    same = written(ids.where("_own is not null").groupBy("_own").agg(F.min("doc_id").alias("_to")), "same")
    known = written(found.join(ids.hint("merge"), "doc_id"), "known")  # one row a number
    links = spread(known.select(F.col("doc_id").alias("a"), "_own"), same, "_own", "a").select("a", F.col("_to").alias("b"))
    parts = written(components(links.unionAll(found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))), "parts")
    named = written(with_few(known, parts.withColumnRenamed("node", "doc_id"), ["doc_id"]).withColumn("component", F.coalesce("component", "doc_id")), "named")
    least = written(named.groupBy("component").agg(F.min("_own").alias("component_id")), "least")
    out = with_few(named.drop("component_id"), least, ["component"]).select(F.col("_own").alias("doc_id"), "n_shingles", "component_id")
    return out.unionAll(sets.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long")))


def _linked(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """linked() where all texts of a doc_id have one set. sets: set_rows(docs), written."""
    own = sets.where("digest is not null and doc_id is not null")
    classes = written(own.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    copies = written(lookup(own.select("doc_id", "digest"), classes, "digest").where("doc_id != rep").select("doc_id").distinct(), "copies")
    ends = written(candidates(_without(docs.where("doc_id is not null").select("doc_id", "text"), copies)), "ends")
    # first the least document of a piece with which a document shares most pieces
    least = ends.groupBy("key").agg(F.min("doc").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    pairs = spread(ends, least, "key", "doc").groupBy("a", F.col("doc").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    pairs = written(pairs, "pairs")  # with each pivot a beside itself
    best = written(pairs.where("a != b").groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "best")
    arrays = written(arrays_of(docs, pairs.select(F.col("b").alias("doc")).distinct()), "arrays")
    links = written(verified(best, arrays), "links")
    parts = written(components(links), "parts")
    # then documents that share the least document of a piece and are in different components, if their sketches are near
    members = with_few(pairs.select(F.col("a").alias("pivot"), F.col("b").alias("doc")), parts.withColumnRenamed("node", "doc"), ["doc"])
    members = written(members.withColumn("component", F.coalesce("component", "doc")), "members")
    cross = near_sketches(members, arrays).join(best.hint("merge"), ["a", "b"], "left_anti")
    cross = written(cross, "cross")
    nearest = written(cross.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a")).select("a", "b"), "nearest")
    more = written(verified(nearest, arrays), "more")
    if not more.isEmpty():
        links = links.unionAll(more)
        parts = written(components(links), "parts")
    rest = written(_apart(cross.select("a", "b").join(nearest.hint("merge"), ["a", "b"], "left_anti"), parts), "rest")
    last = written(verified(rest, arrays), "last")
    if not last.isEmpty():
        parts = written(components(links.unionAll(last)), "parts")
    labels = with_few(classes, parts.withColumnRenamed("node", "rep"), ["rep"]).select("digest", F.coalesce("component", "rep").alias("_c"))
    out = lookup(sets, labels, "digest")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are the least of their component, with their columns as they are; rows with a null doc_id stay."""
    slim = docs.select("doc_id", "text")
    return _without(docs, written(linked(slim).where("doc_id != component_id").select("doc_id").distinct(), "gone")).select(docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS seen FROM edge UNION SELECT node, b FROM reach JOIN edge ON seen = a),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = d.doc_id
"""
