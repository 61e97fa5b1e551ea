"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ from a passage by e = n // 20 edits. It is cut into e + 1 pieces; a passage within
e edits holds at least one piece unchanged. One automaton finds all pieces in a text, and the window around each
hit is verified with Myers' bit-parallel edit distance. Texts and items are compared in lower case with white space
runs as one space. Items of fewer than CHARS_PER_EDIT characters allow no edit; they are found as whole words only, so
that `no` is not found in `note`.

Null, empty and blank texts and items match nothing, nor do rows whose item_id is null; documents with a null doc_id are
searched as others. Very long texts are searched whole, and windows that overlap are verified as one. Of equally near
passages the first is told. Repeated documents are matched one by one, repeated items too. Columns besides the ids and
texts are not looked at; the stage keeps them as they are. Empty tables give no rows. The items are a fixed test
set: they go to the tasks in chunks of bounded size, one pass over the documents for each chunk.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import freed_rows

CHARS_PER_EDIT = 20
#: Items of one pass: at most so many characters, by which the automaton and what is sent are bounded.
PASS_CHARS = 4_000_000


def plain(text: str | None) -> str:
    return " ".join(text.lower().split()) if isinstance(text, str) else ""


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): one more than the edits allowed, of nearly equal length."""
    n = len(item) // CHARS_PER_EDIT + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Edit distance of one item to the best passage of a text, a column of the table held in the bits of integers."""

    def __init__(self, item: str) -> None:
        self.n, self.eq = len(item), {}
        for i, c in enumerate(item):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the nearest passage, the first one on ties; end is after its last character."""
        n, get = self.n, self.eq.get
        top, mask = 1 << n - 1, (1 << n) - 1
        up, down, score, found, end = mask, 0, n, n, 0
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up) & mask, up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & mask, mh << 1 & mask
            up, down = mh | ~(xv | ph) & mask, ph & xv
            if score < found:
                found, end = score, j + 1
        return found, end


def _alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit goes on at either end."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def _matcher(items: list[tuple[int, str]]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    where: dict[str, list[tuple[int, int]]] = {}
    for k, (_, item) in enumerate(items):
        for at, piece in pieces(item):
            where.setdefault(piece, []).append((k, at))
    for piece, places in where.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    myers = [Myers(item) for _, item in items]

    def match(text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of each item within its edits; the nearest passage of each, the first on ties."""
        windows: dict[int, list[list[int]]] = {}
        for end, (n, places) in automaton.iter(text):
            for k, at in places:
                size = len(items[k][1])
                slack = size // CHARS_PER_EDIT
                start = end + 1 - n - at
                if not slack and not _alone(text, start, end + 1):
                    continue
                lo, hi = max(0, start - slack), min(len(text), start + size + slack)
                own = windows.setdefault(k, [])
                if own and lo <= own[-1][1] and own[-1][0] <= lo:
                    own[-1][1] = max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        out = []
        for k, own in windows.items():
            best = min((d, lo + e) for lo, hi in own for d, e in [myers[k].best(text[lo:hi])])
            if best[0] <= len(items[k][1]) // CHARS_PER_EDIT:
                out.append((items[k][0], *best))
        return out

    return match


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, distance, end_char): each item found in each document. end_char counts in the compared form of the text."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n_passes = size // PASS_CHARS + 1
    out = None
    for k in range(n_passes):
        part = benchmark if n_passes == 1 else benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n_passes)) == k)
        items = sorted((r["item_id"], p) for r in part.select("item_id", "text").where("item_id is not null").toLocalIterator() if (p := plain(r["text"])))

        def search(batches, items=items):
            match = _matcher(items) if items else lambda t: []
            for b in batches:
                rows = [(d, *m) for d, t in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True) for m in match(plain(t))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "end_char"]).astype({"doc_id": "Int64"})

        found = docs.select("doc_id", "text").mapInPandas(freed_rows(search), "doc_id bigint, item_id bigint, distance int, end_char bigint")
        out = found if out is None else out.unionAll(found)
    return out


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no item is found, with their columns as they are."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n_passes = size // PASS_CHARS + 1
    kept = docs
    for k in range(n_passes):
        part = benchmark if n_passes == 1 else benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n_passes)) == k)
        items = sorted((r["item_id"], p) for r in part.select("item_id", "text").where("item_id is not null").toLocalIterator() if (p := plain(r["text"])))

        def clean(batches, items=items):
            import pyarrow as pa

            match = _matcher(items) if items else lambda t: []
            for b in batches:
                ok = [not match(plain(t)) for t in b.column("text").to_pylist()]
                yield b.filter(pa.array(ok, pa.bool_()))

        kept = kept.mapInArrow(freed_rows(clean), kept.schema)
    return kept
