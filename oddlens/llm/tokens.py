"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens. The pre-tokens that a task has not met before are laid end to end in one array of
symbols; in every round each of them applies its own lowest-rank pair at all its places, all of them at once, until
none has a pair left. The surviving symbols are the tokens. Counts of pre-tokens are kept for the task's next texts,
up to a bound, after which the store starts anew.

Null and empty texts have no tokens. Special strings in a text are one token each, as the library counts them by
default. Texts of any length are counted whole; of pairs of one rank the leftmost goes first. Repeated rows and null ids
are counted one by one; only the id and the text are read, so other columns cannot clash. An empty table gives no rows. Only byte-level BPE files without
normaliser are read; others raise ValueError.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import freed_rows

LIMIT = 512
#: Pre-tokens whose counts a task keeps; longer ones are counted anew each time.
KEPT, KEPT_CHARS = 400_000, 64
#: The cutting pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary: itself where it prints, else 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merges of a tokenizer file as sorted arrays: pair key, rank and the symbol that it makes. Symbols below 256 are bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{path}: only byte-level BPE without normaliser or prefix space is supported")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: added tokens that take white space or whole words are not supported")
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)
        ids: dict[str, int] = byte_chars()
        left, right, made = [], [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(ids[a])
            right.append(ids[b])
            made.append(ids.setdefault(a + b, len(ids)))
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.arange(len(keys))[order], np.array(made, np.int64)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that remain of each pre-token."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = np.zeros(len(tokens), np.int64)
        sym = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
        row = np.repeat(np.arange(len(tokens)), size)
        none = len(self.keys)
        while len(sym):
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (row[:-1] == row[1:]), self.rank[at], none)
            low = np.full(len(tokens), none)
            np.minimum.at(low, row[:-1], rank)
            live = low[row] < none
            out += np.bincount(row[~live], minlength=len(tokens))
            hit = np.append((rank == low[row[:-1]]) & (rank < none), False)
            # overlapping places, such as aaa: every second one of a run, from the left
            start = hit & ~np.append(False, hit[:-1])
            first = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            hit &= (np.arange(len(hit)) - first) % 2 == 0
            sym = np.where(hit, self.made[np.append(np.minimum(rank, none - 1), 0)], sym)
            keep = live & ~np.append(False, hit[:-1])
            sym, row = sym[keep], row[keep]
        return out


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit). The file is read once, on the driver; its merges go to the tasks with the function."""
    merges = Merges(path)
    kind = docs.schema[key].dataType.simpleString()

    def count(batches):
        import regex

        cut = regex.compile(PATTERN).findall
        special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
        known: dict[str, int] = {}
        for batch in batches:
            ids, texts = batch[key].tolist(), batch[text].tolist()
            for i in range(0, len(texts), 64):
                part = [t if isinstance(t, str) else "" for t in texts[i : i + 64]]
                extra = [len(special.findall(t)) if special else 0 for t in part]
                found = [cut(t) if not n else [x for piece in special.split(t) for x in cut(piece)] for t, n in zip(part, extra, strict=True)]
                if len(known) > KEPT:
                    known.clear()
                new = list(set().union(*found).difference(known))
                got = dict(zip(new, merges.counts([x.encode() for x in new]).tolist(), strict=True)) if new else {}
                known.update(got)
                n_tokens = [n + sum(map(known.__getitem__, f)) for n, f in zip(extra, found, strict=True)]
                for x in new:
                    if len(x) > KEPT_CHARS:
                        del known[x]
                yield pd.DataFrame({key: pd.array(ids[i : i + 64], dtype="Int64") if kind == "bigint" else ids[i : i + 64], "n_bytes": [len(t.encode()) for t in part], "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens]})

    return docs.select(key, text).mapInPandas(freed_rows(count), f"{key} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
