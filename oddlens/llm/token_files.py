"""Token ids in binary files: frequency-ranked ids, byte-aligned variable-length coding with control bytes of their own.

Texts are encoded once and their ids written as a table; the ids are counted over all of it, and an id's rank is its
place by falling frequency (the smaller id on ties; ids that never occur come last). The table is then dealt to ranges by
key and place, and every range writes files of about FILE_IDS ids. A file holds

    magic, number of texts, number of ids, number of control bytes, number of data bytes    (5 x 8 bytes)
    the texts' keys and numbers of ids                                                      (8 and 8 bytes each)
    whether a key is there                                                                  (1 byte each)
    control bytes: four ids to a byte, two bits each: the bytes of the id's rank less one
    data: the ranks, little-endian, 1 to 4 bytes each

and next to the files lies `ranks`, the ids by rank. As frequent ids have small ranks, most of them take one byte. A
reader decodes with table lookups over whole arrays: a control byte gives the length of its group of four and which of the
16 bytes of four 32-bit numbers are in it, as a byte shuffle would.

With a tokenizer whose pre-tokenizer drops white space and never matches across it, a worker has the library encode each word
once and then looks it up. Where the pattern is PATTERN, words of plain Latin characters are cut into pieces by kinds of bytes,
whole portions of texts at once; Arrow numbers the different pieces, and each new one goes to the library's model. Other
tokenizers get whole texts. Special strings inside texts are what the library makes of them.
The table between holds each text's ids compressed, as does its shuffle.

Null, empty and blank texts hold the end id only. A text of any length is one unit: a file holds at least one. Rows come
in ascending key order, null keys first; rows of one key, repeated ones too, in the order in which they were read, each with
ids of its own. Keys are whole numbers; others raise ValueError. Only the key and the text are read, so other columns cannot clash. An empty table gives no rows and only
`ranks`. Ids must be below 2**32; what goes through the driver is one number for each id of the vocabulary.
"""

from __future__ import annotations

import itertools
import re
import sys
import types
import uuid
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddlens.llm.common import SPACE, freed_rows, shared_dir, written
from oddlens.llm.tokens import byte_chars

END_ID = 1
#: Ids of a file, ids that a range of the sort aims at, and words and pieces whose ids a worker keeps.
FILE_IDS, RANGE_IDS, KEPT = 4_000_000, 4_000_000, 1_000_000
#: Characters of texts that a task encodes at once.
PORTION = 8_000_000
#: Printable ASCII and Latin letters that are one letter in every form: no normaliser but lower case changes them, and all are letters.
PLAIN = r"[!-~À-ÖØ-öø-įĲ-ſ]+"
#: The cutting pattern that Encoder._cut follows (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MAGIC = int.from_bytes(b"ranked01", "little")

# by control byte: bytes of its four numbers, and which of the 16 bytes of four 32-bit numbers are there
_LENGTH = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_TOTAL = _LENGTH.sum(1)
_THERE = (np.arange(4) < _LENGTH[:, :, None]).reshape(256, 16)
#: Groups that are coded at once.
GROUPS = 65_536


_BYTE = {b: c for c, b in byte_chars().items()}

# kinds of bytes, and the lower case of PLAIN's letters of two bytes (0: not one of them)
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = bytes([_SPACE if c in SPACE else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _MARK if "!" <= c <= "~" else _ODD for c in map(chr, range(128))] + [_ODD] * 128)
_LETTERS = np.array([ord(chr(c).lower()) if c > 127 and re.fullmatch(PLAIN, chr(c)) else 0 for c in range(0x800)], np.uint16)


def kept(name: str, make):
    """make(), once a worker: what travels with the code of a task starts anew in the next one, a module of the interpreter does not."""
    store = vars(sys.modules.setdefault("_oddlens_kept", types.ModuleType("_oddlens_kept")))
    if name not in store:
        store[name] = make()
    return store[name]


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data) of numbers below 2**32; the last group is filled up with zeros."""
    x = np.zeros((-(-len(numbers) // 4), 4), "<u4")
    x.ravel()[: len(numbers)] = numbers
    control, data = np.empty(len(x), np.uint8), []
    for lo in range(0, len(x), GROUPS):
        part = x[lo : lo + GROUPS]
        more = (part > 0xFF).view(np.uint8) + (part > 0xFFFF) + (part > 0xFFFFFF)
        c = more[:, 0] | more[:, 1] << 2 | more[:, 2] << 4 | more[:, 3] << 6
        control[lo : lo + GROUPS] = c
        data.append(part.view(np.uint8)[_THERE[c]].tobytes())
    return control.tobytes(), b"".join(data)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first n numbers of packed groups, by table lookup, a block of groups at a time."""
    c, d = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
    out, at = np.zeros((len(c), 16), np.uint8), 0
    for lo in range(0, len(c), GROUPS):
        part = c[lo : lo + GROUPS]
        end = at + int(_TOTAL[part].sum())
        out[lo : lo + GROUPS][_THERE[part]] = d[at:end]
        at = end
    return out.view("<u4").ravel()[:n]


class Ragged:
    """Numbers of keys in order of their coming, and the ids of each, end to end."""

    def __init__(self) -> None:
        self.known: dict = defaultdict(itertools.count().__next__)
        self.starts, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def numbers(self, keys, n: int) -> tuple[np.ndarray, list]:
        """(numbers of n keys, those that are new)."""
        before = len(self.known)
        got = np.fromiter(map(self.known.__getitem__, keys), np.int64, n)
        return got, list(itertools.islice(self.known, before, None))

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(size) - size])
        self.sizes, self.flat = np.concatenate([self.sizes, size]), np.concatenate([self.flat, ids])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the keys end to end, the place in them at which each key starts, and their end)."""
        size = self.sizes[numbers]
        before = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.arange(before[-1]) + np.repeat(self.starts[numbers] - before[:-1], size)], before


class Encoder:
    """Ids of texts by a tokenizer file. Words are looked up where white space always ends what the library matches."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._by_word(spec)
        self.by_piece = self.by_word and self._by_piece(spec)
        norm = spec.get("normalizer") or {}
        self.lower = any(n["type"] == "Lowercase" for n in norm.get("normalizers") or [norm] if n)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.words = Ragged()

    @staticmethod
    def _by_piece(spec: dict) -> bool:
        """Whether the pieces of plain words are those of PATTERN, with no other step after the cut than the bytes' stand-ins."""
        first, *rest = spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]]
        return first["pattern"]["Regex"] == PATTERN and [(r.get("type"), bool(r.get("use_regex")), bool(r.get("add_prefix_space"))) for r in rest] == [("ByteLevel", False, False)]

    @staticmethod
    def _by_word(spec: dict) -> bool:
        """Whether the ids of a text are those of its words, one after another: white space is dropped and nothing looks past it."""
        import regex

        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        steps = norm.get("normalizers") or ([norm] if norm else [])
        plain = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " ") for s in steps)
        ok = plain and not spec.get("post_processor") and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and "Regex" in first.get("pattern", {})
        if not ok or any(t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(SPACE) for t in spec.get("added_tokens", [])):
            return False
        cut = regex.compile(first["pattern"]["Regex"])
        return "(?" not in cut.pattern and r"\b" not in cut.pattern and not any(s in m.group() for s in SPACE for t in (f"a{s}b", f"!{s}?", f"1{s}{s}2", f"'{s}s") for m in cut.finditer(t))

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum())), size

    def _cut(self, raw: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of texts that lie end to end in raw and begin at the places first: (their bytes end to end, the place in them at
        which each starts, and their end, its place in raw, whether it is a whole word that the library has to cut).

        A piece starts where the kind of byte changes, at digits, and around 's, 't, 're, 've, 'm, 'll, 'd where the mark starts a
        piece. Words with bytes of no known kind, or with a special string, stay whole and as they are.
        """
        n, whole = len(raw), raw.tobytes()
        kind, low = (np.frombuffer(bytearray(x + bytes(3)), np.uint8) for x in (whole.translate(_KIND), whole.lower() if self.lower else whole))
        two = np.flatnonzero(raw[:-1] & 0xE0 == 0xC0)
        letter = _LETTERS[(raw[two] & 0x1F).astype(np.int64) << 6 | raw[two + 1] & 0x3F]
        good = (letter > 0) & (raw[two + 1] & 0xC0 == 0x80)
        two, letter = two[good], letter[good]
        kind[two] = kind[two + 1] = _LETTER
        if self.lower:
            low[two], low[two + 1] = 0xC0 | letter >> 6, 0x80 | letter & 0x3F
        head = np.zeros(n + 3, bool)
        head[first] = head[0] = True

        start = np.append(True, kind[1:] != kind[:-1])
        start |= head
        start |= kind == _DIGIT
        start &= kind != _SPACE
        mark = np.flatnonzero(low == ord("'"))
        mark = mark[start[mark] & (kind[mark + 1] == _LETTER) & ~head[mark + 1]]
        b, c = low[mark + 1], low[mark + 2]
        short = np.isin(b, np.frombuffer(b"stmd", np.uint8))
        long = ((np.isin(b, np.frombuffer(b"rv", np.uint8)) & (c == ord("e"))) | ((b == ord("l")) & (c == ord("l")))) & ~head[mark + 2]
        start[mark[short | long] + 1] = False
        after = np.append(mark[short] + 2, mark[long] + 3)
        start[after[kind[after] == _LETTER]] = True

        odd = [np.flatnonzero(kind == _ODD)]
        for s in self.special:
            at = whole.find(s)
            while at >= 0:
                odd.append(np.array([at]))
                at = whole.find(s, at + 1)
        odd, within = np.concatenate(odd), None
        if len(odd):
            full = kind != _SPACE
            begins = np.flatnonzero(full & (head | np.append(True, ~full[:-1])))
            ends = np.flatnonzero(full[:-1] & (head[1:] | ~full[1:])) + 1
            word = np.unique(np.searchsorted(begins, odd, "right") - 1)
            step = np.zeros(n + 3, np.int8)
            np.add.at(step, begins[word], 1)
            np.add.at(step, ends[word], -1)
            within = np.cumsum(step, dtype=np.int8) > 0
            start[within] = False
            start[begins[word]] = True
            low[:n][within[:n]] = raw[within[:n]]
        space = kind == _SPACE
        at = np.flatnonzero(start)
        data = low[:n].tobytes().translate(None, SPACE.encode())
        places = np.frombuffer((start.view(np.uint8) | space.view(np.uint8) << 1).tobytes().translate(None, b"\2"), bool)
        return data, np.append(np.flatnonzero(places), len(data)), at, within[at] if within is not None else np.zeros(len(at), bool)

    def _learn(self, new: list) -> None:
        """Adds the ids of plain pieces, which are strings, and of whole words, which are tuples of one string; the pieces come first."""
        tokenize, ids, size = self.tok.model.tokenize, [], []
        n = sum(isinstance(x, str) for x in new)
        for p in new[:n]:
            got = tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE))
            ids += [t.id for t in got]
            size.append(len(got))
        self.words.add(np.array(ids, np.uint32), np.array(size, np.int64))
        if n < len(new):
            self.words.add(*self._ids([x for (x,) in new[n:]]))

    def _pieces(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(numbers in self.words of the texts' pieces, numbers of pieces of each text)."""
        import pyarrow as pa

        texts = texts.fill_null("").cast(pa.large_string())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        data, places, at, odd = self._cut(raw, ends[:-1])
        cells = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(data))
        plain, *more = [cells] if not odd.any() else [cells.filter(pa.array(~odd)), cells.filter(pa.array(odd))]
        plain, more = plain.dictionary_encode(), [m.dictionary_encode() for m in more]
        keys = plain.dictionary.to_numpy(zero_copy_only=False).tolist()
        n = len(keys)
        keys += [(x,) for m in more for x in m.dictionary.to_numpy(zero_copy_only=False).tolist()]
        known, new = self.words.numbers(keys, len(keys))
        if new:
            self._learn(new)
        if not more:
            numbers = known[plain.indices.to_numpy()]
        else:
            numbers = np.empty(len(at), np.int64)
            numbers[~odd], numbers[odd] = known[plain.indices.to_numpy()], known[n + more[0].indices.to_numpy().astype(np.int64)]
        return numbers, np.diff(np.searchsorted(at, ends))

    def _split(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(numbers in self.words of the texts' words, numbers of words of each text). White space at the ends gives empty words, which have no ids."""
        import pyarrow.compute as pc

        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known, new = self.words.numbers(words, len(words))
        if new:
            self.words.add(*self._ids(new))
        return known[coded.indices.to_numpy()], pc.list_value_length(parts).fill_null(0).to_numpy().astype(np.int64)

    def of(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each with the end id, numbers of ids of each). texts: an Arrow array, or a list, of strings and nulls.

        Arrow numbers the different pieces or words, so that only these are looked up one by one.
        """
        import pyarrow as pa

        if not self.by_word:
            ids, size = self._ids([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)])
            return np.insert(ids, np.cumsum(size), END_ID), size + 1
        if len(self.words.known) > KEPT or len(self.words.flat) > 8 * KEPT:
            self.words = Ragged()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        numbers, n = (self._pieces if self.by_piece else self._split)(texts)
        flat, before = self.words.of(numbers)
        ends = np.cumsum(n)
        return np.insert(flat, before[ends], END_ID), before[ends] - before[ends - n] + 1


def encoder_of(path: str) -> Encoder:
    """A worker's encoder: what it learned from one task serves the next. It holds few more than KEPT words and pieces, of 8 ids each on average."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def _unzip():
    import zstandard

    return kept("unzip", lambda: zstandard.ZstdDecompressor().decompress)


def squeezed(ids: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Each text's ids, compressed."""
    import zstandard

    z, ends = zstandard.ZstdCompressor(level=1), np.cumsum(size).tolist()
    wide = memoryview(ids.astype("<u4")).cast("B")
    short = memoryview(ids.astype("<u2")).cast("B")
    # a first byte tells the width
    out = []
    for lo, hi in zip([0, *ends], ends, strict=False):
        if ids[lo:hi].max(initial=0) < 1 << 16:
            out.append(b"2" + z.compress(short[2 * lo : 2 * hi]))
        else:
            out.append(b"4" + z.compress(wide[4 * lo : 4 * hi]))
    return out


def restored(cell: bytes) -> np.ndarray:
    return np.frombuffer(_unzip()(cell[1:]), "<u2" if cell[:1] == b"2" else "<u4")


def encoded(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A written table (key, part, row, n_ids, ids): ids as squeezed() has them; part and row tell the order of reading."""
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches):
        import os

        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, row = encoder_of(path), TaskContext.get().partitionId(), 0
        for b in batches:
            chars = np.cumsum(pc.utf8_length(b.column(1)).fill_null(0).to_numpy().astype(np.int64))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(chars, (chars[lo - 1] if lo else 0) + PORTION, "right")))
                own = b.slice(lo, hi - lo)
                ids, size = encoder.of(own.column(1))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(len(size), part, np.int32)), pa.array(np.arange(row, row + len(size))), pa.array(size), pa.array(squeezed(ids, size), pa.binary())], names=[key, "part", "row", "n_ids", "ids"])
                row += len(size)
                lo = hi

    return written(docs.select(key, text).mapInArrow(freed_rows(encode), f"{key} {kind}, part int, row bigint, n_ids bigint, ids binary"), "ids")


def ranked(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """The ids of the vocabulary by falling frequency in ids (squeezed), the smaller id on ties. One number an id reaches the driver."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                total += np.bincount(np.concatenate([restored(x) for x in b.column(0)[lo : lo + 256].to_pylist()]), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    found = ids.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(vocabulary, np.int64)
    n[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return np.argsort(-n, kind="stable").astype("<u4")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_files(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes and writes docs; a written table of the files: path, seq and start_doc, start (texts and ids before the file), n_docs, n_ids.

    A task names its files anew and tells them when it ends, so what a lost task left is not in the table.
    """
    from tokenizers import Tokenizer

    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be a whole number")
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/oddlens/tokens-{uuid.uuid4().hex}"
    table = encoded(docs, path, text, key)
    order = ranked(table, max(Tokenizer.from_file(path).get_vocab_size(), END_ID + 1))
    store, at = _open(folder)
    store.create_dir(at)
    with store.open_output_stream(f"{at}/ranks", compression=None) as f:
        f.write(order.tobytes())
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    total = table.agg(F.sum("n_ids")).first()[0] or 0

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, at = _open(folder)
        store.create_dir(at)
        part, seq, held, keys, sizes, n, told = TaskContext.get().partitionId(), 0, [], [], [], 0, []

        def close():
            nonlocal seq, held, keys, sizes, n
            control, data = pack(np.concatenate(held))
            head = np.array([MAGIC, len(sizes), n, len(control), len(data)], "<u8").tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + np.array(sizes, "<u8").tobytes() + bytes(k is not None for k in keys)
            name = f"{uuid.uuid4().hex}.ids"
            with store.open_output_stream(f"{at}/{name}", compression=None) as f:
                for x in (head, control, data):
                    f.write(x)
            told.append((part, seq, f"{folder}/{name}", len(sizes), n))
            seq, held, keys, sizes, n = seq + 1, [], [], [], 0

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = restored(x)
                if n and n + len(ids) > FILE_IDS:
                    close()
                held.append(rank[ids])
                keys.append(k)
                sizes.append(len(ids))
                n += len(ids)
        if n:
            close()
        kinds = {"part": pa.int32(), "seq": pa.int32(), "path": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in told], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    place = [F.col(key).asc_nulls_first(), "part", "row"]
    ranges = table.repartitionByRange(int(total // RANGE_IDS) + 1, *place).sortWithinPartitions(*place)
    files = written(ranges.select(key, "ids").mapInArrow(freed_rows(write), "part int, seq int, path string, n_docs bigint, n_ids bigint"), "files")
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)  # a row a file of millions of ids
    return written(files.select("path", F.row_number().over(W.orderBy("part", "seq")).alias("seq"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(s) for c, s in (("n_docs", "start_doc"), ("n_ids", "start"))], "n_docs", "n_ids"), "manifest")


def read_file(uri: str, order: np.ndarray | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, ids of all texts of the file end to end, numbers of ids of each); ValueError if it is not whole."""
    store, path = _open(uri)
    with store.open_input_stream(path, compression=None) as f:
        raw = f.read()
    head = np.frombuffer(raw, "<u8", 5)
    magic, n_docs, n_ids, n_control, n_data = map(int, head)
    if magic != MAGIC or len(raw) != 40 + 17 * n_docs + n_control + n_data:
        raise ValueError(f"{uri}: not a whole file of token ids")
    keys, sizes = np.frombuffer(raw, "<i8", n_docs, 40), np.frombuffer(raw, "<u8", n_docs, 40 + 8 * n_docs).astype(np.int64)
    there = np.frombuffer(raw, np.uint8, n_docs, 40 + 16 * n_docs)
    at = 40 + 17 * n_docs
    return [k if t else None for k, t in zip(keys.tolist(), there.tolist(), strict=True)], (read_ranks(uri) if order is None else order)[unpack(raw[at : at + n_control], raw[at + n_control :], n_ids)], sizes


def read_ranks(uri: str) -> np.ndarray:
    """The ids by rank that lie next to a file."""
    store, path = _open(uri)
    with store.open_input_stream(path.rpartition("/")[0] + "/ranks", compression=None) as f:
        return np.frombuffer(f.read(), "<u4")


def read_files(files: DataFrame, crc: bool = False) -> DataFrame:
    """Rows (key, place, start, n_tokens, ids) of the texts in the files (path, start_doc, start): place numbers them in key order from 0. crc: ids_crc32 in place of ids."""

    def read(batches):
        import pyarrow as pa

        order = None
        for b in batches:
            for uri, doc, start in zip(b["path"].to_pylist(), b["start_doc"].to_pylist(), b["start"].to_pylist(), strict=True):
                order = read_ranks(uri) if order is None else order
                keys, ids, sizes = read_file(uri, order)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                head = [pa.array(keys, pa.int64()), pa.array(doc + np.arange(len(sizes))), pa.array(start + ends[:-1]), pa.array(sizes)]
                if crc:
                    view = memoryview(ids.astype("<u4")).cast("B")
                    last = pa.array([zlib.crc32(view[4 * lo : 4 * hi]) for lo, hi in itertools.pairwise(ends.tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*head, last], names=["key", "place", "start", "n_tokens", "ids_crc32" if crc else "ids"])

    n = max(1, files.count())  # files have bounded size: a task each
    return files.select("path", "start_doc", "start").repartition(n, "path").mapInArrow(freed_rows(read), f"key bigint, place bigint, start bigint, n_tokens bigint, {'ids_crc32 bigint' if crc else 'ids array<bigint>'}")


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return read_files(files, crc=True).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
