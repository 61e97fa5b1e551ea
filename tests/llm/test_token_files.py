"""Files of token ids against the library, and their coding against itself."""

import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oddlens.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, World! it's 12345 o'clock", "", None, " \t\n", "ＦＵＬＬ ｗｉｄｔｈ Straße ΣΑΣ ὈΔΥΣΣΕΎΣ İstanbul", "é ́x  a b c\x1cd\u0085e", "a<|endoftext|>b <|startoftext|> <|endof text|>",
    "don't 've x'll'd ''s", "word " * 3000, "x" * 5000, "日本語テキスト 🙂🙂 👩‍👩‍👧", "tab\tnew\nline\x0b\x0c\r end", "\x00nul", "ﬁ ﬂ ½ Ⅷ ١٢٣ ß'S",
]


TOKENIZER = Tokenizer.from_file(PATH)


def library(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def test_pack():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = tf.pack(x)
        assert len(control) == -(-n // 4)
        assert (tf.unpack(control, data, n) == x).all()
    x = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)
    control, data = tf.pack(x)
    assert control == bytes([0b01010000, 0b11111010 & 0xFF]) and len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4
    assert tf.unpack(control, data, 8).tolist() == x.tolist()


def test_encoder_by_word_is_the_library(monkeypatch):
    monkeypatch.setattr(tf, "KEPT", 20)
    e = tf.Encoder(PATH)
    assert e.by_word
    for part in (TEXTS, TEXTS[:1], TEXTS[3:9], [None], []):
        ids, size = e.of(part)
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])][: len(part)] == [library(t) for t in part]
    whole = tf.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not whole.by_word
    ids, size = whole.of(["a  b", None])
    assert ids.tolist() == [*whole.tok.encode("a  b", add_special_tokens=False).ids, 1, 1] and size.tolist() == [len(ids) - 1, 1]


def test_encoder_on_random_words():
    rng = np.random.default_rng(1)
    pool = [*map(chr, range(1, 128)), *map(chr, range(0xA1, 0x180)), *"ΣσςİǅẞK日\u0301\u0327\u00a0\u2028Ⅷ½", "'s", "'ll", "<|endoftext|>", "<|", " ", " ", "\n"]
    texts = ["".join(rng.choice(pool, rng.integers(0, 60))) for _ in range(1500)]
    ids, size = tf.Encoder(PATH).of(texts)
    for t, x in zip(texts, np.split(ids, np.cumsum(size)[:-1]), strict=True):
        assert x.tolist() == library(t)
    wide = np.array([1, 70_000, 5], np.uint32)
    assert [tf.restored(c).tolist() for c in tf.squeezed(wide, np.array([1, 0, 2]))] == [[1], [], [70_000, 5]]


@pytest.mark.parametrize("limits", [(4_000_000, 4_000_000, 2_000_000), (50, 3000, 40)])
def test_files(spark, tmp_path, limits, monkeypatch):
    for name, x in zip(("FILE_IDS", "RANGE_IDS", "PORTION"), limits, strict=True):
        monkeypatch.setattr(tf, name, x)
    rows = [(i * 7 % 41, t) for i, t in enumerate(TEXTS * 2)] + [(None, "no key"), (None, None), (-5, "before"), (5, "same"), (5, "same"), (1 << 40, "last")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for c in ("part", "row", "ids", "n_ids", "start", "key", "seq"):
        df = df.withColumn(c, F.lit(c))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = tf.op12_token_files(spark, str(tmp_path)).collect()
    crc = lambda t: zlib.crc32(np.array(library(t), "<u4").tobytes())
    assert sorted((r["doc_id"] or -99, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or -99, len(library(t)), crc(t)) for i, t in rows)
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    ids = [r["doc_id"] for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    files = tf.write_files(df, PATH)
    whole = tf.read_files(files).orderBy("place").collect()
    assert [r["place"] for r in whole] == list(range(len(rows)))
    assert sorted((r["key"] or -99, r["ids"]) for r in whole) == sorted((i or -99, library(t)) for i, t in rows)
    counts = np.bincount(np.concatenate([r["ids"] for r in whole]))
    order = tf.read_ranks(files.first()["path"])
    assert order[0] == counts.argmax() and (np.diff(np.append(counts, np.zeros(len(order) - len(counts)))[order]) <= 0).all()


def test_no_rows_and_other_keys(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(ValueError):
        tf.write_files(df, PATH)
    assert tf.read_files(tf.write_files(df.limit(0).withColumn("doc_id", F.lit(1)), PATH)).collect() == []


def test_broken_file(tmp_path):
    (tmp_path / "x.ids").write_bytes(bytes(40))
    with pytest.raises(ValueError):
        tf.read_file(f"file://{tmp_path}/x.ids", np.arange(3))


def test_only_different_words_are_looked_up(monkeypatch):
    """A text of repeated words asks for each once, white space at the ends gives nothing, and an encoder serves a worker's later tasks."""
    asked = []
    numbers = tf.Ragged.numbers
    monkeypatch.setattr(tf.Ragged, "numbers", lambda self, keys, n: asked.append(n) or numbers(self, keys, n))
    e = tf.encoder_of(PATH)
    assert tf.encoder_of(PATH) is e
    texts = ["  the cat\n" * 500 + "\tthe", None, "cat the ", "", " \n\x0b", "x\x1cy\x85z \xa0the"]
    ids, size = e.of(texts)
    assert asked[0] <= 6  # the, cat, the two of the last text, and the empty word
    want = [[*e.tok.encode(t or "", add_special_tokens=False).ids, tf.END_ID] for t in texts]
    assert ids.tolist() == [i for t in want for i in t] and size.tolist() == list(map(len, want))
    asked.clear()
    e.of(["cat the the"])
    assert asked == [2]  # nothing new to cut


def same(e, texts):
    ids, size = e.of(texts)
    want = [library(t) for t in texts]
    assert ids.tolist() == [i for t in want for i in t] and size.tolist() == list(map(len, want))


def test_only_different_pieces_are_looked_up(monkeypatch):
    """Words that differ but consist of the same pieces ask for each piece once; odd words ask for themselves."""
    asked = []
    numbers = tf.Ragged.numbers
    monkeypatch.setattr(tf.Ragged, "numbers", lambda self, keys, n: asked.append(n) or numbers(self, keys, n))
    e = tf.Encoder(PATH)
    same(e, [" ".join(f"Größe{i}.été{j}'s" for i in range(100) for j in range(k, 100, 2)) for k in (0, 1)])
    assert asked == [14]  # größe, été, the dot, 's and ten digits
    same(e, ["日本 größe,日本", "日本"])
    assert asked == [14, 2]


def test_pieces_end_with_their_texts():
    """Contractions and runs are not continued in the next text, and case, marks and special strings are the library's."""
    e = tf.Encoder(PATH)
    parts = ["don'", "t", "'", "ll", "'l", "l", "'re've'd'm'S'LL", "!'s", "''s", "'s's", "'sword", "1't2", "a", "b", "1", "2", "#", "'", "É", "é\u0301", "ÿŸĿſ×÷ªº", "<|start", "oftext|>", "x<|endoftext|>'ll", "'", "re", "\x1c", "'v\x1ce", None, "", " ' s "]
    same(e, parts)
    rng = np.random.default_rng(2)
    for _ in range(200):
        same(e, ["".join(rng.choice([p or " " for p in parts], rng.integers(0, 6))) for _ in range(rng.integers(1, 8))])
    raised = tf.Encoder(PATH)
    raised.by_piece = False  # other patterns: by whole words
    same(raised, parts)


def test_long_words_are_not_kept_without_bound(monkeypatch):
    """Words of scripts without white space are few and long: their ids count too."""
    monkeypatch.setattr(tf, "KEPT", 20)
    e = tf.Encoder(PATH)
    same(e, [f"{i}" + "日本語" * 20 for i in range(15)])
    assert len(e.words.known) == 15 and len(e.words.flat) > 160
    same(e, ["a b"])
    assert len(e.words.known) == 2


def test_encoder_needs_no_installed_package(tmp_path):
    """Executors get the encoder with the code of the task."""
    (tmp_path / "f").write_bytes(cloudpickle.dumps((tf.encoder_of, tf.restored, tf.squeezed)))
    code = f"import pickle, sys; e, r, s = pickle.load(open('f', 'rb')); assert 'oddlens' not in sys.modules; x = e({PATH!r}); assert x is e({PATH!r}); i, n = x.of(['The cat', '日本']); print(i.tolist(), [r(c).tolist() for c in s(i, n)])"
    got = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    parts = [library("The cat"), library("日本")]
    assert got.stdout.strip() == f"{sum(parts, [])} {parts}", got.stderr
