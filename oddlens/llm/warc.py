"""WARC archives and their index by external merging.

write_archives() puts captures into gzipped WARC files of bounded size in the shared folder, one member a record.
Of captures with equal payloads of MIN_REVISIT bytes or more, the one with the largest id is a response record that
holds the payload, and the others are revisit records that refer to it. read_archives() reads files back, record by
record, and checks payload digests. index() is the external merge: every archive file gives a run sorted by URL key,
time and id; runs are dealt by ranges of that key, and each range merges its pieces of the runs with a loser tree,
so that the ranges in order are the globally ordered capture histories. A range splits the captures of one URL too.

Null payloads are empty. A null URL is left out of its record and reads back as null; white space and control
characters in URLs are percent-encoded. Null times are left out too. Rows with one id repeat a record: each is
written, and all rows with the largest id of a payload are responses. A null id never refers to anything larger. Records
with equal keys, times and ids stay in the order of their runs. Payloads of any length are written and read whole, one at
a time. Columns besides the four named are not written. An empty table writes no file and gives no rows. Files are named anew by each task attempt and only those that a
finished task lists are read, so lost executors leave no trace in results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import shared_dir, with_few, written
from oddlens.llm.url_filter import fetch_time

MIN_REVISIT = 1000
#: An archive file is closed after so many compressed bytes.
FILE_BYTES = 8_000_000
LEVEL = 3
#: Records of one range of the index.
RANGE_ROWS = 50_000
_ID = "urn:capture:"
_RUN = "run string, seq bigint, page_id bigint, url string, url_key string, fetched_at string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_KEY = ["url_key", "fetched_at", "page_id"]


def typed(captures: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched_at, html) with payload_bytes, digest, record_type and refers_to."""
    d = captures.withColumn("html", F.coalesce("html", F.lit("")))
    d = d.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "digest": F.sha1("html")})
    twice = d.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("_resp"), F.count(F.lit(1)).alias("_n"))
    twice = written(twice.where("_n > 1 and _resp is not null").select("digest", "_resp"), "payloads")
    d = with_few(d, twice, ["digest"])
    revisit = F.col("_resp").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_resp"))
    return d.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_resp"))}).drop("_resp")


def record(page_id, url, fetched_at, payload: bytes, digest: str, refers_to) -> bytes:
    """The uncompressed WARC record; refers_to: None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if fetched_at is not None:
        head.append(f"WARC-Date: {fetched_at}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """What the records of an uncompressed WARC stream say; ValueError if a payload does not have its digest."""
    while line := stream.readline():
        if not line.strip():
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        if head["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{head['warc-record-id']}: the payload does not match its digest")
        own, other = (head.get(k, "").strip("<>").removeprefix(_ID) for k in ("warc-record-id", "warc-refers-to"))
        size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
        yield {"page_id": int(own) if own != "None" else None, "url": head.get("warc-target-uri"), "fetched_at": head.get("warc-date"), "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": int(other) if other else None, "payload": payload}


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels from the last, then the path in lower case, without scheme, fragment and final slash."""
    if url is None:
        return ""
    rest = re.sub(r"^[A-Za-z][\w+.-]*://", "", url).partition("#")[0]
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.lower().split(":")[0].split("."))) + ")" + slash + path.lower().rstrip("/")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(captures: DataFrame) -> DataFrame:
    """Writes captures (page_id, url, fetched_at, html); returns a written table of the files (path, n_records)."""
    folder = f"{shared_dir(captures.sparkSession)}/oddlens/warc-{uuid.uuid4().hex}"
    rows = typed(captures).select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "html", "digest", "refers_to")

    def write(batches):
        store, path = _open(folder)
        out, size, n, name = None, 0, 0, ""
        for b in batches:
            ids, refers = b["page_id"].tolist(), b["refers_to"].tolist()
            for i, u, at, h, d, r in zip(ids, b["url"].tolist(), b["at"].tolist(), b["html"].tolist(), b["digest"].tolist(), refers, strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(path)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = record(None if pd.isna(i) else int(i), u, at, h.encode(), d, None if pd.isna(r) else int(r))
                data = z.compress(raw) + z.flush()
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "n_records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "n_records": [n]})

    return written(rows.mapInPandas(write, "path string, n_records bigint"), "archives")


def read_archives(files: DataFrame) -> DataFrame:
    """Rows of the records in the files (path); the rows of a file are a run, sorted by URL key, time and id."""

    def read(batches):
        for b in batches:
            for uri in b["path"].tolist():
                store, path = _open(uri)
                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as z:
                    rows = [{k: v for k, v in r.items() if k != "payload"} | {"url_key": url_key(r["url"])} for r in records(io.BufferedReader(z, 1 << 20))]
                rows.sort(key=sort_key)
                t = pd.DataFrame(rows, columns=[c.split()[0] for c in _RUN.split(", ")])
                t["run"], t["seq"] = uri.rpartition("/")[2], range(len(t))
                yield t.astype({"page_id": "Int64", "refers_to": "Int64"})

    n = max(1, files.count())  # files have bounded size: a task each
    return files.select("path").repartition(n).mapInPandas(read, _RUN)


def sort_key(r: dict) -> tuple:
    return r["url_key"], r["fetched_at"] or "", -1 if r["page_id"] is None else r["page_id"]


class LoserTree:
    """Merges k sorted sequences of (key, value); each output costs one comparison a level. Equal keys come in order of sequence."""

    def __init__(self, runs: list[Iterable[tuple]]) -> None:
        self.its = [iter(r) for r in runs]
        self.k = len(self.its)
        self.head = [next(it, None) for it in self.its]
        self.tree = [-1] * max(1, self.k)  # losers; tree[0] is the winner
        for i in range(self.k - 1, -1, -1):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x[0], a) < (y[0], b)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # while the tree is built, the first to come waits for its opponent
                self.tree[node] = i
                return
            if self._less(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (top := self.head[w := self.tree[0]]) is not None:
            yield top
            self.head[w] = next(self.its[w], None)
            self._replay(w)


def index(runs: DataFrame, n: int | None = None) -> DataFrame:
    """runs, as read_archives() gives them and written: globally ordered by URL key, time and id. n: ranges; by default so
    many that each has about RANGE_ROWS records."""
    cols = [c.split()[0] for c in _RUN.split(", ")]

    def merge(batches):
        # what a range gets of each run, kept as columns; the tree merges keys and places
        pieces: dict[str, list[pd.DataFrame]] = {}
        for b in batches:
            for run, part in b.groupby("run", sort=False):
                pieces.setdefault(run, []).append(part)
        if not pieces:
            return
        tables, keys, base = [], [], 0
        for run in sorted(pieces):
            t = pd.concat(pieces.pop(run)).sort_values("seq")
            tables.append(t)
            ids = [-1 if pd.isna(i) else int(i) for i in t["page_id"]]
            keys.append(zip(zip(t["url_key"], t["fetched_at"].fillna(""), ids, strict=True), range(base, base + len(t)), strict=True))
            base += len(t)
        whole = pd.concat(tables, ignore_index=True).astype({"page_id": "Int64", "refers_to": "Int64"})
        del tables
        order = [at for _, at in LoserTree(keys)]
        for lo in range(0, base, 10_000):
            yield whole.iloc[order[lo : lo + 10_000]][cols]

    key = [F.col("url_key"), F.coalesce("fetched_at", F.lit("")), F.coalesce("page_id", F.lit(-1))]
    n = n or runs.count() // RANGE_ROWS + 1
    return runs.repartitionByRange(n, *key).mapInPandas(merge, _RUN).drop("run", "seq")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write_archives(pages.select("page_id", "url", fetch_time(F.col("page_id")).alias("fetched_at"), "html"))
    runs = written(read_archives(files), "runs")
    return index(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Record types and digests follow from the table alone; the archives must give them back.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM r
"""
