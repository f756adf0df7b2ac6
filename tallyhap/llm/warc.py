"""WARC: archives with revisit records, and capture histories by external merge.

Pages are written as gzip members of WARC/1.1 records into files of the shared
folder, each task its own files. Of records with equal payloads the one of the
smallest id is a response, the others are revisits of it. The task sorts the
index of each file by URL key, timestamp and id: a locally sorted capture run,
which is kept in the shared folder. Runs are dealt by as many ranges of that key
as the index needs for `range_rows` rows each, and each task merges its parts of
them externally: what exceeds `range_rows` rows goes to sorted run files in the
shared folder, `fan_in` files become one where more would be open, and a loser
tree merges the streams of the rest. That gives globally ordered capture
histories; records are read back from the archives along them.

Files are named by attempt and the index rows that name them are written once,
so a lost executor leaves at most files that no index row names. Payloads are
grouped by digest with pre-aggregation; a hot payload's records are split by
Spark's skew handling. No task holds more than about `range_rows` index rows.

Nulls: null html is an empty payload; a null URL has the empty key and no
target; a null timestamp is the epoch. A row without id is a response unless an
equal payload has an id. Rows that share an id and payload are all responses.
Payloads of any length are written whole. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, partitions, written
from .url_filter import canonical

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NOT_PLAIN = re.compile(r"[\x00-\x20\x7f]")


@dataclass(frozen=True)
class WarcParams:
    """least_revisit: payloads of fewer bytes are never revisits."""

    least_revisit: int = 0
    file_bytes: int = 64 << 20
    range_rows: int = 50_000
    fan_in: int = 64
    level: int = 4


def url_key(url: str | None) -> str:
    """Host labels from the top, then the path and query: com,example)/a?b."""
    host, path = canonical(url)
    rest = (url or "").partition("://")[2]
    query = rest.partition("#")[0].partition("?")
    return f"{','.join(reversed(host.split('.')))}){path}{query[1]}{query[2]}" if host or path else ""


def record(page: int | None, url: str | None, when: int, payload: bytes, refers: int | None) -> bytes:
    """One WARC record; refers: the page that this one revisits."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {datetime.fromtimestamp(when, UTC):%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _NOT_PLAIN.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    page: int | None
    kind: str
    refers: int | None
    digest: str
    payload_bytes: int
    payload: bytes | None
    url: str | None


def read_record(data: bytes) -> Record:
    """Parse one record; a response's payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = field["WARC-Payload-Digest"].removeprefix("sha1:"), field["WARC-Type"]
    size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    page = lambda x: int(x[len("<urn:page:") : -1]) if len(x) > len("<urn:page:>") else None
    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size):
        raise ValueError(f"damaged payload of page {field['WARC-Record-ID']}")
    refers = page(field["WARC-Refers-To"]) if kind == "revisit" else None
    return Record(page(field["WARC-Record-ID"]), kind, refers, digest, size, payload if kind == "response" else None, field.get("WARC-Target-URI"))


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match,
    so the next smallest takes one walk from a leaf to the root."""

    def __init__(self, runs: Sequence[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.head = [next(r, None) for r in self.runs] + [None] * (self.k - len(self.runs))
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None if x is not None and y is None else x is not None and (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (top := self.tree[0]) >= 0 and self.head[top] is not None:
            yield self.head[top]
            self.head[top] = next(self.runs[top], None)
            self._play(top)


class ExternalMerge:
    """Merges runs that come one after another, a new one wherever the order
    breaks. At most `most` entries are held; beyond, they are merged into a
    sorted run file, and `fan_in` files into one."""

    def __init__(self, store: fs.FileSystem, root: str, most: int, fan_in: int):
        self.store, self.root, self.most, self.fan_in = store, root, most, fan_in
        self.runs: list[list] = []
        self.held, self.files = 0, []

    def add(self, entry) -> None:
        if not self.runs or entry < self.runs[-1][-1]:
            self.runs.append([])
        self.runs[-1].append(entry)
        self.held += 1
        if self.held >= self.most:
            self._spill([iter(r) for r in self.runs])
            self.runs, self.held = [], 0
            if len(self.files) >= self.fan_in:
                old, self.files = self.files, []
                self._spill([self._read(x) for x in old])
                self._delete(old)

    def __iter__(self):
        yield from LoserTree([self._read(x) for x in self.files] + [iter(r) for r in self.runs])
        self._delete(self.files)

    def _spill(self, runs: list[Iterator]) -> None:
        name, part = f"{self.root}/{uuid.uuid4().hex}.run", []
        with self.store.open_output_stream(name, compression=None) as f:
            for e in LoserTree(runs):
                part.append(e)
                if len(part) == 1024:
                    self._frame(f, part)
                    part = []
            if part:
                self._frame(f, part)
        self.files.append(name)

    @staticmethod
    def _frame(f, part: list) -> None:
        data = pickle.dumps(part)
        f.write(struct.pack("<q", len(data)) + data)

    def _read(self, name: str) -> Iterator:
        with self.store.open_input_stream(name, compression=None) as f:
            while head := f.read(8):
                yield from pickle.loads(f.read(struct.unpack("<q", head)[0]))

    def _delete(self, names: list[str]) -> None:
        for x in names:
            self.store.delete_file(x)


def write_archives(pages: DataFrame, directory: str, params: WarcParams = WarcParams(), key: str = "page_id", url: str = "url", html: str = "html", timestamp: str | None = None) -> DataFrame:
    """Write the archives below `directory` (a URI that executors share) and
    return the index: url_key, timestamp, page, file, offset, length."""
    p, spark = params, pages.sparkSession
    when = F.coalesce(F.unix_timestamp(F.col(f"`{timestamp}`")), F.lit(0)) if timestamp else F.lit(0)
    few = pages.select(F.col(f"`{key}`").cast("long").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), when.cast("long").alias("when"), F.coalesce(F.encode(F.col(f"`{html}`").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    # the second column tells payloads of one digest apart, should there be any
    same = few.withColumn("d1", F.sha1("payload")).withColumn("d2", F.xxhash64("payload"))
    first = same.groupBy("d1", "d2").agg(F.min("page").alias("first"))
    both = same.join(first.hint("merge"), ["d1", "d2"]).select("page", "url", "when", "payload", F.when((F.octet_length("payload") >= p.least_revisit) & (F.col("first") != F.coalesce("page", F.col("first") - 1)), F.col("first")).alias("refers"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(directory)
        store.create_dir(root, recursive=True)
        out, rows, offset, name = None, [], 0, ""

        def closed() -> pd.DataFrame:
            nonlocal out, rows, offset
            out.close()
            run_ = pd.DataFrame(sorted(rows, key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[4])), columns=["url_key", "timestamp", "page", "file", "offset", "length"])
            out, rows, offset = None, [], 0
            return run_.astype({"page": "Int64"})

        for f in it:
            for page, link, t, payload, refers in zip(f["page"], f["url"], f["when"], f["payload"], f["refers"]):
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                link = link if isinstance(link, str) else None
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(name, compression=None)
                gz = zlib.compressobj(p.level, zlib.DEFLATED, 31)
                data = gz.compress(record(page, link, int(t), payload, refers)) + gz.flush()
                out.write(data)
                rows.append((url_key(link), int(t), page, name, offset, len(data)))
                offset += len(data)
                if offset >= p.file_bytes:
                    yield closed()
        if out is not None:
            yield closed()

    return written(both.mapInPandas(run, "url_key string, timestamp long, page long, file string, offset long, length long"), "warc-index")


def histories(index: DataFrame, directory: str, params: WarcParams = WarcParams()) -> DataFrame:
    """The records along the globally ordered capture histories: url_key,
    timestamp, page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(directory)
        merge = ExternalMerge(store, root, params.range_rows, params.fan_in)
        for f in it:
            for u, t, g, x, o, n in zip(f["url_key"], f["timestamp"], f["page"], f["file"], f["offset"], f["length"]):
                merge.add((u, int(t), -1 if pd.isna(g) else int(g), x, int(o), int(n)))
        part: list[tuple] = []
        for e in merge:
            part.append(e)
            if len(part) == 2048:
                yield _read(store, part)
                part = []
        if part:
            yield _read(store, part)

    spark = index.sparkSession
    ranges = max(partitions(spark), -(-index.count() // params.range_rows))
    ranged = index.repartitionByRange(ranges, "url_key", "timestamp", "page", "file", "offset")
    return ranged.mapInPandas(run, "url_key string, timestamp long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _read(store, entries: list[tuple]) -> pd.DataFrame:
    """Records of some index entries, each file opened once."""
    found: list[Record | None] = [None] * len(entries)
    handle, name = None, None
    for k in sorted(range(len(entries)), key=lambda k: entries[k][3:5]):
        *_, file, offset, length = entries[k]
        if file != name:
            if handle is not None:
                handle.close()
            handle, name = store.open_input_file(file), file
        handle.seek(offset)
        found[k] = read_record(zlib.decompress(handle.read(length), 31))
    if handle is not None:
        handle.close()
    out = pd.DataFrame({
        "url_key": [e[0] for e in entries], "timestamp": [e[1] for e in entries], "page_id": pd.array([r.page for r in found], "Int64"), "payload_bytes": np.array([r.payload_bytes for r in found], np.int64),
        "payload_digest": [r.digest for r in found], "record_type": [r.kind for r in found], "refers_to": pd.array([r.refers for r in found], "Int64"),
    })
    return out


def archive_directory(spark: SparkSession) -> str:
    """A new folder for archives below the shared one, as a URI."""
    path = fresh_dir(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
