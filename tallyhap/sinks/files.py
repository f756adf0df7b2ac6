"""Single-file text outputs in order of rows.

Tasks write the lines of their partitions as parts in the shared folder, BGZF
blocks already where the file is to be compressed, and the driver joins the
parts by copying bytes. These formats are one ordered file by definition; large
results belong in Parquet.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class _Bgzf:
    """Blocks of at most 64 KB, each a gzip member that names its size."""

    def __init__(self, f):
        self.f, self.held = f, b""

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= 65280:
            self.f.write(_block(self.held[:65280]))
            self.held = self.held[65280:]

    def flush(self) -> None:
        if self.held:
            self.f.write(_block(self.held))
        self.held = b""

    def end(self) -> None:
        self.flush()
        self.f.write(_EOF)


@contextmanager
def text_file(path: str, bgzf: bool | None = None, joined: Callable | None = None):
    """A write(line) function; the file appears under its name when complete.
    joined: what puts more bytes (or BGZF blocks) behind the lines."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    temp = name + ".tmp"
    if "/" in name:
        store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(temp, compression=None) as f:
        out = _Bgzf(f) if (bgzf if bgzf is not None else path.endswith((".gz", ".bgz"))) else f
        yield lambda line: out.write((line + "\n").encode())
        if isinstance(out, _Bgzf):
            out.flush()
        if joined is not None:
            joined(f)
        if isinstance(out, _Bgzf):
            out.end()
    store.move(temp, name)


def shared_uri(spark: SparkSession, name: str) -> str:
    at = shared_path(spark, name)
    return at if "://" in at or at.startswith("file:") else f"file://{at}"


def write_rows(df: DataFrame, path: str, header: Callable[[int], list[str]], sep: str = "\t") -> int:
    """The rows of df, in order of its partitions, below the header, which is
    made once their number is known. df is evaluated once."""
    spark, bgzf = df.sparkSession, path.endswith((".gz", ".bgz"))
    directory = shared_uri(spark, "lines")
    columns = [f"c{k}" for k in range(len(df.columns))]  # names may repeat
    values = df.toDF(*columns).select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("v"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(directory)
        store.create_dir(root, recursive=True)
        k, name, n = TaskContext.get().partitionId(), uuid.uuid4().hex, 0  # a repeated task writes another file
        with store.open_output_stream(f"{root}/{name}", compression=None) as f:
            out = _Bgzf(f) if bgzf else f
            for b in it:
                n += b.num_rows
                out.write("".join([x + "\n" for x in b.column(0).to_pylist()]).encode())
            if bgzf:
                out.flush()
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([name]), pa.array([n], pa.int64())], names=["part", "name", "n"])

    parts = sorted(tuple(r) for r in values.mapInArrow(run, "part int, name string, n long").collect())  # a row a task
    total = sum(n for *_, n in parts)
    store, root = fs.FileSystem.from_uri(directory)
    with text_file(path, joined=lambda f: [_copy(store, f"{root}/{name}", f) for _, name, n in parts if n]) as write:
        for line in header(total):
            write(line)
    if parts:
        store.delete_dir(root)
    return total


def _copy(store: fs.FileSystem, source: str, target) -> None:
    with store.open_input_stream(source, compression=None) as f:
        while data := f.read(8 << 20):
            target.write(data)


def bgzip(source: str, target: str) -> None:
    """A plain or gzip file as BGZF."""
    with open(source, "rb") as f, text_file(target, bgzf=True) as write:
        d = zlib.decompressobj(47) if f.read(2) == b"\x1f\x8b" else None
        f.seek(0)
        rest = b""
        while data := f.read(1 << 20):
            rest += d.decompress(data) if d else data
            *full, rest = rest.split(b"\n")
            for line in full:
                write(line.decode())
        if rest:
            write(rest.decode())
