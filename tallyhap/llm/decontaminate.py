"""Benchmark decontamination: an FM-index per training shard.

Each task reads its documents in shards of about `shard_words` words. Words of
the benchmark are the alphabet and every other word is a separator, so runs too
short for any window drop out before the shard is indexed; that loses nothing.
All windows are searched backward through wavelet-tree ranks at once,
occurrences are located by sampled suffix positions, and their spans merge.

Documents are not shuffled. The benchmark's windows are packed by tasks into
blocks of about `block_chars` characters in the shared folder; a task holds one
block at a time, so the benchmark's size is not limited. An index lives as long
as its shard is in work; with several blocks it is made anew for each.

Nulls: a null text has no words; an item without words has no window and never
occurs; a null item_id is the empty id. Items that share an item_id are one
item with the windows of all. Texts of any length are read whole. Repeated rows
are judged one by one. Extra columns are ignored (`clean` keeps them).
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_dir, release_memory, small_batches
from .fm_index import FMIndex
from .secrets import cut_out

#: Words are runs of digits, letters and non-ASCII characters; A-Z reads as a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOCATE = 500_000


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 8
    items: int = 2
    shard_words: int = 1_000_000
    block_chars: int = 4_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class WindowBlock:
    """Windows of some items over their own vocabulary (ids from 1)."""

    vocabulary: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    owners: list[np.ndarray]  # of each window, places in ids
    ids: list[str]

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], size: int) -> WindowBlock:
        vocabulary: dict[bytes, int] = {}
        ids = sorted({"" if i is None else str(i) for i, _ in items})
        place = {x: k for k, x in enumerate(ids)}
        windows: dict[tuple[int, ...], set[int]] = {}
        for i, text in items:
            seq = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
            for k in range(max(1, len(seq) - size + 1) if seq else 0):
                windows.setdefault(tuple(seq[k : k + size]), set()).add(place["" if i is None else str(i)])
        patterns = np.zeros((len(windows), size), np.int64)
        for row, w in zip(patterns, windows):
            row[: len(w)] = w
        return cls(vocabulary, patterns, np.array([len(w) for w in windows], np.int64), [np.array(sorted(x)) for x in windows.values()], ids)


def pattern_blocks(spark: SparkSession, benchmark: DataFrame, params: DecontaminationParams, item: str = "item_id", text: str = "text") -> list[tuple[str, str]]:
    """(folder, name) of blocks in the shared folder. Only the files that the
    collected rows name count, whatever a repeated task may leave."""
    small_batches(spark)
    few = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks = 1 + (few.agg(F.sum(F.length("text"))).first()[0] or 0) // params.block_chars
    at = fresh_dir(spark, "windows")
    directory = at if "://" in at or at.startswith("file:") else f"file://{at}"

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [_dump(directory, WindowBlock.of([(i, t if isinstance(t, str) else None) for i, t in zip(g["item"], g["text"])], params.window))]})

    found = few.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).applyInPandas(pack, "name string").collect()  # a name a block
    return [(directory, r["name"]) for r in found] or [(directory, _dump(directory, WindowBlock.of([], params.window)))]


def _dump(directory: str, block: WindowBlock) -> str:
    store, root = fs.FileSystem.from_uri(directory)
    store.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(pickle.dumps(block))
    return name


@lru_cache(maxsize=1)
def _load(directory: str, name: str) -> WindowBlock:
    store, root = fs.FileSystem.from_uri(directory)
    with store.open_input_file(f"{root}/{name}") as f:
        return pickle.loads(f.read())


def find(texts: list[str | None], block: WindowBlock) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each text: its words, the places of hit words and of items in ids."""
    get, n = block.vocabulary.get, len(texts)
    parts, sizes = [], np.zeros(n, np.int64)
    for k, t in enumerate(texts):
        w = words(t)
        sizes[k] = len(w)
        parts += [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)), np.zeros(1, np.int32)]
    none = [np.zeros(0, np.int64)] * n
    if not len(block.patterns) or not sizes.sum():
        return sizes, none, list(none)
    flat = np.concatenate([np.zeros(1, np.int32), *parts])
    inside = flat > 0
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    long = ends - starts >= block.lengths.min()
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return sizes, none, list(none)
    # each kept run with the separator before it, and one at the end
    span = ends - starts + 1
    at = np.repeat(starts - 1 - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
    index = FMIndex(np.append(flat[at], 0), len(block.vocabulary) + 1)
    lo, hi = index.search(block.patterns, block.lengths)
    doc_ends = np.cumsum(sizes + 1)  # in flat, document k has the places from doc_ends[k-1] + 1
    cover = np.zeros(len(flat) + 1, np.int32)
    found: set[tuple[int, int]] = set()
    n_rows = hi - lo
    for first in _chunks(n_rows, _LOCATE):
        which = np.repeat(first, n_rows[first])
        offset = np.arange(len(which)) - np.repeat(np.cumsum(n_rows[first]) - n_rows[first], n_rows[first])
        places = at[index.locate(lo[which] + offset)]
        np.add.at(cover, places, 1)
        np.add.at(cover, places + block.lengths[which], -1)
        docs = np.searchsorted(doc_ends, places - 1, side="right")
        for w, d in np.unique(np.stack([which, docs], 1), axis=0):
            found.update((int(d), int(i)) for i in block.owners[w])
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    of = np.searchsorted(doc_ends, hit - 1, side="right")
    begins = np.concatenate([[0], doc_ends[:-1]]) + 1
    hits, items = list(none), list(none)
    for d in np.unique(of):
        hits[d] = hit[np.searchsorted(of, d) : np.searchsorted(of, d, side="right")] - begins[d]
    by_doc: dict[int, list[int]] = {}
    for d, i in found:
        by_doc.setdefault(d, []).append(i)
    for d, x in by_doc.items():
        items[d] = np.array(sorted(x))
    return sizes, hits, items


def _chunks(sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of non-empty windows in parts of about `most` occurrences."""
    part, held = [], 0
    for k in np.flatnonzero(sizes):
        part.append(k)
        held += sizes[k]
        if held >= most:
            yield np.array(part)
            part, held = [], 0
    if part:
        yield np.array(part)


def judge(texts: list[str | None], blocks: list[tuple[str, str]]) -> list[tuple[int, np.ndarray, list[str]]]:
    """(number of words, places of hit words, item ids as sorted strings)."""
    sizes, hits, items = None, [np.zeros(0, np.int64)] * len(texts), [set() for _ in texts]
    for at in blocks:
        block = _load(*at)
        sizes, new, of = find(texts, block)
        for k in range(len(texts)):
            if len(new[k]):
                hits[k] = np.union1d(hits[k], new[k])
            if len(of[k]):
                items[k].update(block.ids[i] for i in of[k])
    return [(int(n), h, sorted(i)) for n, h, i in zip(sizes, hits, items)]


def shards(texts: pd.Series, most: int) -> Iterator[slice]:
    """Parts of a batch of about `most` words (an estimate by length)."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t) // 4 if isinstance(t, str) else 0
        if held >= most:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Merged [start, end) of sorted places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return [(int(a), int(b) + 1) for a, b in zip(places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)])]


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def find_contamination(documents: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated, and the merged
    removal spans (in words) of each document."""
    blocks = pattern_blocks(documents.sparkSession, benchmark, params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in shards(b["text"], params.shard_words):
                own = b.iloc[part]
                found = judge([t if isinstance(t, str) else None for t in own["text"]], blocks)
                yield pd.DataFrame({
                    "key": own["key"].to_numpy(), "n_words": [n for n, _, _ in found], "n_hit": [len(h) for _, h, _ in found],
                    "n_items": [len(i) for *_, i in found], "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for *_, i in found],
                    "contaminated": [len(i) >= params.items for *_, i in found], "spans": [",".join(f"{s}:{e}" for s, e in runs(h)) for _, h, _ in found],
                })
        release_memory()

    few = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = few.schema["key"].dataType.simpleString()
    return few.mapInPandas(run, f"key {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string").withColumnRenamed("key", key)


def clean(documents: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams(), text: str = "text", out: str = "contaminated") -> DataFrame:
    """documents with hit words cut out of `text` (span by span, from the first
    word to the last) and a boolean `out` that says which were contaminated."""
    blocks = pattern_blocks(documents.sparkSession, benchmark, params)

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("hit", T.BooleanType())]))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for part in shards(b, params.shard_words):
                own = [t if isinstance(t, str) else None for t in b.iloc[part]]
                for t, (_, hits, items) in zip(own, judge(own, blocks)):
                    rows.append((cut_out(t, char_spans(t, runs(hits)), "") if len(hits) else t, len(items) >= params.items))
            yield pd.DataFrame(rows, columns=["text", "hit"])
        release_memory()

    return documents.withColumn(out, cut(F.col(f"`{text}`").cast("string"))).withColumn(text, F.col(out)["text"]).withColumn(out, F.col(out)["hit"])
