"""N-gram Jaccard join: documents whose sets of word 5-grams have a Jaccard
similarity of 0.8 or more, exactly, and the components that the links form.

Set-relation skipping on top of a prefix filter:

* Sets are 64-bit hashes of word 5-grams. Equal texts, then equal sets, are one
  class and take part once. Linked sets share an element of their prefixes.
* Elements stand rarest first. Those whose hash lies in the lowest `known` part
  of the range are counted over all documents (so are others that are frequent
  within a batch). They come first, in order of hash, as long as they are in few
  sets; the others follow; frequent ones come last. The table of frequent
  elements is the bounded one of the highest counts; it steers the order only.
* Index lists (one per element) hold their sets by position, then size, and are
  cut into blocks of one position. For a set and a block the sizes that can
  reach the overlap from there are an interval; a block without such sizes is
  skipped as a whole, and of others only the sets of the interval are met.
* In a long list the sets of the lowest positions, which resemble most others,
  lead: the others are compared with them first. A set that proves similar to
  a leader takes over the leader's answers: pairs within one component are not
  computed again. Only sets outside the list's largest component still meet the
  rest of the list, in parts of bounded size, so no link between components is
  lost.

* That is enough for components (similar_components). For all links (class_links,
  link_counts) a class keeps its difference from the class that leads it, and
  followers of one leader are decided from these, exactly and without texts;
  other pairs of long lists are verified.

Candidates are verified on whole texts: the one of a pair that has more partners
is the hub, whose text goes once to each `block` of its partners. Packed arrays
are shuffled, not rows; texts are read again only for the sets in candidate pairs.

Nulls: a null or wordless text has the empty set, links with nothing and is its
own component. Fewer than five words are one shingle. Texts go by the MD5 of
their own until the end, so rows without an id, or with an id that other texts
have too, link and bridge as any others. A component is named by its smallest
id, by null if it has none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, release_memory, small_batches, steps, written
from .components import connected

_CACHE_WORDS = 150_000
#: Odd multipliers, one per place of a word in its shingle.
_PLACES = np.array([xxhash.xxh3_64_intdigest(b"place %d" % k) | 1 for k in range(64)], np.uint64)
_words: dict[bytes, int] = {}


@dataclass(frozen=True)
class JaccardParams:
    """percent: the least similarity. known: part of the hash range that is
    counted over all sets. frequent: how many of the most frequent shingles are
    broadcast (12 bytes each); local: sets of one batch that must share a
    shingle outside `known` for it to count. short: lists up to this length
    meet in full at once. leaders: of a longer list. broadcast_ids: ids or
    names that are broadcast at most (8 or 32 bytes each); beyond, texts are joined by a shuffle.
    block: followers of one leader that are compared with as many others at
    once, partners of one hub, and sets of a list's part."""

    shingle: int = 5
    percent: int = 80
    known: float = 0.3
    frequent: int = 500_000
    local: int = 3
    short: int = 6
    leaders: int = 2
    batch: int = 500_000
    broadcast_ids: int = 500_000
    block: int = 1000


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, np.uint64)
    try:
        w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_words) > _CACHE_WORDS:
            _words.clear()
        for x in words:
            if x not in _words:
                _words[x] = xxhash.xxh3_64_intdigest(x)
        w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    k = min(size, len(w))
    h = np.full(n, 0 if k == size else 7919 * k, np.uint64)
    for j in range(k):
        h += w[j : j + n] * _PLACES[j % 64]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def linked(common: np.ndarray | int, m: np.ndarray | int, n: np.ndarray | int, percent: int = 80):
    """Whether `common` of m and n elements reach the similarity."""
    return 100 * common >= percent * (m + n - common)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    v = xxhash.xxh3_128_intdigest(s.tobytes())
    return (v >> 64) - (1 << 63), (v & (2**64 - 1)) - (1 << 63)


def _batches(it: Iterator[pa.RecordBatch], most: int, size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and sets of about `most` elements together. Texts become Python
    strings a few at a time, and at a task's end the worker lets go of its words."""
    keys, sets, held = [], [], 0
    for b in it:
        for at in range(0, b.num_rows, 128):
            few = b.slice(at, 128)
            keys += few.column("key").to_pylist()
            for t in few.column("text").to_pylist():
                sets.append(shingles(t, size))
                held += len(sets[-1])
            if held >= most:
                yield keys, sets
                keys, sets, held = [], [], 0
    if keys:
        yield keys, sets
    _words.clear()
    release_memory()


def _describe(p: JaccardParams, buckets: int):
    """Of each document its size and signature, in a bucket of its own; and by
    bucket the packed elements of the known part of the range, one for each
    distinct set of the batch. Other elements go by only if a batch's sets
    share them."""
    limit = np.uint64(int(p.known * 2**64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in _batches(it, p.batch, p.shingle):
            sig = [signature(s) for s in sets]
            yield _mixed({
                "bucket": [abs(a) % buckets for a, _ in sig], "doc": [True] * len(keys), "key": keys,
                "n": [len(s) for s in sets], "s1": [a for a, _ in sig], "s2": [b for _, b in sig], "data": [b""] * len(keys),
            })
            every = np.sort(np.concatenate(list({x: s for x, s in zip(sig, sets)}.values())))
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, int)
            count = np.diff(np.append(first, len(every)))
            send = np.repeat((every[first] < limit) | (count >= p.local), count) if len(every) else np.zeros(0, bool)
            every = every[send]
            bucket = (every % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            every, bucket = every[order], bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(every) else np.zeros(0, int)
            if len(cut):
                no, zero = [False] * len(cut), [0] * len(cut)
                yield _mixed({"bucket": bucket[cut], "doc": no, "key": [""] * len(cut), "n": zero, "s1": zero, "s2": zero, "data": [_pack(x) for x in np.split(every, cut[1:])]})

    return run


def _mixed(columns: dict) -> pa.RecordBatch:
    kind = {"doc": pa.bool_(), "key": pa.string(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kind.get(k, pa.int64())) for k, v in columns.items()], names=list(columns))


def _pack(h: np.ndarray) -> bytes:
    """The upper 40 bits of each element (with its bucket, enough to tell
    frequent ones apart; a clash only moves an element in the order)."""
    return (h >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _count(p: JaccardParams):
    """Document rows as they are, and (token, count) of elements that more sets
    have than a short list holds. A token is an element's upper 40 bits and
    bucket."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for f in it:
            data = ~f["doc"]
            parts += [_unpack(x) << np.uint64(24) | np.uint64(b) for b, x in zip(f["bucket"][data], f["data"][data])]
            yield f.loc[~data, ["doc", "key", "n", "s1", "s2"]].assign(token=0, count=0)
        if parts:
            every = np.sort(np.concatenate(parts))
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            count = np.diff(np.append(first, len(every)))
            hot = count > p.short
            for k in range(0, int(hot.sum()), 100_000):
                t, c = every[first][hot][k : k + 100_000], count[hot][k : k + 100_000]
                yield pd.DataFrame({"doc": False, "key": "", "n": 0, "s1": 0, "s2": 0, "token": t.view(np.int64), "count": c})

    return run


_ENTRY = np.dtype([("low", "<u4"), ("mid", "<u2"), ("n", "<u4"), ("at", "<u4"), ("s1", "<i8")])


def prefix(s: np.ndarray, tokens: np.ndarray, counts: np.ndarray, p: JaccardParams, buckets: int) -> np.ndarray:
    """The set's elements by which any linked set must be met, rarest first:
    hashes stand in order, so those of the known part come first by themselves."""
    if len(tokens):
        token = (s >> np.uint64(24) << np.uint64(24)) | (s % np.uint64(buckets))
        at = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
        s = s[np.argsort(np.where(tokens[at] == token, counts[at], 0), kind="stable")]
    return s[: len(s) - -(-p.percent * len(s) // 100) + 1]


def _prefixes(p: JaccardParams, frequent, buckets: int, counted: int):
    """Packed prefix entries by bucket of the element."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = frequent.value
        for _, sets in _batches(it, p.batch, p.shingle):
            once = {}
            for s in sets:
                if len(s):
                    once.setdefault(signature(s)[0], s)
            if not once:
                continue
            parts = [prefix(s, tokens, counts, p, counted) for s in once.values()]
            sizes = np.array([len(x) for x in parts])
            h = np.concatenate(parts)
            e = np.empty(len(h), _ENTRY)
            e["low"], e["mid"] = h & np.uint64(2**32 - 1), (h >> np.uint64(32)) & np.uint64(2**16 - 1)
            e["n"] = np.repeat([len(s) for s in once.values()], sizes)
            e["at"] = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            e["s1"] = np.repeat(np.array(list(once), np.int64), sizes)
            bucket = ((h >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array([x.tobytes() for x in np.split(e, cut[1:])], pa.binary())], names=["bucket", "data"])

    return run


def _fit(e: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether entries a and b can be linked if theirs is the first common
    element: what is left of either set reaches the overlap. That bound also
    rules out sets of unfit size."""
    m, n = e["n"][a].astype(np.int64), e["n"][b].astype(np.int64)
    return linked(np.minimum(m - e["at"][a], n - e["at"][b]), m, n, percent)


def list_pairs(e: np.ndarray, token: np.ndarray, p: JaccardParams) -> tuple[np.ndarray, np.ndarray]:
    """e: entries, by element `token`, then position, then size. Pairs (rows of
    e) to be compared now, and the rows of long lists."""
    new = np.append(True, token[1:] != token[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(e)))
    out = []
    for k in range(2, p.short + 1):
        start = first[size == k]
        for i in range(k):
            for j in range(i + 1, k):
                out.append(np.stack([start + i, start + j]))
    long = size > p.short
    lists, start = np.flatnonzero(long), first[long]
    blocks = np.flatnonzero(new | np.append(True, e["at"][1:] != e["at"][:-1]))
    of = np.searchsorted(first, blocks, side="right") - 1  # each block's list
    first_block, last_block = np.searchsorted(of, lists), np.searchsorted(of, lists, side="right")
    n, count = e["n"].astype(np.int64), last_block - first_block
    place = (np.cumsum(new | np.append(True, e["at"][1:] != e["at"][:-1])) - 1 << 32) + n  # blocks in turn, by size
    for lead in range(p.leaders):
        a = np.repeat(start + lead, count)
        block = np.repeat(first_block, count) + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        m, i, j = n[a], e["at"][a].astype(np.int64), e["at"][blocks[block]].astype(np.int64)
        # sizes that reach the overlap: (100 + percent) min(m - i, n - j) >= percent (m + n)
        least = -(-(p.percent * m + (100 + p.percent) * j) // 100)
        most = ((100 + p.percent) * (m - i) - p.percent * m) // p.percent
        some = (least <= most) & (most >= 0)
        a, block, least, most = a[some], block[some], least[some], most[some]
        low = np.maximum(np.searchsorted(place, (block << 32) + np.minimum(least, 2**32 - 1)), a + 1)  # each pair once
        high = np.searchsorted(place, (block << 32) + np.minimum(most, 2**32 - 1), side="right")
        met = np.maximum(high - low, 0)
        out.append(np.stack([np.repeat(a, met), np.repeat(low, met) + np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met)]))
    pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pairs[:, _fit(e, pairs[0], pairs[1], p.percent)], np.flatnonzero(np.repeat(long, size))


def _lists(p: JaccardParams):
    """From packed entries: candidate pairs of sets, and long lists' entries."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = [(b, x) for f in it for b, x in zip(f["bucket"], f["data"])]
        if not data:
            return
        e = np.concatenate([np.frombuffer(x, _ENTRY) for _, x in data])
        bucket = np.repeat(np.array([b for b, _ in data], np.int64), [len(x) // _ENTRY.itemsize for _, x in data])
        data.clear()
        token = (e["mid"].astype(np.int64) << 32) | e["low"].astype(np.int64)
        order = np.lexsort((e["s1"], e["n"], e["at"], token, bucket))
        e, token, bucket = e[order], token[order], bucket[order]
        new = np.append(True, (token[1:] != token[:-1]) | (bucket[1:] != bucket[:-1]))
        # equal sets of different batches: one entry; they have equal positions
        keep = new | np.append(True, e["s1"][1:] != e["s1"][:-1])
        e, group = e[keep], np.cumsum(new)[keep]
        tag = (bucket[keep] << 48) | token[keep]
        pairs, long = list_pairs(e, group, p)
        a, b = e["s1"][pairs[0]], e["s1"][pairs[1]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        for k in range(0, len(both), 100_000):
            x = both[k : k + 100_000]
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "token": np.int64(0), "n": np.int64(0), "at": np.int64(-1)})
        for k in range(0, len(long), 100_000):
            x = long[k : k + 100_000]
            yield pd.DataFrame({"a": e["s1"][x], "b": np.int64(0), "token": tag[x], "n": e["n"][x].astype(np.int64), "at": e["at"][x].astype(np.int64)})

    return run


def _compared(pairs: DataFrame, texts: DataFrame, p: JaccardParams, what, schema: str) -> DataFrame:
    """what(a, b, x, y) of each pair (a, b) of names, by the sets of their whole
    texts (key, text), where it is not None; a name stands for one text."""
    pairs = written(pairs, "jaccard-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
    ends = written(ends, "jaccard-ends")
    few = ends.count() <= p.broadcast_ids
    ids = ends.select("id")
    need = texts.join(F.broadcast(ids) if few else ids, F.col("key") == F.col("id"), "left_semi").dropDuplicates(["key"])
    need = written(need, "jaccard-texts")
    dealt = pairs
    for c in ("a", "b"):
        dealt = dealt.join(ends.select(F.col("id").alias(c), F.col("k").alias(f"k{c}")), c)
    swap = F.col("kb") > F.col("ka")
    dealt = dealt.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("leaf"), swap.alias("swap"), F.greatest("ka", "kb").alias("k"))
    dealt = written(dealt.select("hub", "leaf", "swap", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("k") / p.block)).cast("int").alias("part")), "jaccard-dealt")
    leaves = dealt.join(need.withColumnRenamed("key", "leaf"), "leaf").select("hub", "part", F.lit(True).alias("leaf_row"), "leaf", "swap", "text")
    hubs = dealt.select("hub", "part").distinct().join(need.withColumnRenamed("key", "hub"), "hub").select("hub", "part", F.lit(False).alias("leaf_row"), F.lit("").alias("leaf"), F.lit(False).alias("swap"), "text")
    met = leaves.unionByName(hubs).repartition(partitions(pairs.sparkSession), "hub", "part").sortWithinPartitions("hub", "part", "leaf_row")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for big in it:
            for at in range(0, big.num_rows, 128):
                out = []
                f = big.slice(at, 128)
                for hub, leaf_row, leaf, swap, text in zip(*(f.column(c).to_pylist() for c in ("hub", "leaf_row", "leaf", "swap", "text"))):
                    own = shingles(text, p.shingle)
                    if not leaf_row:  # comes before its leaves
                        x = own
                        continue
                    r = what(leaf, hub, own, x) if swap else what(hub, leaf, x, own)
                    if r is not None:
                        out.append(r)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
        _words.clear()
        release_memory()

    return met.mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, p: JaccardParams) -> DataFrame:
    """pairs (a, b) of names -> those linked, by their whole texts (key, text)."""

    def near(a: str, b: str, x: np.ndarray, y: np.ndarray):
        return (a, b) if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), p.percent) else None

    return _compared(pairs, texts, p, near, "a string, b string")


@dataclass(frozen=True)
class _Found:
    """ids: id and text's name (key) of each row. texts: key, text. rows: key,
    n, s1, s2. classes: s1, s2, rep. pairs (a, b) of representatives to compare
    at once, and (a, token, n, at) of long lists."""

    ids: DataFrame
    texts: DataFrame
    rows: DataFrame
    classes: DataFrame
    pairs: DataFrame
    long: DataFrame


def _search(docs: DataFrame, p: JaccardParams, key: str, text: str) -> _Found:
    spark = docs.sparkSession
    small_batches(spark)
    ids = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    few = ids.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))  # texts go by name, since ids may be null or used again
    named_ids = written(few.select("id", "key"), "jaccard-ids", keep=True)
    n_parts = partitions(spark)
    buckets = 4 * n_parts
    # of equal texts the one of the smallest id is read; ids of several texts and null ones are all read
    texts_of = named_ids.where("id is not null").groupBy("id").agg(F.min("key").alias("key"), F.max("key").alias("key2")).where("key = key2")
    first = written(texts_of.groupBy("key").agg(F.min("id").alias("rep")), "jaccard-first")  # apart, so that the join can split a hot text
    same = written(texts_of.join(first, "key").where("id <> rep").select("id"), "jaccard-same")
    small = same.count() <= p.broadcast_ids
    one = few.join(F.broadcast(same) if small else same, "id", "left_anti").select("key", "text")
    # documents and counts go through one exchange; only frequent elements come out of it
    mixed = one.mapInArrow(_describe(p, buckets), "bucket long, doc boolean, key string, n long, s1 long, s2 long, data binary").repartition(n_parts, "bucket")
    seen = written(mixed.mapInPandas(_count(p), "doc boolean, key string, n long, s1 long, s2 long, token long, count long"), "jaccard-sets")
    rows = seen.where("doc").select("key", "n", "s1", "s2").distinct()
    hot = seen.where("not doc").orderBy(F.desc("count"), "token").select("token", "count").limit(p.frequent).toPandas()  # a bounded table
    tokens = hot["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], hot["count"].to_numpy(np.int32)[order]))
    # equal sets are one class, named by its smallest text's name (s1 alone only steers the search)
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("key").alias("rep"))
    packed = one.mapInArrow(_prefixes(p, frequent, buckets, buckets), "bucket long, data binary").repartition(n_parts, "bucket")
    lists = written(packed.mapInPandas(_lists(p), "a long, b long, token long, n long, at long"), "jaccard-lists")

    name = classes.select("s1", "rep")
    def named(df: DataFrame, column: str) -> DataFrame:  # noqa: E306
        return df.join(name.select(F.col("s1").alias(column), F.col("rep").alias(f"{column}_")), column).drop(column).withColumnRenamed(f"{column}_", column)

    pairs = _ordered(named(named(lists.where("at < 0").select("a", "b").distinct(), "a"), "b"))
    long = named(lists.where("at >= 0").select("a", "token", "n", "at"), "a")
    return _Found(named_ids, few.select("key", "text"), rows, classes, pairs, long)


def similar_components(docs: DataFrame, params: JaccardParams = JaccardParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of each row; of the links only those that
    components need are computed."""
    with steps(docs.sparkSession):
        f = _search(docs, params, key, text)
        found = _components(f, params)
    # only here do ids come in: a component's name is its smallest one
    smallest = found.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    out = f.ids.join(found.drop("id").join(smallest, "component", "left"), "key")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def representatives(docs: DataFrame, params: JaccardParams = JaccardParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component, that of the smallest id (null last),
    then of the smallest MD5 of the text, then of the smallest hash of the row;
    rows without words are components of their own and all stay."""
    with steps(docs.sparkSession):
        f = _search(docs, params, key, text)
        found = _components(f, params)
    found = found.where("component is not null").select("key", "component")
    best = f.ids.join(found, "key").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("x")).select(F.col("x.id").alias("i"), F.col("x.key").alias("k"))
    times = f.ids.groupBy(F.col("id").alias("i2"), F.col("key").alias("k2")).agg(F.count("*").alias("times"))
    best = written(best.join(times, (F.col("k") == F.col("k2")) & F.col("i").eqNullSafe(F.col("i2"))).select("i", "k", "times"), "jaccard-kept")
    words = F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{key}`").cast("long").alias("id"), F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("key"), words.alias("words"))
    here = (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i"))
    out = rows.where("not words").select("row").unionByName(rows.where("words").join(best.where("times = 1"), here, "left_semi").select("row"))
    repeated = best.where("times > 1")
    if not repeated.isEmpty():
        same = rows.where("words").join(repeated, here, "left_semi").groupBy("id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.unionByName(same.select("row"))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _components(f: _Found, p: JaccardParams) -> DataFrame:
    """key, n, component (null without words) and smallest id of each text."""
    edges = verified(f.pairs, f.texts, p)
    parts = connected(edges)
    long = f.long.join(parts.select(F.col("node").alias("a"), "component"), "a", "left")
    long = written(long.select("a", "token", "n", "at", F.coalesce("component", "a").alias("c")), "jaccard-long")
    again = written(_ordered(_across(long, p)), "jaccard-across")
    if not again.isEmpty():
        more = verified(again, f.texts, p)
        parts = connected(more.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    parts = parts.withColumnRenamed("node", "rep")
    whole = f.classes.join(parts, "rep", "left").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.coalesce("component", "rep").alias("component"))
    least = f.ids.where("id is not null").groupBy("key").agg(F.min("id").alias("id"))
    found = f.rows.join(whole, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n") > 0), "left").join(least, "key", "left")
    return written(found.select("key", "n", "component", "id"), "jaccard-found", keep=True)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _across(long: DataFrame, p: JaccardParams) -> DataFrame:
    """Pairs of one long list that lie in different components and pass the
    bound. One side is always outside the list's largest component; the other
    is dealt into parts of about `block` sets, each of which it meets."""
    by = long.groupBy("token", "c").agg(F.count("*").alias("k"))
    main = by.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("size")).where("parts > 1")
    main = written(main.select("token", "main", F.ceil(F.col("size") / p.block).cast("int").alias("blocks")), "jaccard-mixed")
    some = written(long.join(main, "token").withColumn("in_main", F.col("c") == F.col("main")).drop("main"), "jaccard-some")
    x = some.where("not in_main").select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a"), F.col("n").alias("m"), F.col("at").alias("i"), F.col("c").alias("ca"))
    y = some.select(F.col("token").alias("t"), F.pmod(F.xxhash64("a"), "blocks").cast("int").alias("own"), F.col("a").alias("b"), F.col("n").alias("n"), F.col("at").alias("j"), F.col("c").alias("cb"), "in_main")
    left = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"))
    fit = 100 * left >= p.percent * (F.col("m") + F.col("n") - left)
    return x.join(y, (F.col("token") == F.col("t")) & (F.col("block") == F.col("own")) & (F.col("ca") != F.col("cb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & fit).select("a", "b").distinct()


def class_links(docs: DataFrame, params: JaccardParams = JaccardParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every pair a < b of linked classes, named by their smallest ids. A class
    without an id has no name, so its pairs are not among these."""
    f = _search(docs, params, key, text)
    single, groups = _links(f, params)
    both = single.unionByName(_grouped(groups, params, True))
    ids = _class_of_rows(f).where("id is not null").groupBy("rep").agg(F.min("id").alias("id"))
    for c in ("a", "b"):
        both = both.join(ids.select(F.col("rep").alias(c), F.col("id").alias(f"id_{c}")), c)
    return both.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).where("a <> b").distinct()


def link_counts(docs: DataFrame, params: JaccardParams = JaccardParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and n_links of each row: how many other rows its text is
    linked with, equal ones included. No pair of a leader's followers is a row."""
    f = _search(docs, params, key, text)
    single, groups = _links(f, params)
    of_rows = written(_class_of_rows(f), "jaccard-rows")
    weight = written(of_rows.where("rep is not null").groupBy("rep").agg(F.count("*").alias("w")), "jaccard-weights")
    ends = single.select("a", "b").unionByName(single.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(weight.select(F.col("rep").alias("b"), "w"), "b").groupBy("a").agg(F.sum("w").alias("k"))
    inner = _grouped(groups.join(weight.withColumnRenamed("rep", "a"), "a"), params, False)
    k = ends.unionByName(inner).groupBy("a").agg(F.sum("k").alias("k"))
    n = weight.join(k.withColumnRenamed("a", "rep"), "rep", "left").select("rep", (F.col("w") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"))
    return of_rows.join(n, "rep", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _class_of_rows(f: _Found) -> DataFrame:
    """id, n and class (rep) of each row; an empty set has no class."""
    whole = f.classes.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), "rep")
    named = f.rows.join(whole, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n") > 0), "left").select("key", "n", "rep")
    return f.ids.join(named, "key").select("id", "n", "rep")


def _links(f: _Found, p: JaccardParams) -> tuple[DataFrame, DataFrame]:
    """Linked pairs (a, b) of classes that do not follow the same leader, and
    for each follower (a) its leader and the difference of the two sets."""
    tried = written(f.pairs, "jaccard-tried")
    edges = written(verified(tried, f.texts, p), "jaccard-edges")
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.groupBy("a").agg(F.count("*").alias("deg"))
    best = ends.join(degree.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max(F.struct("deg", "b")).alias("x")).join(degree, "a")
    # the best linked of a class and its neighbours leads it
    leads = written(best.select("a", F.when(F.col("x.deg") > F.col("deg"), F.col("x.b")).when((F.col("x.deg") == F.col("deg")) & (F.col("x.b") > F.col("a")), F.col("x.b")).otherwise(F.col("a")).alias("lead")), "jaccard-leads")

    def differ(a: str, b: str, x: np.ndarray, y: np.ndarray):
        d = np.setxor1d(x, y, assume_unique=True)
        return a, b, len(x), len(y), (len(d) + len(y) - len(x)) // 2, d.tobytes()

    groups = written(_compared(leads.select("a", F.col("lead").alias("b")), f.texts, p, differ, "a string, lead string, n long, l long, miss long, d binary"), "jaccard-followers")

    def led(df: DataFrame, column: str) -> DataFrame:
        return df.join(leads.select(F.col("a").alias(column), F.col("lead").alias(f"{column}_lead")), column, "left").withColumn(f"{column}_lead", F.coalesce(f"{column}_lead", column))

    long = written(led(f.long, "a").withColumnRenamed("a_lead", "c"), "jaccard-long")
    rest = _across(long, p)
    rest = _ordered(rest).join(tried, ["a", "b"], "left_anti")
    apart = led(led(edges, "a"), "b").where("a_lead <> b_lead").select("a", "b")
    return written(apart.unionByName(verified(rest, f.texts, p)), "jaccard-links"), groups


def _grouped(groups: DataFrame, p: JaccardParams, pairs: bool) -> DataFrame:
    """The answers of each leader's followers among themselves, exactly, from
    their differences: of l elements of the leader, two sets share those that
    neither lacks, and those that both have besides. Pairs (a, b), or (a, k) with
    the weights w of a's partners summed. Blocks of followers meet in turn."""
    sizes = groups.groupBy("lead").agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks")).where("blocks > 0")
    some = groups.join(sizes, "lead").withColumn("own", F.pmod(F.xxhash64("a"), "blocks").cast("int"))
    some = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        x = g[g["own"] == i].sort_values("a")
        y = x if i == j else g[g["own"] == j].sort_values("a")
        n, m = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None]
        common = int(g["l"].iloc[0]) - x["miss"].to_numpy()[:, None] - y["miss"].to_numpy()[None] + _shared(list(x["d"]), list(y["d"])) if len(x) and len(y) else np.zeros((len(x), len(y)), np.int64)
        ok = linked(common, n, m, p.percent)
        if i == j:
            np.fill_diagonal(ok, False)
        if pairs:
            u, v = np.nonzero(np.triu(ok) if i == j else ok)
            return pd.DataFrame({"a": x["a"].to_numpy()[u], "b": y["a"].to_numpy()[v]})
        k = pd.DataFrame({"a": x["a"], "k": ok @ y["w"].to_numpy()})
        return k if i == j else pd.concat([k, pd.DataFrame({"a": y["a"], "k": x["w"].to_numpy() @ ok})])

    return some.groupBy("lead", "i", "j").applyInPandas(run, "a string, b string" if pairs else "a string, k long")


def _shared(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """How many elements each of x has in common with each of y, by products of
    0/1 matrices over the elements that both sides hold."""
    sides = []
    for d in (x, y):
        sides.append((np.frombuffer(b"".join(d), np.uint64), np.repeat(np.arange(len(d)), [len(b) // 8 for b in d])))
    both = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(x), len(y)), np.int64)
    kept = []
    for e, row in sides:
        at = np.minimum(np.searchsorted(both, e), max(0, len(both) - 1))
        hit = both[at] == e if len(both) else np.zeros(len(e), bool)
        at, row = at[hit], row[hit]
        order = np.argsort(at, kind="stable")
        kept.append((at[order], row[order]))
    for k in range(0, len(both), 2048):
        parts = []
        for (at, row), d in zip(kept, (x, y)):
            a, b = np.searchsorted(at, [k, k + 2048])
            z = np.zeros((len(d), 2048), np.float32)
            z[row[a:b], at[a:b] - k] = 1
            parts.append(z)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out
