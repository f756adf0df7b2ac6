"""Exact top-k search: Fagin's threshold algorithm over blocks of sorted lists.

Vectors are integers. Rows that resemble each other are dealt into one cell (by
the nearest of a bounded sample of rows, which steers the order of work only),
and a cell into blocks of about `block` rows. A block holds one sorted list per
dimension and is written once to the shared folder; its index row has the ends
of its lists. A task searches for a group of queries of one cell: it takes the
blocks by the bound that the ends of their lists allow, its own cell's first,
and reads those only whose bound can still reach a query's k-th score. Within a
block the lists are read from the end that the query's component favours, the
same number of entries further in each round; candidates met for the first time
are scored whole by random access. Reading stops when the bound, the sum over
lists of the query's component times the last value read, lies below the k-th
score so far, which is carried on from block to block. (A bound equal to it could
still hide a tie of smaller id, unless the block has no smaller id.)

Every row is shuffled once, and queries once more; a query's whole answer comes
out of one task, so nothing is merged. What is read from the shared folder is at
worst every block for every group of `queries` queries; how much less depends on
how the data cluster. No task holds more than a group of queries, a block, and
`chunk` rows of the index.

Vectors that are null, or hold null or non-finite components, take no part, nor
do rows without id. Repeated rows, and rows that share an id, are candidates and
queries of their own; only a query's own row is none of its candidates. Vectors
of different length do not meet; empty ones score 0. Ties go to the smaller id.
Scores that no long can hold rank as they are and come out as the nearest long.
Extra columns are ignored.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, partitions, written


@dataclass(frozen=True)
class TopKParams:
    """pivots: rows that cells form around, at most; depth: entries of each list
    in the first round, then twice as many each time."""

    k: int = 5
    every: int = 50
    scale: int = 256
    block: int = 2048
    queries: int = 1024
    pivots: int = 1024
    depth: int = 4
    chunk: int = 4096


def integers(vector: F.Column, scale: int) -> F.Column:
    """floor(scale * x) of each component, or null if one is null or not finite."""
    good = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def exact(*arrays: np.ndarray) -> bool:
    """Whether inner products of these (two) sets of vectors are exact in doubles."""
    a, b = (np.abs(x).max(initial=0) for x in arrays)
    return float(a) * float(b) * max(1, arrays[0].shape[1]) < 2**52


class Block:
    """Vectors with one sorted list (of their places) per dimension."""

    def __init__(self, ids: np.ndarray, tags: np.ndarray, X: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.tags, self.X = ids, tags, X
        self.order = np.argsort(X, axis=0, kind="stable").T.astype(np.int32) if order is None else order
        self.value = np.take_along_axis(X.T, self.order, 1)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, tags=self.tags, X=self.X, order=self.order)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Block:
        z = np.load(io.BytesIO(data))
        return cls(z["ids"], z["tags"], z["X"], z["order"])


class Best:
    """The k best (score, id) of one query so far, and how many were scored."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.scored = k, np.zeros(0, object), np.zeros(0, np.int64), 0

    def full(self) -> bool:
        return len(self.scores) >= self.k

    def beaten(self, bound, least_id: int) -> bool:
        """Whether nothing of this bound, and of no smaller id, can enter."""
        return self.full() and (bound < self.scores[-1] or bound == self.scores[-1] and least_id > self.ids[-1])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scored += len(scores)
        if self.full():
            some = scores >= self.scores[-1]
            scores, ids = scores[some], ids[some]
        s, i = np.concatenate([self.scores.astype(scores.dtype), scores]), np.concatenate([self.ids, ids])
        if len(s) > self.k and s.dtype != object:  # only what reaches the k-th score is sorted
            some = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, i = s[some], i[some]
        top = (np.lexsort((i, -s)) if s.dtype != object else np.array(sorted(range(len(s)), key=lambda z: (-s[z], i[z])), int))[: self.k]
        self.scores, self.ids = s[top], i[top]


def threshold_search(block: Block, q: np.ndarray, own: int, best: Best, depth: int, safe: bool) -> None:
    """Bring the block's candidates for query q (of the tag own) into best."""
    X, order, value = block.X, block.order, block.value
    n, least = len(block.ids), int(block.ids.min(initial=0))
    kind = np.float64 if safe else object
    q = q.astype(kind)
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    seen, at, step = np.zeros(n, bool), 0, depth
    while at < n:
        to = min(n, at + step)
        fresh = np.zeros(n, bool)
        if len(up) + len(down):
            fresh[order[up, n - to : n - at]] = True
            fresh[order[down, at:to]] = True
        else:
            fresh[at:to] = True
        fresh &= ~seen
        seen |= fresh
        new = np.flatnonzero(fresh)
        new = new[block.tags[new] != own]
        if len(new):
            best.add(X[new].astype(kind) @ q, block.ids[new])
        if seen.all():
            return
        at, step = to, step * 2
        if len(up) + len(down) and best.beaten(q[up] @ value[up, n - to].astype(kind) + q[down] @ value[down, to - 1].astype(kind), least):
            return


def _vectors(f: pd.DataFrame) -> np.ndarray:
    return np.array(f["v"].tolist(), np.int64).reshape(len(f), -1)


def _cells(pivots: dict[int, np.ndarray]):
    """Adds to each row the nearest pivot of its dimension."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in it:
            cell = np.zeros(len(f), np.int32)
            for dim in f["dim"].unique():
                P, rows = pivots.get(int(dim)), np.flatnonzero(f["dim"] == dim)
                if P is not None and dim:
                    X = _vectors(f.iloc[rows]).astype(float)
                    cell[rows] = (2 * X @ P.T - (P * P).sum(1)).argmax(1)
            yield f.assign(cell=cell)

    return run


def _store(directory: str):
    """Rows sorted by dim, cell and part -> blocks in a file of the task, and
    their index. Files are named by attempt; the index names those that count."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(directory)
        store.create_dir(root, recursive=True)
        name, out, offset, rows, held, key = f"{root}/{uuid.uuid4().hex}", None, 0, [], [], None

        def close() -> None:
            nonlocal out, offset, held
            f = pd.concat(held)
            held = []
            block = Block(f["id"].to_numpy(np.int64), f["tag"].to_numpy(np.int64), _vectors(f))
            data = block.dump()
            if out is None:
                out = store.open_output_stream(name, compression=None)
            out.write(data)
            rows.append((*key[:2], name, offset, len(data), len(f), int(block.ids.min()), block.X.min(0).tolist(), block.X.max(0).tolist()))
            offset += len(data)

        for f in it:
            for k, g in f.groupby(["dim", "cell", "part"], sort=True):
                if held and k != key:
                    close()
                key = tuple(map(int, k))
                held.append(g)
        if held:
            close()
        if out is not None:
            out.close()
        yield pd.DataFrame(rows, columns=["dim", "cell", "file", "offset", "length", "n", "least", "low", "high"])

    return run


def _index(path: str, dim: int, chunk: int) -> Iterator[pd.DataFrame]:
    """Index rows of one dimension, at most `chunk` at once."""
    store, root = fs.FileSystem.from_uri(path)
    for info in store.get_file_info(fs.FileSelector(root)):
        if info.size and info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=chunk):
                    g = b.to_pandas()
                    if (g["dim"] == dim).any():
                        yield g[g["dim"] == dim]


def _search(directory: str, index: str, p: TopKParams):
    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        store, _ = fs.FileSystem.from_uri(directory)
        dim, cell, Q = int(key[0]), int(key[1]), _vectors(f)
        own, best = f["tag"].to_numpy(np.int64), [Best(p.k) for _ in range(len(f))]
        met = 0
        for g in _index(index, dim, p.chunk):
            low, high = (np.array(g[c].tolist(), np.int64).reshape(len(g), -1) for c in ("low", "high"))
            met += int(g["n"].sum())
            safe = exact(Q, np.concatenate([low, high]))
            kind = np.float64 if safe else object
            P, N = np.maximum(Q, 0).astype(kind), np.minimum(Q, 0).astype(kind)
            bound = P @ high.T.astype(kind) + N @ low.T.astype(kind)
            order = sorted(range(len(g)), key=lambda b: (g["cell"].iat[b] != cell, -bound[:, b].max(initial=0)))
            for b in order:
                live = [i for i in range(len(Q)) if not best[i].beaten(bound[i, b], int(g["least"].iat[b]))]
                if live:
                    with store.open_input_file(g["file"].iat[b]) as h:
                        h.seek(int(g["offset"].iat[b]))
                        block = Block.load(h.read(int(g["length"].iat[b])))
                    for i in live:
                        threshold_search(block, Q[i], own[i], best[i], p.depth, safe)
        rows = [(q, r, int(i), max(-(2**63), min(2**63 - 1, int(s))), x.scored, met) for q, x in zip(f["id"], best) for r, (s, i) in enumerate(zip(x.scores, x.ids), 1)]
        return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score", "scored", "candidates"])

    return run


def top_k(df: DataFrame, params: TopKParams = TopKParams(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by
    `every`, the k rows of the highest integer inner product with it; and how
    many of its candidates were scored."""
    p, spark = params, df.sparkSession
    v = df.select(F.col(f"`{key}`").cast("long").alias("id"), integers(F.col(f"`{vector}`"), p.scale).alias("v")).where("id is not null and v is not null")
    v = written(v.select("id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("tag")), "topk-vectors")
    few = v.orderBy(F.xxhash64("id", "v", "tag")).limit(min(p.pivots, 1 + v.count() // p.block)).collect()
    pivots = {d: np.array([r["v"] for r in few if r["dim"] == d], float).reshape(-1, d) for d in {r["dim"] for r in few}}
    placed = written(v.mapInPandas(_cells(pivots), "id long, v array<bigint>, dim int, tag long, cell int"), "topk-cells")
    query = F.col("id") % p.every == 0
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / p.block).alias("parts"), F.ceil(F.count_if(query) / p.queries).alias("groups"))
    both = placed.join(sizes, ["dim", "cell"])
    deal = lambda n: F.pmod(F.xxhash64("tag"), n).cast("int").alias("part")
    blocks = both.select("id", "v", "dim", "tag", "cell", deal(F.col("parts"))).repartition(partitions(spark), "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part")
    directory, at = (x if "://" in x or x.startswith("file:") else f"file://{x}" for x in (fresh_dir(spark, "topk-blocks"), fresh_dir(spark, "topk-index")))
    blocks.mapInPandas(_store(directory), "dim int, cell int, file string, offset long, length long, n long, least long, low array<bigint>, high array<bigint>").write.parquet(at)
    queries = both.where(query).select("id", "v", "tag", "dim", "cell", deal(F.col("groups")))
    # dealt by number, as these small rows stand for much work and must not be coalesced
    queries = queries.repartition(partitions(spark), "dim", "cell", "part")
    return queries.groupBy("dim", "cell", "part").applyInPandas(_search(directory, at, p), "query_id long, rank int, vec_id long, score long, scored long, candidates long")
