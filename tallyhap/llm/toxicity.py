"""Toxicity: a convolutional text classifier over hashed words.

The model is trained in numpy on all labelled rows, of texts of any length, and
scores every whole text. Inputs of a score are the words of the text alone;
language only selects which calibrated threshold applies to the finished score.
The labelled rows have three parts, dealt by a hash of their id: eight tenths
are learned from, one tenth calibrates the score, and on the last tenth the
thresholds by language are set; a class too small for that is in all parts.

Learning starts on the driver with those rows of the first part that have the
lowest hashes. Where there are more, tasks go on from there over all rows of the
part, a shard each in an order of its own, and after each pass every parameter
moves by the mean of the shards that moved it. Calibration and thresholds come
from counts over all rows of their part. Labelled texts are written once to the
shared folder, and a pass shuffles those that are learned from; other texts are
left out beforehand by a bit set of the labelled ids.

Nulls: a null text counts as empty, and the empty text has a score (that of no
words). Labels of null, or of documents that do not exist, are not learned
from; a doc_id labelled twice counts once, as toxic if any of its labels says
so; of several texts of one doc_id the smallest is learned from.
Where the labelled texts are of one class only, or none, every score is the
smoothed toxic share (0.1 without labels). Repeated rows are scored as often as
they occur. Extra columns are kept by `with_toxicity`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory, small_batches, steps, written
from .textcnn import TextCNN, calibrate, probability

#: ASCII letters in lower case; other ASCII bytes part words; the rest of UTF-8 stays.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CACHE_WORDS = 150_000
#: Bits of the set of labelled ids at most, and floats of a piece of parameters.
_MOST_BITS = 1 << 24
_PIECE = 1 << 15
#: A step of learning ends at so many words, if its texts are long.
_STEP_WORDS = 300_000


@dataclass(frozen=True)
class ToxicityParams:
    """buckets: of hashed words. sample_toxic, sample_clean: labelled rows of
    either class that learning starts with at most, for so many epochs; passes:
    over all rows of the first part, where it has more, in shards of shard_rows
    or, of many rows, most_shards shards. threshold: of `predicted`, and of
    languages with fewer than min_toxic toxic rows in the part that thresholds
    are set on."""

    buckets: int = 1 << 15
    sample_toxic: int = 1500
    sample_clean: int = 3000
    epochs: int = 8
    passes: int = 2
    shard_rows: int = 8000
    most_shards: int = 64
    threshold: float = 0.3
    min_toxic: int = 20
    seed: int = 7


@dataclass
class ToxicityModel:
    cnn: TextCNN
    platt: tuple[float, float]
    params: ToxicityParams
    thresholds: dict[str, float] = field(default_factory=dict)
    _ids: dict[bytes, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ids": {}, "_table": None}

    def word_symbols(self, word: bytes) -> tuple[int, ...]:
        """Of the word and of its beginnings, so that related words share."""
        return tuple(1 + xxhash.xxh3_64_intdigest(part, seed) % (self.params.buckets - 1) for seed, part in enumerate((word, word[:4], word[:5])))

    def forget(self) -> None:
        """Let go of the words seen so far."""
        self._ids, self._table = {}, None

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()

    def symbols(self, text: str | None) -> np.ndarray:
        return np.array([self.word_symbols(w) for w in self.words(text)], np.int64).reshape(-1, 3)

    def reader(self):
        """`symbols` for many texts: words met before are not hashed again."""
        ids, table = {}, np.zeros((1 << 14, 3), np.int64)

        def read(text: str | None) -> np.ndarray:
            nonlocal ids, table
            if len(ids) > _CACHE_WORDS:
                ids = {}
            words = self.words(text)
            new = [w for w in dict.fromkeys(words) if w not in ids]
            if new:
                used = len(ids)
                if used + len(new) > len(table):
                    table = np.concatenate([table[:used], np.zeros((used + 2 * len(new), 3), np.int64)])
                table[used : used + len(new)] = [self.word_symbols(w) for w in new]
                ids.update(zip(new, range(used, used + len(new))))
            return table[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))]

        return read

    def rows(self, text: str | None) -> np.ndarray:
        """The text's words as rows of a table that holds each word's embedding
        once; new words are appended."""
        words, ids = self.words(text), self._ids
        new = [w for w in dict.fromkeys(words) if w not in ids] if ids else list(dict.fromkeys(words))
        if new:
            used = 1 + len(ids)
            if self._table is None or used + len(new) > len(self._table):
                more = np.zeros((max(1 << 14, 2 * (used + len(new))), self.cnn.dim), np.float32)
                if self._table is not None:
                    more[:used] = self._table[:used]
                self._table = more
            self._table[used : used + len(new)] = self.cnn.embed(np.array([self.word_symbols(w) for w in new], np.int64))
            ids.update(zip(new, range(used, used + len(new))))
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def logits(self, texts) -> np.ndarray:
        """In parts, so that a batch of long texts isn't held as symbols at once."""
        out, part, held = [], [], 0

        def flush() -> None:
            nonlocal part, held
            if part:
                out.append(self.cnn.logits(part, self._table if self._table is not None else self.cnn.E[:1]))
            part, held = [], 0
            if len(self._ids) > _CACHE_WORDS:
                self.forget()

        for t in texts:
            part.append(self.rows(t))
            held += len(part[-1])
            if held > 500_000:
                flush()
        flush()
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts) -> np.ndarray:
        return probability(self.logits(texts), self.platt)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def best_thresholds(scored: DataFrame, least: int) -> dict[str, float]:
    """Of each language with `least` toxic rows of scored (lang, toxic, p) or
    more: the cut of highest F1; of equal ones the middle of the gap. Cells of
    near scores are ranked by their counts, and scores within their cell, so no
    task sorts a whole language."""
    at = scored.where(F.col("lang") != "").groupBy("lang", "p").agg(F.count("*").alias("n"), F.sum("toxic").alias("hit"))
    at = written(at.withColumn("cell", F.floor(256 * F.log(F.col("p") / (1 - F.col("p"))))), "toxicity-scores")
    down, inside = Window.partitionBy("lang").orderBy(F.desc("cell")), Window.partitionBy("lang", "cell").orderBy(F.desc("p"))
    cells = at.groupBy("lang", "cell").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.max("p").alias("top"))
    cells = cells.select(
        "lang", "cell", (F.sum("n").over(down) - F.col("n")).alias("n0"), (F.sum("hit").over(down) - F.col("hit")).alias("hit0"),
        F.lead("top").over(down).alias("below"), F.sum("hit").over(Window.partitionBy("lang")).alias("toxic"),
    ).where(F.col("toxic") >= least)
    f1 = 2 * (F.col("hit0") + F.sum("hit").over(inside)) / (F.col("n0") + F.sum("n").over(inside) + F.col("toxic"))
    cuts = at.join(cells, ["lang", "cell"]).select("lang", f1.alias("f1"), "p", F.coalesce(F.lead("p").over(inside), "below", F.lit(0.0)).alias("next"))
    best = cuts.groupBy("lang").agg(F.max(F.struct("f1", "p", "next")).alias("best"))
    return {r["lang"]: (r["best"]["p"] + r["best"]["next"]) / 2 for r in best.collect()}


def train(documents: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), learn_from: Column | None = None) -> ToxicityModel:
    """Fit, calibrate and set thresholds from `labels` (doc_id, toxic) and the
    texts of `documents` (doc_id, text, lang). learn_from: which doc_id may be
    learned from; by default those that `held_out` leaves."""
    may = ~held_out(F.col("doc_id")) if learn_from is None else learn_from
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & may)
    model = ToxicityModel(TextCNN(params.buckets, seed=params.seed), (0.0, 0.0), params)
    small_batches(documents.sparkSession)
    with steps(documents.sparkSession):
        known = written(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxicity-labels")
        counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        return fit(model, written(labelled(documents, known, sum(counts.values())), "toxicity-texts"), counts)


def labelled(documents: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """doc_id, toxic, text, lang and part (0, 1 or 2) of each id of known (n
    rows) that has a document."""
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    bits = min(_MOST_BITS, 1 << max(10, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(bits))
    words = known.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("set"))
    found, table = np.zeros(bits // 64, np.int64), words.toArrow()  # no more than _MOST_BITS / 64 rows
    found[table["word"].to_numpy()] = table["set"].to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(found)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("place").to_numpy()
            yield b.filter(pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool)))

    texts = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"), place.alias("place"))
    texts = texts.mapInArrow(keep, texts.schema).drop("place")
    rows = texts.join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("t"))
    tenth = F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(10))
    return rows.select("doc_id", "toxic", "t.text", "t.lang", F.greatest(tenth - 7, F.lit(0)).cast("int").alias("part"))


def fit(model: ToxicityModel, rows: DataFrame, counts: dict[int, int]) -> ToxicityModel:
    """rows: of `labelled`. counts: labelled rows of either class in all, which
    weigh those that calibrate."""
    params, spark = model.params, rows.sparkSession
    have = {(r["toxic"], r["part"]): r["n"] for r in rows.groupBy("toxic", "part").agg(F.count("*").alias("n")).collect()}
    if len({k for k, _ in have}) < 2:  # nothing to tell apart: every score is the toxic share
        share = (counts.get(1, 0) + 0.1) / (sum(counts.values()) + 1)
        model.platt = 0.0, float(np.log(share / (1 - share)))
        return model
    short = [k for k in (0, 1) if any((k, part) not in have for part in range(3))]
    learn, fine, last = (rows.where((F.col("part") == k) | F.col("toxic").isin(short)) for k in range(3))

    # at most sample_toxic + sample_clean ids, so a broadcast is bounded
    lowest = [learn.where(F.col("toxic") == k).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, params.sample_toxic), (0, params.sample_clean))]
    found = []
    for r in learn.join(F.broadcast(lowest[0].unionByName(lowest[1])), "doc_id").select("doc_id", "toxic", "text").toLocalIterator():  # texts become symbols a partition at a time
        found.append((r["doc_id"], float(r["toxic"]), model.symbols(r["text"]).astype(np.int32)))
    found.sort(key=lambda r: r[0])
    squares = model.cnn.squares()
    model.cnn.fit([r[2] for r in found], np.array([r[1] for r in found]), epochs=params.epochs, squares=squares)
    n = sum(c for (k, part), c in have.items() if part == 0 or k in short)
    for k in range(params.passes if n > len(found) else 0):
        learn_pass(model, squares, learn, n, k)

    cell = F.round(1024 * score_column(model, F.col("text"), spark, raw=True))
    cells = fine.select("toxic", cell.alias("cell")).groupBy("toxic", "cell").agg(F.count("*").alias("n")).orderBy("cell", "toxic").collect()
    x, y, weight = np.array([(r["cell"] / 1024, r["toxic"], r["n"]) for r in cells]).T
    for k in (0, 1):
        weight[y == k] *= counts[k] / weight[y == k].sum()
    a, b = calibrate(x, y, weight * sum(r["n"] for r in cells) / weight.sum())
    # a few rows may say that a higher logit is less toxic; then the share alone is known, and the ranking stays
    model.platt = (a, b) if a > 0 else (1e-3, float(np.log((counts.get(1, 0) + 0.1) / (counts.get(0, 0) + 1))))
    model.thresholds = best_thresholds(last.select("lang", "toxic", score_column(model, F.col("text"), spark).alias("p")), params.min_toxic)
    return model


def learn_pass(model: ToxicityModel, squares: dict[str, np.ndarray], rows: DataFrame, n: int, k: int) -> None:
    """Pass k over all n rows, whose shards and order depend on their ids alone.
    What a shard moved is averaged by tasks, a piece of the parameters each."""
    params, context = model.params, rows.sparkSession.sparkContext
    shards = min(params.most_shards, -(-n // params.shard_rows))
    start = context.broadcast((model, squares))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (r for b in batches for at in range(0, len(b), 64) for r in zip(*(c.to_pylist() for c in b.slice(at, 64).columns)))
        first, before = start.value[0], start.value[0].cnn.state(start.value[1])
        for shard, own in groupby(texts, key=lambda r: r[0]):
            cnn, grown = first.cnn.copied(), {name: g.copy() for name, g in start.value[1].items()}
            symbols, step, held = first.reader(), [], 0
            for _, toxic, text in own:
                step.append((symbols(text), toxic))
                held += len(step[-1][0])
                if len(step) == 32 or held > _STEP_WORDS:
                    cnn.step(*zip(*step), grown)
                    step, held = [], 0
            if step:
                cnn.step(*zip(*step), grown)
            moved = cnn.state(grown) - before
            for piece, at in enumerate(range(0, len(moved), _PIECE)):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "piece": pa.array([piece], pa.int32()), "moved": pa.array([moved[at : at + _PIECE].tobytes()], pa.binary())})
        release_memory()

    def average(piece: pa.Table) -> pa.Table:
        moved = np.stack([np.frombuffer(x, np.float32) for x in piece.sort_by("shard")["moved"].to_pylist()]).astype(float)
        mean = moved.sum(0) / np.maximum((moved != 0).sum(0), 1)
        return pa.table({"piece": piece["piece"].slice(0, 1), "moved": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    place = [F.xxhash64("doc_id", F.lit(k)), F.xxhash64(F.lit(k), "doc_id")]
    dealt = rows.select(F.pmod(place[0], F.lit(shards)).cast("int").alias("shard"), place[1].alias("place"), "doc_id", "toxic", "text")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "doc_id").select("shard", "toxic", "text")
    moved = dealt.mapInArrow(learn, "shard int, piece int, moved binary").groupBy("piece").applyInArrow(average, "piece int, moved binary")
    pieces = sorted((r["piece"], bytes(r["moved"])) for r in moved.collect())
    model.cnn.load(squares, model.cnn.state(squares) + np.concatenate([np.frombuffer(x, np.float32) for _, x in pieces]))
    start.unpersist()


def score_column(model: ToxicityModel, text: Column, spark, raw: bool = False) -> Column:
    """raw: logits before calibration."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:  # a few become Python strings at a time
            parts = [(own.logits if raw else own.scores)(texts.slice(k, 256).to_pylist()) for k in range(0, len(texts), 256)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        own.forget()
        release_memory()

    return score(text)


def lang_threshold(model: ToxicityModel, lang: Column) -> Column:
    """The threshold of a row's language, from those with min_toxic toxic rows."""
    default = F.lit(model.params.threshold)
    if not model.thresholds:
        return default
    pairs = [F.lit(x) for kv in sorted(model.thresholds.items()) for x in kv]
    return F.coalesce(F.create_map(*pairs)[lang], default)


def with_toxicity(documents: DataFrame, model: ToxicityModel, score: str = "score", text: str = "text") -> DataFrame:
    """documents and a column `score`; one of that name is replaced."""
    return documents.withColumn(score, score_column(model, F.col(f"`{text}`").cast("string"), documents.sparkSession))
