"""The pipeline against its stages' brute-force versions."""

import random

from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_operators import brute_components, brute_contamination

from tallyhap.llm import decontaminate, mixing, secrets, toxicity


def test_run_by_brute_force(spark):
    """run()'s rows from plain steps over Python lists; only the fitted models
    are the operators' own."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in cp.run(spark, DATA).collect()}

    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = dict(zip(rows, model.scores([r.text for r in rows.values()])))
    texts = {i: r.text for i, r in rows.items() if scores[i] < model.thresholds.get(r.lang, model.params.threshold)}
    assert 0 < len(texts) <= len(rows)
    texts = {i: texts[i] for i, (_, c) in brute_components(list(texts.items())).items() if i == c}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = dict(zip(texts, brute_contamination(texts.values(), items)))
    clean = {}
    for i, t in texts.items():
        if len(found[i][2]) < 2:
            hit = sorted(brute_hits(t, items))
            words = [m.span() for m in decontaminate._WORD.finditer(t or "")]
            spans = [(a, b) for a, b in decontaminate.runs(decontaminate.np.array(hit, int))]
            for a, b in reversed(spans):
                t = t[: words[a][0]] + t[words[b - 1][1] :]
            clean[i] = t

    frame = spark.createDataFrame(list(clean.items()), "doc_id long, text string")
    spy = secrets.train(frame)
    safe = {}
    for i, t in clean.items():
        for s, e in reversed(secrets.merged(spy.spans(t))) if t is not None else ():
            t = t[:s] + "[SECRET]" + t[e:]
        safe[i] = t
    assert {i: r.text for i, r in got.items()} == safe
    assert not any(secrets.base_spans(t) for t in safe.values() if t)

    size = {i: len((t or "").split(" ")) and len((t or "").encode().split()) for i, t in safe.items()}
    assert {i: r.size for i, r in got.items()} == size and all(0 <= r.taken <= 2 * r.size for r in got.values())
    order = sorted({rows[i].source for i in safe if rows[i].source is not None}) + [None] * any(rows[i].source is None for i in safe)
    totals = [sum(size[i] for i in safe if rows[i].source == s) for s in order]
    want = mixing.targets(totals, [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5 * sum(totals), 2)
    for s, t in zip(order, want):
        taken = sum(got[i].taken for i in safe if rows[i].source == s)
        assert abs(taken - t) <= 8 + 0.02 * t


def brute_hits(text, items, size=8):
    windows = set()
    for _, t in items:
        w = decontaminate.words(t)
        windows |= {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1) if w else 0)}
    w, out = decontaminate.words(text), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                out.update(range(k, k + n))
    return out


def test_stages_bear_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (2, "", "en", "a", 0, "x"), (None, "w " * 50, "en", "a", 100, "x")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 4, name
        assert stage(spark, docs.limit(0), DATA).count() == 0
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_of_repeated_and_unnamed_copies_one_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(None, text, "en", "a", 9), (None, text, "en", "a", 9), (4, text.upper(), "en", "b", 9), (4, text.upper(), "en", "b", 9), (5, text + " more", "en", "b", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in cp.jaccard_stage(spark, docs, DATA).collect()] == [4]
    assert cp.jaccard_stage(spark, docs.where(F.col("doc_id").isNull()), DATA).count() == 1


def test_toxicity_stage_learns_beyond_its_first_sample(spark, tmp_path):
    """A word of labelled rows that are none of the 1,500 toxic ones with the lowest hashes."""
    r = random.Random(41)
    ids = spark.range(8000).withColumnRenamed("id", "doc_id")
    late = {x.doc_id for x in ids.where((F.col("doc_id") % 2 == 1) & ~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()[1500:]}
    held = {x.doc_id for x in ids.where(toxicity.held_out(F.col("doc_id"))).collect()}
    mark = lambda k: "" if k % 2 == 0 else " zorky" if k in late or k in held else " vextar"
    rows = [(k, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(6)) + mark(k), "en", "s", 9) for k in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids.withColumn("toxic", (F.col("doc_id") % 2).cast("int")).write.parquet(f"{tmp_path}/labels.parquet")
    kept = {x.doc_id for x in cp.toxicity_stage(spark, docs, str(tmp_path)).collect()}
    toxic = {k for k in held if k % 2}
    assert len(late) > 1000 and len(kept & toxic) < 0.05 * len(toxic) and len(kept & (held - toxic)) > 0.95 * len(held - toxic)
