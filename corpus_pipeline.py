"""Corpus pipeline: the toxicity, near-duplicate, decontamination, secret and
mixing operators in turn, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet to
the shared folder and reread as the next one's docs. Null texts pass every
filter as empty ones; documents of the same id are judged row by row, and of
repeated rows with words one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhap.llm import common, decontaminate, jaccard_join, mixing, secrets, toxicity

#: The classifier and the mix are no SQL; tests/llm/test_pipeline.py holds run()
#: against the stages' brute-force versions, one after the other.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the calibrated threshold of their language stay.
    The classifier learns from all labelled documents but the held-out quarter;
    its calibration and thresholds come from all rows of their parts."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = common.temp_column(docs, "score")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return toxicity.with_toxicity(docs, model, score).where(F.col(score) < toxicity.lang_threshold(model, lang)).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, that of the smallest id;
    documents without words are linked with none."""
    return jaccard_join.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others the benchmark's passages are cut."""
    hit = common.temp_column(docs, "hit")
    kept = decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=hit).where(~F.col(hit))
    return _counted(kept).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets replaced by a mark."""
    return _counted(secrets.redact(docs)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, text and all, with what the mix takes of it."""
    return mixing.mixed_rows(docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("source_mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"pipeline-{name}")
    return docs
