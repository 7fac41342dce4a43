"""Corpus preparation: the stages that turn raw documents into a weighted corpus.

Each stage takes the documents that its predecessor kept. All but the last
return the columns of ``documents``; the last adds what training reads: tokens,
domain posteriors and a rate for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import secrets
from tracewell.llm.common import Scratch, materialise
from tracewell.llm.decontam import leaks
from tracewell.llm.language_id import UNDETERMINED, identify, learn
from tracewell.llm.minhash import near_duplicates
from tracewell.llm.mixing import mix_sources


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names, which an operator would replace, out of the way; and the way back."""
    back = {f"__own_{n}": n for n in names if n in docs.columns}
    return docs.withColumnsRenamed({n: held for held, n in back.items()}), back


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; null texts and texts without a letter are rejected."""
    own, back = aside(docs, "lang_pred", "score", "phrase_rate")
    judged = identify(own, learn(docs)).where(F.col("lang_pred") != UNDETERMINED)
    return judged.select(own.columns).withColumnsRenamed(back)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class: the smallest id, of rows without an id or with the same one the first."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        gone = near_duplicates(docs).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    number = next(n for n in ("row", "row_", "row__") if n not in docs.columns)
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()))
    classes = near_duplicates(rows, id_col=number).select(F.col("doc_id").alias(number), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", number)
    stays = classes.join(rows.select(number, "doc_id"), number).groupBy("component_id").agg(F.min(order).alias("o")).select(f"o.{number}")
    return rows.join(stays, number, "left_semi").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    own, back = aside(docs, "leaks")
    found = leaks(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("leaks") == 0)
    return found.select(own.columns).withColumnsRenamed(back)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document, with each secret replaced by a mark and ``n_chars`` counted again."""
    own, back = aside(docs, "secrets", "redacted")
    clean = secrets.scan(own, secrets.learn(docs)).withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        counted = F.when(F.size("secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        clean = clean.withColumn("n_chars", F.coalesce(counted, F.col("n_chars")))
    return clean.select(own.columns).withColumnsRenamed(back)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``tokens``, domain posteriors and the ``rate`` that meets the target weights."""
    return mix_sources(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("mixing to target weights", mixing_stage),
]

ORACLE_SQL = None  # classifiers, sketches and the CRF are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one's is written."""
    scratch = Scratch(spark)
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
        scratch.drop(*held)
        held = [docs]
    return docs
