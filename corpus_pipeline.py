"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir); run() writes what a stage returns as Parquet in the
shared folder and gives it to the next.  All stages but the last return the columns of documents,
whatever other columns there are.  A null or empty text is a document without words: it is
scored as such, holds no line, links with nothing, leaks nothing and is never drawn.  Null
doc_ids and sources are values like others, and rows that share a doc_id are told apart by
the whole row.  Repeated rows stay, but for near_dedup, which leaves one.  An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.decontam import benchmark_leaks
from papyra.llm.linededup import drop_boilerplate_lines
from papyra.llm.minhash import near_duplicates
from papyra.llm.mixing import mix_sources, mixed_texts
from papyra.llm.scratch import Scratch
from papyra.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; those without a text stay."""
    return score_toxicity(docs, _table(spark, sf_dir, "labels")).where("predicted = 0").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that their source repeats."""
    return drop_boilerplate_lines(docs).select(docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, a hash of the whole row: equal rows have one key, others (but for a collision of 64 bits) not; it is never null."""
    return docs.withColumn("_key", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of equal rows, one.  A doc_id may be null or have several texts."""
    keyed = _keyed(docs)
    kept = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = _keyed(docs)
    leaks = benchmark_leaks(keyed.select(F.col("_key").alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(leaks, "_key", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the text of each slot of each shard, by document."""
    return mixed_texts(mix_sources(docs), docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Trees, signatures and the latent space have no SQL form; tests/llm tests the stages one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = before = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        own = len(Scratch.made)
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        for inner in Scratch.made[own:]:  # what the stage wrote on its way
            inner.remove()
        if before is not docs and hasattr(before, "scratch_path"):
            scratch.drop(before)
        before = docs
    return docs
