"""Cost ledger and status: daily totals, month spend, latest rows, durations, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.sources.kept import running_total


def union_kinds(**tables: DataFrame) -> DataFrame:
    """Fact tables on top of each other with their name as ``kind``."""
    out = None
    for kind, df in tables.items():
        own = df.withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def daily_totals(items: DataFrame, kinds: list[str]) -> DataFrame:
    """day, a sum for each kind, total: items with a positive cost only, newest day first."""
    per_kind = [F.sum(F.when(F.col("kind") == k, F.col("cost_usd")).otherwise(0.0)).alias(k) for k in kinds]
    days = items.where("cost_usd > 0").groupBy(F.to_date("created_at").alias("day"))
    return days.agg(*per_kind, F.sum("cost_usd").alias("total")).orderBy(F.col("day").desc())


def month_spend(items: DataFrame, as_of: str, budget: float, without: object = None) -> DataFrame:
    """spent, allowed: costs as they are since the month began, one id left out; budget 0 allows all."""
    since = F.date_trunc("month", F.lit(as_of).cast("timestamp_ntz"))
    rows = items.where(F.col("created_at") >= since)
    if without is not None:
        rows = rows.where(F.col("id") != F.lit(without))
    spent = F.coalesce(F.sum("cost_usd"), F.lit(0.0))
    return rows.agg(spent.alias("spent"), (F.lit(budget <= 0) | (spent < budget)).alias("allowed"))


def today_and_month(items: DataFrame, as_of: str) -> DataFrame:
    """today, month: totals with negative costs as nothing."""
    now, cost = F.lit(as_of).cast("timestamp_ntz"), F.greatest(F.col("cost_usd"), F.lit(0.0))
    total = lambda unit: F.coalesce(F.sum(F.when(F.date_trunc(unit, "created_at") == F.date_trunc(unit, now), cost)), F.lit(0.0))
    return items.agg(total("day").alias("today"), total("month").alias("month"))


def latest(rows: DataFrame, group: str, value: str, *order: str, where: Column | None = None) -> DataFrame:
    """group, value at its latest row; ``where`` limits the rows first."""
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(group).agg(F.max_by(value, F.struct(*order)).alias(value))


def retain_newest(rows: DataFrame, order: list[Column], keep: int, group: str | None = None) -> DataFrame:
    """The newest ``keep`` rows (of each group)."""
    if group is None:
        return rows.orderBy(*order).limit(keep)
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= keep).drop("_rank")


def trimmed_mean_eta(samples: DataFrame, remaining: int, last: int = 50, group: str = "series") -> DataFrame:
    """series, samples, mean, eta: of the last 50 durations; from ten on, a tenth is cut off either end."""
    own = retain_newest(samples, [F.col("pos").desc()], last, group).groupBy(group).agg(F.array_sort(F.collect_list("seconds")).alias("v"))
    n = F.size("v")
    cut = F.when(n >= 10, F.greatest(F.lit(1), F.floor(n / 10).cast("int"))).otherwise(0)
    kept = F.slice("v", cut + 1, n - 2 * cut)
    mean = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept)
    return own.select(group, n.alias("samples"), mean.alias("mean"), (mean * remaining).alias("eta"))


def outcome_counts(rows: DataFrame, column: str = "outcome") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def batch_outcomes(items: DataFrame, budget: float) -> DataFrame:
    """outcome, n of items in order (pos, cost, ok): once the budget is spent the rest is skipped."""
    rows = running_total(items, ["pos"], F.col("cost"), "before")
    return outcome_counts(rows.withColumn("outcome", F.when(F.col("before") >= budget, "skipped").when(F.col("ok"), "completed").otherwise("failed")))


def index_statistics(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, failures: DataFrame, signature: str, stage: str) -> DataFrame:
    """One row: ready documents, chunks, embedded chunks, failures, stored bytes (two a number)."""
    own = vectors.where(F.col("model_signature") == signature)
    parts = [
        documents.agg(F.count_if(F.col("status") == "ready").alias("ready")), chunks.agg(F.count("*").alias("chunks")),
        own.agg(F.count("*").alias("embedded"), F.coalesce(F.sum(F.size("vector").cast("long") * 2), F.lit(0)).alias("bytes")),
        failures.where((F.col("model_signature") == signature) & (F.col("stage") == stage)).agg(F.count("*").alias("failed")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def missing_embeddings(chunks: DataFrame, vectors: DataFrame, signature: str, failures: DataFrame | None = None, stage: str = "embedding") -> DataFrame:
    """Chunks without a vector of the signature, and without a failure where those are given."""
    out = chunks.join(vectors.where(F.col("model_signature") == signature).select("chunk_id"), "chunk_id", "left_anti")
    if failures is not None:
        out = out.join(failures.where((F.col("model_signature") == signature) & (F.col("stage") == stage)).select("chunk_id"), "chunk_id", "left_anti")
    return out


def works_missing_embeddings(chunks: DataFrame, vectors: DataFrame, signature: str, allowed: DataFrame | None = None) -> DataFrame:
    rows = missing_embeddings(chunks, vectors, signature)
    rows = rows if allowed is None else rows.join(allowed.select("work_id").distinct(), "work_id", "left_semi")
    return rows.agg(F.countDistinct("work_id").alias("works"))
