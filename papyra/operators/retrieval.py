"""Vector search, rank fusion, candidate selection, reranking and final matches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.text import fold, jaccard, token_set
from papyra.functions.values import minmax
from papyra.operators.fts import top_hits


@dataclass(frozen=True)
class Depth:
    """Limits of a search: hits of a channel, fused works, passages, characters."""

    channel: int
    fused: int
    passages: int
    characters: int


DEPTHS = {"fast": Depth(100, 30, 30, 45_000), "balanced": Depth(200, 60, 80, 90_000), "deep": Depth(300, 100, 120, 110_000)}
RESULT_LIMITS = (5, 10, 20)


def result_limit(asked: int) -> int:
    return asked if asked in RESULT_LIMITS else 10


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; minus infinity for empty, unequal or zero vectors."""
    bad = (F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm(a) == 0) | (norm(b) == 0)
    return F.when(bad, F.lit(float("-inf"))).otherwise(dot(a, b) / (norm(a) * norm(b)))


def normalized(v: Column, dimensions: int) -> Column:
    """v over its norm; null where it isn't of this many finite numbers or is zero."""
    sound = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm(v) > 0)
    return F.when(sound, F.transform(v, lambda x: x.cast("double") / norm(v)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def half_precision(v: pd.Series) -> pd.Series:
    """Vectors as they come back from 16-bit storage."""
    return v.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))


def vector_topk(vectors: DataFrame, query: list[float], limit: int, cap: int | None = 2, allowed: DataFrame | None = None) -> DataFrame:
    """work_id, chunk_id, score: the largest dot products with the query, of a work ``cap`` at most.

    Rows of another dimension are skipped; ties go to the smaller chunk id.  Batches are
    one matrix product each, and only ids and scores leave them.
    """
    wanted = np.asarray(query, float)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == len(wanted) for v in pdf["vector"]]]
            if len(pdf):
                yield pd.DataFrame({"work_id": pdf["work_id"], "chunk_id": pdf["chunk_id"], "score": np.stack(pdf["vector"].to_numpy()).astype(float) @ wanted})

    rows = vectors.select("work_id", "chunk_id", "vector")
    if allowed is not None:
        rows = rows.join(allowed.select("work_id").distinct(), "work_id", "left_semi")
    kinds = dict(rows.dtypes)
    scored = rows.mapInPandas(scan, f"work_id {kinds['work_id']}, chunk_id {kinds['chunk_id']}, score double")
    return top_hits(scored, limit, cap, score="score")


def ranking(rows: DataFrame, item: str, *order: Column) -> DataFrame:
    """item, rank: position of each item's first row in the order, counted over distinct items.

    For rankings that a limit has already bounded.
    """
    at = rows.withColumn("_at", F.row_number().over(Window.orderBy(*order))).groupBy(item).agg(F.min("_at").alias("_at"))
    return at.select(item, F.row_number().over(Window.orderBy("_at")).alias("rank"))


def fuse(rankings: list[DataFrame], item: str, limit: int | None = None, constant: float = 60.0) -> DataFrame:
    """item, score: reciprocal-rank fusion, best first, ties by item."""
    every = rankings[0].select(item, "rank")
    for other in rankings[1:]:
        every = every.unionAll(other.select(item, "rank"))
    fused = every.groupBy(item).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return fused if limit is None else fused.orderBy(F.round("score", 12).desc(), item).limit(limit)


def metadata_ranking(works: DataFrame, query: str, terms: list[str], limit: int) -> DataFrame:
    """work_id, score: 10 for each term that the metadata hold, 100 where the title holds the query."""
    text = fold(F.concat_ws("\n", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("title", "authors", "abstract_text", "publication_year", "doi", "relative_path") if c in works.columns]))
    score = sum((F.when(text.contains(t), 10).otherwise(0) for t in terms), F.lit(0)) + F.when(fold(F.col("title")).contains(query.lower().strip()), 100).otherwise(0)
    best = works.select("work_id", score.alias("score")).orderBy(F.col("score").desc(), "work_id").limit(limit)
    return best.where("score > 0")  # before the limit it would be pushed down and texts be folded once more for each use


def rescaled(rows: DataFrame, by: str, score: str) -> DataFrame:
    """rows with ``relative``: scores rescaled to 0..1 within each ``by``, 1 where all are equal.

    Bounds are combined before a shuffle and joined back, so a group may hold any share of the rows.
    """
    bounds = rows.groupBy(F.col(by).alias("_by")).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    value = F.when(F.col("_high") - F.col("_low") <= 2.220446049250313e-16, F.lit(1.0)).otherwise((F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return rows.join(bounds, F.col(by).eqNullSafe(F.col("_by"))).withColumn("relative", value).drop("_by", "_low", "_high")


def select_passages(passages: DataFrame, most: int, characters: int, priority: int = 0, by: str = "query") -> DataFrame:
    """query, position, passage: what each query sends to the reranker, under a limit of passages and a budget of characters.

    passages has query, work (the place of its work, from 1), depth (its place in the work, from 1), passage (an id) and
    size.  First come the first passages of the ``priority`` best works (of half of ``most`` at most), then
    those works' second ones, skipping what does not fit; then the first passages of the other works up to the
    first that does not fit; then of each work one more, the first that fits.

    A query's lists are bounded by the fused limit of a search, so one row holds them, and the order is
    folded over with what is left of the budget as its state; queries are dealt out.
    """
    reserved = max(0, min(priority, most // 2))
    first = F.when(F.col("depth") == 1, F.when(F.col("work") <= reserved, 1).otherwise(3)).when((F.col("depth") == 2) & (F.col("work") <= reserved), 2).otherwise(4)
    row = F.struct(first.alias("step"), "work", "depth", "passage", F.col("size").cast("long").alias("size"))
    ordered = passages.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    fold = f"""aggregate(rows,
      named_struct('left', CAST({characters} AS BIGINT), 'taken', CAST(array() AS ARRAY<STRING>), 'ended', false, 'done', 0),
      (s, x) -> CASE WHEN size(s.taken) < {most} AND x.size <= s.left AND NOT array_contains(s.taken, CAST(x.passage AS STRING)) AND NOT (x.step = 3 AND s.ended) AND NOT (x.step = 4 AND s.done = x.work)
        THEN named_struct('left', s.left - x.size, 'taken', array_append(s.taken, CAST(x.passage AS STRING)), 'ended', s.ended, 'done', IF(x.step = 4, CAST(x.work AS INT), s.done))
        ELSE named_struct('left', s.left, 'taken', s.taken, 'ended', s.ended OR x.step = 3, 'done', s.done) END).taken"""
    return ordered.select(by, F.posexplode(F.expr(fold)).alias("position", "passage"))


def select_for_rerank(works: list[list[tuple[str, int]]], passages: int, characters: int, priority: int = 0) -> list[str]:
    """Passage ids chosen under a passage limit and a character budget, from fused works in order.

    works: for each its (id, length) passages.  First the first passages of the works with
    priority, then their second ones, skipping what doesn't fit; then first passages of the
    others, up to the first that doesn't fit; then one more of each work, the first that fits.
    The rule for one query on plain lists; select_passages() is its form on a table of many queries.
    """
    chosen: list[str] = []
    left = characters

    def take(passage: tuple[str, int]) -> bool:
        nonlocal left
        if len(chosen) >= passages or passage[1] > left or passage[0] in chosen:
            return False
        chosen.append(passage[0])
        left -= passage[1]
        return True

    reserved = min(len(works), priority, passages // 2)
    for depth in (0, 1):
        for own in works[:reserved]:
            if len(own) > depth:
                take(own[depth])
    for own in works[reserved:]:
        if own and not take(own[0]):
            break
    for n, own in enumerate(works):
        any(take(p) for p in own[2 if n < reserved else 1 :])
    return chosen


def rerank_text(title: Column, authors: Column, year: Column, doi: Column, body: Column, abstract: Column) -> Column:
    line = lambda label, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(label), c.cast("string")))
    text = F.coalesce(F.nullif(body, F.lit("")), F.nullif(abstract, F.lit("")), F.lit("metadata only"))
    return F.concat_ws("\n", line("Title: ", title), line("Authors: ", authors), line("Year: ", year), line("DOI: ", doi), text)


def rerank_score(query: str, text: Column) -> Column:
    """The stand-in for a reranking model: token Jaccard."""
    return jaccard(token_set(F.lit(query)), token_set(text))


def tier(score: Column) -> Column:
    return F.when(score >= 0.5, "solid").otherwise("marginal")


def relative_scores(rows: DataFrame, score: str = "raw") -> DataFrame:
    """rows with ``relative``: scores rescaled to 0..1 over the batch, which a rerank limit bounds."""
    return rows.withColumn("relative", minmax(F.col(score), Window.partitionBy()))


def collapse_ranked(ranked: DataFrame, limit: int, by: str = "query") -> DataFrame:
    """query, work_id, place of the best ``limit`` works of each query without versions of one already kept.

    ranked has query, place, work_id, doi, duplicate_of, title, year.  Two works are versions of each other
    if they share a DOI, one is marked as the other's duplicate, or their titles are equal and
    their years at most one apart.  A query's list, which the fused limit bounds, is folded over in its order: a
    work is compared with those kept, ``limit`` at most, so no pairs of works are made.
    """
    row = F.struct("place", "work_id", F.nullif("doi", F.lit("")).alias("doi"), "duplicate_of", F.nullif("title", F.lit("")).alias("title"), "year")
    rows = ranked.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    same = "k.doi = x.doi OR k.duplicate_of = x.work_id OR x.duplicate_of = k.work_id OR (k.title = x.title AND abs(k.year - x.year) <= 1)"
    fold = f"""aggregate(rows, slice(rows, 1, 0),
      (s, x) -> IF(size(s) < {limit} AND NOT exists(s, k -> coalesce({same}, false)), array_append(s, x), s))"""
    return rows.select(by, F.explode(F.expr(fold)).alias("k")).select(by, "k.work_id", "k.place")


def collapse_versions(ranked: list[dict], limit: int) -> list:
    """Work ids in order without versions of one already kept: same DOI, a link either way, or
    years at most one apart with equal titles.  The rule on plain lists; collapse_ranked() is its form
    on a table of many queries."""

    def same(a: dict, b: dict) -> bool:
        if a.get("doi") and a.get("doi") == b.get("doi"):
            return True
        if a.get("duplicate_of") == b["work_id"] or b.get("duplicate_of") == a["work_id"]:
            return True
        years = a.get("year"), b.get("year")
        return bool(a.get("title")) and a["title"] == b["title"] and None not in years and abs(years[0] - years[1]) <= 1

    kept: list[dict] = []
    for own in ranked:
        if len(kept) < limit and not any(same(own, k) for k in kept):
            kept.append(own)
    return [k["work_id"] for k in kept]


def display_order(passages: DataFrame, early: int = 3, tolerance: float = 0.08, ratio: float = 0.85) -> DataFrame:
    """passages (work_id, id, raw, start_page) with ``position``.

    By score, page and id; but if passages of the first pages are within the tolerance or
    the ratio of the best, the earliest of them comes first.
    """
    own = Window.partitionBy("work_id")
    best = F.max("raw").over(own)
    near = (F.col("start_page") <= early) & ((best - F.col("raw") <= tolerance) | (F.col("raw") >= ratio * best))
    first = F.min(F.when(near, F.struct("start_page", (-F.col("raw")).alias("r"), "id"))).over(own)["id"]
    return passages.withColumn("_first", first).withColumn("position", F.row_number().over(own.orderBy((~F.col("id").eqNullSafe(F.col("_first"))).cast("int"), F.col("raw").desc(), "start_page", "id"))).drop("_first")


def float16_bytes(v: Column) -> Column:
    return F.size(v) * 2


