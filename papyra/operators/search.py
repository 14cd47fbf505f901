"""Smart search: three channels from kept tables, fused, cut to a budget, reranked, versions collapsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import query_terms
from papyra.operators import retrieval
from papyra.operators.index import KeptIndex

#: Passages of a work that a channel returns, and that a result shows.
PER_WORK = 2


def _held(df: DataFrame) -> DataFrame:
    """Rows that a limit of the search bounds (some hundreds), computed once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _by_rank(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("work_id").orderBy(*order)))


def passage_candidates(fused: DataFrame, keyword: DataFrame, semantic: DataFrame, first: DataFrame) -> DataFrame:
    """work_id, depth, chunk_id: the two best passages of each fused work by reciprocal rank, its opening after the best one.

    keyword has relevance, semantic score; first has each work's first chunk_id.
    """
    ranks = _by_rank(keyword, F.col("relevance").desc(), "chunk_id").select("work_id", "chunk_id", "rank").unionByName(_by_rank(semantic, F.col("score").desc(), "chunk_id").select("work_id", "chunk_id", "rank"))
    scores = ranks.groupBy("work_id", "chunk_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 12).alias("s"))
    best = _by_rank(scores, F.col("s").desc(), "chunk_id").where(F.col("rank") <= PER_WORK)
    opening = first.join(best, ["work_id", "chunk_id"], "left_anti").select("work_id", "chunk_id", F.lit(1.5).alias("rank"))
    every = best.select("work_id", "chunk_id", F.col("rank").cast("double").alias("rank")).unionByName(opening).join(fused.select("work_id"), "work_id", "left_semi")
    return every.select("work_id", F.row_number().over(Window.partitionBy("work_id").orderBy("rank")).alias("depth"), "chunk_id")


def smart_search(index: KeptIndex, vectors: DataFrame, works: DataFrame, query: str, vector: list[float], depth: str = "fast", asked: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """work_id, place, title, raw, score (relative), tier and passages (chunk ids, two at most) of the best works.

    index holds the passages; vectors has work_id, chunk_id and vector; works has work_id, title,
    publication_year, doi, duplicate_of and abstract_text.  The channels are keyword hits, vector hits
    (two of a work each) and metadata.  Of the fused works the best ``asked`` have their second passage
    reserved; a work without passages is reranked by its metadata.  Token overlap stands in for the
    reranking model.
    """
    limits, limit, terms = retrieval.DEPTHS[depth], retrieval.result_limit(asked), query_terms(query)
    scoped = works if allowed is None else works.join(allowed.select("work_id").distinct(), "work_id", "left_semi")
    keyword = _held(index.search(query, "anyTerm", limits.channel, allowed, PER_WORK))
    semantic = _held(retrieval.vector_topk(vectors, vector, limits.channel, PER_WORK, allowed))
    meta = _held(retrieval.metadata_ranking(scoped, query, terms, limits.channel))
    rankings = [
        retrieval.ranking(keyword, "work_id", F.col("relevance").desc(), F.col("chunk_id")),
        retrieval.ranking(semantic, "work_id", F.col("score").desc(), F.col("chunk_id")),
        retrieval.ranking(meta, "work_id", F.col("score").desc(), F.col("work_id")),
    ]
    fused = retrieval.fuse(rankings, "work_id", limits.fused).withColumn("fusion", F.round("score", 12))
    fused = _held(fused.select("work_id", "fusion", F.row_number().over(Window.orderBy(F.col("fusion").desc(), "work_id")).alias("work")))

    chunks = index.live("chunks").join(F.broadcast(fused.select("work_id")), "work_id")  # limits.fused rows are broadcast
    wanted = passage_candidates(fused, keyword, semantic, chunks.groupBy("work_id").agg(F.min("chunk_id").alias("chunk_id")))
    bodies = chunks.select("work_id", "chunk_id", F.col("text").alias("body")).join(F.broadcast(wanted), ["work_id", "chunk_id"])
    known = works.join(F.broadcast(fused), "work_id").select("work_id", "work", "fusion", "title", F.col("publication_year").alias("year"), "doi", "duplicate_of", "abstract_text", *([c for c in ["authors"] if c in works.columns]))
    authors = F.col("authors") if "authors" in works.columns else F.lit(None).cast("string")
    rows = known.join(bodies, "work_id", "left").withColumn("text", retrieval.rerank_text(F.col("title"), authors, F.col("year"), F.col("doi"), F.col("body"), F.col("abstract_text")))
    passage = F.coalesce(F.col("chunk_id").cast("string"), F.concat(F.lit("metadata:"), F.col("work_id").cast("string")))
    scored = rows.select("work_id", "work", "fusion", "title", "year", "doi", "duplicate_of", "chunk_id", F.coalesce("depth", F.lit(1)).alias("depth"), passage.alias("passage"), F.length("text").alias("size"), F.round(retrieval.rerank_score(query, F.col("text")), 12).alias("raw"))
    scored = _held(scored)

    chosen = retrieval.select_passages(scored.withColumn("query", F.lit(0)), limits.passages, limits.characters, limit)
    ranked = retrieval.relative_scores(scored.join(chosen.select("passage"), "passage", "left_semi"))
    best = ranked.groupBy("work_id", "fusion", "title", "year", "doi", "duplicate_of").agg(F.max("raw").alias("raw"), F.max("relative").alias("score"))
    places = best.withColumn("query", F.lit(0)).withColumn("place", F.row_number().over(Window.orderBy(F.col("raw").desc(), F.col("fusion").desc(), "work_id")))
    kept = retrieval.collapse_ranked(places, limit).select("work_id")
    shown = retrieval.display_order(ranked.where("chunk_id IS NOT NULL").select("work_id", F.col("chunk_id").alias("id"), "raw", F.col("depth").alias("start_page"))).where(F.col("position") <= PER_WORK)
    passages = shown.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("passages"))
    out = places.join(kept, "work_id", "left_semi").join(passages, "work_id", "left")
    return out.select("work_id", F.row_number().over(Window.orderBy("place")).alias("place"), "title", F.round("raw", 9).alias("raw"), F.round("score", 9).alias("score"), retrieval.tier(F.col("score")).alias("tier"), "passages")
