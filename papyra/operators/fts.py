"""Full-text search: match expressions, BM25, capped top-k, per-work matches."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import index_tokens, phrase_of, query_terms, searchable

K1, B = 1.2, 0.75
CJK = re.compile(r"[㐀-鿿]")


@dataclass(frozen=True)
class Match:
    """A search expression: all or any of its groups, each of which needs all of its phrases."""

    groups: list[list[list[str]]]
    every: bool

    @property
    def phrases(self) -> list[list[str]]:
        return [p for g in self.groups for p in g]


def _bigrams(text: str) -> list[list[str]]:
    own = CJK.findall(text)
    return [[a + b] for a, b in zip(own, own[1:], strict=False)]


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text) if w]


def match_expression(query: str, mode: str) -> Match | None:
    """The expression for a query in mode anyTerm, allTerms or exactPhrase; None for an empty one.

    A term or phrase with two CJK characters or more is matched by its CJK bigrams alone.
    """
    if mode == "exactPhrase":
        phrase = phrase_of(query)
        pairs = _bigrams(phrase)
        group = [[w for p in pairs for w in p]] if pairs else [_words(phrase)]
        return Match([group], True) if group[0] else None
    groups = [g for t in query_terms(query) for g in [_bigrams(t) or [_words(t)]] if g[0]]
    return Match(groups, mode == "allTerms") if groups else None


def _frequency(joined: Column, length: Column, phrase: list[str]) -> Column:
    """Occurrences of a phrase in tokens joined by two spaces inside single ones."""
    pattern = " " + "  ".join(phrase) + " "
    return ((length - F.length(F.replace(joined, F.lit(pattern), F.lit("")))) / len(pattern)).cast("int")


def bm25(chunks: DataFrame, match: Match, text: str = "text") -> DataFrame:
    """chunks that match, with relevance: higher is better.

    Statistics are those of all chunks: scope filters come after.  The inverse document
    frequency of a phrase in more than half of them is floored at 1e-6.  Only the
    statistics, one row, are broadcast.
    """
    phrases = match.phrases
    rows = chunks.withColumn("_own", index_tokens(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.select(*chunks.columns, F.size("_own").alias("_dl"), F.concat(F.lit(" "), F.array_join("_own", "  "), F.lit(" ")).alias("_joined"))
    rows = rows.select(*chunks.columns, "_dl", *[_frequency(F.col("_joined"), F.length("_joined"), p).alias(f"_tf{i}") for i, p in enumerate(phrases)])
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(phrases))])
    at, tests = 0, []
    for group in match.groups:
        tests.append(reduce(lambda a, b: a & b, [F.col(f"_tf{i}") > 0 for i in range(at, at + len(group))]))
        at += len(group)
    test = reduce((lambda a, b: a & b) if match.every else (lambda a, b: a | b), tests)
    norm = K1 * (1 - B + B * F.col("_dl") / F.col("_avg"))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + norm)
    return rows.where(test).crossJoin(F.broadcast(stats)).select(*chunks.columns, score.alias("relevance"))


def top_hits(hits: DataFrame, limit: int, cap: int | None = None, work: str = "work_id", chunk: str = "chunk_id", score: str = "relevance") -> DataFrame:
    """The best ``limit`` hits, of a work ``cap`` at most; ties by chunk id."""
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy(work).orderBy(F.col(score).desc(), chunk))
        hits = hits.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")
    return hits.orderBy(F.col(score).desc(), chunk).limit(limit)


def keyword_search(chunks: DataFrame, query: str, mode: str = "anyTerm", limit: int = 100, allowed: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """work_id, chunk_id, text, relevance of the best chunks; allowed: a table of work_id, of any size."""
    match = match_expression(query, mode)
    if match is None:
        return chunks.withColumn("relevance", F.lit(0.0)).limit(0)
    hits = bm25(chunks, match)
    if allowed is not None:
        hits = hits.join(allowed.select("work_id").distinct(), "work_id", "left_semi")
    return top_hits(hits, limit, cap)


def hits_with_all_terms(hits: DataFrame, terms: list[str]) -> DataFrame:
    """Hits of works whose retrieved texts together contain every term."""
    if not terms:
        return hits
    whole = hits.groupBy("work_id").agg(F.concat_ws(" ", F.collect_list(searchable(F.col("text")))).alias("_whole"))
    return hits.join(whole.where(reduce(lambda a, b: a & b, [F.col("_whole").contains(t) for t in terms])), "work_id", "left_semi")


def search_all_terms(chunks: DataFrame, query: str, retrieve: int = 240) -> DataFrame:
    """allTerms as the library's search box has it: the best 240 chunks for any term, then works with all."""
    return hits_with_all_terms(keyword_search(chunks, query, "anyTerm", retrieve), query_terms(query))


def work_matches(hits: DataFrame, passages: int = 3) -> DataFrame:
    """work_id, score (the best hit) and the best passages of each work."""
    rank = F.row_number().over(Window.partitionBy("work_id").orderBy(F.col("relevance").desc(), "chunk_id"))
    best = hits.withColumn("_rank", rank).where(F.col("_rank") <= passages)
    return best.groupBy("work_id").agg(F.max("relevance").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("_rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("passages"))
