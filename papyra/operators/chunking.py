"""Pages to search chunks: repeated margins removed, texts split at sentence ends, windows with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import page_text

SENTENCE_END = re.compile(r"[.!?。！？；;\n]")


def margin_lines(pages: DataFrame, edge: int = 3, longest: int = 120, share: float = 0.6) -> DataFrame:
    """doc_id, line, n: lines among the first or last ``edge`` non-empty ones of many pages of a document.

    Many is at least three pages and 60 % of them; documents of fewer than three pages have none.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pages = pages.withColumn("_l", lines)
    ends = F.concat(F.slice("_l", 1, edge), F.slice("_l", F.greatest(F.size("_l") - edge + 1, F.lit(1)), edge))
    counted = pages.select("doc_id", F.explode(F.array_distinct(F.filter(ends, lambda x: F.length(x) <= longest))).alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).where("pages >= 3")
    return counted.join(total, "doc_id").where(F.col("n") >= F.greatest(F.lit(3), F.ceil(share * F.col("pages")))).select("doc_id", "line", "n")


def without_margins(pages: DataFrame, edge: int = 3, **kwargs) -> DataFrame:
    """pages without their document's margin lines, where these are among the first or last lines."""
    gone = margin_lines(pages, edge, **kwargs).groupBy("doc_id").agg(F.collect_set("line").alias("_gone"))
    own = pages.join(gone, "doc_id", "left").withColumn("_l", F.split("text", "\n"))
    keep = F.filter("_l", lambda x, i: ~(F.coalesce(F.array_contains("_gone", F.trim(x)), F.lit(False)) & ((i < edge) | (i >= F.size("_l") - edge))))
    return own.withColumn("text", F.array_join(keep, "\n")).drop("_gone", "_l")


def split_long(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut after the last sentence end inside."""
    out = []
    while len(text) > most:
        ends = [m.end() for m in SENTENCE_END.finditer(text[:most])]
        at = ends[-1] if ends else most
        out.append(text[:at])
        text = text[at:]
    return [p for p in (x.strip() for x in [*out, text]) if p]


def windows(units: list[tuple[int, str]], target: int, most: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first page, last page, text) of chunks of whole units.

    A chunk ends once it reaches the target, or before a unit that would pass ``most``; the next
    begins with its last units, as many as reach the overlap.
    """
    out, held, fresh = [], [], False

    def size(own: list[tuple[int, str]]) -> int:
        return sum(len(t) for _, t in own) + max(0, len(own) - 1)

    def emit() -> None:
        nonlocal held, fresh
        out.append((held[0][0], held[-1][0], "\n".join(t for _, t in held)))
        tail: list[tuple[int, str]] = []
        for unit in reversed(held):
            tail.insert(0, unit)
            if size(tail) >= overlap:
                break
        held, fresh = tail, False

    for unit in units:
        if held and fresh and size([*held, unit]) > most:
            emit()
        if held and not fresh and size([*held, unit]) > most:
            held = []
        held.append(unit)
        fresh = True
        if size(held) >= target:
            emit()
    if fresh:
        out.append((held[0][0], held[-1][0], "\n".join(t for _, t in held)))
    return out


def chunk_pages(pages: DataFrame, target: int = 1400, most: int = 2200, overlap: int = 250) -> DataFrame:
    """doc_id, ordinal, start_page, end_page, text of pages (doc_id, page, text).

    One row a document goes to Python, its pages in order; a page's paragraphs are the units.
    """
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", page_text(F.coalesce("text", F.lit(""))).alias("text")))).alias("pages"))
    kind = dict(pages.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, own in zip(pdf["doc_id"], pdf["pages"], strict=True):
                units = [(p["page"], piece) for p in own for para in re.split(r"\n\n", p["text"]) for piece in split_long(para.strip(), most)]
                rows += [(doc, k, a, b, t) for k, (a, b, t) in enumerate(windows(units, target, most, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "start_page", "end_page", "text"])

    return docs.mapInPandas(run, f"doc_id {kind}, ordinal int, start_page int, end_page int, text string")


def extractable(pages: DataFrame, least: int = 80) -> DataFrame:
    """doc_id of documents whose pages hold at least 80 characters together."""
    return pages.groupBy("doc_id").agg(F.sum(F.length(F.trim("text"))).alias("n")).where(F.col("n") >= least).select("doc_id")
