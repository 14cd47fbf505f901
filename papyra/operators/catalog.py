"""Catalog queries: snapshots, scopes, filters, smart lists, ranking and sorting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import normalize, phrase_of, query_terms, scoring_terms
from papyra.functions.values import priority_rank
from papyra.sources.kept import save

SCOPES = ("all", "title", "authors", "bibliographic", "research", "identifiers", "files")
ONLY_PAGE_WARNING = "页码"


def preferred_version(versions: DataFrame) -> DataFrame:
    """One version of each work: the first preferred one, else the first (columns work_id, is_preferred, pos)."""
    rank = F.row_number().over(Window.partitionBy("work_id").orderBy(F.col("is_preferred").desc(), "pos"))
    return versions.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def snapshots(works: DataFrame, versions: DataFrame) -> DataFrame:
    """works with their preferred version; works without one drop out."""
    return works.join(preferred_version(versions).select("work_id", "file_version_id", "relative_path", "sha256"), "work_id")


def metadata_text(*fields: Column) -> Column:
    return F.concat_ws("\n", *[F.nullif(f.cast("string"), F.lit("")) for f in fields])


def _holds(term: str):
    return lambda field: field.contains(term)


def text_matches(fields: Column, query: str, mode: str) -> Column:
    """Whether an array of normalised fields matches.

    allTerms: each term is in some field; anyTerm: some term is; exactPhrase: one field has
    the phrase.  An empty query matches all, one of quotes alone nothing.
    """
    if not query.strip():
        return F.lit(True)
    if mode == "exactPhrase":
        phrase = phrase_of(query)
        return F.exists(fields, lambda f: f.contains(phrase)) if phrase else F.lit(False)
    tests = [F.exists(fields, _holds(t)) for t in query_terms(query)]
    if not tests:
        return F.lit(False)
    return reduce((lambda a, b: a & b) if mode == "allTerms" else (lambda a, b: a | b), tests)


def fields_of(*columns: Column) -> Column:
    """Normalised, non-empty fields."""
    return F.filter(F.transform(F.array(*[c.cast("string") for c in columns]), normalize), lambda f: f != "")


def special_filters(lo: int | None = None, hi: int | None = None, **flags: bool) -> Column:
    """Year bounds (a null year fails any bound) and flags that must be true where asked for."""
    tests = [F.lit(True)]
    if lo is not None:
        tests.append(F.coalesce(F.col("year") >= lo, F.lit(False)))
    if hi is not None:
        tests.append(F.coalesce(F.col("year") <= hi, F.lit(False)))
    known = {
        "needs_review": F.col("needs_review"), "analyzed": F.col("latest_status") == "completed", "abstract": F.coalesce(F.col("abstract_text"), F.lit("")) != "",
        "annotated": F.col("has_annotations"), "versions": F.col("version_count") >= 2, "missing_doi": F.coalesce(F.col("doi"), F.lit("")) == "",
    }
    tests += [F.coalesce(known[f], F.lit(False)) for f, on in flags.items() if on]
    return reduce(lambda a, b: a & b, tests)


def active_filters(lo: int | None = None, hi: int | None = None, **flags: bool) -> int:
    return (lo is not None) + (hi is not None) + sum(map(bool, flags.values()))


def smart_list(name: str, as_of: str | None = None, key: object = None) -> Column:
    """The predicate of a smart list."""
    status = F.col("latest_status")
    lists = {
        "all": lambda: F.lit(True),
        "needsReview": lambda: F.col("needs_review") | (status == "failed"),
        "duplicates": lambda: F.col("duplicate_of").isNotNull(),
        "queue": lambda: status.isin("queued", "running"),
        "recent": lambda: F.col("date_added") >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL 30 DAYS"),
        "versions": lambda: F.col("version_count") > 1,
        "missingDOI": lambda: F.coalesce(F.col("doi"), F.lit("")) == "",
        "unanalyzed": lambda: status.isNull() | (status == "cancelled"),
        "category": lambda: F.col("category") == key,
        "project": lambda: F.array_contains("project_ids", key),
    }
    return F.coalesce(lists[name](), F.lit(False))


def tag_filter(tags: Column, marks: Column, selected_tags: list, selected_marks: list) -> Column:
    """Pass where nothing is selected, else where a selected tag or mark is there."""
    if not selected_tags and not selected_marks:
        return F.lit(True)
    overlap = lambda own, sel: F.arrays_overlap(own, F.array(*[F.lit(s) for s in sel])) if sel else F.lit(False)
    return F.coalesce(overlap(tags, selected_tags), F.lit(False)) | F.coalesce(overlap(marks, selected_marks), F.lit(False))


def requires_review(needs_review: Column, note: Column) -> Column:
    """Needs review, and not for the page-number warning alone."""
    return needs_review & ~F.coalesce(F.trim(note) == ONLY_PAGE_WARNING, F.lit(False))


def can_mark_reviewed(missing_file: str = "missing file") -> Column:
    busy = F.col("latest_status").isin("queued", "running", "failed")
    return F.col("duplicate_of").isNull() & ~F.coalesce(busy, F.lit(False)) & ~F.coalesce(F.col("note").startswith(missing_file), F.lit(False))


def group_hits(groups: dict[str, tuple[int, Column]], terms: list[str]) -> Column:
    """array<struct<weight, hits, name>> of field groups (name -> weight, normalised fields)."""
    hits = lambda own: sum((F.exists(own, _holds(t)).cast("int") for t in terms), F.lit(0))
    return F.array(*[F.struct(F.lit(w).alias("weight"), hits(own).alias("hits"), F.lit(n).alias("name")) for n, (w, own) in groups.items()])


def relevance_score(groups: dict[str, tuple[int, Column]], query: str, mode: str) -> Column:
    """Sum over field groups of terms found times the group's weight."""
    return F.aggregate(group_hits(groups, scoring_terms(query, mode)), F.lit(0), lambda s, g: s + g["weight"] * g["hits"])


def match_reason(groups: dict[str, tuple[int, Column]], query: str, mode: str) -> Column:
    """Name of the heaviest group with a term; null where none has."""
    found = F.filter(group_hits(groups, scoring_terms(query, mode)), lambda g: g["hits"] > 0)
    return F.array_max(found)["name"]


def library_order(field: str, descending: bool = False, priority: str | None = None) -> list[Column]:
    """Sort keys: project priority, missing values last either way, the field, title, id."""
    key = F.col(field)
    first = [priority_rank(F.col(priority)).desc()] if priority else []
    return [*first, key.isNull().asc(), key.desc() if descending else key.asc(), F.col("title").asc(), F.col("work_id").asc()]


def combined_score(metadata: Column, passage: Column) -> Column:
    """Keyword order: (2 + metadata / 100 where positive) + (1 where a passage matches)."""
    return F.when(metadata > 0, 2 + metadata / 100.0).otherwise(0.0) + F.when(passage > 0, 1.0).otherwise(0.0)


def badges(works: DataFrame) -> DataFrame:
    """One row: counts of the smart lists."""
    count = lambda name: F.count_if(smart_list(name)).alias(name)
    return works.agg(count("all"), count("needsReview"), count("duplicates"), count("queue"), count("missingDOI"), count("unanalyzed"))


def counts_with_zero(dimension: DataFrame, bridge: DataFrame, key: str) -> DataFrame:
    """key, n: rows of the bridge for each row of the dimension, zeros included."""
    return dimension.select(key).join(bridge.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def chips(marks: DataFrame, tags: DataFrame, total: int = 3) -> DataFrame:
    """work_id, name, position: the first marks by sort order, then tags by name, ``total`` in all; overflow: how many more."""
    every = marks.select("work_id", "name", F.lit(0).alias("kind"), F.col("sort_order").cast("string").alias("key")).unionAll(tags.select("work_id", "name", F.lit(1).alias("kind"), F.col("name").alias("key")))
    own = Window.partitionBy("work_id")
    ranked = every.withColumn("position", F.row_number().over(own.orderBy("kind", F.when(F.col("kind") == 0, F.col("key").cast("int")), "key"))).withColumn("overflow", F.greatest(F.lit(0), F.count("*").over(own) - total))
    return ranked.where(F.col("position") <= total).select("work_id", "name", "position", "overflow")


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with ``position`` (long, from 1) in the order, which must be total; no task sees all rows.

    Sorted parts, written once to the shared folder, are numbered each for itself from the number
    of rows in the parts before it.
    """
    dealt = save(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_id", 33)
    # one row for each task
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"))
    out = dealt.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return out.withColumn("position", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_part", "_before")
