"""State of the library and its index: upserts, deletes, merges, reviews, tags, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.identifiers import normalized_doi
from papyra.operators.retrieval import normalized
from papyra.sources.kept import save


def changed_documents(snapshots: DataFrame, documents: DataFrame, schema: int) -> DataFrame:
    """Snapshots whose text must be indexed: new, another version, hash or schema, or pending."""
    old = documents.select("work_id", *[F.col(c).alias(f"_{c}") for c in ("file_version_id", "sha256", "chunk_schema", "status")], F.lit(True).alias("_known"))
    joined = snapshots.join(old, "work_id", "left")
    differs = ~(F.col("file_version_id").eqNullSafe(F.col("_file_version_id")) & F.col("sha256").eqNullSafe(F.col("_sha256")) & F.col("_chunk_schema").eqNullSafe(F.lit(schema)))
    return joined.where(F.col("_known").isNull() | differs | (F.col("_status") == "pending")).select(snapshots.columns)


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the rows of new's keys, and new: an upsert of whole groups."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return old.unionByName(new).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def remove_works(table: DataFrame, works: DataFrame) -> DataFrame:
    return table.join(works.select("work_id").distinct(), "work_id", "left_anti")


def keep_live(table: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Rows whose key is live; rows with a null key stay, as NOT IN leaves them."""
    return table.join(live.select(key).distinct(), key, "left_semi").unionByName(table.where(F.col(key).isNull()))


def scope_removal(documents: DataFrame, chunks: DataFrame, live: DataFrame) -> DataFrame:
    """work_id of documents or chunks outside the live set."""
    return documents.select("work_id").union(chunks.select("work_id")).distinct().join(live.select("work_id").distinct(), "work_id", "left_anti")


def without_signature(table: DataFrame, signature: str) -> DataFrame:
    return table.where(~F.col("model_signature").eqNullSafe(F.lit(signature)))


def failure_key(stage: Column, signature: Column, chunk: Column, work: Column) -> Column:
    return F.concat_ws("|", stage, F.coalesce(signature, F.lit("none")), F.coalesce(chunk.cast("string"), work.cast("string"), F.lit("global")))


def retry_unindexable(documents: DataFrame) -> DataFrame:
    return documents.withColumn("status", F.when(F.col("status") == "unindexable", "pending").otherwise(F.col("status")))


def mark_interrupted(jobs: DataFrame) -> DataFrame:
    """Queued and running jobs fail; interrupted says which."""
    stopped = F.col("status").isin("queued", "running")
    return jobs.withColumn("interrupted", F.coalesce(stopped, F.lit(False))).withColumn("status", F.when(stopped, "failed").otherwise(F.col("status")))


def mark_reviewed(works: DataFrame, eligible: Column) -> DataFrame:
    return works.withColumn("marked", F.coalesce(eligible & F.col("needs_review"), F.lit(False))).withColumn("needs_review", F.when(eligible, F.lit(False)).otherwise(F.col("needs_review")))


def add_tags(bridge: DataFrame, works: DataFrame, tags: list[str]) -> DataFrame:
    """The bridge with each of a user's tags on every work, each once."""
    added = works.select("work_id", F.explode(F.array(*[F.lit(t) for t in tags])).alias("tag"))
    return bridge.select("work_id", "tag").union(added).distinct()


def remove_tags(bridge: DataFrame, works: DataFrame, tags: DataFrame) -> DataFrame:
    gone = bridge.join(works.select("work_id").distinct(), "work_id", "left_semi").join(tags.select("tag").distinct(), "tag", "left_semi")
    return bridge.join(gone.select("work_id", "tag"), ["work_id", "tag"], "left_anti")


def orphan_tags(tags: DataFrame, bridge: DataFrame) -> DataFrame:
    return tags.join(bridge.select("tag").distinct(), "tag", "left_anti")


def find_or_create(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """names with wanted ones whose lower-case form is not there yet."""
    fresh = wanted.withColumn("_k", F.lower("name")).join(names.select(F.lower("name").alias("_k")), "_k", "left_anti")
    return names.select("name").unionAll(fresh.groupBy("_k").agg(F.min("name").alias("name")).select("name"))


def unused(dimension: DataFrame, bridge: DataFrame, work: object, key: str) -> DataFrame:
    return dimension.join(bridge.where(F.col("work_id") == F.lit(work)).select(key), key, "left_anti")


def final_targets(mapping: DataFrame) -> DataFrame:
    """source, target, steps of a mapping (source, target) followed to its end: chains lead to the last work.

    Of several targets of a source the smallest counts; one to itself is none.  On a cycle the smallest id stays and the others go into it.
    Ends are found by doubling: each round goes twice as far, so rounds are the logarithm of the
    longest chain, and each is a join of the mapping with itself, merged by its key: a broadcast would send the
    whole mapping to the driver in every round.
    """
    one = mapping.where("source <> target").groupBy("source").agg(F.min("target").alias("target"))
    table = save(one, "mapping")
    most = max(1, table.count()).bit_length()

    def doubled(table: DataFrame) -> DataFrame:
        """Each source's target 2**most steps on or at the end of its chain, with the steps to it and the least id on the way."""
        now = table.withColumn("steps", F.lit(1).cast("long")).withColumn("least", F.least("source", "target"))
        for _ in range(most):
            on = now.select(F.col("source").alias("target"), F.col("target").alias("_on"), F.col("steps").alias("_steps"), F.col("least").alias("_least"))
            joined = now.join(on.hint("merge"), "target", "left")
            after = save(joined.select("source", F.coalesce("_on", "target").alias("target"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.least("least", "_least").alias("least"), F.col("_on").isNotNull().alias("_moved")), "steps")
            now = after.drop("_moved")
            if not after.where("_moved").take(1):
                break
        return now

    ends = doubled(table)
    # an end that is a source itself lies on a cycle, and going on from there passes all of it
    cycles = ends.join(ends.select(F.col("target").alias("source")).distinct().hint("merge"), "source", "left_semi").groupBy("least").agg(F.count("*")).select(F.col("least").alias("source"))
    if cycles.take(1):
        ends = doubled(save(table.join(cycles.hint("merge"), "source", "left_anti"), "mapping"))
    return ends.select("source", "target", "steps")


def merge_works(works: DataFrame, mapping: DataFrame, fill: list[str]) -> DataFrame:
    """works after each source went into its target, chains of merges into the last one; sources are gone.

    mapping has source and target.  Null ``fill`` fields of a target take the value of the nearest source that has one (of
    equally near ones the smallest value).  A link to a source leads to its final target, one to itself ends.
    """
    ends = final_targets(mapping)
    gone = ends.select(F.col("source").alias("work_id"), "target", "steps").hint("merge")
    nearest = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("steps", c)))[c].alias(f"_{c}")
    donors = works.join(gone, "work_id").groupBy("target").agg(*[nearest(c) for c in fill]).withColumnRenamed("target", "work_id")
    kept = works.join(gone.select("work_id").hint("merge"), "work_id", "left_anti").join(donors.hint("merge"), "work_id", "left")
    kept = kept.join(ends.select(F.col("source").alias("duplicate_of"), F.col("target").alias("_to")).hint("merge"), "duplicate_of", "left")
    link = F.coalesce("_to", "duplicate_of")
    link = F.when(link == F.col("work_id"), None).otherwise(link)
    return kept.select(*[F.coalesce(c, f"_{c}").alias(c) if c in fill else link.alias(c) if c == "duplicate_of" else F.col(c) for c in works.columns])


def tombstones(mapping: DataFrame) -> DataFrame:
    """work_id, merged_into: works that merges took away, for the registry of deleted works."""
    return final_targets(mapping).select(F.col("source").alias("work_id"), F.col("target").alias("merged_into"))


def merged_priorities(priorities: DataFrame, mapping: DataFrame) -> DataFrame:
    """project, work_id, priority after merges: each work's place in a project moves to its final target, the stronger priority stays.

    Completed is stronger than any rank, then three, two, one, none.
    """
    rank = F.when(F.col("priority") == "completed", 4).when(F.col("priority") == "three", 3).when(F.col("priority") == "two", 2).when(F.col("priority") == "one", 1).otherwise(0)
    moved = priorities.join(final_targets(mapping).select(F.col("source").alias("work_id"), "target").hint("merge"), "work_id", "left")
    return moved.select("project", F.coalesce("target", "work_id").alias("work_id"), "priority", rank.alias("_rank")).groupBy("project", "work_id").agg(F.max_by("priority", "_rank").alias("priority"))


def repoint(table: DataFrame, mapping: DataFrame, key: str = "work_id") -> DataFrame:
    """Rows of sources under their final targets, without repeats that this makes."""
    out = table.join(final_targets(mapping).select(F.col("source").alias(key), "target").hint("merge"), key, "left")
    return out.select(*[F.coalesce("target", key).alias(key) if c == key else F.col(c) for c in table.columns]).distinct()


# The categories that an empty library begins with, in order; the first is the system's own.
DEFAULT_CATEGORIES = ("Uncategorized", "Labor", "Macro", "Public", "Development", "Econometrics", "Finance", "Trade", "IO", "Political Economy")


def seeded_categories(categories: DataFrame) -> DataFrame:
    """name, sort_order, is_system: the categories there are, or the default ones where there are none."""
    seeds = categories.sparkSession.createDataFrame([(n, k, k == 0) for k, n in enumerate(DEFAULT_CATEGORIES)], "name string, sort_order int, is_system boolean")
    own = categories.select("name", F.col("sort_order").cast("int").alias("sort_order"), "is_system")
    return own.unionByName(seeds.join(categories.limit(1).select(F.lit(True).alias("_any")), F.lit(True), "left_anti"))


def split_version(works: DataFrame, versions: DataFrame, version_id: object, new_work: object) -> DataFrame:
    """The new work made of one version: its own bibliographic fields first, then the work's."""
    own = versions.where(F.col("file_version_id") == F.lit(version_id)).join(works, "work_id")
    title = F.coalesce(F.nullif("version_title", F.lit("")), F.regexp_replace("original_filename", r"(?i)\.pdf$", ""))
    return own.select(F.lit(new_work).alias("work_id"), title.alias("title"), F.coalesce("version_authors", "authors").alias("authors"), F.coalesce("version_year", "year").alias("year"), F.lit(True).alias("needs_review"))


def promote_version(versions: DataFrame, selected: object) -> DataFrame:
    """versions where the selected one is its work's only preferred one; a supplement cannot be."""
    chosen = versions.where((F.col("file_version_id") == F.lit(selected)) & (F.col("version_type") != "supplement")).select("work_id", F.lit(True).alias("_now"))
    out = versions.join(chosen, "work_id", "left")
    return out.select(*[F.when(F.col("_now"), F.col("file_version_id") == F.lit(selected)).otherwise(F.col(c)).alias(c) if c == "is_preferred" else F.col(c) for c in versions.columns])


def reset_work(works: DataFrame, versions: DataFrame, selected: Column) -> DataFrame:
    """Selected works as if just imported: bibliographic fields are cleared and the title is the preferred file's name.

    Tags, strong identifiers other than the DOI and history stay; only an open duplicate still needs a review.
    versions has work_id and original_filename of the preferred versions.
    """
    own = works.join(versions.select("work_id", F.regexp_replace("original_filename", r"(?i)\.[a-z0-9]+$", "").alias("_stem")), "work_id", "left")
    cleared = {c: F.lit(None) for c in ("year", "journal", "abstract_text", "doi", "document_type", "isbn", "publisher", "conflict_note")}
    cleared |= {"title": F.coalesce("_stem", "title"), "authors": F.lit(""), "metadata_confirmed": F.lit(False), "metadata_source": F.lit("pendingAI"), "needs_review": F.col("duplicate_of").isNotNull(), "category": F.lit("Uncategorized")}
    return own.select(*[F.when(selected, cleared[c]).otherwise(F.col(c)).alias(c) if c in cleared else F.col(c) for c in works.columns])


def mark_unindexable(documents: DataFrame, chunks: DataFrame, failures: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, failures) after the works of ``bad`` (work_id, message) could not be read.

    Their chunks go, their documents are kept as unindexable with the message, and a failure of the extraction
    stage takes the place of the one with the same key.
    """
    own = bad.groupBy("work_id").agg(F.max("message").alias("_message"))
    marked = documents.join(own, "work_id", "left")
    hit = F.col("_message").isNotNull()
    marked = marked.select(*[F.when(hit, {"status": F.lit("unindexable"), "error_message": F.col("_message")}[c]).otherwise(F.col(c)).alias(c) if c in ("status", "error_message") else F.col(c) for c in documents.columns])
    key = failure_key(F.lit("extraction"), F.lit(None).cast("string"), F.lit(None), F.col("work_id"))
    new = own.select(key.alias("key"), F.lit("extraction").alias("stage"), "work_id", F.col("_message").alias("message"))
    kept = failures.join(new.select("key"), "key", "left_anti").select(new.columns)
    return marked, remove_works(chunks, own), kept.unionByName(new)


def save_embeddings(vectors: DataFrame, failures: DataFrame, results: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """(vectors, failures) after results (chunk_id, vector) of a batch came in.

    Sound ones, of so many finite numbers that are not all zero, take the place of the chunk's old vector, at unit
    length, and clear its failures; others leave both as they are.  Of several results of a chunk the greatest counts.
    """
    unit = normalized(F.col("vector"), dimensions)
    sound = results.select("chunk_id", unit.alias("vector")).where("vector IS NOT NULL").groupBy("chunk_id").agg(F.max("vector").alias("vector"))
    return replace_rows(vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")), sound, "chunk_id"), failures.join(sound.select("chunk_id"), "chunk_id", "left_anti")


def remove_everywhere(works: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of these works (work_id)."""
    return {name: remove_works(table, works) for name, table in tables.items()}


def manual_edit(works: DataFrame, edited: Column) -> DataFrame:
    """Works after a user changed fields: the source is manual and confirmed, and a DOI that Crossref had verified is remembered."""
    remembered = F.when(F.col("verified_doi").isNull() & (F.lower("metadata_source") == "crossref"), normalized_doi(F.col("doi"))).otherwise(F.col("verified_doi"))
    now = {"verified_doi": remembered, "metadata_source": F.lit("manual"), "metadata_confirmed": F.lit(True)}
    return works.select(*[F.when(edited, now[c]).otherwise(F.col(c)).alias(c) if c in now else F.col(c) for c in works.columns])


def refresh_outcomes(works: DataFrame, answers: DataFrame, fields: list[str]) -> DataFrame:
    """works after a batch of remote lookups, with ``outcome``: updated, not found or failed.

    answers has work_id, failed and the fields; no row is not found.  Only updated works change, by the fields that were found.
    """
    own = answers.select("work_id", F.coalesce("failed", F.lit(False)).alias("_failed"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = works.join(own, "work_id", "left")
    outcome = F.when(F.col("_failed").isNull(), "not found").when(F.col("_failed"), "failed").otherwise("updated")
    take = lambda c: F.when(F.col("_failed") == F.lit(False), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c)
    return joined.select(*[take(c) if c in fields else F.col(c) for c in works.columns], outcome.alias("outcome"))


def merge_metadata(works: DataFrame, remote: DataFrame, overwrite: list[str], fill: list[str]) -> DataFrame:
    """works after remote records: unconfirmed ones take ``overwrite`` fields, all fill null ``fill`` fields.

    A confirmed work keeps its fields; conflict names the first that differs.
    """
    joined = works.join(remote.select("work_id", *[F.col(c).alias(f"_{c}") for c in [*overwrite, *fill]]), "work_id", "left")
    differs = F.coalesce(*[F.when(F.col("metadata_confirmed") & F.col(f"_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in overwrite])
    take = lambda c: F.when(F.col("metadata_confirmed"), F.col(c)).otherwise(F.coalesce(f"_{c}", c)) if c in overwrite else F.coalesce(c, f"_{c}") if c in fill else F.col(c)
    return joined.select(*[take(c).alias(c) for c in works.columns], differs.alias("conflict"))


def usage_rollup(calls: DataFrame) -> DataFrame:
    """task, tokens, cost, completed_parts: summed over planning and part calls; the last part above 0."""
    return calls.groupBy("task").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.coalesce(F.max(F.when(F.col("part") > 0, F.col("part"))), F.lit(0)).alias("completed_parts"))


def contiguous_prefix(parts: DataFrame, group: str, number: str) -> DataFrame:
    """group, completed: part n counts only after parts 1 to n - 1; repeats count once."""
    seen = parts.select(group, number).distinct()
    at = F.row_number().over(Window.partitionBy(group).orderBy(number))
    return seen.withColumn("_at", at).groupBy(group).agg(F.count_if(F.col("_at") == F.col(number)).alias("completed"))


def can_resume(status: Column, done: Column, total: Column) -> Column:
    return status.isin("failed", "cancelled") & (done > 0) & (total > done)


def swap_neighbours(rows: DataFrame, order: str, chosen: Column, offset: int) -> DataFrame:
    """rows (a dimension, so small) with the sort order of the chosen row and its neighbour exchanged."""
    w = Window.orderBy(order)
    near = rows.withColumn("_me", chosen)
    other = F.lag if offset > 0 else F.lead
    own = F.lead(order).over(w) if offset > 0 else F.lag(order).over(w)
    moved = F.when(F.col("_me") & own.isNotNull(), own).when(other("_me").over(w), other(order).over(w)).otherwise(F.col(order))
    return near.withColumn("_new", moved).drop(order, "_me").withColumnRenamed("_new", order)


def next_order(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).alias("next"))


def nest_manifest(works: DataFrame, versions: DataFrame) -> DataFrame:
    """work_id and its versions as a sorted array of structs, works without versions included."""
    own = versions.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("version_id", "status"))).alias("versions"))
    return works.join(own, "work_id", "left").withColumn("versions", F.coalesce("versions", F.array().cast("array<struct<version_id:bigint,status:string>>")))


def unnest_manifest(nested: DataFrame) -> DataFrame:
    return nested.select("work_id", F.explode("versions").alias("v")).select("work_id", "v.version_id", F.when(F.col("v.status").isin("queued", "running"), "failed").otherwise(F.col("v.status")).alias("status"))


def route_outcomes(inputs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """id, route: online, local (a fallback) or skipped, with the reasons joined."""
    joined = inputs.join(outcomes, "id", "left")
    route = F.when(F.col("online").isNotNull(), "online").when(F.col("local_problem").isNull(), "local").otherwise("skipped")
    return joined.select("id", route.alias("route"), F.when(route != "online", F.concat_ws("；", "online_problem", "local_problem")).alias("reason"))
