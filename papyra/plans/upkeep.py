"""Queries of the index's upkeep, merges, names, manifests, BibTeX files and small rules, over whole tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions import biblio, identifiers
from papyra.functions import text as tx
from papyra.functions import values as va
from papyra.operators import catalog, dedup, ledger, manifest, reconcile, state
from papyra.plans.catalogue import ORACLES, QUERIES, W, jaccard_sql, query, read, tokens_sql, works
from papyra.sources import bibtex, files
from papyra.sources.kept import kept_dir
from papyra.streaming import upkeep

__all__ = ["ORACLES", "QUERIES"]


def dealt(column, *values):
    """One of the values for each row, by the remainder of a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column % len(values) + 1).cast("int"))


def dealt_sql(column: str, *values) -> str:
    own = ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{own}][CAST({column} % {len(values)} + 1 AS BIGINT)]"


# ---- merges and names -------------------------------------------------------------------

CHAINS = """m AS (SELECT c_custkey AS source, CASE WHEN c_custkey % 25 = 7 THEN c_custkey + 1 WHEN c_custkey % 25 = 8 THEN c_custkey - 1 ELSE c_custkey // 2 END AS target FROM customer
  WHERE c_custkey % 25 IN (7, 8) OR (c_custkey % 5 IN (1, 2) AND c_custkey > 1)),
walk(source, node, path) AS (SELECT source, target, [source] FROM m UNION ALL SELECT w.source, m.target, list_append(w.path, w.node) FROM walk w JOIN m ON m.source = w.node WHERE NOT list_contains(w.path, w.node)),
stop AS (SELECT source, node, path, list_contains(path, node) AS round FROM walk w WHERE list_contains(path, node) OR node NOT IN (SELECT source FROM m)),
fin AS (SELECT source, CASE WHEN round THEN list_min(path[list_position(path, node):]) ELSE node END AS target, round, path FROM stop),
ends AS (SELECT source, target, CAST(CASE WHEN round AND list_contains(path, target) THEN list_position(path, target) - 1 ELSE len(path) END AS BIGINT) AS steps FROM fin WHERE source <> target)"""


def _chains(spark, sf_dir):
    key = F.col("c_custkey")
    target = F.when(key % 25 == 7, key + 1).when(key % 25 == 8, key - 1).otherwise(F.floor(key / 2))
    return read(spark, sf_dir, "customer").where((key % 25).isin(7, 8) | ((key % 5).isin(1, 2) & (key > 1))).select(key.alias("source"), target.alias("target"))


@query("merge_targets", f"WITH RECURSIVE {CHAINS} SELECT * FROM ends")
def merge_targets(spark, sf_dir):
    return state.final_targets(_chains(spark, sf_dir))


@query(
    "merge_chains",
    f"""WITH RECURSIVE {CHAINS}, w AS (SELECT c_custkey AS work_id, CASE WHEN c_custkey % 3 = 0 THEN '10.1/' || c_custkey END AS doi, CASE WHEN c_custkey % 4 = 1 THEN c_nationkey END AS year, CASE WHEN c_custkey % 6 = 5 THEN c_custkey // 3 END AS duplicate_of FROM customer),
d AS (SELECT target, arg_min(doi, (steps, doi)) FILTER (doi IS NOT NULL) AS doi, arg_min(year, (steps, year)) FILTER (year IS NOT NULL) AS year FROM ends JOIN w ON work_id = source GROUP BY target)
SELECT w.work_id, coalesce(w.doi, d.doi) AS doi, coalesce(w.year, d.year) AS year, CASE WHEN coalesce(e.target, w.duplicate_of) = w.work_id THEN NULL ELSE coalesce(e.target, w.duplicate_of) END AS duplicate_of
FROM w LEFT JOIN d ON d.target = w.work_id LEFT JOIN ends e ON e.source = w.duplicate_of WHERE w.work_id NOT IN (SELECT source FROM ends)""",
)
def merge_chains(spark, sf_dir):
    key = F.col("c_custkey")
    own = read(spark, sf_dir, "customer").select(key.alias("work_id"), F.when(key % 3 == 0, F.concat(F.lit("10.1/"), key)).alias("doi"), F.when(key % 4 == 1, F.col("c_nationkey")).alias("year"), F.when(key % 6 == 5, F.floor(key / 3)).alias("duplicate_of"))
    return state.merge_works(own, _chains(spark, sf_dir), ["doi", "year"])


PRIORITIES = ("three", "two", "one", "none", "completed")


@query(
    "merge_priorities",
    f"""WITH RECURSIVE {CHAINS}, p AS (SELECT c_nationkey AS project, coalesce(e.target, c_custkey) AS work_id, {dealt_sql('c_custkey', *PRIORITIES)} AS priority FROM customer LEFT JOIN ends e ON e.source = c_custkey)
SELECT project, work_id, arg_max(priority, CASE priority WHEN 'completed' THEN 4 WHEN 'three' THEN 3 WHEN 'two' THEN 2 WHEN 'one' THEN 1 ELSE 0 END) AS priority FROM p GROUP BY project, work_id""",
)
def merge_priorities(spark, sf_dir):
    own = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("work_id"), dealt(F.col("c_custkey"), *PRIORITIES).alias("priority"))
    return state.merged_priorities(own, _chains(spark, sf_dir))


STEMS = ("paper", "Paper", "paper (2)", "paper (3)", "paper (2) (2)", "paper", "study", "x" * 240, "x" * 231 + " (2)")


@query(
    "unique_names_clashes",
    f"""WITH RECURSIVE f AS (SELECT o_custkey % 400 AS folder, o_orderkey AS pos, {dealt_sql('(o_orderkey * 7 + o_custkey // 3)', *STEMS)} AS stem, row_number() OVER (PARTITION BY o_custkey % 400 ORDER BY o_orderkey) AS seq FROM orders),
a(folder, seq, pos, stem, used, name) AS (
  SELECT DISTINCT folder, 0::BIGINT, NULL::BIGINT, '', CASE WHEN folder % 2 = 0 THEN ['paper (4)'] ELSE []::VARCHAR[] END, '' FROM f
  UNION ALL
  SELECT folder, seq, pos, stem, list_append(used, lower(got)), got FROM (SELECT folder, seq, pos, stem, used, list_filter(list_transform(range(1, 300), lambda k: CASE WHEN k = 1 THEN substring(stem, 1, 235) ELSE substring(stem, 1, 235 - length(' (' || k || ')')) || ' (' || k || ')' END), lambda c: NOT list_contains(used, lower(c)))[1] AS got
    FROM (SELECT f.folder, f.seq, f.pos, f.stem, a.used FROM a JOIN f ON f.folder = a.folder AND f.seq = a.seq + 1)))
SELECT folder, pos, name || '.pdf' AS "unique" FROM a WHERE seq > 0""",
)
def unique_names_clashes(spark, sf_dir):
    """Folders of orders whose names clash with each other's numbers, with what a cut leaves of long ones, and with a note that is there already."""
    orders = read(spark, sf_dir, "orders")
    stem = dealt(F.col("o_orderkey") * 7 + F.floor(F.col("o_custkey") / 3), *STEMS)
    names = orders.select((F.col("o_custkey") % 400).alias("folder"), F.col("o_orderkey").alias("pos"), F.concat(stem, F.lit(".pdf")).alias("name"))
    there = names.where("folder % 2 = 0").select("folder", F.lit("paper (4).md").alias("name")).distinct()
    return reconcile.unique_names(names, there).select("folder", "pos", "unique")


# ---- index upkeep -----------------------------------------------------------------------

INDEXED = "d AS (SELECT doc_id AS work_id, CASE WHEN doc_id % 9 = 0 THEN 'pending' ELSE 'ready' END AS status, n_chars FROM documents)"


def _index_tables(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    documents = docs.select(F.col("doc_id").alias("work_id"), F.when(F.col("doc_id") % 9 == 0, "pending").otherwise("ready").alias("status"), F.lit(None).cast("string").alias("error_message"))
    chunks = docs.select((F.col("doc_id") * 10).alias("chunk_id"), F.col("doc_id").alias("work_id"))
    old = docs.where("doc_id % 4 = 0")
    key = state.failure_key(F.lit("extraction"), F.lit(None).cast("string"), F.lit(None), F.col("doc_id"))
    failures = old.select(key.alias("key"), F.lit("extraction").alias("stage"), F.col("doc_id").alias("work_id"), F.lit("old").alias("message"))
    bad = docs.where("n_chars < 300").select(F.col("doc_id").alias("work_id"), F.concat(F.lit("only "), "n_chars").alias("message"))
    return documents, chunks, failures, bad


@query("index_unindexable", f"WITH {INDEXED} SELECT work_id, CASE WHEN n_chars < 300 THEN 'unindexable' ELSE status END AS status, CASE WHEN n_chars < 300 THEN 'only ' || n_chars END AS error_message FROM d")
def index_unindexable(spark, sf_dir):
    return state.mark_unindexable(*_index_tables(spark, sf_dir))[0]


@query("index_failures", f"WITH {INDEXED} SELECT 'extraction|none|' || work_id AS key, 'extraction' AS stage, work_id, CASE WHEN n_chars < 300 THEN 'only ' || n_chars ELSE 'old' END AS message FROM d WHERE n_chars < 300 OR work_id % 4 = 0")
def index_failures(spark, sf_dir):
    return state.mark_unindexable(*_index_tables(spark, sf_dir))[2]


@query(
    "index_remove_works",
    "SELECT 'chunks' AS part, doc_id AS work_id FROM documents WHERE n_chars >= 300 AND source <> 'src3' UNION ALL SELECT 'vectors', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3') UNION ALL SELECT 'failures', doc_id FROM documents WHERE (n_chars < 300 OR doc_id % 4 = 0) AND source <> 'src3'",
)
def index_remove_works(spark, sf_dir):
    """Works of one source go from all of the index's tables, after those that cannot be read lost their chunks."""
    _, chunks, failures = state.mark_unindexable(*_index_tables(spark, sf_dir))
    gone = read(spark, sf_dir, "documents").where("source = 'src3'").select(F.col("doc_id").alias("work_id"))
    left = state.remove_everywhere(gone, chunks=chunks, vectors=read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("work_id")), failures=failures)
    parts = [df.select(F.lit(name).alias("part"), "work_id") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("index_without_signature", "SELECT vec_id, label % 3 AS model_signature FROM embeddings WHERE label % 3 IS DISTINCT FROM 1")
def index_without_signature(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("model_signature"))
    return state.without_signature(rows, 1)


@query("index_retry", f"WITH {INDEXED} SELECT work_id, CASE WHEN n_chars < 300 THEN 'pending' ELSE status END AS status FROM d")
def index_retry(spark, sf_dir):
    return state.retry_unindexable(state.mark_unindexable(*_index_tables(spark, sf_dir))[0]).select("work_id", "status")


UNIT = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


def _saved_embeddings(spark, sf_dir):
    """Vectors of even ids are there; a third of all comes in, some of them short, some zero."""
    rows, key = read(spark, sf_dir, "embeddings"), F.col("vec_id")
    there = rows.where(key % 2 == 0).select(key.alias("chunk_id"), F.col("embedding").alias("vector"))
    vector = F.when(key % 9 == 3, F.slice("embedding", 1, 60)).when(key % 9 == 6, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    failures = rows.where(key % 5 == 0).select(key.alias("chunk_id"), F.lit("embedding").alias("stage"))
    return state.save_embeddings(there, failures, rows.where(key % 3 == 0).select(key.alias("chunk_id"), vector.alias("vector")), 64)


@query("save_embeddings", f"SELECT vec_id AS chunk_id, round(CASE WHEN vec_id % 9 = 0 THEN embedding[1]::DOUBLE / {UNIT} ELSE embedding[1]::DOUBLE END, 9) AS first FROM embeddings WHERE vec_id % 9 = 0 OR vec_id % 2 = 0")
def save_embeddings(spark, sf_dir):
    return _saved_embeddings(spark, sf_dir)[0].select("chunk_id", F.round(F.col("vector")[0], 9).alias("first"))


@query("embedding_failures", "SELECT vec_id AS chunk_id, 'embedding' AS stage FROM embeddings WHERE vec_id % 5 = 0 AND vec_id % 9 <> 0")
def embedding_failures(spark, sf_dir):
    return _saved_embeddings(spark, sf_dir)[1]


@query("latest_versions", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def latest_versions(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return state.latest_wins(rows.where("event_id % 3 = 0"), rows.where("event_id % 3 <> 0"), ["user_id", "event_type"], "event_id")


@query("orphan_tags", "SELECT DISTINCT p_type || p_size AS tag FROM part WHERE p_type || p_size NOT IN (SELECT p_type || p_size FROM part WHERE p_partkey % 4 = 0)")
def orphan_tags(spark, sf_dir):
    own = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", "p_size").alias("tag"))
    return state.orphan_tags(own.select("tag").distinct(), own.where("p_partkey % 4 = 0"))


@query(
    "small_values",
    """SELECT event_id AS id, CASE WHEN event_id % 5 = 4 OR event_id % 7 = 4 THEN 'completed' WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'three' WHEN event_id % 5 = 1 OR event_id % 7 = 1 THEN 'two' WHEN event_id % 5 = 2 OR event_id % 7 = 2 THEN 'one' ELSE 'none' END AS priority,
  round(CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE least(1.0, (event_id % 20) / (event_id % 11)::DOUBLE) END, 9) AS done, CASE WHEN event_id % 3 = 0 AND event_id % 120 BETWEEN 1 AND 99 THEN CAST(event_id % 120 AS INTEGER) END AS parts,
  'Emile & Co ' || event_type AS plain FROM events""",
)
def small_values(spark, sf_dir):
    key = F.col("event_id")
    reply = F.when(key % 3 == 0, F.concat(F.lit(" "), key % 120, F.lit("\n"))).when(key % 3 == 1, F.concat(F.lit("about "), key % 120)).otherwise(F.concat(key % 120, F.lit(".5")))
    return read(spark, sf_dir, "events").select(
        key.alias("id"), va.merged_priority(dealt(key, *PRIORITIES), dealt(key, *PRIORITIES, "none", None)).alias("priority"), F.round(va.fraction_completed(key % 20, key % 11), 9).alias("done"),
        va.part_count_reply(reply).alias("parts"), biblio.plain_text(F.concat(F.lit("{\\'E}mile \\& \\textbf{Co}  "), "event_type")).alias("plain"),
    )


# ---- streams' rules, over tables --------------------------------------------------------


@query("retry_schedule", """WITH f AS (SELECT user_id AS item, event_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt FROM events WHERE event_type = 'error')
SELECT item, event_id, attempt, ts + to_milliseconds([2000, 5000, 12000][attempt]) AS due, attempt > 3 AS given_up FROM f""")
def retry_schedule(spark, sf_dir):
    rows = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("item"), "event_id", F.struct("ts", "event_id").alias("_order"), F.col("ts").alias("at"))
    attempt = F.row_number().over(Window.partitionBy("item").orderBy("_order"))
    out = rows.withColumn("attempt", attempt).withColumn("_delay", upkeep.retry_delay(F.col("attempt"), "fixed"))
    return out.select("item", "event_id", "attempt", F.expr("at + make_dt_interval(0, 0, 0, _delay)").alias("due"), F.col("_delay").isNull().alias("given_up"))


@query("draft_progress", """WITH p AS (SELECT conv_id AS task, turn + 1 AS part FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 2)), t AS (SELECT conv_id AS task, CAST(count(*) AS INTEGER) AS total, CAST(count(*) // 2 AS INTEGER) AS completed FROM conversations GROUP BY conv_id),
r AS (SELECT task, CAST(count(*) FILTER (rk = part) AS INTEGER) AS n FROM (SELECT task, part, row_number() OVER (PARTITION BY task ORDER BY part) AS rk FROM (SELECT DISTINCT task, part FROM p)) GROUP BY task)
SELECT t.task, total, coalesce(n, 0) AS completed, coalesce(n, 0) <> t.completed AS repaired, coalesce(n, 0) > 0 AND coalesce(n, 0) < total AS resumable FROM t LEFT JOIN r ON r.task = t.task""")
def draft_progress(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    progress = rows.groupBy(F.col("conv_id").alias("task")).agg(F.count("*").cast("int").alias("total"), F.floor(F.count("*") / 2).cast("int").alias("completed"))
    return upkeep.repair_progress(progress, rows.where("NOT (conv_id % 5 = 0 AND turn = 2)").select(F.col("conv_id").alias("task"), (F.col("turn") + 1).alias("part")))


@query("batch_budget", "WITH o AS (SELECT o_orderkey, o_orderstatus, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) SELECT CASE WHEN before >= 50000000 THEN 'skipped' WHEN o_orderstatus <> 'F' THEN 'completed' ELSE 'failed' END AS outcome, count(*) AS n FROM o GROUP BY ALL")
def batch_budget(spark, sf_dir):
    items = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").cast("decimal(18,2)").alias("cost"), (F.col("o_orderstatus") != "F").alias("ok"))
    return ledger.batch_outcomes(items, 50_000_000)


# ---- manifest ---------------------------------------------------------------------------

TAGGED = ("A", "R")


@query(
    "manifest_round_trip",
    """WITH w AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE 'Uncategorized' END AS category, o_custkey FROM orders WHERE o_orderkey % 7 <> 0)
SELECT 'work' AS part, id AS a, category AS b FROM w
UNION ALL SELECT 'version', l_orderkey * 10 + l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'failed' ELSE l_linestatus END FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_linestatus) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_linestatus FROM lineitem) JOIN w ON id = l_orderkey
UNION ALL SELECT DISTINCT 'tag', l_orderkey, l_returnflag FROM lineitem JOIN w ON id = l_orderkey
UNION ALL SELECT DISTINCT 'mark', l_orderkey, CAST(l_suppkey AS VARCHAR) FROM lineitem JOIN w ON id = l_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 5000
UNION ALL SELECT DISTINCT 'project', id, c_mktsegment FROM w JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'new category', 0, category FROM (SELECT DISTINCT category FROM w) WHERE category NOT IN ('1-URGENT', 'Uncategorized')
UNION ALL SELECT 'new tag', 0, t FROM (SELECT DISTINCT l_returnflag AS t FROM lineitem JOIN w ON id = l_orderkey) WHERE t <> 'A'
UNION ALL SELECT 'new project', 0, p FROM (SELECT DISTINCT c_mktsegment AS p FROM w JOIN customer ON c_custkey = o_custkey) WHERE p NOT IN (SELECT n_name FROM nation)""",
)
def manifest_round_trip(spark, sf_dir):
    """The library is nested into a manifest, committed over an older one, read back and restored: by name, by id, without deleted works."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    own = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("category"))
    status = F.when(F.col("l_linestatus") == "O", "queued").otherwise(F.col("l_linestatus"))
    versions = lines.groupBy(F.col("l_orderkey").alias("work_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_linestatus").alias("l_linestatus")).select("work_id", "id", status.alias("status"))
    tags = lines.select(F.col("l_orderkey").alias("work_id"), F.col("l_returnflag").alias("name")).distinct()
    marks = lines.select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("id")).distinct()
    projects = orders.join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("work_id"), F.col("c_mktsegment").alias("name"))
    root = f"{kept_dir(spark)}/papyra/manifest-{uuid.uuid4().hex}"
    manifest.commit(manifest.nest(own.limit(0), versions, tags, marks, projects), root, "2024-01-01T00-00-00Z")
    manifest.commit(manifest.nest(own, versions, tags, marks, projects), root, "2024-01-02T00-00-00Z")
    names = lambda df, c: df.select(F.col(c).alias("name")).distinct()
    known = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderpriority").alias("name")).unionByName(orders.select(F.lit("Uncategorized").alias("name"))).distinct()
    back = manifest.restore(
        manifest.current(spark, root), orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("work_id")), known, names(lines.where("l_returnflag = 'A'"), "l_returnflag"),
        names(read(spark, sf_dir, "nation"), "n_name"), read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("id")),
    )
    shape = {"works": ("work", "work_id", "category"), "versions": ("version", "id", "status"), "work_tags": ("tag", "work_id", "name"), "work_marks": ("mark", "work_id", "id"), "work_projects": ("project", "work_id", "name")}
    parts = [back[t].select(F.lit(p).alias("part"), F.col(a).alias("a"), F.col(b).cast("string").alias("b")) for t, (p, a, b) in shape.items()]
    parts += [back[t].select(F.lit(p).alias("part"), F.lit(0).cast("long").alias("a"), F.col("name").alias("b")) for t, p in (("new_categories", "new category"), ("new_tags", "new tag"), ("new_projects", "new project"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- BibTeX -----------------------------------------------------------------------------

BIB = """b AS (SELECT c_custkey AS pos, 'Key' || c_custkey AS key, CASE WHEN c_custkey % 11 = 3 THEN '' ELSE c_mktsegment || ' {Trade} & 100% of_' || c_nationkey END AS title,
  CASE WHEN c_custkey % 13 = 5 THEN '' ELSE c_name || ' Doe; Jane Roe' END AS authors, CASE WHEN c_custkey % 17 <> 2 THEN CAST(1990 + c_nationkey AS INTEGER) END AS year, CASE WHEN c_custkey % 4 <> 1 THEN c_mktsegment || ' Review' END AS journal FROM customer)"""


def _bib(spark, sf_dir):
    key = F.col("c_custkey")
    title = F.when(key % 11 == 3, "").otherwise(F.concat("c_mktsegment", F.lit(" {Trade} & 100% of_"), "c_nationkey"))
    return read(spark, sf_dir, "customer").select(key.alias("pos"), F.concat(F.lit("Key"), key).alias("key"), title.alias("title"), F.when(key % 13 == 5, "").otherwise(F.concat("c_name", F.lit(" Doe; Jane Roe"))).alias("authors"),
                                                  F.when(key % 17 != 2, (1990 + F.col("c_nationkey")).cast("int")).alias("year"), F.when(key % 4 != 1, F.concat("c_mktsegment", F.lit(" Review"))).alias("journal"))


def _rendered(rows):
    kind = biblio.entry_type(F.col("journal"), F.lit(None).cast("string"), F.when(F.col("pos") % 2 == 0, "w1"), F.lit(None).cast("string"))
    return rows.withColumn("kind", kind).select("pos", biblio.bibtex_entry(F.col("key"), F.col("kind"), F.col("title"), F.col("authors"), F.col("year"), F.col("journal"), F.lit(None).cast("string")).alias("entry"))


KIND = "CASE WHEN journal IS NOT NULL THEN 'article' WHEN pos % 2 = 0 THEN 'techreport' ELSE 'misc' END"
ESCAPED = "replace(replace(replace(replace(replace(replace(c_, '{', '\\{'), '}', '\\}'), '#', '\\#'), '&', '\\&'), '%', '\\%'), '_', '\\_')"


@query(
    "bibtex_entry",
    f"""WITH {BIB} SELECT pos, CASE WHEN title <> '' AND authors <> '' AND year IS NOT NULL THEN '@' || {KIND} || '{{' || key || ',' || chr(10) || '  title = {{' || {ESCAPED.replace('c_', 'title')} || '}},' || chr(10) ||
  '  author = {{' || {ESCAPED.replace('c_', "replace(authors, '; ', ' and ')")} || '}},' || chr(10) || '  year = {{' || year || '}}' || CASE WHEN journal IS NOT NULL THEN ',' || chr(10) || '  journal = {{' || journal || '}}' ELSE '' END || chr(10) || '}}' END AS entry FROM b""",
)
def bibtex_entry(spark, sf_dir):
    return _rendered(_bib(spark, sf_dir))


@query(
    "bibtex_parse",
    f"""WITH {BIB} SELECT {KIND} AS kind, key, {ESCAPED.replace('c_', 'title')} AS title, {ESCAPED.replace('c_', "replace(authors, '; ', ' and ')")} AS author, CAST(year AS VARCHAR) AS year, journal FROM b WHERE title <> '' AND authors <> '' AND year IS NOT NULL""",
)
def bibtex_parse(spark, sf_dir):
    """Entries of all customers are written as BibTeX files, and read and parsed back."""
    path = f"{kept_dir(spark)}/papyra/bibtex-{uuid.uuid4().hex}"
    bibtex.write_bibtex(_rendered(_bib(spark, sf_dir)), path)
    own = bibtex.read_bibtex(spark, path).select(bibtex.parse_bibtex("entry").alias("e"))
    return own.select(F.col("e")["@type"].alias("kind"), F.col("e")["@key"].alias("key"), *[F.col("e")[c].alias(c) for c in ("title", "author", "year", "journal")])


@query("bibtex_replace_key", f"""WITH {BIB}, e AS (SELECT pos, key FROM b WHERE title <> '' AND authors <> '' AND year IS NOT NULL) SELECT pos, 'New' || pos AS key FROM e""")
def bibtex_replace_key(spark, sf_dir):
    rows = _rendered(_bib(spark, sf_dir)).where("entry IS NOT NULL")
    renamed = rows.select("pos", bibtex.replace_key(F.col("entry"), F.concat(F.lit("New"), "pos")).alias("entry"))
    return renamed.select("pos", bibtex.parse_bibtex("entry")["@key"].alias("key"))


@query(
    "bibtex_diff",
    f"""WITH {BIB}, o AS (SELECT *, {dealt_sql('pos', 'same', 'title', 'authors', 'year', 'journal', 'blank')} AS edit FROM b WHERE title <> '' AND authors <> '')
SELECT pos, CASE edit WHEN 'title' THEN 'title' WHEN 'authors' THEN 'authors' WHEN 'year' THEN 'year' WHEN 'journal' THEN 'journal' ELSE '' END AS fields FROM o WHERE year IS NOT NULL AND journal IS NOT NULL""",
)
def bibtex_diff(spark, sf_dir):
    """Records against online ones that differ in one field, in none but case, or are blank where that does not count."""
    rows = _bib(spark, sf_dir).where("title <> '' AND authors <> '' AND year IS NOT NULL AND journal IS NOT NULL").withColumn("edit", dealt(F.col("pos"), "same", "title", "authors", "year", "journal", "blank"))
    is_ = lambda e: F.col("edit") == e
    online = {
        "title": F.when(is_("title"), F.concat("title", F.lit(" and more"))).when(is_("blank"), " ").otherwise(F.upper("title")), "authors": F.when(is_("authors"), "Jane Roe; Ann Other").when(is_("blank"), "").otherwise(F.lower("authors")),
        "year": F.when(is_("year"), F.col("year") + 1).otherwise(F.col("year")), "doi": F.lit("https://doi.org/10.1000/A"), "journal": F.when(is_("journal"), F.lit("Other")).otherwise(F.concat("journal", F.lit(" "))),
    }
    local = {c: F.col(c) for c in ("title", "authors", "year", "journal")} | {"doi": F.lit("10.1000/a")}
    return rows.select("pos", F.array_join(F.transform(biblio.record_differences(local, online), lambda x: x["field"]), ",").alias("fields"))


@query(
    "batch_keys",
    """WITH k AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 50 = 7 THEN c_mktsegment || c_nationkey || 'b' ELSE c_mktsegment || c_nationkey END AS key FROM customer),
r AS (SELECT pos, key, lower(key) AS low, row_number() OVER (PARTITION BY lower(key) ORDER BY pos) AS at, count(*) OVER (PARTITION BY lower(key)) AS n FROM k),
s AS (SELECT r.pos, r.key, r.n, list_filter(list_transform(range(1, 800), lambda i: CASE WHEN i <= 26 THEN chr(CAST(96 + i AS INTEGER)) ELSE chr(CAST(96 + (i - 1) // 26 AS INTEGER)) || chr(CAST(97 + (i - 1) % 26 AS INTEGER)) END), lambda x: NOT list_contains(t.every, r.low || x))[r.at] AS suffix
  FROM r, (SELECT list(DISTINCT lower(key)) AS every FROM k) t)
SELECT pos, key, CASE WHEN n > 1 THEN key || suffix ELSE key END AS "unique" FROM s""",
)
def batch_keys(spark, sf_dir):
    key = F.concat("c_mktsegment", "c_nationkey")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 50 == 7, F.concat(key, F.lit("b"))).otherwise(key).alias("key"))
    return files.unique_keys(rows).select("pos", "key", "unique")


SANE = "trim(substring(regexp_replace(trim(regexp_replace(regexp_replace(c_, '[/\\\\:*?\"<>|]', ' ', 'g'), '\\s+', ' ', 'g')), '^[. ]+|[. ]+$', '', 'g'), 1, 120))"


@query(
    "filename",
    f"""WITH p AS (SELECT p_partkey AS id, p_name || {dealt_sql('p_partkey', ': part', ' / two', '...', ' <x>')} AS title, {dealt_sql('p_partkey', 'Doe, Jane', 'Jane Doe; John Roe', 'A One; B Two; C Three', '')} AS authors, p_size AS year, p_partkey % 3 <> 0 AS confirmed, p_brand || '?.PDF' AS original FROM part)
SELECT id, CASE WHEN confirmed THEN {dealt_sql('id', 'Doe', 'Doe & Roe', 'One et al.', 'Unknown Author')} || ' - ' || year || ' - ' || {SANE.replace('c_', 'title')} || '.pdf' ELSE {SANE.replace('c_', "substring(original, 1, length(original) - 4)")} || '.pdf' END AS name FROM p""",
)
def filename(spark, sf_dir):
    title = F.concat("p_name", dealt(F.col("p_partkey"), ": part", " / two", "...", " <x>"))
    authors = dealt(F.col("p_partkey"), "Doe, Jane", "Jane Doe; John Roe", "A One; B Two; C Three", "")
    name = biblio.archive_filename(title, authors, F.col("p_size"), F.col("p_partkey") % 3 != 0, F.concat("p_brand", F.lit("?.PDF")), F.lit(""))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))


# ---- remote matches at their own thresholds ---------------------------------------------

REMOTE = f"""l AS (SELECT p_partkey AS id, p_name || ' ' || lower(p_type) || ' for the ' || lower(p_brand) AS title, 'Jane Doe; John Roe; Ann ' || p_type AS authors, CAST(2000 + p_size AS INTEGER) AS year FROM part),
c AS (SELECT id, id * 10 + k AS candidate_id, title || repeat(' extra' || k || ' word', CAST((id + k) % 4 AS INTEGER)) AS title, {dealt_sql('(id + k)', 'Doe, J.; Roe, J.', 'Someone Else', '', 'Jane Doe; John Roe; Ann Other')} AS authors, CAST(year + (id + 2 * k) % 4 - 1 AS INTEGER) AS year FROM l, (SELECT unnest(range(0, 5)) AS k)),
j AS (SELECT c.id, candidate_id, l.authors AS la, c.authors AS ca, l.year AS ly, c.year AS cy, {jaccard_sql(f"list_distinct({tokens_sql('l.title', 1)})", f"list_distinct({tokens_sql('c.title', 1)})")} AS similarity FROM c JOIN l ON l.id = c.id)"""


def _remote(spark, sf_dir):
    local = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" for the "), F.lower("p_brand")).alias("title"), F.concat(F.lit("Jane Doe; John Roe; Ann "), "p_type").alias("authors"), (2000 + F.col("p_size")).cast("int").alias("year"))
    every = local.select("id", F.col("title").alias("_t"), F.col("year").alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    more = F.repeat(F.concat(F.lit(" extra"), "k", F.lit(" word")), ((F.col("id") + F.col("k")) % 4).cast("int"))
    authors = dealt(F.col("id") + F.col("k"), "Doe, J.; Roe, J.", "Someone Else", "", "Jane Doe; John Roe; Ann Other")
    return local, every.select("id", (F.col("id") * 10 + F.col("k")).alias("candidate_id"), F.concat("_t", more).alias("title"), authors.alias("authors"), (F.col("_y") + (F.col("id") + 2 * F.col("k")) % 4 - 1).cast("int").alias("year"))


def best_sql(test: str) -> str:
    return f"WITH {REMOTE} SELECT id, candidate_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, candidate_id) AS rk FROM j WHERE similarity >= 0.72 AND abs(ly - cy) <= 1 AND {test}) WHERE rk = 1"


@query("remote_match_crossref", best_sql("(ca = '' OR " + jaccard_sql(f"list_distinct({tokens_sql('la', 1)})", f"list_distinct({tokens_sql('ca', 1)})") + " >= 0.2)"))
def remote_match_crossref(spark, sf_dir):
    return dedup.best_remote_match(*_remote(spark, sf_dir)).select("id", "candidate_id", F.round("similarity", 6).alias("similarity"))


NAMES = "list_transform(list_filter(list_transform(string_split(c_, ';'), lambda x: trim(x)), lambda x: x <> ''), lambda x: lower(CASE WHEN contains(x, ',') THEN trim(split_part(x, ',', 1)) ELSE string_split(x, ' ')[-1] END))"


@query("remote_match_surnames", best_sql("(ca = '' OR " + jaccard_sql(f"list_distinct({NAMES.replace('c_', 'la')})", f"list_distinct({NAMES.replace('c_', 'ca')})") + " >= 0.5)"))
def remote_match_surnames(spark, sf_dir):
    return dedup.surname_match(*_remote(spark, sf_dir)).select("id", "candidate_id", F.round("similarity", 6).alias("similarity"))


@query(
    "journal_match",
    f"""WITH {REMOTE}, s AS (SELECT c.id, candidate_id, {jaccard_sql(f"list_filter(list_distinct({tokens_sql('l.title')}), lambda x: x <> 'the')", f"list_filter(list_distinct({tokens_sql('c.title')}), lambda x: x <> 'the')")} AS similarity FROM c JOIN l ON l.id = c.id),
r AS (SELECT *, row_number() OVER w AS rk, lead(similarity) OVER w AS nxt FROM s WHERE similarity >= 0.72 WINDOW w AS (PARTITION BY id ORDER BY similarity DESC, candidate_id))
SELECT id, candidate_id, round(similarity, 6) AS similarity FROM r WHERE rk = 1 AND (nxt IS NULL OR similarity - nxt >= 0.08 OR similarity >= 0.98)""",
)
def journal_match(spark, sf_dir):
    local, candidates = _remote(spark, sf_dir)
    names = candidates.select("id", "candidate_id", F.array("title", F.lit("another name")).alias("names"))
    return dedup.unambiguous_journal(local.withColumnRenamed("title", "journal"), names).select("id", "candidate_id", F.round("similarity", 6).alias("similarity"))


# ---- rules over works -------------------------------------------------------------------


@query(
    "record_rules",
    f"""WITH {W}, w2 AS (SELECT *, {dealt_sql('work_id', '页码', 'other', None, ' 页码 ')} AS note, {dealt_sql('work_id', '10.1000/X', 'https://doi.org/10.1000/x', None)} AS verified, {dealt_sql('work_id', 'Crossref', 'pdf', 'ai')} AS origin, CAST(work_id % 450 AS INTEGER) AS pages, CASE WHEN work_id % 3 = 0 THEN title ELSE 'SSRN-' || work_id END AS name FROM works)
SELECT work_id, needs_review AND coalesce(trim(note) <> '页码', true) AS review, CASE WHEN verified IS NULL THEN origin = 'Crossref' ELSE work_id % 2 = 0 END AS checked, lower(name) = lower(title) OR regexp_full_match(name, '(?i)ssrn[-_ ]\\d+') AS placeholder,
  false AS skip, CASE WHEN pages > 200 THEN 60 END AS page_limit, pages > 200 AS skipped FROM w2""",
)
def record_rules(spark, sf_dir):
    """Review, Crossref check, placeholder titles and long documents, over all works."""
    key = F.col("work_id")
    rows = works(spark, sf_dir).withColumn("note", dealt(key, "页码", "other", None, " 页码 ")).withColumn("name", F.when(key % 3 == 0, F.col("title")).otherwise(F.concat(F.lit("SSRN-"), key)))
    verified, origin, doi = dealt(key, "10.1000/X", "https://doi.org/10.1000/x", None), dealt(key, "Crossref", "pdf", "ai"), F.when(key % 2 == 0, "doi:10.1000/x").otherwise("10.1000/y")
    excerpt, skip = va.long_document((key % 450).cast("int")), va.long_document((key % 450).cast("int"), policy="skip")
    return rows.select(
        "work_id", catalog.requires_review(F.col("needs_review"), F.col("note")).alias("review"), va.crossref_checked(verified, doi, origin).alias("checked"), identifiers.is_placeholder_title(F.col("name"), F.col("title")).alias("placeholder"),
        excerpt["skip"].alias("skip"), excerpt["page_limit"].alias("page_limit"), skip["skip"].alias("skipped"),
    )


@query(
    "metrics_match",
    f"""WITH {W} SELECT work_id, CASE work_id % 4 WHEN 0 THEN coalesce(doi = '10.1000/' || (work_id // 8 * 8), false) WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS valid FROM works""",
)
def metrics_match(spark, sf_dir):
    """Metrics asked for by a DOI, by the same journal in another writing, by another journal, and by nothing."""
    key = F.col("work_id")
    asked_doi = F.when(key % 4 == 0, F.concat(F.lit("10.1000/"), F.floor(key / 8) * 8))
    asked = F.when(key % 4 == 1, F.upper(F.concat(F.lit("The: Journal, "), "category"))).when(key % 4 == 2, "Another")
    return works(spark, sf_dir).select("work_id", va.metrics_match(asked_doi, asked, F.col("doi"), F.concat(F.lit("the  journal "), "category")).alias("valid"))


@query("manual_edit", f"WITH {W} SELECT work_id, CASE WHEN work_id % 2 = 0 AND work_id % 3 = 0 THEN doi END AS verified_doi, CASE WHEN work_id % 2 = 0 THEN 'manual' ELSE {dealt_sql('work_id', 'CrossRef', 'ai', 'pdf')} END AS metadata_source, work_id % 2 = 0 AS metadata_confirmed FROM works")
def manual_edit(spark, sf_dir):
    rows = works(spark, sf_dir).select("work_id", "doi", F.lit(None).cast("string").alias("verified_doi"), dealt(F.col("work_id"), "CrossRef", "ai", "pdf").alias("metadata_source"), F.lit(False).alias("metadata_confirmed"))
    return state.manual_edit(rows, F.col("work_id") % 2 == 0).drop("doi")


@query("refresh_outcomes", f"WITH {W} SELECT work_id, CASE WHEN work_id % 3 = 1 AND work_id % 6 <> 4 THEN 'Remote ' || work_id ELSE title END AS title, CASE work_id % 3 WHEN 0 THEN 'not found' WHEN 1 THEN 'updated' ELSE 'failed' END AS outcome FROM works")
def refresh_outcomes(spark, sf_dir):
    own = works(spark, sf_dir).select("work_id", "title")
    key = F.col("work_id")
    answers = own.where("work_id % 3 <> 0").select("work_id", (key % 3 == 2).alias("failed"), F.when(key % 6 != 4, F.concat(F.lit("Remote "), key)).alias("title"))
    return state.refresh_outcomes(own, answers, ["title"])


@query("reset_records", f"WITH {W} SELECT work_id, CASE WHEN tag = 'fr' THEN 'file ' || work_id ELSE title END AS title, CASE WHEN tag <> 'fr' THEN doi END AS doi, CASE WHEN tag <> 'fr' THEN year END AS year, CASE WHEN tag = 'fr' THEN duplicate_of IS NOT NULL ELSE needs_review END AS needs_review, CASE WHEN tag = 'fr' THEN 'Uncategorized' ELSE category END AS category, tag FROM works")
def reset_records(spark, sf_dir):
    own = works(spark, sf_dir).select("work_id", "title", "doi", "year", "needs_review", "category", "tag", "duplicate_of")
    versions = own.select("work_id", F.concat(F.lit("file "), "work_id", F.lit(".PDF")).alias("original_filename"))
    return state.reset_work(own, versions, F.col("tag") == "fr").drop("duplicate_of")


@query("path_normalization", "SELECT o_orderkey AS id, o_orderkey % 4 <> 1 AS moves FROM orders")
def path_normalization(spark, sf_dir):
    key = F.col("o_orderkey")
    path = F.when(key % 4 == 0, F.concat("o_orderpriority", F.lit("/x.pdf"))).when(key % 4 == 1, F.concat(F.lit("lib/"), "o_orderpriority", F.lit("/"), F.year("o_orderdate"), F.lit("/folder/x.pdf"))).when(key % 4 == 2, F.concat(F.lit("other/"), F.year("o_orderdate"), F.lit("/folder/x.pdf"))).otherwise(F.concat("o_orderpriority", F.lit("/1900/folder/x.pdf")))
    return read(spark, sf_dir, "orders").select(key.alias("id"), identifiers.needs_path_normalization(path, F.col("o_orderpriority"), F.year("o_orderdate").cast("string"), F.lit("folder"), F.lit("x.pdf")).alias("moves"))


@query("resumable_notes", "SELECT l_orderkey, l_linenumber, l_linestatus = 'F' AND l_linenumber > 1 AND 7 > l_linenumber AS can FROM lineitem")
def resumable_notes(spark, sf_dir):
    status = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_orderkey") % 2 == 0, "failed").otherwise("cancelled")).otherwise("running")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", state.can_resume(status, F.col("l_linenumber") - 1, F.lit(6)).alias("can"))


TYPES = ("published", "workingPaper", "acceptedManuscript", "preprint", "supplement", "annotatedCopy", "odd", None)


@query(
    "type_names",
    f"""SELECT p_partkey AS id, {dealt_sql('p_partkey', '正式发表版', '工作论文', '录用稿', '预印本', '补充材料', '带标注副本', '其他版本', '其他版本')} AS label, {dealt_sql('p_partkey', 'published 发表版', 'working paper 工作论文', 'accepted manuscript 录用稿', 'preprint 预印本', 'supplement 补充材料', 'annotated copy 批注副本', 'odd', None)} AS version,
  {dealt_sql('p_partkey', 'article 期刊论文', 'thesis 学位论文', 'novel', '')} AS document, list_filter([{dealt_sql('p_partkey', 'NBER w1', None)}, {dealt_sql('p_partkey', None, 'SSRN 12 3', None)}, {dealt_sql('p_partkey', None, None, 'arXiv 1', 'arXiv 2')}, 'RePEc ' || p_name], lambda x: x IS NOT NULL) AS notes,
  CASE WHEN p_size % 2 = 0 THEN '第 ' || p_size || ' 页' ELSE '第 ' || p_size || '–' || (p_size + 1) || ' 页' END AS pages FROM part""",
)
def type_names(spark, sf_dir):
    key = F.col("p_partkey")
    notes = biblio.identifier_notes(dealt(key, "w1", None), dealt(key, " ", "12\n3", None), dealt(key, None, "", "1", "2"), F.col("p_name"))
    return read(spark, sf_dir, "part").select(
        key.alias("id"), biblio.version_label(dealt(key, *TYPES)).alias("label"), biblio.version_type_name(dealt(key, *TYPES)).alias("version"), biblio.document_type_name(dealt(key, "article", "thesis", "novel", None)).alias("document"),
        notes.alias("notes"), va.page_description(F.col("p_size"), F.col("p_size") + F.col("p_size") % 2).alias("pages"),
    )


NATURAL = "list_aggregate(list_transform(regexp_extract_all(strip_accents(lower(c_)), '(\\d+|\\D+)'), lambda r: CASE WHEN regexp_matches(r, '^\\d') THEN lpad(CAST(length(regexp_replace(r, '^0+(\\d)', '\\1')) AS VARCHAR), 3, '0') || regexp_replace(r, '^0+(\\d)', '\\1') ELSE r END), 'string_agg', '')"


@query(
    "natural_tags",
    f"""WITH t AS (SELECT p_partkey AS id, [p_name || ' ' || (p_partkey % 30), upper(p_name) || '  ' || (p_partkey % 30), 'Étape 10', 'etape 9', ' étape 100 ', p_type || p_size, ''] AS tags FROM part),
c AS (SELECT id, list_filter(list_transform(tags, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS c FROM t),
f AS (SELECT id, unnest(list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: lower(y)), lower(x)) = i)) AS v FROM c)
SELECT id, string_agg(v, '|' ORDER BY {NATURAL.replace('c_', 'v')}, v) AS tags FROM f GROUP BY id""",
)
def natural_tags(spark, sf_dir):
    key = F.col("p_partkey")
    tags = F.array(F.concat("p_name", F.lit(" "), key % 30), F.concat(F.upper("p_name"), F.lit("  "), key % 30), F.lit("Étape 10"), F.lit("etape 9"), F.lit(" étape 100 "), F.concat("p_type", "p_size"), F.lit(""))
    return read(spark, sf_dir, "part").select(key.alias("id"), F.array_join(tx.natural_tags(tags), "|").alias("tags"))


@query("library_sort_natural", f"SELECT p_partkey AS id, row_number() OVER (ORDER BY {NATURAL.replace('c_', 't')}, p_partkey) AS position FROM (SELECT p_partkey, p_name || ' part ' || (p_partkey * 37 % 2000) AS t FROM part)")
def library_sort_natural(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.natural_key(F.concat("p_name", F.lit(" part "), F.col("p_partkey") * 37 % 2000)).alias("_key"))
    return catalog.positions(rows, [F.col("_key").asc(), F.col("id").asc()]).select("id", "position")


@query("smart_list_codec", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'category' WHEN 1 THEN 'project' WHEN 2 THEN 'aiQueue' END AS kind, CASE WHEN o_orderkey % 5 < 2 THEN upper(substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) || '-0000-4000-8000-' || substring(md5(CAST(o_orderkey AS VARCHAR)), 9, 12)) END AS key FROM orders")
def smart_list_codec(spark, sf_dir):
    key, h = F.col("o_orderkey"), F.md5(F.col("o_orderkey").cast("string"))
    own = F.concat(F.substring(h, 1, 8), F.lit("-0000-4000-8000-"), F.substring(h, 9, 12))
    value = va.smart_list_value(dealt(key, "category", "project", "aiQueue", "nothing", "category"), F.when(key % 5 == 4, "no uuid").otherwise(own))
    found = va.smart_list_of(value)
    return read(spark, sf_dir, "orders").select(key.alias("id"), found["kind"].alias("kind"), found["key"].alias("key"))


@query("costs_and_stamps", "SELECT event_id AS id, round(event_id / 1e6 * 0.3 + 500 / 1e6 * 2.5, 9) AS cost, round(event_id / 1e6 * 0.3 + 8192 / 1e6 * 2.5, 9) AS most, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') AS stamp, regexp_full_match(event_type || '-' || user_id || CASE WHEN event_id % 3 = 0 THEN '_' ELSE '' END, '[A-Za-z0-9-]{1,128}') AS valid FROM events")
def costs_and_stamps(spark, sf_dir):
    name = F.concat("event_type", F.lit("-"), "user_id", F.when(F.col("event_id") % 3 == 0, "_").otherwise(""))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(va.card_cost(F.col("event_id"), F.lit(500), 0.3, 2.5), 9).alias("cost"), F.round(va.largest_cost(F.col("event_id"), 0.3, 2.5), 9).alias("most"), files.stamp(F.col("ts")).alias("stamp"), identifiers.valid_workspace_id(name).alias("valid"))


@query("note_lists", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'a；b' ELSE 'a；b；late' END AS added, CASE WHEN o_orderstatus = 'F' THEN 'a；b' ELSE 'a' END AS removed FROM orders")
def note_lists(spark, sf_dir):
    notes = F.when(F.col("o_orderstatus") == "F", " a ；；b").otherwise("a；late； b")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", tx.edit_issue_notes(notes, "none", False)).otherwise(tx.edit_issue_notes(notes, "late", True)).alias("added"), F.when(F.col("o_orderstatus") == "F", tx.edit_issue_notes(notes, "x", False)).otherwise(tx.edit_issue_notes(tx.edit_issue_notes(notes, "late", False), "b", False)).alias("removed"))


@query("valid_parts", "SELECT conv_id, turn, turn % 3 = 0 AS valid FROM conversations")
def valid_parts(spark, sf_dir):
    """Texts under one heading with their number, under two, and under another number."""
    head = lambda n: F.concat(F.lit("# Part "), n.cast("string"), F.lit("\n"))
    turn = F.col("turn") + 1
    body = F.concat(F.lit("## Sub\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^#", "-"))
    text = F.when(F.col("turn") % 3 == 0, F.concat(head(turn), body)).when(F.col("turn") % 3 == 1, F.concat(head(turn), body, F.lit("\n"), head(turn))).otherwise(F.concat(head(turn + 1), body))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", va.is_valid_part(text, turn).alias("valid"))


@query("unused_tags", "SELECT DISTINCT l_returnflag || l_linenumber AS tag FROM lineitem WHERE l_returnflag || l_linenumber NOT IN (SELECT l_returnflag || l_linenumber FROM lineitem WHERE l_orderkey = 1)")
def unused_tags(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.concat("l_returnflag", "l_linenumber").alias("tag"))
    return state.unused(lines.select("tag").distinct(), lines, 1, "tag")


@query("first_source", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'doi ' || c_name WHEN c_custkey % 2 = 0 THEN 'scholar ' || c_name END AS entry FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def first_source(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    a = rows.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("doi "), "c_name").alias("entry"))
    b = rows.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("scholar "), "c_name").alias("entry"))
    return files.first_source(a, b, key="id", value="entry")


@query("companion_files", "SELECT o_orderkey AS id, 'lib/' || o_orderkey || '.md' AS note, 'lib/' || o_orderkey || '.assets' AS assets FROM orders")
def companion_files(spark, sf_dir):
    own = reconcile.companion_paths(F.concat(F.lit("lib/"), "o_orderkey", F.lit(".PDF")))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), own["note"].alias("note"), own["assets"].alias("assets"))


@query("metadata_text", f"WITH {W} SELECT work_id, concat_ws(chr(10), nullif(title, ''), nullif(abstract_text, ''), CAST(year AS VARCHAR), doi) AS text FROM works")
def metadata_text(spark, sf_dir):
    return works(spark, sf_dir).select("work_id", catalog.metadata_text(F.col("title"), F.col("abstract_text"), F.col("year"), F.col("doi")).alias("text"))


@query("palette", "WITH RECURSIVE p AS (SELECT p_partkey AS id, p_name || p_type AS name, 0::BIGINT AS h, 0 AS i FROM part UNION ALL SELECT id, name, (h * 31 + ascii(substring(name, i + 1, 1))) & 2147483647, i + 1 FROM p WHERE i < length(name)) SELECT id, CAST(h % 6 AS BIGINT) AS colour FROM p WHERE i = length(name)")
def palette(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.palette_index(F.concat("p_name", "p_type")).alias("colour"))


@query("evidence_counts", "SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_returnflag <> 'N')::INT + (l_linestatus = 'F')::INT + 1 AS INTEGER) AS fields FROM lineitem")
def evidence_counts(spark, sf_dir):
    fields = va.evidence_fields(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.when(F.col("l_linestatus") == "F", F.lit("F")), F.lit("always"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.size(fields).alias("fields"))


@query("author_lists", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Jane ' || c_name || '; Roe' ELSE 'Roe' END AS authors FROM customer")
def author_lists(spark, sf_dir):
    person = lambda given, family: F.struct(given.alias("given"), family.alias("family"))
    one, two = person(F.lit("Jane"), F.col("c_name")), person(F.lit(None).cast("string"), F.lit("Roe"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), va.author_list(F.when(F.col("c_custkey") % 2 == 0, F.array(one, two)).otherwise(F.array(two))).alias("authors"))


@query(
    "seed_categories",
    """SELECT 'full' AS library, n_name AS name, n_nationkey AS sort_order, false AS is_system FROM nation
UNION ALL SELECT 'empty', * FROM (VALUES ('Uncategorized', 0, true), ('Labor', 1, false), ('Macro', 2, false), ('Public', 3, false), ('Development', 4, false), ('Econometrics', 5, false), ('Finance', 6, false), ('Trade', 7, false), ('IO', 8, false), ('Political Economy', 9, false)) v""",
)
def seed_categories(spark, sf_dir):
    there = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("sort_order"), F.lit(False).alias("is_system"))
    parts = [state.seeded_categories(df).select(F.lit(kind).alias("library"), "name", "sort_order", "is_system") for kind, df in (("full", there), ("empty", there.where("sort_order < 0")))]
    return parts[0].unionByName(parts[1])


# ---- fingerprints and stored vectors, by SQL --------------------------------------------

HALF = "2.0 ** (greatest(CAST(floor(log2(abs(x::DOUBLE))) AS INTEGER), -14) - 10)"
ORACLES["vector_half_precision"] = f"SELECT vec_id, list_transform(embedding, lambda x: CAST(CASE WHEN x = 0 THEN 0 ELSE round_even(x::DOUBLE / {HALF}, 0) * {HALF} END AS FLOAT)) AS stored FROM embeddings"

BITS = range(64)
PRINTS = f"""t AS (SELECT doc_id, unnest(list_filter({tokens_sql('text')}, lambda x: length(x) > 2)[1:50000]) AS term FROM documents),
w AS (SELECT term, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, strlen(term)), lambda k: ('0x' || substring(hex(encode(term)), CAST(2 * k + 1 AS BIGINT), 2))::UHUGEINT)), lambda h, b: xor(h, b) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM (SELECT DISTINCT term FROM t)),
v AS (SELECT doc_id, {', '.join(f'sum(CASE WHEN (h >> {b}) & 1 = 1 THEN n ELSE -n END) AS b{b}' for b in BITS)} FROM (SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term) JOIN w USING (term) GROUP BY doc_id),
f AS (SELECT d.doc_id, CASE WHEN v.doc_id IS NOT NULL THEN lower(lpad(to_hex(({' + '.join(f'(b{b} >= 0)::UHUGEINT * {2**b}::UHUGEINT' for b in BITS)})::UBIGINT), 16, '0')) END AS fingerprint FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id)"""
ORACLES["simhash64"] = f"WITH {PRINTS} SELECT * FROM f"
ORACLES["simhash_near_dups"] = f"WITH {PRINTS} SELECT f.doc_id, g.first FROM f JOIN (SELECT fingerprint, min(doc_id) AS first FROM f GROUP BY fingerprint) g ON g.fingerprint = f.fingerprint WHERE f.doc_id <> g.first"


# ---- duplicates by all steps ------------------------------------------------------------

RECORDS = f"""r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 1 THEN 'copy' || p_size ELSE 'file' || p_partkey END AS sha, CASE WHEN p_partkey % 30 = 2 THEN '10.1/' || p_size END AS doi,
  CASE WHEN p_partkey % 4 <> 3 THEN substring(md5(p_name || p_partkey // 12), 1, 16) END AS fp, p_name || ' of ' || lower(p_type) || ' ' || lower(p_brand) AS title, p_brand || ' Doe' AS authors, CASE WHEN p_partkey % 9 <> 4 THEN CAST(1990 + p_size AS INTEGER) END AS year FROM part),
x AS (SELECT *, list_distinct({tokens_sql('title', 1)}) AS t, list_distinct({tokens_sql('authors', 1)}) AS a FROM r), lib AS (SELECT * FROM x WHERE id % 3 = 0), imp AS (SELECT * FROM x WHERE id % 3 <> 0)"""


@query(
    "dup_cascade_titles",
    f"""WITH {RECORDS}, s AS (SELECT imp.id, lib.id AS other, 0.55 * {jaccard_sql('imp.t', 'lib.t')} + 0.20 * {jaccard_sql('imp.a', 'lib.a')} + 0.10 * CASE WHEN imp.year IS NULL OR lib.year IS NULL THEN 0.4 WHEN abs(imp.year - lib.year) <= 1 THEN 1.0 ELSE 0.0 END
  + 0.15 * CASE WHEN imp.fp IS NULL OR lib.fp IS NULL THEN 0.0 ELSE 1 - bit_count(xor(('0x' || imp.fp)::UBIGINT, ('0x' || lib.fp)::UBIGINT)) / 64.0 END AS score FROM imp, lib),
b AS (SELECT id, first(other ORDER BY score DESC, other) AS other FROM (SELECT id, other, round(score, 9) AS score FROM s WHERE score >= 0.66 - 1e-12) GROUP BY id),
g AS (SELECT imp.id, (SELECT min(id) FROM lib WHERE lib.sha = imp.sha) AS sha, (SELECT min(id) FROM lib WHERE lib.doi = imp.doi) AS doi, (SELECT min(id) FROM lib WHERE lib.fp = imp.fp) AS fp, b.other FROM imp LEFT JOIN b ON b.id = imp.id)
SELECT id, CASE WHEN sha IS NOT NULL THEN 'exactFile' WHEN doi IS NOT NULL THEN 'possibleDuplicate' WHEN fp IS NOT NULL THEN 'sameWork' WHEN other IS NOT NULL THEN 'similar' ELSE 'newWork' END AS decision, coalesce(sha, doi, fp, other) AS matched FROM g""",
)
def dup_cascade_titles(spark, sf_dir):
    """All five decisions: equal files, equal DOIs, equal fingerprints, similar records and new works."""
    key = F.col("p_partkey")
    none = lambda c: F.lit(None).cast("string").alias(c)
    own = read(spark, sf_dir, "part").select(
        key.alias("id"), key.alias("pos"), F.when(key % 40 == 1, F.concat(F.lit("copy"), "p_size")).otherwise(F.concat(F.lit("file"), key)).alias("sha256"), F.when(key % 30 == 2, F.concat(F.lit("10.1/"), "p_size")).alias("doi"), none("nber"), none("ssrn"), none("arxiv"), none("repec"),
        F.when(key % 4 != 3, F.substring(F.md5(F.concat("p_name", F.floor(key / 12))), 1, 16)).alias("fingerprint"), F.concat("p_name", F.lit(" of "), F.lower("p_type"), F.lit(" "), F.lower("p_brand")).alias("title"), F.concat("p_brand", F.lit(" Doe")).alias("authors"),
        F.when(key % 9 != 4, (1990 + F.col("p_size")).cast("int")).alias("year"),
    )
    return dedup.duplicate_cascade(own.where("id % 3 <> 0"), own.where("id % 3 = 0"))


@query(
    "duplicate_versions_doi",
    """WITH w AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN '10.1/' || c_nationkey || '.' || c_custkey // 60 END AS doi, c_mktsegment || c_custkey // 40 AS title, CAST(1990 + c_nationkey AS INTEGER) AS year, CASE WHEN c_custkey % 8 = 5 THEN c_custkey // 2 END AS duplicate_of FROM customer)
SELECT DISTINCT least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id FROM w a JOIN w b ON a.id <> b.id AND (a.doi = b.doi OR a.duplicate_of = b.id OR (a.title = b.title AND abs(a.year - b.year) <= 1))""",
)
def duplicate_versions_doi(spark, sf_dir):
    key = F.col("c_custkey")
    own = read(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 3 != 0, F.concat(F.lit("10.1/"), "c_nationkey", F.lit("."), F.floor(key / 60))).alias("doi"), F.concat("c_mktsegment", F.floor(key / 40)).alias("title"), (1990 + F.col("c_nationkey")).cast("int").alias("year"), F.when(key % 8 == 5, F.floor(key / 2)).alias("duplicate_of"))
    return dedup.duplicate_versions(own)


@query("promote_supplement", "SELECT l_orderkey AS work_id, l_orderkey * 10 + l_linenumber AS file_version_id, l_linenumber = 1 AS is_preferred FROM lineitem")
def promote_supplement(spark, sf_dir):
    """A supplement cannot be preferred: choosing one changes nothing."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_version_id"), F.lit("supplement").alias("version_type"), (F.col("l_linenumber") == 1).alias("is_preferred"))
    return state.promote_version(rows, 12).select("work_id", "file_version_id", "is_preferred")
