"""The registered queries of the document library, each with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.operators import catalog, fts, retrieval, search
from papyra.operators.chunking import chunk_pages
from papyra.operators.index import KeptIndex
from papyra.sources.kept import changed_at, kept_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STATUSES = ("completed", "failed", "queued", "running", "cancelled")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the works of a library, with review flags from labels."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    status = F.element_at(F.array(*[F.lit(s) for s in (*STATUSES, None)]), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("work_id"), F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), "text", F.col("lang").alias("tag"), F.col("source").alias("category"),
        (2000 + F.col("doc_id") % 25).cast("int").alias("year"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("needs_review"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("has_annotations"),
        (1 + F.col("doc_id") % 3).cast("int").alias("version_count"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("10.1000/"), F.col("doc_id"))).alias("doi"),
        status.alias("latest_status"), F.when(F.col("doc_id") % 11 == 10, F.col("doc_id") - 1).alias("duplicate_of"), F.concat(F.col("lang"), F.lit(" "), F.col("source")).alias("abstract_text"),
        F.element_at(F.array(*[F.lit(p) for p in ("three", "two", "one", "none", "completed")]), (F.col("doc_id") % 5 + 1).cast("int")).alias("priority"),
    )


W = """works AS (SELECT d.doc_id AS work_id, trim(split_part(d.text, chr(10), 1)) AS title, d.text, d.lang AS tag, d.source AS category,
  CAST(2000 + d.doc_id % 25 AS INTEGER) AS year, coalesce(l.quality = 0, false) AS needs_review, coalesce(l.toxic = 1, false) AS has_annotations,
  CAST(1 + d.doc_id % 3 AS INTEGER) AS version_count, CASE WHEN d.doc_id % 4 <> 0 THEN '10.1000/' || d.doc_id END AS doi,
  CASE d.doc_id % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'queued' WHEN 3 THEN 'running' WHEN 4 THEN 'cancelled' END AS latest_status,
  CASE WHEN d.doc_id % 11 = 10 THEN d.doc_id - 1 END AS duplicate_of, d.lang || ' ' || d.source AS abstract_text,
  CASE d.doc_id % 5 WHEN 0 THEN 'three' WHEN 1 THEN 'two' WHEN 2 THEN 'one' WHEN 3 THEN 'none' ELSE 'completed' END AS priority
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
FOLD = "strip_accents(lower({}))"


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace({FOLD.format(c)}, '\\s+', ' ', 'g'))"


def tokens_sql(c: str, longer_than: int = 0) -> str:
    return f"list_filter(regexp_split_to_array({FOLD.format(c)}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > {longer_than})"


def jaccard_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END)"


# ---- full-text search -------------------------------------------------------------------


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("work_id"), "text")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cut into passages: chunk_id is the work's id and the passage's number, from 1,000,000 apart."""
    pages = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return chunk_pages(pages).select((F.col("doc_id") * 1_000_000 + F.col("ordinal")).alias("chunk_id"), F.col("doc_id").alias("work_id"), "text")


def index_place(spark: SparkSession, sf_dir: str, name: str) -> KeptIndex:
    """Where an index of the table's present files is kept, built or not."""
    told = f"{spark.sparkContext.applicationId} {sf_dir} {changed_at(spark, f'{sf_dir}/documents.parquet')}"
    return KeptIndex(spark, f"{kept_dir(spark)}/papyra/index-{name}-{hashlib.sha256(told.encode()).hexdigest()[:24]}")


def kept_index(spark: SparkSession, sf_dir: str, name: str, rows: Callable[[SparkSession, str], DataFrame]) -> KeptIndex:
    """The index of a table's chunks, kept in the shared folder and built again only when the table's files change."""
    index = index_place(spark, sf_dir, name)
    if not index.generations():
        index.update(rows(spark, sf_dir))
    return index


def text_index(spark: SparkSession, sf_dir: str) -> KeptIndex:
    return kept_index(spark, sf_dir, "texts", chunks)


def bm25_sql(query_text: str, mode: str, limit: int | None, cap: int | None = None, scope: str = "true") -> str:
    match = fts.match_expression(query_text, mode)
    tf = ", ".join(f"CAST((length(j) - length(replace(j, ' {'  '.join(p)} ', ''))) / {len('  '.join(p)) + 2} AS INTEGER) AS tf{i}" for i, p in enumerate(match.phrases))
    idf = ", ".join(f"greatest(ln((count(*) - count(*) FILTER (tf{i} > 0) + 0.5) / (count(*) FILTER (tf{i} > 0) + 0.5)), 1e-6) AS idf{i}" for i in range(len(match.phrases)))
    score = " + ".join(f"idf{i} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(match.phrases)))
    tests, at = [], 0
    for g in match.groups:
        tests.append("(" + " AND ".join(f"tf{i} > 0" for i in range(at, at + len(g))) + ")")
        at += len(g)
    test = (" AND " if match.every else " OR ").join(tests)
    ranked = f"SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY s DESC, chunk_id) AS rk FROM (SELECT t.*, {score} AS s FROM t, st WHERE ({test}) AND {scope})"
    where = f"WHERE rk <= {cap}" if cap else ""
    return f"""WITH b AS (SELECT doc_id AS chunk_id, source AS work_id, text, {tokens_sql('text')} AS own FROM documents),
t AS (SELECT chunk_id, work_id, text, len(own) AS dl, {tf} FROM (SELECT *, ' ' || array_to_string(own, '  ') || ' ' AS j FROM b)),
st AS (SELECT avg(dl) AS avgdl, {idf} FROM t), hits AS (SELECT * FROM ({ranked}) {where} ORDER BY s DESC, chunk_id {f'LIMIT {limit}' if limit else ''})
SELECT work_id, chunk_id, round(s, 6) AS relevance FROM hits"""


ANY, ALL, PHRASE = "idiot worthless loser", "idiot the loser", '"of the"'
_hits = lambda df: df.select("work_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


@query("index_build", f"SELECT count(*) AS chunks, CAST(sum(len(own)) AS BIGINT) AS tokens, CAST(sum(len(list_distinct(own))) AS BIGINT) AS postings FROM (SELECT {tokens_sql('text')} AS own FROM documents)")
def index_build(spark, sf_dir):
    """What the kept index of all texts holds; the first call of a session builds it."""
    index = text_index(spark, sf_dir)
    n, tokens = index.size()
    return index.live("postings").agg(F.count("*").alias("postings")).select(F.lit(n).alias("chunks"), F.lit(tokens).alias("tokens"), "postings")


@query("fts_any_term_topk", bm25_sql(ANY, "anyTerm", 100))
def fts_any_term_topk(spark, sf_dir):
    return _hits(text_index(spark, sf_dir).search(ANY, "anyTerm", 100))


@query("fts_exact_phrase", bm25_sql(PHRASE, "exactPhrase", 100))
def fts_exact_phrase(spark, sf_dir):
    return _hits(text_index(spark, sf_dir).search(PHRASE, "exactPhrase", 100))


@query("fts_all_terms_query", bm25_sql(ALL, "allTerms", 100))
def fts_all_terms_query(spark, sf_dir):
    return _hits(text_index(spark, sf_dir).search(ALL, "allTerms", 100))


@query("fts_scoped_capped", bm25_sql(ANY, "anyTerm", 50, 3, "work_id IN ('src1', 'src2', 'src3', 'src4')"))
def fts_scoped_capped(spark, sf_dir):
    allowed = chunks(spark, sf_dir).where(F.col("work_id").isin("src1", "src2", "src3", "src4")).select("work_id")
    return _hits(text_index(spark, sf_dir).search(ANY, "anyTerm", 50, allowed, 3))


@query(
    "fts_all_terms",
    f"""WITH h AS ({bm25_sql(ALL, 'anyTerm', 240)}), w AS (SELECT h.work_id, string_agg({norm_sql('d.text')}, ' ') AS whole FROM h JOIN documents d ON d.doc_id = h.chunk_id GROUP BY h.work_id)
SELECT h.* FROM h JOIN w ON h.work_id = w.work_id WHERE contains(whole, 'idiot') AND contains(whole, 'the') AND contains(whole, 'loser')""",
)
def fts_all_terms(spark, sf_dir):
    return _hits(text_index(spark, sf_dir).search_all_terms(ALL))


@query(
    "fts_work_matches",
    f"""WITH h AS ({bm25_sql(ANY, 'anyTerm', 100)}), r AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY relevance DESC, chunk_id) AS rk FROM h)
SELECT work_id, max(relevance) AS score, list(chunk_id ORDER BY rk) AS passages FROM r WHERE rk <= 3 GROUP BY work_id""",
)
def fts_work_matches(spark, sf_dir):
    return fts.work_matches(_hits(text_index(spark, sf_dir).search(ANY, "anyTerm", 100)))


@query("fts_postings", bm25_sql(ANY, "anyTerm", 100))
def fts_postings(spark, sf_dir):
    """The same rows from an index that was built of other texts and then brought up to date, works added, changed and taken away."""
    now = chunks(spark, sf_dir)
    index = index_place(spark, sf_dir, "texts-updated")
    if not index.generations():
        odd = F.pmod(F.xxhash64("work_id"), F.lit(4))
        old = now.where(odd < 3).withColumn("text", F.when(odd == 0, F.concat(F.lit("worthless stale words "), "text")).otherwise(F.col("text")))
        index.update(old.unionByName(now.where(odd == 1).withColumn("work_id", F.concat(F.lit("gone"), "work_id")).withColumn("chunk_id", -1 - F.col("chunk_id"))))
        index.sync(now)
    return _hits(index.search(ANY, "anyTerm", 100))


@query(
    "postings_index",
    f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term",
)
def postings_index(spark, sf_dir):
    return text_index(spark, sf_dir).live("postings").groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf"))


# ---- vectors and fusion -----------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("work_id"), F.col("embedding").alias("vector"))


def probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in read(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]]


DOT = "list_sum(list_transform(list_zip(e.embedding, q.v), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
PROBE = "q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)"


@query("vector_topk", f"WITH {PROBE} SELECT label AS work_id, vec_id AS chunk_id, round(s, 6) AS score FROM (SELECT e.*, {DOT} AS s FROM embeddings e, q) ORDER BY s DESC, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    return retrieval.vector_topk(vectors(spark, sf_dir), probe(spark, sf_dir), 20, None).withColumn("score", F.round("score", 6))


@query(
    "vector_topk_capped",
    f"WITH {PROBE}, s AS (SELECT e.*, {DOT} AS s FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rk FROM s) SELECT label AS work_id, vec_id AS chunk_id, round(s, 6) AS score FROM r WHERE rk <= 2 ORDER BY s DESC, vec_id LIMIT 15",
)
def vector_topk_capped(spark, sf_dir):
    return retrieval.vector_topk(vectors(spark, sf_dir), probe(spark, sf_dir), 15, 2).withColumn("score", F.round("score", 6))


@query("vector_cosine", f"WITH {PROBE} SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]), 6) AS cosine FROM embeddings e, q")
def vector_cosine(spark, sf_dir):
    own = F.array(*[F.lit(x) for x in probe(spark, sf_dir)])
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), own), 6).alias("cosine"))


@query("vector_normalise", "SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS u FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings))")
def vector_normalise(spark, sf_dir):
    unit = retrieval.normalized(F.col("embedding"), 64)
    return read(spark, sf_dir, "embeddings").select("vec_id", unit.alias("u")).select("vec_id", F.round(retrieval.norm(F.col("u")), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


@query("vector_storage_bytes", "SELECT CAST(coalesce(sum(len(embedding) * 2), 0) AS BIGINT) AS bytes FROM embeddings")
def vector_storage_bytes(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").agg(F.coalesce(F.sum(retrieval.float16_bytes(F.col("embedding"))), F.lit(0)).cast("bigint").alias("bytes"))


@query("vector_half_precision")
def vector_half_precision(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", retrieval.half_precision("embedding").alias("stored"))


RANKINGS = """kw AS (SELECT doc_id AS work_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100)),
se AS (SELECT doc_id AS work_id, row_number() OVER (ORDER BY length(source || lang), doc_id DESC) AS rank FROM (SELECT * FROM documents ORDER BY length(source || lang), doc_id DESC LIMIT 100))"""


def _two_rankings(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "work_id")
    a = (F.col("n_chars").desc(), F.col("work_id").asc())
    b = (F.length(F.concat("source", "lang")).asc(), F.col("work_id").desc())
    return [retrieval.ranking(docs.orderBy(*o).limit(100), "work_id", *o) for o in (a, b)]


@query("rrf_fusion", f"WITH {RANKINGS} SELECT work_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM se) GROUP BY work_id")
def rrf_fusion(spark, sf_dir):
    return retrieval.fuse(_two_rankings(spark, sf_dir), "work_id").withColumn("score", F.round("score", 9))


@query("fused_work_ranking", f"WITH {RANKINGS} SELECT work_id, round(s, 9) AS score FROM (SELECT work_id, sum(1.0 / (60 + rank)) AS s FROM (SELECT * FROM kw UNION ALL SELECT * FROM se) GROUP BY work_id) ORDER BY round(s, 12) DESC, work_id LIMIT 30")
def fused_work_ranking(spark, sf_dir):
    return retrieval.fuse(_two_rankings(spark, sf_dir), "work_id", 30).withColumn("score", F.round("score", 9))


@query(
    "fused_channels",
    f"""WITH {W}, kwh AS (SELECT chunk_id AS work_id, relevance FROM ({bm25_sql("worthless the", "anyTerm", 100).replace("round(s, 6)", "s")})), {PROBE}, seh AS (SELECT vec_id AS work_id, {DOT} AS s FROM embeddings e, q ORDER BY s DESC, vec_id LIMIT 100),
meh AS (SELECT work_id, 10 * contains({FOLD.format("concat_ws(chr(10), title, abstract_text, CAST(year AS VARCHAR), doi)")}, 'worthless')::INT + 10 * contains({FOLD.format("concat_ws(chr(10), title, abstract_text, CAST(year AS VARCHAR), doi)")}, 'the')::INT + 100 * contains({FOLD.format('title')}, 'worthless the')::INT AS s FROM works ORDER BY s DESC, work_id LIMIT 100),
r AS (SELECT work_id, row_number() OVER (ORDER BY relevance DESC, work_id) AS rank FROM kwh UNION ALL SELECT work_id, row_number() OVER (ORDER BY s DESC, work_id) FROM seh UNION ALL SELECT work_id, row_number() OVER (ORDER BY s DESC, work_id) FROM meh WHERE s > 0)
SELECT work_id, round(s, 9) AS score FROM (SELECT work_id, sum(1.0 / (60 + rank)) AS s FROM r GROUP BY work_id) ORDER BY round(s, 12) DESC, work_id LIMIT 30""",
)
def fused_channels(spark, sf_dir):
    """The three channels of a search, each over all documents, fused: keyword hits, vector hits and metadata."""
    hits = text_index(spark, sf_dir).search("worthless the", "anyTerm", 100).select(F.col("chunk_id").alias("work_id"), "relevance")
    near = retrieval.vector_topk(vectors(spark, sf_dir).withColumn("work_id", F.col("chunk_id")), probe(spark, sf_dir), 100, None)
    meta = retrieval.metadata_ranking(works(spark, sf_dir).withColumnRenamed("year", "publication_year"), "worthless the", ["worthless", "the"], 100)
    ranks = [retrieval.ranking(df, "work_id", F.col(c).desc(), F.col("work_id")) for df, c in ((hits, "relevance"), (near, "score"), (meta, "score"))]
    return retrieval.fuse(ranks, "work_id", 30).withColumn("score", F.round("score", 9))


META = f"{FOLD.format('concat_ws(chr(10), title, abstract_text, CAST(year AS VARCHAR), doi)')}"


@query(
    "metadata_ranking",
    f"WITH {W} SELECT work_id, CAST(s AS INTEGER) AS score FROM (SELECT work_id, 10 * contains({META}, 'the')::INT + 10 * contains({META}, '2004')::INT + 100 * contains({FOLD.format('title')}, 'the 2004')::INT AS s FROM works) WHERE s > 0 ORDER BY s DESC, work_id LIMIT 100",
)
def metadata_ranking(spark, sf_dir):
    own = works(spark, sf_dir).withColumnRenamed("year", "publication_year")
    return retrieval.metadata_ranking(own, "the 2004", ["the", "2004"], 100)


@query("minmax_rescale", "SELECT vec_id, round(CASE WHEN hi - lo <= 2.220446049250313e-16 THEN 1.0 ELSE (s - lo) / (hi - lo) END, 6) AS relative FROM (SELECT vec_id, s, min(s) OVER (PARTITION BY label) AS lo, max(s) OVER (PARTITION BY label) AS hi FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS s FROM embeddings))")
def minmax_rescale(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("s"))
    return retrieval.rescaled(rows, "label", "s").select("vec_id", F.round("relative", 6).alias("relative"))


@query("relevance_tier", "SELECT vec_id, CASE WHEN abs(embedding[1]::DOUBLE) * 4 >= 0.5 THEN 'solid' ELSE 'marginal' END AS tier FROM embeddings")
def relevance_tier(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", retrieval.tier(F.abs(F.col("embedding")[0].cast("double")) * 4).alias("tier"))


@query(
    "display_order",
    """WITH p AS (SELECT label AS work_id, CAST(vec_id AS VARCHAR) AS id, round(abs(embedding[1]::DOUBLE) * 4, 6) AS raw, CAST(1 + vec_id % 40 AS INTEGER) AS start_page FROM embeddings),
b AS (SELECT *, max(raw) OVER (PARTITION BY work_id) AS best FROM p),
f AS (SELECT work_id, id AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY start_page, raw DESC, id) AS rk FROM b WHERE start_page <= 3 AND (best - raw <= 0.08 OR raw >= 0.85 * best)) WHERE rk = 1)
SELECT p.work_id, p.id, CAST(row_number() OVER (PARTITION BY p.work_id ORDER BY CASE WHEN p.id = f.first_id THEN 0 ELSE 1 END, raw DESC, start_page, p.id) AS INTEGER) AS position FROM p LEFT JOIN f ON p.work_id = f.work_id""",
)
def display_order(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("work_id"), F.col("vec_id").cast("string").alias("id"), F.round(F.abs(F.col("embedding")[0].cast("double")) * 4, 6).alias("raw"), (1 + F.col("vec_id") % 40).cast("int").alias("start_page"))
    return retrieval.display_order(rows).select("work_id", "id", "position")


@query(
    "excerpt",
    f"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents), a AS (SELECT *, coalesce(nullif(instr({FOLD.format('x')}, 'idiot'), 0), nullif(instr({FOLD.format('x')}, 'the'), 0), 1) - 1 AS hit FROM t),
s AS (SELECT *, greatest(0, least(hit - 80, length(x) - 240)) AS st FROM a)
SELECT doc_id, CASE WHEN length(x) <= 240 THEN x ELSE (CASE WHEN st > 0 THEN '…' ELSE '' END) || substring(x, CAST(st + 1 AS BIGINT), 240) || (CASE WHEN st + 240 < length(x) THEN '…' ELSE '' END) END AS excerpt FROM s""",
)
def excerpt(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.excerpt(F.col("text"), ["idiot", "the"]).alias("excerpt"))


# ---- smart search -----------------------------------------------------------------------


RERANK = """l AS (SELECT l_orderkey, l_quantity, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS depth FROM lineitem),
p AS (SELECT o.o_custkey AS query, CAST(dense_rank() OVER (PARTITION BY o.o_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) AS INTEGER) AS work, l.depth,
  CAST(o.o_orderkey * 100 + l.depth AS VARCHAR) AS passage, CAST(l.l_quantity * 40 AS BIGINT) AS size FROM orders o JOIN l ON l.l_orderkey = o.o_orderkey),
s AS (SELECT *, CASE WHEN depth = 1 AND work <= 5 THEN 1 WHEN depth = 2 AND work <= 5 THEN 2 WHEN depth = 1 THEN 3 ELSE 4 END AS step FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY step, work, depth) AS seq FROM s)"""


@query(
    "rerank_select",
    f"""WITH RECURSIVE {RERANK}, w(query, seq, left_, n, ended, done, took, passage) AS (
  SELECT query, 0::BIGINT, 9000::BIGINT, 0, false, 0, false, '' FROM (SELECT DISTINCT query FROM o)
  UNION ALL
  SELECT query, seq, CASE WHEN ok THEN left_ - size ELSE left_ END, CASE WHEN ok THEN n + 1 ELSE n END, ended OR (step = 3 AND NOT ok), CASE WHEN ok AND step = 4 THEN work ELSE done END, ok, passage
  FROM (SELECT o.query, o.seq, o.size, o.step, o.work, o.passage, w.left_, w.n, w.ended, w.done, w.n < 12 AND o.size <= w.left_ AND NOT (o.step = 3 AND w.ended) AND NOT (o.step = 4 AND w.done = o.work) AS ok
    FROM w JOIN o ON o.query = w.query AND o.seq = w.seq + 1))
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY seq) - 1 AS INTEGER) AS position, passage FROM w WHERE took""",
)
def rerank_select(spark, sf_dir):
    """Each customer as a query: its orders are the works, by price, and their lines the passages, five works with a second one reserved."""
    depth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), depth.alias("depth"), (F.col("l_quantity") * 40).cast("bigint").alias("size"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    orders = read(spark, sf_dir, "orders").join(lines.select("o_orderkey").distinct(), "o_orderkey", "left_semi").select(F.col("o_custkey").alias("query"), "o_orderkey", place.alias("work"))
    rows = orders.join(lines, "o_orderkey").select("query", "work", "depth", (F.col("o_orderkey") * 100 + F.col("depth")).cast("string").alias("passage"), "size")
    return retrieval.select_passages(rows, 12, 9000, 5)


@query("smart_search")
def smart_search(spark, sf_dir, depth: str = "fast", asked: int = 10):
    """Keyword, vector and metadata channels over kept passages; see operators.search."""
    own = works(spark, sf_dir).withColumnRenamed("year", "publication_year")
    near = vectors(spark, sf_dir).select(F.col("chunk_id").alias("work_id"), (F.col("chunk_id") * 1_000_000).alias("chunk_id"), "vector")
    return search.smart_search(kept_index(spark, sf_dir, "passages", passages), near, own, ANY, probe(spark, sf_dir), depth, asked)


@query(
    "version_collapse",
    """WITH RECURSIVE r AS (SELECT c_nationkey * 7 + c_custkey % 7 AS query, CAST(row_number() OVER (PARTITION BY c_nationkey * 7 + c_custkey % 7 ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place, c_custkey AS work_id,
  CASE WHEN c_custkey % 5 <> 0 THEN '10.1/' || (c_custkey // 7) % 9 END AS doi, CASE WHEN c_custkey % 4 = 3 THEN c_custkey - 7 END AS duplicate_of, c_mktsegment AS title, CAST(1990 + (c_custkey // 7) % 20 AS INTEGER) AS year FROM customer),
w(query, place, kept, work_id, took) AS (
  SELECT DISTINCT query, 0, []::BIGINT[], 0::BIGINT, false FROM r
  UNION ALL
  SELECT query, place, CASE WHEN ok THEN list_append(kept, work_id) ELSE kept END, work_id, ok FROM (
    SELECT w.query, r.place, w.kept, r.work_id, len(w.kept) < 4 AND NOT EXISTS (SELECT 1 FROM r k WHERE k.query = r.query AND list_contains(w.kept, k.work_id)
      AND (k.doi = r.doi OR k.duplicate_of = r.work_id OR r.duplicate_of = k.work_id OR (k.title = r.title AND abs(k.year - r.year) <= 1))) AS ok
    FROM w JOIN r ON r.query = w.query AND r.place = w.place + 1))
SELECT query, work_id, place FROM w WHERE took""",
)
def version_collapse(spark, sf_dir):
    """Ranked lists of all customers; DOIs, duplicate links, titles and years are dealt so that versions meet in them."""
    number = F.floor(F.col("c_custkey") / 7)
    by = (F.col("c_nationkey") * 7 + F.col("c_custkey") % 7).alias("query")
    rows = read(spark, sf_dir, "customer").select(
        by, F.row_number().over(Window.partitionBy(F.col("c_nationkey") * 7 + F.col("c_custkey") % 7).orderBy(F.col("c_acctbal").desc(), "c_custkey")).alias("place"), F.col("c_custkey").alias("work_id"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("10.1/"), number % 9)).alias("doi"), F.when(F.col("c_custkey") % 4 == 3, F.col("c_custkey") - 7).alias("duplicate_of"),
        F.col("c_mktsegment").alias("title"), (1990 + number % 20).cast("int").alias("year"),
    )
    return retrieval.collapse_ranked(rows, 4)


# ---- catalog ----------------------------------------------------------------------------


@query("filter_year_bounds", f"WITH {W} SELECT work_id, year FROM works WHERE year >= 2010 AND year <= 2020")
def filter_year_bounds(spark, sf_dir):
    return works(spark, sf_dir).where(catalog.special_filters(2010, 2020)).select("work_id", "year")


@query("filter_flags", f"WITH {W} SELECT work_id FROM works WHERE latest_status = 'completed' AND abstract_text <> '' AND version_count >= 2 AND doi IS NULL")
def filter_flags(spark, sf_dir):
    return works(spark, sf_dir).where(catalog.special_filters(analyzed=True, abstract=True, versions=True, missing_doi=True)).select("work_id")


@query(
    "smart_lists",
    f"""WITH {W} SELECT 'needsReview' AS list, count(*) AS n FROM works WHERE needs_review OR coalesce(latest_status = 'failed', false) UNION ALL SELECT 'queue', count(*) FROM works WHERE latest_status IN ('queued', 'running')
UNION ALL SELECT 'missingDOI', count(*) FROM works WHERE doi IS NULL UNION ALL SELECT 'unanalyzed', count(*) FROM works WHERE latest_status IS NULL OR latest_status = 'cancelled'
UNION ALL SELECT 'versions', count(*) FROM works WHERE version_count > 1 UNION ALL SELECT 'duplicates', count(*) FROM works WHERE duplicate_of IS NOT NULL UNION ALL SELECT 'category', count(*) FROM works WHERE category = 'src3'""",
)
def smart_lists(spark, sf_dir):
    own, names = works(spark, sf_dir), ("needsReview", "queue", "missingDOI", "unanalyzed", "versions", "duplicates", "category")
    one = own.agg(*[F.count_if(catalog.smart_list(n, key="src3")).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


@query("recent_events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAYS")
def recent_events(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("date_added", F.col("ts")).withColumn("latest_status", F.lit(None).cast("string"))
    return rows.where(catalog.smart_list("recent", "2024-02-10 00:00:00")).select("event_id")


@query("tag_or_filter", f"WITH {W} SELECT work_id FROM works WHERE tag IN ('fr', 'de') OR category IN ('src1')")
def tag_or_filter(spark, sf_dir):
    return works(spark, sf_dir).where(catalog.tag_filter(F.array("tag"), F.array("category"), ["fr", "de"], ["src1"])).select("work_id")


def _match_sql(test: str) -> str:
    f = f"list_filter([{norm_sql('title')}, {norm_sql('abstract_text')}, CAST(year AS VARCHAR)], lambda f: f <> '')"
    return f"WITH {W}, m AS (SELECT work_id, {f} AS fields FROM works) SELECT work_id FROM m WHERE {test}"


def _has(term: str) -> str:
    return f"len(list_filter(fields, lambda f: contains(f, '{term}'))) > 0"


def _scope(spark, sf_dir, text: str, mode: str) -> DataFrame:
    fields = catalog.fields_of(F.col("title"), F.col("abstract_text"), F.col("year"))
    return works(spark, sf_dir).where(catalog.text_matches(fields, text, mode)).select("work_id")


@query("scope_match_all", _match_sql(f"{_has('the')} AND {_has('2004')}"))
def scope_match_all(spark, sf_dir):
    return _scope(spark, sf_dir, "The 2004", "allTerms")


@query("scope_match_any", _match_sql(f"{_has('src7')} OR {_has('2004')}"))
def scope_match_any(spark, sf_dir):
    return _scope(spark, sf_dir, "ＳＲＣ7 2004", "anyTerm")


@query("scope_match_phrase", _match_sql(_has("fr src3")))
def scope_match_phrase(spark, sf_dir):
    return _scope(spark, sf_dir, '"fr src3"', "exactPhrase")


def _groups():
    own = lambda c: F.array(tx.normalize(F.col(c).cast("string")))
    return {"title": (100, own("title")), "identifiers": (80, own("doi")), "abstract": (55, own("abstract_text"))}


def _group_sql(expr: str) -> str:
    h = lambda c: " + ".join(f"coalesce(contains({norm_sql(c)}, '{t}'), false)::INT" for t in ("the", "src1"))
    return f"WITH {W}, g AS (SELECT work_id, {h('title')} AS a, {h('doi')} AS b, {h('abstract_text')} AS c FROM works) SELECT work_id, {expr} FROM g"


@query("relevance_score", _group_sql("CAST(100 * a + 80 * b + 55 * c AS INTEGER) AS score"))
def relevance_score(spark, sf_dir):
    groups = {k: (w, F.filter(f, lambda x: x.isNotNull())) for k, (w, f) in _groups().items()}
    return works(spark, sf_dir).select("work_id", catalog.relevance_score(groups, "the src1", "allTerms").alias("score"))


@query("match_reason", _group_sql("CASE WHEN a > 0 THEN 'title' WHEN b > 0 THEN 'identifiers' WHEN c > 0 THEN 'abstract' END AS reason"))
def match_reason(spark, sf_dir):
    groups = {k: (w, F.filter(f, lambda x: x.isNotNull())) for k, (w, f) in _groups().items()}
    return works(spark, sf_dir).select("work_id", catalog.match_reason(groups, "the src1", "allTerms").alias("reason"))


@query("library_sort", f"WITH {W} SELECT work_id, row_number() OVER (ORDER BY doi IS NULL, doi DESC, title, work_id) AS position FROM works")
def library_sort(spark, sf_dir):
    order = catalog.library_order("doi", descending=True)
    return catalog.positions(works(spark, sf_dir).select("work_id", "title", "doi"), order).select("work_id", "position")


PRIO = "CASE priority WHEN 'three' THEN 3 WHEN 'two' THEN 2 WHEN 'one' THEN 1 WHEN 'completed' THEN -1 ELSE 0 END"


@query("priority_sort", f"WITH {W} SELECT work_id, row_number() OVER (ORDER BY {PRIO} DESC, year, title, work_id) AS position FROM works")
def priority_sort(spark, sf_dir):
    order = catalog.library_order("year", priority="priority")
    return catalog.positions(works(spark, sf_dir).select("work_id", "title", "year", "priority"), order).select("work_id", "position")


@query("combined_order", f"WITH {W} SELECT work_id, round(CASE WHEN m > 0 THEN 2 + m / 100.0 ELSE 0 END + CASE WHEN p THEN 1 ELSE 0 END, 6) AS score FROM (SELECT work_id, 100 * contains({norm_sql('title')}, 'the')::INT AS m, contains({norm_sql('text')}, 'idiot') AS p FROM works)")
def combined_order(spark, sf_dir):
    has = lambda c, t: F.when(tx.normalize(F.col(c)).contains(t), 1).otherwise(0)
    return works(spark, sf_dir).select("work_id", F.round(catalog.combined_score(100 * has("title", "the"), has("text", "idiot")), 6).alias("score"))


@query("badge_counts", f"WITH {W} SELECT count(*) AS all_, count(*) FILTER (needs_review OR coalesce(latest_status = 'failed', false)) AS needs_review, count(*) FILTER (duplicate_of IS NOT NULL) AS duplicates, count(*) FILTER (latest_status IN ('queued', 'running')) AS queue FROM works")
def badge_counts(spark, sf_dir):
    return catalog.badges(works(spark, sf_dir)).select(F.col("all").alias("all_"), F.col("needsReview").alias("needs_review"), "duplicates", "queue")


@query("category_counts", "SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def category_counts(spark, sf_dir):
    bridge = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
    return catalog.counts_with_zero(read(spark, sf_dir, "nation"), bridge, "n_name")


@query("review_eligible", f"WITH {W} SELECT work_id FROM works WHERE duplicate_of IS NULL AND coalesce(latest_status NOT IN ('queued', 'running', 'failed'), true)")
def review_eligible(spark, sf_dir):
    return works(spark, sf_dir).withColumn("note", F.lit(None).cast("string")).where(catalog.can_mark_reviewed()).select("work_id")


@query("chips", "SELECT work_id, name, position, overflow FROM (SELECT o_custkey AS work_id, name, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY name) AS INTEGER) AS position, greatest(0, count(*) OVER (PARTITION BY o_custkey) - 3) AS overflow FROM (SELECT DISTINCT o_custkey, o_orderpriority AS name FROM orders)) WHERE position <= 3")
def chips(spark, sf_dir):
    tags = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work_id"), F.col("o_orderpriority").alias("name")).distinct()
    return catalog.chips(tags.limit(0).withColumn("sort_order", F.lit(0)), tags).withColumn("overflow", F.col("overflow").cast("bigint"))
