"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.decontam import benchmark_leaks
from papyra.llm.divergence import source_divergence
from papyra.llm.html import main_text
from papyra.llm.linededup import drop_boilerplate_lines
from papyra.llm.lm import score_texts
from papyra.llm.minhash import near_duplicates
from papyra.llm.mixing import mix_sources, words_taken
from papyra.llm.nndescent import audited_near_embeddings
from papyra.llm.resample import resample
from papyra.llm.suffixdedup import remove_repeats
from papyra.llm.toxicity import score_toxicity
from papyra.llm.vectorcode import compress_vectors, with_label_error
from papyra.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_round_trip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op3_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As large a share of all documents as labels have of quality 1, drawn to be like those."""
    labels = _table(spark, sf_dir, "labels").where("quality IS NOT NULL")
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return resample(_table(spark, sf_dir, "documents"), labels.where("quality = 1"), fraction=1.0 if share is None else share)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, recall = audited_near_embeddings(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("recall", F.lit(recall).cast("double"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_taken(mix_sources(_table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate_lines(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    digest = {"n_removed": removed, "n_spans": F.size("spans").cast("long"), "kept_sha256": F.sha2("kept", 256)}
    return remove_repeats(_table(spark, sf_dir, "documents"), 200, digest)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress_vectors(_table(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("entries", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    return with_label_error(codes).select("vec_id", digits.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_lm_score": op2_lm_score,
    "op3_resample": op3_resample,
    "op4_minhash": op4_minhash,
    "op5_decontamination": op5_decontamination,
    "op6_nn_descent": op6_nn_descent,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_html": op9_html,
    "op10_line_dedup": op10_line_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_divergence": op12_divergence,
    "op13_heap_lloyd": op13_heap_lloyd,
}

ORACLE_SQL: dict[str, str] = {
    "op12_divergence": r"""
WITH doc AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
lang AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.total), 0) AS n FROM (SELECT DISTINCT lang FROM doc) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
cnt AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM tok t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
grp AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
share AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
  1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + l.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v)::HUGEINT AS q
  FROM grp g JOIN lang l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM share WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op10_line_dedup": """
WITH page AS (SELECT doc_id, source, text, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS lines FROM documents),
one AS (SELECT source, coalesce(text, '') AS text, any_value(lines) AS lines FROM page GROUP BY source, coalesce(text, '')),
total AS (SELECT source, count(*) AS pages FROM one GROUP BY source),
freq AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(lines) AS line FROM one) GROUP BY source, line),
boiler AS (SELECT f.source, list(f.line) AS drop_lines FROM freq f JOIN total t ON f.source IS NOT DISTINCT FROM t.source
  WHERE f.n >= 5 AND f.n > 0.08 * t.pages GROUP BY f.source),
cut AS (SELECT p.doc_id, p.source, p.text, string_split(p.text, chr(10)) AS every,
  list_filter(string_split(p.text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT coalesce(list_contains(b.drop_lines, trim(x, ' ')), false)) AS kept
  FROM page p LEFT JOIN boiler b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CASE WHEN len(every) = len(kept) THEN text ELSE array_to_string(kept, chr(10)) END AS text,
  CAST(coalesce(len(every) - len(kept), 0) AS BIGINT) AS lines_dropped FROM cut
""",
}
