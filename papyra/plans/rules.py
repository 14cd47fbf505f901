"""Queries of the small rules for values, names and money, over whole tables, with their SQL.

Each takes its odd values from a list of fixed ones, dealt out by a row's key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions import biblio
from papyra.functions import text as tx
from papyra.functions import values as va
from papyra.plans.catalogue import ORACLES, QUERIES, query, read

__all__ = ["ORACLES", "QUERIES"]


def dealt(own: list, by: Column) -> Column:
    """One of ``own`` by the remainder of a key; # in it stands for the key."""
    one = F.element_at(F.array(*[F.lit(x) for x in own]), (by % len(own) + 1).cast("int"))
    return F.replace(one, F.lit("#"), by.cast("string"))


def dealt_sql(own: list, by: str) -> str:
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"
    return f"replace([{', '.join(map(one, own))}][{by} % {len(own)} + 1], '#', CAST({by} AS VARCHAR))"


def key() -> Column:
    return F.col("c_custkey")


# ---- names ------------------------------------------------------------------------------

AUTHORS = ["Doe, Jane", "Jane Doe; John Roe", "Jane Doe; John Roe; Ann Poe#", "", "Jane Doe", None, "José Álvarez; Jane Doe#; Alice Jones", "Ann Poe and J. Roe & X Y#", " ; Lee, A ; "]
AUTHORS_SQL = f"a AS (SELECT c_custkey AS id, {dealt_sql(AUTHORS, 'c_custkey')} AS v, CASE WHEN c_custkey % 4 <> 0 THEN CAST(1990 + c_custkey % 30 AS INTEGER) END AS y FROM customer)"
SURNAMES = (
    r"list_transform(list_filter(list_transform(CASE WHEN contains(v, ';') THEN string_split(v, ';') ELSE string_split_regex(v, '\s+and\s+|\s+&\s+') END, lambda x: trim(x)), lambda x: x <> ''), "
    r"lambda x: CASE WHEN contains(x, ',') THEN trim(split_part(x, ',', 1)) ELSE string_split_regex(x, '\s+')[-1] END)"
)


def _authors(spark, sf_dir):
    year = F.when(key() % 4 != 0, (1990 + key() % 30).cast("int"))
    return read(spark, sf_dir, "customer").select(key().alias("id"), dealt(AUTHORS, key()).alias("v"), year.alias("y"))


@query(
    "author_year",
    f"""WITH {AUTHORS_SQL}, n AS (SELECT id, y, {SURNAMES} AS own FROM a)
SELECT id, CASE WHEN len(own) > 0 AND y IS NOT NULL THEN CASE len(own) WHEN 1 THEN own[1] WHEN 2 THEN own[1] || ' & ' || own[2] ELSE own[1] || ', ' || own[2] || ' et al' END || ' (' || y || ')' END AS ref,
CASE coalesce(len(own), 0) WHEN 0 THEN 'Unknown Author' WHEN 1 THEN own[1] WHEN 2 THEN own[1] || ' & ' || own[2] ELSE own[1] || ' et al.' END AS prefix FROM n""",
)
def author_year(spark, sf_dir):
    return _authors(spark, sf_dir).select("id", biblio.author_year(F.col("v"), F.col("y")).alias("ref"), biblio.author_prefix(F.col("v")).alias("prefix"))


TITLES = ["The Effects of Trade", "Paper", "On the # of a", "étude des prix", "of", "A-b c#"]


@query(
    "citation_key",
    f"""WITH {AUTHORS_SQL}, n AS (SELECT id, y, {SURNAMES} AS own, {dealt_sql(TITLES, 'id')} AS title FROM a),
l AS (SELECT id, y, list_transform(own, lambda x: regexp_replace(strip_accents(x), '[^A-Za-z0-9]', '', 'g')) AS own, list_filter(list_transform(string_split_regex(title, '[^\\p{{L}}\\p{{N}}]+'), lambda w: regexp_replace(strip_accents(w), '[^A-Za-z0-9]', '', 'g')),
  lambda w: w <> '' AND lower(w) NOT IN {biblio.TITLE_STOPWORDS})[1] AS word FROM n)
SELECT id, own[1] || array_to_string(list_transform(own[2:], lambda x: upper(x[1])), '') || y || upper(word[1]) || lower(word[2:]) AS key FROM l""",
)
def citation_key(spark, sf_dir):
    return _authors(spark, sf_dir).select("id", biblio.citation_key(F.col("v"), F.col("y"), dealt(TITLES, F.col("id"))).alias("key"))


TAGS = ["  Labor  economics", "labor Economics", "", "Trade #", "a tag that is longer than the forty-eight characters which one may have"]


@query(
    "tag_normalise",
    f"""WITH v AS (SELECT c_custkey AS id, [{dealt_sql(TAGS, 'c_custkey')}, c_mktsegment, lower(c_mktsegment) || ' ', {dealt_sql(TAGS, '(c_custkey + 1)')}, c_name, 'T1', 't1', 'T2', 'T3', 'T4', 'T5'] AS v FROM customer),
c AS (SELECT id, list_filter(list_transform(v, lambda x: substring(trim(regexp_replace(x, '\\s+', ' ', 'g')), 1, 48)), lambda x: x <> '') AS own FROM v)
SELECT id, array_to_string(list_filter(own, lambda x, i: list_position(list_transform(own, lambda z: lower(z)), lower(x)) = i)[1:8], '|') AS tags FROM c""",
)
def tag_normalise(spark, sf_dir):
    own = F.array(dealt(TAGS, key()), F.col("c_mktsegment"), F.concat(F.lower("c_mktsegment"), F.lit(" ")), dealt(TAGS, key() + 1), F.col("c_name"), *[F.lit(x) for x in ("T1", "t1", "T2", "T3", "T4", "T5")])
    return read(spark, sf_dir, "customer").select(key().alias("id"), F.array_join(tx.tag_names(own), "|").alias("tags"))


# ---- values -----------------------------------------------------------------------------


@query(
    "evidence_pages",
    """WITH v AS (SELECT doc_id, [doc_id % 7, doc_id % 3 + 1, 3, doc_id % 11, doc_id % 7, -1] AS v, n_chars % 9 AS n FROM documents)
SELECT doc_id, list_sort(list_distinct(list_filter(v, lambda p: p BETWEEN 1 AND n))) AS pages, len(list_filter(v, lambda p: p > 0 AND p > n)) > 0 OR list_min(v) < 1 AS invalid FROM v""",
)
def evidence_pages(spark, sf_dir):
    k = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.array(k % 7, k % 3 + 1, F.lit(3).cast("long"), k % 11, k % 7, F.lit(-1).cast("long")).alias("v"), (F.col("n_chars") % 9).alias("n"))
    return rows.select("doc_id", va.evidence_pages(F.col("v"), F.col("n")).alias("pages"), va.has_invalid_pages(F.col("v"), F.col("n")).alias("invalid"))


VALUES, STATUSES = [" x #", "Unknown", "", " unknown ", "#", None], ["explicit", "inferred", "explicit", "unknown", None]


@query(
    "explicit_values",
    f"""WITH v AS (SELECT c_custkey AS id, {dealt_sql(VALUES, 'c_custkey')} AS v, {dealt_sql(STATUSES, 'c_custkey')} AS s, c_acctbal / 5000 AS c FROM customer)
SELECT id, CASE WHEN s = 'explicit' AND c >= 8e-1 AND lower(trim(v)) NOT IN ('', 'unknown') THEN trim(v) END AS value FROM v""",
)
def explicit_values(spark, sf_dir):
    value = va.explicit_value(dealt(VALUES, key()), dealt(STATUSES, key()), F.col("c_acctbal") / 5000)
    return read(spark, sf_dir, "customer").select(key().alias("id"), value.alias("value"))


@query("json_dates", "SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 5 > 1 THEN 1990 + c_custkey % 30 END AS INTEGER) AS year FROM customer")
def json_dates(spark, sf_dir):
    parts = F.when(key() % 5 == 0, F.lit("[]")).when(key() % 5 == 1, F.lit("[[]]")).otherwise(F.concat(F.lit("[["), (1990 + key() % 30).cast("string"), F.lit(", 3], [2001]]")))
    return read(spark, sf_dir, "customer").select(key().alias("id"), va.latest_year(F.from_json(parts, "array<array<int>>")).alias("year"))


@query(
    "priority_map",
    """WITH v AS (SELECT c_custkey AS id, c_custkey % 7 AS b, ['a', 'b', 'c'][c_custkey % 3 + 1] AS k, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END AS v, c_custkey % 11 = 0 AS empty FROM customer)
SELECT id, array_to_string(list_sort(list_filter([CASE WHEN NOT empty AND k <> 'a' THEN 'a=1' END, CASE WHEN NOT empty AND k <> 'b' AND b BETWEEN 1 AND 4 THEN 'b=' || b END, k || '=' || v], lambda x: x IS NOT NULL)), ',') AS map FROM v""",
)
def priority_map(spark, sf_dir):
    json = F.when(key() % 11 != 0, F.concat(F.lit('{"a":1,"b":'), (key() % 7).cast("string"), F.lit("}")))
    own = va.set_priority(json, dealt(["a", "b", "c"], key()), F.when(key() % 4 > 0, (key() % 4).cast("int")))
    return read(spark, sf_dir, "customer").select(key().alias("id"), F.array_join(F.array_sort(F.transform(F.map_entries(own), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("map"))


OUTLINES = ["# Part 1\n# Part 2：x\n# Part 3", "# Part 1\n# Part 3", "1. a\n2. b", "2) b\n1) a\n3) c", "none", "# Part 1\n1. a\n2. b", "# Part 1\n# Part 1", ""]


@query(
    "outline_parts",
    rf"""WITH v AS (SELECT c_custkey AS id, {dealt_sql(OUTLINES, 'c_custkey')} || chr(10) || c_name AS v FROM customer),
h AS (SELECT id, regexp_extract_all(v, '(?m)^#\s+Part\s+(\d+)\b', 1) AS h, regexp_extract_all(v, '(?m)^\s*(\d+)[.)]\s+\S', 1) AS i FROM v),
f AS (SELECT id, list_transform(CASE WHEN len(h) > 0 THEN h ELSE i END, lambda x: CAST(x AS INTEGER)) AS f FROM h)
SELECT id, CAST(CASE WHEN len(f) > 0 AND list_sort(list_distinct(f)) = range(1, len(f) + 1) THEN len(f) END AS INTEGER) AS parts FROM f""",
)
def outline_parts(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(key().alias("id"), va.part_count(F.concat(dealt(OUTLINES, key()), F.lit("\n"), F.col("c_name"))).alias("parts"))


# ---- money ------------------------------------------------------------------------------

RATES = {"lite": (0.1, 0.025, 0.4), "regular": (1.25, 0.31, 10.0), "large": (2.5, 0.625, 15.0)}


def _price_sql(tier: str) -> str:
    fresh, cached, out = (f"{r}e0" for r in RATES[tier])
    return f"((i - k) * {fresh} + k * {cached} + o * {out}) / 1000000e0"


@query(
    "pricing",
    f"""WITH v AS (SELECT c_custkey AS id, c_custkey * 7919 % 400000 AS i, c_custkey * 4447 % 300000 - 1000 AS c, c_custkey % 5000 AS o, abs(c_acctbal) AS s, c_custkey % 3 = 0 AS lite FROM customer), k AS (SELECT *, greatest(0, least(c, i)) AS k FROM v)
SELECT id, CASE WHEN lite THEN {_price_sql('lite')} WHEN i > 200000 THEN {_price_sql('large')} ELSE {_price_sql('regular')} END + s * 45e-1 / 1000000e0 AS usd FROM k""",
)
def pricing(spark, sf_dir):
    source = F.when(key() % 3 == 0, "lite").otherwise("note")
    return read(spark, sf_dir, "customer").select(key().alias("id"), va.note_cost(key() * 7919 % 400_000, key() * 4447 % 300_000 - 1000, key() % 5000, F.abs("c_acctbal"), RATES, source).alias("usd"))


@query("budget_allows", "SELECT c_custkey AS id, (c_custkey % 4 - 1) * 2000 <= 0 OR c_acctbal < (c_custkey % 4 - 1) * 2000 AS allowed FROM customer")
def budget_allows(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(key().alias("id"), va.within_budget(F.col("c_acctbal"), (key() % 4 - 1) * 2000).alias("allowed"))


@query("billed_output", "SELECT p_partkey AS id, CAST(greatest(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size * 2 END - CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 60 END) AS BIGINT) AS n FROM part")
def billed_output(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    return read(spark, sf_dir, "part").select(k.alias("id"), va.billed_output(F.when(k % 5 != 0, size), F.when(k % 7 != 0, size * 2), F.when(k % 3 != 0, k % 60)).alias("n"))


# ---- texts ------------------------------------------------------------------------------

HAN = ["财政政策", " a 财 b 政", "", "财", "货币 # 政策"]


@query(
    "cjk_bigrams",
    f"""WITH v AS (SELECT doc_id, regexp_replace(text || {dealt_sql(HAN, 'doc_id')}, '[^\\x{{3400}}-\\x{{9FFF}}]', '', 'g') AS v FROM documents)
SELECT doc_id, CASE WHEN length(v) <= 1 THEN v ELSE array_to_string(list_transform(range(1, length(v)), lambda i: substring(v, i, 2)), ' ') END AS pairs FROM v""",
)
def cjk_bigrams(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.cjk_bigrams(F.concat("text", dealt(HAN, F.col("doc_id")))), " ").alias("pairs"))


PAGE_ENDS = ["inter-\r\nnational\r\n a \n\n\n\nb", "\r\r\r x-\r", "", " \n \n \n#\n\n"]


@query(
    "page_text",
    f"""WITH v AS (SELECT doc_id, replace(regexp_replace(text || {dealt_sql(PAGE_ENDS, 'doc_id')}, '\\r\\n?', chr(10), 'g'), '-' || chr(10), '') AS v FROM documents)
SELECT doc_id, trim(replace(array_to_string(list_transform(string_split(v, chr(10)), lambda x: trim(x)), chr(10)), repeat(chr(10), 3), repeat(chr(10), 2))) AS text FROM v""",
)
def page_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.page_text(F.concat("text", dealt(PAGE_ENDS, F.col("doc_id")))).alias("text"))


PRINTS = ["ffffffffffffffff", "zz", "0000000000000000", "FFFFFFFFFFFFFFFE", None]


@query(
    "simhash_similarity",
    f"""WITH v AS (SELECT doc_id, md5(text)[1:16] AS a, CASE WHEN doc_id % 3 = 0 THEN {dealt_sql(PRINTS, 'doc_id')} ELSE md5(text)[17:32] END AS b FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(b, '[0-9a-fA-F]{{16}}') AND a IS NOT NULL THEN 1 - CAST(list_sum(list_transform(range(1, 17), lambda i: bit_count(xor(instr('0123456789abcdef', a[i]) - 1, instr('0123456789abcdef', lower(b[i])) - 1)))) AS DOUBLE) / 64 ELSE 0e0 END AS s FROM v""",
)
def simhash_similarity(spark, sf_dir):
    own = F.md5("text")
    other = F.when(F.col("doc_id") % 3 == 0, dealt(PRINTS, F.col("doc_id"))).otherwise(F.substring(own, 17, 16))
    return read(spark, sf_dir, "documents").select("doc_id", va.simhash_similarity(F.substring(own, 1, 16), other).alias("s"))
