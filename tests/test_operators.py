"""Operators on rows made here: goldens, edge cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from papyra.functions import biblio, text, values
from papyra.operators import catalog, dedup, fts, ledger, reconcile, retrieval, state
from papyra.operators.chunking import chunk_pages, split_long, without_margins, windows
from papyra.sources import bibtex, files
from papyra.streaming import upkeep


def one(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int' if isinstance(v, int) else 'double'}" for k, v in row.items()))
    return df.select(column).first()[0]


def test_query_terms():
    assert text.query_terms('smith "Minimum  Wage" ＬＡＢＯＲ') == ["smith", "minimum wage", "labor"]
    assert text.query_terms("“a b” c c") == ["a b", "c", "c"] and text.query_terms('""') == []
    assert text.scoring_terms(' "x y" ', "exactPhrase") == ["x y"]


def test_match_expression():
    m = fts.match_expression("alpha beta", "allTerms")
    assert m.every and m.phrases == [["alpha"], ["beta"]]
    assert fts.match_expression("abc财政政策", "anyTerm").phrases == [["财政"], ["政政"], ["政策"]]
    assert fts.match_expression('"财政x政策"', "exactPhrase").phrases == [["财政", "政政", "政策"]]
    assert fts.match_expression("  ", "anyTerm") is None and fts.match_expression('""', "exactPhrase") is None


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, work_id string, text string")


def test_search_scope_and_cap(spark):
    rows = [(k, "a", "labor labor wage") for k in range(8)] + [(20, "b", "labor"), (30, "c", "labor"), (40, "d", None), (41, "d", "")]
    df = chunk_rows(spark, rows)
    allowed = spark.createDataFrame([("a",), ("b",)], "work_id string")
    hits = fts.keyword_search(df, "labor", allowed=allowed, cap=2).collect()
    assert sorted((h["work_id"], h["chunk_id"]) for h in hits) == [("a", 0), ("a", 1), ("b", 20)]
    assert fts.keyword_search(df, "", cap=2).count() == 0
    assert fts.keyword_search(df, "labor", allowed=allowed.limit(0)).count() == 0


def test_bm25_by_hand(spark):
    import math

    df = chunk_rows(spark, [(1, "a", "x y z"), (2, "b", "y"), (3, "c", "z z"), (4, "d", "w")])
    (hit,) = fts.keyword_search(df, "x").collect()
    n, dl, avg = 4, 3, 7 / 4
    want = math.log((n - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg))
    assert hit["relevance"] == pytest.approx(want)


def test_phrases_overlap(spark):
    df = chunk_rows(spark, [(1, "a", "a a a b"), (2, "a", "b a b"), (3, "a", "ab a.b")])
    assert {h["chunk_id"] for h in fts.keyword_search(df, '"a b"', "exactPhrase").collect()} == {1, 2, 3}


def test_vector_topk(spark):
    rows = [("w", k, [k / 5, 0.0]) for k in range(6)] + [("v", 10, [9.0]), ("v", 11, None), ("v", 12, [0.9, 1.0])]
    df = spark.createDataFrame(rows, "work_id string, chunk_id long, vector array<float>")
    assert [r["chunk_id"] for r in retrieval.vector_topk(df, [1.0, 0.0], 2, None).collect()] == [5, 12]
    assert [r["chunk_id"] for r in retrieval.vector_topk(df, [1.0, 0.0], 5, 2).collect()] == [5, 12, 4]
    assert retrieval.vector_topk(df, [1.0, 0.0], 5, 2, spark.createDataFrame([("v",)], "work_id string")).count() == 1


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(1.0), float("-inf"), float("-inf")]
    unit = [r[0] for r in df.select(retrieval.normalized(F.col("a"), 2)).collect()]
    assert unit == [[pytest.approx(0.6), pytest.approx(0.8)], None, None]
    half = [r[0] for r in spark.createDataFrame([([0.1, 1e-9],), (None,)], "a array<float>").select(retrieval.half_precision("a")).collect()]
    assert half[0][0] == pytest.approx(0.1, abs=1e-4) and half[0][1] == 0 and half[1] is None


def test_selection_for_rerank():
    works = [[("a1", 10), ("a2", 10)], [("b1", 10)], [("c1", 10)]]
    assert retrieval.select_for_rerank(works, 4, 1000) == ["a1", "b1", "c1", "a2"]
    assert retrieval.select_for_rerank(works, 4, 20) == ["a1", "b1"]
    assert retrieval.select_for_rerank(works, 4, 1000, priority=1) == ["a1", "a2", "b1", "c1"]


def test_versions_and_display(spark):
    base = {"work_id": 1, "title": "t", "year": 2000, "doi": None, "duplicate_of": None}
    rows = [base, base | {"work_id": 2, "year": 2001}, base | {"work_id": 3, "year": 2003}, base | {"work_id": 4, "title": "u", "duplicate_of": 3}]
    assert retrieval.collapse_versions(rows, 10) == [1, 3] and retrieval.collapse_versions(rows, 1) == [1]
    own = lambda low: spark.createDataFrame([(1, "late", 0.91, 32), (1, "early", low, 1)], "work_id int, id string, raw double, start_page int")
    first = lambda df: retrieval.display_order(df).orderBy("position").first()["id"]
    assert first(own(0.84)) == "early" and first(own(0.40)) == "late"
    assert retrieval.result_limit(7) == 10 and retrieval.result_limit(5) == 5


def test_relative_scores(spark):
    df = spark.createDataFrame([(3.0,), (2.0,), (1.0,)], "raw double")
    assert sorted(r["relative"] for r in retrieval.relative_scores(df).collect()) == [0.0, 0.5, 1.0]
    assert [r["relative"] for r in retrieval.relative_scores(spark.createDataFrame([(4.0,), (4.0,)], "raw double")).collect()] == [1.0, 1.0]


def test_catalog_edges(spark):
    rows = [(1, "José Álvarez", 2010, False, None), (2, None, None, True, "failed")]
    df = spark.createDataFrame(rows, "work_id int, title string, year int, needs_review boolean, latest_status string")
    ids = lambda c: [r["work_id"] for r in df.where(c).collect()]
    fields = catalog.fields_of(F.col("title"), F.col("year"))
    assert ids(catalog.text_matches(fields, "alvarez 2010", "allTerms")) == [1]
    assert ids(catalog.text_matches(fields, "", "allTerms")) == [1, 2] and ids(catalog.text_matches(fields, '""', "exactPhrase")) == []
    assert ids(catalog.special_filters(lo=1900)) == [1] and ids(catalog.special_filters()) == [1, 2]
    assert ids(catalog.smart_list("needsReview")) == [2] and ids(catalog.smart_list("unanalyzed")) == [1]
    assert [r["work_id"] for r in df.orderBy(*catalog.library_order("year", descending=True)).collect()] == [1, 2]
    assert catalog.active_filters(lo=1, analyzed=True, abstract=False) == 2


def test_duplicate_cascade(spark):
    schema = "id string, pos int, sha256 string, doi string, nber string, ssrn string, arxiv string, repec string, fingerprint string, title string, authors string, year int"
    library = spark.createDataFrame([("L1", 1, "h1", "10.1/a", None, None, None, None, "00000000000000ff", "Minimum wage effects", "Doe", 2000), ("L2", 2, "h1", None, "77", None, None, None, None, "Other", "Roe", 1990)], schema)
    imported = spark.createDataFrame([
        ("a", 1, "h1", None, "77", None, None, None, None, "x", "", None), ("b", 2, "h9", "10.1/A", "77", None, None, None, None, "x", "", None), ("c", 3, "h9", None, None, None, None, None, "00000000000000ff", "zzz", "", None),
        ("d", 4, "h9", None, None, None, None, None, "00000000000000fe", "minimum wage effects", "Doe", 2001), ("e", 5, None, None, None, None, None, None, None, "nothing alike", None, None),
    ], schema)
    got = {r["id"]: (r["decision"], r["matched"]) for r in dedup.duplicate_cascade(imported, library).collect()}
    assert got == {"a": ("exactFile", "L1"), "b": ("possibleDuplicate", "L1"), "c": ("sameWork", "L1"), "d": ("similar", "L1"), "e": ("newWork", None)}


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["the", "of", "wage", "trade", "tax", "labor", "policy", "growth"]
    rows = [(i, i, " ".join(rng.sample(words, rng.randint(0, 5))), rng.choice(["Doe", "Roe", ""]), rng.choice([2000, 2001, 2005, None]), rng.choice(["00000000000000ff", "ffffffffffffffff", None])) for i in range(60)]
    works = spark.createDataFrame(rows, "id int, pos int, title string, authors string, year int, fingerprint string")

    def share(a, b):
        a, b = ({w for w in x.lower().split() if len(w) > 1} for x in (a, b))
        return len(a & b) / len(a | b) if a and b else 0.0

    def score(a, b):
        years = 0.4 if a[4] is None or b[4] is None else float(abs(a[4] - b[4]) <= 1)
        prints = 0.0 if a[5] is None or b[5] is None else 1 - (int(a[5], 16) ^ int(b[5], 16)).bit_count() / 64
        return 0.55 * share(a[2], b[2]) + 0.2 * share(a[3], b[3]) + 0.1 * years + 0.15 * prints

    for least in (0.66, 0.8):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and share(a[2], b[2]) > 0 and score(a, b) >= least}
        assert want and {(r["left_id"], r["right_id"]) for r in dedup.similar_pairs(works, works, least).collect()} == want


def test_cascade_takes_another_work_of_equal_content(spark):
    none = "cast(null as string)"
    works = spark.range(4).selectExpr("id", "id as pos", f"{none} as sha256", *[f"{none} as {c}" for c in ("doi", "nber", "ssrn", "arxiv", "repec", "fingerprint")], "'Minimum wage effects' as title", "'Doe' as authors", "2000 as year")
    assert {r["id"]: r["matched"] for r in dedup.duplicate_cascade(works, works).collect()} == {0: 1, 1: 0, 2: 0, 3: 0}


def test_identifier_links_against_all_pairs(spark):
    rng = random.Random(5)
    pick = lambda own: rng.choice([*own, None])
    rows = [(i, rng.randrange(1000), pick("ab"), pick([True, False]), pick("xyz"), None, " ", None) for i in range(40)]
    got = {r["id"]: r["linked"] for r in dedup.identifier_links(spark.createDataFrame(rows, "id int, pos int, doi string, doi_verified boolean, nber string, ssrn string, arxiv string, repec string")).collect()}
    want = {}
    for a in rows:
        own = [b for b in rows if b[0] != a[0] and ((a[2] and a[2] == b[2] and (a[3] or b[3])) or (a[4] and a[4] == b[4]))]
        if own:
            want[a[0]] = min(own, key=lambda b: (b[1], b[0]))[0]
    assert want and got == want


def test_simhash_by_hand(spark):
    def fnv(word):
        h = 0xCBF29CE484222325
        for b in word.encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return h

    words = ["labor", "wage", "labor", "política"]
    votes = [sum(1 if fnv(w if w != "política" else "politica") >> k & 1 else -1 for w in words) for k in range(64)]
    want = f"{sum(1 << k for k in range(64) if votes[k] >= 0):016x}"
    assert one(spark, dedup.simhash64(F.col("t")), t="Labor, wage labor; Política of") == want
    assert one(spark, dedup.simhash64(F.col("t")), t="a b") is None


def test_ledger(spark):
    df = spark.createDataFrame([("2024-01-02 10:00:00", 1.5, "a"), ("2024-01-02 11:00:00", -3.0, "a"), ("2024-01-03 00:00:00", 0.5, "b")], "created_at string, cost_usd double, kind string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    days = ledger.daily_totals(df, ["a", "b"]).collect()
    assert [(str(r["day"]), r["a"], r["b"], r["total"]) for r in days] == [("2024-01-03", 0.0, 0.5, 0.5), ("2024-01-02", 1.5, 0.0, 1.5)]
    row = ledger.today_and_month(df, "2024-01-02 23:00:00").first()
    assert (row["today"], row["month"]) == (1.5, 2.0)
    assert ledger.month_spend(df.withColumn("id", F.lit(1)), "2024-01-31 00:00:00", 0.0).first()["allowed"]
    samples = spark.createDataFrame([("s", k, 2.0 if k > 1 else 900.0) for k in range(60)], "series string, pos int, seconds double")
    row = ledger.trimmed_mean_eta(samples, 10).first()
    assert (row["samples"], row["mean"], row["eta"]) == (50, 2.0, 20.0)
    got = {r["outcome"]: r["n"] for r in ledger.batch_outcomes(spark.createDataFrame([(1, 1.0, True), (2, 1.0, False), (3, 1.0, True)], "pos int, cost double, ok boolean"), 2.0).collect()}
    assert got == {"completed": 1, "failed": 1, "skipped": 1}


def test_reconciliation(spark):
    known = spark.createDataFrame([(1, 1, "a", "h1"), (2, 2, "b", "h1"), (3, 3, "c", "h2"), (4, 4, "d", "h3")], "id int, pos int, path string, sha256 string")
    found = spark.createDataFrame([("d", "h3"), ("new", "h1"), ("x", "h2"), ("y", "h2")], "path string, sha256 string")
    assert [tuple(r) for r in reconcile.missing_file_matches(known, found).collect()] == [(1, "a", "new")]
    assert tuple(reconcile.health_report(known, found).first()) == (4, 1, 2)
    names = spark.createDataFrame([(1, "A.pdf"), (2, "a.pdf"), (3, "b")], "pos int, name string")
    assert [r["unique"] for r in reconcile.unique_names(names).orderBy("pos").collect()] == ["A.pdf", "a (2).pdf", "b"]


def test_state_changes(spark):
    works = spark.createDataFrame([(1, None, 2000, None), (2, "d2", 1999, 1), (3, "d3", 2001, 2), (4, None, None, 2)], "work_id int, doi string, year int, duplicate_of int")
    mapping = spark.createDataFrame([(2, 1)], "source int, target int")
    got = {r["work_id"]: (r["doi"], r["year"], r["duplicate_of"]) for r in state.merge_works(works, mapping, ["doi", "year"]).collect()}
    assert got == {1: ("d2", 2000, None), 3: ("d3", 2001, 1), 4: (None, None, 1)}
    parts = spark.createDataFrame([("t", 1), ("t", 2), ("t", 2), ("t", 4), ("u", 2)], "task string, part int")
    assert {r["task"]: r["completed"] for r in state.contiguous_prefix(parts, "task", "part").collect()} == {"t": 2, "u": 0}
    marks = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, sort_order int")
    moved = lambda o: {r["id"]: r["sort_order"] for r in state.swap_neighbours(marks, "sort_order", F.col("id") == 2, o).collect()}
    assert moved(1) == {1: 10, 2: 30, 3: 20} and moved(-1) == {1: 20, 2: 10, 3: 30}
    assert state.next_order(marks.limit(0), "sort_order").first()[0] == 0


def test_chunking(spark):
    assert split_long("One. Two! Three", 9) == ["One. Two!", "Three"] and split_long("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and split_long(" ", 5) == []
    rng = random.Random(1)
    units = [(k // 3, "w" * rng.randrange(1, 60)) for k in range(50)]
    out = windows(units, 100, 160, 20)
    assert "".join(t for _, _, t in out).count("w") >= sum(len(t) for _, t in units) and all(len(t) <= 160 for _, _, t in out)
    pages = spark.createDataFrame([(1, p, f"HEAD\nbody {p} text\nmore\nx\ny\nz\nFOOT") for p in range(1, 5)] + [(2, 1, None)], "doc_id int, page int, text string")
    clean = without_margins(pages).where("doc_id = 1 AND page = 2").first()["text"]
    assert clean == "body 2 text\nx" or "HEAD" not in clean and "FOOT" not in clean and "body 2 text" in clean
    chunks = chunk_pages(pages).collect()
    assert [c["ordinal"] for c in chunks] == list(range(len(chunks))) and chunks[0]["start_page"] == 1 and chunks[-1]["end_page"] == 4


def test_bibtex():
    got = bibtex.parse_entry('@Article( key:1 , title = {A {B} \\} c}, Author="X {"} Y", year = 2001, )')
    assert got == {"@type": "article", "@key": "key:1", "title": "A {B} \\} c", "author": 'X {"} Y', "year": "2001"}
    for bad in ("", "@article{k, title = {x}", "@article{k, title {x}}", "@a{k, t = {x}} tail", "@a{k, t = }"):
        with pytest.raises(ValueError):
            bibtex.parse_entry(bad)


def test_biblio(spark):
    assert one(spark, biblio.plain_text(F.col("t")), t="The {E}ffects \\& \\'{e}t\\'e of \\emph{x}") == "The Effects & ete of x"
    assert one(spark, biblio.latex_escaped(F.col("t")), t="a_b & {c} \\") == "a\\_b \\& \\{c\\} \\textbackslash{}"
    assert [one(spark, biblio.alphabetic_suffix(F.col("n")), n=k) for k in (0, 1, 26, 27, 28, 53)] == ["", "a", "z", "aa", "ab", "ba"]
    assert one(spark, values.merged_priority(F.col("a"), F.col("b")), a="one", b="completed") == "completed"
    assert one(spark, files.cache_name(F.col("d"), F.col("t"), F.col("a"), F.col("y")), d="", t="T", a=None, y=2000).endswith(".json")


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"1")
    (tmp_path / "y.txt").write_bytes(b"2")
    assert [r["length"] for r in files.pdf_files(spark, str(tmp_path)).collect()] == [1]
    primary, backups = tmp_path / "m.json", tmp_path / "backups"
    backups.mkdir()
    primary.write_text('{"schemaVersion": 11, "libraryID": "L", "works": []}')
    (backups / "b.json").write_text('{"schemaVersion": 10, "libraryID": "L", "works": [{"work_id": "w"}]}')
    got = files.read_manifest(spark, str(primary), str(backups), "L").collect()
    assert len(got) == 1 and got[0]["works"][0]["work_id"] == "w"
    assert files.read_manifest(spark, str(tmp_path / "none"), str(tmp_path / "no"), "L").count() == 0


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("w1", "v", "h"), ("w2", "v", "h")], "work_id string, file_version_id string, sha256 string").write.parquet(str(source))
    known = spark.createDataFrame([("w1", "v", "h", 2, "ready")], "work_id string, file_version_id string, sha256 string, chunk_schema int, status string")
    stream = spark.readStream.schema("work_id string, file_version_id string, sha256 string").parquet(str(source))
    seen = []
    upkeep.keep_index(stream, lambda: known, lambda df: seen.extend(r["work_id"] for r in df.collect()), str(tmp_path / "cp"), 2, once=True).awaitTermination()
    assert seen == ["w2"]
    lines = spark.createDataFrame([("r", k, x) for k, x in enumerate(["data: a", "data: b", "", "data: c", "", "data: [DONE]"])], "response string, pos int, line string")
    assert sorted(r["data"] for r in upkeep.server_events(lines).collect()) == ["a\nb", "c"]

    def embed(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(k, "bad" if k == 3 else "x" * k) for k in range(6)], "chunk_id int, text string").coalesce(1)
    got = {r["chunk_id"]: (r["vector"], r["error"]) for r in upkeep.embed_batches(rows, embed).collect()}
    assert got[3] == (None, "no") and got[5] == ([5.0], None)


def test_small_rules(spark):
    df = spark.createDataFrame([([1, 1, 1, 2, 2, 2],), ([1, 4, 4, 4],), ([],)], "s array<int>")
    assert [r[0] for r in df.select(values.strength_schedule(F.col("s"))).collect()] == [3, 5, 1]
    got = [r[0] for r in spark.createDataFrame([("7",), (" 100 ",), ("x",), ("1.0",)], "r string").select(values.part_count_reply(F.col("r"))).collect()]
    assert got == [7, None, None, None]
    assert one(spark, values.fraction_completed(F.col("a"), F.col("b")), a=3, b=4) == 0.75 and one(spark, values.fraction_completed(F.col("a"), F.col("b")), a=3, b=0) == 0.0
    field = "map<string,struct<value:string,status:string,confidence:double,pages:array<int>,evidence:string>>"
    rows = [({"a": ("x", "explicit", 1.0, [9], "e")}, {"a": ("x", "explicit", 1.0, p, "e")} if ok else {"a": ("y", "explicit", 1.0, [1], "e")}) for p, ok in (([2], True), ([7], True), ([1], False))]
    df = spark.createDataFrame(rows, f"o {field}, c {field}")
    assert [r[0]["a"]["pages"] for r in df.select(values.chosen_correction(F.col("o"), F.col("c"), F.lit(5))).collect()] == [[2], [9], [9]]
