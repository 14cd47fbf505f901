"""Queries whose work once grew with the square of a table's copies: rows of their SQL on many copies, and figures that do not grow so."""

import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from papyra.functions import identifiers, text
from papyra.operators import dedup, index, manifest, retrieval, state
from papyra.plans import catalogue, records

SHIFT = 100_000


@pytest.fixture(scope="module")
def copies(sf_dir, tmp_path_factory):
    """Tables of the library four times over, keys shifted, of which SQL can still go through all pairs."""
    root = str(tmp_path_factory.mktemp("copies"))
    con = duckdb.connect()
    for table, key, rows in (("part", "p_partkey", 600), ("supplier", "s_suppkey", 100), ("customer", "c_custkey", 1500)):
        con.execute(f"copy (select t.* replace ({key} + i * {SHIFT} as {key}) from (select * from '{sf_dir}/{table}.parquet' order by {key} limit {rows}) t, range(4) r(i)) to '{root}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{root}/{table}.parquet'")
    return root, con


def same_as_sql(spark, copies, name):
    root, con = copies
    df = __spark_entry__.queries()[name](spark, root)
    result = con.execute(f"select {', '.join(df.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert result
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, result))


def test_best_remote_match_on_copies(spark, copies):
    same_as_sql(spark, copies, "best_remote_match")
    _, contents, cand = records._peers(spark, copies[0], 2)
    assert contents.count() <= 600  # not 2,400
    assert cand.groupBy("id", "title").count().where("count > 2").isEmpty()  # two of each title, not all copies


def test_journal_match_unambiguous_on_copies(spark, copies):
    same_as_sql(spark, copies, "journal_match_unambiguous")
    _, _, cand = records._peers(spark, copies[0], 3)
    assert cand.groupBy("id", "title").count().where("count > 3").isEmpty()


def test_journal_match_unambiguous_pairs_no_names(spark, tmp_path, monkeypatch):
    """Names that all differ: they are looked up by the words they share, only names of many words meet in pairs."""
    root, con = str(tmp_path), duckdb.connect()
    con.execute(f"""copy (select i as p_partkey, case when i % 40 = 0 then 'the one two three four five six seven' || i // 80 when i % 7 = 0 then '' when i % 11 = 0 then NULL else 'the red ring' || i % 50 || case when i % 3 = 0 then ' ' || i % 9 else ' of bolt' || i end end as p_name,
        'Brand#' || i % 2 as p_brand, 'X' as p_type, (i % 3)::int as p_size from range(900) r(i)) to '{root}/part.parquet' (format parquet)""")
    con.execute(f"create view part as select * from '{root}/part.parquet'")
    pairs, keep = [], dedup.journal_matches
    monkeypatch.setattr(dedup, "journal_matches", lambda local, cand, *a, **k: pairs.append(cand.count()) or keep(local, cand, *a, **k))
    same_as_sql(spark, (root, con), "journal_match_unambiguous")
    assert pairs[0] < 10_000  # 22 or 23 long names with some 130 others in each of 6 groups, not 100,000


def sets_made_above_join(df):
    """Whether the plan splits texts in its last join or above it, where rows are pairs."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(k for k, line in enumerate(lines) if "Join " in line)
    return any("split(" in line for line in lines[: join + 1])


def test_journal_match_without_broadcast(spark, copies):
    """A table too large to be broadcast: the optimizer took the condition apart wrongly."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same_as_sql(spark, copies, "journal_match")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not sets_made_above_join(__spark_entry__.queries()["journal_match"](spark, copies[0]))


@pytest.mark.parametrize("name", ["remote_match_surnames", "remote_match_crossref"])
def test_remote_match_sets_are_made_once(spark, copies, name):
    same_as_sql(spark, copies, name)
    assert not sets_made_above_join(__spark_entry__.queries()[name](spark, copies[0]))


@pytest.mark.parametrize("name", ["remote_match_surnames", "remote_match_crossref"])
def test_remote_match_compares_titles_once(spark, copies, name):
    """The least similarity is asked for after the ranks: in the join's condition titles were compared once more for every pair."""
    plan = __spark_entry__.queries()[name](spark, copies[0])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [line for line in plan if "array_intersect(t#" in line and "Project" in line]
    assert not [line for line in plan if "array_intersect(t#" in line and "Project" not in line]


def test_jaccard_of_sets(spark):
    rows = [(["a", "b"], ["b", "c"]), ([], []), ([], ["a"]), (["a"], ["a"]), (None, ["a"])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(dedup.jaccard(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1 / 3, 0.0, 0.0, 1.0, None]


def test_remote_match_deals_rows_out_before_sets(spark, copies):
    """Candidates come in as few tasks as their file has row groups; sets are made behind the exchange."""
    plan = __spark_entry__.queries()["remote_match_crossref"](spark, copies[0])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [k for k, line in enumerate(plan) if "RepartitionByExpression" in line]
    assert len(dealt) == 2
    assert not any("[^\\p{L}\\p{N}]+" in line for line in plan[dealt[-1] :])


def test_token_jaccard_pairs_on_copies(spark, copies):
    """Contents are paired, not works: four copies of 100 suppliers are 100 contents."""
    same_as_sql(spark, copies, "token_jaccard_pairs")
    rows = [(i, i, f"supplier {i % 10:03d}", "ann" if i % 2 else "", 2000, None) for i in range(400)]
    works, contents = dedup._contents(spark.createDataFrame(rows, "id int, pos int, title string, authors string, year int, fingerprint string"), "left")
    assert works.count() == 400 and contents.count() == 10


def test_token_jaccard_pairs_of_names_that_differ(spark, tmp_path, monkeypatch):
    """The word that all titles have made pairs of all; with an author in common it makes those of an author, each once and in slices."""
    root, con = str(tmp_path), duckdb.connect()
    con.execute(f"copy (select i as s_suppkey, case when i % 31 = 0 then 'Supplier' when i % 37 = 0 then '' when i % 41 = 0 then NULL when i % 43 = 0 then 'Supplier#7 Supplier#8 of ' || i // 2 else 'Supplier#' || lpad(i::varchar, 9, '0') end as s_name, (i % 25)::int as s_nationkey from range(500) r(i)) to '{root}/supplier.parquet' (format parquet)")
    con.execute(f"create view supplier as select * from '{root}/supplier.parquet'")
    met, keep = {}, dedup._meet
    monkeypatch.setattr(dedup, "_meet", lambda a, b, sizes, share, named: met.setdefault((share > 0, named, a.count() > 0), keep(a, b, sizes, share, named)))
    monkeypatch.setattr(dedup, "SLICE", 3)
    same_as_sql(spark, (root, con), "token_jaccard_pairs")
    assert met[True, False, True].count() < 20_000  # 17 titles of that word alone with all others, not 250,000
    named = met[False, True, True]
    assert named.count() == named.select("left", "right").distinct().count() < 15 * 20 * 20
    assert named.select("_slice").distinct().count() > 3


def test_dup_cascade_titles_on_copies(spark, copies):
    same_as_sql(spark, copies, "dup_cascade_titles")


def test_best_similar_pairs_profiles(spark, monkeypatch):
    """Works that differ in their fingerprints alone are not paired before names and years have bounded the best score."""
    kept = {}
    keep = dedup.save
    monkeypatch.setattr(dedup, "save", lambda df, name: kept.setdefault(name, keep(df, name)))
    rows = [(i, i, f"red ring number{i % 10:02d}", "ann lee", 2000 + i % 10, f"{i * 0x9E3779B97F4A7C15 % 2**64:016x}") for i in range(400)]
    works = spark.createDataFrame(rows, "id int, pos int, title string, authors string, year int, fingerprint string")
    got = {r["id"]: r["matched"] for r in dedup.best_similar(works.where("id % 3 <> 0"), works.where("id % 3 = 0"), 0.66).collect()}
    assert kept["profiles"].count() == 10  # a title has its own year; not 267 times 133 pairs
    bits = lambda i, j: (int(rows[i][5], 16) ^ int(rows[j][5], 16)).bit_count()
    assert got == {i: min((j for j in range(0, 400, 3) if j % 10 == i % 10), key=lambda j: (bits(i, j), j)) for i in range(400) if i % 3}


def test_index_postings_are_grouped_in_their_row(spark):
    """Neither tokens nor postings go through an exchange, so nothing but texts is shuffled when an index is written."""
    chunks = spark.createDataFrame([(1, "w", 5, ["b", "a", "b", "c", "b"]), (2, "w", 1, ["a"]), (3, "v", 0, [])], "chunk_id int, work_id string, dl int, own array<string>")
    df = index._postings(chunks)
    assert sorted((r["chunk_id"], r["dl"], r["term"], r["positions"]) for r in df.collect()) == [(1, 5, "a", [1]), (1, 5, "b", [0, 2, 4]), (1, 5, "c", [3]), (2, 1, "a", [0])]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_index_postings_come_sorted_in_pieces(spark, monkeypatch):
    """Every posting was compared with others of its task, text by text; pieces come out sorted, so only numbers of buckets are."""
    texts = {k: [f"t{(k * 7 + i * i) % 13}" for i in range(k % 6)] for k in range(40)}
    chunks = spark.createDataFrame([(k, f"w{k % 3}", len(own), own) for k, own in texts.items()], "chunk_id int, work_id string, dl int, own array<string>").coalesce(1)
    want = {(k, f"w{k % 3}", len(own), t, zlib.crc32(t.encode()) % 5, tuple(i for i, x in enumerate(own) if x == t)) for k, own in texts.items() for t in own}
    for piece in (1, 7, 10**6):
        monkeypatch.setattr(index, "PIECE", piece)
        df = index._postings(chunks, 5)
        got = [(r["chunk_id"], r["work_id"], r["dl"], r["term"], r["bucket"], tuple(r["positions"])) for r in df.collect()]
        assert len(got) == len(want) and set(got) == want
    assert [(r[4], r[3], r[0]) for r in got] == sorted((r[4], r[3], r[0]) for r in got)
    assert "Sort [bucket" in plan_of(df.sortWithinPartitions("bucket")) and "transform(" not in plan_of(df)


def test_fts_postings_builds_its_own_index_only(spark, sf_dir, monkeypatch):
    """The index of the whole table was built for the name of its folder."""
    monkeypatch.setattr(catalogue, "text_index", lambda *a: pytest.fail("not needed"))
    assert __spark_entry__.queries()["fts_postings"](spark, sf_dir).count() == 61


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_version_collapse_makes_no_pairs(spark, copies):
    """A list is folded over against the works kept; its works were paired with each other before."""
    same_as_sql(spark, copies, "version_collapse")
    rows = [(1, k + 1, k, None, None, "one title", 2000 + k % 2) for k in range(3000)]
    table = spark.createDataFrame(rows, "query int, place int, work_id long, doi string, duplicate_of long, title string, year int")
    df = retrieval.collapse_ranked(table, 5)
    assert "Join" not in plan_of(df)
    assert [r["work_id"] for r in df.collect()] == [0]


def test_merges_broadcast_no_mapping(spark, copies, monkeypatch):
    """Every round of the doubling sent the mapping to the driver and back out."""
    for name in ("merge_targets", "merge_chains", "merge_priorities"):
        same_as_sql(spark, copies, name)
    plans, keep = [], state.save
    monkeypatch.setattr(state, "save", lambda df, name: plans.append(plan_of(df)) or keep(df, name))
    mapping = spark.createDataFrame([(k, k - 1) for k in range(1, 40)] + [(50, 51), (51, 50)], "source long, target long")
    works = spark.createDataFrame([(k, None, None) for k in range(60)], "work_id long, year int, duplicate_of long")
    plans.append(plan_of(state.merge_works(works, mapping, ["year"])))
    plans.append(plan_of(state.merged_priorities(works.selectExpr("1 AS project", "work_id", "'one' AS priority"), mapping)))
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)


def test_restore_sorts_no_works(spark, monkeypatch):
    """Works that stay are found by a join that holds the deleted ids alone; a work's names are made distinct in its row."""
    plans, keep = [], manifest.save
    monkeypatch.setattr(manifest, "save", lambda df, name: plans.append(plan_of(df)) or keep(df, name))
    kept = spark.createDataFrame([(10, k, f"t{k}", None, [(k, "queued")], ["b", "a", "b"], [7, 8, 7], []) for k in range(9)], manifest.RECORD)
    names = spark.createDataFrame([("a",)], "name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = manifest.restore(kept, spark.createDataFrame([(1,), (1,), (4,)], "work_id long"), names, names, names, spark.createDataFrame([(7,)], "id long"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plans[0] and "Exchange" not in plan_of(back["work_tags"])
    stay = [k for k in range(9) if k not in (1, 4)]
    assert sorted(map(tuple, back["work_tags"].collect())) == [(k, t) for k in stay for t in "ab"]
    assert sorted(map(tuple, back["work_marks"].collect())) == [(k, 7) for k in stay]
    assert sorted(map(tuple, back["versions"].collect())) == [(k, k, "failed") for k in stay]
    assert back["works"].count() == 7 and [r[0] for r in back["new_tags"].collect()] == ["b"]


def test_duplicate_versions_send_digests(spark):
    """Titles may be whole texts: what meets in the joins is their digest."""
    rows = [(1, "x" * 5000, 2000, None, None), (2, "x" * 5000, 2001, None, None), (3, "x" * 5000, 2003, None, None), (4, "", 2000, None, None), (5, "", 2000, 4, None), (6, None, 2000, None, "d"), (7, "y", 1990, None, "d"), (8, "z", 1980, 9, "e"), (9, "z", 1981, 8, "e"), (10, "w", 1970, 11, None), (11, "w", 1970, 10, None)]
    works = spark.createDataFrame(rows, "id int, title string, year int, duplicate_of int, doi string")
    df = dedup.duplicate_versions(works)
    assert sorted(map(tuple, df.collect())) == [(1, 2), (4, 5), (6, 7), (8, 9), (10, 11)]
    assert "Aggregate" not in plan_of(df)  # each pair is made once
    lines = df._jdf.queryExecution().analyzed().toString().splitlines()
    assert len([line for line in lines if "sha2(" in line]) == 6


def test_simhash_holds_words_of_a_piece(spark, monkeypatch):
    """A batch's texts go in pieces, with the fingerprints of one go; words do not cross to Python one by one."""
    texts = pd.Series(["labor wage " * (k % 5) + f"study{k % 7}" if k % 6 else None for k in range(300)] + ["", "one two"])
    whole = dedup._prints([t.split(" ") if t else [] for t in texts])
    sizes, prints = [], dedup._prints
    monkeypatch.setattr(dedup, "PIECE", 100)
    monkeypatch.setattr(dedup, "_prints", lambda words: sizes.append(sum(map(len, words))) or prints(words))
    assert list(dedup._simhash.func(texts)) == whole
    assert len(sizes) > 50 and max(sizes) < 40
    df = spark.createDataFrame([("a b",)], "t string").select(dedup.simhash64(F.col("t")))
    assert "array_join" in df._jdf.queryExecution().analyzed().toString()


def test_header_lines_are_made_once(spark, sf_dir):
    """The lines of a text were made again for each use of them, in the title's test for each line."""
    df = __spark_entry__.queries()["header_inference"](spark, sf_dir)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    pages = ["\n".join(f"line {k}" for k in range(3000)) + "\nAbstract\n", "T\nby A. B. \nby C†\nThis version: 1\nby D\n", "Abstract of it\nby X", "", None]
    got = spark.createDataFrame(list(enumerate(pages)), "i int, p string").select("i", identifiers.header_title_authors(F.col("p")).alias("f")).orderBy("i").select("f.*").collect()
    assert list(map(tuple, got)) == [("line 0 line 1 line 2 line 3", None), ("T by A. B.", "C"), ("Abstract of it", "X"), (None, None), (None, None)]


def test_metadata_ranking_folds_texts_once(spark):
    """The test of the score was pushed below it, so that every text was folded once more."""
    works = spark.createDataFrame([(1, "Wage Ｌabor", "x"), (2, "Été", "wage"), (3, "none", None), (4, None, "LÁBOR")], "work_id int, title string, abstract_text string")
    df = retrieval.metadata_ranking(works, "wage labor", ["wage", "labor"], 10)
    assert list(map(tuple, df.collect())) == [(1, 120), (2, 10), (4, 10)]
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Filter" in line and "lower(" in line]


def test_fold_leaves_out_what_does_not_occur(spark):
    rows = ["ＬＡＢＯＲ é", "Élan", "ABC", "文献 Ａ", "～！", "", None]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "i int, v string").orderBy("i").select(text.fold(F.col("v"))).collect()]
    assert got == ["labor e", "elan", "abc", "文献 a", "~!", "", None]
