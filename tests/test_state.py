"""Merges over chains, names, running totals, budgeted selection and version collapse against plain rules."""

import random

import pytest
from pyspark.sql import functions as F

from papyra.functions import biblio
from papyra.functions import text as tx
from papyra.operators import manifest, reconcile, retrieval, state
from papyra.sources import bibtex, files, kept


def plain_names(rows, taken):
    """The rule one file at a time."""
    out, used = {}, {}
    for folder, name in taken:
        used.setdefault(folder, set()).add(name.lower())
    for folder, pos, name in sorted(rows, key=lambda r: r[1]):
        own, k = used.setdefault(folder, set()), 1
        pdf, dot = name.lower().endswith(".pdf"), name.rfind(".")
        stem, end = (name[:-4], ".pdf") if pdf else (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
        while True:
            suffix = "" if k == 1 else f" ({k})"
            base = ""
            for c in stem:
                if len((base + c).encode()) <= 255 - len(suffix.encode()) - (20 if pdf else len(end.encode())):
                    base += c
            every = [(base + suffix + e).lower() for e in ((".pdf", ".md", ".assets", "-精读笔记.md", "-精读笔记.assets") if pdf else (end,))]
            if not any(e in own for e in every):
                own.update(every)
                out[folder, pos] = base + suffix + end
                break
            k += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_names_are_unique_in_order(spark, seed):
    """The two probes of a clash and a long name, then random folders with numbers, cases, companions, taken names, and one name that most files share."""
    rng = random.Random(seed)
    stems = ["a", "A", "a (2)", "a (3)", "a (2) (2)", "a-精读笔记", "b", "b (7)", "é" * 130, "é" * 119 + "x", "x" * 300, "x" * 231 + " (2)", "x" * 222, "x" * 222 + " (2)", "lone"]
    rows = [("p", 0, "a.pdf"), ("p", 1, "a.pdf"), ("p", 2, "a (2).pdf"), ("p", 3, "n" * 300 + ".pdf"), ("p", 4, "n" * 300 + ".PDF")]
    rows += [(rng.choice("fg"), 10 + k, rng.choice(stems if k % 3 else ["a", "lone"]) + rng.choice([".pdf", ".PDF"])) for k in range(250)]
    rows += [("m", 300 + k, rng.choice(["a", "a (2)", "b", "only", "z" * 250]) + rng.choice([".pdf", ".md", ".txt", ""])) for k in range(80)] + [("n", 400 + k, "notes.txt") for k in range(5)] + [("n", 410, ".hidden"), ("n", 411, "end.")]
    taken = [("f", "A (5).md"), ("f", "b-精读笔记.assets"), ("g", "lone (2).pdf"), ("h", "a.pdf")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(f, p, n, 1) for f, p, n in rows], "folder string, pos long, name string, _at int").drop("_at")
    got = {(r["folder"], r["pos"]): r["unique"] for r in reconcile.unique_names(df, spark.createDataFrame(taken, "folder string, name string")).collect()}
    assert got == plain_names(rows, taken)
    assert got["p", 0] == "a.pdf" and got["p", 1] == "a (2).pdf" and got["p", 2] == "a (2) (2).pdf"
    assert all(len(n[:-4].encode()) + 20 <= 255 if n.endswith(".pdf") else len(n.encode()) <= 255 for n in got.values()) and len({(k[0], n.lower()) for k, n in got.items()}) == len(rows)


def test_merges_over_chains_and_cycles(spark):
    """Works 3->2->1 with a DOI only in 3, a link to the deleted 2; a cycle 10->11->10 with a tail 12->11."""
    works = spark.createDataFrame([(1, None, 2000, None), (2, None, None, 1), (3, "10.1/c", 1990, 2), (4, None, 1, 2), (10, None, None, 11), (11, "10.1/k", None, 10), (12, "10.1/l", 5, 11), (20, "d", 1, 20)], "work_id long, doi string, year int, duplicate_of long")
    mapping = spark.createDataFrame([(3, 2), (2, 1), (10, 11), (11, 10), (12, 11), (20, 20)], "source long, target long")
    ends = {(r["source"], r["target"], r["steps"]) for r in state.final_targets(mapping).collect()}
    assert ends == {(3, 1, 2), (2, 1, 1), (11, 10, 1), (12, 10, 2)}
    got = {r["work_id"]: (r["doi"], r["year"], r["duplicate_of"]) for r in state.merge_works(works, mapping, ["doi", "year"]).collect()}
    assert got == {1: ("10.1/c", 2000, None), 4: (None, 1, 1), 10: ("10.1/k", 5, None), 20: ("d", 1, None)}
    assert {(r["work_id"], r["merged_into"]) for r in state.tombstones(mapping).collect()} == {(2, 1), (3, 1), (11, 10), (12, 10)}
    places = spark.createDataFrame([("p", 1, "one"), ("p", 3, "completed"), ("q", 2, "three"), ("q", 4, "none")], "project string, work_id long, priority string")
    assert {tuple(r) for r in state.merged_priorities(places, mapping).select("project", "work_id", "priority").collect()} == {("p", 1, "completed"), ("q", 1, "three"), ("q", 4, "none")}


@pytest.mark.parametrize("n", [1, 2, 17, 64])
def test_long_chains(spark, n):
    mapping = spark.createDataFrame([(k, k - 1) for k in range(1, n + 1)], "source long, target long")
    assert {(r["source"], r["target"], r["steps"]) for r in state.final_targets(mapping).collect()} == {(k, 0, k) for k in range(1, n + 1)}


def test_running_totals_and_counts(spark):
    rows = [(k, k % 3 if k % 2 else 0, float(k % 7)) for k in range(500)]
    df = spark.createDataFrame(rows, "pos long, key long, cost double").repartition(6)
    got = {r["pos"]: r["before"] for r in kept.running_total(df, ["pos"], F.col("cost"), "before").collect()}
    assert got == {k: sum(r[2] for r in rows[:k]) for k in range(500)}
    at = {r["pos"]: r["n"] for r in kept.running_count(df, ["key"], "pos", "n").collect()}
    assert at == {k: sum(1 for r in rows[: k + 1] if r[1] == rows[k][1]) for k in range(500)}


def test_selection_and_collapse_equal_the_plain_rules(spark):
    """Many queries at once against the rule for one, priority works included."""
    rng = random.Random(9)
    rows, plain = [], {}
    for q in range(120):
        works = [[(f"{q}-{w}-{d}", rng.randrange(1, 60)) for d in range(rng.randrange(1, 5))] for w in range(rng.randrange(1, 9))]
        plain[q] = works
        rows += [(q, w + 1, d + 1, p, s) for w, own in enumerate(works) for d, (p, s) in enumerate(own)]
    df = spark.createDataFrame(rows, "query int, work int, depth int, passage string, size int").repartition(5)
    for most, budget, priority in [(6, 150, 0), (6, 150, 2), (9, 400, 10), (1, 1000, 3), (4, 10, 1)]:
        got = {}
        for r in retrieval.select_passages(df, most, budget, priority).orderBy("query", "position").collect():
            got.setdefault(r["query"], []).append(r["passage"])
        assert got == {q: x for q, own in plain.items() if (x := retrieval.select_for_rerank(own, most, budget, priority))}
    ranked = [(q, k + 1, q * 100 + k, rng.choice(["d1", "d2", "", None]), rng.choice([None, q * 100 + rng.randrange(9)]), rng.choice(["t", "u", "", None]), rng.choice([2000, 2001, 2003, None])) for q in range(60) for k in range(9)]
    table = spark.createDataFrame(ranked, "query int, place int, work_id long, doi string, duplicate_of long, title string, year int")
    for limit in (3, 20):
        got = {}
        for r in retrieval.collapse_ranked(table, limit).orderBy("query", "place").collect():
            got.setdefault(r["query"], []).append(r["work_id"])
        for q in range(60):
            own = [dict(zip(("place", "work_id", "doi", "duplicate_of", "title", "year"), r[1:], strict=True)) for r in ranked if r[0] == q]
            assert got[q] == retrieval.collapse_versions(own, limit)


def test_names_and_entries_by_example(spark):
    rows = spark.createDataFrame([(1, "A: Study/2", "Doe, Jane; Roe, J; Poe, A", 2024, True, "raw.pdf"), (2, "T", "X", 2000, False, "my *file.PDF")], "id int, t string, a string, y int, c boolean, o string")
    got = [r[0] for r in rows.orderBy("id").select(biblio.archive_filename(F.col("t"), F.col("a"), F.col("y"), F.col("c"), F.col("o"), F.lit(""))).collect()]
    assert got == ["Doe et al. - 2024 - A Study 2.pdf", "my file.pdf"]
    rows = spark.createDataFrame([(1, "Doe2024Paper", "A & B", "Jane Doe; J Roe", 2024, "Jrnl", None), (2, "k", "", "x", 2000, None, None)], "id int, k string, t string, a string, y int, j string, d string")
    got = [r[0] for r in rows.orderBy("id").select(biblio.bibtex_entry(F.col("k"), F.lit("article"), F.col("t"), F.col("a"), F.col("y"), F.col("j"), F.col("d"))).collect()]
    assert got == ["@article{Doe2024Paper,\n  title = {A \\& B},\n  author = {Jane Doe and J Roe},\n  year = {2024},\n  journal = {Jrnl}\n}", None]
    keys = files.unique_keys(spark.createDataFrame([(1, "Doe2024Paper"), (2, "Doe2024Paper"), (3, "Doe2024Papera")], "pos int, key string"))
    assert [r["unique"] for r in keys.orderBy("pos").collect()] == ["Doe2024Paperb", "Doe2024Paperc", "Doe2024Papera"]


def test_bibtex_files_are_cut_anywhere(spark, tmp_path):
    """Entries over many splits of a few hundred bytes; values with lines that begin with @, text before the first entry, Windows line ends."""
    entry = lambda k: f"@article{{k{k},\n  title = {{Title {k}" + (f"\n@home {{and}} more {k}" if k % 7 == 0 else "") + "},\n  year = 2000\n}"
    (tmp_path / "a.bib").write_text("% written by hand\n\n" + "\n\n".join(entry(k) for k in range(400)) + "\n")
    (tmp_path / "b.bib").write_bytes("\r\n\r\n".join(entry(k).replace("\n", "\r\n") for k in range(400, 430)).encode())
    (tmp_path / "c.bib").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = bibtex.read_bibtex(spark, str(tmp_path)).select(bibtex.parse_bibtex("entry").alias("e")).select(F.col("e")["@key"].alias("k"), F.col("e")["title"].alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["k"], r["t"]) for r in rows) == sorted((f"k{k}", f"Title {k}" + (f" @home {{and}} more {k}" if k % 7 == 0 else "")) for k in range(430))


def test_manifest_versions_rotate(spark, tmp_path):
    """The current manifest is replaced whole; the newest backups stay; a damaged or newer one is passed over."""
    root = str(tmp_path / "library")
    one = lambda title: spark.createDataFrame([(10, 1, title, None, [], ["t"], [], [])], manifest.RECORD)
    title = lambda: [r["title"] for r in manifest.current(spark, root).collect()]
    assert title() == []
    for k in range(5):
        manifest.commit(one(f"v{k}"), root, f"2024-01-0{k}", keep=2)
        assert title() == [f"v{k}"]
    assert sorted(p.name for p in (tmp_path / "library" / "backups").iterdir()) == ["2024-01-03", "2024-01-04"]
    part = next((tmp_path / "library" / "current").glob("part-*"))
    part.write_text('{"schemaVersion": 10, "id": 1, "ti')
    (part.parent / f".{part.name}.crc").unlink()
    assert title() == ["v3"]
    manifest.commit(one("v9").withColumn("schemaVersion", F.lit(99)), root, "2024-01-05")
    assert title() == ["v3"]


def test_natural_order(spark):
    tags = ["b 10", "B 9", "b  9", "", " a", "b 010", "Émile", "emile 2", "zeta", "2", "10", "1"]
    got = spark.createDataFrame([(tags,)], "t array<string>").select(tx.natural_tags(F.col("t"))).first()[0]
    assert got == ["1", "2", "10", "a", "B 9", "b 010", "b 10", "Émile", "emile 2", "zeta"]
