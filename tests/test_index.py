"""The kept index against the search without one, and what its updates touch."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from papyra.functions.text import query_terms
from papyra.operators import fts, retrieval
from papyra.operators.index import KeptIndex
from papyra.operators.search import smart_search
from papyra.streaming.upkeep import index_stream

QUERIES = [("alpha beta", "anyTerm"), ("alpha beta", "allTerms"), ("beta gamma alpha", "exactPhrase"), ('"alpha alpha" delta', "anyTerm"), ("经济学 alpha", "allTerms"), ("absent", "anyTerm"), ("", "anyTerm")]


def rows(seed, works):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "经济学习", *[f"w{k}" for k in range(30)]]
    return [(w * 10 + k, w, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))) or None) for w in works for k in range(3)]


def table(spark, data):
    return spark.createDataFrame(data, "chunk_id long, work_id long, text string")


def same_rows(index, chunks):
    for text, mode in QUERIES:
        plain = [(r["chunk_id"], round(r["relevance"], 9)) for r in fts.keyword_search(chunks, text, mode, 50, cap=2).collect()]
        assert [(r["chunk_id"], round(r["relevance"], 9)) for r in index.search(text, mode, 50, cap=2).collect()] == plain, text


def files(root, name):
    return {str(p) for p in Path(root, name).rglob("part-*")}


def test_updates_deletes_and_compaction(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "index"), buckets=16)
    data = rows(1, range(40))
    assert index.update(table(spark, data)) == 0
    same_rows(index, table(spark, data))
    # one work changes: its terms' buckets get a file, nothing is overwritten
    before = files(index.root, "postings")
    data = [r for r in data if r[1] != 7] + [(70, 7, "alpha onlyhere")]
    index.update(table(spark, [r for r in data if r[1] == 7]))
    new = files(index.root, "postings") - before
    assert before <= files(index.root, "postings") and len({os.path.basename(os.path.dirname(f)) for f in new}) <= 2
    same_rows(index, table(spark, data))
    # works go, one of them twice, and come back
    index.update(None, table(spark, [(0, 3, ""), (0, 4, "")]))
    index.update(table(spark, [(30, 3, "beta beta")]), table(spark, [(0, 4, ""), (0, 999, "")]))
    data = [r for r in data if r[1] not in (3, 4)] + [(30, 3, "beta beta")]
    same_rows(index, table(spark, data))
    assert index.size()[0] == len(data)
    old = index.generations()
    assert index.compact() == old[-1] + 1 and index.generations() == [old[-1] + 1]
    same_rows(index, table(spark, data))
    index.update(table(spark, [(31, 3, "gamma")]))
    same_rows(index, table(spark, [r for r in data if r[1] != 3] + [(31, 3, "gamma")]))


def test_sync_writes_what_differs(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "index"))
    data = rows(2, range(20))
    index.sync(table(spark, data))
    assert index.sync(table(spark, data)) is None
    data = [r for r in data if r[1] not in (5, 6)] + [(60, 6, "alpha new"), (500, 50, "beta")]
    now = index.sync(table(spark, data))
    assert {r["work_id"] for r in spark.read.parquet(f"{index.root}/chunks/generation={now}").collect()} == {6, 50}
    same_rows(index, table(spark, data))


def test_half_written_generation_does_not_count(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "index"))
    data = rows(3, range(10))
    index.update(table(spark, data))
    table(spark, [(1, 1, "x")]).withColumn("dl", F.lit(1)).withColumn("digest", F.lit(1)).write.parquet(f"{index.root}/chunks/generation=1")
    same_rows(index, table(spark, data))
    index.update(table(spark, [(990, 99, "alpha alpha")]))
    same_rows(index, table(spark, [*data, (990, 99, "alpha alpha")]))


def test_scope_and_all_terms(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "index"))
    chunks = table(spark, rows(4, range(30)))
    index.update(chunks)
    allowed = chunks.where("work_id % 3 = 0").select("work_id")
    plain = fts.keyword_search(chunks, "alpha beta", "anyTerm", 20, allowed, 1)
    assert [r["chunk_id"] for r in index.search("alpha beta", "anyTerm", 20, allowed, 1).collect()] == [r["chunk_id"] for r in plain.collect()]
    want = {(r["chunk_id"], round(r["relevance"], 9)) for r in fts.search_all_terms(chunks, "alpha beta", 30).collect()}
    assert {(r["chunk_id"], round(r["relevance"], 9)) for r in index.search_all_terms("alpha beta", 30).collect()} == want


def test_compaction_when_a_fifth_is_dead(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "index"))
    assert not index.compact_if_needed()
    index.update(table(spark, [(w, w, "alpha beta gamma delta") for w in range(10)]))
    index.update(None, table(spark, [(0, 1, "")]))
    assert not index.compact_if_needed()
    index.update(None, table(spark, [(0, 2, "")]))
    assert index.compact_if_needed() and len(index.generations()) == 1 and not index.compact_if_needed()
    assert index.search("alpha").count() == 8 and index.size() == (8, 32)


def test_empty_table(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "index"))
    index.update(table(spark, []))
    assert index.search("alpha").count() == 0 and index.size() == (0, 0)
    index.update(table(spark, [(1, 1, "alpha")]))
    assert [r["chunk_id"] for r in index.search("alpha").collect()] == [1]


@pytest.mark.parametrize("restart", [False, True])
def test_stream_of_changes(spark, tmp_path, restart):
    """Snapshots arrive in files; the index holds the last version of each work, also when the stream restarts and a micro-batch is written again."""
    source, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    index = KeptIndex(spark, str(tmp_path / "index"))
    first = rows(5, range(12))
    table(spark, first).coalesce(1).write.parquet(str(source / "a"))
    schema = "chunk_id long, work_id long, text string"
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
    index_stream(stream(), index, checkpoint, once=True).awaitTermination()
    if restart:  # the last commit is lost: the batch is run again and replaces its generation
        for f in Path(checkpoint, "commits").glob("*0*"):
            f.unlink()
    second = [(20, 2, "alpha changed"), (21, 2, "beta"), (300, 30, "gamma")]
    table(spark, second).coalesce(1).write.parquet(str(source / "b"))
    index_stream(stream(), index, checkpoint, once=True).awaitTermination()
    now = [r for r in first if r[1] != 2] + second
    same_rows(index, table(spark, now))
    assert index.size()[0] == len(now)


def test_smart_search_by_plain_rules(spark, tmp_path):
    """Two passages a work, openings, reserved works, a work without passages, and versions, against the rules on plain lists."""
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", *[f"w{k}" for k in range(25)]]
    data = [(w * 100 + k, w, " ".join(rng.choice(words) for _ in range(rng.randrange(4, 30)))) for w in range(60) if w != 7 for k in range(rng.randrange(1, 6))]
    index = KeptIndex(spark, str(tmp_path / "index"))
    index.update(table(spark, data))
    about = {w: (f"alpha {w}" if w in (7, 8) else f"paper {w // 3}", 2000 + w % 2, f"10.1/{w // 2}" if w % 5 == 0 else None, w - 1 if w % 9 == 4 else None) for w in range(60)}
    works = spark.createDataFrame([(w, t, y, d, u, f"about {w}") for w, (t, y, d, u) in about.items()], "work_id long, title string, publication_year int, doi string, duplicate_of long, abstract_text string")
    near = {c: [rng.random(), rng.random()] for c, _, _ in data}
    vectors = spark.createDataFrame([(c, w, near[c]) for c, w, _ in data], "chunk_id long, work_id long, vector array<double>")
    query, probe = "alpha beta", [1.0, 0.3]
    got = smart_search(index, vectors, works, query, probe, asked=5).orderBy("place").collect()

    limits = retrieval.DEPTHS["fast"]
    keyword = [(r["work_id"], r["chunk_id"]) for r in index.search(query, "anyTerm", limits.channel, cap=2).orderBy(F.col("relevance").desc(), "chunk_id").collect()]
    semantic, taken = [], {}
    for c in sorted(near, key=lambda c: (-(near[c][0] + 0.3 * near[c][1]), c)):
        if taken.setdefault(c // 100, 0) < 2:
            taken[c // 100] += 1
            semantic.append((c // 100, c))
    semantic = semantic[: limits.channel]
    text = {w: f"{t}\nabout {w}\n{y}" + (f"\n{d}" if d else "") for w, (t, y, d, _) in about.items()}
    score = {w: sum(10 for q in ("alpha", "beta") if q in text[w]) + (100 if query in about[w][0] else 0) for w in about}
    meta = sorted((w for w in about if score[w]), key=lambda w: (-score[w], w))[: limits.channel]
    fusion = {}
    for ranks in (list(dict.fromkeys(w for w, _ in keyword)), list(dict.fromkeys(w for w, _ in semantic)), meta):
        for k, w in enumerate(ranks, 1):
            fusion[w] = fusion.get(w, 0) + 1 / (60 + k)
    fused = sorted(fusion, key=lambda w: (-round(fusion[w], 12), w))[: limits.fused]
    body, tokens = {c: t for c, _, t in data}, lambda t: {x for x in __import__("re").split(r"[^\w]+|_", t.lower()) if x}
    lists, raw = [], {}
    for w in fused:
        s = {}
        for hits in (keyword, semantic):
            for k, c in enumerate([c for x, c in hits if x == w], 1):
                s[c] = s.get(c, 0) + 1 / (60 + k)
        own = sorted(s, key=lambda c: (-round(s[c], 12), c))[:2]
        first = min((c for c, x, _ in data if x == w), default=None)
        if first is not None and first not in own:
            own.insert(min(1, len(own)), first)
        rows_ = []
        for c in own or [None]:
            t, y, d, _ = about[w]
            doc = f"Title: {t}\nYear: {y}" + (f"\nDOI: {d}" if d else "") + "\n" + (body[c] if c is not None else f"about {w}")
            name = str(c) if c is not None else f"metadata:{w}"
            a, b = tokens(query), tokens(doc)
            raw[name] = (w, round(len(a & b) / len(a | b), 12), c)
            rows_.append((name, len(doc)))
        lists.append(rows_)
    chosen = [raw[p] for p in retrieval.select_for_rerank(lists, limits.passages, limits.characters, 5)]
    best = {}
    for w, r, _ in chosen:
        best[w] = max(best.get(w, 0), r)
    order = sorted(best, key=lambda w: (-best[w], -round(fusion[w], 12), w))
    want = retrieval.collapse_versions([{"work_id": w, "title": about[w][0], "year": about[w][1], "doi": about[w][2], "duplicate_of": about[w][3]} for w in order], 5)
    assert [r["work_id"] for r in got] == want and [r["raw"] for r in got] == [pytest.approx(best[w]) for w in want]
    low, high = min(r for _, r, _ in chosen), max(r for _, r, _ in chosen)
    assert [r["score"] for r in got] == [pytest.approx((best[w] - low) / (high - low)) for w in want]
    for r in got:
        assert set(r["passages"] or []) <= {c for w, _, c in chosen if w == r["work_id"]} and len(r["passages"] or []) == min(2, sum(1 for w, _, c in chosen if w == r["work_id"] and c is not None))
    assert query_terms(query) == ["alpha", "beta"]
