"""Near-duplicates, embeddings and components against brute force."""

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm.components import connected_components
from papyra.llm.minhash import band_count, near_duplicates
from papyra.llm.nndescent import descend, first_lists, near_embeddings
from papyra.llm.scratch import Scratch, shared_dir


def least_of_component(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    df = spark.createDataFrame(pairs, "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "t")).collect()}
    want = least_of_component({x for p in pairs if p[0] != p[1] for x in p}, pairs)
    assert got == want


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert (1 - 0.85**4) ** band_count(0.85) <= 1e-6


def brute_texts(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(own)
    links = [(a, b) for a, b in combinations(sets, 2) if any(x and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    return sets, least_of_component(sets, links)


def near_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 30, 120]))]
        for _ in range(rng.choice([1, 1, 4, 25])):
            copy = list(own)
            for _ in range(rng.randrange(0, max(1, len(own) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(copy) if rng.random() < 0.8 else "\n".join(copy).upper()))
    return rows


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, shingle, percent):
    rows = near_texts(percent) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "two one"), (906, "x" * 300_000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n string")
    got = {r["doc_id"]: r for r in near_duplicates(df, shingle=shingle, percent=percent).collect()}
    sets, component = brute_texts(rows, shingle, percent)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s[0]) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == component
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_families_are_compared_in_full(spark, monkeypatch):
    """A chain of near copies, where no document is near them all, is one component."""
    import papyra.llm.minhash as m

    monkeypatch.setattr(m, "TILE", 4)
    words = [f"v{k}" for k in range(260)]
    rows = []
    for k in range(30):
        own = list(words)
        for j in range(k):
            own[(j * 8) % 260] = f"n{j}"
        rows.append((k + 1, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == brute_texts(rows, 3, 85)[1]


def test_near_duplicates_odd_rows(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (7, "other words are here now"), (9, "other words are here now"), (None, "a b c d e f"), (None, None)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(7, 2, 7, True), (7, 2, 7, True), (7, 1, 7, True), (9, 1, 7, False), (None, 2, None, True), (None, 0, None, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_vectors(rows, cosine):
    ids = sorted({r[0] for r in rows})
    unit = [None if r[1] is None or not r[2:] else r for r in rows]
    n, links = {i: 0 for i in ids}, []
    for a, b in combinations([r for r in unit if r], 2):
        if a[2] is None or b[2] is None or a[2] != b[2]:
            continue
        x, y = np.array(a[1], float), np.array(b[1], float)
        if len(x) == len(y) and np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
            n[a[0]] += 1
            n[b[0]] += 1
            links.append((a[0], b[0]))
    return n, least_of_component(ids, links)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(12):
        base = rng.standard_normal(32)
        for _ in range(int(rng.choice([1, 2, 3, 40]))):
            rows.append((len(rows) + 1, (base + rng.standard_normal(32) * rng.choice([0.01, 0.07, 0.12])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
    rows += [(len(rows) + 1 + k, rows[k][1], rows[k][2]) for k in range(10)]
    k = len(rows)
    rows += [(k + 1, None, 1), (k + 2, [0.0] * 32, 1), (k + 3, [float("nan")] * 32, 1), (k + 4, rows[0][1], None), (k + 5, [1.0, 2.0], 1), (k + 6, [2.0, 4.0], 1), (k + 7, [float("inf")] + [1.0] * 31, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cid string")
    got = {r["vec_id"]: r for r in near_embeddings(df).collect()}
    n, component = brute_vectors(rows, 0.98)
    assert len(got) == len(rows)
    assert {i: r["n_links"] for i, r in got.items()} == n
    assert {i: r["component_id"] for i, r in got.items()} == component


def test_embeddings_empty_and_nulls(spark):
    assert near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    rows = [(None, [1.0, 0.0], 1), (3, [1.0, None], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)]
    got = sorted(map(tuple, near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True)], key=str)


def test_registered_query_on_a_table(spark, sf_dir):
    from papyra.llm.queries import op4_minhash

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where(F.length("text") < 900).collect()]
    got = {r["doc_id"]: r["component_id"] for r in op4_minhash(spark, sf_dir).collect()}
    want = brute_texts(rows, 3, 85)[1]
    # links to longer texts aside, of which there are few, components agree
    assert sum(got[i] != c for i, c in want.items()) <= 0.02 * len(want)


def test_registered_query_is_exact_on_the_whole_table(spark, sf_dir):
    """Every document of the table, long ones included: sizes and components of all pairs that share a shingle, compared by sets."""
    from papyra.llm.queries import op4_minhash

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    holders = {}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    pairs = {p for own in holders.values() if len(own) > 1 for p in combinations(sorted(own), 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = least_of_component(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op4_minhash(spark, sf_dir).collect()}
    assert got == {i: (len(own), want[i], want[i] == i) for i, own in sets.items()}


def dense_label(n, dim, spread, seed):
    """n unit vectors about one direction, at an angle of about ``spread`` from it."""
    rng = np.random.default_rng(seed)
    x = np.eye(dim)[0] + spread * rng.standard_normal((n, dim)) / np.sqrt(dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_doubled_lists_take_farther_neighbours(spark):
    x = dense_label(300, 12, 0.36, 8)
    near = math.cos(3 * math.acos(0.98))
    cosines = x @ x.T
    want = {(a, b) for a in range(300) for b in range(300) if a != b and cosines[a, b] >= near}
    assert len(want) > 40 * 300 and np.median(cosines) < 0.95
    nodes = spark.createDataFrame([(k, 1, v) for k, v in enumerate(x.tolist())], "cid long, label long, vector array<double>")
    scratch = Scratch(spark, "t")
    nodes = scratch.save(nodes, "nodes")
    graph = descend(nodes, first_lists(nodes, range(50, 53), 4, 10), near, 10, scratch, 10)[0]
    got = {(r["p"], r["q"]) for r in graph.where(graph.cosine >= near).collect()}
    assert len(got & want) >= 0.99 * len(want)


def test_groups_of_copies_do_not_hide_lost_links(spark):
    x = dense_label(60, 3, 0.5, 3)
    rows = [(100 * (k + 1), v, 1) for k, v in enumerate(x.tolist())]
    # copies of one vector hold most links, and first lists alone (no rounds) miss others
    rows += [(100000 + k, rows[0][1], 1) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in near_embeddings(df, k=2, bits=2, planes=1, max_rounds=0, attempts=1).collect()}
    n, component = brute_vectors(rows, 0.98)
    assert {i: r["n_links"] for i, r in got.items()} == n
    assert {i: r["component_id"] for i, r in got.items()} == component


def test_audit_asks_every_query_vector(spark):
    """Each id divisible by 100 is the copy of a vector with a smaller id: all of them are audited, and links that are lost are seen."""
    from papyra.llm.nndescent import _audit, audited_near_embeddings

    rng = np.random.default_rng(6)
    pairs = [(v / np.linalg.norm(v)).tolist() for v in rng.standard_normal((99, 8))]
    rows = [(100 * (k + 1), v, 1) for k, v in enumerate(pairs)] + [(100 * (k + 1) - 1, v, 1) for k, v in enumerate(pairs)]
    rows += [(100 * (k + 1) - 50, (np.array(v) + 0.001 * rng.standard_normal(8)).tolist(), 1) for k, v in enumerate(pairs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, recall = audited_near_embeddings(df)
    assert recall == 1.0 and {r["n_links"] for r in got.collect()} == {2}
    classes = spark.createDataFrame([(100 * (k + 1) - 1, 1, v, True) for k, v in enumerate(pairs)], "cid long, label long, vector array<double>, asked boolean")
    assert _audit(classes, 0.98, Scratch(spark, "t")).count() == 99
