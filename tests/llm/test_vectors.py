"""Vector codes and source divergence against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import divergence, vectorcode
from papyra.llm.divergence import share, source_divergence
from papyra.llm.queries import QUERIES
from papyra.llm.vectorcode import Heaps, compress_vectors, decode, nearest_entries, with_label_error


def brute_codes(rows, entries, rounds=4, parts=4, scale=1024):
    """(vec_id, label, entries, error) of rows (vec_id, vector, label), and the codebooks, in plain integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(r[1]) for r in rows), default=0) // parts) * parts
    d = width // parts
    points = [[math.floor(scale * x) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    cut = [[v[p * d : p * d + d] for p in range(parts)] for v in points]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda j: (far(v[p], books[p][j]), j)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, own, strict=True) if a[p] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = assign()
    return [(r[0], r[2], tuple(a), sum(far(v[p], books[p][a[p]]) for p in range(parts))) for r, v, a in zip(rows, cut, own, strict=True)], books


def vectors(seed, n, width):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(6)]
    rows = []
    for k in range(n):
        v = [float(np.float32(c + rng.gauss(0, 0.05))) for c in rng.choice(centres)]
        if k % 17 == 3:
            v = list(rows[k // 2][1] or v)
        rows.append((k * 3 % n, v, rng.choice([0, 1, None])))
    return rows


@pytest.mark.parametrize("width,entries,block", [(8, 7, 50), (16, 16, 7), (6, 5, 4096)])
def test_codes_equal_plain_lloyd(spark, monkeypatch, width, entries, block):
    """Ties and copies, null and repeated ids, bad vectors, widths that parts do not divide, several lengths, clashing names."""
    monkeypatch.setattr(vectorcode, "BLOCK", block)
    rows = vectors(width, 180, width)
    rows += [(None, [0.5] * width, 1), (0, [0.25] * width, None), (5, None, 1), (6, [float("nan")] * width, 1), (7, [0.1, None] + [0.0] * (width - 2), 1), (8, [float("inf")] + [0.0] * (width - 1), 2), (900, [0.5] * (width - 2), 2), (901, [], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, entries string, error int").repartition(3)
    codes, books = compress_vectors(df, entries=entries)
    want, want_books = brute_codes(rows, entries)
    assert books.entries.tolist() == want_books
    assert Counter((r["vec_id"], r["label"], tuple(r["entries"]), r["error"]) for r in codes.collect()) == Counter(want)
    sums = defaultdict(int)
    for _, label, _, error in want:
        sums[label] += error
    assert {(r["label"], r["label_error"]) for r in with_label_error(codes).collect()} == set(sums.items())


def test_large_components_and_few_vectors(spark):
    rows = [(1, [3e4, -2e4, 1.0, 0.0], 0), (2, [3e4, -2e4 + 0.001, 1.5, 0.1], 0), (3, [-9.0, 5e3, 2.5, 0.0], 0)]
    codes, books = compress_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=2)
    want, want_books = brute_codes(rows, 2)
    assert books.entries.tolist() == want_books and {(r["vec_id"], r["error"]) for r in codes.collect()} == {(w[0], w[3]) for w in want}
    huge = compress_vectors(spark.createDataFrame([(1, [3e38, 0.0, 0.0, 0.0], 0), (2, [-3e38, 0.0, 0.0, 0.0], 0)], "vec_id long, embedding array<float>, label int"))[0]
    assert [r["error"] for r in huge.collect()] == [0, 0]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    codes, books = compress_vectors(df)
    assert with_label_error(codes).count() == 0 and books.entries.size == 0
    assert compress_vectors(spark.createDataFrame([(1, [], 0)], "vec_id long, embedding array<float>, label int"))[0].collect()[0]["error"] == 0
    assert source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_bounds_skip_work_and_heaps_stay_heaps():
    rng = np.random.default_rng(3)
    x, book = rng.integers(-300, 300, (500, 4)), rng.integers(-300, 300, (9, 4))
    entry, slack = nearest_entries(x, book)
    square = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == square.argmin(axis=1)).all()
    two = np.sort(np.sqrt(square), axis=1)[:, :2]
    assert (slack <= two[:, 1] - two[:, 0]).all() and np.allclose(slack, two[:, 1] - two[:, 0])
    heaps, still = Heaps([[] for _ in book]), np.zeros(len(book))
    heaps.push(np.arange(500), entry, slack, still)
    rows, of = Heaps.unpack(*(a for a in heaps.pack())).pop(np.full(len(book), 20.0))
    assert set(rows) == set(np.flatnonzero(slack <= 20.0)) and (of == entry[rows]).all() and 0 < len(rows) < 500


def test_decoded_vectors_are_near(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes, books = compress_vectors(df)
    rows = decode(codes, books).join(df.select("vec_id", "embedding"), "vec_id").collect()
    error = sum(sum((a - b) ** 2 for a, b in zip(r["embedding"], r["decoded"], strict=True)) for r in rows)
    assert error < 0.5 * sum(sum(a * a for a in r["embedding"]) for r in rows)


def test_code_query_on_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, books = brute_codes(rows, 256)
    got = QUERIES["op13_heap_lloyd"](spark, sf_dir).collect()
    assert {(r["vec_id"], r["code"], r["error"]) for r in got} == {(w[0], "".join(f"{x:02x}" for x in w[2]), w[3]) for w in want}
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()}


# -- divergence ------------------------------------------------------------------------------


def brute_divergence(rows, min_docs=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = set()
    for lang in {r[0] for r in rows}:
        own = [(s, [w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]) for g, s, t in rows if g == lang]
        docs = Counter(w for _, t in own for w in set(t))
        kept = [w for w, n in docs.items() if n >= min_docs]
        groups = {s: Counter() for s, _ in own}
        for s, t in own:
            groups[s].update(w for w in t if docs[w] >= min_docs)
        whole = sum(groups.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (c.total() + len(kept)) for w in kept}
        shares, q = {s: p(c) for s, c in groups.items()}, p(whole)
        for s, c in groups.items():
            pairs = [(o, sum((shares[s][w] - shares[o][w]) ** 2 // shares[o][w] for w in kept)) for o in groups if o != s]
            terms = [(w, (shares[s][w] - q[w]) ** 2 // q[w]) for w in kept if c[w] and shares[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("rare,chunk,block", [(64, 512, 64), (3, 5, 4), (0, 512, 2), (10**6, 512, 64)])
def test_divergence_against_brute_force(spark, monkeypatch, rare, chunk, block):
    """Both kinds of terms, all heavy, few tiles and many; nulls, empty and long texts, groups without terms, lone sources, ties, repeated rows."""
    monkeypatch.setattr(divergence, "RARE_GROUPS", rare)
    monkeypatch.setattr(divergence, "CHUNK_TERMS", chunk)
    monkeypatch.setattr(divergence, "BLOCK_GROUPS", block)
    monkeypatch.setattr(divergence, "HELD", 500)
    rng = random.Random(rare + chunk)
    vocabulary = ["".join(rng.choice("abcéßΩ字DE") for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    rows = []
    for k in range(300):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice([f"s{rng.randrange(14)}", "é", None])
        rows.append((lang, source, " ".join(rng.choice(vocabulary[: 10 + k % 140]) + rng.choice(["", ",", "1", "_x"]) for _ in range(rng.randrange(0, 30)))))
    rows += [("en", "none", None), ("en", "digits", "12 34"), ("xx", "only", "a b c"), ("yy", "p", "zzz"), ("yy", "q", None), rows[0], rows[0], ("en", "long", " ".join(rng.choice(vocabulary) for _ in range(20000)))]
    df = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "lang string, source string, text string, n int, term string, rank int").repartition(3)
    got = [tuple(r) for r in source_divergence(df, top_terms=20).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, top=20)


def test_share_is_exact_for_large_counts(spark):
    rows = [(1, 3), (7, 7), (10**12 + 1, 3 * 10**15), (2**52, 2**53 - 1), (1, 2**53 - 1), (10**6, 10**6 + 1)]
    got = spark.createDataFrame(rows, "c long, n long").select(share(F.col("c"), F.col("n")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * c // n for c, n in rows]
