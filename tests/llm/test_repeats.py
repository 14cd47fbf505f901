"""The column-wise transform and the removal of repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import suffixdedup
from papyra.llm.queries import QUERIES
from papyra.llm.suffixdedup import column_wise, recurring, remove_repeats


def buffer(texts):
    size = np.array([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size


def test_transform_and_common_prefixes():
    rng = random.Random(5)
    for _ in range(60):
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 9))]
        symbols, prefix, _ = column_wise(*buffer(texts), 10)
        order = sorted([([(1, x) for x in t[j:]] + [(0, k)], k, j) for k, t in enumerate(texts) for j in range(len(t) + 1)])
        code = {x: k for k, x in enumerate(sorted({x for t in texts for x in t}))}
        assert list(symbols) == [code[texts[k][j - 1]] if j else len(code) for _, k, j in order]
        same = [0]
        for (a, _, _), (b, _, _) in zip(order, order[1:], strict=False):
            n = next(i for i in range(len(a)) if a[i] != b[i])
            same.append(min(n, 10))
        assert list(prefix) == same


@pytest.mark.parametrize("length", [1, 3, 300])
def test_recurring_with_weights(length):
    rng = random.Random(length)
    word = [bytes(rng.choice(b"xyz") for _ in range(310)) for _ in range(3)]
    texts = [rng.choice(word)[: rng.randrange(1, 311)] + rng.choice(word)[: rng.randrange(0, 40)] for _ in range(40)]
    weight = np.array([rng.choice([1, 1, 2]) for _ in texts])
    count = Counter()
    for t, w in zip(texts, weight, strict=True):
        for j in range(len(t) - length + 1):
            count[t[j : j + length]] += w
    for t, got in zip(texts, recurring(*buffer(texts), weight, length), strict=True):
        assert list(got) == [count[t[j : j + length]] >= 2 for j in range(len(t) - length + 1)]


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[j : j + length] for t in raw for j in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if count[t[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        spans = sum(1 for j, x in enumerate(gone) if x and (j == 0 or not gone[j - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def digest(df, length):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = remove_repeats(df, length, {"n_removed": removed, "n_spans": F.size("spans"), "h": F.sha2("kept", 256)}).collect()
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in rows)


def texts_with_repeats(seed, n):
    rng = random.Random(seed)
    vocabulary = ["ä" * rng.randrange(0, 2) + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [prose(60) for _ in range(4)]
    texts = [None, "", "", "short", "short", "x" * 3000, "ab" * 150]
    for _ in range(n):
        kind = rng.randrange(6)
        text = prose(rng.randrange(5, 120))
        if kind == 0 and texts:
            text = rng.choice(texts) or ""
        elif kind < 4:
            a, b = sorted((rng.randrange(0, 200), rng.randrange(0, 300)))
            text = prose(rng.randrange(0, 30)) + rng.choice(shared)[a:b] + prose(rng.randrange(0, 30)) + rng.choice(shared)[:a]
        elif kind == 4:
            text = text + text[: rng.randrange(0, 400)]
        texts.append(text)
    texts.append(" ".join([prose(12000), shared[0], prose(12000)]))
    return texts


@pytest.mark.parametrize("length,bucket", [(200, 2048), (40, 2048), (200, 2), (7, 3)])
def test_against_brute_force(spark, monkeypatch, length, bucket):
    """Ids null and repeated, null, empty, short and long texts, whole copies, and (small buckets) anchors that must be split many times."""
    monkeypatch.setattr(suffixdedup, "BUCKET", bucket)
    monkeypatch.setattr(suffixdedup, "SPAN", 5000)
    monkeypatch.setattr(suffixdedup, "COLLECTION", 20000)
    texts = texts_with_repeats(length, 120)
    ids = [None if k % 50 == 7 else k // 2 for k in range(len(texts))]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, k1 int, anchor string").repartition(3)
    assert digest(df, length) == Counter((i, *row) for i, row in zip(ids, brute(texts, length), strict=True))


def test_real_outputs_and_empty_table(spark):
    text = "q" * 30 + "0123456789" * 3
    rows = remove_repeats(spark.createDataFrame([(1, "aaa" + text), (2, text + "b"), (3, "c")], "doc_id long, text string"), 50).collect()
    got = {r["doc_id"]: (bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in rows}
    assert got == {1: (b"aaa", [(3, 63)]), 2: (b"b", [(0, 60)]), 3: (b"c", [])}
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op11_suffix_dedup"](spark, sf_dir).collect()}
    assert got == dict(zip([r["doc_id"] for r in docs], brute([r["text"] for r in docs], 200), strict=True))
