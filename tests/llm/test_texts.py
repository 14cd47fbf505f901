"""Language model, resampling, decontamination, mixing, toxicity and line dedup on small tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import lm
from papyra.llm.decontam import benchmark_leaks, subsequence
from papyra.llm.linededup import drop_boilerplate_lines
from papyra.llm.mixing import mix_sources, mixed_texts, words_taken
from papyra.llm.resample import resample, take_largest
from papyra.llm.toxicity import score_toxicity


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())) + [b"\n"]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_automaton_equals_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "LANE", 7)
    rng, mass = random.Random(order), 3.0
    rows = [(k, " ".join(rng.choice("a b c D e\n").strip() or "x" for _ in range(rng.randrange(0, 30)))) for k in range(60)] + [(60, None), (61, ""), (62, "new words only")]
    rows += [(70 + k, "z y x " * 4 + "rare pair here " * k) for k in range(6)] + [(80, "a b c a b c " * 40)]
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r["doc_id"]: r for r in lm.score_texts(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double"), held, order=order, masses=(mass,), block_bytes=300, range_bytes=500).collect()}
    assert len(got) == len(rows)
    own = {i: tokens(t) for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    n, docs = collections.Counter(), 0
    for i, w in own.items():
        if not out[i]:
            docs += 1
            s = [b"<s>", *w]
            n.update(tuple(s[e - k + 1 : e + 1]) for e in range(1, len(s)) for k in range(1, order + 1) if e - k + 1 >= 0)
    total, types = sum(v for g, v in n.items() if len(g) == 1), sum(1 for g in n if len(g) == 1)

    def p(h, w):
        if not h:
            return (n[(w,)] + 1) / (total + types + 1)
        return (n[(*h, w)] + mass * p(h[1:], w)) / ((docs if h == (b"<s>",) else n[h]) + mass)

    for i, w in own.items():
        s = [b"<s>", *w]
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["train_tokens"]) == (out[i], len(w), total)
        assert got[i]["n_known"] == sum(n[(x,)] > 0 for x in w)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((n[(x,)] + 1) / (total + types + 1)) for x in w))
        assert got[i]["score"] == pytest.approx(sum(math.log10(p(tuple(s[max(0, e - order + 1) : e]), s[e])) for e in range(1, len(s))))


def test_model_of_null_and_repeated_ids(spark):
    rows = [(None, "a b a b"), (1, "a b c"), (1, "a b c"), (2, None), (None, None), (3, "c " * 3000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, n_known string")
    got = [(r["doc_id"], r["n_tokens"], r["train_tokens"]) for r in lm.score_texts(df, F.lit(None).cast("boolean")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(i, len(tokens(t)), 3016) for i, t in rows]))
    assert lm.score_texts(df.limit(0), F.lit(False)).count() == 0


def test_model_is_a_distribution(spark):
    """Over all known words and one unknown, the probabilities after a history sum to one."""
    docs = [(1, "a b a c"), (2, "b a")]
    probes = [(10 + k, f"a {w}") for k, w in enumerate(["a", "b", "c", "zzz"])]
    df = spark.createDataFrame(docs + probes + [(30, "a"), (31, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score_texts(df, F.col("doc_id") >= 10, order=2, masses=(2.0,)).collect()}
    # words after "a", then an end of the text: the end's share is what the text "a" itself has
    def share(i, w):
        return 10 ** (got[i]["score"] - start) / end[w]

    start = math.log10((1 + 2.0 * (3 + 1) / (8 + 4 + 1)) / (2 + 2.0))
    uni = {"a": 4 / 13, "b": 3 / 13, "c": 2 / 13, "zzz": 1 / 13, "$": 3 / 13}
    pairs = {("a", "$"): 1, ("b", "$"): 0, ("c", "$"): 1}
    count = {"a": 3, "b": 2, "c": 1, "zzz": 0}
    end = {w: (pairs.get((w, "$"), 0) + 2.0 * uni["$"]) / (count[w] + 2.0) for w in count}
    total = sum(share(10 + k, w) for k, w in enumerate(["a", "b", "c", "zzz"])) + 10 ** (got[30]["score"] - start)
    assert total == pytest.approx(1.0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert lm.score_texts(docs, F.lit(False)).count() == 0
    assert resample(docs, docs, fraction=0.5).count() == 0
    assert words_taken(mix_sources(docs)).count() == 0 and mixed_texts(mix_sources(docs), docs).count() == 0
    assert drop_boilerplate_lines(docs).count() == 0
    benchmark = spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (None, "x")], "item_id long, text string")
    assert benchmark_leaks(docs, benchmark).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(docs, labels).count() == 0


def test_resample_prefers_the_target(spark):
    rng = random.Random(3)
    good, bad = [f"g{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad) for _ in range(50))) for k in range(200)] + [(200, None), (201, ""), (None, "g1 g2")]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, log_weight double")
    target = df.where("doc_id % 4 = 1 AND doc_id < 200")
    first = resample(df, target, fraction=0.5).collect()
    assert len(first) == round(0.5 * len(rows))
    assert sum(1 for r in first if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] % 2) >= 98
    assert sorted(map(str, resample(df, target, fraction=0.5).collect())) == sorted(map(str, first))
    assert resample(df, target.limit(0), fraction=0.1).count() == round(0.1 * len(rows))


def test_weights_equal_brute_force(spark):
    """Log ratios of all texts: null, empty, one word, very long, repeated rows, and equal texts under several ids, which tie."""
    from papyra.llm.kernel import U, hash_words, mix

    rng, buckets = random.Random(21), 128
    rows = [(k, " ".join(rng.choice("a Bb c dd e f\n").strip() or "x" for _ in range(rng.randrange(2, 40)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "one"), (103, " ".join(rng.choice("abcdefgh") for _ in range(50_000))), (104, "tie tie"), (105, "tie tie"), (106, "tie tie"), rows[0], rows[0], (None, "no id")]
    target = {k for k in range(0, 60, 3)} | {104}

    def grams(text):
        own = [w.decode() for w in tokens(text)[:-1]]
        h = hash_words(own)
        with np.errstate(over="ignore"):
            pairs = mix(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
        return collections.Counter(int(x % U(buckets)) for x in [*h, *pairs])

    own = [(i, grams(t)) for i, t in rows]
    every, good = sum((c for _, c in own), collections.Counter()), sum((c for i, c in own if i in target), collections.Counter())
    want = collections.Counter()
    for i, c in own:
        n, mine = c.total(), i in target
        p = lambda b: (good[b] - mine * c[b] + 1) / (good.total() - mine * n + buckets)  # noqa: B023, E731
        q = lambda b: (every[b] - c[b] + 1) / (every.total() - n + buckets)  # noqa: B023, E731
        want[i, round(sum(k * (math.log(p(b)) - math.log(q(b))) for b, k in c.items()), 6)] += 1
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, tie string").repartition(3)
    got = resample(df, spark.createDataFrame([(i,) for i in target], "doc_id long"), fraction=1.0, buckets=buckets).collect()
    assert collections.Counter((r["doc_id"], round(r["log_weight"], 6)) for r in got) == want


def test_take_largest_is_exact(spark):
    rng = random.Random(2)
    rows = [(k, k % 3, rng.choice([0.0, 1.0, 1e-9, 1e9, rng.gauss(0, 1)])) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, tie long, key double")
    for k in (1, 7, 250, 499, 500, 600):
        want = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:k]
        assert sorted(tuple(r) for r in take_largest(df, "key", k).collect()) == sorted(want)


def test_leaks_whole_and_paraphrased(spark):
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(3000)]
    common = ["the", "of", "a"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(rng.randrange(15, 55))) for k in range(30)]
    docs, want = [], set()
    for d in range(120):
        own = text(rng.randrange(0, 400))
        if d % 4 == 0:
            k, item = items[d // 4]
            copy = [w for w in item if d % 8 or rng.random() > 0.1]
            at = rng.randrange(len(own) + 1)
            own[at:at] = copy
            want.add((d, k))
        docs.append((d, " ".join(w.upper() if d % 3 == 0 else w + "," for w in own)))
    docs += [(500, None), (501, ""), (502, "the of a"), (None, " ".join(items[3][1]))]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(99, None), (98, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_leaks(df, benchmark).collect()}
    assert got == want | {(None, 3)}
    blocks = benchmark_leaks(df, benchmark, block_items=8)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == got
    assert benchmark_leaks(df, benchmark.limit(0)).count() == 0


def test_leaks_of_more_items_than_the_rank(spark):
    rng = np.random.default_rng(12)
    share = 1 / np.arange(1, 2001) ** 0.8
    text = lambda n: [f"v{k}" for k in rng.choice(2000, n, p=share / share.sum())]
    sizes = [9, 20, 20, 20, 300] * 16
    items = [(k, text(n)) for k, n in enumerate(sizes)]
    # each item verbatim among words like its own
    docs = [(k, " ".join(text(44) + item + text(44))) for k, item in items]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_leaks(df, benchmark, rank=32).collect()}
    assert got >= {(k, k) for k, _ in items}, len([k for k, _ in items if (k, k) in got])


def test_subsequence():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    from papyra.llm.decontam import _masks
    import numpy as np

    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        assert subsequence(_masks(np.array(a)), len(a), b) == brute(a, b)


def targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: float(weights[k % 3]) for k, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        share = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mixing_meets_targets(spark):
    rng = random.Random(5)
    rows = [(k, "\t".join("w" for _ in range(rng.randrange(0, 90))), rng.choice(["é", "a", "B", "hot", "hot", "hot", None])) for k in range(400)]
    rows += [(7, None, "a"), (None, "x y z", "z"), (None, "x y z", "z"), (500, "", "empty")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    mixed = mix_sources(df, block_words=16)
    got = words_taken(mixed).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets(dict(sizes))
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = words_taken(mix_sources(df.repartition(7), block_words=16)).collect()
    assert sorted(map(str, again)) != [] and collections.Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == collections.Counter((r["doc_id"], r["size"], r["taken"]) for r in got)
    pieces = mixed_texts(mixed, df).collect()
    assert sum(p["n_words"] for p in pieces) == sum(taken.values()) and all(len(p["text"].split()) == p["n_words"] for p in pieces)
    slots = collections.Counter((p["shard"], p["slot"]) for p in pieces)
    assert max(sum(p["n_words"] for p in pieces if (p["shard"], p["slot"]) == s) for s in slots) <= 16


def test_lines(spark):
    rows = [(k, f"unique {k}\n  cookie notice \n\ncommon", "s1", 99) for k in range(10)] + [(20, "cookie notice", "s2", 13), (21, None, "s1", None), (22, "", "s1", 0), (23, "cookie notice", "s1", 13)]
    rows += [(30 + k, "copy line one\ncopy line two", "s1", 27) for k in range(40)]  # copies of one page are one page
    rows += [(100 + k, f"n{k}\nnull host", None, 1) for k in range(6)]
    got = {r["doc_id"]: r for r in drop_boilerplate_lines(spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, n_chars long, lines_dropped int")).collect()}
    assert got[3]["text"] == "unique 3\n" and got[3]["lines_dropped"] == 2 and got[3]["n_chars"] == 9
    assert got[20]["text"] == "cookie notice" and got[21]["text"] is None and got[22]["text"] == "" and got[23]["text"] == ""
    assert got[31]["text"] == "copy line one\ncopy line two" and got[31]["n_chars"] == 27
    assert got[101]["text"] == "n1"
    wide = drop_boilerplate_lines(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), broadcast_bytes=0)
    assert {r["doc_id"]: r["text"] for r in wide.collect()} == {i: r["text"] for i, r in got.items()}


def test_toxicity_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("x").alias("score"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    odd = spark.createDataFrame([(10**9, None, "x"), (10**9 + 1, "", "x"), (None, "you idiot", "x"), (10**9 + 2, "a " * 200_000, "x")], "doc_id long, text string, score string")
    got = score_toxicity(docs.unionByName(odd), labels.unionByName(spark.createDataFrame([(10**9, None), (None, 1)], "doc_id long, toxic int"))).cache()
    assert got.count() == docs.count() + 4 and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert got.where((F.col("score") >= 0.5) != (F.col("predicted") == 1)).count() == 0
    rows = got.join(labels, "doc_id").where("held_out").select("toxic", "score").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got.where("held_out").limit(50).collect())
    pos, neg = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.75
    assert got.where("doc_id IS NULL").first()["held_out"] is False
    one = score_toxicity(docs.limit(5), labels.where("toxic = 0"))
    assert one.count() == 5


def test_permutations_and_their_inverse():
    import numpy as np

    from papyra.llm.mixing import permute

    for n in (1, 2, 3, 17, 1000, 4097):
        i, size, key = np.arange(n), np.full(n, n), np.full(n, 99, np.uint64)
        out = permute(i, size, key)
        assert sorted(out) == list(range(n)) and (permute(out, size, key, inverse=True) == i).all()


def test_obfuscated_tokens_are_whole():
    import pyarrow as pa

    from papyra.llm.kernel import WORD_BYTE, hash_words, words
    from papyra.llm.toxicity import FEATURES, SEED_LEXICON, features

    seed, you = np.unique(hash_words(SEED_LEXICON)), np.unique(hash_words(["you"]))
    texts = ["such an id1ot", "i-d.i.o.t", "x" * 40 + ".y plain", "", None, "1 st.upid and m0ron\nl.o.s.e.r", "a.b" * 200_000]
    got = [features(f, (np.zeros(0, np.uint64), np.zeros(0)), seed, you) for f in words(pa.array(texts), WORD_BYTE, chunk=1 << 30)]
    assert np.concatenate(got)[:, FEATURES.index("obfuscated_hits")].tolist() == [1, 1, 0, 0, 0, 3, 0]


def test_leaks_against_brute_force(spark):
    """Verbatim, reworded and scattered items among many: found exactly where a search over all places finds them."""
    rng = np.random.default_rng(21)
    share = 1 / np.arange(1, 3001) ** 0.7
    text = lambda n: [f"v{k}" for k in rng.choice(3000, n, p=share / share.sum())]
    items = [(k, text(int(n))) for k, n in enumerate(rng.integers(10, 60, 40))]
    docs = []
    for k, item in items:
        lost = rng.random(len(item))
        lost[-max(3, len(item) // 5) :] = 1  # its answer stays
        reworded = [f"other{rng.integers(1000)}" if x < 0.3 else w for w, x in zip(item, lost, strict=True)]
        docs += [(3 * k, text(30) + item + text(50)), (3 * k + 1, text(40) + reworded + text(20)), (3 * k + 2, text(20) + item[: len(item) // 2] + text(60))]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    def leaks(doc, item):
        n, tail = len(item), item[-max(3, len(item) // 5) :]
        if len(set(doc) & set(item)) < 0.5 * len(set(item)):
            return False
        for at in range(0, len(doc), max(2, n // 8)):
            window = doc[at : at + n + n // 2]
            c = common(item, window)
            if 10 * c >= 8 * n or 10 * c >= 6 * n and 2 * common(tail, window) >= len(tail):
                return True
        return False

    want = {(d, k) for d, doc in docs for k, item in items if leaks(doc, item)}
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in docs] * 2, "doc_id long, text string")  # repeated rows give repeated results
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in benchmark_leaks(df, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect())
    assert set(got) == want and set(got.values()) == {2}


def test_every_verbatim_item_of_a_large_benchmark_is_found(spark):
    rng = np.random.default_rng(22)
    share = 1 / np.arange(1, 20_001) ** 0.8
    text = lambda n: [f"v{k}" for k in rng.choice(20_000, n, p=share / share.sum())]
    items = [(k, text(int(n))) for k, n in enumerate(rng.choice([10, 20, 40, 80, 150, 300, 500], 1000))]
    df = spark.createDataFrame([(k, " ".join(text(25) + item + text(25))) for k, item in items] + [(-1, " ".join(text(60_000)))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_leaks(df, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()}
    assert {(k, k) for k, _ in items} <= got, sorted({(k, k) for k, _ in items} - got)[:9]
    assert not [d for d, _ in got if d == -1]


def test_leak_space_is_fitted_on_all_items_and_no_sample():
    import numpy as np

    from papyra.llm.decontam import latent_space

    rows = np.random.default_rng(1).random((6, 40)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    space = latent_space(np.concatenate([rows, rows[:2]]))
    assert space.shape == (40, 6)
    passage = np.random.default_rng(2).random(40)
    assert np.allclose((passage @ space) @ (rows @ space).T, passage @ rows.T, atol=1e-5)


def test_leak_directions_are_fitted_on_all_passages(spark):
    """The space was fitted on the items alone, before that on a sample of passages."""
    from papyra.llm import decontam

    rng = np.random.default_rng(31)
    # passages of one of six subjects, five words each, of one to six blocks
    docs = [(k, sorted(rng.choice(decontam.BLOCK * 6, 40 * (1 + k % 6) // 2, replace=False).tolist()), k % 6) for k in range(300)]
    rows = [(k, 32 * 6, pos, [int(5 * subject + rng.integers(5)) for _ in pos]) for k, pos, subject in docs] + [(1000, 9, [], []), (None, 0, [], [])]
    hits = spark.createDataFrame(rows, "doc_id long, n_words long, pos array<int>, term array<int>").repartition(7)
    weight = rng.random(33) + 0.5
    whole = np.zeros((0, 33))
    for _, _, pos, term in rows:
        for block in range(6):
            own = np.bincount([t for p, t in zip(pos, term) if block * 32 <= p < block * 32 + 64], minlength=33) * weight
            if own.any():
                whole = np.concatenate([whole, own[None] / np.linalg.norm(own)])
    assert np.allclose(decontam._gram_times(hits, weight, np.eye(33)), whole.T @ whole, atol=1e-3)
    v = np.linalg.svd(whole, full_matrices=False)[2][:6].T
    got = decontam.corpus_space(hits, weight, 20)
    assert np.allclose(got.T @ got, np.eye(20), atol=1e-5) and np.linalg.svd(v.T @ got)[1].min() > 0.99
    assert decontam.corpus_space(hits.limit(0), weight, 12).shape == (33, 0)


def test_leaks_whose_rare_words_were_replaced(spark):
    """What stays of such an item are words that its subject's passages share: its product with the passage is too small, its place in the latent space is near."""
    rng = np.random.default_rng(32)
    text = lambda s, n: [f"s{s % 16}w{k}" for k in rng.integers(0, 60, n)]
    items, docs = [], []
    for k in range(40):
        common, rare = text(k, 24), [f"rare{k}x{i}" for i in range(16)]
        items.append((k, [w for pair in zip(rare, common) for w in pair] + common[16:]))
        around = [f"rare{(k + 1 + i) % 40}x{i % 16}" for i in range(56)]
        docs.append((k, around[:28] + [f"new{rng.integers(9000)}" if w.startswith("rare") else w for w in items[k][1]] + around[28:]))
        docs += [(100 + 20 * k + i, text(k, 192)) for i in range(20)]
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_leaks(df, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()}
    assert {(k, k) for k, _ in items} <= got, sorted({(k, k) for k, _ in items} - got)
