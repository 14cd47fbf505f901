"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all texts keeps, for each document, the positions of words that occur in
   the benchmark; no other word can match.  Everything below reads that table.
2. Passages are windows of two neighbouring blocks of BLOCK words.  Document frequencies of
   all passages give TF-IDF weights.
3. A randomised SVD of the TF-IDF rows A of all passages, no sample of them, gives the latent
   space: a pass over every passage adds up A'(A M), M random.
4. Every passage is compared with every item.  Pairs whose TF-IDF cosine is above ``cosine``,
   less for very short and very long items, are candidates, so verbatim items are found however
   many items there are.  So are pairs with half of that, as where an item's rarest words were
   replaced, whose cosine in the latent space is above ``cosine``.
5. A candidate is confirmed by the longest common subsequence of the item's words and the
   document's words around the place, and by the item's last words (its answer).

The benchmark is a stated query set: it is taken in blocks of ``block_items`` items, so what
goes to the executors is bounded by that number and not by the tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.kernel import WORD_BYTE, lean, words
from papyra.llm.scratch import Scratch

BLOCK = 32
#: Passages of a product at once: what is made for them stays in the processor's cache.
PIECE = 128
#: Rows of a sum that are sent together, and what a 1 is in sums of whole numbers.
ROWS_OF_Z, UNIT = 64, 1 << 20


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    """The hashed words of each text."""
    column = pc.utf8_lower(pa.array([t or "" for t in texts], pa.string()))
    out = []
    for found in words(column, WORD_BYTE):
        every = found.hash
        out += [every[found.bounds[k] : found.bounds[k + 1]] for k in range(found.hi - found.lo)]
    return out


def _find(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index in the sorted vocabulary, or -1; a table of 16 leading bits rules most words out."""
    lead = np.zeros(1 << 16, bool)
    lead[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    out = np.full(len(hashes), -1, np.int32)
    maybe = np.flatnonzero(lead[(hashes >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    good = vocabulary[at] == hashes[maybe]
    out[maybe[good]] = at[good]
    return out


def _hits(vocabulary_bytes: bytes):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = np.frombuffer(vocabulary_bytes, np.uint64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                pos, term, ends, sizes = [], [], [0], []
                for found in words(pc.utf8_lower(batch.column("text")), WORD_BYTE):
                    index = _find(vocabulary, found.hash)
                    at = np.flatnonzero(index >= 0)
                    inside = np.searchsorted(at, found.bounds)
                    pos.append((at - np.repeat(found.bounds[:-1], np.diff(inside))).astype(np.int32))
                    term.append(index[at])
                    ends += list(ends[-1] + inside[1:])
                    sizes.append(np.diff(found.bounds))
                offsets = pa.array(np.array(ends, np.int32))
                join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.concatenate(sizes).astype(np.int64)), pa.ListArray.from_arrays(offsets, join(pos)), pa.ListArray.from_arrays(offsets, join(term))],
                    ["doc_id", "n_words", "pos", "term"],
                )

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, term) of all hits of a batch."""
    pos, term = batch.column("pos"), batch.column("term")
    count = pc.list_value_length(pos).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), count), pos.flatten().to_numpy(), term.flatten().to_numpy()


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            yield batch.slice(lo, size)


def _cells(row: np.ndarray, pos: np.ndarray, term: np.ndarray, d: int) -> tuple[np.ndarray, int]:
    """Sorted (passage, term) keys, passage * d + term, and the width of a row of passages.

    A hit is in the two windows that its block begins and ends; passage = row * width + block.
    """
    block = (pos // BLOCK).astype(np.int64)
    width = int(block.max()) + 1 if len(block) else 1
    key = (row * width + block) * d + term
    return np.sort(np.concatenate([key, key[block > 0] - d])), width


def _frequencies(d: int):
    """Rows (term, n): passages that hold the term; term -1: passages."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(d + 1, np.int64)
        for batch in _slices(batches, 512):
            row, pos, term = _flat(batch)
            key, _ = _cells(row, pos, term, d)
            if len(key):
                n[:d] += np.bincount(key[np.concatenate([[True], key[1:] != key[:-1]])] % d, minlength=d)
            n[d] += int(np.maximum(1, -(-batch.column("n_words").to_numpy() // BLOCK)).sum())
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == d, -1, at)), pa.array(n[at])], ["term", "n"])

    return run


def _rows(row: np.ndarray, pos: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages as L2-normalised TF-IDF rows: row, block, where each starts, terms, values."""
    used, d = weight[term] > 0, len(weight)
    key, width = _cells(row[used], pos[used], term[used], d)
    if not len(key):
        return key, key, key, key, np.zeros(0, np.float32)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.concatenate([new, [len(key)]]))
    passage, terms = np.divmod(key[new], d)
    value = tf * weight[terms]
    start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    norm = np.sqrt(np.add.reduceat(value * value, start))
    value = (value / np.repeat(norm, np.diff(np.concatenate([start, [len(value)]])))).astype(np.float32)
    return *np.divmod(passage[start], width), start, terms, value


def _times(start: np.ndarray, terms: np.ndarray, value: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    out, bounds = np.zeros((len(start), matrix.shape[1]), np.float32), np.append(start, len(terms))
    for lo in range(0, len(start), PIECE):
        part = bounds[lo : lo + PIECE + 1]
        rows = matrix[terms[part[0] : part[-1]]]
        rows *= value[part[0] : part[-1], None]
        np.add.reduceat(rows, part[:-1] - part[0], axis=0, out=out[lo : lo + PIECE])
    return out


def _products(start: np.ndarray, terms: np.ndarray, value: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray], m: int) -> np.ndarray:
    """The products of passages with m items, of which postings has, by term, where its entries begin, and of each the item and its value."""
    first, item, own = postings
    count = np.diff(first)[terms]
    passage = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(terms))))
    at = np.repeat(first[terms] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return np.bincount(np.repeat(passage * m, count) + item[at], np.repeat(value, count) * own[at], len(start) * m).reshape(-1, m)


def _of(start: np.ndarray, terms: np.ndarray, value: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of some passages."""
    size = np.diff(np.append(start, len(terms)))
    kept = np.repeat(np.bincount(passages, minlength=len(start)) > 0, size)
    return np.cumsum(size[passages]) - size[passages], terms[kept], value[kept]


def _item_rows(items: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """The items as dense normalised TF-IDF rows over the terms."""
    out = np.zeros((len(items), len(weight)), np.float32)
    for k, own in enumerate(items):
        np.add.at(out[k], own, 1.0)
    out *= weight
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)


def _gram_times(hits: DataFrame, weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A'(A M), where A has the TF-IDF rows of all passages.

    A task adds up its passages and sends pieces of whole numbers, so the sum is the same in any order.
    """
    d, k = matrix.shape
    packed = (weight.astype(np.float64).tobytes(), matrix.astype(np.float32).tobytes())
    piece = lambda parts, rows: pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["part", "rows"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m = np.frombuffer(packed[0]), np.frombuffer(packed[1], np.float32).reshape(d, k)
        total = np.zeros((d, k))
        for batch in _slices(batches, 64):
            _, _, start, terms, value = _rows(*_flat(batch), w)
            if not len(start):
                continue
            y = _times(start, terms, value, m)
            passage = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(terms))))
            order = np.argsort(terms, kind="stable")
            own = terms[order]
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            rows = y[passage[order]]
            rows *= value[order, None]
            total[own[at]] += np.add.reduceat(rows, at, axis=0)
        whole = np.rint(total * UNIT).astype(np.int64)
        parts = [p for p in range(0, d, ROWS_OF_Z) if whole[p : p + ROWS_OF_Z].any()]
        yield piece(parts, [whole[p : p + ROWS_OF_Z] for p in parts])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if part != now and now is not None:
                    yield piece([now], [total])
                total = np.frombuffer(rows, np.int64) + (total if part == now else 0)
                now = part
        if now is not None:
            yield piece([now], [total])

    sums = hits.mapInArrow(run, "part long, rows binary").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part long, rows binary")
    out = np.zeros((d, k))
    for p in sums.collect():  # as large as M
        rows = np.frombuffer(p["rows"], np.int64).reshape(-1, k)
        out[p["part"] : p["part"] + len(rows)] = rows / UNIT
    return out


def latent_space(rows: np.ndarray) -> np.ndarray:
    """The right singular vectors (terms x rank) of the rows, all that are not 0, the leading ones first."""
    _, size, v = np.linalg.svd(rows.astype(np.float64), full_matrices=False)
    return np.ascontiguousarray(v[size > 1e-6 * max(size[0], 1e-30)].T, np.float32)


def corpus_space(hits: DataFrame, weight: np.ndarray, rank: int) -> np.ndarray:
    """The latent space (terms x rank) of the TF-IDF rows of all passages: a randomised SVD, which finds the leading directions from A'(A M)."""
    return latent_space(_gram_times(hits, weight, np.random.default_rng(5).standard_normal((len(weight), min(rank, len(weight))))).T)


def subsequence(masks: dict[int, int], n: int, sequence: list[int]) -> int:
    """Length of the longest common subsequence with an n-word item, of which masks has each word's places."""
    every = (1 << n) - 1
    v = every
    for t in sequence:
        m = masks.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & every
    return n - v.bit_count()


def _masks(item: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, t in enumerate(item.tolist()):
        out[t] = out.get(t, 0) | 1 << k
    return out


def in_reach(counts: np.ndarray, which: np.ndarray, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether so many of an item's words are among the hits from lo to hi, in any order, that they could be a leak; counts has the words of each item."""
    size, n = hi - lo, counts.sum(axis=1)[which]
    pair = np.repeat(np.arange(len(lo)), size)
    near = term[np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)]
    most = counts[which[pair], near]
    pair, near, most = (x[most > 0] for x in (pair, near, most))
    _, first, times = np.unique(pair * counts.shape[1] + near, return_index=True, return_counts=True)
    common = np.bincount(pair[first], np.minimum(times, most[first]), len(lo))
    return np.where(n < 8, common == n, 10 * common >= 6 * n)


def confirm(item: np.ndarray, masks: dict[int, int], answer: dict[int, int], n_answer: int, pos: np.ndarray, term: np.ndarray, weight: np.ndarray, lo: int, hi: int) -> tuple[int, int, bool]:
    """(common, first word, leak) of an item among the hits of one document between words lo and hi.

    The item's place is where most of its rarer words agree; the window there holds one and
    a half times its words.  A leak has at least 80 % of the item's words in order, or 60 %
    with half of its answer; an item of fewer than eight words must be there whole.
    """
    n = len(item)
    a, b = np.searchsorted(pos, [lo - n, hi + n])
    near_pos, near = pos[a:b], term[a:b]
    # each hit votes for the places that put one of the item's equal words on it
    by = np.argsort(item, kind="stable")
    first, last = (np.searchsorted(item[by], near, side=s) for s in ("left", "right"))
    hit = np.repeat(np.arange(len(near)), last - first)
    if not len(hit):
        return 0, lo, False
    k = by[np.arange(len(hit)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[hit]]
    step = max(2, n // 8)
    s = (near_pos[hit] - k) // step
    votes = np.bincount(np.concatenate([s, s + 1]) - s.min(), np.tile(weight[near[hit]] + 1e-3, 2))
    place = int(np.argmax(votes) + s.min()) * step
    c, e = np.searchsorted(near_pos, [place - n // 4 - step, place + n + n // 4 + step])
    window = near[c:e].tolist()
    common = subsequence(masks, n, window)
    if n < 8:
        return common, place, common == n
    return common, place, 10 * common >= 8 * n or (10 * common >= 6 * n and 2 * subsequence(answer, n_answer, window) >= n_answer)


def _search(items: list[np.ndarray], ids: list[int], weight: np.ndarray, item_rows: np.ndarray, space: np.ndarray, cosine: float):
    # of a verbatim item of n words and its window of 64 the cosine is about sqrt(n / 64), or sqrt(64 / n) of a long one
    n = np.array([len(x) for x in items])
    least = (cosine * np.minimum(1.0, np.sqrt(np.minimum(n / BLOCK, 4 * BLOCK / n)))).astype(np.float32)
    by_term, by_item = np.nonzero(item_rows.T)
    postings = (np.searchsorted(by_term, np.arange(len(weight) + 1)), by_item, item_rows[by_item, by_term])
    latent_items = item_rows @ space
    latent_items /= np.maximum(np.linalg.norm(latent_items, axis=1, keepdims=True), 1e-30)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.array([np.bincount(x, minlength=len(weight)) for x in items], np.int32)
        masks = [_masks(x) for x in items]
        tails = [x[-max(3, len(x) // 5) :] for x in items]
        answers = [_masks(x) for x in tails]
        for batch in _slices(batches, 64):
            row, pos, term = _flat(batch)
            docs, blocks, start, terms, value = _rows(row, pos, term, weight)
            width = int(pos.max(initial=0)) + 2
            place = row * width + pos
            found: dict[tuple[int, int], tuple[int, int]] = {}
            for lo in range(0, len(start), 2048):
                part = start[lo : lo + 2048]
                end = start[lo + 2048] if lo + 2048 < len(start) else len(terms)
                own = (part - part[0], terms[part[0] : end], value[part[0] : end])
                product = _products(*own, postings, len(items))
                near = np.flatnonzero((product >= least / 2).any(axis=1))
                latent = _times(*_of(*own, near), space)
                latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-30)
                some = product[near]
                at, which = np.nonzero((some >= least) | (some >= least / 2) & (latent @ latent_items.T >= cosine))
                for each in range(0, len(at), 4096):
                    p, k = lo + near[at[each : each + 4096]], which[each : each + 4096]
                    doc, block = docs[p], blocks[p]
                    ends = [np.searchsorted(place, doc * width + np.clip(x, 0, width - 1)) for x in (block * BLOCK - n[k], (block + 2) * BLOCK + n[k])]
                    for x in np.flatnonzero(in_reach(counts, k, term, *ends)).tolist():
                        i, own_block, item = int(doc[x]), int(block[x]), int(k[x])
                        a, b = np.searchsorted(row, [i, i + 1])
                        common, first, leak = confirm(items[item], masks[item], answers[item], len(tails[item]), pos[a:b], term[a:b], weight, own_block * BLOCK, (own_block + 2) * BLOCK)
                        if leak and common > found.get((i, item), (0, 0))[0]:
                            found[i, item] = (common, first)
            keys = sorted(found)
            rows = [x for x, _ in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([ids[k] for _, k in keys], pa.int64()), pa.array([max(0, found[x][1]) for x in keys], pa.int64()),
                 pa.array([found[x][0] for x in keys], pa.int64()), pa.array([len(items[k]) for _, k in keys], pa.int64())],
                ["doc_id", "item_id", "first_word", "common_words", "item_words"],
            )

    return run


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, *, rank: int = 256, cosine: float = 0.25, block_items: int = 1000, max_share: float = 0.05, directions: int = 32
) -> DataFrame:
    """doc_id, item_id, first_word, common_words, item_words: the items found in each document.

    Frequencies, the space of ``directions`` dimensions and the search cover every passage.  Terms in more than ``max_share`` of the passages have no weight,
    unless they are needed to leave an item five weighted words.  Words are runs of
    letters and digits, lower-cased.  Null or empty texts hold nothing, items without words
    are never found, repeated rows give repeated results, other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    # blocks hold about the rank at most; where hashing deals out more, the rank follows
    blocks = max(1, math.ceil(benchmark.count() / max(1, min(block_items, rank))))
    out = None
    for b in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        rows = [(r["item_id"], x) for r, x in zip(own, item_words([r["text"] for r in own]), strict=True) if len(x)]
        if not rows:
            continue
        vocabulary = np.unique(np.concatenate([x for _, x in rows]))
        items = [np.searchsorted(vocabulary, x).astype(np.int32) for _, x in rows]
        d = len(vocabulary)
        hits = scratch.save(docs.mapInArrow(_hits(vocabulary.tobytes()), "doc_id long, n_words long, pos array<int>, term array<int>"), "hits")
        counts = hits.mapInArrow(_frequencies(d), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        n = {r["term"]: r["n"] for r in counts}
        total = max(1, n.get(-1, 0))
        frequency = np.array([n.get(t, 0) for t in range(d)])
        used = frequency <= max_share * total
        for x in items:
            spare = np.unique(x)
            short = 5 - int(used[spare].sum())
            if short > 0:
                used[spare[~used[spare]][np.argsort(frequency[spare[~used[spare]]], kind="stable")[:short]]] = True
        weight = np.where(used, np.log1p(total / (1.0 + frequency)), 0.0)
        item_rows = _item_rows(items, weight)
        space = corpus_space(hits, weight, directions)
        found = hits.mapInArrow(_search(items, [i for i, _ in rows], weight, item_rows, space, cosine), "doc_id long, item_id long, first_word long, common_words long, item_words long")
        found = scratch.save(found, "leaks")
        scratch.drop(hits)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, first_word long, common_words long, item_words long")
    return out
