"""Exact removal of long byte strings that occur more than once in a collection.

A byte goes if it lies in any string of ``length`` bytes that also starts somewhere else, in
the same text or another.  Whether a string recurs is read off the common prefixes of a
multi-document Burrows-Wheeler transform, which is built column by column: each round
inserts one symbol of every piece, from its last to its first, and passes over the transform
and its common prefixes once, in order (``column_wise``).

What is sorted are pieces, so that rounds are few however long a text is, and so that Spark
can deal the work out.  All strings of ``length`` bytes have an anchor, their least 64-byte
substring by hash; a piece is a run of strings with one anchor, and equal strings have equal
anchors, so a piece is only ever compared with the pieces of its anchor:

* equal texts are one text, and equal pieces one piece, with the number of copies as weight;
* anchors that occur once have nothing that recurs, and an anchor whose pieces are all equal
  needs no order: these weights alone decide;
* the other pieces go, by anchor, into collections of a bounded size, one transform each;
* an anchor of different pieces is split by a longer anchor, twice for all and, where it has very many,
  again and again, until its parts are small or the anchor is the whole string.

No group is collected whole: copies are counted before a shuffle, and the largest thing a
task holds is a collection or one text.  Anchors and pieces are known by 64-bit hashes (a piece by
its own and its anchor's), strings are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.kernel import BASE, BASE_INVERSE, BYTE_VALUE, U, lean, mix, powers, string_views
from papyra.llm.scratch import Scratch

ANCHOR = 64
#: Different pieces of one anchor that one transform takes; beyond it the anchor is made longer.
BUCKET = 2048
#: Times that the anchors of several pieces are made longer, however few those are.
LENGTHEN = 2
#: Bytes of a collection, unless one anchor's pieces are more.
COLLECTION = 1 << 20
#: Bytes of text that are looked at together.
SPAN = 1 << 19
#: Rows of the transform that one entry of the rank table stands for.
BLOCK = 512
#: Rows in which the nearest equal symbol is looked for first; as many that hold nothing lie on either side of a transform.
NEAR = 12

KEY = ["k1", "k2"]


# -- the transform ---------------------------------------------------------------------------


def _least_between(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least value of each non-empty range begin..end-1; prefix has a value more than the ranges reach."""
    order = np.argsort(begin, kind="stable")
    out = np.empty(len(begin), np.int64)
    out[order] = np.minimum.reduceat(prefix, np.stack([begin[order], end[order]], axis=1).ravel())[::2]
    return out


def _nearest(symbols: np.ndarray, prefix: np.ndarray, blocks: tuple[np.ndarray, int], pos: np.ndarray, symbol: np.ndarray, number: np.ndarray, step: int) -> np.ndarray:
    """The least common prefix on the way from each pos to the nearest row before (step -1) or after it (1) that holds symbol.

    There is one, the number-th that holds it.  Row 0 is at index NEAR of symbols and prefix.  Equal symbols
    stand close together: a few rows are looked at first, the others are found by their block.
    """
    first = pos + (NEAR + 1 if step > 0 else 0)
    held, passed = sliding_window_view(symbols, NEAR)[first], sliding_window_view(prefix, NEAR)[first + (step < 0)]
    if step < 0:  # prefixes of pos and the rows passed; after it, of those and the row found
        held, passed = held[:, ::-1], passed[:, ::-1]
    hit = held == symbol[:, None]
    at = hit.argmax(axis=1)
    found = hit[np.arange(len(pos)), at]
    out = np.where(np.arange(NEAR) <= at[:, None], passed, np.iinfo(prefix.dtype).max).min(axis=1).astype(np.int64)
    far = np.flatnonzero(~found)
    if len(far):
        starts, n = blocks
        place, c = pos[far], symbol[far].astype(np.int64)
        block = np.searchsorted(starts, (c << 40) + number[far], side="right") - 1 - c * n
        rows = symbols[NEAR : NEAR + n * BLOCK].reshape(n, BLOCK)[block] == symbol[far, None]
        within = (place - block * BLOCK)[:, None]
        if step > 0:
            rows &= np.arange(BLOCK) > within
            begin, end = place + 1, block * BLOCK + rows.argmax(axis=1) + 1
        else:
            rows &= np.arange(BLOCK) < within
            begin, end = block * BLOCK + BLOCK - rows[:, ::-1].argmax(axis=1), place + 1
        out[far] = _least_between(prefix, begin + NEAR, end + NEAR)
    return out


def column_wise(data: np.ndarray, start: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transform of texts ``data[start:start + size]``, none empty: symbols, common prefixes up to depth, and each row's next row.

    Row i stands for the i-th of all suffixes in order, the first len(start) being the ends of the texts.
    ``symbols`` holds what precedes the suffix, as codes, with the highest code where nothing does;
    ``next`` the row of the suffix that is longer by that symbol.
    """
    m, every = len(start), np.unique(data)
    code = np.zeros(256, np.uint8)
    code[every] = np.arange(len(every))
    data, stop = code[data], len(every)
    shift = 8 if depth < 256 else 16
    kind = np.uint16 if shift == 8 else np.uint32
    mask = (1 << shift) - 1
    total = int(size.sum()) + m
    block_of = (np.arange(total) // BLOCK) * (stop + 1)
    cell = np.empty(total, np.int64)
    below = np.packbits(np.tri(BLOCK, k=-1, dtype=bool), axis=1, bitorder="little").view("<u8")  # the bits before each place of a block

    symbol = data[start + size - 1].astype(np.int64)
    packed = (symbol << shift).astype(kind)
    seen = np.zeros(stop + 1, np.int64)  # rows that hold each symbol
    np.add.at(seen, symbol, 1)
    text, pos, column = np.arange(m), np.arange(m), 0
    while len(text):
        column += 1
        n = len(packed)
        blocks = -(-n // BLOCK)
        symbols = np.full(NEAR + blocks * BLOCK + NEAR, 255, np.uint8)
        symbols[NEAR : NEAR + n] = packed >> shift
        prefix = np.zeros(NEAR + n + NEAR + 1, np.uint8 if shift == 8 else np.uint16)
        prefix[NEAR : NEAR + n] = packed & mask
        np.add(block_of[:n], symbols[NEAR : NEAR + n], out=cell[:n])
        counts = np.bincount(cell[:n], minlength=blocks * (stop + 1)).reshape(blocks, stop + 1)
        before = np.cumsum(counts, axis=0) - counts
        table = (before.T + (np.arange(stop + 1) << 40)[:, None]).ravel(), blocks
        block, within, held = pos // BLOCK, pos % BLOCK, symbol.astype(np.uint8)
        bits = np.packbits(symbols[NEAR:-NEAR].reshape(blocks, BLOCK)[block] == held[:, None], axis=1, bitorder="little").view("<u8")
        rank = before[block, symbol] + np.bitwise_count(bits & below[within]).sum(axis=1, dtype=np.int64)
        first = m + np.concatenate([[0], np.cumsum(seen[:stop])])[:stop]
        row = first[symbol] + rank  # among the rows after this round
        left, right = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        has_left, has_right = rank > 0, rank < seen[symbol] - 1
        left[has_left] = np.minimum(_nearest(symbols, prefix, table, pos[has_left], held[has_left], rank[has_left] - 1, -1) + 1, depth)
        right[has_right] = np.minimum(_nearest(symbols, prefix, table, pos[has_right], held[has_right], rank[has_right] + 1, 1) + 1, depth)

        own = start[text] + size[text] - column - 1  # what precedes the new suffixes
        more = column < size[text]
        symbol = np.where(more, data[np.maximum(own, 0)], stop).astype(np.int64)
        old = np.ones(n + len(text), bool)
        old[row] = False
        grown = np.empty(n + len(text), kind)
        grown[old] = packed
        after = row[has_right] + 1
        grown[after] = (grown[after] & kind(mask << shift)) | right[has_right].astype(kind)
        grown[row] = (symbol << shift).astype(kind) | left.astype(kind)
        # a new row right after another new one keeps the prefix that it found on its own left
        packed = grown
        np.add.at(seen, symbol, 1)
        text, pos, symbol = text[more], row[more], symbol[more]
    symbols = (packed >> shift).astype(np.uint8)
    order = np.argsort(symbols, kind="stable")
    follow = np.empty(len(packed), np.int64)
    follow[order] = m + np.arange(len(packed))
    return symbols, (packed & mask).astype(np.int64), follow


def recurring(data: np.ndarray, start: np.ndarray, size: np.ndarray, weight: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, whether the string of length bytes at each of its first size - length + 1 places occurs twice, texts counting by weight."""
    _, prefix, follow = column_wise(data, start, size, length)
    group = np.cumsum(prefix < length)
    places = np.maximum(size - length + 1, 0)
    at = np.concatenate([[0], np.cumsum(places)])
    own = np.zeros(at[-1], np.int64)
    text, pos = np.arange(len(start)), np.arange(len(start))
    for column in range(1, int(size.max()) + 1):
        pos = follow[pos]
        if column >= length:
            own[at[text] + size[text] - column] = group[pos]
        more = size[text] > column
        text, pos = text[more], pos[more]
    total = np.bincount(own, np.repeat(weight, places))
    return np.split(total[own] >= 2, at[1:-1])


# -- pieces ----------------------------------------------------------------------------------


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, offset in the row, strings, offset of the anchor in the piece, anchor's hash, piece's hash) of all pieces of a column, some bytes at a time."""
    k = min(ANCHOR, length)
    window = length - k + 1
    data, offsets = string_views(column)
    for lo in range(0, max(0, len(data) - length + 1), SPAN):
        raw = data[lo : lo + SPAN + length - 1]
        n = len(raw) - length + 1
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[raw] * powers(BASE, len(raw)), out=sums[1:])
        back = powers(BASE_INVERSE, len(raw) + 1)
        grams = mix((sums[k:] - sums[:-k]) * back[: len(raw) - k + 1])
        # least hash of each string: high bits of the hash, then the place, so that the leftmost wins
        key = (grams & U(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        padded = np.concatenate([key, np.full(-len(key) % window, ~U(0))]).reshape(-1, window)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()[window - 1 : window - 1 + n]
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
        anchor = (np.minimum(ahead, behind) & U(0xFFFFFF)).astype(np.int64)

        first, last = (int(np.searchsorted(offsets, x, side="right")) - 1 for x in (lo, lo + n - 1))
        held = np.diff(np.clip(offsets[first : last + 2], lo, lo + n))
        place = np.arange(lo, lo + n)
        row = np.repeat(np.arange(first, last + 1), held)
        valid = np.repeat(offsets[first + 1 : last + 2], held) - place >= length
        turns = np.ones(n, bool)
        turns[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        begins, ends = valid & turns, valid.copy()
        begins[1:] |= valid[1:] & ~valid[:-1]
        ends[:-1] &= turns[1:] | ~valid[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends)
        yield row[s], place[s] - offsets[row[s]], e - s + 1, anchor[s] - s, grams[anchor[s]], mix((sums[e + length] - sums[s]) * back[s])


def _anchors(length: int):
    """Anchors of a batch's texts with their number, texts that have copies counted twice."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            twice = batch.column("copies").to_numpy() > 1
            for row, _, _, _, anchor, _ in _pieces(batch.column("text"), length):
                one, at = np.unique(anchor, return_inverse=True)
                n = np.bincount(at, 1 + twice[row], minlength=len(one)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return run


def _places(length: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in KEY]
            copies = np.minimum(batch.column("copies").to_numpy(), 2)
            for row, offset, strings, at, anchor, piece in _pieces(batch.column("text"), length):
                columns = [k[row] for k in keys] + [copies[row], offset, strings.astype(np.int32), at.astype(np.int32), anchor.view(np.int64), piece.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*KEY, "copies", "start", "strings", "at", "anchor", "piece"])

    return run


def _sorted_runs(length: int):
    """Runs of recurring strings of each piece; rows come in order of anchor, and an anchor's rows go into one transform."""

    def collection(rows: list[tuple]) -> pa.RecordBatch:
        size = np.array([len(r[3]) for r in rows])
        marks = recurring(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), np.cumsum(size) - size, size, np.array([r[2] for r in rows]), length)
        spans = []
        for own in marks:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
            spans.append([{"lo": int(a), "hi": int(b)} for a, b in edge.reshape(-1, 2)])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], ["anchor", "piece", "runs"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "n", "bytes")), strict=True):
                if held >= COLLECTION and row[0] != rows[-1][0]:
                    yield collection(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        if rows:
            yield collection(rows)

    return run


_RUNS = "array<struct<lo:int,hi:int>>"


def _piece_runs(pieces: DataFrame, length: int, scratch: Scratch, depth: int = 0) -> DataFrame:
    """(anchor, piece, runs): the places lo..hi-1 of each piece whose strings recur; pieces without any may be missing.

    ``pieces`` is a saved table (anchor, piece, n, strings, at, wide, bytes), one row for each different piece:
    n of its copies, whose strings all hold the anchor, ``wide`` bytes at ``at``.
    """
    size = pieces.groupBy("anchor").agg(F.count("*").alias("different"), F.sum("n").alias("all"))
    counted = pieces.join(size.where("all >= 2"), "anchor")
    runs = counted.where("different = 1").select("anchor", "piece", F.array(F.struct(F.lit(0).alias("lo"), F.col("strings").alias("hi"))).cast(_RUNS).alias("runs"))
    if depth < LENGTHEN:  # most pieces that share 64 bytes share little more
        runs = scratch.save(runs, "alone")
        many = counted.where("different > 1").select(pieces.columns)
    else:
        few = counted.where(f"different BETWEEN 2 AND {BUCKET}").select("anchor", "piece", "n", "bytes")
        ordered = few.repartition("anchor").sortWithinPartitions("anchor", "piece").mapInArrow(_sorted_runs(length), f"anchor long, piece long, runs {_RUNS}")
        runs = runs.unionByName(ordered.where("size(runs) > 0"))
        many = scratch.save(counted.where(f"different > {BUCKET}").select(pieces.columns), "many")
        if not many.take(1):
            return runs
    # strings that reach `half` bytes to the left of the anchor share that much more with it, the others as much on the right
    half = F.expr(f"CAST(({length} - wide + 1) DIV 2 AS INT)")
    left_strings = F.greatest(F.lit(0), F.least(F.col("strings"), F.col("at") - half + 1))
    sides = F.array(
        F.struct(F.lit(0).alias("shift"), left_strings.alias("strings"), (F.col("at") - half).alias("at"), (F.col("wide") + half).alias("wide")),
        F.struct(left_strings.alias("shift"), (F.col("strings") - left_strings).alias("strings"), (F.col("at") - left_strings).alias("at"), (F.lit(length) - half + 1).alias("wide")),
    )
    parts = many.select(F.col("anchor").alias("from_anchor"), F.col("piece").alias("from_piece"), "n", F.col("bytes").alias("whole"), F.posexplode(sides).alias("side", "part")).select("from_anchor", "from_piece", "n", "whole", "side", "part.*").where("strings > 0")
    parts = parts.withColumn("bytes", F.expr(f"substring(whole, shift + 1, strings + {length - 1})"))
    parts = parts.withColumn("anchor", F.xxhash64(F.lit(depth), "side", F.expr("substring(bytes, at + 1, wide)"))).withColumn("piece", F.xxhash64("bytes")).drop("whole", "side")
    links = scratch.save(parts.select("from_anchor", "from_piece", "shift", "anchor", "piece"), "links")
    finer = scratch.save(parts.groupBy("anchor", "piece", "strings", "at", "wide").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes")).select(pieces.columns), "finer")
    if depth < LENGTHEN:  # nothing reads these bytes any more
        scratch.drop(pieces)
    below = _piece_runs(finer, length, scratch, depth + 1)
    back = links.join(below, ["anchor", "piece"]).select("from_anchor", "from_piece", F.expr("transform(runs, r -> named_struct('lo', r.lo + shift, 'hi', r.hi + shift))").cast(_RUNS).alias("runs"))
    whole = back.groupBy("from_anchor", "from_piece").agg(F.flatten(F.collect_list("runs")).cast(_RUNS).alias("runs"))  # two parts at most
    return runs.unionByName(whole.select(F.col("from_anchor").alias("anchor"), F.col("from_piece").alias("piece"), "runs"))


# -- texts -----------------------------------------------------------------------------------


def _cut():
    """Each text's maximal removed spans and what is left of it."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for text, found in zip(batch.column("text"), batch.column("found").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.as_buffer() is not None else b""
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in found or []):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                edges = [0, *(x for pair in merged for x in pair), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(spans, span), pa.array(kept, pa.binary())], [*KEY, "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, digest: dict[str, Column] | None = None) -> DataFrame:
    """Each row's doc_id, n_bytes, and what is left of its text without the strings of ``length`` bytes that recur in docs.

    ``digest`` maps names to columns of spans (array of start, end: the maximal removed runs, in
    bytes from 0, end excluded) and kept (binary: the bytes left); by default both are
    returned.  Digests are taken once for each different text.  Texts are UTF-8 bytes, of any
    length; a null text is empty.  A text shorter than length keeps all of its bytes, and so does one whose
    strings occur nowhere else; repeated rows lose all bytes that such a string covers,
    ids may be null or repeat, and other columns of docs are ignored.  An empty table gives an empty one.
    """
    digest = digest or {"spans": F.col("spans"), "kept": F.col("kept")}
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", F.xxhash64(F.lit(11), "text").alias("k1"), F.xxhash64(F.lit(13), "text").alias("k2"), "text")

    # different texts, in buckets by their key: joins by key then move no text
    different = rows.groupBy(*KEY).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    texts = scratch.bucketed(different.where(F.octet_length("text") >= length), KEY, "texts")

    shared = texts.select("copies", "text").mapInArrow(_anchors(length), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n >= 2").select("anchor")
    places = texts.mapInArrow(_places(length), "k1 long, k2 long, copies long, start long, strings int, at int, anchor long, piece long")
    places = scratch.save(places.join(scratch.save(shared, "shared"), "anchor", "left_semi"), "places")

    # one place of each different piece lends its bytes, where several pieces share an anchor
    one = places.groupBy("anchor", "piece", "strings", "at").agg(F.sum("copies").alias("n"), F.min(F.struct(*KEY, "start")).alias("place")).select("anchor", "piece", "strings", "at", "n", "place.*")
    one = scratch.save(one, "pieces")
    mixed = one.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1").select("anchor")
    bytes_ = texts.join(one.join(mixed, "anchor", "left_semi"), KEY).select("anchor", "piece", "n", "strings", "at", F.lit(min(ANCHOR, length)).alias("wide"), F.expr(f"substring(CAST(text AS BINARY), CAST(start + 1 AS INT), strings + {length - 1})").alias("bytes"))
    alone = one.join(mixed, "anchor", "left_anti").where("n >= 2").select("anchor", "piece", F.array(F.struct(F.lit(0).alias("lo"), F.col("strings").alias("hi"))).cast(_RUNS).alias("runs"))
    runs = scratch.save(alone.unionByName(_piece_runs(scratch.save(bytes_, "bytes"), length, scratch)), "runs")

    found = places.join(runs, ["anchor", "piece"]).select(*KEY, F.explode(F.expr(f"transform(runs, r -> named_struct('start', start + r.lo, 'end', start + r.hi + {length - 1}))")).alias("span"))
    found = found.groupBy(*KEY).agg(F.collect_list("span").alias("found"))  # at most one for each place of a text
    cut = texts.join(found, KEY).select(*KEY, "text", "found").mapInArrow(_cut(), "k1 long, k2 long, spans array<struct<start:long,end:long>>, kept binary")
    cut = scratch.save(cut.select(*KEY, *[c.alias(n) for n, c in digest.items()]), "cut")

    # texts that lose nothing are digested where they are read
    whole = rows.select("doc_id", *KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.col("text").cast("binary").alias("kept"))
    whole = whole.select("doc_id", *KEY, "n_bytes", *[c.alias(f"whole_{n}") for n, c in digest.items()])
    joined = whole.join(cut.withColumn("is_cut", F.lit(True)), KEY, "left")
    return joined.select("doc_id", "n_bytes", *[F.when(F.col("is_cut"), F.col(n)).otherwise(F.col(f"whole_{n}")).alias(n) for n in digest])
