"""Near-duplicate documents by min-max hashing, confirmed on whole shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so half the hash evaluations give a signature of the same length.  Bands of four
values are bucket keys.  The number of bands follows from the threshold, so that a pair at
the threshold shares no bucket with a chance of at most one in a million.

Documents with equal sets form one class from the start; only one of each class is
banded, so a group of copies costs one row in the buckets however large it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.components import connected_components
from papyra.llm.kernel import U, lean, mix, shingle_sets, words
from papyra.llm.scratch import Scratch

ROWS = 4
MISS = 1e-6
#: Documents on each side of a tile that is compared in full.
TILE = 256
#: Ids up to which they may be broadcast: about 30 MB as a hash table.
BROADCAST_IDS = 250_000


def band_count(threshold: float) -> int:
    """Bands of ROWS values that a pair at the threshold shares none of with a chance of MISS; even."""
    n = math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))
    return n + n % 2


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation, next to each other."""
    out = np.zeros((len(a), 2), np.uint64)
    for k in range(0, len(shingles), 1 << 14):
        h = shingles[None, k : k + (1 << 14)] * a[:, None] + b[:, None]
        low, high = h.min(axis=1), h.max(axis=1)
        out[:, 0] = np.minimum(out[:, 0], low) if k else low
        out[:, 1] = np.maximum(out[:, 1], high) if k else high
    return out.ravel()


def _sign(bands: int, size: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(bands * ROWS // 2)
        number = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            k1, k2 = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            sign, band, count = [], [], np.zeros(batch.num_rows, np.int32)
            for found in words(batch.column("text")):
                for row, own in shingle_sets(found, size):
                    n[row] = len(own)
                    if not len(own):
                        continue
                    k1[row], k2[row] = np.sum(mix(own), dtype=np.uint64), np.bitwise_xor.reduce(mix(own * U(0xD6E8FEB86659FD93)))
                    values = signature(own, a, b).reshape(bands, ROWS)
                    key = number
                    for c in range(ROWS):
                        key = mix(key * U(0x9E3779B97F4A7C15) + values[:, c])
                    sign.append((mix(values) & U(0x7FFFFFFF)).astype(np.int32).ravel())
                    band.append(key.view(np.int64))
                    count[row] = 1
            at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(at * np.int32(bands)), flat(band, np.int64)),
                 pa.ListArray.from_arrays(pa.array(at * np.int32(bands * ROWS)), flat(sign, np.int32))],
                ["doc_id", "n", "k1", "k2", "bands", "sign"],
            )

    return run


def _confirm(size: int, percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                left, right = batch.column("u").to_numpy(), batch.column("v").to_numpy()
                own: list[np.ndarray] = [None] * batch.num_rows
                for found in words(batch.column("text_u")):
                    for row, shingles in shingle_sets(found, size):
                        own[row] = shingles
                # rows come sorted by v: its set is made once for a run of rows
                first = [k for k in range(batch.num_rows) if k == 0 or right[k] != right[k - 1]]
                if last is not None and first and right[0] == last:
                    first = first[1:]
                sets = {}
                for found in words(batch.column("text_v").take(pa.array(first, pa.int64()))):
                    for row, shingles in shingle_sets(found, size):
                        sets[first[row]] = shingles
                ok = np.zeros(batch.num_rows, bool)
                for k in range(batch.num_rows):
                    if k in sets:
                        last, last_set = right[k], sets[k]
                    a, b = (own[k], last_set) if len(own[k]) <= len(last_set) else (last_set, own[k])
                    if len(a):
                        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                        both = int(np.count_nonzero(b[at] == a))
                        ok[k] = 100 * both >= percent * (len(a) + len(b) - both)
                yield pa.RecordBatch.from_arrays([pa.array(left[ok]), pa.array(right[ok])], ["u", "v"])

    return run


def _texts(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs with these ids, written.  Up to BROADCAST_IDS ids go to the texts; beyond, both are shuffled."""
    ids = scratch.save(ids.distinct(), "ids")
    return scratch.save(docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi"), "texts")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough; texts are fetched for these documents only."""
    texts = _texts(docs, pairs.select(F.col("u").alias("doc_id")).unionAll(pairs.select(F.col("v").alias("doc_id"))), scratch)
    left = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    both = left.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    # an id that stands for several texts must not take one text for another
    both = both.select("u", "text_u", "v", "text_v").sortWithinPartitions("v", F.xxhash64("text_v"))
    out = scratch.save(both.mapInArrow(_confirm(size, percent), "u long, v long").distinct(), "links")
    scratch.drop(texts)
    return out


def _tile(size: int, percent: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        rep, component, n = (batch.column(c).to_numpy() for c in ("rep", "component", "n"))
        straggler = batch.column("straggler").to_numpy(zero_copy_only=False).astype(bool)
        sign = batch.column("sign").flatten().to_numpy().reshape(len(rep), -1)
        sets: list[np.ndarray] = [None] * len(rep)
        for found in words(batch.column("text")):
            for row, shingles in shingle_sets(found, size):
                sets[row] = shingles
        members = np.flatnonzero(~straggler)
        out = []
        for x in np.flatnonzero(straggler):
            may = (component[members] != component[x]) & (100 * np.minimum(n[members], n[x]) >= percent * np.maximum(n[members], n[x]))
            at = members[may]
            at = at[np.count_nonzero(sign[at] == sign[x], axis=1) >= least]
            for y in at:
                a, b = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
                both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    out.append((rep[x], rep[y]))
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(np.maximum(u, v).astype(np.int64) if out else [], pa.int64()), pa.array(np.minimum(u, v).astype(np.int64) if out else [], pa.int64())], ["u", "v"])

    return run


def _families_confirmed(apart: DataFrame, named: DataFrame, docs: DataFrame, size: int, percent: int, bands: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) within families: documents connected by the buckets that hold them.

    apart has rep, first (the least document of a bucket) and component.  In each family
    the members outside its largest component (stragglers) are compared with every member
    of another component.  The comparison goes in tiles of TILE by TILE documents, so
    neither a task's size nor the number of rows follows the pairs.
    """
    family = connected_components(apart.select(F.col("rep").alias("u"), F.col("first").alias("v")), scratch)
    own = apart.select("rep", "component").distinct().join(family.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep")
    own = scratch.save(own, "families")
    sizes = own.groupBy("family", "component").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("family").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("members"))
    largest = largest.select("family", F.col("top.component").alias("giant"), "members", (F.col("members") - F.col("top.c")).alias("stragglers")).where("stragglers > 0")
    own = own.join(largest, "family")
    texts = _texts(docs, own.select(F.col("rep").alias("doc_id")), scratch)
    own = own.join(named.select(F.col("doc_id").alias("rep"), "n", "sign"), "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    number = F.xxhash64("rep", F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), tiles(c) - 1))
    columns = ["family", "rep", "component", "n", "sign", "text"]
    rows = own.select(*columns, F.lit(False).alias("straggler"), F.pmod(number, tiles("members")).cast("int").alias("i"), every("stragglers").alias("j"))
    loose = own.where("component <> giant").select(*columns, F.lit(True).alias("straggler"), F.pmod(number, tiles("stragglers")).cast("int").alias("j"), every("members").alias("i"))
    p = percent / 100
    least = math.floor(bands * ROWS * p - 6.5 * math.sqrt(bands * ROWS * p * (1 - p)))
    both = rows.unionByName(loose).groupBy("family", "i", "j")
    out = scratch.save(both.applyInArrow(_tile(size, percent, least), "u long, v long").distinct(), "links")
    scratch.drop(texts)
    return out


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id long, text string).

    Two documents are linked where 100 * intersection >= percent * union of their sets of
    distinct ``shingle``-word shingles; component_id is the smallest doc_id reachable by links,
    kept is doc_id = component_id.  Null and empty texts have no shingles and link with
    nothing; a text with fewer words is one shingle.  Rows with one doc_id are one document.
    Rows with a null doc_id link with nothing, have a null component_id and are kept.
    Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bands = band_count(percent / 100)
    signed = scratch.save(docs.mapInArrow(_sign(bands, shingle), "doc_id long, n long, k1 long, k2 long, bands array<long>, sign array<int>"), "signed")
    named = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(named.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    chosen = named.join(classes.select(F.col("rep").alias("doc_id"), F.col("k1").alias("c1"), F.col("k2").alias("c2")), "doc_id").where("k1 = c1 AND k2 = c2")
    reps = chosen.select("doc_id", "n", F.explode("bands").alias("band")).withColumnRenamed("doc_id", "rep")

    # round one: a star in each bucket, around another document in each band
    order = F.struct(F.xxhash64("rep", "band").alias("h"), F.col("rep").alias("center"), F.col("n").alias("center_n"))
    groups = reps.groupBy("band").agg(F.count("*").alias("members"), F.min(order).alias("c")).where("members > 1").select("band", "c.center", "c.center_n")
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    star = reps.join(groups, "band").where(F.col("rep") != F.col("center")).where(fits(F.col("n"), F.col("center_n")))
    # the centre is v: it is the one that recurs
    tried = scratch.save(star.select(F.col("rep").alias("u"), F.col("center").alias("v")).distinct(), "tried")
    links = _confirmed(tried, docs, shingle, percent, scratch)
    labels = scratch.save(connected_components(links, scratch), "labels")

    # round two: families of documents that share buckets but are not all linked are compared in full
    part = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = part.groupBy("band").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("first"))
    apart = scratch.save(part.join(lowest.where("members > 2 AND lo <> hi").select("band", "first"), "band").select("rep", "first", "component").distinct(), "apart")
    if not apart.isEmpty():
        further = _families_confirmed(apart, named, docs, shingle, percent, bands, scratch)
        if not further.isEmpty():
            labels = scratch.save(connected_components(links.unionAll(further), scratch), "labels")

    found = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n", "k1", "k2").join(found, ["k1", "k2", "n"], "left")
    # rows of one doc_id are one document, whatever their texts
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
