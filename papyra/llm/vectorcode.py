"""Codes for vectors: parts are replaced by the nearest entries of codebooks fitted by heap Lloyd rounds.

A Lloyd round would compare every part with every entry.  Here each block of vectors keeps, for
each entry, a heap of the parts assigned to it, keyed by their slack: a lower bound of the
distance to any other entry minus an upper bound of the distance to their own.  When entries move, a
part's slack shrinks by at most the way its own entry went plus the longest way of another one,
so heaps need no update: the key is the slack plus the drift up to the part's last scan, and a
round pops only the parts whose key the drift so far has reached.  Those are compared
with all entries again, exactly, and pushed back; all others keep their entry for sure.

Everything is integers.  Bounds are rounded outwards, so a part that stays would stay under exact
arithmetic, ties included (a tie has no slack).  Each round reads the blocks of the last one and writes
them anew, with the change of each entry's sum and count; Spark adds the changes up, and the
driver sees one row for each component of the codebooks, never of the vectors.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.kernel import lean
from papyra.llm.scratch import Scratch

#: Vectors of one block, the unit that has heaps of its own.
BLOCK = 4096
#: Labels whose sums may be broadcast.
BROADCAST_LABELS = 250_000
#: Widens bounds far beyond the rounding of doubles.
MARGIN = 1e-12


@dataclass
class Codebooks:
    """``entries[part, index]`` are integer vectors, ``scale`` times what they stand for."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _limit(width: int) -> int:
    """Magnitude that integer components are held to, so that squared distances over all parts fit 64 bits."""
    return math.isqrt((2**63 - 1) // (4 * max(1, width)))


def _integers(values: np.ndarray, scale: int, width: int) -> np.ndarray:
    limit = _limit(width)
    return np.clip(np.floor(values.astype(np.float64) * scale), -limit, limit).astype(np.int64)


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, slack) of each row of x: the nearest entry, the lower index on ties, and a lower bound of how much farther any other is."""
    entry, slack = np.empty(len(x), np.int64), np.empty(len(x))
    largest = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    exact_as_double = 4 * max(1, x.shape[1]) * largest**2 < 2**53
    for lo in range(0, len(x), 1024):
        part = x[lo : lo + 1024]
        if exact_as_double:
            a, b = part.astype(np.float64), book.astype(np.float64)
            square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        else:
            square = np.stack([((part - c) ** 2).sum(axis=1) for c in book], axis=1)
        best = square.argmin(axis=1)
        row = np.arange(len(part))
        near = square[row, best].astype(np.float64)
        if len(book) > 1:
            square[row, best] = np.iinfo(np.int64).max if square.dtype == np.int64 else np.inf
            far = square.min(axis=1).astype(np.float64)
        else:
            far = np.full(len(part), np.inf)
        entry[lo : lo + 1024] = best
        slack[lo : lo + 1024] = np.sqrt(far) * (1 - MARGIN) - np.sqrt(near) * (1 + MARGIN)
    return entry, slack


class Heaps:
    """The parts of one position in a block: a heap of (key, row) for each entry."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    @classmethod
    def unpack(cls, sizes: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> Heaps:
        at = np.concatenate([[0], np.cumsum(sizes)])
        pairs = list(zip(keys.tolist(), rows.tolist(), strict=True))
        return cls([pairs[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])

    def pack(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = [pair for heap in self.heaps for pair in heap]
        return np.array([len(h) for h in self.heaps], np.int32), np.array([k for k, _ in flat], np.float64), np.array([r for _, r in flat], np.int32)

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of the parts whose bounds the drift of their entry has reached, taken out."""
        rows, entries = [], []
        for entry, (heap, limit) in enumerate(zip(self.heaps, drift.tolist(), strict=True)):
            while heap and heap[0][0] <= limit:
                rows.append(heapq.heappop(heap)[1])
                entries.append(entry)
        return np.array(rows, np.int64), np.array(entries, np.int64)

    def push(self, rows: np.ndarray, entries: np.ndarray, slack: np.ndarray, drift: np.ndarray) -> None:
        keys = slack + drift[entries] - MARGIN * (np.abs(slack) + drift[entries])
        for row, entry, key in zip(rows.tolist(), entries.tolist(), keys.tolist(), strict=True):
            heapq.heappush(self.heaps[entry], (key, row))

    def entries(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        for entry, heap in enumerate(self.heaps):
            for _, row in heap:
                out[row] = entry
        return out


def _blocks(width: int, scale: int):
    """Vectors as blocks of padded integers, two bytes a component where they suffice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(lo, BLOCK)
                n, vectors = batch.num_rows, batch.column("vector")
                sizes = vectors.value_lengths().to_numpy()
                points = np.zeros((n, width), np.int64)
                points[np.arange(width) < sizes[:, None]] = _integers(vectors.flatten().to_numpy(zero_copy_only=False), scale, width)
                kind = np.int16 if np.abs(points).max(initial=0) < 2**15 else np.int64
                one = pa.array([0, n], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(one, batch.column("vec_id")), pa.ListArray.from_arrays(one, batch.column("label")), pa.array([points.astype(kind).tobytes()], pa.binary()), pa.array([kind == np.int16])],
                    ["ids", "labels", "points", "short"],
                )

    return lean(run)


def _points(row: dict, parts: int, width: int) -> np.ndarray:
    return np.frombuffer(row["points"], np.int16 if row["short"] else np.int64).astype(np.int64).reshape(len(row["ids"]), parts, width // parts)


def _assign(row: dict, points: np.ndarray, books: np.ndarray, drift: np.ndarray) -> tuple[list[Heaps], list[tuple]]:
    """A block's heaps after a round, and for each part position the (rows, old entries or None, new entries) that were scanned."""
    parts, entries, _ = books.shape
    heaps, scanned = [], []
    first = row.get("sizes") is None
    if not first:
        sizes, keys, rows = np.frombuffer(row["sizes"], np.int32).reshape(parts, entries), np.frombuffer(row["keys"]), np.frombuffer(row["rows"], np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
    for p in range(parts):
        if first:
            own, todo, old = Heaps([[] for _ in range(entries)]), np.arange(len(points)), None
        else:
            own = Heaps.unpack(sizes[p], keys[ends[p] : ends[p + 1]], rows[ends[p] : ends[p + 1]])
            todo, old = own.pop(drift[p])
        new, slack = nearest_entries(points[todo, p], books[p])
        own.push(todo, new, slack, drift[p])
        heaps.append(own)
        scanned.append((todo, old, new))
    return heaps, scanned


def _round(books: np.ndarray, drift: np.ndarray, width: int):
    """Blocks with new heaps and the change of sums and counts: ``at`` counts components of all entries, an entry's count after its sum."""
    parts, entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.to_pylist()[0]
                points = _points(row, parts, width)
                heaps, scanned = _assign(row, points, books, drift)
                change = np.zeros((parts, entries, d + 1), np.int64)
                for p, (todo, old, new) in enumerate(scanned):
                    value = np.concatenate([points[todo, p], np.ones((len(todo), 1), np.int64)], axis=1)
                    moved = np.ones(len(todo), bool) if old is None else old != new
                    np.add.at(change[p], new[moved], value[moved])
                    if old is not None:
                        np.subtract.at(change[p], old[moved], value[moved])
                at = np.flatnonzero(change)
                packed = [h.pack() for h in heaps]
                state = [np.concatenate([x[i] for x in packed]).tobytes() for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(c) for c in ("ids", "labels", "points", "short")), *(pa.array([x], pa.binary()) for x in state),
                     pa.array([at], pa.list_(pa.int32())), pa.array([change.ravel()[at]], pa.list_(pa.int64())), pa.array([sum(len(x[0]) for x in scanned)], pa.int64())],
                    ["ids", "labels", "points", "short", "sizes", "keys", "rows", "at", "by", "scanned"],
                )

    return lean(run)


def _codes(books: np.ndarray, drift: np.ndarray, width: int):
    """The last assignment: each vector's entries and squared distance."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.to_pylist()[0]
                points = _points(row, parts, width)
                heaps, _ = _assign(row, points, books, drift)
                entry = np.stack([h.entries(len(points)) for h in heaps], axis=1)
                error = sum(((points[:, p] - books[p][entry[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                codes = pa.FixedSizeListArray.from_arrays(pa.array(entry.ravel().astype(np.int32)), parts).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), codes, pa.array(error)], ["vec_id", "label", "entries", "error"])

    return lean(run)


def _add_up(state: DataFrame, sums: np.ndarray) -> None:
    """Add the blocks' changes to the sums (Python integers, one for each component of the codebooks)."""
    change = state.select(F.inline(F.arrays_zip("at", "by"))).groupBy("at").agg(F.sum(F.col("by").cast("decimal(38,0)")).alias("by"))
    for at, by in change.collect():
        sums[at] += int(by)


def _moved(books: np.ndarray, sums: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of the means, rounded down, and the drift that any part of an entry may have seen so far: its entry's way and the longest way of another one."""
    parts, entries, d = books.shape
    new = books.copy()
    table = sums.reshape(parts, entries, d + 1)
    for p in range(parts):
        for j in range(entries):
            if table[p, j, d]:
                new[p, j] = [int(x) // int(table[p, j, d]) for x in table[p, j, :d]]
    way = np.sqrt(((new - books).astype(np.float64) ** 2).sum(axis=2)) * (1 + MARGIN)
    others = np.zeros_like(way)
    if entries > 1:
        ordered = np.sort(way, axis=1)
        others[:] = ordered[:, -1:]
        others[np.arange(parts), way.argmax(axis=1)] = ordered[:, -2]
    return new, (drift + way + others) * (1 + MARGIN)


def compress_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, entries, error) for each vector kept, and the codebooks.

    ``vectors`` has vec_id, embedding and label.  Rows whose vector is null or holds null or non-finite
    components are dropped.  A component x becomes floor(scale * x); the integers are
    cut into equal consecutive parts, and each position's codebook starts as that part of the vectors with
    the ``entries`` smallest ids (null ids last, equal ids by vector).  A round assigns every part to
    the nearest entry, the lower index on ties, then replaces each entry by the mean of its parts, rounded
    down; entries without parts stay.  Parts are assigned once more at the end.  ``entries`` are the indexes
    in part order, ``error`` the squared distances added up.

    With fewer vectors codebooks have as many entries; without any there are none, and no rows.  Vectors
    may differ in length and need not be divisible by parts: all count as padded with zeros to one length.
    Integers beyond about 2**31 / sqrt(length) in magnitude are held there, so that all errors fit 64 bits.  Ids and
    labels may be null and repeat; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectorcode")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select("vec_id", "label", F.col("embedding").alias("vector")).where(F.col("vector").isNotNull() & finite)
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    kind = dict(kept.dtypes)
    if longest is None:
        empty = kept.select("vec_id", "label", F.array().cast("array<int>").alias("entries"), F.lit(0).cast("long").alias("error")).where("false")
        return empty, Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    width = -(-longest // parts) * parts
    least = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = np.zeros((len(least), width), np.int64)
    for row, (vector,) in zip(start, least, strict=True):
        row[: len(vector)] = _integers(np.array(vector), scale, width)
    books = start.reshape(len(least), parts, width // parts).transpose(1, 0, 2).copy()

    schema = f"ids array<{kind['vec_id']}>, labels array<{kind['label']}>, points binary, short boolean"
    state = scratch.save(kept.mapInArrow(_blocks(width, scale), schema), "blocks")
    drift = np.zeros(books.shape[:2])
    sums = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), object)
    for _ in range(rounds):
        after = scratch.save(state.mapInArrow(_round(books, drift, width), schema + ", sizes binary, keys binary, rows binary, at array<int>, by array<long>, scanned long"), "blocks")
        scratch.drop(state)
        state = after
        _add_up(state, sums)
        books, drift = _moved(books, sums, drift)
    codes = state.mapInArrow(_codes(books, drift, width), f"vec_id {kind['vec_id']}, label {kind['label']}, entries array<int>, error long")
    codes = scratch.save(codes, "codes")
    scratch.drop(state)
    return codes, Codebooks(books, scale)


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error: the error added up over the rows of an equal label, nulls together (null where the sum leaves 64 bits)."""
    sums = codes.groupBy("label").agg(F.expr("try_cast(sum(CAST(error AS DECIMAL(38,0))) AS BIGINT)").alias("label_error"))
    sums = Scratch(codes.sparkSession, "labels").save(sums.select(F.col("label").alias("of"), "label_error"), "labels")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with the vector that each one stands for: the entries of its indexes, in part order, over scale."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / books.scale) for x in entry]) for entry in part]) for part in books.entries])
    return codes.withColumn("decoded", F.flatten(F.transform("entries", lambda index, part: table[part][index])))
