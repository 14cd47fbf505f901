"""Language-model scores from a weighted backoff automaton.

The model is an n-gram model with Dirichlet (MacKay-Peto) smoothing:

    p(w)      = (c(w) + 1) / (N + V + 1)
    p(w | h)  = (c(h w) + m p(w | h')) / (c(h) + m),   h' = h without its first word

with a mass m for each order.  As an automaton: each known history is a state; a known
n-gram is an arc that leaves its history's state with weight log10 p(w | h) and leads to the
state of its own last words; every state has a failure arc to h' with weight
log10(m / (c(h) + m)), taken where the state has no arc for the next word.  A text is walked
once from left to right, with its state carried from word to word.

No machine can hold the automaton of a large corpus, so each block of documents gets the
part that its own texts can reach.  A block sends its distinct words and pairs with its
training counts, packed by hash range; a range adds up the counts of all blocks and answers
each block in the order it was asked.  A frequent n-gram is one entry for each block, so no
key is hot.  Longer n-grams follow in a second exchange, but only those all of whose pairs
are in several blocks: where a pair is in one block only, so is every n-gram that holds the
pair, and the block knows their number.  Nothing is pruned.

An exchange has as many pieces as blocks times ranges, so both sizes should grow with the
memory of an executor: ``block_bytes`` and ``range_bytes`` of text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.kernel import U, lean, mix, release, words
from papyra.llm.scratch import Scratch

#: Text bytes of a block of documents, and of the corpus for each range of n-grams.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 6 << 20
#: Positions that one lane of a walk takes; a longer text is walked in several lanes, each from the state of the words before.
LANE = 256
#: Dirichlet masses of orders 2, 3 and 4.
MASSES = (500.0, 50.0, 5.0)
END, BEGIN = U(0x5BD1E995A3F4C2B7), U(0xE6546B64C1B3A54D)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a position of each, and the number of each position's key."""
    by = np.argsort(key).astype(np.int32)
    key = key[by]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    number = np.empty(len(by), np.int32)
    number[by] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], by[new], number


class Grams:
    """The tokens of a block of texts and its distinct n-grams of each order."""

    def __init__(self, texts: pa.Array, order: int, bits: int = 64):
        """``bits`` of the hashes of pairs and longer n-grams are kept; words have all 64."""
        tokens, sizes = [], []
        for found in words(texts, chunk=1 << 18):
            own, n = found.hash, np.diff(found.bounds)
            # one end after the words of each text
            tokens.append(np.insert(own, found.bounds[1:], END))
            sizes.append(n + 1)
        token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.start = np.cumsum(self.size) - self.size
        del tokens
        # positions in a block fit 32 bits, which halves what a task holds
        self.doc = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.order = order
        place = np.arange(len(token), dtype=np.int32) - self.start.astype(np.int32)[self.doc]
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.start] = BEGIN
        #: by order: the distinct keys, each position's index among them (-1: history too short), a position of each
        self.keys: list[np.ndarray] = []
        self.index: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        key = token
        for k in range(1, order + 1):
            has = np.flatnonzero(place >= k - 2).astype(np.int32)
            keys, at, number = _distinct(key[has] if k == 1 else key[has] >> U(64 - bits))
            index = np.full(len(token), -1, np.int32)
            index[has] = number
            self.keys.append(keys)
            self.index.append(index)
            self.at.append(has[at])
            del keys, at, number, index, has
            if k == 1:
                key = mix(before * U(0x9E3779B97F4A7C15) + token)
            elif k < order:
                longer = np.empty_like(key)
                longer[1:] = key[:-1]
                if len(longer):
                    longer[0] = 0
                key = mix(longer * U(0x9E3779B97F4A7C15) + token + U(k))

    def counts(self, k: int, use: np.ndarray) -> np.ndarray:
        """Occurrences of each distinct n-gram of order k in the texts marked by use."""
        index = self.index[k - 1]
        keep = (index >= 0) & use[self.doc]
        return np.bincount(index[keep], minlength=len(self.keys[k - 1]))


class Automaton:
    """States, arcs and failure arcs that a block's texts can reach."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], n_docs: int, n_tokens: int, n_types: int, masses: list[float]):
        """masses[k - 2] is the mass of order k."""
        self.grams = grams
        self.known = [c > 0 for c in counts]
        self.root = np.log10((counts[0] + 1.0) / (n_tokens + n_types + 1.0))
        self.arc, self.fail = [self.root], [np.zeros(0)]
        lower = 10.0**self.root
        for k in range(2, grams.order + 1):
            at, mass = grams.at[k - 1], masses[k - 2]
            first = at == grams.start[grams.doc[at]]
            history = counts[k - 2][grams.index[k - 2][np.maximum(at - 1, 0)]].astype(float)
            history[first] = n_docs if k == 2 else 0
            p = (counts[k - 1] + mass * lower[grams.index[k - 2][at]]) / (history + mass)
            self.arc.append(np.log10(p))
            self.fail.append(np.log10(mass / (history + mass)))
            lower = p

    def state_before(self, at: np.ndarray) -> np.ndarray:
        """The words in the longest known history before each position; at a text's start, its beginning."""
        state = np.zeros(len(at), np.int64)
        start = at == self.grams.start[self.grams.doc[at]]
        state[start] = min(1, self.grams.order - 1)
        for k in range(1, self.grams.order):
            if not len(self.known[k - 1]):
                break
            own = self.grams.index[k - 1][np.maximum(at - 1, 0)]
            state[~start & (own >= 0) & self.known[k - 1][own]] = k
        return state

    def walk(self) -> np.ndarray:
        """The log10 probability of each position.

        Lanes walk side by side, each from left to right with its state: from it, the arc of
        the next word is taken if there is one, and else failure arcs down to the first
        state that has it.
        """
        order, index = self.grams.order, self.grams.index
        out = np.zeros(len(self.grams.doc))
        lanes = -(-self.grams.size // LANE)
        text = np.repeat(np.arange(len(lanes)), lanes)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = self.grams.start[text] + turn * LANE
        length = np.minimum(LANE, self.grams.size[text] - turn * LANE)
        by = np.argsort(-length, kind="stable")
        begin, length = begin[by], length[by]
        carried = self.state_before(begin)
        for step in range(int(length[0]) if len(length) else 0):
            active = np.searchsorted(-length, -step)  # lanes longer than step
            at, state = begin[:active] + step, carried[:active].copy()
            after = carried[:active]
            for k in range(order, 1, -1):
                here = np.flatnonzero(state == k - 1)
                own = index[k - 1][at[here]]
                arc = self.known[k - 1][own]
                out[at[here]] += np.where(arc, self.arc[k - 1][own], self.fail[k - 1][own])
                after[here[arc]] = min(k, order - 1)
                state[here] = np.where(arc, -1, k - 2)
            here = np.flatnonzero(state == 0)
            own = index[0][at[here]]
            out[at[here]] += self.root[own]
            after[here] = self.known[0][own] if order > 1 else 0
        return out


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an array of integers, first bytes first: sorted keys and small counts then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T[::-1]).tobytes()


def _integers(raw: bytes, kind: type) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, len(raw) // np.dtype(kind).itemsize)
    return np.ascontiguousarray(own[::-1].T).view(kind).ravel()


def _blocks(block_bytes: int):
    """One row for each block of a task's documents: an id, and the documents as a compressed Arrow stream."""

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink, options = pa.BufferOutputStream(), pa.ipc.IpcWriteOptions(compression="zstd")
        with pa.ipc.new_stream(sink, held[0].schema, options=options) as writer:
            writer.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                part = whole.slice(lo, 64)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= block_bytes:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    return run


def _documents(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _pieces(grams: Grams, orders: list[int], use: np.ndarray, asked: list[np.ndarray | None], bits: int, ranges: int, block: str) -> pa.RecordBatch:
    """A row for each range: the sorted keys of each order that are asked for, with their counts in the texts marked by use."""
    rows: dict[int, tuple[list[bytes], list[bytes]]] = {}
    for place, (k, ask) in enumerate(zip(orders, asked, strict=True)):
        keys, n = grams.keys[k - 1], grams.counts(k, use).astype(np.int32)
        if ask is not None:
            keys, n = keys[ask], n[ask]
        width = 64 if k == 1 else bits
        cut = np.searchsorted(keys, np.array([(b << width) // ranges for b in range(1, ranges)], np.uint64))
        for b, (lo, hi) in enumerate(zip([0, *cut], [*cut, len(keys)], strict=True)):
            if lo < hi:
                row = rows.setdefault(b, ([b""] * len(orders), [b""] * len(orders)))
                row[0][place], row[1][place] = _planes(keys[lo:hi]), _planes(n[lo:hi])
    kinds = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    columns = [list(rows), [block] * len(rows), [r[0] for r in rows.values()], [r[1] for r in rows.values()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["range", "block", "keys", "n"])


ASKED = "range long, block string, keys array<binary>, n array<binary>"


def _ask_short(bits: int, ranges: int, order: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist(), strict=True):
                docs = _documents(raw)
                orders = [1, 2][:order]
                yield _pieces(Grams(docs.column("text"), len(orders), bits), orders, ~docs.column("held_out").to_numpy(), [None] * len(orders), bits, ranges, block)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each n-gram, in the order it was asked, twice its total, plus one if several blocks have it.

    Block '' has the range's distinct words and their sum.
    """
    out: list[tuple] = []
    own, blocks = table.column("range")[0].as_py(), table.column("block").to_pylist()
    asked, counted = table.column("keys"), table.column("n")
    replies: list[list[bytes]] = [[] for _ in blocks]
    for place in range(len(asked[0])):
        keys = [_integers(asked[r][place].as_py(), np.uint64) for r in range(len(blocks))]
        n = np.concatenate([_integers(counted[r][place].as_py(), np.int32) for r in range(len(blocks))]).astype(np.int64)
        every = np.concatenate(keys)
        by = np.argsort(every, kind="stable")
        new = np.ones(len(by), bool)
        new[1:] = every[by][1:] != every[by][:-1]
        at = np.flatnonzero(new)
        totals = np.add.reduceat(n[by], at) if len(by) else n
        # a block sends a key once, so a key that comes twice is in several blocks
        shared = np.diff(np.append(at, len(by))) > 1
        reply = np.empty(len(every), np.int64)
        reply[by] = (2 * totals + shared)[np.cumsum(new) - 1]
        if place == 0:
            out.append((own, "", [_planes(np.array([np.count_nonzero(totals), totals.sum()], np.int64))]))
        at = 0
        for r, part in enumerate(keys):
            replies[r].append(_planes(reply[at : at + len(part)]))
            at += len(part)
    out += [(own, block, reply) for block, reply in zip(blocks, replies, strict=True)]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.binary())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["range", "block", "totals"])


ANSWERED = "range long, block string, totals array<binary>"


def _totals(replies: pa.Table, orders: int) -> list[np.ndarray]:
    """The replies for each asked order, ranges put together again."""
    by = np.argsort(replies.column("range").to_numpy(), kind="stable")
    column = replies.column("totals")
    return [np.concatenate([np.zeros(0, np.int64), *[_integers(column[int(r)][place].as_py(), np.int64) for r in by]]) for place in range(orders)]


def _unsettled(grams: Grams, pairs: np.ndarray) -> list[np.ndarray]:
    """For each order above 2: which n-grams other blocks may have, because each of their pairs is in several blocks."""
    out: list[np.ndarray] = []
    here = (pairs & 1).astype(bool)[grams.index[1]]  # by position; every position has a pair
    run = here.copy()
    for k in range(3, grams.order + 1):
        run[1:] = run[:-1] & here[1:]
        run[:1] = False
        at = grams.at[k - 1]
        out.append(run[at])
    return out


def _ask_long(order: int, bits: int, ranges: int):
    def run(key: tuple, block: pa.Table, replies: pa.Table) -> pa.Table:
        docs = _documents(block.column("docs")[0].as_py())
        grams, use = Grams(docs.column("text"), order, bits), ~docs.column("held_out").to_numpy()
        asked = _unsettled(grams, _totals(replies, 2)[1])
        out = pa.Table.from_batches([_pieces(grams, list(range(3, order + 1)), use, asked, bits, ranges, key[0].as_py())])
        del grams, asked
        release()
        return out

    return run


def _score(order: int, bits: int, n_docs: int, n_tokens: int, n_types: int, masses: list[float]):
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        docs = _documents(block.column("docs")[0].as_py())
        grams, use = Grams(docs.column("text"), order, bits), ~docs.column("held_out").to_numpy()
        long = replies.column("long").to_numpy(zero_copy_only=False).astype(bool)
        answers = _totals(replies.filter(pa.array(~long)), min(order, 2))
        counts = [x >> 1 for x in answers]
        if order > 2:
            further = _totals(replies.filter(pa.array(long)), order - 2)
            for k, asked, totals in zip(range(3, order + 1), _unsettled(grams, answers[1]), further, strict=True):
                own = grams.counts(k, use)
                own[asked] = totals >> 1
                counts.append(own)
        model = Automaton(grams, counts, n_docs, n_tokens, n_types, masses)
        first = grams.index[0]
        add = lambda x: np.bincount(grams.doc, x, len(grams.size))
        arrays = [docs.column("doc_id"), docs.column("held_out"), pa.array(grams.size), pa.array(add(model.known[0][first]).astype(np.int64)), pa.array(np.full(len(grams.size), n_tokens)), pa.array(add(model.root[first])), pa.array(add(model.walk()))]
        out = pa.table(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        del grams, model, counts
        release()
        return out

    return run


def score_texts(docs: DataFrame, held_out: Column, *, order: int = 4, masses: tuple[float, ...] = MASSES, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    The model learns from rows where the boolean column ``held_out`` is false or null.
    Tokens are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end; null and empty
    texts are an end alone.  base_score has c + 1 over N + V + 1 for each token; score is the
    automaton's log10 probability.  ``masses`` are those of orders 2, 3, ...; the last holds for
    all orders beyond.  Repeated rows count as often as they come, null doc_ids are scored and
    learned from.  Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "lm")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = scratch.save(plain.mapInArrow(_blocks(block_bytes), "block string, docs binary"), "blocks")
    size = plain.agg(F.sum(F.octet_length("text") + 1), F.count_if(~F.col("held_out"))).first()
    total, n_docs = size[0] or 0, size[1]
    ranges = max(1, math.ceil(total / range_bytes))
    # two of the corpus's n-grams share the bits that are kept with a chance below 2**-17
    bits = min(64, max(2, total).bit_length() + 17)
    masses = [masses[min(k - 2, len(masses) - 1)] for k in range(2, order + 1)]
    asked = blocks.mapInArrow(_ask_short(bits, ranges, order), ASKED)
    answers = scratch.save(asked.groupBy("range").applyInArrow(_answer, ANSWERED), "answers")
    n_types = n_tokens = 0
    for r in answers.where("block = ''").select("totals").collect():  # one row a range
        own = _integers(r["totals"][0], np.int64)
        n_types, n_tokens = n_types + int(own[0]), n_tokens + int(own[1])
    short = answers.where("block <> ''")
    replies = short.withColumn("long", F.lit(False))
    if order > 2:
        asked = blocks.groupBy("block").cogroup(short.groupBy("block")).applyInArrow(_ask_long(order, bits, ranges), ASKED)
        further = scratch.save(asked.groupBy("range").applyInArrow(_answer, ANSWERED), "answers")
        replies = replies.unionAll(further.where("block <> ''").withColumn("long", F.lit(True)))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = blocks.groupBy("block").cogroup(replies.groupBy("block"))
    return both.applyInArrow(_score(order, bits, n_docs, n_tokens, n_types, masses), schema)
