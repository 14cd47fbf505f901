"""Mixing sources to target weights by fixed-length blocks of words.

Each source is one long run of words: its documents in a fixed pseudorandom order, cut
into blocks of ``block_words``.  Output shards draw how many of their slots each source
gets from a multinomial; a source's slots, numbered over all shards, go through a
pseudorandom permutation of its block numbers, a new one for each pass over the source; and
slots meet blocks in a join by block number.  Nothing depends on how Spark deals out rows,
so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.kernel import NOT_SPACE, U, lean, mix, string_views, word_counts
from papyra.llm.scratch import Scratch, bytes_in

#: Bytes up to which the table of sources may be broadcast; a plain join beyond.
BROADCAST_BYTES = 16 << 20
#: Slots of an output shard, and those that one task fills.
SHARD_SLOTS, TASK_SLOTS = 2048, 1 << 15


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, or its inverse: a Feistel network, walked until in range."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (U(1) << half) - U(1)
    x, out = index.astype(np.uint64), np.zeros(len(index), np.int64)
    left = np.arange(len(index))
    while len(left):
        h, m, k = half[left], mask[left], key.astype(np.uint64)[left]
        scramble = lambda v, step: mix(v * U(0x9E3779B97F4A7C15) + k + U(step)) & m  # noqa: B023, E731
        a, b = x[left] >> h, x[left] & m
        for step in range(3, -1, -1) if inverse else range(4):
            a, b = (b ^ scramble(a, step), a) if inverse else (b, a ^ scramble(b, step))
        x[left] = (a << h) | b
        inside = x[left] < size.astype(np.uint64)[left]
        out[left[inside]] = x[left[inside]].astype(np.int64)
        left = left[~inside]
    return out


def running_starts(df: DataFrame, group: str, order: list[str], value: str, out: str, scratch: Scratch) -> DataFrame:
    """df with ``out``: the sum of ``value`` over the rows of its group that come before.

    Rows are range-partitioned, so a group with a third of all rows spreads over many
    tasks; what comes before a task is a sum over tasks, which is one row for each.
    """
    dealt = scratch.save(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), out)
    within = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = dealt.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    rows = dealt.withColumn("_run", F.sum(value).over(within) - F.col(value)).join(parts, ["_part", group])
    return rows.withColumn(out, F.col("_run") + F.col("_before")).drop("_part", "_run", "_before")


def source_targets(sized: DataFrame, weights: tuple[int, ...], total_share: float, most: float) -> DataFrame:
    """source, sid, source_size, target, quota: weights repeat over sources by code point, null last.

    Targets share ``total_share`` of all words by weight; none is above ``most`` times its
    source's words, and what is cut off goes to the others by weight, until none is above.
    In the order of (most * words / weight) the sources cut off come first, so one running
    sum finds the level at which the rest share.  One row for each source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    sources = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = (total_share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    sources = sources.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("level").alias("level")))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), rest * F.col("weight")))
    sources = sources.withColumn("target", target.cast("double"))
    return sources.select("source", "sid", "source_size", "target", F.least(F.round("target"), F.floor("cap")).cast("long").alias("quota"))


@dataclass
class Mix:
    """docs: a row for each document (source, sid, start, size, ...); pieces: what each slot takes of it."""

    docs: DataFrame
    pieces: DataFrame


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, tie; tie tells apart documents that share an id."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.array(word_counts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), size, batch.column("tie")], ["doc_id", "source", "size", "tie"])

    plain = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    return plain.select("*", F.xxhash64("text").alias("tie")).mapInArrow(run, "doc_id long, source string, size long, tie long")


def _quotas(sources: pd.DataFrame, block: int, seed: int) -> pd.DataFrame:
    """Blocks, full passes and slots of each source: its last slot ends where its quota does."""
    s = sources[sources["source_size"] > 0].copy()
    size, quota = s["source_size"].to_numpy(), s["quota"].to_numpy()
    s["blocks"] = -(-size // block)
    s["passes"] = quota // size
    s["rest"] = quota % size
    last = s["blocks"].to_numpy() - 1
    # where, in the pass that is not whole, the source's last and shorter block comes
    where = permute(last, s["blocks"].to_numpy(), _keys(s["sid"].to_numpy(), s["passes"].to_numpy(), seed), inverse=True)
    short = block - (size - last * block)
    slots = -(-s["rest"].to_numpy() // block)
    slots = np.where(where < slots, -(-(s["rest"].to_numpy() + short) // block), slots)
    s["slots"] = s["passes"] * s["blocks"] + slots
    s["where"] = where
    return s


def _keys(sid: np.ndarray, passes: np.ndarray, seed: int) -> np.ndarray:
    return mix(sid.astype(np.uint64) * U(0x9E3779B97F4A7C15) + passes.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F) + U(seed))


def mix_sources(
    docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), total_share: float = 1.5, most: float = 2.0, block_words: int = 512, seed: int = 3
) -> Mix:
    """Mix all documents (doc_id long, text, source) so that each source gives its target in words.

    Words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none and are never taken.
    A null source is a source, the last one.  A source's words taken are its target,
    rounded; no document gives more than ``most`` times its words, up to whole passes.
    Repeated rows are documents of their own.  The table of sources (one row each) is the
    only thing the driver sees.  Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.save(_sized(docs), "sizes")
    sources = scratch.save(source_targets(sized, weights, total_share, most), "sources")
    small = bytes_in(spark, sources.scratch_path) <= BROADCAST_BYTES
    named = sources.withColumnRenamed("source", "_source")
    rows = sized.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    placed = scratch.save(running_starts(rows, "sid", ["h", "doc_id", "tie", "size"], "size", "start", scratch), "placed")

    table = _quotas(sources.select("sid", "source_size", "quota").orderBy("sid").toPandas(), block_words, seed)
    table = table[table["slots"] > 0]
    total = int(table["slots"].sum())
    if not total:
        return Mix(placed, spark.createDataFrame([], "sid long, start long, shard long, slot long, first_word long, n_words long"))
    plan = {c: table[c].to_numpy() for c in ("sid", "source_size", "blocks", "passes", "rest", "slots", "where")}
    shards = -(-total // SHARD_SLOTS)
    share = plan["slots"] / total

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                n = np.random.default_rng([seed, int(shard)]).multinomial(SHARD_SLOTS, share)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"sid": plan["sid"][at], "shard": shard, "n": n[at], "place": np.cumsum(n)[at] - n[at]})

    drawn = spark.range(shards).mapInPandas(draw, "sid long, shard long, n long, place long")
    drawn = scratch.save(running_starts(drawn, "sid", ["shard"], "n", "first", scratch), "drawn")
    # a source drawn too often leaves holes at its end; one drawn too rarely fills holes, dealt out by one more permutation
    have = {r["sid"]: r["n"] for r in drawn.groupBy("sid").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    plan["have"] = np.array([have.get(s, 0) for s in plan["sid"].tolist()], np.int64)

    @lean
    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = {int(s): k for k, s in enumerate(plan["sid"])}
        over, under = np.maximum(plan["have"] - plan["slots"], 0), np.maximum(plan["slots"] - plan["have"], 0)
        first_hole, filled = np.cumsum(over) - over, np.cumsum(under)
        for pdf in batches:
            for sid, shard, n, place, first in pdf[["sid", "shard", "n", "place", "first"]].itertuples(index=False):
                k = where[sid]
                i = np.arange(first, first + n)
                source = np.full(n, k)
                hole = np.flatnonzero(i >= plan["slots"][k])
                if len(hole):
                    at = permute(first_hole[k] + i[hole] - plan["slots"][k], np.full(len(hole), over.sum()), np.full(len(hole), seed, np.uint64))
                    source[hole] = np.searchsorted(filled, at, side="right")
                    left = source[hole] < len(filled)
                    other = source[hole[left]]
                    i[hole[left]] = plan["slots"][other] - (filled[other] - at[left])
                    slot_at = np.delete(np.arange(n), hole[~left])
                    i, source = i[slot_at], source[slot_at]
                else:
                    slot_at = np.arange(n)
                if not len(i):
                    continue
                blocks, size, sids = plan["blocks"][source], plan["source_size"][source], plan["sid"][source]
                turn, index = i // blocks, i % blocks
                block = permute(index, blocks, _keys(sids, turn, seed))
                length = np.minimum(block_words, size - block * block_words)
                before = index * block_words - (plan["where"][source] < index) * (blocks * block_words - size)
                take = np.where(turn < plan["passes"][source], length, np.clip(plan["rest"][source] - before, 0, length))
                slot = permute(place + slot_at, np.full(len(i), SHARD_SLOTS), np.full(len(i), shard + seed, np.uint64))
                yield pd.DataFrame({"sid": sids, "block": block, "shard": shard, "slot": slot, "take": take})[take > 0]

    # one small file holds the draws of all shards: they are dealt out before slots are made of them
    drawn = drawn.select("sid", "shard", "n", "place", "first").repartition(max(1, -(-total // TASK_SLOTS)), "shard")
    slots = drawn.mapInPandas(fill, "sid long, block long, shard long, slot long, take long")
    b = F.lit(block_words)
    spans = placed.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(_div("start", b), _div(F.col("start") + F.col("size") - 1, b))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * b)
    spans = spans.select("sid", "start", "block", (low - F.col("start")).alias("first_word"), (low - F.col("block") * b).alias("o"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - low).alias("len"))
    # Spark takes the slots for as small as the draws they are made of, and would broadcast them
    pieces = slots.hint("merge").join(spans, ["sid", "block"]).withColumn("n_words", F.greatest(F.lit(0), F.least("len", F.col("take") - F.col("o"))))
    return Mix(placed, pieces.where("n_words > 0").select("sid", "start", "shard", "slot", "first_word", "n_words"))


def _div(a: Column | str, b: Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.floor((a - F.pmod(a, b)) / b).cast("long")


def words_taken(mixed: Mix) -> DataFrame:
    """The rows of mixed.docs with ``taken``: the words of the mix that come from each, repeats counted."""
    taken = mixed.pieces.groupBy("sid", "start").agg(F.sum("n_words").alias("taken"))
    filled = mixed.docs.where("size > 0").join(taken, ["sid", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return filled.unionByName(mixed.docs.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def mixed_texts(mixed: Mix, docs: DataFrame) -> DataFrame:
    """shard, slot, source, doc_id, first_word, n_words, text: the mix itself, a row for each piece of a slot."""
    per_doc = mixed.pieces.groupBy("sid", "start").agg(F.collect_list(F.struct("shard", "slot", "first_word", "n_words")).alias("pieces"))
    named = mixed.docs.where("size > 0").select("sid", "start", "doc_id", "source", "tie").join(per_doc, ["sid", "start"])
    # of rows with one doc_id and text any one will do: they are numbered alike on both sides
    number = F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("source"))
    named = named.withColumn("k", number).drop("sid", "start")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("_s")).withColumn("tie", F.xxhash64("text"))
    texts = texts.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("_s"))).drop("_s")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tie") == F.col("b.tie")) & (F.col("a.k") == F.col("b.k"))
    both = named.alias("a").join(texts.alias("b"), same).select("a.doc_id", "a.source", "a.pieces", "b.text")

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                data, offsets = string_views(batch.column("text"))
                rows, out = [], []
                for k, pieces in enumerate(batch.column("pieces").to_pylist()):
                    raw = data[offsets[k] : offsets[k + 1]]
                    inside = NOT_SPACE[raw]
                    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
                    end = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
                    for p in pieces:
                        rows.append(k)
                        text = raw[start[p["first_word"]] : end[p["first_word"] + p["n_words"] - 1]].tobytes().decode()
                        out.append((p["shard"], p["slot"], p["first_word"], p["n_words"], text))
                at = pa.array(rows, pa.int64())
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("source").take(at), *arrays], ["doc_id", "source", "shard", "slot", "first_word", "n_words", "text"])

    return both.mapInArrow(cut, "doc_id long, source string, shard long, slot long, first_word long, n_words long, text string")
