"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Each text is a bag of word unigrams and bigrams hashed into ``buckets``.  Two generative
models give each bucket a probability: one from the target texts, one from all texts.  A
text's weight is the sum of their log ratios over its n-grams; adding Gumbel noise and
taking the k largest is sampling k texts without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.kernel import U, Words, lean, mix, words
from papyra.llm.scratch import Scratch

#: Target ids up to which they may be broadcast: about 30 MB as a hash table.
BROADCAST_IDS = 250_000


def _buckets(found: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of the part, bucket) of every unigram and bigram."""
    own, doc = found.hash, found.doc
    if len(own) < 2:
        return doc, (own % U(buckets)).astype(np.int64)
    pair = mix(own[:-1] * U(0x9E3779B97F4A7C15) + own[1:])
    same = doc[:-1] == doc[1:]
    return np.concatenate([doc, doc[:-1][same]]), (np.concatenate([own, pair[same]]) % U(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """n-grams of each bucket: of the target's texts, and of all; two rows of ``buckets`` numbers.

    docs has text and is_target.  The result's size is the number of buckets, whatever the input.
    """
    piece = 1024

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            target = batch.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
            for found in words(batch.column("text")):
                doc, at = _buckets(found, buckets)
                total[1] += np.bincount(at, minlength=buckets)
                total[0] += np.bincount(at[target[found.lo + doc]], minlength=buckets)
        where = range(0, buckets, piece)
        for k in range(2):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(where), pa.int32()), pa.array(list(where), pa.int32()), pa.array([total[k, w : w + piece].tolist() for w in where], pa.list_(pa.int64()))], ["kind", "start", "n"])

    parts = docs.select("text", "is_target").mapInArrow(run, "kind int, start int, n array<long>")
    summed = _sum_arrays(parts)
    out = np.zeros((2, buckets))
    for r in summed.collect():
        out[r["kind"], r["start"] : r["start"] + len(r["n"])] = r["n"]
    return out


def _sum_arrays(parts: DataFrame) -> DataFrame:
    def add(batches: pa.Table) -> pa.Table:
        n = np.stack([np.asarray(x, np.int64) for x in batches.column("n").to_pylist()]).sum(axis=0)
        return pa.table({"kind": batches.column("kind")[:1], "start": batches.column("start")[:1], "n": pa.array([n.tolist()], pa.list_(pa.int64()))})

    return parts.groupBy("kind", "start").applyInArrow(add, "kind int, start int, n array<long>")


def log_weights(docs: DataFrame, counts: np.ndarray, smoothing: float) -> DataFrame:
    """doc_id, tie, n_words, log_weight: the text's log ratio of target to raw probability.

    A text is left out of the models that judge it: its own n-grams are taken off the raw
    counts, and off the target's if it is a target text.  Else target texts would gain by
    every rare word that they alone hold.  docs has doc_id, text and is_target.
    """
    raw, buckets, totals = counts.astype(np.int64).tobytes(), counts.shape[1], counts.sum(axis=1)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_target, of_all = np.frombuffer(raw, np.int64).reshape(2, buckets)
        for batch in batches:
            target = batch.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
            weight, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for found in words(batch.column("text")):
                n, (doc, at) = found.hi - found.lo, _buckets(found, buckets)
                pair, own = np.unique(doc * buckets + at, return_counts=True)
                doc, at = pair // buckets, pair % buckets
                mine = target[found.lo : found.hi][doc] * own
                ratio = np.log(np.maximum(of_target[at] - mine, 0) + smoothing) - np.log(np.maximum(of_all[at] - own, 0) + smoothing)
                size = np.bincount(doc, own, n)
                left = [totals[0] - target[found.lo : found.hi] * size + smoothing * buckets, totals[1] - size + smoothing * buckets]
                weight[found.lo : found.hi] = np.bincount(doc, own * ratio, n) - size * (np.log(left[0]) - np.log(left[1]))
                count[found.lo : found.hi] = np.diff(found.bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(count), pa.array(weight)], ["doc_id", "tie", "n_words", "log_weight"])

    return docs.select("doc_id", "text", "is_target", F.xxhash64("text").alias("tie")).mapInArrow(run, "doc_id long, tie long, n_words long, log_weight double")


def take_largest(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows with the largest (key, then smallest doc_id and tie): no sort, no single task.

    The k-th key is found by counting rows in ever finer bins: each pass is one small
    aggregate of at most 2048 rows.  Only rows equal to the k-th key are then ordered.
    """
    total = rows.count()
    if k >= total:
        return rows
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0  # rows beyond the bins
    for _ in range(12):
        if low == high:
            break
        width = (high - low) / 2048
        if width <= 0 or low + width == low:
            break
        bin_ = F.least(F.lit(2047), F.floor((F.col(key) - low) / width)).cast("int")
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        for r in sorted(inside.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    # what is left between low and high is one key, or keys no double tells apart
    sure = rows.where(F.col(key) > high)
    edge = rows.where((F.col(key) >= low) & (F.col(key) <= high)).orderBy(F.col(key).desc(), "doc_id", "tie").limit(k - above)
    return sure.unionAll(edge)


def resample(
    docs: DataFrame, target_ids: DataFrame, *, fraction: float, buckets: int = 1 << 16, smoothing: float = 1.0, seed: int = 17
) -> DataFrame:
    """doc_id, n_words, log_weight, sample_key of the fraction of docs that is drawn.

    docs has doc_id and text; target_ids names the documents whose texts the sample should
    be like.  The log weight is the whole text's log ratio, so a long text is drawn or left
    with more certainty than a short one; the noise is a fixed function of doc_id, text and
    seed, so reruns agree.  Null and empty texts have weight 0 and take
    part; rows with a null doc_id take part, too; repeated rows are drawn on their own but
    have one key.  Without target texts all weights are 0.  Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "resample")
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    target = target_ids.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("is_target", F.lit(True))
    # few enough ids go to the texts; else texts and ids meet in a shuffle
    small = target.count() <= BROADCAST_IDS
    marked = docs.join(F.broadcast(target) if small else target, "doc_id", "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    counts = bucket_counts(marked, buckets)
    if not counts[0].any():
        counts[0] = counts[1]
    weighed = log_weights(marked, counts, smoothing)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "tie"), 11) + 0.5) / F.lit(float(1 << 53))
    keyed = scratch.save(weighed.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform))), "keys")
    k = round(fraction * keyed.count())
    return take_largest(keyed, "sample_key", k).drop("tie") if k else keyed.limit(0).drop("tie")
