"""A kept positional index: postings in term buckets, changed work by work, searched by its terms only.

Tables under the index's folder, each with a part for every generation, as an update is called:

* ``postings/generation=G/bucket=B``: term, chunk_id, work_id, dl, positions; each file is sorted by term, or holds pieces that are;
* ``chunks/generation=G``: chunk_id, work_id, dl, digest, text;
* ``dead/generation=G``: works of which older generations no longer count;
* ``summary/generation=G``: chunks and tokens that the update added and took away, written last;
* ``compacted/generation=G``: marks a generation that stands for all before it.

An update writes only the changed works' postings, into their terms' buckets, and nothing is
overwritten, so readers always see whole generations: those with a summary.  A generation that
is written again (a micro-batch after a restart) replaces itself.  Deleted works are left out by
a join on a table of works.  compact() folds all generations into one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.text import index_tokens, query_terms
from papyra.operators.fts import B, K1, Match, hits_with_all_terms, match_expression, top_hits
from papyra.sources.kept import hadoop

SUMMARY = "added long, added_tokens long, dead long, dead_tokens long"


def _phrase_frequency(phrase: list[str], column: dict[str, str]) -> Column:
    """Times that a phrase occurs: places of its first word from which each next word is one place on."""
    back = lambda w, k: F.transform(column[w], lambda p: p - k)
    return F.size(reduce(F.array_intersect, [back(w, k) for k, w in enumerate(phrase)]))


#: About as many tokens are grouped at once.
PIECE = 1_000_000


def _grouped(buckets: int):
    """Postings of chunks, sorted by bucket, term and chunk in each piece: terms and chunks get numbers in that order, and one sort by both brings a term's places together."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("dl").to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
                yield batch.slice(lo, hi - lo)
                lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            part = part.take(pc.sort_indices(part, [("chunk_id", "ascending")]))
            size = pc.list_value_length(part.column("own")).to_numpy(zero_copy_only=False)
            coded = part.column("own").flatten().dictionary_encode()
            named = pa.table({"term": coded.dictionary, "bucket": pa.array([zlib.crc32(t.encode()) % buckets for t in coded.dictionary.to_pylist()], pa.int32())})
            by_name = pc.sort_indices(named, [("bucket", "ascending"), ("term", "ascending")])
            number = np.empty(len(by_name), np.int64)
            number[by_name.to_numpy()] = np.arange(len(by_name))
            chunk = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(chunk)) - np.repeat(np.cumsum(size) - size, size)
            key = number[coded.indices.to_numpy()] * len(size) + chunk
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            term, chunk = np.divmod(key[first], len(size))
            of, name = part.select(["chunk_id", "work_id", "dl"]).take(pa.array(chunk)), named.take(by_name.take(pa.array(term))).combine_chunks()
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([*of.columns, *[name.column(c).combine_chunks() for c in ("term", "bucket")], positions], [*of.schema.names, "term", "bucket", "positions"])

    return run


def _postings(chunks: DataFrame, buckets: int = 64) -> DataFrame:
    """chunk_id, work_id, dl, term, bucket, positions: a chunk's tokens (own) are in one row, so they are grouped where they are."""
    kind = dict(chunks.dtypes)
    return chunks.where("dl > 0").select("chunk_id", "work_id", "dl", "own").mapInArrow(_grouped(buckets), f"chunk_id {kind['chunk_id']}, work_id {kind['work_id']}, dl int, term string, bucket int, positions array<int>")


class KeptIndex:
    """An index in the folder ``root``.  buckets is a property of the folder and must not change."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # -- tables

    def _written(self, name: str) -> set[int]:
        fs, at = hadoop(self.spark, f"{self.root}/{name}/generation=*/_SUCCESS")
        return {int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(at) or []}

    def generations(self) -> list[int]:
        """Whole generations, oldest first; the first is the last one that stands for all before it."""
        own = self._written("summary")
        first = max(self._written("compacted") & own, default=0)
        return sorted(g for g in own if g >= first)

    def _read(self, name: str, generations: list[int]) -> DataFrame:
        base = f"{self.root}/{name}"
        reader = self.spark.read.option("basePath", base)
        if name == "postings":  # an update without words leaves no file to take a schema from
            kind = dict(self._read("chunks", generations).dtypes)
            reader = reader.schema(f"term string, chunk_id {kind['chunk_id']}, work_id {kind['work_id']}, dl int, positions array<int>, generation int, bucket int")
        return reader.parquet(*[f"{base}/generation={g}" for g in generations])

    def live(self, name: str, generations: list[int] | None = None) -> DataFrame:
        """Rows of ``postings`` or ``chunks`` whose work no later generation took away."""
        own = self.generations() if generations is None else generations
        rows = self._read(name, own)
        if len(own) == 1:
            return rows
        dead = self._read("dead", own[1:]).groupBy("work_id").agg(F.max("generation").alias("_dead"))
        return rows.join(dead, "work_id", "left").where("_dead IS NULL OR generation >= _dead").drop("_dead")

    def size(self) -> tuple[int, int]:
        """Chunks and tokens of the index: one row of each generation is read."""
        own = self.generations()
        if not own:
            return 0, 0
        n, tokens = self._read("summary", own).agg(F.sum(F.col("added") - F.col("dead")), F.sum(F.col("added_tokens") - F.col("dead_tokens"))).first()
        return n, tokens

    # -- changes

    def update(self, chunks: DataFrame | None, removed: DataFrame | None = None, generation: int | None = None) -> int:
        """Put all chunks (chunk_id, work_id, text) of new and changed works in place of those works' old ones; drop ``removed`` works (work_id).

        Returns the generation written: the next even number, or the one given (even, and above all others but
        itself).  Odd ones are compact()'s.
        """
        before = [g for g in self.generations() if generation is None or g < generation]
        now = generation if generation is not None else (before[-1] // 2 * 2 + 2 if before else 0)
        self._delete("summary", now)
        if chunks is None:
            chunks = self._read("chunks", before).select("chunk_id", "work_id", "text").limit(0)
        own = index_tokens(F.coalesce("text", F.lit("")))
        # dealt out before texts are split, as a table may come in few row groups
        rows = chunks.repartition("chunk_id").select("chunk_id", "work_id", F.size(own).alias("dl"), F.xxhash64("text").alias("digest"), "text")
        self._write(rows, "chunks", now)

        chunks = self._read("chunks", [now])  # written once: what makes the chunks is not run again
        postings = _postings(chunks.select("chunk_id", "work_id", "dl", own.alias("own")), self.buckets)
        # each task writes the postings of its own chunks, as a segment: no token or posting is sent, and pieces that are sorted need no comparing
        self._write(postings.sortWithinPartitions("bucket"), "postings", now, "bucket")

        added = chunks.agg(F.count("*").alias("added"), F.coalesce(F.sum("dl"), F.lit(0)).alias("added_tokens"))
        gone = chunks.select("work_id") if removed is None else chunks.select("work_id").union(removed.select("work_id"))
        if before:
            self._write(gone.distinct(), "dead", now)
            old = self.live("chunks", before).join(self._read("dead", [now]).select("work_id"), "work_id", "left_semi")
            died = old.agg(F.count("*").alias("dead"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dead_tokens"))
        else:
            died = self.spark.range(1).select(F.lit(0).alias("dead"), F.lit(0).alias("dead_tokens"))
        summary = added.crossJoin(died)  # one row each
        self._write(summary.select(*[F.col(c.split()[0]).cast("long") for c in SUMMARY.split(", ")]), "summary", now)
        return now

    def sync(self, chunks: DataFrame) -> int | None:
        """Make the index hold exactly these chunks: only works with a new, changed or vanished chunk are written; None if there are none."""
        if not self.generations():
            return self.update(chunks)
        new = chunks.select("work_id", "chunk_id", F.xxhash64("text").alias("digest"))
        old = self.live("chunks").select("work_id", "chunk_id", F.col("digest").alias("_digest"))
        both = new.withColumn("_new", F.lit(True)).join(old.withColumn("_old", F.lit(True)), ["work_id", "chunk_id"], "full")
        changed = both.where("_new IS NULL OR _old IS NULL OR NOT (digest <=> _digest)").select("work_id").distinct()
        if changed.isEmpty():
            return None
        return self.update(chunks.join(changed, "work_id", "left_semi"), changed)

    def compact(self) -> int:
        """One generation with the live rows of all; the older ones are deleted after it is whole.  Not while an update runs."""
        own = self.generations()
        if len(own) == 1:
            return own[0]
        now = own[-1] + 1
        self._write(self.live("chunks", own).drop("generation"), "chunks", now)
        postings = self.live("postings", own).drop("generation")
        self._write(postings.repartitionByRange("bucket", "term", "chunk_id").sortWithinPartitions("bucket", "term", "chunk_id"), "postings", now, "bucket")
        n, tokens = self.size()
        # without its summary the mark counts for nothing; with it the older generations do not
        self._write(self.spark.range(0), "compacted", now)
        self._write(self.spark.createDataFrame([(n, tokens, 0, 0)], SUMMARY), "summary", now)
        for g in own:
            for name in ("summary", "compacted", "dead", "postings", "chunks"):
                self._delete(name, g)
        return now

    def compact_if_needed(self, dead_share: float = 0.2, force: bool = False) -> bool:
        """Compact where so much of what was written no longer counts; says whether it did."""
        own = self.generations()
        if not own:
            return False
        added, dead = self._read("summary", own).agg(F.sum("added_tokens"), F.sum("dead_tokens")).first()
        if not force and dead < dead_share * max(1, added):
            return False
        self.compact()
        return True

    def _delete(self, name: str, generation: int) -> None:
        fs, at = hadoop(self.spark, f"{self.root}/{name}/generation={generation}")
        fs.delete(at, True)

    def _write(self, df: DataFrame, name: str, generation: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}/generation={generation}")

    # -- search

    def postings_of(self, terms: list[str]) -> DataFrame:
        """Live postings of these terms: their buckets are the only ones read."""
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self.live("postings").where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))

    def bm25(self, match: Match) -> DataFrame:
        """work_id, chunk_id, relevance of the chunks that match; statistics are those of all chunks."""
        phrases, words = match.phrases, sorted({w for p in match.phrases for w in p})
        column = {w: f"_w{i}" for i, w in enumerate(words)}
        in_phrase = {w for p in phrases if len(p) > 1 for w in p}
        held = [F.max(F.when(F.col("term") == w, F.size("positions"))).alias(f"{column[w]}_n") for w in words]
        held += [F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(column[w]) for w in words if w in in_phrase]
        rows = self.postings_of(words).groupBy("work_id", "chunk_id", "dl").agg(*held)
        count = lambda p: F.col(f"{column[p[0]]}_n") if len(p) == 1 else _phrase_frequency(p, column)
        rows = rows.select("work_id", "chunk_id", "dl", *[F.greatest(F.coalesce(count(p), F.lit(0)), F.lit(0)).alias(f"_tf{i}") for i, p in enumerate(phrases)])
        n, tokens = self.size()
        found = rows.agg(*[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(phrases))])
        at, tests = 0, []
        for group in match.groups:
            tests.append(reduce(lambda a, b: a & b, [F.col(f"_tf{i}") > 0 for i in range(at, at + len(group))]))
            at += len(group)
        test = reduce((lambda a, b: a & b) if match.every else (lambda a, b: a | b), tests)
        norm = K1 * (1 - B + B * F.col("dl") / F.lit(tokens / n if n else 1.0))
        score = F.lit(0.0)
        for i in range(len(phrases)):
            tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
            score = score + F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6)) * tf * (K1 + 1) / (tf + norm)
        return rows.where(test).crossJoin(F.broadcast(found)).select("work_id", "chunk_id", score.alias("relevance"))  # one row is broadcast

    def search(self, query: str, mode: str = "anyTerm", limit: int = 100, allowed: DataFrame | None = None, cap: int | None = None) -> DataFrame:
        """work_id, chunk_id, relevance of the best chunks, as fts.keyword_search() has them without an index."""
        match = match_expression(query, mode)
        if match is None:
            return self.live("chunks").select("work_id", "chunk_id", F.lit(0.0).alias("relevance")).limit(0)
        hits = self.bm25(match)
        if allowed is not None:
            hits = hits.join(allowed.select("work_id").distinct(), "work_id", "left_semi")
        return top_hits(hits, limit, cap)

    def with_text(self, hits: DataFrame, limit: int) -> DataFrame:
        """hits, of which a limit leaves that many at most, with their texts."""
        few = F.broadcast(hits) if limit <= 10_000 else hits
        return self.live("chunks").select("chunk_id", "text").join(few, "chunk_id")

    def search_all_terms(self, query: str, retrieve: int = 240) -> DataFrame:
        """The best 240 chunks for any term, then those of works whose retrieved texts hold all."""
        hits = self.with_text(self.search(query, "anyTerm", retrieve), retrieve)
        return hits_with_all_terms(hits, query_terms(query))
