"""How far the sources of a language differ from each other, and which terms make the difference.

A group is one source in one language.  Its term shares are integers per billion, smoothed over
the terms the language keeps, and two groups differ by the sum of (p - q)**2 / q over all of
those, each rounded down.  That is groups times groups times terms; two kinds of terms share the work:

* heavy terms, which many groups have, go into dense tiles: the shares of a block of groups for a chunk
  of terms, one NumPy matrix, compared with each block of the language;
* rare terms are in few groups.  A group that lacks a term has its base share there, which is
  the same for all terms it lacks.  So the sum over rare terms is taken as if no two groups
  had a term in common: from each group's histogram of shares against the other's base share.
  Postings then correct it: for each pair of groups that a rare term has in common, by what
  that term really gives less what was assumed.

Both sums are exact integers, and are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.kernel import LOWER, lean, words
from papyra.llm.scratch import Scratch

#: Letters: A-Z, a-z and every byte of a non-ASCII character.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
#: A term is heavy if more groups than this have it, or a quarter of the language's groups.
RARE_GROUPS = 64
#: Terms of a chunk and groups of a block of the dense tiles.
CHUNK_TERMS = 512
BLOCK_GROUPS = 64
#: Languages whose sizes, a row each, may be broadcast.
BROADCAST_LANGS = 100_000
#: Counted rows that a task holds before it gives them away.
HELD = 400_000

_COUNTS = "lang string, source string, term string, n long, docs long"


def _count():
    """Occurrences and documents of each term by group, and a row without a term for each group, added up within a task."""
    names = ["lang", "source", "term"]

    def add_up(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(names).aggregate([("n", "sum"), ("docs", "sum")])
        return out.select([*names, "n_sum", "docs_sum"]).rename_columns([*names, "n", "docs"])

    def count(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for found in words(batch.column("text"), LETTER):
            rows = batch.slice(found.lo, found.hi - found.lo)
            lang, source = rows.column("lang").dictionary_encode(), rows.column("source").dictionary_encode()
            group, of = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
            langs, sources = lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary)))
            zero = pa.array(np.zeros(len(group), np.int64))
            yield pa.table([langs, sources, pa.nulls(len(group), pa.string()), zero, zero], names=[*names, "n", "docs"])
            if not len(found.start):
                continue
            raw = LOWER[found.raw[LETTER[found.raw]]]
            ends = np.concatenate([[0], np.cumsum(found.end - found.start)]).astype(np.int32)
            coded = pa.StringArray.from_buffers(len(found.start), pa.py_buffer(ends), pa.py_buffer(raw)).dictionary_encode()
            terms = len(coded.dictionary)
            once, n = np.unique(found.doc * terms + coded.indices.to_numpy(), return_counts=True)
            pair, at = np.unique(of[once // terms] * terms + once % terms, return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, at, n)
            by = pa.array(pair // terms)
            yield pa.table([langs.take(by), sources.take(by), coded.dictionary.take(pa.array(pair % terms)), pa.array(total), pa.array(np.bincount(at, minlength=len(pair)))], names=[*names, "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0
        for batch in batches:
            for table in count(batch):
                held.append(table)
                fresh += table.num_rows
                if fresh > HELD:
                    held, fresh = [add_up(held)], 0
                    if held[0].num_rows > HELD // 2:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from add_up(held).to_batches()

    return lean(run)


def share(count: Column, total: Column, scale: int = 10**9) -> Column:
    """1 + floor(scale * count / total) for count <= total < 2**53, by long division in steps of 1,000, so that 64 bits do."""
    div = lambda a, b: F.call_function("div", a, b)
    out, rest, step = div(count, total), count % total, scale
    while step > 1:
        rest = rest * 1000
        out, rest, step = out * 1000 + div(rest, total), rest % total, step // 1000
    return out + 1


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) DIV {q}"


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _corrections():
    """For pairs of groups with rare terms in common: what those terms give, less what was assumed of terms that only one or none of the two has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posts = batch.column("posts")
            size = posts.value_lengths().to_numpy()
            flat = posts.flatten()
            source = flat.field("source").dictionary_encode()
            lang = batch.column("lang").dictionary_encode()
            p, base = flat.field("p").to_numpy(), flat.field("base").to_numpy()
            code = np.repeat(lang.indices.to_numpy().astype(np.int64), size) * len(source.dictionary) + source.indices.to_numpy()
            group, code = np.unique(code, return_inverse=True)
            first = np.cumsum(size) - size
            keys, values = [], []
            for k in np.unique(size):
                for some in np.array_split(first[size == k], max(1, int((size == k).sum() * k * k) >> 20)):
                    at = some[:, None] + np.arange(k)
                    a, b = np.repeat(at, k, axis=1), np.tile(at, (1, k))
                    a, b = a[a != b], b[a != b]
                    value = _differ(p[a], p[b]) - _differ(p[a], base[b]) - _differ(base[a], p[b]) + _differ(base[a], base[b])
                    pair, of = np.unique(code[a] * len(group) + code[b], return_inverse=True)
                    total = np.zeros(len(pair), np.int64)
                    np.add.at(total, of, value)
                    keys.append(pair)
                    values.append(total)
            pair, value = np.concatenate(keys), np.concatenate(values)
            a, b = group[pair // len(group)], group[pair % len(group)]
            named = lambda g: source.dictionary.take(pa.array(g % len(source.dictionary)))
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(a // len(source.dictionary))), named(a), named(b), pa.array(value)], ["lang", "source", "item", "value"])

    return lean(run)


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of groups and chunk of terms as a matrix of shares; a row without a term names a group and its base share."""
    groups = rows[rows.term.isna()].sort_values("source")
    held = rows[rows.term.notna()]
    terms = np.sort(held.term.unique())
    shares = np.repeat(groups.base.to_numpy(np.int64)[:, None], len(terms), axis=1)
    shares[groups.source.searchsorted(held.source), np.searchsorted(terms, held.term)] = held.p
    one = rows.iloc[0]
    return pd.DataFrame([(one.lang, one.chunk, one.block, list(groups.source), groups.base.tolist(), list(terms), shares.tobytes())], columns=["lang", "chunk", "block", "sources", "bases", "terms", "shares"])


def _tiles():
    """Sums over a chunk's terms for each pair of groups of two blocks."""

    def spread(row: dict, side: str, column: dict) -> np.ndarray:
        own = np.array(row[f"bases_{side}"], np.int64)
        out = np.repeat(own[:, None], len(column), axis=1)
        if row[f"terms_{side}"]:
            out[:, [column[t] for t in row[f"terms_{side}"]]] = np.frombuffer(row[f"shares_{side}"], np.int64).reshape(len(own), -1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                column = {t: i for i, t in enumerate({*row["terms_a"], *row["terms_b"]})}
                a, b = spread(row, "a", column), spread(row, "b", column)
                neither = row["terms"] - len(column)
                base_a, base_b = np.array(row["bases_a"], np.int64), np.array(row["bases_b"], np.int64)
                value = np.stack([_differ(p, b).sum(axis=1) for p in a]) + neither * _differ(base_a[:, None], base_b)
                names_a, names_b = np.array(row["sources_a"], object), np.array(row["sources_b"], object)
                i, j = np.indices(value.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(i), pa.string()), pa.array(names_a[i], pa.string()), pa.array(names_b[j], pa.string()), pa.array(value.ravel())], ["lang", "source", "item", "value"])

    return lean(run)


def source_divergence(docs: DataFrame, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group, a source in a language.

    Part ``pair``: the divergence from each other source of the language, all of them.  Part ``term``: the kept
    terms that the group uses more than its language does, the ``top_terms`` largest by value.  Ranks go from 1 in
    a group and part, value descending, then item by its UTF-8 bytes.

    Terms are runs of letters, A-Z lower-cased; a language keeps those in at least min_docs of its rows.
    Null texts, languages and sources count as ''.  A group without terms, or a language that keeps none,
    has pairs all the same (of value 0 without terms kept).  A language with one source has no pairs.  Repeated rows
    count each time; other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    tasks = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count(), _COUNTS)
    counts = scratch.save(tasks.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")

    # kept terms, with their total and the number of groups that have them; `lead` marks one row of each
    term = Window.partitionBy("lang", "term")
    every = counts.where("term IS NOT NULL").select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), F.count("*").over(term).alias("groups"), (F.row_number().over(term.orderBy("source")) == 1).alias("lead"))
    kept = scratch.save(every.where(f"docs >= {min_docs}").drop("docs"), "kept")
    groups = counts.select("lang", "source").distinct()
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    langs = sizes.join(kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("lead").alias("kept_terms")), "lang", "left").fillna(0)
    groups = groups.join(langs, "lang").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n")), ["lang", "source"], "left").fillna(0, ["own_n"])
    whole, lang_whole = F.col("own_n") + F.col("kept_terms"), F.col("lang_n") + F.col("kept_terms")
    base = F.when(F.col("kept_terms") > 0, share(F.lit(1).cast("long"), F.greatest(whole, F.lit(1))))
    groups = scratch.save(groups.select("lang", "source", "sources", "kept_terms", whole.alias("whole"), lang_whole.alias("lang_whole"), base.alias("base")), "groups")

    heavy = (F.col("groups") > RARE_GROUPS) | (F.col("groups") * 4 >= F.col("sources"))
    posts = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "lead", "base", share(F.col("n") + 1, F.col("whole")).alias("p"), share(F.col("total") + 1, F.col("lang_whole")).alias("q"), heavy.alias("heavy"))
    posts = scratch.save(posts, "posts")

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    terms = ranked(posts.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))).where(f"rank <= {top_terms}")

    # rare terms: each group's shares against the other's base share, then corrections for terms in common
    rare = posts.where("NOT heavy")
    shares = rare.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("shares"), F.sum("terms").alias("rare_terms"))
    one = groups.join(shares, ["lang", "source"], "left").select("lang", "source", F.coalesce("base", F.lit(1)).alias("base"), F.coalesce("shares", F.array().cast("array<struct<p:long,terms:long>>")).alias("shares"), F.coalesce("rare_terms", F.lit(0)).alias("rare_terms"))
    of_lang = rare.where("lead").groupBy("lang").agg(F.count("*").alias("lang_rare"))
    side = lambda x: one.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in one.columns if c != "lang"])
    pairs = side("a").join(side("b"), "lang").where("source_a <> source_b").join(of_lang, "lang", "left")
    lacking = f"(coalesce(lang_rare, 0) - rare_terms_a - rare_terms_b) * ({_f('base_a', 'base_b')})"
    own = f"aggregate(shares_a, 0L, (s, x) -> s + x.terms * ({_f('x.p', 'base_b')}))"
    other = f"aggregate(shares_b, 0L, (s, x) -> s + x.terms * ({_f('base_a', 'x.p')}))"
    assumed = pairs.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.expr(f"{lacking} + {own} + {other}").alias("value"))
    common = rare.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "base")).alias("posts")).where("size(posts) > 1")  # of RARE_GROUPS at most
    fixes = common.select("lang", "posts").mapInArrow(_corrections(), "lang string, source string, item string, value long")

    # heavy terms: chunks of about CHUNK_TERMS terms, blocks of about BLOCK_GROUPS groups
    dense = posts.where("heavy")
    chunks = dense.where("lead").groupBy("lang").agg(F.ceil(F.count("*") / CHUNK_TERMS).cast("int").alias("chunks"))
    place = scratch.save(chunks.join(sizes, "lang").select("lang", "chunks", F.ceil(F.col("sources") / BLOCK_GROUPS).cast("int").alias("blocks")), "place")
    if place.count() <= BROADCAST_LANGS:  # else a join that splits large languages
        place = F.broadcast(place)
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    chunked = dense.join(place, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"), block, "source", "term", "p", "base", "lead")
    chunked = scratch.save(chunked, "chunked")
    in_chunk = chunked.where("lead").groupBy("lang", "chunk").agg(F.count("*").alias("terms"))
    named = groups.join(place, "lang").select("lang", "source", "base", block, "chunks").join(in_chunk, "lang").select("lang", "chunk", "block", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "base")
    packed = chunked.drop("lead").unionByName(named).groupBy("lang", "chunk", "block").applyInPandas(_pack, "lang string, chunk int, block int, sources array<string>, bases array<long>, terms array<string>, shares binary")
    packed = scratch.save(packed, "packed")
    face = lambda x: packed.select("lang", "chunk", *[F.col(c).alias(f"{c}_{x}") for c in ("sources", "bases", "terms", "shares")])
    tiles = face("a").join(face("b"), ["lang", "chunk"]).join(in_chunk, ["lang", "chunk"]).mapInArrow(_tiles(), "lang string, source string, item string, value long")

    parts = assumed.unionByName(fixes).unionByName(tiles.where("source <> item"))
    added = parts.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    pairs = ranked(added.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pairs.unionByName(terms.select(pairs.columns))
