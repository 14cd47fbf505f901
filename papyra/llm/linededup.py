"""Line dedup by site-relative frequency: drop the lines that many pages of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.scratch import Scratch, bytes_in

#: Bytes up to which the table of boilerplate lines may be broadcast; a shuffled join beyond.
BROADCAST_BYTES = 32 << 20
SALTS = 64


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate_lines(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """host, keys: the lines of each host on more than ``ratio`` of its pages.

    A page is a distinct whole text of its host, so that copies of one page, which the
    near-duplicate stage removes, don't make their lines boilerplate.  A page counts once
    for a line.  Lines are compared trimmed; blank lines never count.  At most
    (mean distinct lines of a page) / ratio lines of a host can qualify, so a host's list is
    short however many pages it has.
    """
    page = pages.select(F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    # a distinct text is known by its hashes; its lines go along once per task and are merged by first()
    keyed = page.select("host", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"), F.transform(lines, _line_key).alias("keys"))
    distinct = keyed.groupBy("host", "t1", "t2").agg(F.first("keys").alias("keys"))
    counted = distinct.select("host", F.explode(F.concat("keys", F.array(F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))))).alias("key"))
    frequency = counted.groupBy("host", "key").agg(F.count("*").alias("n"))
    # the null key counts the pages
    totals = frequency.where("key.a IS NULL").select(F.col("host").alias("host_"), F.col("n").alias("pages"))
    found = frequency.where(f"key.a IS NOT NULL AND n >= {int(min_pages)}").join(totals, F.col("host").eqNullSafe(F.col("host_")))
    return found.where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate_lines(
    pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = 0.08, min_pages: int = 5, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """All rows of pages, without the lines found on more than ``ratio`` of their host's pages.

    The column ``lines_dropped`` (long) counts them.  Other lines, their order and their
    white space stay, so a text without such lines is unchanged; a text of nothing else
    becomes empty.  Null texts stay null, null hosts are one host, repeated rows are
    treated alike, a line needs at least ``min_pages`` pages, and n_chars, where there is
    such a column, is counted anew for texts that changed.
    """
    scratch = Scratch(pages.sparkSession, "lines")
    found = scratch.save(boilerplate_lines(pages, host, text, ratio, min_pages), "boilerplate")
    small = bytes_in(pages.sparkSession, found.scratch_path) <= broadcast_bytes
    columns = [c for c in pages.columns if c != "lines_dropped"]
    left = pages.select(*columns)
    if small:
        on = F.col(host).eqNullSafe(F.col("_host"))
        joined = left.join(F.broadcast(found.select(F.col("host").alias("_host"), F.col("keys").alias("_keys"))), on, "left")
    else:  # a host may hold a third of the pages: its one row of lines goes to each salt
        salted = found.select(F.col("host").alias("_host"), F.col("keys").alias("_keys"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        left = left.withColumn("_own", F.pmod(F.xxhash64(*[F.col(c) for c in columns if c != host]), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, F.col(host).eqNullSafe(F.col("_host")) & (F.col("_own") == F.col("_salt")), "left")
    split = F.split(F.col(text), "\n")
    keep = F.filter(split, lambda x: ~F.coalesce(F.array_contains(F.col("_keys"), _line_key(F.trim(x))), F.lit(False)) | (F.trim(x) == ""))
    has = F.col("_keys").isNotNull() & F.col(text).isNotNull()
    out = joined.withColumn("_kept", F.when(has, keep))
    dropped = F.when(has, (F.size(split) - F.size("_kept")).cast("long")).otherwise(F.lit(0).cast("long"))
    fresh = F.when(has & (dropped > 0), F.array_join("_kept", "\n")).otherwise(F.col(text))
    out = out.withColumn("_fresh", fresh).withColumn("lines_dropped", dropped)
    new = {text: F.col("_fresh").alias(text)}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("lines_dropped") > 0, F.length("_fresh").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*[new.get(c, F.col(c)) for c in columns], "lines_dropped")
