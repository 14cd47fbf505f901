"""Sources and sinks: tables, PDF listings, manifests, BibTeX, journals, cached lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST_VERSION = 10
# Schemas as DDL, so that importing this needs no session.
WORK = (
    "work_id string, title string, authors string, year int, journal string, abstract_text string, doi string, nber string, ssrn string, arxiv string, repec string, "
    "category string, date_added timestamp, needs_review boolean, duplicate_of string, metadata_source string, metadata_confirmed boolean"
)
VERSION = ("file_version_id string, work_id string, relative_path string, original_filename string, page_count int, file_size bigint, sha256 string, fingerprint string, version_type string, is_preferred boolean")
MANIFEST = (
    "schemaVersion int, libraryID string, deletedWorkIDs array<string>, "
    "works array<struct<work_id:string,title:string,category:string,versions:array<struct<version_id:bigint,status:string>>,tagNames:array<string>>>"
)


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def pdf_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, sha256 of every PDF below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.lower("path").endswith(".pdf")).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, primary: str, backups: str, library: str | None = None) -> DataFrame:
    """The first manifest that decodes, is not of a newer schema and has the library's id: the
    primary first, then backups, newest first.  paths may not exist."""

    def load(path: str, rank: int) -> DataFrame:
        raw = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").schema(MANIFEST).json(path)
        return raw.select("*", F.lit(rank).alias("_rank"), F.col("_metadata.file_modification_time").alias("_time"))

    out = None
    for k, path in enumerate((primary, backups)):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            out = load(path, k) if out is None else out.unionAll(load(path, k))
    if out is None:
        return spark.createDataFrame([], MANIFEST)
    good = out.where(F.col("schemaVersion").isNotNull() & (F.col("schemaVersion") <= MANIFEST_VERSION))
    if library is not None:
        good = good.where(F.col("libraryID") == library)
    return good.orderBy("_rank", F.col("_time").desc()).limit(1).drop("_rank", "_time")


def stamp(ts: Column) -> Column:
    """ISO 8601 without colons."""
    return F.replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(":"), F.lit("-"))


def recoverable_imports(journal: DataFrame, files: DataFrame) -> DataFrame:
    """journal rows with ``action``: recover, clean or warn (undecodable: a null destination)."""
    known = files.select(F.col("path").alias("destination"), F.lit(True).alias("_there")).distinct()
    out = journal.join(known, "destination", "left")
    return out.withColumn("action", F.when(F.col("destination").isNull(), "warn").when(F.col("_there"), "recover").otherwise("clean")).drop("_there")


def cache_name(doi: Column, title: Column, author: Column, year: Column) -> Column:
    """File name of a cached lookup."""
    key = F.concat_ws("|", F.lit("v3"), F.coalesce(F.nullif(F.lower(doi), F.lit("")), F.lower(title), F.lit("")), F.lower(F.coalesce(author, F.lit(""))), F.coalesce(year.cast("string"), F.lit("")))
    return F.concat(F.sha2(key, 256), F.lit(".json"))


def fresh(ts: Column, as_of: str, days: int = 30) -> Column:
    return ts >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAYS")


def first_source(*lookups: DataFrame, key: str, value: str) -> DataFrame:
    """key, value from the first table that has it."""
    out = None
    for k, df in enumerate(lookups):
        own = df.select(key, F.col(value).alias(f"_{k}"))
        out = own if out is None else out.join(own, key, "full")
    return out.select(key, F.coalesce(*[F.col(f"_{k}") for k in range(len(lookups))]).alias(value))


def known_stages(failures: DataFrame, stages: tuple[str, ...] = ("extraction", "embedding", "query", "rerank")) -> DataFrame:
    return failures.where(F.col("stage").isin(*stages)).orderBy(F.col("occurred_at").desc())


def bibtex_document(entries: DataFrame) -> DataFrame:
    """One row: entries (pos, content) joined by blank lines, with a line end."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    return entries.agg(F.concat(F.array_join(ordered, "\n\n"), F.lit("\n")).alias("document"))


def unique_keys(entries: DataFrame) -> DataFrame:
    """entries (pos, key) with ``unique``: repeated keys, case aside, end in a, b, ..., skipping keys already there.

    Suffixes are dealt in order; a key with a suffix that some entry has as its own is passed over.
    """
    from papyra.functions.biblio import alphabetic_suffix, suffix_number

    own = F.lower("key")
    n = F.count("*").over(Window.partitionBy("_low"))
    at = F.row_number().over(Window.partitionBy("_low").orderBy("pos"))
    marked = entries.withColumn("_low", own).withColumn("_n", n).withColumn("_at", at)
    # a key with one to seven letters taken off its end: what it holds a suffix of
    ends = F.filter(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.struct(F.substr("_taken", F.lit(1), F.length("_taken") - k).alias("_low"), F.substr("_taken", F.length("_taken") - k + 1).alias("end"), k.alias("k"))), lambda x: (F.length("_taken") > x["k"]) & x["end"].rlike("^[a-z]+$"))
    held = entries.select(own.alias("_taken")).distinct().select(F.explode(ends).alias("x")).select("x._low", suffix_number(F.col("x.end")).alias("number"))
    # the k-th number held is passed over by entries from its place less those passed over before it
    held = held.groupBy("_low").agg(F.transform(F.array_sort(F.collect_set("number")), lambda x, k: x - k).alias("_from"))
    out = marked.join(held, "_low", "left").withColumn("_number", F.col("_at") + F.coalesce(F.size(F.filter("_from", lambda x: x <= F.col("_at"))), F.lit(0)))
    return out.withColumn("unique", F.when(F.col("_n") > 1, F.concat("key", alphabetic_suffix(F.col("_number")))).otherwise(F.col("key"))).drop("_low", "_n", "_at", "_from", "_number")
