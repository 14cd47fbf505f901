"""BibTeX text as a source."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.sources.kept import running_total

HEAD = re.compile(r"\s*@\s*([A-Za-z]+)\s*([{(])\s*([^,\s{}()]+)\s*,", re.S)
NAME = re.compile(r"\s*([A-Za-z][\w:-]*)\s*=\s*")
BARE = re.compile(r"[^\s,})#]+")


def _value(text: str, at: int) -> tuple[str, int]:
    """A braced, quoted or bare value from ``at``, and where it ends."""
    if at < len(text) and text[at] in '{"':
        close, depth, start = ("}" if text[at] == "{" else '"'), 0, at + 1
        k = start
        while k < len(text):
            c = text[k]
            if c == "\\":
                k += 1
            elif c == close and depth == 0:
                return text[start:k], k + 1
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            k += 1
        raise ValueError("a value has no end")
    found = BARE.match(text, at)
    if not found:
        raise ValueError("a field has no value")
    return found.group(), found.end()


def parse_entry(text: str) -> dict[str, str]:
    """Fields of one entry, names in lower case, with @type and @key; ValueError for anything else."""
    head = HEAD.match(text)
    if not head:
        raise ValueError("no entry")
    out, at = {"@type": head.group(1).lower(), "@key": head.group(3)}, head.end()
    close = "}" if head.group(2) == "{" else ")"
    while True:
        while at < len(text) and (text[at].isspace() or text[at] == ","):
            at += 1
        if at >= len(text):
            raise ValueError("the entry has no end")
        if text[at] == close:
            break
        name = NAME.match(text, at)
        if not name:
            raise ValueError("not a field")
        value, at = _value(text, name.end())
        out[name.group(1).lower()] = " ".join(value.split())
    if text[at + 1 :].strip():
        raise ValueError("text after the entry")
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def parse_bibtex(text: pd.Series) -> pd.Series:
    """parse_entry(), null where it fails."""

    def one(t: str | None) -> dict[str, str] | None:
        try:
            return parse_entry(t) if t is not None else None
        except ValueError:
            return None

    return text.map(one)


def replace_key(entry, key):
    """A BibTeX text column under another citation key."""
    return F.regexp_replace(entry, F.lit(r"^(\s*@\s*[A-Za-z]+\s*[{(]\s*)[^,\s]+"), F.concat(F.lit("$1"), key))


#: How the text after a line's @ begins if an entry does.
ENTRY = r"^\s*[A-Za-z]+\s*[{(]\s*[^,\s{}()]+\s*,"


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """file, entry: the entries of BibTeX files of any size, as text from their @ on.

    Files are split anywhere and cut at lines that begin with @, so one large file is many tasks' work.  A
    line of a value may begin with @, too: what does not look like an entry's head belongs to the entry before.
    Text before a file's first entry is none.
    """
    raw = spark.read.option("lineSep", "\n@").option("recursiveFileLookup", "true").text(path)
    own = F.when(F.col("value").startswith("@"), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), own.alias("value"))
    rows = rows.withColumn("_head", F.col("value").rlike(ENTRY))
    if not rows.where("NOT _head").take(1):
        return rows.select("file", F.concat(F.lit("@"), "value").alias("entry"))
    numbered = running_total(rows, ["file", "_block", "_id"], F.col("_head").cast("long"), "_before").withColumn("_entry", F.col("_before") + F.col("_head").cast("long"))
    pieces = F.array_sort(F.collect_list(F.struct("_block", "_id", "_head", "value")))
    whole = numbered.groupBy("file", "_entry").agg(pieces.alias("pieces")).where("pieces[0]._head")
    return whole.select("file", F.concat(F.lit("@"), F.array_join(F.transform("pieces", lambda x: x["value"]), "\n@")).alias("entry"))


def write_bibtex(entries: DataFrame, path: str) -> None:
    """entries (pos, entry) as BibTeX files, in order over all files, with blank lines between."""
    entries.where("entry IS NOT NULL").orderBy("pos").select(F.col("entry").alias("value")).write.option("lineSep", "\n\n").text(path)
