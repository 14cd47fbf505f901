"""Reconciliation of files: missing ones found by hash, committed transactions, folder conflicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.sources.kept import running_count, save


def missing_file_matches(known: DataFrame, found: DataFrame) -> DataFrame:
    """id, old_path, new_path of known files whose path vanished.

    known has id, pos, path, sha256; found has path and sha256.  A hash must have exactly one
    file that no known path claims, and that file goes to the first row in input order.
    """
    lost = known.join(found.select("path"), "path", "left_anti")
    free = found.join(known.select("path"), "path", "left_anti").groupBy("sha256").agg(F.count("*").alias("n"), F.min("path").alias("new_path")).where("n = 1")
    rank = F.row_number().over(Window.partitionBy("sha256").orderBy("pos"))
    first = lost.withColumn("_rank", rank).where("_rank = 1")
    return first.join(free, "sha256").select("id", F.col("path").alias("old_path"), "new_path")


def health_report(known: DataFrame, found: DataFrame) -> DataFrame:
    """checked, relocated, missing in one row."""
    moved = missing_file_matches(known, found).agg(F.count("*").alias("relocated"))
    lost = known.join(found.select("path"), "path", "left_anti").agg(F.count("*").alias("lost"))
    return known.agg(F.count("*").alias("checked")).crossJoin(moved).crossJoin(lost).select("checked", "relocated", (F.col("lost") - F.col("relocated")).alias("missing"))


def committed_transactions(moves: DataFrame, paths: DataFrame) -> DataFrame:
    """txn, committed: whether all of its destinations are known paths."""
    marked = moves.join(paths.select(F.col("path").alias("destination"), F.lit(True).alias("_known")).distinct(), "destination", "left")
    return marked.groupBy("txn").agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("committed"))


def safe_folders(files: DataFrame) -> DataFrame:
    """work_id of works none of whose folders holds another work's file."""
    shared = files.groupBy("folder").agg(F.count_distinct("work_id").alias("n")).where("n > 1").select("folder")
    bad = files.join(shared, "folder", "left_semi").select("work_id").distinct()
    return files.select("work_id").distinct().join(bad, "work_id", "left_anti")


#: Endings of the files that belong to an article; a name fits if all of them fit into LONGEST bytes of UTF-8.
COMPANIONS = (".pdf", ".md", ".assets", "-精读笔记.md", "-精读笔记.assets")
LONGEST = 255
_ROOM = LONGEST - max(len(c.encode()) for c in COMPANIONS)
#: Stems of more bytes than this may be cut when a number is added, and then meet others.
_CUT = _ROOM - len(" (999999999)")


def cut_utf8(value: str, most: int) -> str:
    """The characters of value, in order, as long as each fits into ``most`` bytes; one that does not is left out, and shorter ones after it may still fit."""
    if len(value.encode()) <= most:
        return value
    out, room = [], most
    for c in value:
        n = len(c.encode())
        if n <= room:
            out.append(c)
            room -= n
        if not room:
            break
    return "".join(out)


def _candidate(stem: str, ending: str, number: int) -> str:
    suffix = "" if number == 1 else f" ({number})"
    return cut_utf8(stem, (_ROOM if ending == ".pdf" else LONGEST - len(ending.encode())) - len(suffix.encode())) + suffix


class _Folder:
    """Names that are taken among related ones, case aside."""

    def __init__(self, taken: list[str]):
        self.names = {n.lower() for n in taken}
        self.next: dict[str, int] = {}

    def allocate(self, stem: str, ending: str) -> tuple[str, int]:
        """The first candidate whose name is free, a PDF's companions' too, and its number; names are only ever added, so a name's numbers only grow."""
        key = (stem + ending).lower()
        number = self.next.get(key, 1)
        while True:
            out = _candidate(stem, ending, number)
            own = [(out + c).lower() for c in (COMPANIONS if ending == ".pdf" else (ending,))]
            if self.names.isdisjoint(own):
                break
            number += 1
        self.next[key] = number + 1
        self.names.update(own)
        return out + ending, number


def unique_names(names: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """names (pos, name and, if there are several, folder) with ``unique``, a name of its own in its folder.

    Files come in order of pos: each takes its name, or the first of name (2), name (3), ... that nobody has, case
    aside, neither one of ``taken`` (folder, name) nor an earlier file (pos is unique in a folder; a null name is an empty
    one).  A PDF, which ends in .pdf then, also needs the names of its companions (notes and assets); others keep their ending.  Characters of a stem are left out where they do not fit, so that the longest companion fits into 255 bytes.

    Stems can only meet others that differ in numbers and companion endings, or beyond the length where they
    are cut; such families are dealt out and each goes through in order.  In a family all of whose stems are short,
    a PDF name's files beyond the largest number that stands in any of the family's names cannot meet another name: they count
    on from there, which needs no order in one place.  So a name that very many files share is counted, not gathered.
    """
    rows = names if "folder" in names.columns else names.withColumn("folder", F.lit(""))
    whole = F.coalesce("name", F.lit(""))
    ending = F.when(F.lower(whole).endswith(".pdf"), ".pdf").otherwise(F.regexp_extract(whole, r"(?<=.)(\.[^./]+)$", 1))
    rows = rows.withColumn("_ending", ending).withColumn("_stem", F.substring(whole, F.lit(1), F.length(whole) - F.length("_ending")))
    rows = rows.withColumn("_low", F.lower(F.concat("_stem", "_ending"))).withColumn("_root", _root(F.lower("_stem")))
    # what may be cut, and names whose numbers may meet a PDF's companions, go through in order
    long = (F.greatest(F.octet_length("_stem"), F.octet_length("_low") - F.octet_length("_ending")) > _CUT) | (F.octet_length("_low") > LONGEST - 12)
    stems = rows.groupBy("folder", "_root", "_low").agg(F.max(long).alias("_long"), F.max(F.col("_ending") != ".pdf").alias("_other"), F.max(_largest_number(F.col("_low"))).alias("_number"))
    family = stems.groupBy("folder", "_root").agg(F.count("*").alias("_stems"), (F.max("_long") | ((F.count("*") > 1) & F.max("_other"))).alias("_long"), F.max("_number").alias("_number"))
    if taken is None:
        held = rows.select("folder", "_root", "name").limit(0)
    else:
        bare = F.regexp_replace(F.lower("name"), r"(\.pdf|\.md|\.assets)$", "")
        held = (taken if "folder" in taken.columns else taken.withColumn("folder", F.lit(""))).select("folder", _root(bare).alias("_root"), "name", _largest_number(bare).alias("_number"))
        most = held.groupBy("folder", "_root").agg(F.max("_number").alias("_held"))
        family = family.join(most, ["folder", "_root"], "left").withColumn("_number", F.greatest("_number", "_held")).withColumn("_stems", F.when(F.col("_held").isNull(), F.col("_stems")).otherwise(2)).drop("_held")
    # a stem's files in order, numbered over sorted parts, so that no stem is one task's
    counted = running_count(rows, ["folder", "_low"], "pos", "_at").join(family, ["folder", "_root"])
    simple = counted.where("_stems = 1 AND NOT _long").withColumn("_n", F.col("_at"))
    mixed = counted.where("_stems > 1 OR _long")
    early = mixed.where("_long OR _at <= _number + 1")
    kind = dict(rows.dtypes)

    def fold(files: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        own, out = _Folder(list(held["name"])), []
        for row in files.sort_values("pos").itertuples():
            name, number = own.allocate(row.stem, row.ending)
            out.append((row.folder, row.low, row.pos, name, number, row.at))
        return pd.DataFrame(out, columns=["folder", "_low", "pos", "unique", "_number_now", "_at"])

    small = early.select("folder", "_root", F.col("_low").alias("low"), F.col("_stem").alias("stem"), F.col("_ending").alias("ending"), "pos", F.col("_at").alias("at"))
    folded = small.groupBy("folder", "_root").cogroup(held.select("folder", "_root", "name").groupBy("folder", "_root"))
    folded = save(folded.applyInPandas(fold, f"folder {kind['folder']}, _low string, pos {kind['pos']}, unique string, _number_now long, _at long"), "folded")
    shift = folded.groupBy("folder", "_low").agg((F.max("_number_now") - F.max("_at")).alias("_shift"))
    late = mixed.where("NOT _long AND _at > _number + 1").join(shift, ["folder", "_low"]).withColumn("_n", F.col("_at") + F.col("_shift"))
    columns = [*names.columns, "unique"]
    numbered = F.concat("_stem", F.when(F.col("_n") > 1, F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(F.lit("")), "_ending")
    first = early.drop("_at").join(folded.select("folder", "_low", "pos", "unique"), ["folder", "_low", "pos"])
    return simple.withColumn("unique", numbered).select(columns).unionByName(late.withColumn("unique", numbered).select(columns)).unionByName(first.select(columns))


def _root(low: Column) -> Column:
    """What stems that can meet have in common: without numbers and companion endings, as often as there are any; of long ones what no cut takes away."""
    bare = F.regexp_replace(low, r"(( \(\d+\))|(-精读笔记))+$", "")
    return F.when(F.octet_length(bare) > 2 * _CUT - _ROOM, F.substring(bare, 1, _CUT // 4)).otherwise(bare)


def _largest_number(low: Column) -> Column:
    digits = F.regexp_extract_all(low, F.lit(r" \((\d{1,9})\)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(digits, lambda x: x.cast("int"))), F.lit(0))


def companion_paths(path) -> dict:
    stem = F.regexp_replace(path, r"(?i)\.pdf$", "")
    return {"note": F.concat(stem, F.lit(".md")), "assets": F.concat(stem, F.lit(".assets"))}
