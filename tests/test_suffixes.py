"""Keys that very many entries share: letters only, none twice, as many as there are entries."""

from pyspark.sql import functions as F

from papyra.functions import biblio
from papyra.sources import files


def by_hand(offset):
    """The rule as the application has it, from 0."""
    out = ""
    while True:
        out = chr(97 + offset % 26) + out
        offset = offset // 26 - 1
        if offset < 0:
            return out


def test_suffixes_beyond_two_letters(spark):
    numbers = [*range(1, 2000), 18278, 18279, 475254, 475255, 321272406, 321272407]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", biblio.alphabetic_suffix(F.col("n")).alias("s")).select("n", "s", biblio.suffix_number(F.col("s")).alias("back")).collect()
    assert {r.n: r.s for r in rows} == {n: by_hand(n - 1) for n in numbers}
    assert all(r.back == r.n for r in rows)


def test_keys_beyond_two_letters(spark):
    taken = ["Ka", "kAB", "kaaa", "Kaab", "kaac", "kab1", "k", "kA"]
    entries = [(i, "K") for i in range(800)] + [(1000 + i, k) for i, k in enumerate(taken)]
    got = {r.pos: r.unique for r in files.unique_keys(spark.createDataFrame(entries, "pos int, key string")).collect()}
    lows = {k.lower() for _, k in entries}
    free = (s for s in map(by_hand, range(5000)) if "k" + s not in lows)
    assert [got[i] for i in range(800)] == ["K" + next(free) for _ in range(800)]
    assert got[1006] == "k" + next(free)
    assert got[1001] == "kAB" and got[1000] == "Kaa" and got[1007] == "kAc"  # kAB itself is there
