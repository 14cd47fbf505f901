"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a seed lexicon and of one learned from labelled
rows, nearness of second-person words to lexicon words, capitals, punctuation and
obfuscation rates.  Trees and calibration are fitted by Spark ML on a bounded sample of
labelled rows (``max_train_rows``); every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.kernel import WORD_BYTE, Words, hash_words, lean, mix, words
from papyra.llm.scratch import Scratch

# Insults and slurs-free abuse words of the four corpus languages.
SEED_LEXICON = """
idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile cretin loser losers pathetic worthless
disgusting trash garbage scum clown clowns filth vermin freak creep jerk bastard bitch asshole crap damn hate
kill die shut fool foolish ugly fat liar coward pig retard retarded
idiota imbécil estúpido estúpida basura asqueroso asquerosa payaso inútil tonto tonta cerdo mierda cabrón odio
idiote imbécile crétin débile connard connasse ordure salaud pourriture merde minable nul pathétique clown
dumm idiotin trottel dummkopf arschloch abschaum versager wertlos widerlich müll schwachkopf depp hass scheiße
""".split()
# Second-person words of the same languages.
SECOND_PERSON = """you your yours yourself u ur tú tu tus te ti usted ustedes vosotros vuestro toi tes ton ta vous
votre vos du dich dir dein deine deiner ihr euch euer sie ihnen""".split()
# Signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

FOLDS = 4
#: Bytes of the two word beginnings that are learned besides whole words.
BEGINNINGS = (4, 5)
FEATURES = (
    "log_words", "seed_density", "seed_hits", "learned_density", "learned_hits", "learned_sum", "learned_max",
    "begin_density", "begin_sum", "begin_max", "you_near", "you_rate", "capital_rate", "shout_rate", "punctuation_rate",
    "exclamation_rate", "obfuscation_rate", "obfuscated_hits",
)


def _units(found: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word index, hash) of whole words and of the beginnings of longer words."""
    out = [(np.arange(len(found.start)), found.hash)]
    for size in BEGINNINGS:
        at = np.flatnonzero(found.end - found.start > size)
        start = found.start[at]
        out.append((at, mix(found.hash_of(start, start + size) + np.uint64(size))))
    return out


@lean
def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each unit of a batch: in how many of its documents of each fold and class it occurs."""
    for batch in batches:
        fold, toxic = batch.column("fold").to_numpy(), batch.column("toxic").to_numpy()
        keys = []
        for found in words(batch.column("text"), WORD_BYTE):
            doc = found.doc
            for at, unit in _units(found):
                pair = np.unique(np.stack([doc[at].astype(np.uint64) + np.uint64(found.lo), unit]), axis=1)
                keys.append(np.stack([fold[pair[0].astype(int)].astype(np.uint64) * np.uint64(2) + toxic[pair[0].astype(int)].astype(np.uint64), pair[1]]))
        if keys:
            pair, count = np.unique(np.concatenate(keys, axis=1), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64)), pa.array(pair[0].astype(np.int32)), pa.array(count.astype(np.int64))], ["unit", "cell", "n"])


def learn_lexicons(train: DataFrame, seen: dict[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted unit hashes and log odds: for each fold from the other folds, then from all.

    A unit must occur in at least three toxic documents, with odds at least six times
    those of the other documents.  seen: documents in each cell (2 * fold + toxic).
    """
    counts = train.select("text", "fold", "toxic").mapInArrow(_document_counts, "unit long, cell int, n long")
    wide = counts.groupBy("unit").agg(*[F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)])
    toxic = sum(F.col(f"c{2 * f + 1}") for f in range(FOLDS))
    clean = sum(F.col(f"c{2 * f}") for f in range(FOLDS))
    n_toxic, n_clean = (sum(seen.get(2 * f + y, 0) for f in range(FOLDS)) for y in (1, 0))
    odds = (toxic + 0.5) * (n_clean + 1.0) / ((clean + 0.5) * (n_toxic + 1.0))
    # the training rows are bounded, and so is what they have in common
    chosen = wide.where((toxic >= 3) & (odds >= 6))
    rows = np.array([tuple(r) for r in chosen.collect()], dtype=np.int64).reshape(-1, 1 + 2 * FOLDS)
    rows = rows[np.argsort(rows[:, 0].view(np.uint64))]
    out = []
    for left in [*range(FOLDS), None]:
        use = [f for f in range(FOLDS) if f != left]
        t, c = rows[:, [2 + 2 * f for f in use]].sum(axis=1), rows[:, [1 + 2 * f for f in use]].sum(axis=1)
        nt, nc = (sum(seen.get(2 * f + y, 0) for f in use) for y in (1, 0))
        weight = np.log((t + 0.5) * (nc + 1.0) / ((c + 0.5) * (nt + 1.0)))
        keep = (t >= 2) & (weight > 1.5)
        out.append((rows[keep, 0].view(np.uint64), weight[keep]))
    return out


def _look_up(table: tuple[np.ndarray, np.ndarray], units: np.ndarray) -> np.ndarray:
    keys, weight = table
    if not len(keys):
        return np.zeros(len(units))
    at = np.minimum(np.searchsorted(keys, units), len(keys) - 1)
    return np.where(keys[at] == units, weight[at], 0.0)


def _per_row(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n)


def _row_max(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, doc, values)
    return out


def features(found: Words, table: tuple[np.ndarray, np.ndarray], seed: np.ndarray, you: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n, doc = found.hi - found.lo, found.doc
    count = np.maximum(np.diff(found.bounds), 1)
    units = _units(found)
    hashes = units[0][1]
    in_seed = np.isin(hashes, seed)
    learned = _look_up(table, hashes)
    begins = np.zeros(len(hashes))
    for at, unit in units[1:]:
        np.maximum.at(begins, at, _look_up(table, unit))
    hit = in_seed | (learned > 0) | (begins > 2.5)
    # nearness: 1 / (1 + words between) of the nearest second-person word, the largest of the text
    is_you = np.isin(hashes, you)
    at_hit, at_you = np.flatnonzero(hit), np.flatnonzero(is_you)
    near = np.zeros(n)
    if len(at_hit) and len(at_you):
        right = np.searchsorted(at_you, at_hit)
        for side in (np.clip(right, 0, len(at_you) - 1), np.clip(right - 1, 0, len(at_you) - 1)):
            other = at_you[side]
            same = doc[other] == doc[at_hit]
            np.maximum.at(near, doc[at_hit][same], 1.0 / np.maximum(1, np.abs(other - at_hit))[same])
    raw = found.raw
    size = np.maximum(np.diff(found.offsets), 1)

    def rate(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[found.offsets]) / size

    upper = (raw >= 65) & (raw <= 90)
    letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    sign = ~WORD_BYTE[raw] & (raw > 32)
    digit = (raw >= 48) & (raw <= 57)
    masked = np.zeros(len(raw), bool)
    if len(raw) > 2:
        hidden = (sign & (raw != 39) & (raw != 45)) | digit
        masked[1:-1] = hidden[1:-1] & letter[:-2] & letter[2:]
    capitals = np.concatenate([[0], np.cumsum(upper)])
    shout = (capitals[found.end] - capitals[found.start] == found.end - found.start) & (found.end - found.start > 2)
    obfuscated = np.zeros(n)
    # tokens between white space that hold such a sign, each once and whole
    at = np.flatnonzero(masked)
    space = np.flatnonzero(raw <= 32)
    begin, stop = np.union1d(space + 1, found.offsets[:-1]), np.union1d(space, found.offsets[1:])
    starts, one = np.unique(begin[np.searchsorted(begin, at, side="right") - 1], return_index=True)
    ends = stop[np.searchsorted(stop, at[one], side="right")]
    rows = np.searchsorted(found.offsets, starts, side="right") - 1
    for row, lo, hi in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
        token = raw[lo:hi].tobytes().decode("utf-8", "ignore").lower()
        plain = ["".join(c for c in form if c.isalpha()) for form in (token, token.translate(LEET))]
        forms = hash_words([p for p in plain if p])
        obfuscated[row] += bool(np.isin(forms, seed).any() or _look_up(table, forms).any())
    add = lambda values: _per_row(values, doc, n)
    return np.stack([
        np.log1p(np.diff(found.bounds)), add(in_seed) / count, add(in_seed), add(learned > 0) / count, add(learned > 0), add(learned), _row_max(learned, doc, n),
        add(begins > 0) / count, add(begins), _row_max(begins, doc, n), near, add(is_you) / count, rate(upper), add(shout) / count, rate(sign),
        rate(raw == 33), rate(masked), obfuscated,
    ], axis=1)


def with_features(docs: DataFrame, lexicons: list[tuple[np.ndarray, np.ndarray]], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and an array ``features``; rows with a column fold use that fold's lexicon."""
    by_fold = "fold" in keep
    columns = [F.col(c) for c in keep] + [F.col("text").alias("_text")]
    schema = docs.select(*[F.col(c) for c in keep], F.array().cast("array<double>").alias("features")).schema
    tables = [(k.tobytes(), w.tobytes()) for k, w in lexicons]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(np.frombuffer(k, np.uint64), np.frombuffer(w)) for k, w in tables]
        seed, you = np.unique(hash_words(SEED_LEXICON)), np.unique(hash_words(SECOND_PERSON))
        for batch in batches:
            fold = batch.column("fold").to_numpy() if by_fold else None
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = np.zeros((part.num_rows, len(FEATURES)))
                for found in words(part.column("_text"), WORD_BYTE):
                    if not by_fold:
                        rows[found.lo : found.hi] = features(found, own[-1], seed, you)
                        continue
                    mine = fold[lo + found.lo : lo + found.hi]
                    for f in np.unique(mine):
                        at = np.flatnonzero(mine == f)
                        rows[found.lo + at] = features(found, own[int(f)], seed, you)[at]
                flat = pa.array(rows.ravel())
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.ListArray.from_arrays(offsets, flat)], [*keep, "features"])

    return docs.select(*columns).mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, max_train_rows: int) -> DataFrame:
    """doc_id, text, toxic, fold: labelled rows outside the held-out fifth, at most about max_train_rows.

    Where there are more, those with the smallest hash of doc_id are taken.  A doc_id that
    is labelled more than once counts as toxic if any label says so; null labels say nothing.
    Texts are whole, however long.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    total = marked.count()
    if total > max_train_rows:
        bound = int(max_train_rows / total * 2**32)
        marked = marked.where((F.xxhash64("doc_id").bitwiseAND(2**32 - 1)) < bound)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return plain.join(F.broadcast(marked) if total <= max_train_rows * 2 else marked, "doc_id").select("doc_id", "text", "toxic", fold)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, max_train_rows: int = 20_000, trees: int = 20, depth: int = 3, seed: int = 11
) -> DataFrame:
    """All rows of docs with held_out, score (0 to 1) and predicted.

    Only ``text`` feeds the score.  Null and empty texts are scored as texts without
    words; repeated rows get equal scores; other columns pass through, except clashing
    names (held_out, score, predicted), which are replaced.  A null doc_id is not held
    out.  Without labels of both classes the score is 1 - exp(-50 * seed lexicon density).
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    docs = docs.drop("held_out", "score", "predicted", "features", "fold", "toxic")
    keep = docs.columns
    train = scratch.save(training_rows(docs, labels, max_train_rows), "train")
    seen = {2 * r["fold"] + r["toxic"]: r["n"] for r in train.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    both = all(sum(seen.get(2 * f + y, 0) for f in range(FOLDS)) for y in (0, 1))
    if not both:
        rows = with_features(docs, [(np.zeros(0, np.uint64), np.zeros(0))] * (FOLDS + 1), keep)
        score = 1 - F.exp(-50 * F.col("features")[FEATURES.index("seed_density")])
    else:
        lexicons = learn_lexicons(train, seen)
        table = scratch.save(with_features(train, lexicons, ["doc_id", "toxic", "fold"]), "features")
        table = table.select("fold", F.col("toxic").cast("double").alias("label"), array_to_vector("features").alias("vector")).coalesce(4).cache()
        make = GBTClassifier(labelCol="label", featuresCol="vector", maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, minInstancesPerNode=5, seed=seed, cacheNodeIds=False)
        # the trees leave fold 0 to the calibration, where both parts hold both classes
        apart = _both(table.where("fold > 0")) and _both(table.where("fold = 0"))
        trees_model = make.fit(table.where("fold > 0") if apart else table)
        judged = trees_model.transform(table.where("fold = 0") if apart else table)
        calibration = IsotonicRegression(labelCol="label", featuresCol="p").fit(judged.select("label", vector_to_array("probability")[1].alias("p")))
        table.unpersist()
        rows = with_features(docs, lexicons, keep).withColumn("vector", array_to_vector("features"))
        rows = trees_model.transform(rows).withColumn("p", vector_to_array("probability")[1])
        rows = calibration.setPredictionCol("calibrated").transform(rows.drop("prediction"))
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("calibrated") + 0.001 * F.col("p")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    out = rows.select(*keep, held.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _both(table: DataFrame) -> bool:
    return table.select("label").distinct().count() == 2
