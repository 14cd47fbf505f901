"""Near-duplicate embeddings by NN-descent over representatives.

1. Equal vectors of a label are one class.  Classes linked with a leader form its ball.  In
   a ball within half the threshold's angle any two members are linked by the triangle
   inequality, so they are counted without being compared; other balls are compared inside.
2. NN-descent over the leaders of each label: lists start from hyperplane buckets, and each
   round compares the neighbours of a node with each other, where one of them is new.  A
   list full of neighbours near enough for a link is doubled.
   Nodes whose lists are still full at the end are compared with all leaders of their label.
3. Recall is audited: the vectors whose id is divisible by 100 are compared with all vectors, and
   each counts alike, by the classes it is linked with; below the goal, more hyperplanes and
   longer lists follow, and at last all leaders of a label are compared.
4. Ball pairs near enough are compared member by member in double precision.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.components import connected_components
from papyra.llm.kernel import lean
from papyra.llm.scratch import Scratch

CHUNK = 512
SLACK = 1e-7
#: Pairs found after which a group's task removes repeated ones.
HELD_PAIRS = 1 << 21
#: Vectors that more than this many rows, and more than one in this many rows, share are common.
COMMON = 1000
LOG = logging.getLogger(__name__)


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors; rows must have one length and none be zero."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _lengths(batch: pa.RecordBatch, column: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each vector length in a batch."""
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    return [(at, _unit(batch.column(column).take(pa.array(at)))) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]]


def _planes(seed: int, bits: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits))


def _buckets(classes: DataFrame, seed: int, bits: int) -> DataFrame:
    """classes with bucket: label, length and the sides of random hyperplanes, hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for at, x in _lengths(batch, "vector"):
                code[at] = ((x @ _planes(seed, bits, x.shape[1])) > 0) @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(code)], ["cid", "code"])

    coded = classes.select("cid", "vector").mapInArrow(run, "cid long, code long")
    return classes.join(coded, "cid").withColumn("bucket", F.xxhash64("label", F.size("vector"), "code")).drop("code")


def _angles(pairs: DataFrame, a: str, b: str, keep: list[str], least: float = -2.0) -> DataFrame:
    """Columns keep with the cosine of the vector columns a and b, where it is at least ``least``."""
    schema = pairs.select(*keep, F.lit(0.0).alias("cosine")).schema

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                cosine = np.zeros(batch.num_rows)
                other = np.diff(batch.column(b).offsets.to_numpy())
                for at, x in _lengths(batch, a):
                    if (other[at] == x.shape[1]).all():
                        cosine[at] = np.einsum("ij,ij->i", x, _unit(batch.column(b).take(pa.array(at))))
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(cosine)], [*keep, "cosine"])
                yield out.filter(pa.array(cosine >= least))

    return pairs.select(*keep, a, b).mapInArrow(run, schema)


def balls(classes: DataFrame, cosine: float, scratch: Scratch, rounds: int = 3, bits: int = 10) -> DataFrame:
    """cid, ball, r: the leader of each class (itself at first), with which it is linked, and the angle to it."""
    ball = scratch.save(classes.select("cid", F.col("cid").alias("ball"), F.lit(0.0).alias("r"), F.lit(False).alias("leads")), "balls")
    for k in range(rounds):
        free = classes.join(ball.where("ball = cid").select("cid", "leads"), "cid")
        coded = _buckets(free, 1000 + k, bits)
        order = F.struct((~F.col("leads")).alias("n"), F.xxhash64("cid", F.lit(k)).alias("h"), F.col("cid").alias("leader"))
        leaders = coded.groupBy("bucket").agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1").select("bucket", "o.leader")
        leaders = leaders.join(classes.select(F.col("cid").alias("leader"), F.col("vector").alias("vector_l"), F.col("label").alias("label_l")), "leader")
        pairs = coded.where("NOT leads").join(leaders, "bucket").where("cid <> leader AND label = label_l AND size(vector) = size(vector_l)")
        joined = _angles(pairs, "vector", "vector_l", ["cid", "leader"], cosine)
        joined = joined.select("cid", "leader", F.acos(F.least(F.lit(1.0), "cosine")).alias("angle"))
        # a leader that others join this round must not join another
        joined = scratch.save(joined, "joined")
        leading = joined.select("leader").distinct()
        joins = joined.join(leading.withColumnRenamed("leader", "cid"), "cid", "left_anti").groupBy("cid").agg(F.min(F.struct("angle", "leader")).alias("to"))
        leading = leading.select(F.col("leader").alias("cid"), F.lit(True).alias("now"))
        nxt = ball.join(joins, "cid", "left").join(leading, "cid", "left")
        ball = scratch.save(
            nxt.select("cid", F.coalesce("to.leader", "ball").alias("ball"), F.coalesce("to.angle", "r").alias("r"), (F.col("leads") | F.coalesce("now", F.lit(False))).alias("leads")), "balls"
        )
    return ball.select("cid", "ball", "r")


def _best(edges: DataFrame, sizes: DataFrame | None, k: int) -> DataFrame:
    """The nearest neighbours of each p: k, or the size that ``sizes`` has for p."""
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.col("cosine").desc(), "q"))
    ranked = edges.groupBy("p", "q").agg(F.max("cosine").alias("cosine"), F.min("fresh").alias("fresh")).withColumn("rank", rank)
    if sizes is None:
        return ranked.where(F.col("rank") <= k)
    return ranked.join(sizes, "p", "left").where(F.col("rank") <= F.coalesce("k", F.lit(k))).drop("k")


def first_lists(nodes: DataFrame, seeds: range, bits: int, k: int) -> DataFrame:
    """Edges (p, q, cosine, fresh): neighbours in the order of a random projection within each bucket."""
    out = None
    for seed in seeds:
        coded = _buckets(nodes, seed, bits)
        turn = Window.partitionBy("bucket").orderBy(F.try_element_at("vector", F.lit(1 + seed % 7)), "cid")
        for step in (1, 2, 3):
            near = coded.select("cid", "vector", F.lead("cid", step).over(turn).alias("q"), F.lead("vector", step).over(turn).alias("vector_q"))
            pairs = near.where("q IS NOT NULL").select(F.col("cid").alias("p"), "q", "vector", "vector_q")
            out = pairs if out is None else out.unionAll(pairs)
    edges = _angles(out, "vector", "vector_q", ["p", "q"]).withColumn("fresh", F.lit(True))
    return edges.unionAll(edges.select(F.col("q").alias("p"), F.col("p").alias("q"), "cosine", "fresh"))


def _distinct(p: list[np.ndarray], q: list[np.ndarray], value: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Each pair (p, q) once; its cosine is the same wherever it was found, but for rounding."""
    a, b, c = np.concatenate(p), np.concatenate(q), np.concatenate(value)
    order = np.lexsort((b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)]) if len(a) else np.zeros(0, bool)
    return [a[new]], [b[new]], [c[new]]


def _local_join(table: pa.Table) -> pa.Table:
    """Compare the neighbours of each node of a group, where one of the two is new and beats a list."""
    table = table.combine_chunks()
    p, q, fresh, kth = (table.column(c).to_numpy() for c in ("p", "q", "fresh", "kth"))
    x = np.asarray(table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(p), -1)
    order = np.argsort(p, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(p[order]) != 0, [True]]))
    left, right, value = [], [], []
    held = 0
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        at = order[a:b]
        if len(at) < 2 or not fresh[at].any():
            continue
        s = x[at] @ x[at].T
        i, j = np.nonzero((fresh[at][:, None] | fresh[at][None, :]) & (s > kth[at][:, None]) & (q[at][:, None] != q[at][None, :]))
        left.append(q[at][i])
        right.append(q[at][j])
        value.append(s[i, j])
        held += len(i)
        if held > HELD_PAIRS:
            left, right, value = _distinct(left, right, value)
            held = 0
    if left:
        left, right, value = _distinct(left, right, value)
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
    return pa.table([join(left, np.int64), join(right, np.int64), join(value, np.float64)], ["p", "q", "cosine"])


def descend(nodes: DataFrame, edges: DataFrame, near: float, k: int, scratch: Scratch, max_rounds: int, group_rows: int = 500) -> tuple[DataFrame, DataFrame | None]:
    """The neighbour lists after NN-descent, and the nodes p whose lists were still full at the end."""
    count = nodes.count()
    groups = max(1, math.ceil(count / group_rows))
    sizes, grown = None, None
    graph = scratch.save(_best(edges, None, k), "graph")
    for _ in range(max_rounds):
        # a node takes part with its list and with the best of those that list it
        reverse = graph.select(F.col("q").alias("p"), F.col("p").alias("q"), "cosine", "fresh")
        around = _best(graph.select("p", "q", "cosine", "fresh").unionAll(reverse), sizes, 2 * k).drop("rank", "cosine")
        # a list with room takes anything; one that was doubled only what is near
        kth = graph.groupBy(F.col("p").alias("q")).agg(F.count("*").alias("n"), F.min("cosine").alias("worst"))
        kth = kth.withColumn("k", F.lit(k)) if sizes is None else kth.join(sizes.withColumnRenamed("p", "q"), "q", "left").withColumn("k", F.coalesce("k", F.lit(k)))
        kth = kth.select("q", F.when(F.col("n") >= F.col("k"), F.col("worst")).when(F.col("k") > k, F.lit(near - SLACK)).otherwise(F.lit(-2.0)).alias("kth"))
        rows = around.join(nodes.select(F.col("cid").alias("q"), "vector"), "q").join(kth, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
        if grown is not None:
            # what was compared with a full list before is compared again with the doubled one
            rows = rows.join(grown.select(F.col("p").alias("q"), F.lit(True).alias("again")), "q", "left")
            rows = rows.withColumn("fresh", F.col("fresh") | F.coalesce("again", F.lit(False))).drop("again")
        rows = rows.withColumn("g", F.pmod(F.xxhash64("p"), F.lit(groups))).withColumn("d", F.size("vector"))
        found = rows.groupBy("g", "d").applyInArrow(_local_join, "p long, q long, cosine double").withColumn("fresh", F.lit(True))
        old = graph.select("p", "q", "cosine", F.lit(False).alias("fresh"))
        nxt = scratch.save(_best(old.unionAll(found.select("p", "q", "cosine", "fresh")), sizes, k), "graph")
        scratch.drop(graph)
        graph = nxt
        full = graph.where(F.col("cosine") >= near).groupBy("p").agg(F.count("*").alias("n"))
        full = full.join(sizes, "p", "left") if sizes is not None else full.withColumn("k", F.lit(None).cast("int"))
        full = full.where(F.col("n") >= F.coalesce("k", F.lit(k))).select("p", (2 * F.coalesce("k", F.lit(k))).cast("int").alias("k"))
        grown = scratch.save(full, "sizes")
        saturated = grown.count()
        if saturated:
            sizes = grown if sizes is None else scratch.save(grown.unionAll(sizes.join(grown, "p", "left_anti")), "sizes")
        if graph.where("fresh").count() <= 0.002 * count * k and not saturated:
            break
    return graph, grown.select("p") if grown is not None and saturated else None


def _tile_pairs(nodes: DataFrame, chosen: DataFrame | None, scratch: Scratch) -> DataFrame:
    """own_a, own_b: tiles of the chosen nodes, or all, each beside every tile of its label and vector length.

    Tiles hold about CHUNK nodes, and pairs of tiles are dealt out alone, so the work on a
    large label spreads over many tasks.
    """
    key = ["label", "d"]
    nodes = nodes.select("cid", "label", "vector", F.size("vector").alias("d"))
    counts = nodes.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).alias("tiles"))
    tiled = scratch.save(nodes.join(counts, key).withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles"))), "tiled")
    own = tiled if chosen is None else tiled.join(chosen.select("cid").distinct(), "cid", "left_semi")
    pack = lambda rows, side: rows.groupBy(*key, F.col("tile").alias(f"tile_{side}")).agg(F.collect_list(F.struct("cid", "vector")).alias(f"own_{side}"))
    mine, others = scratch.save(pack(own, "a"), "tiles"), scratch.save(pack(tiled, "b"), "tiles")
    scratch.drop(tiled)
    pairs = mine.select(*key, "tile_a").join(others.select(*key, "tile_b"), key)
    return pairs.join(mine, [*key, "tile_a"]).join(others, [*key, "tile_b"]).select("own_a", "own_b")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ids, cosines) of each pair of tiles."""
    for whole in batches:
        for k in range(whole.num_rows):
            (p, x), (q, y) = ((side.field("cid").to_numpy(), _unit(side.field("vector"))) for side in (whole.column(c).slice(k, 1).flatten() for c in ("own_a", "own_b")))
            yield p, q, x @ y.T


def all_near(nodes: DataFrame, chosen: DataFrame | None, near: float, scratch: Scratch) -> DataFrame:
    """Edges (p, q, cosine, fresh) from the chosen nodes, or all, to every node of their label with a cosine of at least ``near``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, q, s in _products(batches):
            i, j = np.nonzero((s >= near) & (p[:, None] != q[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(p[i]), pa.array(q[j]), pa.array(s[i, j]), pa.array(np.zeros(len(i), bool))], ["p", "q", "cosine", "fresh"])

    return scratch.save(_tile_pairs(nodes, chosen, scratch).mapInArrow(run, "p long, q long, cosine double, fresh boolean"), "all_near")


def _members(parts: DataFrame) -> DataFrame:
    """ball, pack, own: the members of each ball in packs of CHUNK at most."""
    number = F.row_number().over(Window.partitionBy("ball", "part").orderBy("cid"))
    # balls are split before they are numbered, so none is numbered by one task
    split = parts.withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(16)))
    packs = split.withColumn("chunk", F.floor((number - 1) / CHUNK)).groupBy("ball", "part", "chunk")
    return packs.agg(F.collect_list(F.struct("cid", "m", "vector")).alias("own")).withColumn("pack", F.col("chunk") * 16 + F.col("part")).select("ball", "pack", "own")


def _compare(cosine: float):
    """Rows (cid, n, c, a, b): how many rows and classes of the other pack a class is linked with; of its own pack, itself left out."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                batch = whole.slice(k, 1)
                sides = []
                for name in ("own_a", "own_b"):
                    own = batch.column(name).flatten()
                    sides.append((own.field("cid").to_numpy(), own.field("m").to_numpy(), _unit(own.field("vector"))))
                (ia, ma, xa), (ib, mb, xb) = sides
                a, b = batch.column("a")[0].as_py(), batch.column("b")[0].as_py()
                hit = xa @ xb.T >= cosine
                if a == b and batch.column("pack_a")[0].as_py() == batch.column("pack_b")[0].as_py():
                    np.fill_diagonal(hit, True)
                    ids, n, c = ia, hit @ mb - 1, hit.sum(axis=1) - 1
                else:
                    ids, n, c = np.concatenate([ia, ib]), np.concatenate([hit @ mb, hit.T @ ma]), np.concatenate([hit.sum(axis=1), hit.sum(axis=0)])
                keep = n > 0
                size = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(n[keep].astype(np.int64)), pa.array(c[keep].astype(np.int64)), pa.array([a] * size, pa.int64()), pa.array([b] * size, pa.int64())], ["cid", "n", "c", "a", "b"])

    return run


def _audit(classes: DataFrame, cosine: float, scratch: Scratch) -> DataFrame:
    """cid, truth: the classes linked with each query class (of a vector whose id is divisible by 100), by comparing it with all classes of its label.

    Classes and not rows are counted, so a group of many copies weighs no more than a single
    vector.  Links are confirmed ones, so fewer than the truth are pairs not found.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, q, s in _products(batches):
            n = ((s >= cosine) & (p[:, None] != q[None, :])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n.astype(np.int64))], ["cid", "n"])

    pairs = _tile_pairs(classes, classes.where("asked"), scratch)
    return scratch.save(pairs.mapInArrow(run, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("truth")), "truth")


def near_embeddings(
    rows: DataFrame, *, cosine: float = 0.98, k: int = 10, bits: int = 8, planes: int = 3, max_rounds: int = 10, goal: float = 0.97, attempts: int = 3
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows (vec_id, embedding, label).

    Two vectors are linked where labels are equal and not null and the cosine, in double
    precision, is at least ``cosine``.  Vectors that are null, zero, or hold null or
    non-finite components link with nothing, nor do vectors of different lengths or rows with a
    null vec_id (their component_id is null, kept is true).  n_links counts other rows;
    repeated rows are vectors of their own with one id.  The mean recall of the query
    classes, those of vectors whose vec_id is divisible by 100, must reach ``goal``, or else, after ``attempts``, the
    leaders of each label are all compared with each other; audited_near_embeddings() says what was measured.  Components beyond 1e150, and vectors
    without one beyond 1e-150, count as non-finite and zero.  Other columns are ignored.
    """
    return audited_near_embeddings(rows, cosine=cosine, k=k, bits=bits, planes=planes, max_rounds=max_rounds, goal=goal, attempts=attempts)[0]


def audited_near_embeddings(
    rows: DataFrame, *, cosine: float = 0.98, k: int = 10, bits: int = 8, planes: int = 3, max_rounds: int = 10, goal: float = 0.97, attempts: int = 3
) -> tuple[DataFrame, float | None]:
    """near_embeddings() and the mean recall that its last audit measured; None where no query vector has a link."""
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark, "nndescent")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e150))) & F.exists("vector", lambda x: F.abs(x) > F.lit(1e-150))
    linked = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    classes = scratch.save(linked.groupBy("label", "vector").agg(F.min("vec_id").alias("cid"), F.count("*").alias("m"), F.max(F.pmod("vec_id", F.lit(100)) == 0).alias("asked")), "classes")
    # one id with several vectors: a class is known by its id, so it keeps the id for one and makes others
    number = F.row_number().over(Window.partitionBy("cid").orderBy("label", "vector"))
    classes = scratch.save(classes.withColumn("vec", F.col("cid")).withColumn("cid", F.when(number == 1, F.col("cid")).otherwise(F.xxhash64("cid", number))), "classes")
    ball = balls(classes, cosine, scratch)
    parts = scratch.save(classes.join(ball, "cid"), "parts")
    spread = parts.groupBy("ball").agg(F.max("r").alias("r"), F.sum("m").alias("rows"), F.count("*").alias("size"))
    nodes = scratch.save(classes.select("cid", "label", "vector").join(spread.select(F.col("ball").alias("cid")), "cid"), "nodes")
    unit = F.transform("vector", lambda x: x / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, y: s + y * y)))
    nodes = scratch.save(nodes.withColumn("vector", unit), "nodes")
    theta = math.acos(cosine)
    near = math.cos(min(math.pi, 3 * theta))  # leaders of two balls with a link
    tight = F.col("r") <= theta / 2 - 1e-6

    found = truth = recall = None
    for attempt in range(attempts + 1):
        if attempt < attempts:
            edges = first_lists(nodes, range(50 + 10 * attempt, 50 + 10 * attempt + planes * (attempt + 1)), bits, k)
            graph, full = descend(nodes, edges if found is None else edges.unionAll(found.select("p", "q", "cosine", "fresh")), near, k * 2**attempt, scratch, max_rounds)
            found = graph
            if full is not None:
                graph = graph.select("p", "q", "cosine", "fresh").unionAll(all_near(nodes, full.select(F.col("p").alias("cid")), near - SLACK, scratch))
        else:
            graph = all_near(nodes, None, near - SLACK, scratch)
        close = graph.where(F.col("cosine") >= near - SLACK).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
        side = lambda s: spread.select(F.col("ball").alias(s), F.col("r").alias(f"r_{s}"), F.col("rows").alias(f"rows_{s}"), F.col("size").alias(f"size_{s}"))  # noqa: B023, E731
        close = scratch.save(close.join(side("a"), "a").join(side("b"), "b").withColumn("angle", F.acos(F.least(F.lit(1.0), "cosine")) + F.col("r_a") + F.col("r_b")), "close")
        whole = close.where(F.col("angle") <= theta - 1e-6)
        packs = scratch.save(_members(parts), "packs")
        pairs = close.where(F.col("angle") > theta - 1e-6).select("a", "b").unionAll(spread.where(~tight).select(F.col("ball").alias("a"), F.col("ball").alias("b")))
        side = lambda s: packs.select(*[F.col(c).alias(n + s) for c, n in (("ball", ""), ("own", "own_"), ("pack", "pack_"))])  # noqa: B023, E731
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("a <> b OR pack_a <= pack_b")
        compared = scratch.save(pairs.mapInArrow(_compare(cosine), "cid long, n long, c long, a long, b long"), "compared")
        other = lambda s, o: whole.select(F.col(s).alias("ball"), F.col(f"rows_{o}").alias("n"), F.col(f"size_{o}").alias("c"))  # noqa: B023, E731
        per_ball = other("a", "b").unionAll(other("b", "a")).groupBy("ball").agg(F.sum("n").alias("all_of"), F.sum("c").alias("all_c"))
        inside = spread.select("ball", F.when(tight, F.col("rows") - 1).otherwise(0).alias("inside"), F.when(tight, F.col("size") - 1).otherwise(0).alias("inside_c"))
        links = parts.join(inside, "ball").join(per_ball, "ball", "left").join(compared.groupBy("cid").agg(F.sum("n").alias("some"), F.sum("c").alias("some_c")), "cid", "left")
        total = lambda *parts: sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)).cast("long")
        links = links.select("cid", "ball", "label", "vector", total("inside", "all_of", "some").alias("n_links"), total("inside_c", "all_c", "some_c").alias("n_classes"))
        links = scratch.save(links, "links")
        if attempt < attempts:
            truth = _audit(classes, cosine, scratch) if truth is None else truth
            seen = truth.where("truth > 0").join(links.select("cid", "n_classes"), "cid")
            recall = seen.agg(F.avg(F.least("truth", "n_classes") / F.col("truth"))).first()[0]
            LOG.info("recall of the query classes: %s", recall)
            if recall is None or recall >= goal:
                break
    joins = whole.select("a", "b").unionAll(compared.select("a", "b").distinct())
    # ids of classes, then of balls: a ball's members are linked, and so are balls with a link
    edges = joins.select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = connected_components(edges, scratch)
    least = parts.join(labels.withColumnRenamed("node", "ball"), "ball", "left").withColumn("group", F.coalesce("component", "ball"))
    of_group = least.groupBy("group").agg(F.min("vec").alias("component_id"))
    of_ball = least.select("ball", "group").distinct().join(of_group, "group").select("ball", "component_id")
    named = links.join(of_ball, "ball").join(classes.select("cid", "m"), "cid")
    named = scratch.save(named.select(F.col("label").alias("_l"), F.col("vector").alias("_v"), "m", "n_links", "component_id"), "named")
    # fewer than COMMON vectors can each be that share of the rows: they go to the rows, the others meet them in a shuffle
    bar = max(COMMON, -(-(classes.agg(F.sum("m")).first()[0] or 0) // COMMON))
    same = (F.col("label") == F.col("_l")) & (F.col("vector") == F.col("_v"))
    common = rows.join(F.broadcast(named.where(F.col("m") > bar)), same, "left")
    fields = ["vec_id", "n_links", "component_id"]
    rest = common.where("m IS NULL").select("vec_id", "vector", "label").join(named.where(F.col("m") <= bar), same, "left")
    out = common.where("m IS NOT NULL").select(*fields).unionAll(rest.select(*fields))
    known = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(known, F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), recall
