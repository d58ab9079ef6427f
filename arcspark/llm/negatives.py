"""Hard-negative mining by exact inner products, most of them never finished.

Vectors are turned by an orthogonal matrix, the principal axes of all of them,
so that the leading components hold most of every product. A product is
summed over leading components first; what is missing is at most the product
of the lengths of the two rests, and a slack covers the rounding. A pair whose
bound can't reach what is asked for is dropped; the others go on, and at last
their integer vectors are multiplied, exactly.

Two searches, each of all anchors, in blocks, against all rows: the best rows
of the anchor's own label, then, with those scores as bounds, the best rows of
other labels within each window. A task meets one block of anchors with one
part of the rows and keeps the best of each alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcspark.llm.common import materialize, new_scope, sweep

#: Anchors in a block; anchors and rows whose products are held at once; rows of a part, at most.
BLOCK, ANCHORS, ROWS, PART = 16_384, 512, 2048, 4_000_000
#: Share of pairs still alive from which a product goes on for all of a tile.
DENSE = 0.05
#: Integers below this add up exactly as doubles.
EXACT = float(1 << 53)
_FIRST, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Rotation:
    """Principal axes (columns), the first components of each step, and the slack for rounding as a share of both lengths."""

    axes: np.ndarray
    steps: list[int]
    slack: float

    @classmethod
    def of(cls, moments: np.ndarray) -> Rotation:
        """From the sum of the outer products of all vectors."""
        n = len(moments)
        _, axes = np.linalg.eigh(moments) if n else (None, np.zeros((0, 0)))
        axes = np.ascontiguousarray(axes[:, ::-1])
        unit = 2.0**-53
        # turning and adding up err by d**1.5 and d units; then how far the axes are from orthogonal, which errs by d**2
        off = float(np.linalg.norm(axes.T @ axes - np.eye(n))) + n * n * unit
        return cls(axes, sorted({max(1, n // 4), max(1, n // 2), n} - {0} if n else set()), 8 * (n**1.5 + n) * unit + 2 * off)


@dataclass
class Vectors:
    """Rows of some integer vectors: ids, labels, integers, turned components, and the length of what each step leaves."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    turned: np.ndarray
    rests: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, by: Rotation) -> Vectors:
        turned = whole @ by.axes
        squares = turned * turned
        rests = np.stack([np.sqrt(squares[:, s:].sum(1)) for s in by.steps], 1) if by.steps else np.zeros((len(ids), 0))
        return cls(ids, labels, whole, turned, rests, np.sqrt((whole * whole).sum(1)))

    def take(self, rows: np.ndarray | slice) -> Vectors:
        return Vectors(*(x[rows] for x in (self.ids, self.labels, self.whole, self.turned, self.rests, self.lengths)))


def integers(vectors: pa.Array, scale: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x width doubles that hold floor(scale * x), which rows take part); shorter vectors end in zeros.

    A vector takes part if it is there and all its components are numbers, and
    if the square of its length fits into a long: so does every score then.
    """
    n = len(vectors)
    sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64) if n else np.zeros(0, np.int64)
    flat = vectors.flatten()
    ok = np.asarray(vectors.is_valid())
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), np.float64)
    owner = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, width))
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = place < width
    with np.errstate(invalid="ignore", over="ignore"):
        out[owner[inside], place[inside]] = np.floor(scale * values[inside])
        squares = (out * out).sum(1)
    ok &= np.isfinite(squares) & (squares < 2.0**62)
    out[~ok] = 0
    return out, ok


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products of rows of ``a`` and ``b``, pair by pair."""
    if exact:  # every partial sum is an integer that a double holds
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


def alive(a: Vectors, b: Vectors, by: Rotation, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the allowed pairs whose score is in [low, high] of the row of ``a``; others are dropped as soon as bounds tell."""
    slack = by.slack * np.outer(a.lengths, b.lengths) + 1e-6
    partial = np.zeros((len(a.ids), len(b.ids)))
    i = j = None
    at = 0
    for k, s in enumerate(by.steps):
        if i is None:
            partial += a.turned[:, at:s] @ b.turned[:, at:s].T
            reach = np.outer(a.rests[:, k], b.rests[:, k]) + slack
            allowed = allowed & (partial + reach >= low[:, None]) & (partial - reach <= high[:, None])
            if np.count_nonzero(allowed) < DENSE * allowed.size:
                i, j = np.nonzero(allowed)
                partial, slack = partial[i, j], slack[i, j]
        else:
            partial = partial + np.einsum("ij,ij->i", a.turned[i, at:s], b.turned[j, at:s])
            reach = a.rests[i, k] * b.rests[j, k] + slack
            on = (partial + reach >= low[i]) & (partial - reach <= high[i])
            i, j, partial, slack = i[on], j[on], partial[on], slack[on]
        at = s
    if i is None:
        i, j = np.nonzero(allowed)
    exact = not len(i) or float(a.lengths.max() * b.lengths.max()) < EXACT / 2
    score = products(a.whole[i], b.whole[j], exact)
    on = (score >= low[i]) & (score <= high[i])
    return i[on], j[on], score[on]


class Best:
    """The best ``depth`` (score, id) of each slot: higher scores first, then lower ids."""

    def __init__(self, slots: int, depth: int):
        self.score = np.full((slots, depth), _FIRST)
        self.id = np.full((slots, depth), _LAST)
        self.n = np.zeros(slots, np.int64)

    def least(self) -> np.ndarray:
        """The score that a new entry must reach: the last of a full slot's."""
        return np.where(self.n == self.score.shape[1], self.score[:, -1], _FIRST)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        depth = self.score.shape[1]
        touched = np.unique(slot)
        kept = np.arange(depth) < self.n[touched, None]
        slot = np.concatenate([np.repeat(touched, self.n[touched]), slot])
        score = np.concatenate([self.score[touched][kept], score])
        ids = np.concatenate([self.id[touched][kept], ids])
        order = np.lexsort((ids, ~score, slot))  # ~ turns the order of all integers
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, touched)
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        on = place < depth
        self.score[slot[on], place[on]], self.id[slot[on], place[on]] = score[on], ids[on]
        self.n[touched] = np.minimum(np.diff(np.append(first, len(slot))), depth)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = np.arange(self.score.shape[1]) < self.n[:, None]
        return np.nonzero(held)[0], self.score[held], self.id[held]


def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """percent * score / 100, rounded up or down, without a product that a long can't hold."""
    q, r = np.divmod(score, 100)
    return percent * q + (-((-percent * r) // 100) if up else percent * r // 100)


def moments(rows: DataFrame, scale: float, width: int) -> tuple[int, np.ndarray]:
    """How many vectors there are, and the sum of their outer products: width * width numbers."""

    def work(batches):
        total, n = np.zeros((width, width)), 0
        for batch in batches:
            whole, _ = integers(batch.column(0), scale, width)
            total += whole.T @ whole
            n += len(whole)
        if n:
            i, j = np.nonzero(np.triu(total))
            yield pa.record_batch([pa.array([-1, *i.tolist()], pa.int32()), pa.array([-1, *j.tolist()], pa.int32()), pa.array([float(n), *total[i, j].tolist()])], ["i", "j", "x"])

    out, n = np.zeros((width, width)), 0
    for r in rows.select("vector").mapInArrow(work, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        if r["i"] < 0:
            n = int(r["x"])
        else:
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["x"]
    return n, out


def _dealt(rows: DataFrame, anchors: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Anchors of a block, then rows of a part, in each of blocks * parts tasks."""
    slot = lambda block, part: (block * parts + part).cast("int")
    block, part = F.pmod("akey", F.lit(blocks)), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    heads = anchors.withColumn("part", many(parts)).select(slot(block, F.col("part")).alias("slot"), F.lit(0).alias("kind"), F.col("anchor_id").alias("vec_id"), "akey", "label", "vector", "scores")
    tails = rows.withColumn("part", part).withColumn("block", many(blocks)).select(slot(F.col("block"), F.col("part")).alias("slot"), F.lit(1).alias("kind"), "vec_id", F.lit(None).cast("long").alias("akey"), "label", "vector", F.lit(None).cast("array<long>").alias("scores"))
    return heads.unionByName(tails).repartitionById(blocks * parts, "slot").sortWithinPartitions("kind")


def _search(dealt: DataFrame, by, scale: float, width: int, depth: int, window: tuple[int, int] | None) -> DataFrame:
    """(anchor_id, akey, top, score, vec_id): the best of each task, without a window of the anchor's label, with one of others for each of its scores."""

    def work(batches):
        rotation = by.value
        heads, keys, tops, waiting = [], [], [], []
        a = best = None

        def ready() -> None:
            nonlocal a, best, low, high
            whole = np.concatenate([x[2] for x in heads]) if heads else np.zeros((0, width))
            ids, labels = (np.concatenate([x[k] for x in heads]) if heads else np.zeros(0, np.int64) for k in (0, 1))
            a = Vectors.of(ids, labels, whole, rotation)
            if window:
                most = max((len(t) for t in tops), default=0)
                scores = np.asarray([[*t, *[_FIRST] * (most - len(t))] for t in tops], np.int64).reshape(len(tops), most)
                there = np.asarray([[k < len(t) for k in range(most)] for t in tops], bool).reshape(len(tops), most)
                scores = np.where(there, scores, 0)
                low, high = np.where(there, share(scores, window[0], True), _LAST), np.where(there, share(scores, window[1], False), _FIRST)
            else:
                low, high = np.full((len(ids), 1), _FIRST), np.full((len(ids), 1), _LAST)
            best = Best(len(ids) * low.shape[1], depth)

        low = high = None

        def meet(b: Vectors) -> None:
            slots = low.shape[1]
            if not slots:
                return
            for at in range(0, len(a.ids), ANCHORS):
                some = slice(at, at + ANCHORS)
                for label in np.unique(b.labels) if not window else (None,):
                    rows = np.arange(len(b.ids)) if window else np.flatnonzero(b.labels == label)
                    own = np.arange(len(a.ids))[some] if window else np.flatnonzero(a.labels[some] == label) + at
                    if not len(own) or not len(rows):
                        continue
                    x, y = a.take(own), b.take(rows)
                    allowed = x.ids[:, None] != y.ids[None, :]
                    if window:
                        allowed &= x.labels[:, None] != y.labels[None, :]
                    # what any window of an anchor still asks for
                    least = np.maximum(low[own], best.least().reshape(-1, slots)[own])
                    open_ = least <= high[own]
                    floor = np.where(open_, least, _LAST).min(1)
                    roof = np.where(open_, high[own], _FIRST).max(1)
                    i, j, score = alive(x, y, rotation, floor, roof, allowed & open_.any(1)[:, None])
                    for w in range(slots):
                        on = (score >= least[i, w]) & (score <= high[own[i], w])
                        best.add(own[i[on]] * slots + w, score[on], y.ids[j[on]])

        for batch in batches:
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(kind, 1))
            for anchors, part in ((True, batch.slice(0, cut)), (False, batch.slice(cut))):
                if not part.num_rows:
                    continue
                whole, _ = integers(part.column(4), scale, width)
                ids, labels = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 3))
                if anchors:
                    heads.append((ids, labels, whole))
                    keys += part.column(2).to_pylist()
                    tops += [x or [] for x in part.column(5).to_pylist()]
                    continue
                if a is None:
                    ready()
                if len(a.ids):
                    for at in range(0, len(ids), ROWS):
                        meet(Vectors.of(ids[at : at + ROWS], labels[at : at + ROWS], whole[at : at + ROWS], rotation))
        if best is not None and low.shape[1]:
            slot, score, ids = best.rows()
            owner, top = np.divmod(slot, low.shape[1])
            yield pa.record_batch([pa.array(a.ids[owner]), pa.array(np.asarray(keys, np.int64)[owner]), pa.array(top.astype(np.int32)), pa.array(score), pa.array(ids)], ["anchor_id", "akey", "top", "score", "vec_id"])

    return dealt.select("kind", "vec_id", "akey", "label", "vector", "scores").mapInArrow(work, "anchor_id long, akey long, top int, score long, vec_id long")


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", anchor: Column | None = None,
    scale: float = 256, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100),
) -> DataFrame:
    """Per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``anchor`` holds (ids divisible by 100). A
    row's score is its integer product with the anchor, higher ones first,
    lower ids first among equals. Positives: the first of the anchor's label;
    negatives: for each positive, the first of other labels whose score is
    within ``window`` percent of the positive's.

    Rows without an id, a label or a vector, with a component that is null or
    not finite, or so long that a score might not fit into a long, take no
    part. A shorter vector ends in zeros. Rows that share the anchor's id are
    neither its positives nor its negatives; rows that repeat an id otherwise
    stand each for itself, and an anchor with the same label and vector counts
    once. Without positives an anchor has no rows; an empty table gives none.
    Other columns are not looked at. A task holds BLOCK anchors and their best.
    """
    spark = vectors.sparkSession
    scope = new_scope("negatives")
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), (F.col(id_col) % 100 == 0 if anchor is None else anchor).alias("anchor"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0

    def sound(batches):
        for batch in batches:
            _, ok = integers(batch.column(2), scale, width)
            yield batch.filter(pa.array(ok))

    rows = rows.mapInArrow(sound, rows.schema)
    n, sums = moments(rows, scale, width)
    rotation = spark.sparkContext.broadcast(Rotation.of(sums))
    anchors = rows.where("anchor").select(F.col("vec_id").alias("anchor_id"), F.xxhash64("vec_id", "label", "vector").alias("akey"), "label", "vector").dropDuplicates(["anchor_id", "akey"])
    anchors = materialize(anchors, "negatives-anchors", scope)
    rows = rows.drop("anchor")
    blocks = -(-anchors.count() // BLOCK) or 1
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-tasks // blocks), -(-n // PART))

    found = _search(_dealt(rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")), blocks, parts), rotation, scale, width, positives, None)
    best = Window.partitionBy("anchor_id", "akey").orderBy(F.desc("score"), "vec_id")
    tops = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    tops = materialize(tops.select("anchor_id", "akey", (F.col("place") - 1).alias("top"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives", scope)
    scores = tops.groupBy("anchor_id", "akey").agg(F.transform(F.array_sort(F.collect_list(F.struct("top", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    found = _search(_dealt(rows, anchors.join(scores, ["anchor_id", "akey"]), blocks, parts), rotation, scale, width, negatives, window)
    best = Window.partitionBy("anchor_id", "akey", "top").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    out = found.join(tops, ["anchor_id", "akey", "top"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = materialize(out, "negatives")
    sweep(spark, scope)
    return out


MINED_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
