"""Hard negatives by exact search in a multiway hyperplane tree.

Vectors of whole numbers are given one more component that makes them equally long. Inner products with an anchor then fall as the
distance grows, and a window of scores is a ring around the anchor. A node of the tree has ``FAN`` split points and gives each vector
to the nearest. Each split point knows the range of its distances to every sibling's subtree, over all rows; a subtree whose range
misses the ring, as seen from any split point of the node, is left out. Leaves are searched exactly, so the result is exact.

Rows with a null label, a null vector or a component that is null or not finite take no part, nor do those whose squared length
exceeds 2^62, as their scores need not fit a long. Shorter vectors count as if filled up with zeros; an empty one is all zeros.
Repeated rows are rows of their own, as anchors too. A null vec_id is no anchor and stands behind all others. Columns besides vec_id,
embedding and label are not read. Without anchors, or without rows of another label, the result is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import column, small_batches
from ebbtide.runtime import materialize, scratch_dir

SCALE = 256
FAN = 12
"""Split points of a node."""

DEPTH = 2
"""Levels of nodes; the tree has FAN ** DEPTH leaves, which keep their distances to the split points above them only."""

SAMPLE_ROWS = 4096
"""Rows that the split points are picked from, at most: those with the least hashes. All rows are indexed."""

BLOCK_BYTES = 8 << 20
"""Anchors sent to the executors at a time, in bytes of their vectors; any number of blocks follow each other."""

BATCH_ROWS, BATCH_ANCHORS = 4096, 256
"""A task scores so many rows against so many anchors at once."""

LONGEST = 2.0**62
NO_ID, NO_SCORE = 2**63 - 1, -(2**62) - 1


class Tree:
    """Split points, and per node, split point and sibling the range of distances (None until all rows have been seen)."""

    def __init__(self, sample: np.ndarray, square: float, dim: int) -> None:
        self.square, self.dim = square, dim
        self.points = [np.zeros((FAN**level, FAN, dim + 1)) for level in range(DEPTH)]
        self.ranges: list[np.ndarray] | None = None
        self._pick(self._longer(sample), 0, 0)

    def _longer(self, rows: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.square - (rows * rows).sum(1), 0))
        return np.concatenate([rows, last[:, None]], axis=1)

    def _pick(self, rows: np.ndarray, level: int, node: int) -> None:
        """Each split point is the row farthest from those before it; a node of too few rows repeats one, which stays without rows."""
        if level == DEPTH or not len(rows):
            return
        near = np.full(len(rows), -np.inf)
        at = 0
        for i in range(FAN):
            self.points[level][node, i] = rows[at]
            near = np.maximum(near, rows @ rows[at])
            at = int(near.argmin())
        child = (rows @ self.points[level][node].T).argmax(1)
        for i in range(FAN):
            self._pick(rows[child == i], level + 1, node * FAN + i)

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Leaves of rows, and per level their node, their child and their distances to the node's split points."""
        long, node, seen = self._longer(rows), np.zeros(len(rows), dtype=np.int64), []
        for points in self.points:
            product = np.empty((len(rows), FAN))
            for n in np.unique(node):
                product[node == n] = long[node == n] @ points[n].T
            child = product.argmax(1)
            seen.append((node, child, np.sqrt(np.maximum(2 * self.square - 2 * product, 0))))
            node = node * FAN + child
        return node, seen

    def leaves(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which leaves (columns) may hold a row that scores ``low`` to ``high`` with an anchor (rows)."""
        own = (anchors * anchors).sum(1)
        reach = np.sqrt(np.maximum(own + self.square - 2 * low, 0))
        inner = np.sqrt(np.maximum(own + self.square - 2 * high, 0))
        slack = 1e-6 * (1 + np.sqrt(own + self.square))
        open_ = np.ones((len(anchors), 1), dtype=bool)
        for points, (least, most) in zip(self.points, self.ranges):
            away = own[:, None, None] + self.square - 2 * np.einsum("qd,nfd->qnf", anchors, points[:, :, :-1])
            away = np.sqrt(np.maximum(away, 0))
            start = np.maximum(away - reach[:, None, None], inner[:, None, None] - away) - slack[:, None, None]
            end = away + (reach + slack)[:, None, None]
            fits = np.ones((len(anchors), len(points), FAN), dtype=bool)
            for f in range(FAN):  # split point f against the subtrees of all its siblings
                fits &= (most[None, :, f, :] >= start[:, :, f, None]) & (least[None, :, f, :] <= end[:, :, f, None])
            open_ = (fits & open_[:, :, None]).reshape(len(anchors), -1)
        return open_


def _vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, whole-number components and squared length of the rows that take part."""
    x = column(rows, "embedding")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    out = rows.where(column(rows, "label").isNotNull() & x.isNotNull() & fine).select(
        column(rows, "vec_id").cast("long").alias("vec_id"), column(rows, "label").cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("double")).alias("_x"))
    return out.withColumn("_square", F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v)).where(F.col("_square") <= LONGEST)


def _matrix(lists: list, dim: int, kind: type = np.float64) -> np.ndarray:
    out = np.zeros((len(lists), dim), dtype=kind)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def _unpack(values: list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.int32).reshape(len(values), dim)


_PLACED = pa.schema([("leaf", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary()), ("anchor", pa.int64()), ("own", pa.int64())])


def _place(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        rows = _matrix(b["_x"].to_pylist(), tree.dim)
        leaf, _ = tree.place(rows)
        packed = [r.tobytes() for r in rows.astype(np.int32)]
        own = (rows.astype(np.int64) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(leaf.astype(np.int32)), b["vec_id"], b["label"], pa.array(packed, pa.binary()), b["_anchor"], pa.array(own)], schema=_PLACED)


_RANGES = pa.schema([("level", pa.int32()), ("node", pa.int32()), ("child", pa.int32()), ("least", pa.list_(pa.float64())), ("most", pa.list_(pa.float64()))])


def _spread(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """Distances from a node's split points to the rows of each subtree: least and most, once a task."""
    found: dict[tuple, list] = {}
    for b in batches:
        if not b.num_rows:
            continue
        for level, (node, child, away) in enumerate(tree.place(_unpack(b["x"].to_pylist(), tree.dim).astype(np.float64))[1]):
            for n, c in np.unique(np.stack([node, child], axis=1), axis=0):
                mine = away[(node == n) & (child == c)]
                old = found.get((level, n, c))
                least, most = mine.min(0), mine.max(0)
                found[level, n, c] = [least, most] if old is None else [np.minimum(old[0], least), np.maximum(old[1], most)]
    if found:
        yield pa.RecordBatch.from_pylist(
            [{"level": k[0], "node": int(k[1]), "child": int(k[2]), "least": v[0].tolist(), "most": v[1].tolist()} for k, v in found.items()], _RANGES)


class _Best:
    """The first ``k`` rows in each window of each anchor that a task has seen."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.score = np.full((*low.shape, k), NO_SCORE, dtype=np.int64)
        self.id = np.full((*low.shape, k), NO_ID, dtype=np.int64)

    def ring(self, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Scores that can still matter to an anchor: a full window looks no lower than its last row."""
        low = np.maximum(self.low[at], np.where(self.score[at, :, -1] > NO_SCORE, self.score[at, :, -1], self.low[at]))
        return low.min(1).astype(np.float64), self.high[at].max(1).astype(np.float64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of anchors ``at`` (rows) with rows in the order of their ids; those out of question are ``NO_SCORE``."""
        order = np.argsort(-scores, axis=1, kind="stable")
        ranked = np.take_along_axis(scores, order, axis=1)
        n = scores.shape[1]
        for w in range(self.low.shape[1]):
            start = (ranked > self.high[at, w][:, None]).sum(1)
            spot = start[:, None] + np.arange(self.k)[None, :]
            inside = spot < n
            spot = np.minimum(spot, n - 1)
            score = np.take_along_axis(ranked, spot, axis=1)
            inside &= (score >= self.low[at, w][:, None]) & (score > NO_SCORE)
            score = np.where(inside, score, NO_SCORE)
            found = np.where(inside, ids[np.take_along_axis(order, spot, axis=1)], NO_ID)
            both = np.concatenate([self.score[at, w], score], axis=1), np.concatenate([self.id[at, w], found], axis=1)
            first = np.lexsort((both[1], -both[0]), axis=-1)[:, :self.k]
            self.score[at, w], self.id[at, w] = (np.take_along_axis(x, first, axis=1) for x in both)


_FOUND_SQL = "anchor long, window int, score long, vec_id long"
_FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch], tree: Tree, ask: dict, same: bool) -> Iterator[pa.RecordBatch]:
    """The first rows of every window among the rows of this task, which come leaf by leaf."""
    best = _Best(ask["low"], ask["high"], ask["k"])
    exact = np.float64 if tree.square < 2.0**53 else np.int64  # whole numbers below 2^53 add up exactly as floats
    anchors = ask["x"].astype(exact)

    def search(leaf: int, rows: list) -> None:
        ids = np.array([NO_ID if r[0] is None else r[0] for r in rows], dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        labels = np.array([r[1] for r in rows], dtype=np.int64)[order]
        x = _unpack([r[2] for r in rows], tree.dim)[order].astype(exact)
        for s in range(0, len(anchors), BATCH_ANCHORS):
            part = slice(s, s + BATCH_ANCHORS)
            at = s + np.flatnonzero(tree.leaves(ask["x"][part].astype(np.float64), *best.ring(part))[:, leaf])
            if len(at):
                scores = (anchors[at] @ x.T).astype(np.int64)
                agree = ask["label"][at][:, None] == labels[None, :]
                scores[~agree if same else agree] = NO_SCORE
                best.add(at, scores, ids)

    waiting, leaf = [], None
    for b in batches:
        for at, *row in zip(*(b[c].to_pylist() for c in ("leaf", "vec_id", "label", "x"))):
            if waiting and (at != leaf or len(waiting) == BATCH_ROWS):
                search(leaf, waiting)
                waiting = []
            leaf = at
            waiting.append(row)
    if waiting:
        search(leaf, waiting)
    a, w, k = np.nonzero(best.score > NO_SCORE)
    for s in range(0, len(a), 1 << 16):
        t = slice(s, s + (1 << 16))
        spot = a[t], w[t], k[t]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ask["anchor"][a[t]]), pa.array(w[t].astype(np.int32)), pa.array(best.score[spot]), pa.array(best.id[spot])], schema=_FOUND)


def _known(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each window, from the ``k`` of each task."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _chosen(found: DataFrame, asked: DataFrame, positives: int) -> DataFrame:
    """The positives of each anchor, by place: of the first rows the anchor itself is left out, if it is one of them."""
    own = asked.select(F.col("anchor").alias("_a"), F.col("vec_id").alias("anchor_id"), F.col("own").alias("_own"))
    first = _ranked(found, positives + 1).join(own, F.col("anchor") == F.col("_a"))
    itself = (F.col("vec_id") == F.col("anchor_id")) & (F.col("score") == F.col("_own"))
    first = first.withColumn("_self", F.min(F.when(itself, F.col("rank"))).over(Window.partitionBy("anchor")))
    before = F.coalesce((F.col("_self") < F.col("rank")).cast("int"), F.lit(0))
    first = first.where(F.col("_self").isNull() | (F.col("_self") != F.col("rank"))).withColumn("place", F.col("rank") - before)
    return first.where(F.col("place") <= positives).select(
        "anchor", "anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))


def _windows(chosen: DataFrame, anchors: np.ndarray, positives: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative per anchor and positive; without a positive no score fits."""
    least, most = np.full((len(anchors), positives), 2**62, dtype=np.int64), np.full((len(anchors), positives), -(2**62), dtype=np.int64)
    place = {a: i for i, a in enumerate(anchors.tolist())}
    for a, p, s in zip(*(c.to_pylist() for c in chosen.select("anchor", "place", "positive_score").toArrow().columns)):
        least[place[a], p - 1], most[place[a], p - 1] = -(-low * s // 100), high * s // 100
    return least, most


def _fit(spark: SparkSession, rows: DataFrame, square: float, dim: int) -> Tree:
    sample = rows.orderBy(F.xxhash64("vec_id", "_x"), "vec_id").limit(SAMPLE_ROWS).select("_x").toArrow()
    return Tree(_matrix(sample["_x"].to_pylist(), dim), square, dim)


def _ranges(placed: DataFrame, tree: Tree) -> list[tuple[np.ndarray, np.ndarray]]:
    rows = placed.mapInArrow(lambda b: _spread(b, tree), "level int, node int, child int, least array<double>, most array<double>")
    rows = rows.select("level", "node", "child", F.posexplode(F.arrays_zip("least", "most")).alias("point", "ends"))
    rows = rows.groupBy("level", "node", "child", "point").agg(F.min("ends.least").alias("least"), F.max("ends.most").alias("most"))
    out = [(np.full((FAN**level, FAN, FAN), np.inf), np.full((FAN**level, FAN, FAN), -np.inf)) for level in range(DEPTH)]
    for r in rows.collect():  # at most FAN * FAN numbers a node, whatever the rows
        out[r.level][0][r.node, r.point, r.child], out[r.level][1][r.node, r.point, r.child] = r.least, r.most
    return out


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels.

    Scores are inner products of ``floor(256 * x)``; higher ones come first, ties by smaller vec_id. A negative scores ``low`` to
    ``high`` percent of the positive. ``is_anchor`` is a condition on vec_id. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Anchors are worked off in blocks of bounded size, each block against all rows: once for the positives and once for the windows
    that they set. A task returns its first rows of each window, so what is shuffled grows with anchors and tasks, not with rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    whole = _vectors(rows)
    whole = materialize(whole.withColumn("_anchor", F.when(F.coalesce(is_anchor, F.lit(False)), F.monotonically_increasing_id())))
    bound = whole.agg(F.max("_square").alias("square"), F.max(F.size("_x")).alias("dim"), F.count("_anchor").alias("anchors")).first()
    if not bound.anchors:
        return spark.createDataFrame([], out)
    tree = _fit(spark, whole, float(bound.square), int(bound.dim))
    placed = whole.select("vec_id", "label", "_x", "_anchor").mapInArrow(
        lambda b: _place(b, tree), "leaf int, vec_id long, label long, x binary, anchor long, own long")
    placed = placed.repartitionByRange(2 * spark.sparkContext.defaultParallelism, "leaf", F.xxhash64("vec_id", "x")).sortWithinPartitions("leaf")
    placed = materialize(placed)
    tree.ranges = _ranges(placed, tree)

    per_block = max(1, BLOCK_BYTES // (8 * max(tree.dim, 1)))
    blocks = -(-bound.anchors // per_block)
    path = f"{scratch_dir(spark)}/ebbtide/{uuid.uuid4().hex}"
    for block in range(blocks):
        mine = placed.where("anchor IS NOT NULL").where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == block)
        asked = mine.select("anchor", "label", "x").toArrow()
        if not asked.num_rows:
            continue
        ask = {c: np.array(asked[c].to_pylist(), dtype=np.int64) for c in ("anchor", "label")}
        ask["x"] = _unpack(asked["x"].to_pylist(), tree.dim).astype(np.int64)
        edge = np.full((asked.num_rows, 1), 2**62, dtype=np.int64)
        first = spark.sparkContext.broadcast((tree, ask | {"low": -edge, "high": edge, "k": positives + 1}))
        found = placed.mapInArrow(lambda b, s=first: _search(b, *s.value, True), _FOUND_SQL)
        chosen = materialize(_chosen(found, mine, positives))
        lows, highs = _windows(chosen, ask["anchor"], positives, low, high)
        second = spark.sparkContext.broadcast((tree, ask | {"low": lows, "high": highs, "k": negatives}))
        found = placed.mapInArrow(lambda b, s=second: _search(b, *s.value, False), _FOUND_SQL)
        near = _ranked(found, negatives).select(
            F.col("anchor").alias("_a"), (F.col("window") + 1).alias("_w"), "rank", F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id"))
        pairs = chosen.join(near, (F.col("anchor") == F.col("_a")) & (F.col("place") == F.col("_w")))
        pairs.select("anchor_id", _known("positive_id"), F.col("rank").cast("int").alias("rank"), _known("negative_id"),
                     "positive_score", "negative_score").write.mode("append").parquet(path)
        first.unpersist()
        second.unpersist()
    return spark.read.schema(out).parquet(path)
