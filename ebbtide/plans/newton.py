"""Second-order boosted trees: splits and leaf values from sums of gradients and Hessians per (node, feature, bin).

Features are cut into bins once, at exact percentiles, and stored as one byte each. A level of a tree is one pass: every task adds up
gradients and Hessians per node, feature and bin, the sums of all tasks are added where their feature's splits are judged, and one row
per node and feature comes back. What is shuffled is bounded by tasks, nodes, features and bins, not by rows. Rows keep the margin of
the trees so far; it is written again every ``REFRESH`` trees. Boosters that are fitted together share the bins and every pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.metrics import auc
from ebbtide.operators.quantiles import column_percentiles
from ebbtide.runtime import materialize

REFRESH = 10
LEAST_GAIN = 1e-6
BOOTSTRAP_STREAM = 1 << 32
"""Keeps the bootstrap's numbers apart from those that draw rows."""
LEAST_SHARE = 1e-6
"""The base score stays this far from 0 and 1."""


@dataclass
class Tree:
    """A full binary tree in heap order: node i has children 2i + 1 and 2i + 2. ``feature`` is -1 at leaves."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    gain: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    """Sum of the Hessians of a node's training rows."""

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n))

    def nodes(self, codes: np.ndarray, by: str) -> np.ndarray:
        """Where each row ends; ``codes`` are bins (``by`` bin) or numbers (threshold). Not-a-number goes right."""
        at = np.zeros(len(codes), dtype=np.int64)
        rows = np.arange(len(codes))
        edge = self.bin if by == "bin" else self.threshold
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            x = codes[rows[inner], f[inner]]
            stays = x <= edge[at[inner]] if by == "bin" else x < edge[at[inner]]
            at[inner] = 2 * at[inner] + np.where(stays, 1, 2)


    def paths(self) -> list[Path]:
        """One path for each leaf; several splits on one feature become one interval."""
        out = []

        def walk(at: int, sides: dict[int, tuple[float, float, float]]) -> None:
            f = int(self.feature[at])
            if f < 0:
                out.append(Path(float(self.value[at]), [(i, *s) for i, s in sides.items()]))
                return
            lo, hi, share = sides.get(f, (-np.inf, np.inf, 1.0))
            edge, total = float(self.threshold[at]), self.cover[2 * at + 1] + self.cover[2 * at + 2]
            left = float(self.cover[2 * at + 1] / total) if total else 0.5
            walk(2 * at + 1, {**sides, f: (lo, min(hi, edge), share * left)})
            walk(2 * at + 2, {**sides, f: (max(lo, edge), hi, share * (1.0 - left))})

        walk(0, {})
        return out


@dataclass
class Path:
    """A leaf's value, and for every feature on the way to it: its interval [lo, hi) and the share of the rows that keep to it.

    Not-a-number stands above all edges.
    """

    value: float
    sides: list[tuple[int, float, float, float]]

    def add(self, x: np.ndarray, out: np.ndarray) -> float:
        """Adds the leaf's part of every feature's Shapley value to ``out``; returns its part of the mean.

        With the features of a set known and the others drawn by cover, a row reaches the leaf with the product of its own
        sides (0 or 1) over the set and of the shares over the rest. The products of all sets of one size are the
        coefficients of a polynomial, so no set is listed.
        """
        d = len(self.sides)
        share = [s for *_, s in self.sides]
        if not d:
            return self.value
        keeps = [(~(x[:, f] < lo) & ((x[:, f] < hi) if hi < np.inf else True)).astype(np.float64) for f, lo, hi, _ in self.sides]
        size = [factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)]
        for i, (f, *_) in enumerate(self.sides):
            sums = np.zeros((d, len(x)))
            sums[0] = 1.0
            for n, j in enumerate(j for j in range(d) if j != i):
                for s in range(n + 1, 0, -1):
                    sums[s] = sums[s] * share[j] + sums[s - 1] * keeps[j]
                sums[0] *= share[j]
            out[:, f] += self.value * (keeps[i] - share[i]) * np.tensordot(size, sums, 1)
        return self.value * float(np.prod(share))


def score_of(g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """What a node with these sums takes off the loss, twice."""
    t = np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)
    return t * t / (h + l2)


def leaf_value(g: float, h: float, l1: float, l2: float) -> float:
    return float(-np.sign(g) * max(abs(g) - l1, 0.0) / (h + l2))


def _uniform(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """Numbers in [0, 1) from the hash of a row's key: the same rows are drawn however they are dealt."""
    z = h.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03) % 2**64)
    for shift, mix in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(mix)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def bootstrap_weights(h: np.ndarray, seed: int, tree: int, power: float) -> np.ndarray:
    """Weights of a Bayesian bootstrap, ``(-ln u) ** power`` with u from the key: exponential for a power of one, equal for zero."""
    return (-np.log(1.0 - _uniform(h, seed + BOOTSTRAP_STREAM, tree))) ** power


def _codes(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """The codes as rows of ``k`` bytes; all are equally long and none is null, so they lie one after the other."""
    codes = batch["codes"].cast(pa.binary())
    start = np.frombuffer(codes.buffers()[1], dtype=np.int32)[codes.offset] if len(codes) else 0
    return np.frombuffer(codes.buffers()[2] or b"", dtype=np.uint8, count=len(codes) * k, offset=int(start)).reshape(len(codes), k)


def _vectors(x: pa.Array, k: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), k)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _bin(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    k = len(edges)
    for b in batches:
        x = _vectors(b["x"], k)
        codes = np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
        ends = pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32) * np.int32(k))
        packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, ends, pa.py_buffer(codes.tobytes())])
        yield pa.RecordBatch.from_arrays([b["h"], b["y"], b["w"], b["v"], packed], names=["h", "y", "w", "v", "codes"])


def _advance(batches: Iterator[pa.RecordBatch], trees: list[list[Tree]], k: int) -> Iterator[pa.RecordBatch]:
    """Adds each booster's trees to its margin."""
    for b in batches:
        if b.num_rows:
            codes = _codes(b, k)
            for i, fresh in enumerate(trees):
                if fresh:
                    margin = b[f"m{i}"].to_numpy(zero_copy_only=False).copy()
                    for t in fresh:
                        margin += t.value[t.nodes(codes, "bin")]
                    b = b.set_column(b.schema.get_field_index(f"m{i}"), f"m{i}", pa.array(margin))
            yield b


@dataclass
class Growing:
    """A tree on its way: the booster's place among those fitted together, its trees since the margin was written, features to use."""

    place: int
    booster: NewtonBooster
    fresh: list[Tree]
    tree: Tree
    use: np.ndarray


def _sums(batches: Iterator[pa.RecordBatch], trees: list[Growing], level: int, k: int, bins: int, number: int) -> Iterator[pa.RecordBatch]:
    """Sums of gradients and Hessians per tree, node of this level, feature and bin."""
    first, n_nodes = 2**level - 1, 2**level
    sums = [(np.zeros((n_nodes, len(t.use), bins)), np.zeros((n_nodes, len(t.use), bins))) for t in trees]
    for b in batches:
        h, learns = b["h"].to_numpy(zero_copy_only=False), ~b["v"].to_numpy(zero_copy_only=False).astype(bool)
        rows, y_all, w_all = _codes(b, k), b["y"].to_numpy(zero_copy_only=False), b["w"].to_numpy(zero_copy_only=False)
        drawn: dict[tuple, np.ndarray] = {}
        for grown, (g_sum, h_sum) in zip(trees, sums):
            own = grown.booster
            draw = own.seed, own.row_share
            if draw not in drawn:
                drawn[draw] = learns & (_uniform(h, own.seed, number) < own.row_share) if own.row_share < 1 else learns
            here = drawn[draw]
            if not here.any():
                continue
            codes = rows[here]
            at = grown.tree.nodes(codes, "bin")
            open_ = at >= first
            codes, node = codes[open_], at[open_] - first
            y, w, margin = (x[here][open_] for x in (y_all, w_all, b[f"m{grown.place}"].to_numpy(zero_copy_only=False)))
            if own.bootstrap:
                w = w * bootstrap_weights(h[here][open_], own.seed, number, own.bootstrap)
            for t in grown.fresh:
                margin += t.value[t.nodes(codes, "bin")]
            p = _sigmoid(margin)
            g, hess = w * (p - y), w * np.maximum(p * (1 - p), 1e-16)
            for j, f in enumerate(grown.use):
                spot = node * bins + codes[:, f]
                g_sum[:, j] += np.bincount(spot, weights=g, minlength=n_nodes * bins).reshape(n_nodes, bins)
                h_sum[:, j] += np.bincount(spot, weights=hess, minlength=n_nodes * bins).reshape(n_nodes, bins)
    task = TaskContext.get().partitionId()
    for grown, (g_sum, h_sum) in zip(trees, sums):
        n = len(grown.use)
        for node in range(n_nodes):
            if h_sum[node, 0].any():
                yield pa.RecordBatch.from_pydict({
                    "place": pa.array([grown.place] * n, pa.int32()), "node": pa.array([node] * n, pa.int32()),
                    "feature": pa.array(grown.use, pa.int32()), "task": pa.array([task] * n, pa.int32()),
                    "g": [r.tobytes() for r in g_sum[node]], "h": [r.tobytes() for r in h_sum[node]]})


_BEST = pa.schema([("place", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), ("g", pa.float64()), ("h", pa.float64()),
                   ("gl", pa.float64()), ("hl", pa.float64())])


def _splits(batches: Iterator[pa.RecordBatch], boosters: Sequence[NewtonBooster]) -> Iterator[pa.RecordBatch]:
    """The best split of each (booster, node, feature), whose parts come one after the other in the order of tasks."""
    key, g, h, out = None, None, None, []

    def judge() -> None:
        if key is None:
            return
        own, gl, hl = boosters[key[0]], np.cumsum(g), np.cumsum(h)
        l1, l2, child = own.l1, own.l2, own.child
        gt, ht = float(gl[-1]), float(hl[-1])
        gain = score_of(gl, hl, l1, l2) + score_of(gt - gl, ht - hl, l1, l2) - score_of(np.float64(gt), np.float64(ht), l1, l2)
        gain = np.where((hl >= child) & (ht - hl >= child), np.round(gain, 9), -np.inf)[:-1]
        at = int(np.argmax(gain)) if len(gain) else 0
        out.append({"place": key[0], "node": key[1], "feature": key[2], "bin": at, "gain": float(gain[at]) if len(gain) else -np.inf,
                    "g": gt, "h": ht, "gl": float(gl[at]), "hl": float(hl[at])})

    for b in batches:
        for place, node, f, gb, hb in zip(*(b[c].to_pylist() for c in ("place", "node", "feature", "g", "h"))):
            gs, hs = np.frombuffer(gb), np.frombuffer(hb)
            if (place, node, f) != key:
                judge()
                key, g, h = (place, node, f), gs.copy(), hs.copy()
            else:
                g, h = g + gs, h + hs
    judge()
    if out:
        yield pa.RecordBatch.from_pylist(out, _BEST)


@dataclass
class NewtonModel:
    base: float
    trees: list[Tree]
    n_features: int
    history: list[dict] = field(default_factory=list)

    @property
    def featureImportances(self) -> list[float]:
        """Gains of each feature's splits, summing to one."""
        total = np.zeros(self.n_features)
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
        return list(total / total.sum()) if total.sum() > 0 else [1.0 / self.n_features] * self.n_features

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.nodes(x, "threshold")]
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``score``, the probability of the label."""
        model, k = self, self.n_features

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(_sigmoid(model.margins(np.concatenate(x.to_numpy()).reshape(len(x), k) if len(x) else np.zeros((0, k)))))

        return rows.withColumn("score", score(vector_to_array("features")))


    def contributions(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Shapley values of each row's features, and the mean margin: they add up to the row's margin."""
        out, mean = np.zeros((len(x), self.n_features)), self.base
        for t in self.trees:
            for p in t.paths():
                mean += p.add(x, out)
        return out, mean

    def explain(self, rows: DataFrame) -> DataFrame:
        """Adds ``contributions``, one number a feature, which with :meth:`expected` add up to the margin (log odds)."""
        model, k = self, self.n_features

        @F.pandas_udf("array<double>")
        def parts(x: pd.Series) -> pd.Series:
            got, _ = model.contributions(np.array(x.tolist(), dtype=np.float64).reshape(len(x), k))
            return pd.Series(list(got))

        return rows.withColumn("contributions", parts(vector_to_array("features")))

    def expected(self) -> float:
        return self.contributions(np.zeros((0, self.n_features)))[1]

    def mean_contributions(self, rows: DataFrame, features: Sequence[str]) -> DataFrame:
        """(feature, gain): the mean size of a feature's contributions over all rows, largest first."""
        means = self.explain(rows).agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f"m{i}") for i in range(self.n_features)])
        pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("gain")) for i, f in enumerate(features)])
        return means.select(F.inline(pairs)).orderBy(F.desc("gain"), "feature")

    def table(self, spark) -> DataFrame:
        """(tree, node, feature, bin, threshold, gain, value, cover), all nodes of the heap."""
        rows = [(n, i, *(c[i].item() for c in (t.feature, t.bin, t.threshold, t.gain, t.value, t.cover)))
                for n, t in enumerate(self.trees) for i in range(len(t.value))]
        return spark.createDataFrame(rows, "tree int, node int, feature int, bin int, threshold double, gain double, value double, cover double")

    @staticmethod
    def of(base: float, n_features: int, table: DataFrame, history: list[dict]) -> NewtonModel:
        trees = [Tree(*(t[c].to_numpy() for c in ("feature", "bin", "threshold", "gain", "value", "cover")))
                 for _, t in table.toPandas().sort_values(["tree", "node"]).groupby("tree")]
        return NewtonModel(base, trees, n_features, history)


@dataclass(frozen=True)
class NewtonBooster:
    """``fit`` takes rows with features (vector), y, w, keys that tell rows apart, and with early stopping is_valid."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.05
    l1: float = 0.1
    l2: float = 1.0
    child: float = 1.0
    row_share: float = 0.8
    column_share: float = 0.8
    bootstrap: float = 0.0
    """Power of the weights (-ln u)^power that every row gets anew for each tree; 0 leaves weights as they are."""
    bins: int = 64
    patience: int = 0
    """Trees without a better validation score after which to stop; 0 never stops. AUC, or log loss where validation has one class."""
    seed: int = 1
    keys: Sequence[str] = ("cust_id", "ref_date")

    def fit(self, rows: DataFrame) -> NewtonModel:
        return fit_together([self], rows)[0]


def fit_together(boosters: Sequence[NewtonBooster], rows: DataFrame) -> list[NewtonModel]:
    """What ``fit`` of each gives, from one binned table and one pass a level for all; they share bins and keys, and none may stop early.

    One alone may stop early.
    """
    one, n = boosters[0], len(boosters)
    if not 2 <= one.bins <= 256:
        raise ValueError("bins are kept in a byte")
    if n > 1 and (any(b.patience for b in boosters) or len({(b.bins, tuple(b.keys)) for b in boosters}) > 1):
        raise ValueError("boosters that stop early or differ in bins or keys are fitted one by one")
    valid = F.col("is_valid") if "is_valid" in rows.columns else F.lit(False)
    wide = rows.where("y IS NOT NULL").select(
        F.xxhash64(*one.keys).alias("h"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), valid.alias("v"),
        vector_to_array("features").alias("x"))
    some = wide.select(F.size("x").alias("k")).first()
    if some is None:
        raise ValueError("no labelled rows")
    k = some.k
    sums = wide.where("NOT v").agg(F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("w")).first()
    share = sums.wy / sums.w if sums.w else 0.5
    share = min(max(share, LEAST_SHARE), 1 - LEAST_SHARE)
    models = [NewtonModel(float(np.log(share / (1 - share))), [], k) for _ in boosters]
    edges = _edges(wide.where("NOT v"), k, one.bins)
    state = wide.mapInArrow(lambda b: _bin(b, edges), "h long, y double, w double, v boolean, codes binary")
    state = materialize(state.select("*", *[F.lit(m.base).alias(f"m{i}") for i, m in enumerate(models)]))
    fresh: list[list[Tree]] = [[] for _ in boosters]
    best, best_at = -np.inf, 0
    by_loss = one.patience and state.where("v").agg(F.count_distinct("y").alias("n")).first().n < 2
    live = list(range(n))
    for number in range(max(b.rounds for b in boosters)):
        live = [i for i in live if number < boosters[i].rounds]
        trees = _grow(state, boosters, {i: fresh[i] for i in live}, number, k, edges)
        live = [i for i in live if trees[i].feature[0] >= 0 or trees[i].value[0]]
        if not live:
            break
        for i in live:
            models[i].trees.append(trees[i])
            fresh[i].append(trees[i])
        if max(map(len, fresh)) == REFRESH or one.patience:
            state, fresh = materialize(_advanced(state, fresh, k)), [[] for _ in boosters]
        if one.patience:
            now = _validation(state, by_loss)
            models[0].history.append({"tree": number, "score": now})
            if now > best:
                best, best_at = now, len(models[0].trees)
            elif len(models[0].trees) - best_at >= one.patience:
                break
    if one.patience:
        models[0].trees = models[0].trees[:best_at]
    return models


def _edges(train: DataFrame, k: int, bins: int) -> list[np.ndarray]:
    probs = [i / bins for i in range(1, bins)]
    cells = {f"x{i}": F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(k)}
    found = column_percentiles(train, None, cells, probs).first()
    return [np.unique(np.array(found[f"q:x{i}"] if found and found[f"q:x{i}"] else [], dtype=np.float64)) for i in range(k)]


def _advanced(state: DataFrame, trees: list[list[Tree]], k: int) -> DataFrame:
    return state.mapInArrow(lambda b: _advance(b, trees, k), state.schema)


def _validation(state: DataFrame, by_loss: bool) -> float:
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("m0")))
    held = state.where("v").select("y", p.alias("p"))
    if by_loss:
        inside = F.greatest(F.least("p", F.lit(1 - 1e-15)), F.lit(1e-15))
        return -(held.agg(F.avg(-(F.col("y") * F.ln(inside) + (1 - F.col("y")) * F.ln(1 - inside))).alias("loss")).first().loss or 0.0)
    return auc(held).first().auc or 0.0


def _grow(state: DataFrame, boosters: Sequence[NewtonBooster], fresh: dict[int, list[Tree]], number: int, k: int,
          edges: list[np.ndarray]) -> dict[int, Tree]:
    """The next tree of every booster in ``fresh``, which holds its trees since the margins were written."""
    growing = []
    for i, before in fresh.items():
        own = boosters[i]
        rng = np.random.default_rng([own.seed, number])
        use = np.sort(rng.choice(k, max(1, int(own.column_share * k)), replace=False)) if own.column_share < 1 else np.arange(k)
        growing.append(Growing(i, own, list(before), Tree.empty(own.depth), use))
    trees = {t.place: t.tree for t in growing}
    spread, level = 1 + max((len(e) for e in edges), default=0), 0
    while growing := [t for t in growing if level < t.booster.depth]:
        sums = state.mapInArrow(
            lambda b, now=growing, lv=level: _sums(b, now, lv, k, spread, number),
            "place int, node int, feature int, task int, g binary, h binary")
        judged = sums.repartition("place", "node", "feature").sortWithinPartitions("place", "node", "feature", "task").mapInArrow(
            lambda b: _splits(b, boosters),
            "place int, node int, feature int, bin int, gain double, g double, h double, gl double, hl double")
        found: dict[tuple[int, int], object] = {}
        for r in judged.collect():  # one row per tree, node and feature
            old = found.get((r.place, r.node))
            if old is None or (-r.gain, r.feature) < (-old.gain, old.feature):
                found[r.place, r.node] = r
        split = set()
        for (place, node), r in found.items():
            at, tree, own = 2**level - 1 + node, trees[place], boosters[place]
            if level == 0:
                tree.value[at], tree.cover[at] = own.rate * leaf_value(r.g, r.h, own.l1, own.l2), r.h
            if r.gain <= LEAST_GAIN or r.bin >= len(edges[r.feature]):
                continue
            split.add(place)
            tree.feature[at], tree.bin[at], tree.threshold[at], tree.gain[at] = r.feature, r.bin, edges[r.feature][r.bin], r.gain
            for side, g, h in ((1, r.gl, r.hl), (2, r.g - r.gl, r.h - r.hl)):
                tree.value[2 * at + side], tree.cover[2 * at + side] = own.rate * leaf_value(g, h, own.l1, own.l2), h
        growing, level = [t for t in growing if t.place in split], level + 1
    return trees
