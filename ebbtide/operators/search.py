"""Search of blend weights by branch and bound: exact, with most candidates never ranked.

Passes over the rows of a group (a month, or the whole table):

1. every candidate's scores are counted in bins, once per task, so nothing the size of rows times candidates is ever built. The counts
   bound AUC and the hits of the top share from both sides, whatever the order inside a bin, and with them the composite. Candidates
   whose upper bound misses the best lower bound are out;
2. those left are counted again in more bins, twice, as long as any are left to rule out;
3. those left then are ranked exactly (``ranked``): tasks send the distinct scores of ranges with their counts, never rows, and only rows
   of the few scores around the border of the top share are looked at one by one.

The rows are dealt to tasks by group once and written, so that no pass shuffles them. The bins of a candidate are cut at places of its
scores on a bounded sample of the group. They only decide how tight the bounds are; the result is that of the full search at any size.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.operators import metrics
from ebbtide.runtime import materialize

ROUNDS = ((256, 2048), (4096, 16384), (16384, 65536))
"""Bins, and rows of a group whose scores place their cuts (those with the least hashes), of each pass over bins."""

LOT = 20_000
"""Candidates of a group that one job counts in the bins of the first round; more are counted in several, and fewer where bins are more."""

HELD = 1 << 16
"""Rows of a group that a task counts at once."""

PER_TASK = 1 << 20
"""Rows that are dealt to one task."""

PER_RANGE = 1 << 19
"""Rows of a group, about, whose scores by one candidate are put in order by one task."""

SEGMENTS = 256
"""Runs of neighbouring scores that such a range is told apart in: the more, the fewer rows lie in the one across the border."""

SLACK = 1e-8
"""Bounds within this of each other count as equal: composites are compared in nine digits."""

Grids = Mapping[str, Sequence[tuple[int, Sequence[float]]]]
"""Per group its candidates: number and weights."""


def blended(columns: Sequence[np.ndarray], weights: Sequence[float]) -> np.ndarray:
    """A blend in the order of additions that the expressions have, so both give the same bits."""
    out = weights[0] * columns[0]
    for w, x in zip(weights[1:], columns[1:]):
        out = out + w * x
    return out


def _places(n: int, bins: int, share: float, flip: bool) -> np.ndarray:
    """Places in a sorted sample to cut at: even ones, and all where the border of the top share is likely to lie."""
    even = (np.arange(1, bins + 1) * n) // (bins + 1)
    reach = 3 * int(np.ceil(np.sqrt(share * (1 - share) * n)))
    border = [int(share * n)] * flip + [int((1 - share) * n)]
    return np.unique(np.concatenate([even, *[np.arange(max(0, b - reach), min(n, b + reach)) for b in border]]).astype(np.int64))


def _apart(cuts: np.ndarray) -> np.ndarray:
    """Sorted cuts in which a repeated value is cut off on its other side too, so that the bin between holds that value alone."""
    again = np.concatenate([[False], cuts[1:] == cuts[:-1]]) & np.isfinite(cuts)
    return np.where(again, np.nextafter(cuts, np.inf), cuts)


def _single(cuts: np.ndarray) -> np.ndarray:
    """The bins that hold one value alone."""
    inside = cuts[1:] == np.nextafter(cuts[:-1], np.inf)
    return np.concatenate([[False], inside, [False]])


def _blocks(batches: Iterator[pa.RecordBatch], streams: Sequence[str], grids: Grids) -> Iterator[tuple[str, np.ndarray, list[np.ndarray]]]:
    """Group, labels and streams of at least ``HELD`` rows of a group that has candidates, and of the rest at the end.

    Rows may come packed, as ``_packed`` leaves them.
    """
    held: dict[str, list[tuple[np.ndarray, list[np.ndarray]]]] = {}

    def block(g: str) -> tuple[str, np.ndarray, list[np.ndarray]]:
        parts = held.pop(g)
        return g, np.concatenate([y for y, _ in parts]), [np.concatenate(x) for x in zip(*(columns for _, columns in parts))]

    for batch in batches:
        if pa.types.is_binary(batch["_y"].type):
            for g, label, *columns in zip(*(batch[x] for x in ("_group", "_y", *streams))):
                if grids.get(g.as_py()):
                    yield g.as_py(), np.frombuffer(label.as_buffer(), np.int64), [np.frombuffer(c.as_buffer(), np.float64) for c in columns]
            continue
        groups = batch["_group"].dictionary_encode()
        codes = groups.indices.to_numpy(zero_copy_only=False)
        label = batch["_y"].to_numpy(zero_copy_only=False).astype(np.int64)
        columns = [batch[s].to_numpy(zero_copy_only=False) for s in streams]
        for code, g in enumerate(groups.dictionary.to_pylist()):
            if not grids.get(g):
                continue
            here = codes == code
            held.setdefault(g, []).append((label[here], [c[here] for c in columns]))
            if sum(len(y) for y, _ in held[g]) >= HELD:
                yield block(g)
    for g in list(held):
        yield block(g)


def _packed(batches: Iterator[pa.RecordBatch], streams: Sequence[str], groups: Mapping[str, int]) -> Iterator[pa.RecordBatch]:
    """Labels and streams of ``HELD`` rows or more in a row: every pass reads them, and most of its time would be handing over single rows."""
    for g, *columns in ((g, label, *x) for g, label, x in _blocks(batches, streams, groups)):
        yield pa.RecordBatch.from_pydict({"_group": [g], **{name: [x.tobytes()] for name, x in zip(("_y", *streams), columns)}})


def _sorted(scores: np.ndarray) -> np.ndarray:
    """Scores in order, without those that are no number (an infinite stream of weight 0)."""
    scores = np.sort(scores)
    return scores[:len(scores) - np.count_nonzero(np.isnan(scores))]


def _count(batches: Iterator[pa.RecordBatch], streams: Sequence[str], grids: Grids, samples: Mapping[str, list[np.ndarray]],
           bins: int, share: float, flip: bool) -> Iterator[pa.RecordBatch]:
    """Rows and positives per bin of every candidate, for the groups this task has rows of."""
    cuts: dict[str, np.ndarray] = {}
    counts: dict[str, np.ndarray] = {}
    for g, label, columns in _blocks(batches, streams, grids):
        # Sorting scores and looking up the cuts is cheaper than the other way round.
        if g not in counts:
            places = _places(len(samples[g][0]), bins, share, flip)
            cuts[g] = np.stack([_apart(np.sort(blended(samples[g], w))[places]) for _, w in grids[g]])
            counts[g] = np.zeros((len(grids[g]), 2 * (len(places) + 1)), dtype=np.int64)
        bins_ = counts[g].shape[1] // 2
        for part, at in ((label == 0, 0), (label == 1, bins_)):
            mine = [c[part] for c in columns]
            for i, (_, w) in enumerate(grids[g]):
                scores = _sorted(blended(mine, w))
                below = np.searchsorted(scores, cuts[g][i], side="left")
                counts[g][i, at:at + bins_] += np.diff(below, prepend=0, append=len(scores))
    for g, table in counts.items():
        names = [c for c, _ in grids[g]]
        for s in range(0, len(table), 64):
            part = slice(s, s + 64)
            yield pa.RecordBatch.from_pydict(
                {"_group": [g] * len(names[part]), "candidate": pa.array(names[part], pa.int32()), "counts": [r.tobytes() for r in table[part]],
                 "single": [np.packbits(_single(c)).tobytes() for c in cuts[g][part]]})


def bounds(counts: np.ndarray, share: float, flip: bool, single: np.ndarray | None = None) -> tuple[float, float] | None:
    """Least and largest composite that the counts per bin allow, bins from low to high scores; None with one class only.

    The rows of a ``single`` bin are tied: their pairs count half, and only which of them are in the top share is open.
    """
    neg, pos = counts.reshape(2, -1)
    n_neg, n_pos = int(neg.sum()), int(pos.sum())
    if not n_neg or not n_pos:
        return None
    n = n_neg + n_pos
    top = max(1, int(np.rint(share * n)))
    above = n_pos - np.cumsum(pos)
    inside = neg * pos
    tied = float(inside[single].sum()) if single is not None else 0.0
    least = float((neg * above).sum()) + tied / 2
    auc = least / (n_pos * n_neg), (least + float(inside.sum()) - tied) / (n_pos * n_neg)

    def hits(neg: np.ndarray, pos: np.ndarray) -> tuple[int, int]:
        """Of the first ``top`` rows, bins given best first."""
        upto = np.cumsum(neg + pos)
        at = int(np.searchsorted(upto, top))
        full = int(pos[:at].sum())
        need = top - (int(upto[at - 1]) if at else 0)
        return full + max(0, need - int(neg[at])), full + min(need, int(pos[at]))

    def composite(auc: float, hits: int) -> float:
        wg, wr, wl = metrics.WEIGHTS
        return ((2 * auc - 1) / (2 * metrics.BASE_AUC - 1) * wg + hits / n_pos / metrics.BASE_RECALL * wr
                + hits / top / (n_pos / n) / metrics.BASE_LIFT * wl)

    ends = []
    if not flip or auc[1] >= 0.5:
        low, high = hits(neg[::-1], pos[::-1])
        ends.append((composite(max(auc[0], 0.5) if flip else auc[0], low), composite(auc[1], high)))
    if flip and auc[0] < 0.5:
        low, high = hits(neg, pos)
        ends.append((composite(1 - min(auc[1], 0.5), low), composite(1 - auc[0], high)))
    return min(e[0] for e in ends), max(e[1] for e in ends)


def _bound(batches: Iterator[pa.RecordBatch], share: float, flip: bool) -> Iterator[pa.RecordBatch]:
    total: dict[tuple, np.ndarray] = {}
    single: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for g, c, packed, alone in zip(*(batch[x].to_pylist() for x in ("_group", "candidate", "counts", "single"))):
            counts = np.frombuffer(packed, dtype=np.int64)
            total[g, c] = total[g, c] + counts if (g, c) in total else counts
            single[g, c] = np.unpackbits(np.frombuffer(alone, np.uint8), count=len(counts) // 2).astype(bool)
    found = [(g, c, bounds(counts, share, flip, single[g, c])) for (g, c), counts in total.items()]
    if found:
        yield pa.RecordBatch.from_pydict({
            "_group": [g for g, *_ in found], "candidate": pa.array([c for _, c, _ in found], pa.int32()),
            "low": pa.array([b and b[0] for *_, b in found], pa.float64()), "high": pa.array([b and b[1] for *_, b in found], pa.float64())})


def sample_scores(rows: DataFrame, streams: Sequence[str], n: int, sizes: Mapping[str, int] | None = None) -> dict[str, list[np.ndarray]]:
    """``n`` rows drawn from each group (all, if it has fewer), as columns; ``sizes`` are the rows of each group, counted if not given.

    A group's rows are drawn one by one, where they lie: nothing is shuffled or sorted but what comes back.
    """
    if sizes is None:
        sizes = {r._group: r.n for r in rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    enough = n + 8 * n ** 0.5 + 16  # fewer than n are drawn about once in 10^15
    shares = F.create_map(*[F.lit(x) for g, size in sizes.items() for x in (g, min(1.0, enough / max(size, 1)))])
    some = rows.select("_group", F.rand(17).alias("_place"), *streams).where(F.col("_place") < F.element_at(shares, F.col("_group")))
    table = some.toArrow()
    groups = table["_group"].to_numpy()
    order = np.argsort(table["_place"].to_numpy())
    return {g: [table[s].to_numpy()[order][groups[order] == g][:n] for s in streams] for g in set(groups)}


def candidate_bounds(rows: DataFrame, streams: Sequence[str], grids: Grids, samples: Mapping[str, list[np.ndarray]], bins: int,
                     share: float = metrics.TOP_SHARE, flip: bool = True) -> DataFrame:
    """(_group, candidate, low, high): bounds of each candidate's composite; ``rows`` is a written table of _group, _y and the streams, or
    such rows packed.

    Rows are counted where they lie. What a task returns is bounded by candidates and bins of the groups it has rows of; where ``prepared``
    dealt the rows, these are few.
    """
    names, sent = list(streams), rows.sparkSession.sparkContext.broadcast((dict(grids), dict(samples)))
    counted = _of(rows, grids, names).mapInArrow(lambda b: _count(b, names, *sent.value, bins, share, flip), "_group string, candidate int, counts binary, single binary")
    merged = counted.repartition("_group", "candidate")
    return merged.mapInArrow(lambda b: _bound(b, share, flip), "_group string, candidate int, low double, high double")


def survivors(bounded: DataFrame, top: int = 1, known: Mapping[str, float] | None = None) -> dict[str, list[int]]:
    """Per group the candidates that may be among its best ``top`` and may exceed the composite ``known`` of another, if there is any.

    Where no composite exists, the first one stands for all.
    """
    out: dict[str, list[int]] = {}
    table: dict[str, list] = {}
    for r in bounded.collect():  # one row a group and candidate
        table.setdefault(r._group, []).append((r.candidate, r.low, r.high))
    for g, found in table.items():
        lows = sorted((low for _, low, _ in found if low is not None), reverse=True)
        if not lows:
            out[g] = sorted(c for c, *_ in found)[:top]
            continue
        least = max(lows[min(top, len(lows)) - 1], (known or {}).get(g, -np.inf)) - SLACK
        out[g] = sorted(c for c, _, high in found if high is not None and high >= least)
    return out


class Prepared(NamedTuple):
    """Rows to search, as ``prepared`` wrote them, with what all searches of them need; ``blocks`` are the same rows packed, without ids."""

    rows: DataFrame
    blocks: DataFrame
    streams: list[str]
    ids: list[str]
    groups: list[str]
    sizes: dict[str, int]
    samples: dict[str, list[np.ndarray]]


def prepared(rows: DataFrame, streams: Sequence[str], ids: Sequence[str]) -> Prepared:
    """Write the rows with a label and all streams once, dealt by range over group and hash.

    So a group of any share is spread, a task has few groups, and no pass of a search shuffles rows. ``groups`` has all groups of the rows.
    """
    slim = materialize(rows.select(*ids, "_group", "_y", *[F.col(s).cast("double").alias(s) for s in streams]))
    groups = [r._group for r in slim.select("_group").distinct().collect()]
    whole = metrics.scored(slim, "_y", *streams).where(F.col("_group").isNotNull())
    sizes = {r._group: r.n for r in whole.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).collect()}
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes.values()) // PER_TASK))
    # The ids are in the hash, so rows that agree in all streams are spread too.
    dealt = materialize(whole.repartitionByRange(tasks, "_group", F.xxhash64(*ids, *streams)))
    names = list(streams)
    fields = ", ".join(f"`{c}` binary" for c in ("_y", *names))
    blocks = materialize(_of(dealt, sizes, names).mapInArrow(lambda b: _packed(b, names, sizes), f"_group string, {fields}"))
    return Prepared(dealt, blocks, names, list(ids), groups, sizes, sample_scores(dealt, streams, max(n for _, n in ROUNDS), sizes))


def search(rows: DataFrame, streams: Sequence[str], grids: Mapping[str, Sequence[Sequence[float]]], ids: Sequence[str], top: int = 1,
           share: float = metrics.TOP_SHARE, flip: bool = True) -> DataFrame:
    """The best ``top`` candidates per group with their metrics: _group, candidate (place in the group's grid), n ... flipped, place.

    ``rows`` has _group, _y, the ids and the streams; rows without a label or any stream are left out, as are groups without a grid. Equal
    composites (nine digits) go to the candidate that comes first. Groups are as few as months; their candidates go to the tasks whole.
    """
    return search_prepared(prepared(rows, streams, ids), {g: dict(enumerate(grid)) for g, grid in grids.items()}, top, share, flip)


def search_prepared(ready: Prepared, grids: Mapping[str, Mapping[int, Sequence[float]]], top: int = 1, share: float = metrics.TOP_SHARE,
                    flip: bool = True, known: Mapping[str, float] | None = None) -> DataFrame:
    """``search`` over prepared rows, with the numbers of the candidates given.

    ``known`` has, for some groups, the composite of a weight vector ranked before: candidates that don't exceed it (in nine digits) are
    left out, and so is a group without any other. Equal weight vectors of a group are looked at once.
    """
    known = known or {}
    equal = {g: _equal(grid) for g, grid in grids.items() if g in ready.sizes}
    left = {g: {numbers[0]: list(w) for w, numbers in some.items()} for g, some in equal.items()}
    for bins, n in ROUNDS:
        open_ = {g: some for g, some in left.items() if len(some) > top or (some and g in known)}
        if not open_:
            break
        first = {g: [x[:n] for x in ready.samples[g]] for g in open_}
        parts = [candidate_bounds(ready.blocks, ready.streams, lot, first, bins, share, flip) for lot in _lots(open_, max(1, LOT * ROUNDS[0][0] // bins))]
        kept = survivors(reduce(DataFrame.unionByName, parts), top, known)
        left |= {g: {c: some[c] for c in kept.get(g, [])} for g, some in open_.items()}
    scored = ranked(ready, left, share, flip)
    spread = [(g, numbers[0], c) for g, some in equal.items() for numbers in some.values() for c in numbers[1:top]]
    if spread:
        others = scored.sparkSession.createDataFrame(spread, "_group string, candidate int, _other int")
        copies = scored.join(F.broadcast(others), ["_group", "candidate"]).withColumn("candidate", F.col("_other"))
        scored = scored.unionByName(copies.drop("_other"))
    if known:
        least = F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col("_group"))
        scored = scored.where(least.isNull() | (F.round("composite", 9) > F.round(least, 9)))
    return best(scored, top)


def _equal(grid: Mapping[int, Sequence[float]]) -> dict[tuple[float, ...], list[int]]:
    """The weight vectors of a grid, each with the numbers of the candidates that have it."""
    out: dict[tuple[float, ...], list[int]] = {}
    for c, w in sorted(grid.items()):
        out.setdefault(tuple(map(float, w)), []).append(c)
    return out


def _of(rows: DataFrame, grids: Mapping[str, object], streams: Sequence[str]) -> DataFrame:
    """What a pass reads: label and streams of the groups that have candidates."""
    return rows.where(F.col("_group").isin(*[g for g, some in grids.items() if some])).select("_group", "_y", *streams)


def _lots(left: Mapping[str, dict[int, list[float]]], size: int) -> list[Grids]:
    """Candidates in lots of at most ``size`` a group, the most that a task counts at once."""
    most = max(map(len, left.values()), default=0)
    pairs = {g: list(some.items()) for g, some in left.items()}
    return [{g: some[i:i + size] for g, some in pairs.items()} for i in range(0, max(most, 1), size)]


def _runs(order: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of scores in the given order, and the place where each begins."""
    scores = scores[order]
    begin = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))
    return scores[begin], begin


def _tally(batches: Iterator[pa.RecordBatch], streams: Sequence[str], grids: Grids, samples: Mapping[str, list[np.ndarray]],
           ranges: Mapping[str, int]) -> Iterator[pa.RecordBatch]:
    """Distinct scores of every candidate with their rows and positives, cut in ranges at even places of its scores on the sample."""
    cuts: dict[tuple[str, int], np.ndarray] = {}
    for g, label, columns in _blocks(batches, streams, grids):
        for c, w in grids[g]:
            if (g, c) not in cuts:
                some = np.sort(blended(samples[g], w))
                cuts[g, c] = some[np.arange(1, ranges[g]) * len(some) // ranges[g]]
            scores = blended(columns, w)
            order = np.argsort(scores)
            order = order[:len(order) - np.count_nonzero(np.isnan(scores))]
            if not len(order):
                continue
            values, begin = _runs(order, scores)
            n, pos = np.diff(begin, append=len(order)), np.add.reduceat(label[order], begin)
            ends = np.concatenate([[0], np.searchsorted(values, cuts[g, c]), [len(values)]])
            here = [(r, slice(ends[r], ends[r + 1])) for r in range(len(ends) - 1) if ends[r] < ends[r + 1]]
            yield pa.RecordBatch.from_pydict({
                "_group": [g] * len(here), "candidate": pa.array([c] * len(here), pa.int32()), "_range": pa.array([r for r, _ in here], pa.int32()),
                **{name: [x[at].tobytes() for _, at in here] for name, x in (("scores", values), ("n", n.astype(np.int32)), ("pos", pos.astype(np.int32)))}})


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range's distinct scores from high to low, in ``SEGMENTS`` runs: ends, rows, positives, and twice the pairs won within the run."""
    held: dict[tuple, list[tuple[np.ndarray, ...]]] = {}
    for batch in batches:
        for g, c, r, *packed in zip(*(batch[x].to_pylist() for x in ("_group", "candidate", "_range", "scores", "n", "pos"))):
            held.setdefault((g, c, r), []).append(tuple(np.frombuffer(x, t) for x, t in zip(packed, (np.float64, np.int32, np.int32))))
    for g, c, r in list(held):
        scores, n, pos = (np.concatenate(x) for x in zip(*held.pop((g, c, r))))
        order = np.argsort(-scores)
        values, begin = _runs(order, scores)
        n, pos = (np.add.reduceat(x[order].astype(np.int64), begin) for x in (n, pos))
        ends = np.unique(np.linspace(0, len(values), SEGMENTS + 1).astype(np.int64))
        start, stop = ends[:-1], ends[1:] - 1
        before = np.cumsum(pos) - pos
        before -= np.repeat(before[start], np.diff(ends))
        won = (n - pos) * (2 * before + pos)
        yield pa.RecordBatch.from_pydict({
            "_group": [g] * len(start), "candidate": pa.array([c] * len(start), pa.int32()), "high": values[start], "low": values[stop],
            **{name: np.add.reduceat(x, start) for name, x in (("n", n), ("pos", pos), ("won", won))}})


def ranked(ready: Prepared, left: Mapping[str, Mapping[int, Sequence[float]]], share: float = metrics.TOP_SHARE, flip: bool = True) -> DataFrame:
    """Exact metrics of each group's candidates, as ``metrics.ranking_metrics`` of a copy of the rows per candidate would give them.

    No copies are made: a task counts its rows per distinct score of each candidate and sends these by ranges of the score; a range of a
    candidate is put in order by one task, whose totals per run of scores are added up. One run lies across the border of the top share:
    its rows are taken in the order of score and ids.
    """
    rows, streams, ids, samples = ready.rows, ready.streams, ready.ids, ready.samples
    spark, keys = rows.sparkSession, ["_group", "candidate"]
    grids = {g: list(some.items()) for g, some in left.items() if some}
    ranges = {g: max(1, min(-(-ready.sizes[g] // PER_RANGE), len(samples[g][0]))) for g in grids}
    sent = spark.sparkContext.broadcast((grids, {g: samples[g] for g in grids}, ranges))
    tallied = _of(ready.blocks, grids, streams).mapInArrow(
        lambda b: _tally(b, streams, *sent.value), "_group string, candidate int, _range int, scores binary, n binary, pos binary")
    entries = sum(ready.sizes[g] * len(some) for g, some in grids.items())
    parts = max(spark.sparkContext.defaultParallelism, -(-entries // PER_TASK))
    runs = tallied.repartition(parts, *keys, "_range").mapInArrow(
        _ordered, "_group string, candidate int, high double, low double, n long, pos long, won long")
    # At most SEGMENTS rows a range reach this window.
    upto = Window.partitionBy(*keys).orderBy(F.desc("high")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = runs.withColumns({f"{c}_before": F.sum(c).over(upto) - F.col(c) for c in ("n", "pos")}
                           | {f"{c}_total": F.sum(c).over(Window.partitionBy(*keys)) for c in ("n", "pos")})
    pairs = F.sum(F.col("won") + 2 * (F.col("n") - F.col("pos")) * F.col("pos_before")) / F.lit(2.0)
    groups = materialize(metrics.border(run, keys, ["high", "low"], pairs, share, flip=flip))
    mixed = (F.col("_tied_pos") > 0) & (F.col("_tied_pos") < F.col("_tied_n"))
    at = groups.where(mixed).select(*keys, "high", "low", "_need", "flipped").collect()  # one row a candidate
    ties = _between(rows, streams, [(r._group, r.candidate, left[r._group][r.candidate], r.high, r.low, r._need, r.flipped) for r in at])
    order = [F.when(F.col("flipped"), F.col("p")).otherwise(-F.col("p")) + F.lit(0.0), *[F.col(c) for c in ids]]
    # One row a candidate, written: who reads the result twice does not place the rows twice.
    taken = materialize(metrics.first_rows(ties.select(*keys, *ids, "_y", "_need", "flipped", "p"), keys, order, "_y"))
    return metrics.measured(groups, taken, keys)


def _between(rows: DataFrame, streams: Sequence[str], at: Sequence[tuple]) -> DataFrame:
    """The rows that a candidate of their group scores from ``low`` to ``high``, with the blended score."""
    table = rows.sparkSession.createDataFrame(
        at, "_of string, candidate int, w array<double>, high double, low double, _need long, flipped boolean")
    spread = rows.join(F.broadcast(table), F.col("_group") == F.col("_of")).drop("_of")
    return spread.withColumn("p", _blend(streams)).where(F.col("p").between(F.col("low"), F.col("high")))


def _blend(streams: Sequence[str]) -> Column:
    p = F.element_at("w", 1) * F.col(streams[0])
    for i, s in enumerate(streams[1:], 2):
        p = p + F.element_at("w", i) * F.col(s)
    return p


def best(scored: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows of each group by composite; there are no more rows than surviving candidates."""
    order = Window.partitionBy("_group").orderBy(F.desc_nulls_last(F.round("composite", 9)), "candidate")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
