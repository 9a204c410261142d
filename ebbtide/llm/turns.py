"""Repair of conversations: the cheapest edits that make roles alternate, found by weighted interval parsing.

A repaired conversation is ``(s?(ua)+)?`` over role initials. A conversation may be far longer than one task should hold, so its rows
are dealt by range; each task parses the rows it got of a conversation, and the few parts of one conversation are combined afterwards.

Input rows have conv_id, turn, role and text; other columns are not read. Null roles and texts count as one space, null turns sort
first, null conv_ids are one conversation. Rows of one turn stand in the order of role and SHA-256 of the text, so repeated rows are
neighbours; all but the first are duplicates. A role counts by its first character; one that is not s, u or a can't be kept. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ebbtide.llm.common import column, small_batches
from ebbtide.runtime import materialize

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
"""Costs of the edits; a truncated row that is not deleted adds the last."""

BLOCK = 8
"""Rows that are parsed over all splits; longer spans are made of two neighbouring ones (see ``Chart``)."""

KNOWN = 50_000
"""Cells of short spans that a worker remembers, by the kinds of their rows; a full memory is emptied."""

# --- the grammar -------------------------------------------------------------------------------------------------------------
# A symbol (p, q) derives the edits that lead the output from state p to q: 0 nothing written, 1 after s, 2 after u, 3 after a.
# Chomsky normal form: (p, q) -> (p, r) (r, q), or the edit of one row, closed under insertions on both sides.

SYMBOLS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
_AT = {s: i for i, s in enumerate(SYMBOLS)}
RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in SYMBOLS]
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
WRITES = {0: "user", 1: "user", 2: "assistant", 3: "user"}
"""The role that an insertion or a change of role writes in a state."""

Cell = list  # per symbol the least (cost, audit), or None


def joined(x: Cell, y: Cell) -> Cell:
    """The cell of two neighbouring spans.

    Taking the least part on each side is right: audits of one span and cost are never prefixes of each other, as each has one letter
    a row and one more insertion would cost more.
    """
    out = []
    for pairs in RULES:
        best = None
        for i, j in pairs:
            a, b = x[i], y[j]
            if a is None or b is None:
                continue
            cost = a[0] + b[0]
            if best is None or cost < best[0]:
                best = cost, a[1] + b[1]
            elif cost == best[0]:
                best = min(best, (cost, a[1] + b[1]))
        out.append(best)
    return out


def _lesser(x: Cell, y: Cell) -> Cell:
    return [b if a is None else a if b is None else min(a, b) for a, b in zip(x, y)]


def _insertions() -> Cell:
    cell = [(0, "") if p == q else None for p, q in SYMBOLS]
    once = [(INSERT, "I") if NEXT.get((p, WRITES[p][0])) == q else None for p, q in SYMBOLS]
    for _ in range(4):
        cell = _lesser(cell, joined(cell, once))
    return cell


NOTHING = _insertions()


def _row(kind: str) -> Cell:
    """One row: d must go; otherwise its initial (x: none that can be kept), a capital if it is truncated."""
    cell = [(DELETE, "D") if p == q else None for p, q in SYMBOLS]
    if kind != "d":
        more = TRUNCATED if kind.isupper() else 0
        for i, (p, q) in enumerate(SYMBOLS):
            if NEXT.get((p, WRITES[p][0])) == q:
                cell[i] = min(cell[i] or (REROLE + more, "R"), (REROLE + more, "R"))
            if NEXT.get((p, kind.lower())) == q:
                cell[i] = min(cell[i] or (KEEP + more, "K"), (KEEP + more, "K"))
    return joined(joined(NOTHING, cell), NOTHING)


_known: dict[str, Cell] = {}


def parsed(kinds: str) -> Cell:
    """The cell of a span of at most ``BLOCK`` rows: all its spans by length, each over all its splits."""
    if kinds in _known:
        return _known[kinds]
    if len(_known) > KNOWN:
        _known.clear()
    for n in range(1, len(kinds) + 1):
        for start in range(len(kinds) - n + 1):
            span = kinds[start:start + n]
            if span in _known:
                continue
            cell = _row(span) if n == 1 else [None] * len(SYMBOLS)
            for cut in range(1, n):
                cell = _lesser(cell, joined(_known[span[:cut]], _known[span[cut:]]))
            _known[span] = cell
    return _known[kinds]


class Chart:
    """The cell of a growing span, as rows are added.

    A symbol derives itself through any state in between, so all splits of a span give one cell. Up to ``BLOCK`` rows every split is
    tried; above that spans of equal length are combined in pairs, and the chart holds one cell for each power of two.
    """

    def __init__(self) -> None:
        self.waiting, self.cells = [], []

    def add(self, kind: str) -> None:
        self.waiting.append(kind)
        if len(self.waiting) == BLOCK:
            self._push(0, parsed("".join(self.waiting)))
            self.waiting = []

    def _push(self, level: int, cell: Cell) -> None:
        while self.cells and self.cells[-1][0] == level:
            cell, level = joined(self.cells.pop()[1], cell), level + 1
        self.cells.append((level, cell))

    def whole(self) -> Cell:
        cell = parsed("".join(self.waiting)) if self.waiting else None
        for _, before in reversed(self.cells):
            cell = before if cell is None else joined(before, cell)
        return NOTHING if cell is None else cell


def cheapest(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) that leaves nothing or ends with an assistant."""
    return min(cell[_AT[0, 0]], cell[_AT[0, 3]])


# --- rows and parts -------------------------------------------------------------------------------------------------------------

ORDER = ["conv_id", "turn", "role", "_digest"]
PART = ("_part int, _turns long, _min long, _max long, _blank long, _duplicate long, _truncated long, _illegal long, "
        "_first string, _last string, _cost array<long>, _audit array<string>")
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _rows(turns: DataFrame) -> DataFrame:
    """Rows with their order and first fault but for duplicates, which need all rows."""
    rows = turns.select(
        column(turns, "conv_id").alias("conv_id"), column(turns, "turn").cast("long").alias("turn"),
        F.coalesce(column(turns, "role"), F.lit(" ")).alias("role"), F.coalesce(column(turns, "text"), F.lit(" ")).alias("text"))
    return rows.withColumn("_digest", F.unhex(F.sha2("text", 256)))


def _marked(rows: DataFrame) -> DataFrame:
    """One row per (conversation, turn, role, text) with its count: copies, however many, are collapsed where they are read.

    ``_again`` marks a role and text that an earlier turn had.
    """
    end = F.rtrim("text", F.lit(BLANK))
    seen = rows.select(*ORDER, (F.length(end) == 0).alias("_empty"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("_open"))
    seen = seen.groupBy(*ORDER, "_empty", "_open").agg(F.count("*").alias("_n"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = seen.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_digest").alias("_d")).agg(F.min(place).alias("_place"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_digest") == F.col("_d"))
    return seen.join(first, same).select(*seen.columns, (~place.eqNullSafe(F.col("_place"))).alias("_again"))


def _parts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of this range: its counts and the cell of its rows here."""
    done: list[dict] = []
    at = object()
    chart = part = last_turn = None

    def close() -> None:
        if part is not None:
            cell = chart.whole()
            part["_cost"] = [None if c is None else c[0] for c in cell]
            part["_audit"] = [None if c is None else c[1] for c in cell]
            done.append(part)

    for batch in batches:
        for conv, turn, role, empty, open_, n, again in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "_empty", "_open", "_n", "_again"))):
            initial = role[:1]
            if part is None or conv != at:
                close()
                at, chart, last_turn = conv, Chart(), None
                part = {"conv_id": conv, "_part": TaskContext.get().partitionId(), "_turns": 0, "_min": turn, "_max": turn, "_blank": 0,
                        "_duplicate": 0, "_truncated": 0, "_illegal": 0, "_first": initial, "_last": None}
            if part["_last"] is not None:
                part["_illegal"] += part["_last"] + initial not in ("su", "ua", "au")
            part["_illegal"] += n - 1
            part["_last"] = initial
            if turn is not None:
                part["_turns"] += turn != last_turn
                part["_min"] = turn if part["_min"] is None else part["_min"]
                part["_max"] = last_turn = turn
            if empty:
                part["_blank"] += n
            else:
                part["_duplicate"] += n - (not again)
                part["_truncated"] += open_ and not again
            if empty or again:
                chart.add("d")
            else:
                kind = initial if initial and initial in "sua" else "x"
                chart.add(kind.upper() if open_ else kind)
            for _ in range(n - 1):
                chart.add("d")
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


class _Conversation:
    """Parts in order, then rows in order, as they stream by."""

    def __init__(self, conv: object) -> None:
        self.conv, self.part, self.cell, self.sum, self.audit = conv, None, NOTHING, dict.fromkeys(COUNTS, 0), None

    def add(self, p: dict) -> None:
        cell = [None if c is None else (c, a) for c, a in zip(p["_cost"], p["_audit"])]
        if self.part is None:
            self.cell, self.turns, self.min, self.max = cell, p["_turns"], p["_min"], p["_max"]
        else:
            self.cell = joined(self.cell, cell)
            self.sum["illegal"] += self.part["_last"] + p["_first"] not in ("su", "ua", "au")
            self.turns += p["_turns"] - (self.max is not None and self.max == p["_min"])
            self.min = p["_min"] if self.min is None else self.min
            self.max = p["_max"] if p["_max"] is not None else self.max
        for c in ("blank", "duplicate", "truncated", "illegal"):
            self.sum[c] += p["_" + c]
        self.part = p

    def verdict(self) -> None:
        if self.audit is None:
            self.sum["cost"], self.audit = cheapest(self.cell) if self.part else (0, "")
            if self.part and self.min is not None:
                self.sum["gaps"] = self.max - self.min + 1 - self.turns
            self.at, self.state, self.written = 0, 0, 0

    def _insert(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = WRITES[self.state]
            self.state, self.at, self.written = NEXT[self.state, role[0]], self.at + 1, self.written + 1
            yield self.written, None, role, "", "I"

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        """What the repaired conversation has up to this row: (position, turn, role, text, edit)."""
        self.verdict()
        yield from self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = WRITES[self.state] if edit == "R" else role
            self.state, self.written = NEXT[self.state, role[0]], self.written + 1
            yield self.written, turn, role, text, edit

    def end(self) -> Iterator[tuple]:
        self.verdict()
        yield from self._insert()


def _apply(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows_out: bool) -> Iterator[pa.RecordBatch]:
    """Parts and rows of whole conversations in order: either a verdict each, its digest streamed, or the repaired rows."""
    talk, digest, done = None, None, []

    def put(found: Iterator[tuple]) -> None:
        for place, turn, role, text, edit in found:
            if rows_out:
                done.append({"conv_id": talk.conv, "position": place, "turn": turn, "role": role, "text": text, "edit": edit})
            else:
                digest.update((f"\n{role}:{text}" if place > 1 else f"{role}:{text}").encode())

    def close() -> None:
        if talk is not None:
            put(talk.end())
            if not rows_out:
                done.append({"conv_id": talk.conv, **talk.sum, "audit": talk.audit, "repaired_sha256": digest.hexdigest()})

    for batch in batches:
        for r in batch.to_pylist():
            if talk is None or r["conv_id"] != talk.conv:
                close()
                talk, digest = _Conversation(r["conv_id"]), hashlib.sha256()
            if r["_kind"] == 1:
                talk.add(r)
            elif r["_kind"] == 2:
                put(talk.row(r["turn"], r["role"], r["text"]))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def _stream(turns: DataFrame, out: str, rows_out: bool, among: DataFrame | None = None) -> DataFrame:
    small_batches(turns.sparkSession)
    rows = _rows(turns)
    key = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType)])
    part = T.StructType([*key, *T._parse_datatype_string(PART)])
    parts_schema = to_arrow_schema(part)
    marked = materialize(_marked(rows))
    order = [F.asc_nulls_first(c) for c in ORDER]
    parts = marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _parts(b, parts_schema), part)
    both = parts.withColumn("_kind", F.lit(1)).unionByName(rows.withColumn("_kind", F.lit(2)), allowMissingColumns=True)
    if among is not None:
        ids = among.select(column(among, "conv_id").alias("conv_id")).distinct().withColumn("_kind", F.lit(0))
        both = both.unionByName(ids, allowMissingColumns=True)
    final = T.StructType([*key, *T._parse_datatype_string(out)])
    final_schema = to_arrow_schema(final)
    sort = [F.asc_nulls_first(c) for c in ("conv_id", "_kind", "_part", "turn", "role", "_digest")]
    return both.repartition("conv_id").sortWithinPartitions(*sort).mapInArrow(lambda b: _apply(b, final_schema, rows_out), final)


def repair(turns: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Per conversation its faults, the least cost, the edits, and the digest of what they leave.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256. Of equally cheap edits the audit that is
    least in ASCII counts. ``among`` adds conversations that have no rows in ``turns``: zeros, an empty audit, the empty digest. Rows of
    one conversation stream through one task for the digest, which has no parts; memory holds its audit, one letter an edit.
    """
    return _stream(turns, ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string", False, among)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 1), turn (null: inserted), role, text, edit (K, R or I)."""
    return _stream(turns, "position long, turn long, role string, text string, edit string", True)
