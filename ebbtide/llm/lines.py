"""Line dedup by pairwise alignment: common blocks of two documents are deleted from the later one.

Documents that overlap are found through rare runs of lines. Each line that is not blank gives two keys: the shortest runs of
neighbouring lines that start with it, and that end with it, and have ``BLOCK_CHARS`` characters. Each such line of a block of two documents,
however short its lines are, lies in a key within the block, so every pair with a block has a key in common. Keys of at most
``RARE_DOCS`` documents pair all of them. A key of more leads its documents to the first that has it and to the first in which it stands
once, so n documents are at most 2 n pairs. A pair found through several keys is one pair. Left out are pairs that share frequent keys only:
a line of theirs can stay where the hub of its key has the key in another order than the rest of what it shares with the later
document, and blank lines at a block's ends. With ``rare_docs`` above all documents no pair is left out.

The two lists of line hashes of a pair are aligned by patience diff: lines found once in both anchor the alignment, in the longest order
that both share, and the gaps between anchors are aligned the same way; a gap without such lines is aligned by the first, second, and further
occurrence of its lines. Runs of aligned lines with at least ``BLOCK_CHARS`` characters are blocks, and go from the later document.

Only hashes travel until texts are cut: keys, pairs, and two arrays for each pair. Rows of a frequent key and pairs of one hub are dealt over
``SALTS`` parts, and what they meet is sent to the parts that have them. The first document of a line never loses it, because no earlier one has
it; all alignments are made on the input. Joins are sort-merge joins at every size, so that what is shuffled grows with the table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import column, matches, small_batches
from ebbtide.runtime import materialize

BLOCK_CHARS, RARE_DOCS = 60, 4
SALTS = 64
"""Parts of a frequent key; a mask of them is a long."""
BASE = 0x9E3779B97F4A7C15
"""Odd, so that it has an inverse: run hashes are differences of one running sum."""


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i == p or j == q:
            continue
        in_a, in_b = Counter(a[i:p]), Counter(b[j:q])
        place = {b[k]: k for k in range(j, q) if in_b[b[k]] == 1}
        common = [(k, place[a[k]]) for k in range(i, p) if in_a[a[k]] == 1 and a[k] in place]
        if not common:
            place = dict(zip(_numbered(b, j, q), range(j, q), strict=True))
            common = [(k, place[x]) for k, x in zip(range(i, p), _numbered(a, i, p), strict=True) if x in place]
        last = (i, j)
        for x, y in _rising(common):
            todo.append((last[0], x, last[1], y))
            out.append((x, y))
            last = (x + 1, y + 1)
        if last != (i, j):
            todo.append((last[0], p, last[1], q))
    return sorted(out)


def _numbered(lines: list[int], start: int, end: int) -> list[tuple[int, int]]:
    """Lines with the number of their occurrence between ``start`` and ``end``."""
    seen: Counter[int] = Counter()
    out = []
    for x in lines[start:end]:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs`` that rises in the second place too."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        before.append(at[pile - 1] if pile else -1)
        tops[pile:pile + 1] = [y]
        at[pile:pile + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common_blocks(earlier: list[int], later: list[int], sizes: list[int], block_chars: int) -> list[int]:
    """Lines of ``later`` in aligned blocks of enough characters."""
    out: list[int] = []
    block: list[int] = []
    previous = (-2, -2)
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if (i, j) != (previous[0] + 1, previous[1] + 1):
            if sum(sizes[k] for k in block) >= block_chars:
                out += block
            block = []
        block.append(j)
        previous = (i, j)
    return out


def run_keys(lines: list[np.ndarray], sizes: list[np.ndarray], block_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) for each line with characters: the hash of the shortest run from it that has ``block_chars`` characters.

    So is the shortest run that ends with it; a run that is both counts once. Runs do not leave their document.
    """
    ends = np.cumsum([len(x) for x in lines])
    line, size = np.concatenate(lines).view(np.uint64), np.concatenate(sizes).astype(np.int64)
    doc = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    chars, block = np.concatenate([[0], np.cumsum(size)]), max(block_chars, 1)
    at = np.flatnonzero(size > 0)
    stop = np.searchsorted(chars, chars[at] + block)
    start = np.searchsorted(chars, chars[at + 1] - block, "right") - 1
    begins = (ends - [len(x) for x in lines])[doc[at]]
    ahead, behind = stop <= ends[doc[at]], start >= begins
    runs = np.unique(np.stack([np.concatenate([at[ahead], start[behind]]), np.concatenate([stop[ahead], at[behind] + 1])]), axis=1)
    start, stop = runs[0], runs[1]
    power = np.cumprod(np.full(len(line), BASE, np.uint64))
    back = np.cumprod(np.full(len(line), pow(BASE, -1, 1 << 64), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line * power)])
    return doc[start], ((total[stop] - total[start]) * back[start]).view(np.int64)


def _keyed(listed: DataFrame, block_chars: int) -> DataFrame:
    """(_doc, _run, _once, _salt): each key of a document, and whether it stands there once."""
    key_type = listed.schema["_doc"].dataType["key"].dataType.simpleString()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            doc, run = run_keys(list(b["_lines"]), list(b["_sizes"]), block_chars)
            n = pd.DataFrame({"_at": doc, "_run": run}).value_counts(sort=False).reset_index(name="_n")
            at = n["_at"].to_numpy()
            yield pd.DataFrame({"_key": b["_key"].to_numpy()[at], "_mark": b["_mark"].to_numpy()[at], "_run": n["_run"], "_once": n["_n"] == 1})

    out = listed.select(F.col("_doc.key").alias("_key"), F.col("_doc.mark").alias("_mark"), "_lines", "_sizes").mapInPandas(
        keys, f"_key {key_type}, _mark long, _run long, _once boolean")
    doc = F.struct(F.col("_key").alias("key"), F.col("_mark").alias("mark"))
    return _salted(out.select(doc.alias("_doc"), "_run", "_once"))


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_doc"), F.lit(SALTS)).cast("int"))


def _pairs(keyed: DataFrame, rare_docs: int) -> DataFrame:
    """(_doc, _hub), the later and the earlier document of each pair to be aligned, once."""
    alone = F.min(F.when(F.col("_once"), F.col("_doc")))
    hubs = keyed.groupBy("_run").agg(
        F.count("*").alias("_n"), F.min("_doc").alias("_first"), alone.alias("_alone"), _parts().alias("_parts")).where("_n > 1")
    shared = keyed.join(_each_part(hubs).hint("merge"), ["_run", "_salt"])
    led = shared.where(F.col("_n") > rare_docs).select("_doc", F.explode(F.array("_first", "_alone")).alias("_hub")).where("_hub < _doc")
    rare = shared.where(F.col("_n") <= rare_docs).groupBy("_run").agg(F.sort_array(F.collect_list("_doc")).alias("_docs"))
    rare = rare.select("_docs", F.posexplode("_docs").alias("_i", "_doc")).select("_doc", F.explode(F.expr("slice(_docs, 1, _i)")).alias("_hub"))
    return led.unionByName(rare).distinct()


def _parts() -> Column:
    """The salts of a group as bits."""
    return F.bit_or(F.expr("shiftleft(1L, _salt)"))


def _each_part(rows: DataFrame) -> DataFrame:
    """``rows`` once for each salt in _parts."""
    every = F.expr(f"filter(sequence(0, {SALTS - 1}), s -> bit_get(_parts, s) = 1)")
    return rows.withColumn("_salt", F.explode(every)).drop("_parts")


def dedup_lines(docs: DataFrame, block_chars: int = BLOCK_CHARS, rare_docs: int = RARE_DOCS, key: str = "doc_id", text: str = "text",
                count: str = "n_lines", removed: str = "n_removed") -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and ``count`` and ``removed`` (replacing columns of these names), a row per row.

    Lines are split at \\n and compared without spaces at their ends. The later of two documents has the larger key; of equal
    keys, the larger hash of the text. Repeated rows are one document and lose nothing to each other. A row with a null key or a null
    text is left as it is. A document whose lines all go has an empty text. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    mark = F.xxhash64(column(docs, key), column(docs, text))
    lines = F.split(F.col(text), "\n")
    listed = materialize(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.struct(F.col(key).alias("key"), mark.alias("mark")).alias("_doc"),
        F.transform(lines, lambda x: F.xxhash64(F.trim(x))).alias("_lines"),
        F.transform(lines, lambda x: F.length(F.trim(x))).alias("_sizes")).dropDuplicates(["_doc"]))
    pairs = materialize(_pairs(_keyed(listed, block_chars), rare_docs))
    met = _salted(pairs)
    hubs = met.groupBy("_hub").agg(_parts().alias("_parts")).join(
        listed.select(F.col("_doc").alias("_hub"), F.col("_lines").alias("_before")).hint("merge"), "_hub")
    both = met.join(listed.hint("merge"), "_doc").join(_each_part(hubs).hint("merge"), ["_hub", "_salt"])

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gone = [common_blocks(x.tolist(), y.tolist(), s.tolist(), block_chars) for x, y, s in zip(b["_before"], b["_lines"], b["_sizes"], strict=True)]
            yield pd.DataFrame({"_key": b["_key"], "_mark": b["_mark"], "_n": [len(x) for x in b["_lines"]], "_gone": gone})

    def flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flags = [np.isin(np.arange(n), at) for n, at in zip(b["_n"], b["_at"], strict=True)]
            yield pd.DataFrame({"_key": b["_key"], "_mark": b["_mark"], "_gone": flags})

    key_type = docs.schema[key].dataType.simpleString()
    cut = both.select(F.col("_doc.key").alias("_key"), F.col("_doc.mark").alias("_mark"), "_before", "_lines", "_sizes").mapInPandas(
        align, f"_key {key_type}, _mark long, _n int, _gone array<int>")
    cut = cut.select("_key", "_mark", "_n", F.explode("_gone").alias("_at")).groupBy("_key", "_mark", "_n").agg(F.collect_set("_at").alias("_at"))
    cut = materialize(cut.mapInPandas(flag, f"_key {key_type}, _mark long, _gone array<boolean>"))
    out = docs.join(cut.hint("merge"), matches(docs, cut, {"_key": column(docs, key), "_mark": mark}), "left")
    gone, whole = column(cut, "_gone"), column(docs, text)
    every = F.split(whole, "\n")
    left = F.filter(F.zip_with(every, gone, lambda x, gone: F.when(~gone, x)), lambda x: x.isNotNull())
    kept = F.when(gone.isNull(), whole).otherwise(F.array_join(left, "\n"))
    names = [c for c in docs.columns if c not in (count, removed)]
    return out.select(
        *(kept.alias(c) if c == text else column(docs, c) for c in names), F.coalesce(F.size(every), F.lit(0)).cast("long").alias(count),
        F.coalesce(F.size(F.filter(gone, lambda x: x)), F.lit(0)).cast("long").alias(removed))
