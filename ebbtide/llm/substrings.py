"""Substring dedup: words under a window of ``window`` words that also starts elsewhere, in any text, are removed.

Pass 1 fills a count-min sketch. A window is counted under its anchor, the smallest hash among its runs of ``RUN`` words: equal
windows have equal anchors at equal places, so the number of places of an anchor is never below the number of places of any
window that has it, and the sketch's estimate is never below either. Anchors are about a tenth as many as windows. Each task adds
up its part of the sketch, parts are merged cell by cell in Spark, and what is kept of a cell is whether it reached two: one bit.
The sketch has about two cells per anchor, up to ``MAX_BITS``: 2 x 32 MB that a broadcast never exceeds. Beyond that it lets more
windows through, and loses none.

Pass 2 groups exactly the windows whose estimate is two or more, by two independent 64-bit hashes, with map-side counts. What comes
back are the windows found only once: a count of one names its single place, so nothing is joined on a window and the places of a
window that very many texts share are never brought together. Windows with an estimate of two or more that are not refuted this way
are the repeated ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import small_batches
from ebbtide.llm.rolling import Words, mix, slide
from ebbtide.runtime import materialize

WINDOW, RUN = 35, 16
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BLOCK_BITS, MAX_BITS = 16, 28
FLUSH = 1 << 20


def anchors(words: Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the anchor's hash (0 where no window fits), and the hashes at all anchor places."""
    inside = words.inside(window)
    hashes = mix(words.windows(run)) | np.uint64(1)
    width = window - run + 1
    least = np.where(inside, slide(hashes, width, np.minimum)[:len(inside)], np.uint64(0))
    # A place is an anchor if one of the windows over it has its hash as the smallest.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = slide(padded, width, np.maximum)[:len(hashes)]
    return least, hashes[:len(most)][most == hashes[:len(most)]]


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (hashes * np.uint64(ROWS[row])) >> np.uint64(64 - bits)


def sketch(docs: DataFrame, bits: int, window: int, run: int) -> DataFrame:
    """(block, seen_twice): the merged sketch, a bit per cell, in blocks of 2^16 cells."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def part() -> pd.DataFrame:
            blocks, found, counts = [], [], []
            every = np.concatenate(held)
            held.clear()
            for row in range(len(ROWS)):
                cell, n = np.unique(cells(every, row, bits), return_counts=True)
                block = (cell >> np.uint64(BLOCK_BITS)).astype(np.int64)
                cut = np.flatnonzero(np.diff(block)) + 1
                n = np.minimum(n, 2).astype(np.uint8)
                low = (cell & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint16)
                for c, k, b in zip(np.split(low, cut), np.split(n, cut), block[np.concatenate([[0], cut])], strict=True):
                    blocks.append((row << bits - BLOCK_BITS) + int(b))
                    found.append(c.tobytes())
                    counts.append(k.tobytes())
            return pd.DataFrame({"block": blocks, "cells": found, "counts": counts})

        size = 0
        for b in batches:
            a = anchors(Words([t.encode() for t in b["_text"]], 1), window, run)[1]
            if len(a):
                held.append(a)
                size += len(a)
            if size >= FLUSH:
                size = 0
                yield part()
        if held:
            yield part()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The blocks of one task, however many parts there are: a share of the bounded sketch.
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, c, k in zip(b["block"], b["cells"], b["counts"], strict=True):
                total = sums.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint8))
                at = np.frombuffer(c, np.uint16)
                total[at] = np.minimum(total[at] + np.frombuffer(k, np.uint8), 2)
        for block, total in sums.items():
            yield pd.DataFrame({"block": [block], "seen_twice": [np.packbits(total > 1).tobytes()]})

    filled = docs.select("_text").mapInPandas(fill, "block long, cells binary, counts binary")
    return filled.repartition("block").mapInPandas(merge, "block long, seen_twice binary")


def windows_estimated_repeated(words: Words, twice: np.ndarray, bits: int, window: int, run: int) -> np.ndarray:
    """Starts of the windows whose estimate is two or more."""
    least, _ = anchors(words, window, run)
    at = np.flatnonzero(least)
    for row in range(len(ROWS)):
        cell = cells(least[at], row, bits)
        at = at[(twice[row, (cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 > 0]
    return at


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept: a row per row of ``docs``; ``kept`` holds the remaining words joined by one space.

    Words are what spaces, tabs and line ends leave. A null text has no words. A repeated row repeats all its windows; a text shorter
    than the window has none. Windows are judged on the input. An empty table gives an empty result; other columns are not read.
    """
    if not 0 < run <= window:
        raise ValueError("a run must lie inside the window")
    spark = docs.sparkSession
    small_batches(spark)
    text_or_empty = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(key), text_or_empty).alias("_print"), text_or_empty.alias("_text"))
    key_type = given.schema["_key"].dataType.simpleString()
    size = given.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    expected = max(1, size * 2 // (5 * (window - run + 2)))  # words of five bytes or more, two anchors per window span
    bits = min(max((2 * expected - 1).bit_length(), BLOCK_BITS), MAX_BITS)
    twice = np.zeros((len(ROWS), 1 << bits - 3), np.uint8)
    per_row = 1 << bits - BLOCK_BITS
    for r in materialize(sketch(given, bits, window, run)).toLocalIterator():
        row, block = divmod(r["block"], per_row)
        twice[row, block << BLOCK_BITS - 3:(block + 1) << BLOCK_BITS - 3] = np.frombuffer(r["seen_twice"], np.uint8)
    shared = spark.sparkContext.broadcast(twice)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = Words([t.encode() for t in b["_text"]])
            at = windows_estimated_repeated(words, shared.value, bits, window, run)
            doc = words.doc[at]
            yield pd.DataFrame({
                "_print": b["_print"].to_numpy()[doc], "_pos": (at - words.first[doc]).astype(np.int32),
                "_h1": words.windows(window, 0)[at].view(np.int64), "_h2": words.windows(window, 1)[at].view(np.int64)})

    found = given.select("_print", "_text").mapInPandas(candidates, "_print long, _pos int, _h1 long, _h2 long")
    once = found.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.max("_print").alias("_print"), F.max("_pos").alias("_pos")).where("_n = 1")
    refuted = once.groupBy("_print").agg(F.collect_list(F.struct("_pos", "_h1")).alias("_once"))  # at most the words of one text
    refuted = refuted.select("_print", F.col("_once._pos").alias("_pos"), F.col("_once._h1").alias("_h1"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode() for t in b["_text"]]
            words = Words(texts)
            again = np.zeros(len(words) + 1, bool)
            again[windows_estimated_repeated(words, shared.value, bits, window, run)] = True
            h = words.windows(window, 0).view(np.int64)
            for i, (pos, h1) in enumerate(zip(b["_pos"], b["_h1"], strict=True)):
                if pos is not None:
                    at = words.first[i] + np.asarray(pos, np.int64)
                    fits = at < len(h)
                    at, h1 = at[fits], np.asarray(h1, np.int64)[fits]
                    again[at[h[at] == h1]] = False
            edge = np.zeros(len(words) + window + 1, np.int32)
            start = np.flatnonzero(again)
            edge[start] += 1
            edge[start + window] -= 1
            gone = np.cumsum(edge)[:len(words)] > 0
            removed = np.add.reduceat(np.concatenate([gone, [False]]), words.first[:-1]) if len(words.doc) else np.zeros(len(texts), np.int64)
            counts = np.diff(words.first)
            removed = np.where(counts > 0, removed, 0)
            kept = []
            for i, t in enumerate(texts):
                own = t.split()
                if removed[i]:
                    own = [w for w, g in zip(own, gone[words.first[i]:words.first[i + 1]], strict=True) if not g]
                kept.append(b" ".join(own).decode())
            yield pd.DataFrame({"_key": b["_key"], "n_words": counts, "n_removed": removed.astype(np.int64), "kept": kept})

    out = given.join(refuted, "_print", "left").select("_key", "_text", "_pos", "_h1")
    return out.mapInPandas(remove, f"_key {key_type}, n_words long, n_removed long, kept string").withColumnRenamed("_key", key)
