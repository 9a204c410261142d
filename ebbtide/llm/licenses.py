"""License scans: short notices found with a bounded number of edits.

A notice that stands in a text with at most k edits has, cut into k + 1 pieces, one piece that stands there unchanged. All pieces of
all notices are looked up in one walk over the text; around each the bounded-error matching of the regex library decides.

Texts and notices are compared as lower-cased words (A-Z only) with one space between. A null text has no words. Repeated rows are
scanned each for itself; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ebbtide.llm.common import column, small_batches

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
"""Exact phrases, by words."""

CHARS_PER_EDIT = 12
"""A notice may differ by one edit (insert, delete or change a character) for so many of its characters; pieces are that long at least."""

NOTICES = {
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "released under the bsd license",
    ],
    "cc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution",
        "licensed under the creative commons attribution",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license",
        "you should have received a copy of the gnu general public license",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["under the terms of the gnu lesser general public license"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
}
"""Label: notices, as words."""

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


class Notice:
    """A notice between spaces, its edits, the pieces that one match must hold one of, and the pattern that verifies."""

    def __init__(self, label: str, words: str) -> None:
        self.label, self.words = label, words
        self.text = f" {words} "
        self.edits = max(1, len(words) // CHARS_PER_EDIT)
        ends = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.pieces = [(a, self.text[a:b]) for a, b in zip(ends, ends[1:])]
        self.pattern = regex.compile(f"(?:{regex.escape(self.text)}){{e<={self.edits}}}", regex.BESTMATCH)
        self.verify = lru_cache(maxsize=1024)(self._verify)

    def _verify(self, around: str) -> tuple[int, int, int] | None:
        """Start, end and number of edits of the best match within a piece of text."""
        m = self.pattern.search(around)
        return m and (*m.span(), sum(m.fuzzy_counts))


class Notices:
    def __init__(self, notices: dict[str, list[str]]) -> None:
        self.all = [Notice(label, words) for label, list_ in sorted(notices.items()) for words in list_]
        at: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.all):
            for offset, piece in n.pieces:
                at.setdefault(piece, []).append((i, offset))
        self.pieces = ahocorasick.Automaton()
        for piece, places in at.items():
            self.pieces.add_word(piece, (len(piece), places))
        self.pieces.make_automaton()

    def find(self, text: str) -> list[tuple[Notice, int, int, int]]:
        """(notice, start, end, edits) of all notices in a text of words between spaces, the best of those that overlap."""
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.pieces.iter(text):
            for i, offset in places:
                starts.setdefault(i, set()).add(end + 1 - length - offset)
        out = []
        for i, spots in starts.items():
            n = self.all[i]
            found = set()
            for spot in spots:
                # A match reaches at most `edits` beyond either end, wherever in it the piece lies.
                low = max(0, spot - n.edits)
                m = n.verify(text[low:spot + len(n.text) + n.edits])
                if m:
                    inside = text[low + m[0]:low + m[1]]
                    start = low + m[0] + len(inside) - len(inside.lstrip())
                    found.add((m[2], start, start + len(inside.strip())))
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(found):
                at = bisect_left(taken, (start, end))
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                    taken.insert(at, (start, end))
                    out.append((n, start, end, edits))
        return sorted(out, key=lambda f: (f[1], f[2], f[0].label, f[0].words))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _places(text: str, phrase: str) -> list[int]:
    """Where the words of a phrase stand in a text of words between spaces, by number of the first word."""
    out, at, words, phrase = [], 0, 0, f" {phrase} "
    while (found := text.find(phrase, at)) >= 0:
        words += text.count(" ", at, found)
        out.append(words)
        at = found
        words, at = words + 1, at + 1
    return out


def scan_text(text: str | None, notices: Notices, phrases: dict[str, str]) -> dict:
    words = words_of(text or "")
    row = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
    if not words:
        return row
    plain = f" {b' '.join(words).decode()} "
    places, base = [], set()
    for phrase, label in phrases.items():
        if found := _places(plain, phrase):
            places += found
            base.add(label)
    found = notices.find(plain)
    if not places and not found:
        return row
    row["n_base"] = len(places)
    if places:
        row["first_word"], row["last_word"] = min(places), max(places)
    row["base_labels"] = ",".join(sorted(base))
    row["labels"] = ",".join(sorted(base | {n.label for n, *_ in found}))
    row["score"] = 1.0 if base else max(1 - edits / (n.edits + 1) for n, _, _, edits in found)
    if found:
        spots = [m.span() for m in _WORD.finditer(text)]
        at = words_before = 0
        for n, start, end, edits in found:
            words_before, at = words_before + plain.count(" ", at, start), start
            first = words_before - 1
            last = first + plain.count(" ", start, end)
            row["spans"].append({"label": n.label, "notice": n.words, "first_word": first, "last_word": last, "start": spots[first][0], "end": spots[last][1], "edits": edits})
    return row


_OUT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,notice:string,first_word:long,last_word:long,start:long,end:long,edits:int>>")


@cache
def _compiled(notices: tuple) -> Notices:
    """Once a worker."""
    return Notices({label: list(words) for label, words in notices})


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema, notices: tuple, phrases: dict[str, str]) -> Iterator[pa.RecordBatch]:
    compiled = _compiled(notices)
    for b in batches:
        rows = [{"doc_id": i.as_py(), **scan_text(t.as_py(), compiled, phrases)} for i, t in zip(b["doc_id"], b["text"])]
        yield pa.RecordBatch.from_pylist(rows, schema)


def scan_licenses(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per document its words, the places of exact phrases and the licenses that these or notices name.

    doc_id, n_words, n_base (places of phrases), first_word and last_word (least and largest place, words from 0), base_labels, labels,
    score (1 with a phrase, else the share of a notice's edits that its best match has left; 0 without any), spans (label, notice, first
    and last word, start and end in the text, edits). Of one notice's matches that overlap, those with the fewest edits count.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").cast("string").alias("text"))
    out = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(_OUT)])
    schema = to_arrow_schema(out)
    fixed = tuple((label, tuple(words)) for label, words in sorted(notices.items()))
    return rows.mapInArrow(lambda b: _scan(b, schema, fixed, phrases), out)
