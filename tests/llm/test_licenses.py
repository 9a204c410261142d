import random
import re

import pytest

from ebbtide.llm import licenses
from tests.llm.conftest import CLASHING, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def least_edits(text, notice):
    """Fewest edits between a notice and any part of a text, by dynamic programming over all of it."""
    column = list(range(len(notice) + 1))
    best = column[-1]
    for c in text:
        before, column = column, [0]
        for i, n in enumerate(notice, 1):
            column.append(min(before[i - 1] + (n != c), before[i] + 1, column[-1] + 1))
        best = min(best, column[-1])
    return best


def damaged(rnd, text, edits):
    chars = list(text)
    for _ in range(edits):
        i, kind = rnd.randrange(len(chars)), rnd.choice("ids")
        if kind == "i":
            chars.insert(i, rnd.choice("abc e"))
        elif kind == "d":
            del chars[i]
        else:
            chars[i] = rnd.choice("abc e")
    return "".join(chars)


def test_finds_the_notices_within_their_edits_and_no_other():
    rnd, notices = random.Random(5), licenses.Notices(licenses.NOTICES)
    for _ in range(80):
        n = rnd.choice(notices.all)
        text = "lorem ipsum " * rnd.randint(0, 3) + damaged(rnd, n.words, rnd.randint(0, n.edits + 2)) + " dolor sit" * rnd.randint(0, 2)
        plain = " " + " ".join(WORD.findall(lower(text))) + " "
        assert {f[0].words for f in notices.find(plain)} == {m.words for m in notices.all if least_edits(plain, m.text) <= m.edits}, text


def base(text):
    words = WORD.findall(lower(text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


SAID = ["MIT License", "mit\nlicense", "the Apache-License", "GNU General  Public License", "MIT licence", "permit license", "Released under the MIT Licence.", "mit license mit license", "ÀMIT license", "MIT LICENSEé",
        "Permission is hereby granted, free of charge, to any person obtaining copy of this software and assocated documentation files"]


def test_base_and_spans_of_odd_texts(spark):
    rnd = random.Random(6)
    rows = [(*r, *range(14)) for r in odd_rows()]
    rows += [(1000 + i, " ".join(rnd.choice([*SAID, "x", "Lorem, ipsum."]) for _ in range(rnd.randint(1, 9))), "en", "s", 1, *range(14)) for i in range(40)]
    rows += [(2000, "released under the " * 3000 + "mit license", "en", "s", 1, *range(14))]
    got = licenses.scan_licenses(spark.createDataFrame(rows, CLASHING).repartition(3)).collect()
    want = sorted(((r[0], *base(r[1])) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == want
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    assert any(r.spans for r in got)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score > 0) == bool(r.labels)
        for s in r.spans if r.doc_id is not None else []:
            words = WORD.findall(lower(texts[r.doc_id]))
            assert WORD.findall(lower(texts[r.doc_id][s.start:s.end])) == words[s.first_word:s.last_word + 1]
            assert least_edits(" " + " ".join(words[s.first_word:s.last_word + 1]) + " ", f" {s.notice} ") <= s.edits + 2


def test_no_rows(none):
    assert licenses.scan_licenses(none).collect() == []


@pytest.mark.parametrize("text", [None, "", " \n\t", "..."])
def test_without_words(text):
    assert licenses.scan_text(text, licenses.Notices(licenses.NOTICES), licenses.PHRASES)["n_words"] == 0
