"""Substring dedup, near duplicates and line dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from ebbtide.llm import near
from ebbtide.llm.lines import common_blocks, dedup_lines, patience, run_keys
from ebbtide.llm.near import near_duplicates, shingle_sets
from ebbtide.llm.rolling import Words, slide
from ebbtide.llm.substrings import remove_repeats
from tests.llm.conftest import counted, some_text


def removed_by_hand(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    starts = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - window + 1) if starts[tuple(w[i:i + window])] > 1 for k in range(i, i + window)}
        out.append((key, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize(("window", "run"), [(35, 16), (5, 3), (4, 4), (3, 1)])
def test_substrings_of_odd_rows(odd, window, run):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = remove_repeats(odd, window, run).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert counted(got) == counted(removed_by_hand(rows, window))


def test_substrings_with_few_words_and_a_full_sketch(spark, monkeypatch):
    from ebbtide.llm import substrings

    # So narrow that most estimates are too high: nothing may be lost or removed in error.
    monkeypatch.setattr(substrings, "MAX_BITS", 16)
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 90)))) for i in range(40)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 9, 4).collect()
    assert counted(got) == counted(removed_by_hand(rows, 9))


def test_empty_tables(none):
    assert remove_repeats(none).count() == 0
    assert near_duplicates(none).count() == 0
    assert dedup_lines(none).count() == 0


def test_words_are_what_split_gives():
    texts = [b"", b"  a bb\tccc\n", b"\x0b\x0c d", "é ñ x".encode(), b"last"]
    words = Words(texts)
    assert np.diff(words.first).tolist() == [len(t.split()) for t in texts]
    again = Words([b"a d", b"bb \n last"])
    assert set(again.hash[0].tolist()) <= set(words.hash[0].tolist())
    values = np.array([5, 3, 8, 1, 9, 2, 7])
    for width in range(1, 8):
        assert slide(values, width, np.minimum).tolist() == [min(values[i:i + width]) for i in range(len(values) - width + 1)]


def linked_by_hand(rows, shingle, similar):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < shingle else (tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)))

    sets = [shingles(t) for _, t in rows]
    parent = {k: k for k, _ in rows if k is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            common = len(sets[i] & sets[j])
            if None not in (a, b) and common and 100 * common >= similar * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(k, len(s), None if k is None else root(k), k is None or root(k) == k) for (k, _), s in zip(rows, sets, strict=True)]


def test_near_duplicates_of_odd_rows(odd):
    # Two different texts share an id here; a row's component goes by its own text.
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.text != "another text of the same id"]
    given = odd.where("text IS NULL OR text <> 'another text of the same id'")
    got = near_duplicates(given, 3, 85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert counted(got) == counted(linked_by_hand(rows, 3, 85))


def test_near_duplicates_of_one_large_group(spark):
    """Copies with a growing number of changes: chains, pairs just above and below the threshold, hubs that do not see all."""
    rnd = random.Random(11)
    base = some_text(rnd, 150, 150).split()
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rnd.randint(0, 12)):
            words[rnd.randrange(len(words))] = f"new{rnd.randint(0, 400)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, some_text(rnd, 20, 60)) for i in range(40)]
    rnd.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).drop("_print", "_group").collect()
    assert counted(got) == counted(linked_by_hand(rows, 3, 85))


def test_half_keys_agree_as_often_as_sets():
    rnd = np.random.default_rng(5)
    base = rnd.integers(1, 1 << 63, 2000, np.uint64)
    other = base.copy()
    other[:300] = rnd.integers(1, 1 << 63, 300, np.uint64)
    j = 1700 / 2300
    agree = np.mean(near.half_keys(base) == near.half_keys(other))
    assert abs(agree - j ** near.WIDTH) < 0.4  # 16 keys only
    assert (near.half_keys(base) == near.half_keys(base[::-1])).all()
    assert [len(s) for s in shingle_sets([b"", b"a", b"a b", b"a b c", b"A b c"], 3)] == [0, 1, 1, 1, 1]


def test_patience_aligns_in_order_and_finds_moved_neighbours():
    assert patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert patience([], [1]) == []
    assert patience([1, 9, 2, 3], [7, 1, 2, 8, 3]) == [(0, 1), (2, 2), (3, 4)]
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.randint(0, 9) for _ in range(rnd.randint(0, 15))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert common_blocks([1, 2, 3], [1, 2, 9, 3], [30, 30, 30, 30], 60) == [0, 1]


def test_lines_go_from_the_later_document_only(spark):
    a, b, c = (f"{x} is a line that is long enough to be found by its hash, and to be a block of its own" for x in "abc")
    rows = [(1, f"{a}\n{b}\nend"), (2, f"start\n{a}\n{b}\n{c}"), (3, f"{c}\n"), (3, f"{c}\n"), (4, "short\nlines"), (5, "short\nlines"), (None, a), (6, None), (7, "")]
    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed, r.extra) for r in dedup_lines(
        spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, extra string")).collect()}
    assert got[1, f"{a}\n{b}\nend"] == (3, 0, "x")
    assert got[2, f"start\n{c}"] == (4, 2, "x")
    assert got[3, ""] == (2, 1, "x")
    assert got[4, "short\nlines"] == got[5, "short\nlines"] == (2, 0, "x")
    assert got[None, a][1] == 0 and got[6, None] == (0, 0, "x") and got[7, ""] == (1, 0, "x")


def lines_by_hand(rows, block_chars=60):
    """Every later document against every earlier one."""
    docs = sorted({(k, t) for k, t in rows})
    split = [[x.strip(" ") for x in t.split("\n")] for _, t in docs]
    out = {}
    for d, (doc, lines) in enumerate(zip(docs, split, strict=True)):
        sizes = [len(x) for x in lines]
        gone = {j for h in range(d) for j in common_blocks(split[h], lines, sizes, block_chars)}
        out[doc] = (len(lines), len(gone), "\n".join(x for j, x in enumerate(doc[1].split("\n")) if j not in gone))
    return out


def test_lines_against_all_pairs(spark):
    rnd = random.Random(11)
    pool = [some_text(rnd, 1, 14, 99) for _ in range(60)]
    rows = []
    for i in range(120):
        at = rnd.randrange(40)
        part = pool[at:at + rnd.randint(2, 9)] + ([""] if i % 3 else [])
        own = [f"{some_text(rnd, 2, 9, 99)} {i}" for _ in range(rnd.randint(0, 4))]
        rows.append((i, "\n".join(part + own if i % 2 else own + part)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = lines_by_hand(rows)
    assert sum(n for _, n, _ in want.values()) > 300
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(docs, rare_docs=1000).collect()}
    assert got == {k: v for (k, _), v in want.items()}
    # Frequent keys lead to hubs: blank lines beside a block may stay.
    got = {r.doc_id: r.text.split() for r in dedup_lines(docs).collect()}
    assert got == {k: v[2].split() for (k, _), v in want.items()}


def test_lines_that_stand_twice_short_ones_and_other_hubs(spark):
    twice = "a passage of one line that is long enough to be a block of its own, standing twice in the first"
    a, b, c = (f"{x} line of five and thirty characters."[:35] for x in ("one", "two", "six"))
    short = "\n".join(f"short one {i}" for i in range(8))
    rows = [(1, f"{twice}\nown text\n{twice}"), *((i, f"{twice}\nend {i}") for i in range(2, 9))]
    rows += [(11, f"{a}\nx"), (12, f"{b}\ny"), (13, f"{c}\nz"), (14, f"{a}\n{b}\n{c}\n14"), (15, f"15\n{a}\n{b}\n{c}")]
    rows += [(21, f"{short}\n21"), (22, f"22\n{short}")]
    got = {r.doc_id: (r.n_removed, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), rare_docs=2).collect()}
    assert all(got[i] == (1, f"end {i}") for i in range(2, 9)) and got[1][0] == 0
    assert got[14][0] == 0 and got[15] == (3, "15")
    assert got[21][0] == 0 and got[22] == (8, "22")


def test_run_keys_are_those_of_equal_runs():
    rnd = np.random.default_rng(4)
    lines = [rnd.integers(0, 5, rnd.integers(1, 40)) for _ in range(30)]
    sizes = [x * 9 for x in lines]
    doc, run = run_keys(lines, sizes, 60)
    want = []
    for d, x in enumerate(lines):
        for i in range(len(x)):
            for j in range(i + 1, len(x) + 1):
                if x[i] and x[j - 1] and sum(x[i:j]) * 9 >= 60 and (sum(x[i + 1:j]) * 9 < 60 or sum(x[i:j - 1]) * 9 < 60):
                    want.append((d, tuple(x[i:j].tolist())))
    assert doc.tolist() == [d for d, _ in want]
    assert len(set(run.tolist())) == len({r for _, r in want}) == len(set(zip(run.tolist(), [r for _, r in want], strict=True)))


def test_lines_of_odd_rows(odd):
    before, after = odd.collect(), dedup_lines(odd).collect()
    assert len(before) == len(after)
    for column in ("_key", "_print", "_mark", "_gone", "kept", "lang"):
        assert counted([(getattr(r, column),) for r in before]) == counted([(getattr(r, column),) for r in after])
    assert {r.doc_id for r in after if r.n_removed} >= {100, 101}
    # No line is lost: whatever went is still in a document that kept it.
    lines = {x.strip() for r in before for x in (r.text or "").split("\n")}
    assert lines == {x.strip() for r in after for x in (r.text or "").split("\n")}
