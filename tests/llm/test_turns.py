import hashlib
import itertools
import random
import zlib

import pytest

from ebbtide.llm import turns
from ebbtide.llm.queries import damage

SCHEMA = "conv_id long, turn long, role string, text string, _kind int, _digest int, audit int"
STEP = {(0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def left_to_right(kinds):
    """The cheapest edits by the states of the output alone, row after row."""
    def inserted(v):
        for _ in range(3):
            for (p, _), q in STEP.items():
                if v[p] is not None and (v[q] is None or (v[p][0] + 2, v[p][1] + "I") < v[q]):
                    v[q] = v[p][0] + 2, v[p][1] + "I"
        return v

    v = inserted([(0, ""), None, None, None])
    for k in kinds:
        w = [None] * 4
        for p, at in enumerate(v):
            if at is None:
                continue
            ways = [(p, 3, "D")]
            if k != "d":
                more = k.isupper()
                ways += [(q, 2 + more, "R") for (s, _), q in STEP.items() if s == p]
                ways += [(q, more, "K") for (s, i), q in [*STEP.items(), ((0, "s"), 1)] if s == p and i == k.lower()]
            for q, cost, edit in ways:
                new = at[0] + cost, at[1] + edit
                w[q] = new if w[q] is None else min(w[q], new)
        v = inserted(w)
    return min(x for x in (v[0], v[3]) if x)


def all_edits(kinds, extra):
    """Every sequence of edits with at most ``extra`` insertions, tried outright."""
    found = []
    for n in range(extra + 1):
        for spots in itertools.combinations_with_replacement(range(len(kinds) + 1), n):
            for edits in itertools.product(*(["D"] if k == "d" else ["D", "K", "R"] for k in kinds)):
                state, cost, audit, fine = 0, 0, "", True
                for i in range(len(kinds) + 1):
                    for _ in range(spots.count(i)):
                        state, cost, audit = STEP[state, "a" if state == 2 else "u"], cost + 2, audit + "I"
                    if i == len(kinds):
                        break
                    k, e = kinds[i], edits[i]
                    audit += e
                    if e == "D":
                        cost += 3
                        continue
                    cost += (2 if e == "R" else 0) + k.isupper()
                    initial = ("a" if state == 2 else "u") if e == "R" else k.lower()
                    nxt = {**STEP, (0, "s"): 1}.get((state, initial))
                    if nxt is None:
                        fine = False
                        break
                    state = nxt
                if fine and state in (0, 3):
                    found.append((cost, audit))
    return min(found)


def whole(kinds):
    chart = turns.Chart()
    for k in kinds:
        chart.add(k)
    return turns.cheapest(chart.whole())


def test_cells_equal_every_sequence_of_edits():
    rnd = random.Random(2)
    for n in (0, 1, 2, 3, 4, 4):
        for _ in range(12):
            kinds = "".join(rnd.choice("suaxdSUAX") for _ in range(n))
            assert whole(kinds) == all_edits(kinds, n + 2), kinds


def test_long_spans_equal_a_walk_from_left_to_right():
    rnd = random.Random(3)
    for n in (7, 8, 9, 15, 16, 17, 63, 200, 1000):
        kinds = "".join(rnd.choice("ssuauauaxdSUA") for _ in range(n))
        assert whole(kinds) == left_to_right(kinds), kinds


def test_all_splits_of_a_span_give_one_cell():
    for kinds in ("suauau", "Uasxdd", "aauuSA", "ddusau"):
        cells = [turns.joined(turns.parsed(kinds[:i]), turns.parsed(kinds[i:])) for i in range(1, len(kinds))]
        assert all(c == turns.parsed(kinds) for c in cells)


def plain(rows, among):
    """What ``repair`` must return, in plain Python."""
    out = []
    for conv in among:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        kinds, blank, dup, cut, seen = "", 0, 0, 0, set()
        for _, role, text in mine:
            end = text.rstrip(turns.BLANK)[-1:]
            first = "blank" if not end else "dup" if (role, text) in seen else "cut" if end not in ".!?" else ""
            seen.add((role, text))
            blank, dup, cut = blank + (first == "blank"), dup + (first == "dup"), cut + (first == "cut")
            kind = role[:1] if role[:1] in tuple("sua") else "x"
            kinds += "d" if first in ("blank", "dup") else kind.upper() if first == "cut" else kind
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        numbers = [t for t, *_ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = left_to_right(kinds)
        at, state, lines = iter(mine), 0, []
        for e in audit:
            role, text = ("assistant" if state == 2 else "user"), ""
            if e != "I":
                _, own, text = next(at)
                role = own if e == "K" else role
            if e != "D":
                state = {**STEP, (0, "s"): 1}[state, role[0]]
                lines.append(f"{role}:{text}")
        out.append((conv, gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(seed):
    rnd = random.Random(seed)
    rows = []
    for conv in range(12):
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            rows.append((conv, rnd.choice([turn, turn, turn * 2]), role, rnd.choice(["Hi there.", "What? ", "cut off", "", " \n", None, f"No {turn}!"])))
    rows += [(50, None, "user", "One."), (50, None, "assistant", "Two."), (50, 3, "user", "One."), (51, None, None, None)]
    rows += [(None, 0, "user", "Nobody's."), (None, 1, "assistant", "Yes!"), (52, 0, "user", "x" * 100_000 + "."), (52, 5, "assistant", "é ß\t.")]
    rows += [(60, t, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(300)]  # far longer than the others
    rows += [(61, 0, "user", "Again.")] * 70  # copies of one row
    return rows


def repair(spark, rows, among=None):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    ids = None if among is None else spark.createDataFrame([(a, 1) for a in among], "conv_id long, x int")
    return sorted(map(tuple, turns.repair(df, ids).collect()), key=repr)


def test_verdicts_of_odd_conversations(spark):
    rows = talk(1)
    ids = list(dict.fromkeys(r[0] for r in rows)) + [77]
    assert repair(spark, rows, ids) == plain(rows, ids)


def test_repaired_rows_alternate_and_have_the_digest(spark):
    rows = talk(4)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    found = {}
    for r in sorted(turns.repaired(df).collect(), key=lambda r: r.position):
        found.setdefault(r.conv_id, []).append(r)
    for v in turns.repair(df).collect():
        mine = found.get(v.conv_id, [])
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == v.repaired_sha256
        initials = "".join(r.role[0] for r in mine).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2)


def test_no_rows(spark):
    assert repair(spark, []) == []
    assert repair(spark, [], [3]) == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("conv,turn", [(1, 2), (None, 4), (7, None), (123456789, 12), (20, 3), (3, 3), (5, 1)])
def test_damage_follows_the_checksum(spark, conv, turn):
    case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    got = [(r.role, r.text) for r in damage(spark.createDataFrame([(conv, turn, "assistant", "A. b? c! d")], "conv_id long, turn long, role string, text string")).collect()]
    want = {0: [], 1: [("assistant", "")], 2: [("assistant", "A b c d")], 3: [("assistant", "A. b? c! d")] * 2, 4: [("user", "A. b? c! d")]}
    assert got == want.get(case, [("assistant", "A. b? c! d")])
