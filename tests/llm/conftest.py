import random

import pytest

WORDS = [w.capitalize() if i % 7 == 0 else w for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega é ñ ß 12 3x".split())]
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _key int, _print int, _text int, _class int, _doc int, _mark int, _gone int, _lang int, kept int, n_words int, n_removed int, component int, token_ids int, c0 int"


def some_text(rnd, low, high, per_line=12):
    words = [rnd.choice(WORDS) + rnd.choice(["", "", "", str(rnd.randint(0, 99))]) for _ in range(rnd.randint(low, high))]
    return "\n".join(" ".join(words[i:i + per_line]) for i in range(0, len(words), per_line))


def odd_rows(seed=1, plain=30):
    """Null ids, texts and languages; empty, blank and long texts; equal, repeated and nearly equal rows."""
    rnd = random.Random(seed)
    texts = [some_text(rnd, 5, 120) for _ in range(plain)]
    near = texts[0].split(" ")
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, texts[0]), (101, texts[0]), (102, " ".join(near[:-1] + ["changed"])), (103, " ".join(near[:len(near) // 2]))]
    rows += [(5, texts[5]), (5, texts[5]), (6, "another text of the same id"), (None, texts[7]), (None, None), (200, None), (201, ""), (202, " \t\n "), (203, "one"), (204, "one two")]
    rows += [(300, some_text(rnd, 4000, 4000)), (301, "x" * 5000), (302, "a b " * 300)]
    return [(i, t, rnd.choice(["en", "fr", None]), "s", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, *range(14)) for r in odd_rows()], CLASHING).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def counted(rows):
    """Rows as a multiset that compares whatever their order."""
    return sorted(map(tuple, rows), key=repr)
