"""Quality rules: counts of a text's junk, and its perplexity under two n-gram models inside a band of its language.

Both are modified Kneser-Ney models over the bytes of all texts. Tasks count every 5-gram of unfolded bytes of every text, Spark adds
the counts up. From these counts come

* the model of the spelling, of order ``SPELLED`` over bytes as they are. It has as many n-grams as the corpus has, and is made
  by joins and windows over n-gram, context and shorter n-gram, none of which has more than 256 rows a key. An n-gram that one text
  alone has counts as unseen, so that a text is not judged by what was learnt from it;
* the model of the kinds, of order 4 over folded bytes: letters without case, one unit each for digits, white space and kinds of
  punctuation, and the low bits of the later bytes of other characters. 32 units make at most 32^4 n-grams a language (17 MB), so
  one task a language turns them into sorted arrays of n-gram hashes with log-probabilities and back-off weights. Languages are
  scored in blocks of ``LANGUAGES`` models.

What is broadcast is bounded: log-probabilities of the spelling go in blocks of ``BLOCK_BYTES``, each a pass over the texts.

Documents whose mean log-perplexity, by either model, lies more than ``below`` robust deviations under or ``above`` over the median of
their language are rejected: the one side holds texts of few patterns, the other noise. Both limits are wider for short texts,
whose mean varies more.

Copies and near copies of a text (one smallest hash of ``SPAN`` units) count as one text, in the models and in the band, however many
they are. The deviation of few texts is drawn to ``PRIOR`` of the median by the weight of ``FEW`` texts, and it is at least ``FLOOR``
of the median.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import BROADCAST_BYTES, small_batches
from ebbtide.runtime import materialize

ORDER, BITS = 4, 5
GRAMS = 1 << BITS * ORDER
SPELLED, BYTE = 5, 8
"""Order of the model over bytes as they are, and the bits of its units: an n-gram is a number below 2^40."""
HELD = 1 << 21
"""Distinct n-grams of texts that a task holds before it adds them up, and half of it before it hands them on."""
BLOCK_BYTES = BROADCAST_BYTES
"""Largest part of the spelling's model that is broadcast at once."""
LANGUAGES = 8
OWN_MODEL_UNITS = 100_000
"""A language with fewer units in the corpus shares the model and the band of all such languages and of null."""
BELOW, ABOVE, SHORT = 5.0, 4.0, 1_000
"""The upper limit is set by the labels of sf0.1: it rejects 57 of 571 texts labelled as junk which pass all else, and 21 of 3 409 clean ones."""
FLOOR, PRIOR, FEW = 0.01, 0.1, 10
"""Shares of the median loss, and a number of texts. On sf0.1 the deviations of the four languages are 1.2 to 2.1 % of the median."""
SPAN, WHOLE = 24, 1 << 24
"""Units of a window that marks copies; the weight of a text without copies, in whole numbers so that sums do not depend on their order."""
MIN_WORDS, MAX_REPEAT = 20, 30
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\r\x0b\x0c"
OTHERS = ""


def _folding() -> np.ndarray:
    unit = np.empty(256, np.int64)
    for b in range(256):
        c = chr(b)
        if c.isascii() and c.isalpha():
            unit[b] = ord(c.lower()) - ord("a")
        elif c in SPACE:
            unit[b] = 26
        elif c.isascii() and c.isdigit():
            unit[b] = 27
        elif c in ".,;:!?'\"-()":
            unit[b] = 28
        elif b < 128:
            unit[b] = 29 if c in SYMBOLS else 30
        else:
            unit[b] = 31 if b >= 0xC0 else b & 31
    return unit


UNIT = _folding()
START = np.full(ORDER - 1, UNIT[32])


def grams(text: bytes) -> np.ndarray:
    """The code of the n-gram that ends at each byte."""
    units = np.concatenate([START, UNIT[np.frombuffer(text, np.uint8)]])
    n = len(units) - ORDER + 1
    code = units[:n].copy()
    for k in range(1, ORDER):
        code <<= BITS
        code |= units[k:k + n]
    return code


def byte_grams(text: bytes) -> np.ndarray:
    """The number of the n-gram of ``SPELLED`` bytes that ends at each byte; spaces stand before the text."""
    units = np.frombuffer(b" " * (SPELLED - 1) + text, np.uint8)
    n = len(units) - SPELLED + 1
    code = np.zeros(n, np.int64)
    for k in range(SPELLED):
        code <<= BYTE
        code |= units[k:k + n]
    return code


def hashed(code: np.ndarray, order: int) -> np.ndarray:
    """Mixed 64-bit hash of n-grams of one order; codes below 2^20 do not collide."""
    x = (code.astype(np.uint64) | np.uint64(order << 32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sketch(code: np.ndarray) -> int:
    """The smallest hash of the windows of ``SPAN`` units, which nearly all near copies of a text share."""
    if len(code) <= SPAN:
        code = np.concatenate([code, np.zeros(SPAN + 1 - len(code), np.int64)])
    n = len(code) - SPAN
    x = np.zeros(n, np.uint64)
    for k in range(0, SPAN, ORDER):
        x = (x ^ code[k:k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return int(x.min().astype(np.int64))


def text_weights(docs: DataFrame) -> DataFrame:
    """(_lang, _print, _weight, _owner) of the texts that have copies or near copies: ``WHOLE`` is dealt out among all rows of one sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_lang": b["_lang"], "_print": b["_print"], "_sketch": [sketch(grams(t.encode())) for t in b["_text"]]})

    marks = docs.select("_lang", "_print", "_text").mapInPandas(run, "_lang string, _print long, _sketch long")
    marks = materialize(marks.groupBy("_lang", "_print", "_sketch").agg(F.count("*").alias("_n")))
    again = materialize(marks.groupBy("_lang", "_sketch").agg(F.sum("_n").alias("_all")).where("_all > 1"))
    weight = F.greatest(F.floor(F.lit(WHOLE) / F.col("_all")), F.lit(1)).cast("long")
    shared = marks.join(again, ["_lang", "_sketch"]).select("_lang", "_print", weight.alias("_weight"), F.col("_sketch").alias("_owner"))
    return materialize(shared.dropDuplicates(["_lang", "_print"]))


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(gram, n, lo, hi) with each n-gram once."""
    code, n, lo, hi = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n[order], first), np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first)


def count_grams(docs: DataFrame) -> DataFrame:
    """(_lang, gram, n, lo, hi): all n-grams of ``SPELLED`` bytes of whole texts; each task adds up what it has read before anything is shuffled.

    ``n`` is in parts of ``WHOLE``, as texts that share a sketch count as one text, their mean. ``lo`` and ``hi`` are the smallest and
    the largest mark of the texts that have the n-gram: equal, if it is one text alone (with its copies).
    """
    weights = text_weights(docs)
    small = weights.count() * 64 <= BROADCAST_BYTES
    weighed = docs.select("_lang", "_print", "_text").join(F.broadcast(weights) if small else weights, ["_lang", "_print"], "left")
    weighed = weighed.select("_lang", "_text", F.coalesce("_weight", F.lit(WHOLE)).alias("_weight"), F.coalesce("_owner", "_print").alias("_owner"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, ...]]] = {}
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                gram, n, lo, hi = _added(parts)
                many = lo != hi
                # Which texts they are no longer matters; equal numbers take less room.
                lo[many], hi[many] = 0, 1
                yield pd.DataFrame({"_lang": lang, "gram": gram, "n": n, "lo": lo, "hi": hi})
            held.clear()

        for b in batches:
            for lang, text, weight, owner in zip(b["_lang"], b["_text"], b["_weight"], b["_owner"], strict=True):
                if not text:
                    continue
                gram, n = np.unique(byte_grams(text.encode()), return_counts=True)
                mark = np.full(len(gram), owner)
                held.setdefault(lang, []).append((gram, n * weight, mark, mark))
                size += len(gram)
                if size > HELD or len(held) > LANGUAGES:
                    for name in held:
                        held[name] = [_added(held[name])]
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD // 2 or len(held) > LANGUAGES:
                        yield from flush()
                        size = 0
        yield from flush()

    counted = weighed.mapInPandas(run, "_lang string, gram long, n long, lo long, hi long")
    return counted.groupBy("_lang", "gram").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _whole(n: Column) -> Column:
    """A count in texts; a gram counts once at least."""
    return F.greatest(F.round(n / WHOLE), F.lit(1)).cast("long")


def fold_grams(counts: DataFrame) -> DataFrame:
    """(_lang, gram, n) over folded bytes, the last ``ORDER`` of each n-gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            code, out = b["gram"].to_numpy(np.int64), np.zeros(len(b), np.int64)
            for k in reversed(range(ORDER)):
                out = out << BITS | UNIT[code >> BYTE * k & 255]
            yield pd.DataFrame({"_lang": b["_lang"], "gram": out.astype(np.int32), "n": b["n"]})

    folded = counts.select("_lang", "gram", "n").mapInPandas(run, "_lang string, gram int, n long")
    return folded.groupBy("_lang", "gram").agg(_whole(F.sum("n")).alias("n"))


def spelling(counts: DataFrame, order: int = SPELLED, bits: int = BYTE) -> DataFrame:
    """(_lang, gram, log): the log-probability of every n-gram of ``counts`` (a written table) after its first ``order - 1`` units.

    The highest order uses counts, the lower ones the number of different units in front. Discounts are those of all n-grams; of those that
    one text alone has the whole count is taken off and left to the shorter n-gram, down to the uniform distribution over units.
    """
    levels = [counts.select("_lang", "gram", _whole(F.col("n")).alias("n"), "lo", "hi")]
    for k in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << bits * k) - 1)).alias("gram")
        levels.append(materialize(levels[-1].groupBy("_lang", shorter).agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))))
    lower = None
    for k, level in enumerate(reversed(levels), 1):
        level = level.join(materialize(_discounts(level)), "_lang")
        taken = F.when((F.col("lo") == F.col("hi")) | (F.col("n") == 0), F.col("n")).otherwise(F.element_at("_cut", F.least("n", F.lit(3)).cast("int")))
        # At most 2^bits rows have one context.
        after = Window.partitionBy("_lang", F.shiftright("gram", bits)).orderBy("gram").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        level = level.select("_lang", "gram", "n", taken.alias("_taken"), F.sum("n").over(after).alias("_total"), F.sum(taken).over(after).alias("_left"))
        if lower is None:
            level = level.withColumn("_down", F.lit(1.0 / (1 << bits)))
        else:
            level = level.withColumn("_short", F.col("gram").bitwiseAND(F.lit((1 << bits * (k - 1)) - 1)))
            level = level.join(lower.select("_lang", F.col("gram").alias("_short"), F.col("p").alias("_down")), ["_lang", "_short"])
        p = (F.col("n") - F.col("_taken") + F.col("_left") * F.col("_down")) / F.col("_total")
        lower = materialize(level.select("_lang", "gram", p.alias("p")))
    return materialize(lower.select("_lang", "gram", F.log("p").cast("float").alias("log")))


def _discounts(level: DataFrame) -> DataFrame:
    """(_lang, _cut): what is taken off a count of one, two and more, as in :func:`kneser_ney`."""
    seen = level.groupBy("_lang").agg(*[F.count_if(F.col("n") == i).alias(f"_{i}") for i in (1, 2, 3, 4)])
    y = F.when(F.col("_1") > 0, F.col("_1") / (F.col("_1") + 2 * F.col("_2"))).otherwise(0.5)
    cut = [F.when(F.col(f"_{i}") > 0, F.least(F.greatest(i - (i + 1) * y * F.col(f"_{i + 1}") / F.col(f"_{i}"), F.lit(0.0)), F.lit(float(i)))).otherwise(0.5) for i in (1, 2, 3)]
    return seen.select("_lang", F.array(*cut).alias("_cut"))


def kneser_ney(code: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order, lowest first: sorted hashes, log-probabilities of n-grams and log back-off weights of them as contexts.

    The highest order uses counts, the lower ones the number of different units in front (continuation counts). Probabilities
    are interpolated down to the uniform distribution over units, so every n-gram has one.
    """
    tables = {ORDER: (code, count)}
    for k in range(ORDER - 1, 0, -1):
        below = np.bincount(tables[k + 1][0] & ((1 << BITS * k) - 1), minlength=1 << BITS * k)
        seen = np.flatnonzero(below)
        tables[k] = (seen, below[seen])
    lower, out = np.full(1, 1 / (1 << BITS)), []
    weights: dict[int, np.ndarray] = {}
    dense = lower
    for k in range(1, ORDER + 1):
        c, n = tables[k]
        ones, twos, threes, fours = (np.count_nonzero(n == i) for i in (1, 2, 3, 4))
        y = ones / (ones + 2 * twos) if ones else 0.5
        cut = np.array([0.0] + [min(max(i - (i + 1) * y * b / a, 0.0), i) if a else 0.5 for i, a, b in ((1, ones, twos), (2, twos, threes), (3, threes, fours))])
        taken = cut[np.minimum(n, 3)]
        context, size = c >> BITS, 1 << BITS * (k - 1)
        total = np.bincount(context, n, size)
        back = np.divide(np.bincount(context, taken, size), total, out=np.ones(size), where=total > 0)
        down = dense[c & ((1 << BITS * (k - 1)) - 1)] if k > 1 else lower[0]
        p = (n - taken) / total[context] + back[context] * down
        weights[k - 1] = back
        out.append((c, p))
        if k < ORDER:
            # Probabilities of all n-grams of this order, those not seen by their context's back-off weight.
            every = np.arange(1 << BITS * k)
            dense = back[every >> BITS] * (dense[every & ((1 << BITS * (k - 1)) - 1)] if k > 1 else lower[0])
            dense[c] = p
    model = []
    for k, (c, p) in enumerate(out, 1):
        h = hashed(c, k)
        order = np.argsort(h)
        bow = np.log(np.maximum(weights[k][c], 1e-12)) if k < ORDER else np.zeros(len(c))
        model.append((h[order], np.log(np.maximum(p, 1e-300))[order].astype(np.float32), bow[order].astype(np.float32)))
    # The weight of the empty context, for units that the corpus does not have.
    model.append((np.zeros(1, np.uint64), np.log(np.maximum(weights[0] * lower, 1e-12)).astype(np.float32), np.zeros(1, np.float32)))
    return model


class Model:
    """Look-ups in the sorted arrays; a code is looked up once, then remembered."""

    def __init__(self, arrays: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.arrays, self.unseen = arrays[:ORDER], float(arrays[ORDER][1][0])
        self.known = np.full(GRAMS, np.nan, np.float32)

    def _find(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        h, (have, _, _) = hashed(code, k), self.arrays[k - 1]
        at = np.minimum(np.searchsorted(have, h), len(have) - 1)
        return at, have[at] == h

    def _log(self, code: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full(len(code), self.unseen)
        at, found = self._find(code, k)
        out = self.arrays[k - 1][1][at].astype(np.float64)
        rest = code[~found]
        if len(rest):
            down = self._log(rest & ((1 << BITS * (k - 1)) - 1), k - 1)
            if k > 1:
                at, seen = self._find(rest >> BITS, k - 1)
                down += np.where(seen, self.arrays[k - 2][2][at], 0.0)
            out[~found] = down
        return out

    def loss(self, code: np.ndarray) -> float:
        """Mean negative log-probability of the n-grams."""
        value = self.known[code]
        new = np.isnan(value)
        if new.any():
            fresh = np.unique(code[new])
            self.known[fresh] = self._log(fresh, ORDER)
            value = self.known[code]
        return -float(value.mean(dtype=np.float64))


def train(counts: DataFrame) -> DataFrame:
    """One row per language with its arrays; a language has at most 32^4 counts, so one task holds them."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        model = kneser_ney(group["gram"].to_numpy(np.int64), group["n"].to_numpy(np.int64))
        return pd.DataFrame({"_lang": [group["_lang"].iloc[0]], "hashes": [[h.tobytes() for h, _, _ in model]],
                             "logs": [[p.tobytes() for _, p, _ in model]], "backs": [[b.tobytes() for _, _, b in model]]})

    return counts.groupBy("_lang").applyInPandas(fit, "_lang string, hashes array<binary>, logs array<binary>, backs array<binary>")


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; words are split at the six ASCII white spaces."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACE))
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            repeats += line in seen
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeats, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in 8-word windows that occur at least twice; windows are numbered exactly, by doubling."""
    if len(words) < 9:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    for width in (1, 2, 4):
        pair = ids[:-width] * (len(words) + 1) + ids[width:]
        _, ids, count = np.unique(pair, return_inverse=True, return_counts=True)
        if len(count) == len(pair):
            return 0  # no shorter window occurs twice
    again = np.flatnonzero(count[ids] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + 8, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_units long, loss double, _spelled double, _sketch long"

LOSSES = ("loss", "spelled")

Logs = dict[str, tuple[np.ndarray, np.ndarray]]
"""Per language n-grams in ascending order and their log-probabilities."""


def _logs(model: DataFrame) -> Logs:
    """A block of the spelling's model; at most ``BLOCK_BYTES`` come to the driver at once."""
    rows = model.select("_lang", "gram", "log").toArrow()
    lang, gram, log = rows["_lang"].to_numpy(), rows["gram"].to_numpy(), rows["log"].to_numpy()
    out = {}
    for name in set(lang):
        mine = np.flatnonzero(lang == name)
        mine = mine[np.argsort(gram[mine])]
        out[name] = gram[mine], log[mine]
    return out


def _spelled_loss(text: bytes, lang: str, logs: Logs) -> float:
    """The part of a text's negative log-probability that the n-grams of this block have."""
    if lang not in logs or not text:
        return 0.0
    gram, log = logs[lang]
    code = np.sort(byte_grams(text))  # looked up in order, neighbours are near in memory
    at = np.minimum(np.searchsorted(gram, code), len(gram) - 1)
    return -float(log[at][gram[at] == code].sum(dtype=np.float64))


def _more_spelled(docs: DataFrame, logs: Logs) -> DataFrame:
    """(_lang, _print, _more): the parts of another block, once for each text."""
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            more = [_spelled_loss(t.encode(), lang, shared.value) for lang, t in zip(b["_lang"], b["_text"], strict=True)]
            yield pd.DataFrame({"_lang": b["_lang"], "_print": b["_print"], "_more": more})

    parts = docs.select("_lang", "_print", "_text").mapInPandas(run, "_lang string, _print long, _more double")
    return materialize(parts.groupBy("_lang", "_print").agg(F.max("_more").alias("_more")))


def _score(docs: DataFrame, models: dict[str, list], logs: Logs, key_type: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((models, logs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {lang: Model(arrays) for lang, arrays in shared.value[0].items()}
        spelled = shared.value[1]
        names = [f.split()[0] for f in STATS.split(", ")]
        for b in batches:
            rows = []
            for lang, text in zip(b["_lang"], b["_text"], strict=True):
                raw = text.encode()
                code = grams(raw)
                rows.append((*text_stats(text), len(code), ready[lang].loss(code) if len(code) else 0.0, _spelled_loss(raw, lang, spelled), sketch(code)))
            stats = pd.DataFrame(rows, columns=names, index=b.index)
            yield pd.concat([b[["_key", "_print", "_lang"]], stats], axis=1)

    return docs.mapInPandas(run, f"_key {key_type}, _print long, _lang string, {STATS}")


def assess(docs: DataFrame, below: float = BELOW, above: float = ABOVE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, _print (the hash of the text), and for both models
    the mean loss and the limits of its band: loss, low, high (kinds), spelled, spelled_low, spelled_high (bytes).

    A row per row of ``docs``, repeated rows included. A null text counts as empty: no words, base failed. A null language and
    languages with little text share one model. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_print"), F.coalesce(F.col(lang), F.lit(OTHERS)).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    key_type = given.schema["_key"].dataType.simpleString()
    units = materialize(given.groupBy("_lang").agg(F.sum(F.octet_length("_text")).alias("units")))
    own = units.where((F.col("units") >= OWN_MODEL_UNITS) & (F.col("_lang") != OTHERS)).select("_lang", F.col("_lang").alias("_model"))
    given = given.join(own, "_lang", "left").withColumn("_lang", F.coalesce("_model", F.lit(OTHERS))).drop("_model")
    counts = materialize(count_grams(given))
    spelt = spelling(counts)
    fitted = materialize(train(fold_grams(counts)))
    langs = sorted(r[0] for r in fitted.select("_lang").collect())
    scored = []
    for i in range(0, max(len(langs), 1), LANGUAGES):
        block = langs[i:i + LANGUAGES]
        models = {
            r["_lang"]: [(np.frombuffer(h, np.uint64), np.frombuffer(p, np.float32), np.frombuffer(b, np.float32)) for h, p, b in zip(r["hashes"], r["logs"], r["backs"], strict=True)]
            for r in fitted.where(F.col("_lang").isin(block)).collect()}
        # Texts of languages without a model are empty ones; they come with the first block.
        mine = F.col("_lang").isin(block) if i else ~F.col("_lang").isin(langs[LANGUAGES:])
        models.setdefault(OTHERS, models.get(OTHERS) or _empty_model())
        known = spelt.where(F.col("_lang").isin(block))
        n = max(1, -(-known.count() * 12 // BLOCK_BYTES))
        parts = [known.where(F.pmod(F.xxhash64("gram"), F.lit(n)) == b) for b in range(n)]
        part = materialize(_score(given.where(mine), models, _logs(parts[0]), key_type))
        for more in parts[1:]:
            part = part.join(_more_spelled(given.where(mine), _logs(more)), ["_lang", "_print"])
            part = part.withColumn("_spelled", F.col("_spelled") + F.col("_more")).drop("_more")
        scored.append(part)
    stats = scored[0]
    for more in scored[1:]:
        stats = stats.unionByName(more)
    stats = materialize(stats.withColumn("spelled", F.col("_spelled") / F.greatest("n_units", F.lit(1))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    # The bands are those of the texts which pass the plain rules, one of each sketch.
    normal = stats.where(~failed).groupBy("_lang", "_sketch").agg(F.min(F.struct("_print", *LOSSES)).alias("_one")).select("_lang", *[f"_one.{x}" for x in LOSSES])
    normal = materialize(normal)
    middle = materialize(normal.groupBy("_lang").agg(*[_median(F.col(x)).alias(f"_mid_{x}") for x in LOSSES], F.count("*").alias("_texts")))
    apart = [_median(F.abs(F.col(x) - F.col(f"_mid_{x}"))).alias(f"_mad_{x}") for x in LOSSES]
    spread = materialize(normal.join(middle, "_lang").groupBy("_lang", "_texts", *[f"_mid_{x}" for x in LOSSES]).agg(*apart))
    out, inside = stats.join(spread, "_lang", "left"), F.lit(True)
    for x, low, high in (("loss", "low", "high"), ("spelled", "spelled_low", "spelled_high")):
        mid = F.col(f"_mid_{x}")
        drawn = (F.col("_texts") * 1.4826 * F.col(f"_mad_{x}") + FEW * PRIOR * mid) / (F.col("_texts") + FEW)
        sigma = F.greatest(drawn, FLOOR * mid) * F.sqrt(1 + SHORT / F.greatest("n_units", F.lit(1)))
        out = out.withColumn(low, mid - below * sigma).withColumn(high, mid + above * sigma)
        inside &= F.coalesce(F.col(x).between(F.col(low), F.col(high)), F.lit(True))
    return out.select(F.col("_key").alias(key), "_print", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      (~failed & inside).alias("kept"), "loss", "low", "high", "spelled", "spelled_low", "spelled_high")


def _median(value: Column) -> Column:
    """Half way between the lower and the upper one."""
    return (F.percentile_approx(value, 0.5, 100_000) - F.percentile_approx(-value, 0.5, 100_000)) / 2


def _empty_model() -> list:
    return kneser_ney(np.array([0]), np.array([1]))
