"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates that pass their own checks (Luhn, mod 97, calendar, octets, number plans), e-mail addresses and credentials are
replaced by others of the same format, by a keyed permutation. A value therefore has the same pseudonym wherever it stands, however it
is punctuated; two values never share one; and who holds the key can undo it. Check digits are computed anew, so pseudonyms are valid.

Only DataFrame functions are used. Texts without digits, ``@``, an equals sign or the mark of an access key are returned as they are; in the others one pattern
finds all values, and the text is put together again from the gaps and the pseudonyms. No rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}+",
    "secret": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bpassword=[^\s]+|\btoken = \"[^\"\s]+\"",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b",
    "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{2}[./][0-9]{2}[./][0-9]{4}\b",
    "ip": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b(?!\.[0-9])",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
}
"""What is looked for, first match wins. A mailbox is tried from the start of its run only and no part gives back what it took, so long
tokens cost their length; a domain has at most 128 parts, more than any real one, so the pattern's depth is bounded."""
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
DAYS = (184, 397)
"""Days from 1900-01-01 on, as a product; the one day of 2099 beyond them stands for itself."""


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _stream(secret: str, tweak: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), tweak.cast("string"), other.cast("string")), 512)


def _number(secret: str, tweak: Column, other: Column, modulus: int) -> Column:
    return F.pmod(F.conv(F.substring(_stream(secret, tweak, other), 1, 15), 16, 10).cast("long"), F.lit(modulus))


def permute_pair(left: Column, right: Column, sizes: tuple[int, int], secret: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the pairs below ``sizes``, as a struct (l, r)."""
    m, n = sizes
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(at: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(F.pmod(at.l + _number(secret, i, at.r, m), F.lit(m)).alias("l"), at.r.alias("r"))).otherwise(
            F.struct(at.l.alias("l"), F.pmod(at.r + _number(secret, i, at.l, n), F.lit(n)).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step)


def _shift(char: Column, by: Column) -> Column:
    """A digit or letter moved on within its class; anything else as it is."""
    code = F.ascii(char)
    def turn(base: str, size: int) -> Column:
        return F.char(F.lit(ord(base)) + F.pmod(code - ord(base) + by, F.lit(size)))
    return (F.when(code.between(48, 57), turn("0", 10)).when(code.between(97, 122), turn("a", 26)).when(code.between(65, 90), turn("A", 26)).otherwise(char))


def permute_text(value: Column, secret: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of texts that keeps the class of every character: digits, small and capital letters, others fixed."""
    n = F.length(value)
    half = (n / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, n).alias("r"))

    def moved(side: Column, other: Column, i: Column) -> Column:
        place = F.sequence(F.lit(1), F.length(side))

        def chars(hexes: Column) -> Column:
            return F.array_join(F.transform(place, lambda k: bind(F.substring(side, k, F.lit(1)), lambda c: _shift(
                c, F.conv(F.substring(hexes, 2 * F.pmod(k - 1, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")))), "")

        return F.when(F.length(side) > 0, bind(_stream(secret, i, other), chars)).otherwise(side)

    def step(at: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(moved(at.l, at.r, i).alias("l"), at.r.alias("r"))).otherwise(
            F.struct(at.l.alias("l"), moved(at.r, at.l, i).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda end: F.concat(end.l, end.r))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(layout: Column, chars: Column, pattern: str) -> Column:
    """``layout`` with its characters of ``pattern`` replaced by ``chars`` in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def fill(chars: Column) -> Column:
        def step(at: Column, c: Column) -> Column:
            return F.when(c.rlike(pattern), F.struct(F.concat(at.s, F.substring(chars, at.i, F.lit(1))).alias("s"), (at.i + 1).alias("i"))).otherwise(
                F.struct(F.concat(at.s, c).alias("s"), at.i.alias("i")))

        return F.aggregate(F.split(layout, ""), start, step, lambda at: at.s)

    return bind(chars, fill)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum by Luhn's rule over bound digits; ``doubled`` is 1 if the last digit is doubled and 0 if the one before it is."""
    n = F.length(digits)

    def step(total: Column, k: Column) -> Column:
        return bind(F.substring(digits, n - k, F.lit(1)).cast("int"), lambda d: total + F.when(
            (k + doubled) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)


def _card(value: Column, secret: str) -> tuple[Column, Column]:
    valid = bind(_digits(value), lambda digits: F.length(digits).between(13, 19) & (_luhn_sum(digits, 0) % 10 == 0))
    # The first digit says which scheme it is and stays; the last is the check digit.
    body = bind(_digits(value), lambda digits: F.concat(
        F.substring(digits, 1, 1), permute_text(F.substring(digits, F.lit(2), F.length(digits) - 2), secret)))
    new = bind(body, lambda body: F.concat(body, F.pmod(10 - _luhn_sum(body, 1) % 10, F.lit(10)).cast("string")))
    return valid, _refill(value, new, "[0-9]")


def _mod97(letters: Column) -> Column:
    def step(rest: Column, c: Column) -> Column:
        n = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(F.when(n > 9, rest * 100 + n).otherwise(rest * 10 + n), F.lit(97))

    return F.aggregate(F.split(letters, ""), F.lit(0), step)


def _iban(value: Column, secret: str) -> tuple[Column, Column]:
    bare = F.replace(value, F.lit(" "), F.lit(""))
    country, own = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    valid = F.length(bare).between(15, 34) & (_mod97(F.concat(own, F.substring(bare, 1, 4))) == 1)
    new = bind(permute_text(own, secret), lambda own: F.concat(
        country, F.lpad((98 - _mod97(F.concat(own, country, F.lit("00")))).cast("string"), 2, "0"), own))
    return valid, _refill(value, new, "[A-Z0-9]")


def _phone(value: Column, secret: str) -> tuple[Column, Column]:
    digits = _digits(value)
    n = F.length(digits)
    american = (n == 10) & ~value.startswith("+") | (n == 11) & value.startswith("+1")
    local = F.right(digits, F.lit(10))
    plan = american & local.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    # The leading digits of the area and the exchange have a rule of their own and stay, as does a country code.
    new = bind(permute_text(F.concat(F.substring(local, 2, 2), F.substring(local, 5, 6)), secret), lambda moved: F.concat(
        F.substring(digits, F.lit(1), n - 10), F.substring(local, 1, 1), F.substring(moved, 1, 2), F.substring(local, 4, 1), F.substring(moved, 3, 6)))
    abroad = F.concat(F.substring(digits, 1, 3), permute_text(F.substring(digits, F.lit(4), n), secret))
    loose = value.startswith("+") & n.between(8, 15)
    return plan | loose, _refill(value, F.when(plan, new).otherwise(abroad), "[0-9]")


def _date(value: Column, secret: str) -> tuple[Column, Column]:
    iso = value.rlike("^[0-9]{4}-")
    sep = F.substring(value, 3, 1)
    day = F.when(iso, F.try_to_date(value, "yyyy-MM-dd")).otherwise(F.try_to_date(F.translate(value, "./", "--"), "dd-MM-yyyy"))
    at = F.date_diff(day, F.lit("1900-01-01").cast("date"))
    a, b = DAYS
    pair = permute_pair((at / b).cast("int"), F.pmod(at, F.lit(b)), DAYS, secret)
    inside = at.between(0, a * b - 1)
    new = bind(pair, lambda pair: F.date_add(F.lit("1900-01-01").cast("date"), (pair.l * b + pair.r).cast("int")))
    written = bind(new, lambda new: F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(
        F.concat(F.date_format(new, "dd"), sep, F.date_format(new, "MM"), sep, F.date_format(new, "yyyy"))))
    return F.coalesce(inside, F.lit(False)), written


def _ip(value: Column, secret: str) -> tuple[Column, Column]:
    part = [F.split_part(value, F.lit("."), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    valid = (part[0] < 256) & (part[1] < 256) & (part[2] < 256) & (part[3] < 256) & ~value.rlike(r"\b0[0-9]")
    pair = permute_pair(part[0] * 256 + part[1], part[2] * 256 + part[3], (1 << 16, 1 << 16), secret)
    return valid, bind(pair, lambda pair: F.concat_ws(
        ".", *(x.cast("string") for half in (pair.l, pair.r) for x in (F.floor(half / 256), F.pmod(half, F.lit(256))))))


def _ssn(value: Column, secret: str) -> tuple[Column, Column]:
    area, group, serial = (F.split_part(value, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    # 898 areas, 99 groups, 9999 serial numbers.
    pair = permute_pair(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), secret)
    return valid, bind(pair, lambda pair: F.concat_ws(
        "-", F.lpad((pair.l + 1 + F.when(pair.l >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
        F.lpad((F.floor(pair.r / 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(pair.r, F.lit(9999)) + 1).cast("string"), 4, "0")))


def _email(value: Column, secret: str) -> tuple[Column, Column]:
    # The mailbox is permuted; the domain says nothing about a person and stays.
    name = F.split_part(value, F.lit("@"), F.lit(1))
    return F.lit(True), F.concat(permute_text(name, secret), F.substring(value, F.length(name) + 1, F.length(value)))


def _secret(value: Column, secret: str) -> tuple[Column, Column]:
    name = F.regexp_extract(value, "^(AKIA|ASIA|password=|token = )", 1)  # says what it is and stays
    return F.lit(True), F.concat(name, permute_text(F.substring(value, F.length(name) + 1, F.length(value)), secret))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card}


def pseudonym(value: Column, secret: str) -> Column:
    """The pseudonym of a found value, or the value itself if it does not pass its check."""
    out = F.when(F.lit(False), value)
    for kind, pattern in KINDS.items():
        whole = value.rlike(f"^(?:{pattern})$")
        valid, new = MAKERS[kind](value, f"{secret}/{kind}")
        out = out.when(whole & valid, new)
    return out.otherwise(value)


def pseudonymise(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text with pseudonyms, n_found (values replaced) and found (their originals), a row per row of ``docs``.

    A null text stays null with nothing found; an empty one stays empty. Repeated rows and null keys are kept as they are. Values that
    fail their check are left. Other columns are not read.
    """
    given = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    some = F.col("_text").rlike("[0-9@=]|A[KS]IA")
    none = F.array().cast("array<string>")
    found = given.withColumn("_values", F.when(some, F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0))).otherwise(none))
    found = found.withColumn("_new", F.transform("_values", lambda v: pseudonym(v, secret)))
    gaps = F.split("_text", PATTERN, -1)
    whole = F.concat(F.array_join(F.zip_with(gaps, F.concat("_new", F.array(F.lit(""))), lambda gap, new: F.concat(gap, new)), ""))
    out = found.withColumn("_out", F.when(F.size("_values") > 0, whole).otherwise(F.col("_text")))
    changed = F.filter(F.zip_with("_values", "_new", lambda v, n: F.when(v != n, v)), lambda v: v.isNotNull())
    return out.select(F.col("_key").alias(key), F.col("_out").alias(text), F.size(changed).cast("long").alias("n_found"), changed.alias("found"))
