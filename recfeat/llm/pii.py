"""Format-preserving pseudonyms for personal numbers, dates and addresses, with DataFrame functions only.

A Feistel network keyed by a secret permutes each value within its own format: a card number of a known issuer that
passes the Luhn test becomes another of that issuer that does, an account number (IBAN) another of its country with the
right check digits, a date another date, a telephone number another of the same shape whose area and exchange are
as valid as they were.  Equal values get equal pseudonyms in all documents, and different values of a kind get different
ones.  What fails its validation (a long number without a right check digit or issuer, 2023-02-31, 999.1.2.3) is
left as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10

# Fixed formats.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9+])[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])",
}
#: Card numbers of known issuers: their first digits with the lengths in use.
ISSUERS = (
    r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}"
    r"|3(?:0[0-5]|[689][0-9])[0-9]{11}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12,15}|62[0-9]{14,17}|(?:50|5[6-8]|63|67)[0-9]{11,17})$"
)
KINDS = tuple(PATTERNS)
#: Leading digits of a card number that tell its issuer and stay.
ISSUER_DIGITS = 4
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"([ -])", r"(?<sep>[ -])").replace(r"\1", r"\k<sep>")

#: Days of 1900-01-01 .. 2099-12-31 are 17 x 4297; numbers of persons are 898 x 99 areas and groups x 9999 serials.
_DAYS = (17, 4297)
_PERSONS = (898 * 99, 9999)


def _noise(key: str, tweak: str, r: Column, x: Column) -> Column:
    """A keyed 56-bit value."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), r.cast("string"), x.cast("string")).cast("binary"), 256), 1, 14), 16, 10).cast("long")


def feistel(a: Column, b: Column, of_a: Column, of_b: Column, key: str, tweak: str) -> Column:
    """The pair (a, b), a < of_a and b < of_b, as another such pair: a keyed permutation, rounds on either half in turn."""

    def step(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(((s["a"] + _noise(key, tweak, r, s["b"])) % of_a).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), ((s["b"] + _noise(key, tweak, r, s["a"])) % of_b).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _tens(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(19)]), n + 1)


def _letters26(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(26**i).cast("long") for i in range(14)]), n + 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _permute_digits(d: Column, key: str, tweak: str) -> Column:
    """Another string of as many digits (1 to 36)."""
    u = F.floor(F.length(d) / 2).cast("int")
    v = (F.length(d) - u).cast("int")
    head = F.coalesce(F.substring(d, F.lit(1), u).try_cast("long"), F.lit(0).cast("long"))
    tail = F.substring(d, u + 1, v).try_cast("long")
    out = feistel(head, tail, _tens(u), _tens(v), key, tweak)
    return F.concat(F.when(u > 0, F.lpad(out["a"].cast("string"), u, "0")).otherwise(F.lit("")), F.lpad(out["b"].cast("string"), v, "0"))


def _refill(m: Column, new: Column, kind: str) -> Column:
    """``m`` with its characters of class ``kind`` replaced by those of ``new``, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    return F.aggregate(
        F.split(m, ""), start,
        lambda s, c: F.when(c.rlike(kind), F.struct(F.concat(s["out"], F.substring(new, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))),
        lambda s: s["out"],
    )


def _luhn(d: Column) -> Column:
    """The Luhn sum of a digit string modulo 10."""
    return F.aggregate(
        F.split(F.reverse(d), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")),
        lambda s, c: F.struct((s["sum"] + _luhn_term(c.try_cast("int"), s["i"])).alias("sum"), (s["i"] + 1).alias("i")),
        lambda s: s["sum"] % 10,
    )


def _luhn_term(x: Column, i: Column) -> Column:
    twice = 2 * x
    return F.when(i % 2 == 0, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    # The check digit follows from the others, so permuting the others permutes the valid numbers.
    head = F.substring(d, 1, ISSUER_DIGITS)
    body = F.concat(head, _permute_digits(F.substring(d, F.lit(ISSUER_DIGITS + 1), n - ISSUER_DIGITS - 1), key, "card"))
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    return F.when(d.rlike(ISSUERS) & (_luhn(d) == 0), _refill(m, F.concat(body, check.cast("string")), "[0-9]")).otherwise(m)


def _mod97(s: Column) -> Column:
    """The remainder by 97 of a string of digits and letters, a letter counting as its number from 10 on."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: ((acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int"))


def _iban(m: Column, key: str) -> Column:
    """The digits of the account are permuted, country and letters stay, and the check digits follow."""
    plain = F.regexp_replace(m, " ", "")
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    digits = _digits(account)
    new = F.when(F.length(digits).between(2, 36), _refill(account, _permute_digits(digits, key, "iban"), "[0-9]")).otherwise(account)
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    valid = (_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34)
    return F.when(valid, _refill(m, F.concat(country, check, new), "[A-Z0-9]")).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """Area and exchange codes begin with 2 to 9; each stays on its side of that rule."""
    head = F.when(m.startswith("+1"), F.lit("+1")).otherwise(F.lit(""))
    rest = F.substring(m, F.length(head) + 1, F.length(m))
    d = _digits(rest)
    area, exchange, line = (F.substring(d, a, n).try_cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    low = [F.when(x < 200, 0).otherwise(200) for x in (area, exchange)]
    many = [F.when(x < 200, 200).otherwise(800) for x in (area, exchange)]
    out = feistel((area - low[0]) * many[1] + exchange - low[1], line, many[0] * many[1], F.lit(10_000), key, "phone")
    new = [F.floor(out["a"] / many[1]) + low[0], out["a"] % many[1] + low[1], out["b"]]
    return F.concat(head, _refill(rest, F.concat(*[F.lpad(x.cast("string"), n, "0") for x, n in zip(new, (3, 3, 4), strict=True)]), "[0-9]"))


def _ip(m: Column, key: str) -> Column:
    p = F.split(m, r"\.")
    o = [F.get(p, F.lit(i)).try_cast("long") for i in range(4)]
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    parts = [F.floor(out["a"] / 256), out["a"] % 256, F.floor(out["b"] / 256), out["b"] % 256]
    return F.when(F.greatest(*o) <= 255, F.concat_ws(".", *[x.cast("long").cast("string") for x in parts])).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).try_cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area < 666, area - 1).otherwise(area - 2)
    out = feistel(place * 99 + group - 1, serial - 1, F.lit(_PERSONS[0]), F.lit(_PERSONS[1]), key, "ssn")
    at = F.floor(out["a"] / 99)
    new = F.concat_ws(
        "-", F.lpad(F.when(at < 665, at + 1).otherwise(at + 2).cast("string"), 3, "0"),
        F.lpad((out["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((out["b"] + 1).cast("string"), 4, "0"),
    )
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), new).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso = m.contains("-")
    y = F.when(iso, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4))
    mo = F.when(iso, F.substring(m, 6, 2)).otherwise(F.substring(m, 1, 2))
    d = F.when(iso, F.substring(m, 9, 2)).otherwise(F.substring(m, 4, 2))
    day = F.concat_ws("-", y, mo, d).try_cast("date")
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))
    out = feistel(F.floor(n / _DAYS[1]), n % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, "date")
    new = F.date_add(F.lit("1900-01-01").cast("date"), (out["a"] * _DAYS[1] + out["b"]).cast("int"))
    text = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.date_format(new, "MM/dd/yyyy"))
    return F.when(n.between(0, _DAYS[0] * _DAYS[1] - 1), text).otherwise(m)


def _permute_letters(letters: Column, key: str, tweak: str) -> Column:
    """Another string of as many letters a-z (0 to 26)."""
    n = F.length(letters)
    u = F.floor(n / 2).cast("int")

    def number(s: Column) -> Column:
        return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.ascii(c) - 97)

    def word(x: Column, k: Column) -> Column:
        places = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, lambda i: F.char(97 + F.call_function("div", x, _letters26(k - i)) % 26)), "")

    out = feistel(number(F.substring(letters, F.lit(1), u)), number(F.substring(letters, u + 1, n)), _letters26(u), _letters26(n - u), key, tweak)
    return F.when(n > 0, F.concat(word(out["a"], u), word(out["b"], n - u))).otherwise(F.lit(""))


def _in_pieces(s: Column, size: int, most: int, permute) -> Column:
    """``s`` permuted by pieces of ``size`` characters, each piece with a tweak of its own; up to ``most`` characters."""
    first = permute(F.substring(s, 1, size), "email")
    whole = first
    for i in range(1, -(-most // size)):
        piece = F.substring(s, i * size + 1, size)
        whole = F.concat(whole, F.when(F.length(s) > i * size, permute(piece, f"email{i}")).otherwise(F.lit("")))
    return F.when(F.length(s) > size, whole).otherwise(first)


def _email(m: Column, key: str) -> Column:
    """Letters become letters and digits digits; the domain stays.  Case is folded, as it tells no addresses apart."""
    local = F.lower(F.substring_index(m, "@", 1))
    domain = F.lower(F.substring_index(m, "@", -1))
    letters, digits = F.regexp_replace(local, "[^a-z]", ""), _digits(local)
    name = _refill(local, _in_pieces(letters, 26, 64, lambda p, t: _permute_letters(p, key, t)), "[a-z]")
    name = F.when(F.length(digits) > 0, _refill(name, _in_pieces(digits, 36, 64, lambda p, t: _permute_digits(p, key, t)), "[0-9]")).otherwise(name)
    return F.concat_ws("@", name, domain)


def kind_of(m: Column) -> Column:
    """Which kind of value a match is; null if none."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    make = {"email": _email, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "iban": _iban, "card": _card}
    out = m
    for k in KINDS:
        out = F.when(kind == k, make[k](m, key)).otherwise(out)
    return out


def keep_secret(spark: SparkSession, key: str) -> None:
    """Hide the key wherever the session shows plans: in explain, the UI and event logs it stands as redacted."""
    name, hidden = "spark.sql.redaction.string.regex", re.escape(key)
    before = spark.conf.get(name, None)
    if not before:
        spark.conf.set(name, hidden)
    elif hidden not in before.split("|"):
        spark.conf.set(name, f"{before}|{hidden}")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_email .. n_card (values replaced, by kind) and n_pii.

    ``key`` is the secret: the same key gives the same pseudonyms everywhere; the session's plans are shown without it.  A null text stays null with counts 0;
    an empty one stays empty.  Every input row gives one row, repeated and null ids included; other columns are not
    read; an empty table gives none.  Work is in the row alone: no shuffle, no Python.
    """
    keep_secret(docs.sparkSession, key)
    text = F.col(text_col)
    maybe = text.rlike("[0-9@]")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.when(maybe, F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).alias("_found"))
    found = rows.withColumn("_new", F.transform("_found", lambda m: F.struct(m.alias("old"), kind_of(m).alias("kind"))))
    found = found.withColumn("_new", F.transform("_new", lambda x: F.struct(x["old"].alias("old"), x["kind"].alias("kind"), pseudonym(x["old"], x["kind"], key).alias("new"))))
    between = F.split("text", _ANY, -1)
    joined = F.concat(
        F.array_join(F.zip_with(F.slice(between, 1, F.size("_new")), "_new", lambda gap, x: F.concat(gap, x["new"])), ""), F.element_at(between, -1)
    )

    def replaced(kind: str) -> Column:
        return F.size(F.filter("_new", lambda x: (x["kind"] == kind) & (x["new"] != x["old"])))

    counts = [replaced(k) for k in KINDS]
    some = F.coalesce(F.size("_new") > 0, F.lit(False))
    tally = [F.when(some, c).otherwise(0).cast("long").alias(f"n_{k}") for k, c in zip(KINDS, counts, strict=True)]
    out = found.select("doc_id", F.when(some, joined).otherwise(F.col("text")).alias("text"), *tally)
    return out.withColumn("n_pii", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long")))
