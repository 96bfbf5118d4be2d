"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame and SQL functions alone.

Candidates are found by pattern and validated: card numbers by their Luhn digit, IPv4 addresses by their octets, dates
by the calendar, social-security numbers by their parts, phone numbers by their digits, mail addresses by their form. A
valid value is taken apart into symbols of known radix and permuted by an unbalanced Feistel network: in each round one
half of the symbols moves, each modulo its own radix, by an HMAC-SHA-256 of the other half. So a pseudonym is a value of
the same format (cards get a fitting Luhn digit, dates stay dates between 1900 and 2099, mail domains stay), distinct
values stay distinct, and equal values are equal wherever they occur and however they are separated.

Dates with slashes or dots are read day first; where that is no calendar date, month first, and the pseudonym is then
written month first. So one date in two orders has one pseudonym in two orders, and only a date read month first may get
the letters of another one read day first. Phone numbers are candidates from their plus sign on; national forms
without one are not.

The key is the caller's; only its SHA-256 stands in a plan. Texts without a candidate pass through unchanged. No pattern
repeats a group by recursion, so values of any length are safe. Defined results: a null text stays null, an empty one
empty; text outside valid values is untouched; equal texts have equal results; an empty table gives an empty result; all
other columns are left alone: where one is called like the count, the count gets underscores in front.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.llm.runtime import fresh_names, table

#: The session setting that holds the query's key; without it the query takes this name itself, for tests only.
KEY_SETTING = "trovex.pseudonym.key"
ROUNDS = 10
#: Days of 1900-01-01 to 2099-12-31: 73,049 = 17 * 4,297, the two radices of a date.
DAYS = (17, 4297)

_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
_ISO = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
_DMY = r"(?<![0-9./])[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
_CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
PATTERN = "|".join((_MAIL, _IPV4, _ISO, _DMY, _SSN, _PHONE, _CARD))


def _hmac(message: Column, key: str) -> Column:
    """HMAC-SHA-256 in hex, under the SHA-256 of ``key``."""
    block = hashlib.sha256(key.encode()).digest() + bytes(32)
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _moved(state: Column, by: Column, keep_first: bool, r: Column, tweak: Column, key: str) -> Column:
    """One round: the symbols of the first (or else second) half move, by the other half."""
    half = F.floor(F.size(state) / 2).cast("int")
    other = F.slice(state, half + 1, F.size(state) - half) if not keep_first else F.slice(state, 1, half)
    seen = F.array_join(F.transform(other, lambda e: e["v"].cast("string")), ",")
    mine = (lambda i: i < half) if not keep_first else (lambda i: i >= half)

    def step(e: Column, i: Column) -> Column:
        digest = _hmac(F.concat_ws("|", tweak, r.cast("string"), i.cast("string"), seen), key)
        shift = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
        return F.when(mine(i), F.struct(F.pmod(e["v"] + shift, e["m"]).alias("v"), e["m"].alias("m"))).otherwise(e)

    return F.transform(state, step)


def feistel(symbols: Column, tweak: Column, key: str, rounds: int = ROUNDS) -> Column:
    """``symbols``, an array of (v, m) with 0 <= v < m, permuted within the product of its radices."""
    turn = lambda s, r: F.when(r % 2 == 1, _moved(s, s, False, r, tweak, key)).otherwise(_moved(s, s, True, r, tweak, key))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), symbols, turn)


def _pair(v: Column, m: Column) -> Column:
    return F.struct(v.cast("long").alias("v"), m.cast("long").alias("m"))


def _numbers(values: list[Column], radices: list[int]) -> Column:
    return F.array(*[_pair(v, F.lit(m)) for v, m in zip(values, radices)])


def _characters(s: Column, tweak: str, key: str) -> Column:
    """A string with its ASCII letters and digits permuted, each within its kind; the rest stays."""
    chars = F.filter(F.split(s, ""), lambda c: c.rlike("[0-9A-Za-z]"))
    base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65)
    symbols = F.transform(chars, lambda c: _pair(F.ascii(c) - base(c), F.when(c.rlike("[0-9]"), 10).otherwise(26)))
    kinds = F.array_join(F.transform(chars, lambda c: base(c).cast("string")), "")
    moved = F.transform(F.arrays_zip(chars.alias("c"), feistel(symbols, F.concat(F.lit(tweak), kinds), key).alias("x")), lambda z: F.char(z["x"]["v"] + base(z["c"])))
    # the gaps between permuted characters keep their places
    gaps = F.split(s, "[0-9A-Za-z]", -1)
    return F.array_join(F.zip_with(gaps, moved, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def _luhn_sum(digits: Column, from_right: int) -> Column:
    """Sum of the Luhn weights; the rightmost digit stands ``from_right`` places from the end of the whole number."""
    places = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when((i + from_right) % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2 - 1, F.lit(9)) + 1 - F.when(c == "0", 9).otherwise(0)))
    return F.aggregate(F.filter(places, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = F.substring(m, F.lit(1), F.length(m) - 1)
    moved = _characters(body, "card", key)
    check = F.pmod(-_luhn_sum(F.regexp_replace(moved, "[^0-9]", ""), 1), F.lit(10))
    return F.when(_luhn_sum(digits, 0) % 10 == 0, F.concat(moved, check.cast("string"))).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda c: c.cast("long"))
    moved = feistel(F.transform(octets, lambda x: _pair(x, F.lit(256))), F.lit("ip"), key)
    return F.when(F.forall(octets, lambda x: x < 256), F.array_join(F.transform(moved, lambda x: x["v"].cast("string")), ".")).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    mark = F.regexp_extract(m, "[./-]", 0)
    parts = F.split(m, "[./-]")
    read = lambda y, mo, d: F.try_to_date(F.concat_ws("-", F.get(parts, F.lit(y)), F.lpad(F.get(parts, F.lit(mo)), 2, "0"), F.lpad(F.get(parts, F.lit(d)), 2, "0")), "yyyy-MM-dd")
    day_first, month_first = read(2, 1, 0), read(2, 0, 1)
    day = F.datediff(F.when(iso, read(0, 1, 2)).otherwise(F.coalesce(day_first, month_first)), F.to_date(F.lit("1900-01-01")))
    size = DAYS[0] * DAYS[1]
    moved = feistel(_numbers([F.floor(day / DAYS[1]), day % DAYS[1]], list(DAYS)), F.lit("date"), key)
    new = F.date_add(F.to_date(F.lit("1900-01-01")), (F.get(moved, F.lit(0))["v"] * DAYS[1] + F.get(moved, F.lit(1))["v"]).cast("int"))
    same_marks = F.length(F.regexp_replace(m, "[^.]", "")) != 1
    one, two = (F.when(day_first.isNotNull(), F.date_format(new, a)).otherwise(F.date_format(new, b)) for a, b in (("dd", "MM"), ("MM", "dd")))
    text = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat_ws("", one, mark, two, mark, F.date_format(new, "yyyy")))
    return F.when(day.isNotNull() & (day >= 0) & (day < size) & same_marks, text).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    moved = feistel(_numbers([area - 1 - F.when(area > 666, 1).otherwise(0), group - 1, serial - 1], [898, 99, 9999]), F.lit("ssn"), key)
    a = F.get(moved, F.lit(0))["v"] + 1
    a = a + F.when(a >= 666, 1).otherwise(0)
    text = F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.get(moved, F.lit(1))["v"] + 1).cast("string"), 2, "0"), F.lpad((F.get(moved, F.lit(2))["v"] + 1).cast("string"), 4, "0"))
    return F.when(valid, text).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)
    count = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return F.when(count.between(8, 15), F.concat(country, _characters(F.substring(m, F.length(country) + 1, F.length(m)), "phone", key))).otherwise(m)


def _mail(m: Column, key: str) -> Column:
    return F.concat(_characters(F.substring_index(m, "@", 1), "mail", key), F.lit("@"), F.substring_index(m, "@", -1))


def kind_of(m: Column) -> Column:
    """What a candidate may be."""
    return (
        F.when(F.contains(m, F.lit("@")), "mail")
        .when(m.rlike(r"^\+"), "phone")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | m.rlike(r"^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}$"), "date")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .otherwise("card")
    )


def pseudonym(m: Column, key: str) -> Column:
    """A candidate's pseudonym; the candidate itself if it is not valid."""
    kind = kind_of(m)
    return F.when(kind == "mail", _mail(m, key)).when(kind == "phone", _phone(m, key)).when(kind == "ip", _ipv4(m, key)).when(kind == "date", _date(m, key)).when(kind == "ssn", _ssn(m, key)).otherwise(_card(m, key))


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with the valid values of ``column`` replaced, and n_replaced, their number. One pass, no shuffle."""
    text = F.col(f"`{column}`")
    swapped, counted = fresh_names(docs, "swapped", "n_replaced")
    if "n_replaced" not in {c.lower() for c in docs.columns}:
        counted = "n_replaced"
    some = F.coalesce(text.rlike("[0-9@]") & text.rlike(PATTERN), F.lit(False))
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    swaps = F.when(some, F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"))))
    gaps = F.split(text, PATTERN, -1)
    rebuilt = F.array_join(F.zip_with(gaps, F.col(swapped), lambda g, s: F.concat(g, F.coalesce(s["new"], F.lit("")))), "")
    out = docs.withColumn(swapped, swaps)
    out = out.withColumn(counted, F.coalesce(F.size(F.filter(swapped, lambda s: s["old"] != s["new"])), F.lit(0)).cast("long"))
    return out.withColumn(column, F.when(F.col(swapped).isNotNull(), rebuilt).otherwise(text)).drop(swapped)


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, spark.conf.get(KEY_SETTING, KEY_SETTING)).select("doc_id", "text", "n_replaced")
