"""Masking identifiers and names: patent numbers, known numbers, exact names, partial names and titles.

Masks delete, so that no placeholder becomes a shared token. All functions take null for null and leave an empty text
empty; an empty list of names, titles or numbers changes nothing but blanks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovex.functions.text import cleanup, group_digits

# What counts as a keyword, a number and a kind.
KEYWORDS = (
    r"patents?\s+numbers?",
    r"patents?\s+num\.?s?",
    r"patents?\s+nos?\.?",
    r"pats?\.?\s*nos?\.?",
    r"pats?\.?\s*num\.?s?",
    r"U\.?\s*S\.?\s*Pats?\.?\s*Nos?\.?",
    r"U\.?\s*S\.?\s*Patents?\s+Nos?\.?",
    r"Ser\.?\s*Nos?\.?",
    r"applications?\s+Ser\.?\s*Nos?\.?",
    r"Reg\.?\s*Des\.?\s*Nos?\.?",
    r"Reg\.?\s*Nos?\.?",
    r"(?:provisional\s+)?patents?\s+applications?\s+nos?\.?",
    r"(?:pat(?:ent)?s?\.?\s+)?app(?:lication)?s?\.?\s+pub(?:lication)?s?\.?\s*nos?\.?",
    r"pub(?:lication)?s?\.?\s*nos?\.?",
    r"app(?:lication)?s?\.?\s*nos?\.?",
    r"designs?\s+nos?\.?",
    r"patented",
    r"designs?\s+patents?",
    r"patents?",
)
SEPARATED = r"\d{1,3}(?:[,\.]\s*\d{3})+"
PLAIN = r"\d{5,14}"
SLASH = r"\d{2,4}/\d{3,9}(?:[,\.]\s?\d{3})?"
HYPHEN = r"[A-Z]{2}\s*\d[\d\s\-]{4,20}\d"
SPACED = r"\d+(?:[\s\-]\d+){1,6}"
DESIGN = r"D(?:\d{6,7}|\d{1,3}[,.]\s*\d{3})"
COUNTRY = r"(?:[A-Z]{1,3}\s?)?"
KIND = r"(?:\s+(?-i:[A-Z]{1,2})\d{0,2}(?!\w)|[A-Z]{1,2}\d{0,2}|\.[A-Z0-9]{1,2}|-\d{1,6}(?:/\d+)?)?"
SCOPE_KIND = r"(?:\s+(?-i:[A-Z]{1,2})\d{0,2}(?!\w)|(?-i:[A-Z]{1,2})\d{0,2}(?!\w)|\.(?-i:[A-Z0-9])(?![a-z])|-\d{1,6}(?:/\d+)?)?"
TAIL = r"(?:[A-Za-z]\d{0,2})?(?!\w)"
LIST_SEPARATORS = r"\s*(?:(?:[,;:|&]|\band\b|nos?\.)\s*)*(?:Nr\.?\s*)?#?"
MOST_LISTED = 30
# When a name's word counts as common, and how alike a window must be.
FUZZY_PERCENT = 70
COMMON_SHARE = 0.10
COMMON_SINGLE_SHARE = 0.02
PLACEHOLDERS = ("individual", "unknown", "n/a", "")


def _either(*patterns: str) -> str:
    return f"(?:{'|'.join(patterns)})"


_TOKEN = _either(HYPHEN, SLASH, SEPARATED, PLAIN, DESIGN)
_LISTED = _either(HYPHEN, SLASH, SEPARATED, SPACED, PLAIN, DESIGN)


class Rule:
    """Deletes ``inner`` wherever it matches; with a ``scope``, only inside the scope's matches."""

    def __init__(self, scope: str | None, *inner: str, any_case: bool = False):
        flags = re.IGNORECASE if any_case else 0
        self.scope = re.compile(scope, flags) if scope else None
        self.inner = [re.compile(p, flags) for p in inner]

    def delete(self, text: str) -> str:
        for p in self.inner:
            text = p.sub("", text)
        return text

    def __call__(self, text: str) -> str:
        return self.scope.sub(lambda m: self.delete(m.group()), text) if self.scope else self.delete(text)


#: In this order: numbers listed after a keyword, numbers that a product listing states, then forms that are safe anywhere.
RULES = (
    Rule(rf"\b{_either(*KEYWORDS)}(?:{LIST_SEPARATORS}{COUNTRY}{_LISTED}{SCOPE_KIND}){{1,{MOST_LISTED}}}", rf"(?<!\w)#?{COUNTRY}{_TOKEN}{KIND}(?!\w)", rf"(?<!\w){COUNTRY}(?:{SPACED})(?!\w)", any_case=True),
    Rule(rf"\b(?:design\s+)?(?:patent|trademark)(?:\s+\w+){{0,5}}?\s+numbers?\s+(?:is\s+)?{_LISTED}(?:\s*(?:[,&]|\band\b)\s*{_LISTED})*", rf"(?<!\w){_LISTED}(?!\w)", any_case=True),
    Rule(None, rf"(?<!\w)U\.?S\.?\s+{DESIGN}{KIND}(?!\w)"),
    Rule(None, rf"(?<!\w)US\d{{0,2}}{DESIGN}{KIND}(?!\w)"),
    Rule(None, rf"(?<!\w)USD(?:\d{{6,7}}|{SEPARATED}){TAIL}"),
    Rule(None, rf"(?<!\w)#\s*(?:[A-Za-z]{{0,2}}\s?)?(?:{SEPARATED}|{PLAIN}){TAIL}"),
    Rule(None, rf"(?<!\w)[EW][PO]\s?\d{{6,10}}{KIND}(?!\w)"),
    Rule(None, rf"(?<!\w){DESIGN}{TAIL}"),
)


def delete_numbers(text: str) -> str:
    """A text without the patent numbers that the rules find."""
    for rule in RULES:
        text = rule(text)
    return text


@F.pandas_udf(T.StringType())
def _without_numbers(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else delete_numbers(t))


def _clean(text: Column, clean: bool) -> Column:
    return cleanup(text) if clean else text


def mask_patent_numbers(text: Column, clean: bool = True) -> Column:
    """Deletes patent numbers; their keywords stay. Nested replacement is beyond regexp_replace, so this runs on Arrow batches."""
    return _clean(_without_numbers(text), clean)


def quote(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\\.\[\]\{\}\(\)\*\+\-\?\^\$\|])", r"\\$1")


def known_number_pattern(number: Column) -> Column:
    """A pattern for the written forms of a known number; null where there is none.

    With a slash, the part before it and the part after it, the latter plain or grouped, or both without the slash; else
    the digits, five at least, plain or grouped by comma, dot, or comma and blank. A country may stand before, a kind after.
    """
    left, right = (F.regexp_replace(F.get(F.split(number, "/", 2), F.lit(i)), "[^0-9]", "") for i in (0, 1))
    digits = F.regexp_replace(number, "[^0-9]", "")
    slashed = F.concat_ws("|", F.concat_ws("/", left, group_digits(right)), F.concat_ws("/", left, right), F.concat(left, right))
    plain = F.concat_ws("|", *[group_digits(digits, s) for s in (", ", ",", "[.]")], digits)
    forms = F.when((F.length(left) > 0) & (F.length(right) > 0), slashed).when(F.length(digits) >= 5, plain)
    return F.concat(F.lit(r"(?iU)(?<!\w)" + COUNTRY + "(?:"), forms, F.lit(")" + TAIL))


def mask_known_numbers(text: Column, numbers: Column, clean: bool = True) -> Column:
    """Deletes all written forms of the known ``numbers`` (an array)."""
    drop = lambda t, n: F.coalesce(F.regexp_replace(t, known_number_pattern(n), F.lit("")), t)
    return _clean(F.aggregate(F.coalesce(numbers, F.array().cast("array<string>")), text, drop), clean)


def mask_known_number(text: Column, number: Column) -> Column:
    return mask_known_numbers(text, F.array(number))


def _longest_first(names: Column) -> Column:
    return F.array_sort(names, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))


def name_variants(names: Column) -> Column:
    """The names and, for names of several words, their form without blanks; each once whatever its case, longest first."""
    each = F.flatten(F.transform(names, lambda n: F.array(n, F.array_join(F.split(F.trim(n), r"\s+"), ""))))
    each = F.filter(each, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    return _longest_first(F.filter(each, lambda x, i: F.array_position(F.transform(each, F.lower), F.lower(x)) == i + 1))


def mask_names(text: Column, names: Column, clean: bool = True) -> Column:
    """Deletes each name and its form without blanks, the longest first, whatever the case, at borders of letters and digits."""
    drop = lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9])"), quote(n), F.lit(r"(?![A-Za-z0-9])")), F.lit(""))
    return _clean(F.aggregate(name_variants(F.coalesce(names, F.array().cast("array<string>"))), text, drop), clean)


def mask_titles(text: Column, titles: Column) -> Column:
    """Deletes titles that stand in the text word for word, whatever the white space between the words and the case."""
    words = lambda t: F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    pattern = lambda t: F.concat(F.lit(r"(?iU)(?<![A-Za-z0-9])"), F.array_join(F.transform(words(t), quote), r"\s+"), F.lit(r"(?![A-Za-z0-9])"))
    real = F.filter(F.coalesce(titles, F.array().cast("array<string>")), lambda t: F.size(words(t)) > 0)
    return cleanup(F.aggregate(real, text, lambda x, t: F.regexp_replace(x, pattern(t), F.lit(""))))


def token_shares(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, share): the share of ``texts`` that hold each lower-case run of ASCII letters and digits."""
    tokens = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    n = texts.agg(F.count(text).alias("n"))
    return tokens.groupBy("token").agg(F.count("*").alias("df")).join(n, F.lit(True)).select("token", (F.col("df") / F.col("n")).alias("share"))


def name_candidates(names: DataFrame, shares: DataFrame, stop_words: Iterable[str] = ()) -> DataFrame:
    """(name, candidates) for each of the distinct ``names`` (name): all runs of its distinctive words, longest first.

    Stop words and words of more than a tenth of the texts are dropped before the runs are formed, so a run may join words
    that are not neighbours in the name. A single word of a longer name must be rarer still.
    """
    words = names.select("name").distinct().select("name", F.regexp_extract_all("name", F.lit("[A-Za-z0-9]+"), F.lit(0)).alias("w"))
    each = words.select("name", F.size("w").alias("n"), F.posexplode("w").alias("at", "word")).withColumn("token", F.lower("word"))
    each = each.join(shares, "token", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    stops = list(stop_words)
    good = (F.col("share") <= COMMON_SHARE) & (~F.col("token").isin(*stops) if stops else F.lit(True))
    kept = each.where(good).groupBy("name", "n").agg(F.sort_array(F.collect_list(F.struct("at", "word", "share"))).alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(i, F.size("w")), lambda j: F.slice("w", i, j - i + 1))))
    fit = F.filter(runs, lambda r: (F.size(r) > 1) | (F.col("n") == 1) | (F.get(r, F.lit(0))["share"] <= COMMON_SINGLE_SHARE))
    texts = F.array_distinct(F.transform(fit, lambda r: F.array_join(F.transform(r, lambda x: x["word"]), " ")))
    found = kept.select("name", _longest_first(texts).alias("candidates"))
    return words.select("name").join(found, "name", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = row & at.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return bin(~row & full).count("1")


def similar(a: str, b: str, percent: int = FUZZY_PERCENT) -> bool:
    """Indel similarity: twice the common subsequence over both lengths."""
    if min(len(a), len(b)) * (200 - percent) < max(len(a), len(b)) * percent:
        return False
    return 200 * lcs(a, b) >= percent * (len(a) + len(b))


def fuzzy_spans(text: str, candidates: list[str], percent: int = FUZZY_PERCENT) -> list[tuple[int, int]]:
    """The union of the word windows that are similar to a candidate of as many words; words are runs of ASCII letters and digits."""
    words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", text)]
    found = set()
    by_length: dict[int, list[str]] = {}
    for c in candidates:
        by_length.setdefault(len(c.split()), []).append(c)
    for n, wanted in by_length.items():
        for i in range(len(words) - n + 1):
            window = " ".join(w for w, _, _ in words[i : i + n])
            if any(similar(c.lower(), window, percent) for c in wanted):
                found.add((words[i][1], words[i + n - 1][2]))
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


@F.pandas_udf(T.StringType())
def _without_similar(text: pd.Series, candidates: pd.Series) -> pd.Series:
    def one(t: str | None, c) -> str | None:
        if t is None or c is None:
            return t
        for s, e in reversed(fuzzy_spans(t, list(c))):
            t = t[:s] + t[e:]
        return t

    return pd.Series([one(t, c) for t, c in zip(text, candidates)])


def fuzzy_mask(text: Column, candidates: Column) -> Column:
    """Deletes word windows that are similar to a candidate."""
    return cleanup(_without_similar(text, candidates))


def mask_text(text: Column, numbers: Column, names: Column, candidates: Column) -> Column:
    """The whole mask of one text: patent numbers, known numbers, names, then what resembles a part of a name."""
    return fuzzy_mask(mask_names(mask_known_numbers(mask_patent_numbers(text, False), numbers, False), names, False), candidates)


def mask_entries(rows: DataFrame, fields: Iterable[str], titles: str | None = None, numbers: str = "numbers", names: str = "names", candidates: str = "candidates") -> DataFrame:
    """``rows`` with a column <field>_masked for each text or list of texts in ``fields``, null where the field is null.

    ``titles`` names a column of patent titles to delete too, for products; a patent's own title is its content.
    """
    args = [F.col(c) for c in (numbers, names, candidates)]
    for field in fields:
        kind = rows.schema[field].dataType
        if isinstance(kind, T.ArrayType):
            # Python runs on rows: items are masked one by one and gathered in their order
            key = "__entry"
            keyed = rows.withColumn(key, F.monotonically_increasing_id())
            items = keyed.select(key, numbers, names, candidates, *([titles] if titles else []), F.posexplode(field).alias("__at", "__item"))
            masked = mask_text(F.col("__item"), *args)
            masked = mask_titles(masked, F.col(titles)) if titles else masked
            lists = items.select(key, "__at", masked.alias("__masked")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__at", "__masked"))).alias("__list"))
            rows = keyed.join(lists, key, "left").withColumn(f"{field}_masked", F.when(F.col(field).isNotNull(), F.coalesce(F.col("__list.__masked"), F.array().cast("array<string>")))).drop(key, "__list")
        else:
            masked = mask_text(F.col(field), *args)
            rows = rows.withColumn(f"{field}_masked", mask_titles(masked, F.col(titles)) if titles else masked)
    return rows
