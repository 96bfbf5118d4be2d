"""Column functions for text clean-up, identifiers and tokens. Patterns are Java regex; white space is Unicode where said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = "\t\n\x0b\x0c\r"
_PUNCT = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


def ws_normalize(c: Column) -> Column:
    """Collapses runs of white space to one blank and trims."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def cleanup(c: Column) -> Column:
    """Collapses blanks and drops those before punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, " +", " "), r" ([,;:.!?])", "$1"))


def flatten_text(items: Column) -> Column:
    """A list of strings as one text: items normalised, blanks skipped."""
    return F.concat_ws(" ", F.filter(F.transform(items, ws_normalize), lambda x: x != ""))


def split_bullets(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def nonempty(c: Column) -> Column:
    """TRUE for a string with something other than blanks; null and blank are FALSE."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def patent_id(country: Column, number: Column, kind: Column) -> Column:
    return F.concat(F.upper(F.coalesce(country, F.lit(""))), F.coalesce(number, F.lit("")), F.upper(F.coalesce(kind, F.lit(""))))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def group_digits(c: Column, separator: str = ",") -> Column:
    return F.regexp_replace(digits_only(c), r"(?<=\d)(?=(\d{3})+$)", separator)


def sanitize(c: Column) -> Column:
    """A safe file name: blanks and other characters become _, 200 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, " ", "_"), r"[^A-Za-z0-9._-]", "_"), 1, 200)


def _accent_table() -> tuple[str, str]:
    """Letters with accents of the Latin, Greek and Cyrillic blocks, and the letters without, by Unicode's decomposition."""
    import unicodedata

    found = []
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code) and bare.isalpha() and chr(code).isalpha():
            found.append((chr(code), bare))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def strip_accents(c: Column) -> Column:
    """Letters without their accents; combining marks go. One pass of translate, no Python."""
    return F.regexp_replace(F.translate(c, *_accent_table()), r"\p{Mn}+", "")


def extension_of(url: Column, default: str = "html") -> Column:
    """The file extension of a URL or path, without query and fragment, in lower case."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(bare, r"[.]([A-Za-z0-9]{2,4})$", 1), F.lit("")), F.lit(default)))


#: Extensions of the content types that assets come in.
EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "video/mp4": "mp4", "application/vnd.apple.mpegurl": "m3u8", "application/x-mpegURL": "m3u8"}


def extension_of_type(content_type: Column, url: Column, default: str = "bin") -> Column:
    """By content type where it is known, else by the URL."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    known = F.create_map(*[F.lit(x) for k, v in EXTENSIONS.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(known, kind), extension_of(url, default))


def bm25_tokens(c: Column) -> Column:
    """Lower-case runs without ASCII blanks, punctuation removed; one pass of translate, as patterns took most of the time."""
    return F.filter(F.split(F.translate(F.lower(c), _BLANKS + _PUNCT, " " * len(_BLANKS)), " "), lambda x: x != "")


def word_tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscore in any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def word_ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def merge_spans(spans: Column) -> Column:
    """The union of [s, e) spans that overlap or touch; ``spans`` is an array of struct(s, e). A span opens an island where all
    before it end earlier, so an island ends where the longest reach up to the next opening does."""
    x = F.array_sort(spans)
    reach = lambda i: F.array_max(F.transform(F.slice(x, 1, i), lambda y: y["e"]))
    opens = F.filter(F.transform(x, lambda y, i: F.when((i == 0) | (y["s"] > F.coalesce(reach(F.greatest(i, F.lit(1))), y["s"])), i)), lambda i: i.isNotNull())
    last = lambda k: F.coalesce(F.get(opens, k + 1), F.size(x))
    return F.transform(opens, lambda i, k: F.struct(F.get(x, i)["s"].alias("s"), reach(last(k)).alias("e")))


def keyword_spans(c: Column, keyword: str, reach: int = 200) -> Column:
    """struct(start, text) for each match of ``keyword`` with up to ``reach`` characters before and after it."""
    gaps = F.transform(F.split(c, keyword, -1), F.length)
    hits = F.transform(F.regexp_extract_all(c, F.lit(keyword), F.lit(0)), F.length)
    starts = F.transform(hits, lambda h, i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(hits, 1, i), F.lit(0), lambda a, x: a + x))
    lo = lambda s: F.greatest(s - reach, F.lit(0))
    return F.zip_with(starts, hits, lambda s, h: F.struct(s.alias("start"), F.trim(F.substring(c, lo(s) + 1, s + h + reach - lo(s))).alias("text")))
