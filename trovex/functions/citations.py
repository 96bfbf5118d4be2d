"""Patent citations in free text: mention filter, keyword windows, number grammar and prefix rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovex.functions.text import keyword_spans, ws_normalize

# The patterns that decide what counts as a mention, a number, a kind and an American number. Java needs (?U)
# for Unicode classes.
PHRASE = r"(?iU)\b(?:patent\s+numbers?|patent\s+no\.?s?|patent\s+num\.?s?|pat\.\s*no\.?s?|pat\.\s*num\.?s?)"
MENTION = r"(?iU)\b(?:patent|pat\.?s?(?=\W|$))"
KEYWORD = r"(?iU)\b(?:patent\s+numbers?|patent\s+no\.?s?|patent\s+num\.?s?|pat\.\s*no\.?s?|pat\.\s*num\.?s?|patent|pat\.?s?(?=\W|$))"
PLAIN = r"(?iU)([A-Z]{1,3})?(\d{5,14})([A-Z]\d?$)?"
COMMA = r"(?iU)([A-Z]{1,3})?(\d{1,3}(?:,\d{3})+)([A-Z]\d?)?"
KIND = r"(?iU)^\s*(A\d?|A[1-4,8-9]|B\d?|B[1-4,8-9]|S\d?|S[1-2]|\.[X0-9])\b"
US_HINT = r"(?iU)\b(?:US|U\.S\.|U\. S\.|U\.S)"
REACH = 200
HINT_REACH = 20
KIND_REACH = 5


def mentions_patent(text: Column) -> Column:
    """TRUE for a phrase that announces a number, or a keyword with a number within 200 characters; null is FALSE."""
    near = F.exists(keyword_spans(text, MENTION, REACH), lambda s: s["text"].rlike(COMMA) | s["text"].rlike(PLAIN))
    return F.coalesce(text.rlike(PHRASE) | near, F.lit(False))


def has_us_hint(text: Column, start: Column, span: Column) -> Column:
    """TRUE if the span, or the 20 characters before its keyword, says US. Cutting those 20 may fabricate the start of a word."""
    before = F.substring(text, F.greatest(start - HINT_REACH, F.lit(0)) + 1, F.least(start, F.lit(HINT_REACH)))
    return span.rlike(US_HINT) | before.rlike(US_HINT)


def apply_prefix(prefix: Column, digits: Column, kind: Column, suffix: Column | None = None) -> Column:
    """struct(country, number): ZL is Chinese, RE and D are American and stay in the number, two letters are a country,
    of three the last stays, a single letter stays; a kind with a leading dot is Chinese; the suffix ends the number."""
    p = F.upper(F.coalesce(prefix, F.lit("")))
    country = F.when(p == "ZL", "CN").when(p.isin("RE", "D"), "US").when(F.length(p) >= 2, F.substring(p, 1, 2)).otherwise("")
    kept = F.when(p == "ZL", "").when(p.isin("RE", "D"), p).when(F.length(p) == 3, F.substring(p, 3, 1)).when(F.length(p) == 1, p).otherwise("")
    return F.struct(F.when(F.startswith(kind, F.lit(".")), "CN").otherwise(country).alias("country"), F.concat(kept, digits, F.lit("") if suffix is None else suffix).alias("number"))


def numbers(span: Column) -> Column:
    """An array of struct(prefix, digits, suffix, kind) of a span: those with commas first, then plain ones, each from left to right."""
    found = []
    for pattern in (COMMA, PLAIN):
        ahead = pattern + rf"(?=(.{{0,{KIND_REACH}}}))"
        part = lambda g, p=ahead: F.regexp_extract_all(span, F.lit(p), F.lit(g))
        hits = F.arrays_zip(part(1).alias("p"), part(2).alias("d"), part(3).alias("s"), part(4).alias("after"))
        found.append(F.transform(hits, lambda h: F.struct(h["p"].alias("prefix"), F.replace(h["d"], F.lit(","), F.lit("")).alias("digits"), h["s"].alias("suffix"), F.upper(F.regexp_extract(h["after"], KIND, 1)).alias("kind"))))
    return F.concat(*found)


def parse_citations(products: DataFrame, *fields: str) -> DataFrame:
    """A row for each cited number of a product (product_id, ord and text ``fields``, in their order): the first of each number,
    whatever its country; a blank row for each keyword without one. Null and blank fields have none."""
    fields = fields or ("features",)
    texts = products.select("product_id", "ord", F.posexplode(F.array(*[ws_normalize(F.col(f).cast("string")) for f in fields])).alias("field_no", "body"))
    spans = texts.select("product_id", "ord", "field_no", "body", F.posexplode(keyword_spans(F.col("body"), KEYWORD, REACH)).alias("span_no", "span"))
    spans = spans.select("product_id", "ord", "field_no", "span_no", F.col("span.text").alias("span_text"), has_us_hint(F.col("body"), F.col("span.start"), F.col("span.text")).alias("american"))
    rows = spans.select("*", F.posexplode_outer(numbers(F.col("span_text"))).alias("number_no", "hit"))
    kind = F.coalesce("hit.kind", F.lit(""))
    rows = rows.withColumn("x", apply_prefix(F.col("hit.prefix"), F.coalesce("hit.digits", F.lit("")), kind, F.coalesce("hit.suffix", F.lit(""))))
    country = F.when((F.col("x.country") == "") & F.col("american"), "US").otherwise(F.col("x.country"))
    rows = rows.select("product_id", "ord", "field_no", "span_no", F.coalesce("number_no", F.lit(0)).alias("number_no"), F.col("x.number").alias("patent_number"), country.alias("country_code"), kind.alias("kind_code"), "span_text")
    at = ("field_no", "span_no", "number_no")
    rest = ("country_code", "kind_code", "span_text")
    named = rows.where("patent_number != ''").groupBy("product_id", "ord", "patent_number").agg(F.min(F.struct(*at, *rest)).alias("r"))
    named = named.select("product_id", "ord", *[f"r.{c}" for c in at], "patent_number", *[f"r.{c}" for c in rest])
    return named.unionByName(rows.where("patent_number = ''"))
