"""Claims: parsing, fragment clean-up and the aggregate first claim."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLAIM = r"(?s)^(?:claim\s+)?([0-9]+)\s*[.:-]\s+(.*)$"


def parse_claim(text: Column) -> Column:
    """struct(claim_number, body, depends_on) of a numbered claim of ten characters or more; null for others."""
    number = F.regexp_extract(text, "(?i)" + _CLAIM, 1)
    body = F.regexp_extract(text, "(?i)" + _CLAIM, 2)
    on = F.regexp_extract(body, r"(?i)\bclaim\s+([0-9]+)", 1)
    whole = F.struct(number.try_cast("int").alias("claim_number"), body.alias("body"), F.nullif(on, F.lit("")).try_cast("int").alias("depends_on"))
    return F.when((F.length(text) >= 10) & (number != ""), whole)


def clean_claims(claims: Column) -> Column:
    """``claims``, an array of struct(claim_number, ord, text): where a claim number holds a fragment of its longest text, only
    that one stays; sorted by number, then place, without a number last."""
    same = lambda x: F.filter(claims, lambda y: y["claim_number"].eqNullSafe(x["claim_number"]))
    top = lambda g: F.array_max(F.transform(g, lambda y: F.struct(F.length(y["text"]).alias("n"), (-y["ord"]).alias("o"), y["text"].alias("text"))))
    fragment = lambda y, longest: (F.trim(y["text"]) != F.trim(longest["text"])) & F.contains(F.trim(longest["text"]), F.trim(y["text"]))

    def stays(x: Column) -> Column:
        longest = top(same(x))
        return ~F.exists(same(x), lambda y: fragment(y, longest)) | (x["ord"] == -longest["o"])

    kept = F.filter(claims, stays)
    return F.array_sort(kept, lambda a, b: F.when(a["claim_number"].isNull() & b["claim_number"].isNotNull(), 1).when(a["claim_number"].isNotNull() & b["claim_number"].isNull(), -1).when(a["claim_number"] < b["claim_number"], -1).when(a["claim_number"] > b["claim_number"], 1).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))


def drop_whole_claim(texts: Column) -> Column:
    """Without the first claim, if it contains all the others."""
    rest = F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0)))
    whole = (F.size(texts) > 1) & F.forall(rest, lambda x: F.contains(F.lower(F.get(texts, F.lit(0))), F.lower(x)))
    return F.when(whole, rest).otherwise(texts)
