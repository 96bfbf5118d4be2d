"""Building the retrieval corpus from merged pairs, and the entities that each side could leak."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.functions.text import nonempty
from trovex.operators.masking import PLACEHOLDERS
from trovex.operators.order import first_wins


def is_design(c: str = "patent_number") -> F.Column:
    return F.startswith(F.upper(F.col(c)), F.lit("D"))


def build_corpus(merged: DataFrame, keep_designs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(products, patents, mappings, skip counts). Products are admitted before any pair is dropped, so those of design patents stay as distractors."""
    reason = F.when(~nonempty(F.col("product_title")), "no_product_title")
    if not keep_designs:
        reason = reason.when(is_design(), "design")
    reason = reason.when(~nonempty(F.col("patent_number")), "no_number").when(~nonempty(F.col("patent_title")), "no_patent_title")
    rows = merged.withColumn("skip_reason", reason)
    products = first_wins(rows.where(nonempty(F.col("product_title"))), ["product_id"]).select("product_id", "product_title", "brand")
    good = rows.where("skip_reason is null")
    patents = first_wins(good, ["patent_number"]).select("patent_number", "patent_title")
    mappings = good.select("patent_number", "product_id").distinct().join(products.select("product_id"), "product_id", "left_semi")
    skips = rows.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
    return products, patents, mappings, skips


#: Bibliographic keys that a corpus record does not carry.
DROPPED_KEYS = (
    "id",
    "full",
    "figurePage",
    "label",
    "left",
    "top",
    "type",
    "Additional",
    "right",
    "bottom",
    "IsCPC",
    "Leaf",
    "FirstCode",
    "num_attr",
    "thisCountry",
    "isPatent",
    "isScholar",
    "scholarID",
    "events",
)


def prune_keys(bibliographic: F.Column, drop: tuple[str, ...] = DROPPED_KEYS) -> F.Column:
    return F.map_filter(bibliographic, lambda k, v: ~k.isin(*drop))


def split_names(c: F.Column) -> F.Column:
    """Names of a list in one string, split at ; and the word and."""
    parts = F.transform(F.split(c, r"(?iU);|\band\b"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def entity_list(names: F.Column) -> F.Column:
    """Names without placeholders, each once whatever its case (the first spelling stays), longest first, then in their order."""
    real = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: ~F.lower(x).isin(*PLACEHOLDERS))
    low = F.transform(real, F.lower)
    once = F.filter(real, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    placed = F.transform(once, lambda x, i: F.struct((-F.length(x)).alias("l"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda e: e["x"])


def patent_names(bibliographic: F.Column) -> F.Column:
    """Inventors and assignees of a bibliographic map."""
    return entity_list(F.flatten(F.transform(F.array(*[F.lit(k) for k in ("inventor", "assigneeCurrent", "assigneeOriginal")]), lambda k: F.coalesce(split_names(bibliographic[k]), F.array().cast("array<string>")))))


def product_names(details: F.Column, store: F.Column) -> F.Column:
    """Brand, manufacturer and store of a product; the store is taken from the details where it has none of its own."""
    found = F.array(details["Brand"], details["Manufacturer"], F.coalesce(store, details["store"]))
    return entity_list(F.filter(found, lambda x: x.isNotNull()))


def known_numbers(bibliographic: F.Column) -> F.Column:
    """The numbers by which a patent may be cited."""
    found = F.transform(F.array(*[bibliographic[k] for k in ("publicationNumber", "numberWithoutCodes", "applicationNumber")]), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: F.coalesce(x != "", F.lit(False))))


def _parts(value: F.Column, masked: F.Column | None, strict: bool) -> F.Column:
    """A text or list as a list of trimmed parts; of a masked one, the plain value only where that is null (``strict``: also where it is empty)."""
    if masked is not None:
        empty = masked.isNull() | ((masked == "") if strict else F.lit(False))
        value = F.when(empty, value).otherwise(masked)
    return F.filter(F.array(F.trim(value)), lambda x: F.coalesce(x != "", F.lit(False)))


def _claim_text(key: str):
    return lambda x: F.trim(F.coalesce(x[key], x["text"]))


def joined_text(rows: DataFrame, fields: tuple[str, ...], masked: bool = False, strict_compat: bool = False) -> F.Column:
    """The fields of a record as one text, parted by blanks; lists are joined, claims (structs with a text) too.

    With ``masked``, <field>_masked is read where it is not null. ``strict_compat`` reads the plain field also where the
    masked one is empty, which may leak what was masked.
    """
    out = []
    kinds = dict(rows.dtypes)
    for f in fields:
        names = [f, f"{f}_masked"] if masked and f"{f}_masked" in kinds else [f]
        texts = []
        for n in names:
            c = F.col(n)
            if "struct" in kinds[n]:
                key = "text_masked" if masked and "text_masked" in kinds[n] else "text"
                c = F.transform(c, _claim_text(key))
            elif kinds[n].startswith("array"):
                c = F.transform(c, lambda x: F.trim(x))
            texts.append(F.array_join(F.filter(c, lambda x: x != ""), " ") if kinds[n].startswith("array") else c.cast("string"))
        out.append(_parts(texts[0], texts[1] if len(texts) > 1 else None, strict_compat))
    return F.array_join(F.concat(*out), " ")


def patent_text(rows: DataFrame, masked: bool = False, strict_compat: bool = False) -> F.Column:
    """Title, abstract, description and claims, those that ``rows`` has."""
    return joined_text(rows, tuple(f for f in ("title", "abstract", "description", "claims") if f in rows.columns), masked, strict_compat)


def product_text(rows: DataFrame, masked: bool = False, strict_compat: bool = False) -> F.Column:
    """Title, description and features, those that ``rows`` has."""
    return joined_text(rows, tuple(f for f in ("title", "description", "features") if f in rows.columns), masked, strict_compat)


def cross_entities(mappings: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(key, names): an entity's own names and those of its partners one hop away, distinct and sorted; both sides are (key, names)."""
    partner = mappings.join(right.withColumnRenamed("names", "theirs"), right_key).groupBy(left_key).agg(F.flatten(F.collect_set("theirs")).alias("theirs"))
    both = left.join(partner, left_key, "left")
    return both.select(left_key, F.array_sort(F.array_distinct(F.concat("names", F.coalesce("theirs", F.array().cast("array<string>"))))).alias("names"))
