"""Joining products and pairs, coverage profiles and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovex.functions.text import nonempty
from trovex.operators.order import first_wins, last_wins


def merge_pairs(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """Pairs with their product (the last of an id): no blank title or number on either side, the first pair of (product, number)."""
    p = last_wins(products, ["product_id"]).select("product_id", F.col("title").alias("product_title"), F.col("brand"))
    rows = pairs.join(p, "product_id").where(nonempty(F.col("product_title")) & nonempty(F.col("patent_title")) & nonempty(F.col("patent_number")))
    return first_wins(rows, ["product_id", "patent_number"])


def country_label(c: str = "country_code") -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", "UNKNOWN").otherwise(F.trim(c))


def with_total(df: DataFrame, label: Column, *aggs: Column) -> DataFrame:
    """Aggregates by label, with a TOTAL row."""
    rows = df.withColumn("label", label).rollup("label").agg(F.grouping("label").alias("__all"), *aggs)
    return rows.withColumn("label", F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col("label"))).drop("__all")


def country_stats(pairs: DataFrame) -> DataFrame:
    """Rows, distinct products and distinct (country, number, kind) by country, and in TOTAL."""
    triple = F.when(nonempty(F.col("patent_number")), F.concat_ws("|", country_label(), "patent_number", "kind_code"))
    return with_total(pairs.where(nonempty(F.col("product_id"))), country_label(), F.count("*").alias("n_rows"), F.count_distinct("product_id").alias("n_products"), F.count_distinct(triple).alias("n_patents"))


def pair_stats(rows: DataFrame) -> DataFrame:
    """Counts, distinct entities and coverage of a set of pairs, in one pass."""
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(F.concat_ws("|", "country_code", "patent_number", "kind_code")).alias("n_patents"),
        F.count_distinct("product_id").alias("n_products"),
        F.count_if(nonempty(F.col("patent_title"))).alias("with_title"),
        F.count_if("has_abstract").alias("with_abstract"),
        F.count_if("has_images").alias("with_images"),
        F.count_if(F.col("has_abstract") & F.col("has_images")).alias("with_both"),
    )


def entity_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """pair_stats over the first row of each entity whose key parts are all filled."""
    full = rows
    for k in keys:
        full = full.where(nonempty(F.col(k)))
    return pair_stats(first_wins(full, keys))


def _filled(rows: DataFrame, column: str) -> Column:
    """Whether a text, list or map has something in it; FALSE where ``rows`` lacks the column."""
    if column not in rows.columns:
        return F.lit(False)
    kind = dict(rows.dtypes)[column]
    return F.coalesce(F.size(column) > 0, F.lit(False)) if kind.startswith(("array", "map")) else nonempty(F.col(column).cast("string"))


def coverage_stats(rows: DataFrame) -> DataFrame:
    """One row over merged pairs: numbers of pairs, patents and products, how many have each field, and the combinations of
    modes. Patent fields are abstract, description, claims and images, product fields product_title, product_description, features
    and product_images; a column that is missing counts as empty."""
    has = lambda c: _filled(rows, c)
    fields = {"has_abstract": "abstract", "has_description": "description", "has_claims": "claims", "has_patent_images": "images", "has_title": "product_title", "has_product_description": "product_description", "has_features": "features", "has_product_images": "product_images"}
    modes = {"text_text": ("abstract", "product_title"), "image_image": ("images", "product_images"), "patent_text_product_image": ("abstract", "product_images")}
    triple = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("country_code", "patent_number", "kind_code")])
    return rows.agg(
        F.count("*").alias("total"),
        F.count_distinct(triple).alias("unique_patents"),
        F.count_distinct("product_id").alias("unique_products"),
        *[F.count_if(has(c)).alias(name) for name, c in fields.items()],
        *[F.count_if(has(a) & has(b)).alias(name) for name, (a, b) in modes.items()],
    )


def info_coverage(rows: DataFrame, order: str = "ord") -> DataFrame:
    """By country, and in TOTAL, over the first row of each (country, number, kind): how many there are, how many fetches
    failed, and how many of the others have each field. An ``error``, or no bibliography at all, is a failure."""
    keys = ["country_code", "patent_number", "kind_code"]
    first = first_wins(rows, keys, order)
    failed = F.col("bibliographic").isNull() | (F.col("error").isNotNull() if "error" in rows.columns else F.lit(False))
    has = lambda c: F.count_if(~failed & _filled(first, c)).alias(f"has_{c}")
    return with_total(first, country_label(), F.count("*").alias("total"), F.count_if(failed).alias("fetch_failed"), *[has(c) for c in ("abstract", "description", "claims", "images")])


def step_stats(rows: DataFrame) -> DataFrame | None:
    """The profile that fits a step's output: by source file, by coverage of patent fields, or by country; none fits other rows."""
    if "source_file" in rows.columns:
        patented = F.coalesce(F.col("extracted_patents") != "", F.lit(False)) if "extracted_patents" in rows.columns else F.lit(False)
        return with_total(rows, F.coalesce("source_file", F.lit("unknown")), F.count("*").alias("n_products"), F.count_if(patented).alias("n_patented"))
    if {"bibliographic", "country_code"} <= set(rows.columns):
        return info_coverage(rows.withColumn("ord", F.monotonically_increasing_id()))
    if {"product_id", "country_code", "patent_number", "kind_code"} <= set(rows.columns):
        return country_stats(rows)
    return None


def per_patent(rows: DataFrame) -> DataFrame:
    """Pairs for each distinct number, on average; numbers that are blank don't count."""
    some = rows.where(nonempty(F.col("patent_number")))
    return some.agg((F.count("*").cast("double") / F.greatest(F.count_distinct("patent_number"), F.lit(1))).alias("pairs_per_patent"))


def country_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("country_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country_code")


def us_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("country_code") == "US")


def is_active(status: Column, whole_word: bool = False) -> Column:
    """Status says active or granted; as a substring (so also in inactive) unless ``whole_word``."""
    low = F.lower(F.coalesce(status, F.lit("")))
    return low.rlike(r"\b(active|granted)\b") if whole_word else low.rlike("active|granted")


def sample(rows: DataFrame, keys: list[str], n: int = 20, seed: int = 42) -> DataFrame:
    """``n`` entities with complete keys, the first row of each, drawn by a hash of key and seed."""
    full = rows
    for k in keys:
        full = full.where(nonempty(F.col(k)))
    key = F.concat(*[F.col(k) for k in keys])
    return first_wins(full, keys).withColumn("draw", F.md5(F.concat(key, F.lit(f"#{seed}")))).orderBy("draw").limit(n)
