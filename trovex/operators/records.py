"""Raw product records: one schema for all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a product, and the source fields that may hold its id.
CANONICAL_FIELDS = ("product_id", "title", "description", "features", "images", "videos", "price", "rating", "details", "source_file", "extracted_patents")
ID_ALIASES = ("parent_asin", "asin")

_MAP = "map<string,string>"


def _fields(json: Column) -> Column:
    """A JSON object as a map; strings without quotes, other values as JSON text. Null if it is none."""
    return F.from_json(json, _MAP)


def record_id(fields: Column, id_field: str | None = None) -> Column:
    """struct(name, value): the first present of the explicit field, product_id and the aliases, even if its value is null."""
    names = [*([id_field] if id_field else []), "product_id", *ID_ALIASES]
    name = F.coalesce(*[F.when(F.map_contains_key(fields, n), F.lit(n)) for n in names])
    return F.struct(name.alias("name"), F.element_at(fields, name).alias("value"))


def normalize_products(raw: DataFrame, json: str = "value", id_field: str | None = None) -> DataFrame:
    """``raw`` records as product_id, the canonical fields as JSON text or strings, and ``details`` (a map).

    Records without an id, or with a null one, are rejected, as are texts that are no JSON object. Fields that are not
    canonical move into details, over those of the same name there; the explicit id field and the aliases do not, and
    product_id is never one. Details that are no object are kept under ``_raw``.
    """
    name = "__fields"
    while name in raw.columns:
        name = f"_{name}"
    rows = raw.withColumn(name, _fields(F.col(json)))
    fields = F.col(name)
    found = record_id(fields, id_field)
    no_map = F.from_json(F.lit("{}"), _MAP)
    text = fields["details"]
    details = F.when(text.isNull() | (text == ""), no_map).otherwise(F.coalesce(_fields(text), F.create_map(F.lit("_raw"), text)))
    extra = F.map_filter(fields, lambda k, v: ~k.isin(*CANONICAL_FIELDS) & (k != found["name"]))
    whole = F.map_concat(F.map_filter(details, lambda k, v: ~F.map_contains_key(extra, k)), extra)
    others = [c for c in CANONICAL_FIELDS if c not in ("product_id", "details")]
    kept = [F.col(f"`{c}`") for c in raw.columns if c not in (json, "product_id", "details", *others)]
    return rows.where(found["value"].isNotNull()).select(*kept, found["value"].alias("product_id"), *[fields[c].alias(c) for c in others], whole.alias("details"))


def top_level(rows: DataFrame, field: str, strict_compat: bool = False) -> Column:
    """A field that normalisation moved into details, read where later steps look for it; ``strict_compat`` finds nothing there."""
    own = F.col(field).cast("string") if field in rows.columns else F.lit(None).cast("string")
    return own if strict_compat else F.coalesce(own, F.col("details")[field])
