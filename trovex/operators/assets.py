"""Visual assets: what there is to fetch, where it belongs, what is there already, and reports. Fetching itself is left to a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovex.functions.text import sanitize
from trovex.operators.order import first_wins
from trovex.operators.pages import file_name

# The sizes of a product image, and the folders of a patent image.
SIZES = ("thumb", "large", "hi_res")
FOLDERS = {"thumbnail": "thumb", "highres_matched": "hi_res", "highres_additional": "hi_res"}


def product_images(rows: DataFrame, images: str = "images") -> DataFrame:
    """(ord, product_id, url, type, subtype) for each size that an image of ``rows`` (ord, product_id, images: array of struct of SIZES) has."""
    kinds = rows.schema[images].dataType.elementType.names
    each = rows.select("ord", "product_id", F.explode(images).alias("i"))
    sizes = F.array(*[F.struct(F.lit(s).alias("subtype"), F.col(f"i.{s}").alias("url")) for s in SIZES if s in kinds])
    found = each.select("ord", "product_id", F.explode(sizes).alias("x")).where(F.coalesce(F.col("x.url") != "", F.lit(False)))
    return found.select("ord", "product_id", "x.url", F.lit("product_image").alias("type"), "x.subtype")


def is_link(url: Column) -> Column:
    return F.coalesce(F.startswith(url, F.lit("http")), F.lit(False))


def dedup_key(rows: DataFrame) -> Column:
    """What makes two assets one: product images by product, size and URL, videos by product and URL, patent images by patent, resolution and URL, others by URL."""
    col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    t = F.col("type")
    return (
        F.when(t == "product_image", F.array(t, col("product_id"), col("subtype"), col("url")))
        .when(t == "product_video", F.array(t, col("product_id"), col("url")))
        .when(t == "patent_image", F.array(t, col("patent_number"), col("resolution"), col("url")))
        .otherwise(F.array(F.lit("other"), col("url")))
    )


def distinct_assets(rows: DataFrame) -> DataFrame:
    """The first of each asset."""
    return first_wins(rows.withColumn("asset_key", dedup_key(rows)), ["asset_key"]).drop("asset_key")


def _hashed(name: Column, url: Column) -> Column:
    """A file name with eight digits of the URL's SHA-256 before its extension."""
    mark = F.substring(F.sha2(url.cast("binary"), 256), 1, 8)
    stem, ext = F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(name, r"^(.*)\.([^.]*)$", 2)
    return F.when(name.rlike(r"\."), F.concat(stem, F.lit("_"), mark, F.lit("."), ext)).otherwise(F.concat(name, F.lit("_"), mark))


def target_path(rows: DataFrame) -> Column:
    """Where an asset belongs below the output folder; the hash keeps equal names apart."""
    col = lambda c, d: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(d)) if c in rows.columns else F.lit(d)
    url, t = F.col("url"), F.col("type")
    name = sanitize(_hashed(file_name(url), url))
    folder = F.create_map(*[F.lit(x) for k, v in FOLDERS.items() for x in (k, v)])
    resolution = col("resolution", "unknown")
    return (
        F.when(t == "product_image", F.concat_ws("/", F.lit("products"), col("product_id", "UNKNOWN_PRODUCT"), F.lit("images"), col("subtype", "image"), name))
        .when(t == "product_video", F.concat_ws("/", F.lit("products"), col("product_id", "UNKNOWN_PRODUCT"), F.lit("videos"), name))
        .when(t == "patent_image", F.concat_ws("/", F.lit("patents"), col("patent_number", "UNKNOWN_PATENT"), F.coalesce(F.try_element_at(folder, resolution), F.concat(F.lit("images_"), resolution)), name))
        .otherwise(F.concat_ws("/", F.lit("other"), name))
    )


def to_fetch(tasks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tasks without a good last entry in the manifest."""
    return tasks.join(manifest.select("url").distinct(), "url", "left_anti")


def with_assets(rows: DataFrame, assets: DataFrame, key: str = "product_id", present: bool = True) -> DataFrame:
    """Rows whose key has an asset, or has none."""
    return rows.join(assets.select(key).distinct(), key, "left_semi" if present else "left_anti").select(*rows.columns)


def failures(entries: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` entries that failed: a report, so cut on purpose."""
    return entries.where(~F.coalesce(F.col("downloaded"), F.lit(False))).orderBy("ord").limit(most)
