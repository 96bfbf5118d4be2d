"""Readers with an explicit row order, and listings of file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.functions.text import split_bullets
from trovex.operators.order import first_wins


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_path"), F.monotonically_increasing_id().alias("line_id")).where(F.trim("value") != "")


def read_records(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON lines, plain or gzip, as (ord, source_file, raw_hash, value): blank lines go; malformed ones go too, or raise if
    ``strict``. ``ord`` follows files by name, then lines; ``raw_hash`` is the MD5 of the record with sorted keys, so 1 and 1.0 count as equal."""
    read = F.parse_json("value") if strict else F.try_parse_json("value")
    rows = _lines(spark, path).withColumn("v", read).where("v is not null")
    name = F.element_at(F.split("source_path", "/"), -1)
    return rows.select(F.struct(name.alias("file"), "line_id").alias("ord"), name.alias("source_file"), F.md5(F.to_json("v").cast("binary")).alias("raw_hash"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """read_records with the fields of ``schema``."""
    return read_records(spark, path, strict).withColumn("r", F.from_json("value", schema)).select("ord", "source_file", "raw_hash", "r.*")


def read_folder(spark: SparkSession, folder: str, schema: str | None = None, pattern: str = "*.jsonl.gz") -> DataFrame:
    """All files of a folder whose names match, in the order of their names; raises if there is none. A file that breaks off
    midway gives what it holds up to there, and the rest of the folder is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    if not files.limit(1).count():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    key = "spark.sql.files.ignoreCorruptFiles"
    rows = read_records(spark, f"{folder.rstrip('/')}/{pattern}") if spark.conf.get(key, "false") == "true" else _tolerant(spark, f"{folder.rstrip('/')}/{pattern}")
    return rows if schema is None else rows.withColumn("r", F.from_json("value", schema)).select("ord", "source_file", "raw_hash", "r.*")


def _tolerant(spark: SparkSession, path: str) -> DataFrame:
    """read_records with the reader's own option, which no other reader of the session shares."""
    lines = spark.read.option("ignoreCorruptFiles", "true").text(path).select("value", F.col("_metadata.file_path").alias("source_path"), F.monotonically_increasing_id().alias("line_id")).where(F.trim("value") != "")
    rows = lines.withColumn("v", F.try_parse_json("value")).where("v is not null")
    name = F.element_at(F.split("source_path", "/"), -1)
    return rows.select(F.struct(name.alias("file"), "line_id").alias("ord"), name.alias("source_file"), F.md5(F.to_json("v").cast("binary")).alias("raw_hash"), "value")


def read_json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON value: an object is a row, a list one for each element. Malformed JSON raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def convert_catalog(catalog: DataFrame, id_field: str = "parent_asin", locale: str = "us", order: str = "ord") -> DataFrame:
    """A catalog (product_id, product_locale, product_title, product_description, product_bullet_point, product_brand,
    product_color, and a row order) in the schema of the larger source: the rows of one locale, the first of each id. The
    description becomes a list of one, bullet points a list, brand and colour details; what the catalog lacks is empty.
    The filter and the columns reach the scan."""
    rows = first_wins(catalog.where(F.col("product_locale") == locale), ["product_id"], order)
    has = lambda c: F.trim(F.col(c)) if c in rows.columns else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    one = F.when(has("product_description") != "", F.array(has("product_description"))).otherwise(none)
    bullets = F.coalesce(split_bullets(has("product_bullet_point")), none)
    details = F.map_filter(F.create_map(F.lit("Brand"), has("product_brand"), F.lit("Color"), has("product_color")), lambda k, v: F.coalesce(v != "", F.lit(False)))
    title = F.coalesce(has("product_title"), F.lit("")).alias("title")
    return rows.select(F.col("product_id").cast("string").alias(id_field), title, one.alias("description"), bullets.alias("features"), none.alias("categories"), details.alias("details"), none.alias("images"), none.alias("videos"))


def list_assets(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def assets_of(files: DataFrame, folder: str) -> DataFrame:
    """(id, path, name, kind) of the files <folder>/<id>/[images/]<kind>/<name> among ``files`` (path)."""
    below = F.regexp_extract("path", rf"/{folder}/([^/]+)/(?:images/)?([^/]+)/([^/]+)$", 1)
    part = lambda g: F.regexp_extract("path", rf"/{folder}/([^/]+)/(?:images/)?([^/]+)/([^/]+)$", g)
    return files.where(below != "").select(part(1).alias("id"), "path", part(3).alias("name"), part(2).alias("kind"))


def pick_image(assets: DataFrame, kinds: tuple[str, ...] = ("hi_res",), prefer: str | None = None) -> DataFrame:
    """(id, path): each id's image, of the first of ``kinds`` that it has, names that start with ``prefer`` (whatever the case) before others, then by name."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(kinds)])
    other = F.lit(0) if prefer is None else (~F.startswith(F.lower("name"), F.lit(prefer.lower()))).cast("int")
    return assets.where(F.col("kind").isin(*kinds)).groupBy("id").agg(F.min_by("path", F.struct(rank.alias("r"), other.alias("o"), "name", "path")).alias("path"))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where("trim(value) != ''").count()
