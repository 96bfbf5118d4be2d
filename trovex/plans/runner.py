"""The dataset construction in seven steps, from a catalog to the merged pairs and examples, over a configuration file.

Steps hand each other JSON lines at the paths that the configuration names, so any of them can be run alone. Steps 2 and 3
stop for review: where the configuration names a reviewed file that is not there, the automatic output is written and
ReviewRequired raised; where it is there, its records replace the automatic ones.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.functions import citations as C
from trovex.operators import enrich as E
from trovex.operators import merge as G
from trovex.operators import pages as P
from trovex.operators.records import normalize_products
from trovex.sources import readers, sinks

log = logging.getLogger(__name__)
PAIR = "product_id string, patent_number string, country_code string, kind_code string, span_text string"


class ReviewRequired(Exception):
    """A step's output awaits review."""


class Config:
    """A nested configuration."""

    def __init__(self, values: Mapping[str, Any]):
        self.values = values

    @classmethod
    def load(cls, path: str) -> "Config":
        import yaml

        return cls(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})

    def get(self, dotted: str, default: Any = None) -> Any:
        at: Any = self.values
        for key in dotted.split("."):
            if not isinstance(at, Mapping) or key not in at:
                return default
            at = at[key]
        return at

    def need(self, dotted: str) -> Any:
        """The value, or a KeyError that names the part of the path that is missing."""
        at: Any = self.values
        path = dotted.split(".")
        for i, key in enumerate(path):
            if not isinstance(at, Mapping) or key not in at:
                raise KeyError(f"missing in the configuration: {'.'.join(path[: i + 1])}")
            at = at[key]
        return at


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def reviewed(spark: SparkSession, automatic: DataFrame, schema: str, output: str, review: str | None, step: str) -> DataFrame:
    """The reviewed records instead of the ``automatic`` ones, where a review is asked for; see ReviewRequired."""
    if not review:
        return automatic
    if not exists(spark, review):
        sinks.write_jsonl(automatic, output)
        raise ReviewRequired(f"{step}: review {output}, save the result as {review}, then run again")
    return readers.read_jsonl(spark, review, schema).drop("source_file", "raw_hash")


def _numbered(df: DataFrame) -> DataFrame:
    return df if "ord" in df.columns else df.withColumn("ord", F.monotonically_increasing_id())


def patented_products(spark: SparkSession, cfg: Config) -> DataFrame:
    """Step 1: records of all source files that mention a patent, each once, normalised."""
    raw = readers.read_folder(spark, cfg.need("source.input_dir"))
    first = raw.groupBy("raw_hash").agg(F.min_by(F.struct("ord", "source_file", "value"), "ord").alias("r")).select("r.*")
    rows = normalize_products(first.withColumnRenamed("source_file", "read_from"), id_field=cfg.get("source.product_id_field"))
    said = F.exists(F.array("title", "description", "features"), lambda t: C.mentions_patent(t))
    return rows.withColumn("source_file", F.col("read_from")).where(said).drop("ord", "read_from")


def interim_pairs(spark: SparkSession, cfg: Config) -> DataFrame:
    """Step 2: cited numbers of each product."""
    rows = readers.read_jsonl(spark, cfg.need("paths.raw_products"), "product_id string, title string, description string, features string")
    found = C.parse_citations(rows, "title", "description", "features")
    found = found.orderBy("ord", "field_no", "span_no", "number_no").select("product_id", "patent_number", "country_code", "kind_code", "span_text")
    return reviewed(spark, found, PAIR, cfg.need("paths.interim_pairs"), cfg.get("review_steps.step_02"), "step 2")


def _answers(spark: SparkSession, ids: DataFrame, cfg: Config, source: E.Source | None, cache: str | None) -> DataFrame:
    if source is None:
        raise ValueError("this step needs a source of pages")
    known = spark.read.parquet(cache) if cache and exists(spark, cache) else None
    return E.lookup(ids, source, known, partitions=int(cfg.get("scraping.max_workers", 5)))


def kind_codes(spark: SparkSession, cfg: Config, source: E.Source | None = None) -> DataFrame:
    """Step 3: the kind code of each pair, from the title of its page."""
    pairs = readers.read_jsonl(spark, cfg.need("paths.interim_pairs"), PAIR)
    ids = pairs.select(E.google_id(F.col("country_code"), F.col("patent_number")).alias("id")).where("id != ''")
    answers = _answers(spark, ids, cfg, source, None)
    kinds = answers.select("id", F.nullif(P.kind_of_title(P.page_title(F.col("value"))), F.lit("")).alias("value"))
    found = E.enrich_kinds(pairs, kinds).orderBy("ord").drop("ord", "source_file", "raw_hash")
    return reviewed(spark, found, PAIR, cfg.need("paths.pairs_with_kinds"), cfg.get("review_steps.step_03"), "step 3")


def patent_info(spark: SparkSession, cfg: Config, source: E.Source | None = None) -> DataFrame:
    """Step 4: each pair with its page's data; good answers are kept in the cache table."""
    pairs = readers.read_jsonl(spark, cfg.need("paths.pairs_with_kinds"), PAIR)
    cache = cfg.need("paths.patent_cache")
    ids = pairs.where("country_code != '' and patent_number != '' and kind_code != ''").select(F.concat(F.upper("country_code"), "patent_number", F.upper("kind_code")).alias("id"))
    answers = _answers(spark, ids, cfg, source, cache)
    E.cacheable(answers).write.mode("append").parquet(cache)
    answers = answers.where("error is not null").unionByName(spark.read.parquet(cache).groupBy("id").agg(F.max("value").alias("value")).withColumn("error", F.lit(None).cast("string")))
    return P.read_patent_pages(E.enrich_pages(pairs, answers)).orderBy("ord").drop("ord", "source_file", "raw_hash")


INFO = PAIR + ", error string, bibliographic map<string,string>, abstract string, description string, images array<string>, claims array<struct<text:string,claim_number:int,dependent:boolean,depends_on:int>>"


def clean_info(spark: SparkSession, cfg: Config) -> DataFrame:
    """Step 5: claims without the fragments of others."""
    from trovex.operators.claims import clean_claims

    rows = readers.read_jsonl(spark, cfg.need("paths.patent_info"), INFO)
    placed = F.transform("claims", lambda c, i: F.struct(c["claim_number"].alias("claim_number"), i.alias("ord"), c["text"].alias("text"), c["dependent"].alias("dependent"), c["depends_on"].alias("depends_on")))
    kept = F.transform(clean_claims(placed), lambda c: F.struct(c["text"], c["claim_number"], c["dependent"], c["depends_on"]))
    return rows.withColumn("claims", kept).orderBy("ord").drop("ord", "source_file", "raw_hash")


def merged_pairs(spark: SparkSession, cfg: Config) -> DataFrame:
    """Step 6: products and patents, a row for each pair."""
    pairs = readers.read_jsonl(spark, cfg.need("paths.patent_info_cleaned"), INFO).drop("source_file", "raw_hash")
    pairs = pairs.withColumn("patent_title", F.col("bibliographic")["DC.title"])
    products = readers.read_jsonl(spark, cfg.need("paths.raw_products"), "product_id string, title string, description string, features string, details map<string,string>").drop("source_file", "raw_hash")
    return G.merge_pairs(pairs, products.withColumn("brand", F.col("details")["Brand"])).orderBy("ord").drop("ord")


def examples(spark: SparkSession, cfg: Config) -> DataFrame:
    """Step 7: a sample of entities, the same whenever it is drawn."""
    rows = readers.read_jsonl(spark, cfg.need("paths.merged_dataset"), INFO + ", patent_title string, product_title string, brand string").drop("source_file", "raw_hash")
    return G.sample(rows, ["country_code", "patent_number", "kind_code"], int(cfg.get("examples.n", 20)), int(cfg.get("examples.seed", 42))).drop("ord", "draw")


STEPS: dict[int, tuple[str, Callable[..., DataFrame], str]] = {
    1: ("patented products", patented_products, "paths.raw_products"),
    2: ("interim pairs", interim_pairs, "paths.interim_pairs"),
    3: ("kind codes", kind_codes, "paths.pairs_with_kinds"),
    4: ("patent info", patent_info, "paths.patent_info"),
    5: ("clean claims", clean_info, "paths.patent_info_cleaned"),
    6: ("merged dataset", merged_pairs, "paths.merged_dataset"),
    7: ("examples", examples, "paths.examples"),
}
_ASKS = (3, 4)


def chosen_steps(steps: Iterable[int] | None = None, no_examples: bool = False) -> list[int]:
    """All steps in order, or those named; ValueError for a number that is none."""
    wanted = list(STEPS) if steps is None else list(steps)
    if wrong := [s for s in wanted if s not in STEPS]:
        raise ValueError(f"no such step: {wrong}; steps are 1 to {max(STEPS)}")
    return [s for s in STEPS if s in wanted and not (no_examples and s == 7)]


def run_pipeline(spark: SparkSession, config: Config | str, steps: Iterable[int] | None = None, no_examples: bool = False, source: E.Source | None = None) -> list[int]:
    """Runs the chosen steps in order and gives their numbers. A step's profile is written beside its output."""
    cfg = Config.load(config) if isinstance(config, str) else config
    done = []
    for number in chosen_steps(steps, no_examples):
        name, step, output = STEPS[number]
        log.info("step %d: %s", number, name)
        result = step(spark, cfg, source) if number in _ASKS else step(spark, cfg)
        path = cfg.need(output)
        sinks.write_jsonl(result, path)
        if profile := G.step_stats(result):
            sinks.write_csv_stats(profile, sinks.stats_path(path))
        done.append(number)
    return done


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("--steps", nargs="+", type=int)
    p.add_argument("--no-examples", action="store_true")
    a = p.parse_args(argv)
    run_pipeline(SparkSession.builder.getOrCreate(), a.config, a.steps, a.no_examples)


if __name__ == "__main__":
    main()
