"""Enrichment of pairs from a pluggable source: each distinct id is looked up once, known answers come from a cache table.

A source is a function of an id that gives a text, None or raises; Throttled asks for another try. It runs on executors,
on batches of distinct ids, so the number of partitions bounds how many requests are under way.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovex.functions.text import nonempty, patent_id

# Tries after the first, and the seconds before each.
RETRIES = 3
RETRY_SECONDS = 2.0

Source = Callable[[str], str | None]
_SCHEMA = "id string, value string, error string"


class Throttled(Exception):
    """The source asks to come back later."""


def ask(source: Source, key: str, retries: int = RETRIES, wait: float = RETRY_SECONDS) -> tuple[str | None, str | None]:
    """(value, error) of one id; only throttling is tried again, after 2, 4 and 8 times ``wait`` / 2."""
    for attempt in range(retries + 1):
        try:
            return source(key), None
        except Throttled as e:
            if attempt == retries:
                return None, f"Throttled: {e}"
            time.sleep(wait * 2**attempt)
        except Exception as e:  # a source's failure is a row's error, not the job's
            return None, f"{type(e).__name__}: {e}"
    return None, None


def lookup(ids: DataFrame, source: Source, cache: DataFrame | None = None, partitions: int = 5, retries: int = RETRIES, wait: float = RETRY_SECONDS) -> DataFrame:
    """(id, value, error) for each distinct ``id`` of ``ids``: from ``cache`` (id, value) where it has a value, else from the source."""
    wanted = ids.where(nonempty(F.col("id"))).select("id").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [ask(source, k, retries, wait) for k in batch["id"]]
            yield pd.DataFrame({"id": batch["id"], "value": [a for a, _ in answers], "error": [e for _, e in answers]})

    if cache is None:
        return wanted.repartition(partitions, "id").mapInPandas(run, _SCHEMA)
    known = cache.where("value is not null").groupBy("id").agg(F.max("value").alias("value"))
    fresh = wanted.join(known, "id", "left_anti").repartition(partitions, "id").mapInPandas(run, _SCHEMA)
    return wanted.join(known, "id").select("id", "value", F.lit(None).cast("string").alias("error")).unionByName(fresh)


def cacheable(answers: DataFrame) -> DataFrame:
    """(id, value) of the answers worth keeping: failures are asked again next time."""
    return answers.where("value is not null and error is null").select("id", "value")


def google_id(country: Column, number: Column) -> Column:
    return F.replace(F.concat(country, number), F.lit("."), F.lit(""))


def enrich_kinds(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """``pairs`` with the kind code that ``answers`` (id, value) give, also over one already there; without a number or country the own one stays, null if empty."""
    full = nonempty(F.col("patent_number")) & nonempty(F.col("country_code"))
    keyed = pairs.withColumn("__id", F.when(full, google_id(F.col("country_code"), F.col("patent_number"))))
    found = answers.select(F.col("id").alias("__id"), F.col("value").alias("__kind"))
    out = keyed.join(found, "__id", "left").withColumn("kind_code", F.when(full, F.col("__kind")).otherwise(F.nullif("kind_code", F.lit(""))))
    return out.select(*[F.col(f"`{c}`") for c in pairs.columns])


def enrich_pages(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """``pairs`` without span_text, with the page (``html``) and error of their complete id; incomplete ids have neither."""
    full = nonempty(F.col("patent_number")) & nonempty(F.col("country_code")) & nonempty(F.col("kind_code"))
    keyed = pairs.drop("span_text").withColumn("__id", F.when(full, patent_id(F.col("country_code"), F.col("patent_number"), F.col("kind_code"))))
    found = answers.select(F.col("id").alias("__id"), F.col("value").alias("html"), "error")
    return keyed.join(found, "__id", "left").drop("__id")
