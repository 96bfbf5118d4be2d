"""Mixing sources to target weights by pivotal dependent rounding.

Each document's expected copies are its source's target over its source's size. The whole part is taken as it is; the
fractions are rounded dependently: two documents exchange words, in a direction drawn so that both keep their
expectation, until one has a whole number of copies, and the other goes on. So the words taken from a source stay at
its target but for the one document left at the end, which is drawn by its own probability.

The reduction is a tree: rows are dealt into buckets of a bounded number of documents of one source, each bucket is
reduced to one residual document, and the residuals of each source form the buckets of the next level, until a source
has one left. No task ever sees more than a bucket, however large the source. Larger documents go first in a bucket, so
that smaller ones absorb their remainder. All draws come from hashes of the seed and the document, so reruns agree.

Defined results: a null or blank text has size 0 and takes 0; null sources form one source, the last; equal rows are
separate documents and take their copies one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovex.llm.runtime import materialize, ship, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_TIMES = 2.0
BUCKET = 256
WORD = r"[^\x20\x09-\x0D]+"
_DONE = 1e-7


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES) -> DataFrame:
    """(source, source_size, n_docs) rows of ``sizes`` plus the target of each: ``share`` of all words by weight, none above ``most_times`` its size.

    Weights repeat over the sources by code point, null last. Sources stand in order of the level at which they fill up;
    those that fill below the common level stay at their limit, the others share the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(most_times)))
    t = t.withColumn("level", F.col("most") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("common", (F.col("goal") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    t = t.withColumn("level_at_end", F.first(F.when(F.col("level") > F.col("common"), F.col("common")), ignorenulls=True).over(everything))
    # the first source that does not fill up sets the level for all after it
    t = t.withColumn("target", F.when(F.col("level_at_end").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * F.col("level_at_end"))))
    return t.select("source", "source_size", "n_docs", "target")


def _reduce_bucket(size: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> None:
    """Rounds ``mass`` (words above the whole copies, 0 to ``size``) in place to 0 or ``size`` for all rows but one at most."""
    draws = rng.random(len(size))
    s, m = size.tolist(), mass.tolist()
    carrier = -1
    for j in range(len(s)):
        if m[j] <= _DONE * s[j]:
            m[j] = 0.0
            continue
        if m[j] >= (1 - _DONE) * s[j]:
            m[j] = s[j]
            continue
        if carrier < 0:
            carrier = j
            continue
        i = carrier
        up, down = min(s[i] - m[i], m[j]), min(m[i], s[j] - m[j])
        d = up if draws[j] * (up + down) < down else -down
        m[i] += d
        m[j] -= d
        open_i = _DONE * s[i] < m[i] < (1 - _DONE) * s[i]
        open_j = _DONE * s[j] < m[j] < (1 - _DONE) * s[j]
        for k, still in ((i, open_i), (j, open_j)):
            if not still:
                m[k] = 0.0 if m[k] < 0.5 * s[k] else s[k]
        carrier = i if open_i else j if open_j else -1
    mass[:] = m


def _bucket_rounder(seed: int, level: int):
    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["size", "pick", "salt"], ascending=[False, True, True], kind="stable")
        size, mass = groups["size"].to_numpy(float), groups["mass"].to_numpy(float).copy()
        rng = np.random.default_rng([seed, level, int(groups["pick"].iloc[0]) & 0x7FFFFFFF, int(groups["bucket"].iloc[0])])
        _reduce_bucket(size, mass, rng)
        return groups.assign(mass=mass)

    return run


def pivotal_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES, bucket: int = BUCKET, seed: int = 20240229, size: Column | None = None, key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: its key (as doc_id), source, size, source_size, target, copies and taken words."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col("source").cast("string").alias("source"), (size_of(F.col("text")) if size is None else size).alias("size"), F.xxhash64("text").alias("salt"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("salt", F.monotonically_increasing_id())).otherwise(F.col("salt")))
    rows = materialize(rows)  # the only pass over the texts
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, share, most_times)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["source"]), "inner").drop(targets["source"])
    rows = rows.withColumn("whole", F.least(F.floor(rate + F.lit(1e-9)), F.lit(int(most_times)))).withColumn("mass", F.greatest(F.lit(0.0), rate - F.col("whole")) * F.col("size"))
    rows = rows.withColumn("pick", F.xxhash64(F.lit(seed), "doc_id", "size", "salt")).withColumn("buckets", F.ceil(F.col("n_docs") / bucket))
    state = rows.withColumn("bucket", F.pmod("pick", "buckets")).withColumn("live", F.col("mass") > 0)
    schema = state.schema
    state = materialize(state.groupBy("source", "bucket").applyInPandas(_bucket_rounder(seed, 0), schema))
    is_open = (F.col("mass") > F.col("size") * _DONE) & (F.col("mass") < F.col("size") * (1 - _DONE))
    done, rest, level = state.where(~is_open), state.where(is_open), 0
    while True:
        most = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        level += 1
        fresh = rest.withColumn("pick", F.xxhash64(F.lit(seed + level), "doc_id", "size", "salt")).withColumn("buckets", F.ceil(F.col("buckets") / bucket))
        fresh = fresh.withColumn("bucket", F.pmod("pick", "buckets"))
        fresh = materialize(fresh.groupBy("source", "bucket").applyInPandas(_bucket_rounder(seed, level), schema))
        done, rest = done.unionByName(fresh.where(~is_open)), fresh.where(is_open)
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "doc_id", "salt"), F.lit(1 << 30)) / float(1 << 30) * F.col("size") < F.col("mass")
    done = done.unionByName(rest.withColumn("mass", F.when(drawn, F.col("size").cast("double")).otherwise(0.0)))
    copies = (F.col("whole") + F.when(F.col("mass") > F.col("size") * 0.5, 1).otherwise(0)).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix(table(spark, sf_dir, "documents")).drop("source")
