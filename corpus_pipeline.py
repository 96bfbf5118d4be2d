"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``. Decisions are made and applied row by row, also
where rows share a doc_id or have none. Working columns take names that ``docs`` does not have. All stages take an empty
table, for an empty result; each says what becomes of null and empty texts and of repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.llm.bpe_prefix import bpe_encode
from trovex.llm.line_join import drop_similar_lines
from trovex.llm.minhash_circulant import near_duplicates
from trovex.llm.mix_pivotal import pivotal_mix
from trovex.llm.quality_suffix import suffix_repetition
from trovex.llm.runtime import fresh_names, materialize, table


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rules or the repetition limits; null and empty texts fail them. Equal rows are judged alike."""
    mark = fresh_names(docs, "q_")[0]
    judged = suffix_repetition(docs, carry=tuple(docs.columns), prefix=mark)
    return judged.where(f"`{mark}kept`").select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later lines that are similar to an earlier one of the corpus; a text of which nothing stays goes. Null and
    empty texts stay; rows equal in doc_id and text are one document here, and both stay or go."""
    return drop_similar_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five-word shingles, Jaccard 0.8): that with the smallest doc_id, none
    last. Rows without a word all stay; of rows equal in doc_id and text one stays."""
    doc, row, stay_doc, stay_row, some = fresh_names(docs, "doc", "row", "stay_doc", "stay_row", "some")
    found = near_duplicates(docs, shingle_words=5, percent=80).where("stays")
    stays = found.groupBy(F.col("doc_id").alias(stay_doc), F.col("row").alias(stay_row)).agg((F.max("n_shingles") > 0).alias(some))
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), row: F.xxhash64("text")})
    kept = keyed.join(stays.hint("merge"), F.col(doc).eqNullSafe(F.col(stay_doc)) & (F.col(row) == F.col(stay_row)))
    # rows without a word are told apart by a number, so that none of them goes
    kept = kept.withColumn(stay_row, F.when(~F.col(some), F.monotonically_increasing_id()))
    return kept.dropDuplicates([doc, row, stay_row]).select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source comes to its target; a document's copies are equal rows. Rows
    equal in all columns are drawn one by one, and come as often as all of them were drawn. Rows without a word take no
    part in the mix and pass once."""
    key, mixed_key, copies, copy = fresh_names(docs, "key", "mixed_key", "copies", "copy")
    everything = _columns(docs)
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(~wordless).withColumn(key, F.concat(F.hex(F.xxhash64(*everything)), F.lit("-"), F.hex(F.xxhash64(F.lit(5), *everything))))
    mixed = pivotal_mix(keyed, key=key).groupBy(F.col("doc_id").alias(mixed_key)).agg(F.sum("copies").cast("int").alias(copies))
    both = keyed.dropDuplicates([key]).join(mixed.where(f"{copies} > 0").hint("merge"), F.col(key) == F.col(mixed_key))
    repeated = both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*everything)
    return repeated.unionByName(docs.where(wordless))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the text they decode to; null counts as empty."""
    return bpe_encode(docs, keep_ids=True, digests=True).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("bpe encode", encode),
]

#: Suffix arrays and BPE are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
