"""The download manifest as a stream: new files are folded into the latest entry of each URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.operators.order import last_wins


def latest_entries(entries: DataFrame) -> DataFrame:
    """The last entry of each URL, if it succeeded."""
    return last_wins(entries, ["url"]).where("downloaded")


def fold_manifest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Streams Parquet files of entries into ``target``/batch=N, each batch already reduced to its last entry by URL; latest_entries over
    the target then gives the state. A batch is overwritten as a whole, so a repeated one changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        last_wins(batch, ["url"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    return latest_entries(spark.read.parquet(target).drop("batch").withColumn("ord", F.col("ord")))
