"""Files for queries that show a reader and a writer at work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from trovex.sources import readers, sinks


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder; below a temporary one only in local mode. It goes with the application."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.gettempdir()
    path = f"{folder.rstrip('/')}/rt-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def round_trip(df: DataFrame, schema: str, gzip: bool = False) -> DataFrame:
    """``df`` written as JSON lines and read again."""
    path = scratch(df.sparkSession)
    sinks.write_jsonl(df, path, gzip=gzip)
    return readers.read_folder(df.sparkSession, path, schema, "*.json.gz" if gzip else "*.json")
