"""Session helpers: shipping the package to executors, the shared folder, reading tables."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_holds: dict[str, tuple[dict, ...]] = {}
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of every executor, once for each application.

    The archive goes through Spark's own file server, so no folder needs to be shared.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    if root.suffix != ".zip" and not str(root.parent).endswith(".zip"):
        out = Path(tempfile.mkdtemp(prefix="pkg")) / f"{root.name}-src.zip"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where that is unset, a temporary folder, but only in local mode:
    on a cluster a machine's own folder would lose rows."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no shared folder")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage and survives lost executors. The
    shuffle files of the write go with its end, the folder with the application's. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``materialize`` that nothing reads any more, long before the application ends."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` for working columns, each with as many underscores in front as make it differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file on the driver; the folder can be set with TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def ship_file(spark: SparkSession, path: str) -> str:
    """Sends a driver's file to every executor, once for each application; the name under which SparkFiles.get finds it."""
    sc = spark.sparkContext
    if (key := f"{sc.applicationId} {path}") not in _SHIPPED:
        sc.addFile(path)
        _SHIPPED.add(key)
    return os.path.basename(path)


def give_back() -> None:
    """Returns memory that this process does not use any more to the machine; else allocators keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_worker(owner: str, run: Callable[[Iterator], Iterator], keep: tuple[dict, ...] = (), drop: tuple[dict, ...] = ()) -> Callable[[Iterator], Iterator]:
    """``run`` for Python workers that are reused from stage to stage and wait, with all they hold, beside the stages in
    between. The tables ``keep`` are emptied when another owner's task comes to the worker, ``drop`` at the end of each task."""

    def held(batches: Iterator) -> Iterator:
        for other in [x for x in _holds if x != owner]:
            for cache in _holds.pop(other):
                cache.clear()
        _holds[owner] = keep
        try:
            yield from run(batches)
        finally:
            for cache in drop:
                cache.clear()
            give_back()

    return held
