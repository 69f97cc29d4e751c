"""What the operators share: the shared folder, written intermediate tables and a per-process worker cache."""

from __future__ import annotations

import contextlib
import os
import re
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Worker functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders that this process has written and not dropped.
_LEFT: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``clear`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here and a lost executor costs no recomputation.

    ``df.checkpoint()`` would run narrow Python stages twice (once to count, once to write).
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Jobs that are planned within hand Python batches of at most so many rows: for rows of many bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that are no longer read."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that are left, once the results that read them are stored."""
    for path in list(_LEFT):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _LEFT.discard(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text", "lang", "source", "n_chars")))


def worker_cache(name: str, make):
    """A value that lives on in the Python worker process, across the tasks it runs, until one of another name is asked for:
    a worker that goes on to another operator does not hold the tables of the last."""
    box = vars(sys.modules.setdefault("palimpsest_worker_cache", types.ModuleType("palimpsest_worker_cache"))).setdefault("held", {})
    if name not in box:
        box.clear()
        box[name] = make()
    return box[name]


def file_system(uri: str):
    """(pyarrow filesystem, path inside it) of a URI or a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))
