"""Committed entries applied to keyed state as a stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.resolve import live, newest
from palimpsest.store import Store


def versions_stream(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """A stream of the Parquet files of a change log, ``max_files`` a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def resolved(stream: DataFrame) -> DataFrame:
    """Newest version of every key; the sequence is kept with it, so a version that comes twice or late changes nothing."""
    return stream.groupBy("k").agg(F.max_by(F.struct("op", "v", "seq"), F.col("seq")).alias("r")).select("k", "r.op", "r.v", "r.seq")


def apply_available(stream: DataFrame, folder: str) -> DataFrame:
    """Apply all that is there to the state, and return the live state.  Checkpoint and state lie under ``folder``: a later
    call goes on where this one ended.  A micro-batch writes the keys that it changed, in a folder of its own: one that is
    run again after a crash writes the same folder again, and loses nothing of the others."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")

    run = resolved(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return live(newest(spark.read.schema("k string, op int, v string, seq bigint").parquet(f"{folder}/state"))).select("k", "v", "seq")


def into_store(stream: DataFrame, store: Store, folder: str) -> None:
    """Apply ``stream(pos, op, k, v)`` to a store, one atomic batch a micro-batch; the checkpoint makes a restart go on
    after the last batch, and a batch that is run again is recognised by its epoch in the store's manifest."""

    def write(batch: DataFrame, epoch: int) -> None:
        if epoch > store._state.get("epoch", -1) and not batch.isEmpty():
            store._state["epoch"] = epoch
            store.write_frame(batch)

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", folder).trigger(availableNow=True).start()
    run.awaitTermination()


def scratch(spark: SparkSession) -> str:
    """A new folder where driver and executors both can write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
