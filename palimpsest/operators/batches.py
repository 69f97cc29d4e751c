"""Write batches: sequence numbers, sizes, validation and group commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.coding import batch_bytes, record_bytes
from palimpsest.model import FRAME_HEADER, GROUP_COMMIT_BYTES, PUT
from palimpsest.operators.ordered import row_numbers, running_sum


def expand(batches: DataFrame) -> DataFrame:
    """Versions of ``batches(base_seq, ops array<struct<op, k, v>>)``; each operation takes the next sequence."""
    each = batches.select("base_seq", F.posexplode("ops").alias("pos", "o"))
    return each.select("o.k", (F.col("base_seq") + F.col("pos")).alias("seq"), "o.op", F.when(F.col("o.op") == PUT, F.col("o.v")).otherwise("").alias("v"))


def concatenate(batches: DataFrame, order: str) -> DataFrame:
    """One batch of all, in order: sequences go on from the least base and counts add up."""
    base = batches.agg(F.min("base_seq").alias("first"))
    each = batches.select(F.col(order).alias("_o"), F.posexplode("ops").alias("pos", "o"))
    numbered = row_numbers(each, F.floor(F.col("_o") / 1_000), [F.col("_o"), F.col("pos")], "n")
    return numbered.crossJoin(F.broadcast(base)).select("o.k", (F.col("first") + F.col("n") - 1).alias("seq"), "o.op", F.when(F.col("o.op") == PUT, F.col("o.v")).otherwise("").alias("v"))


def repeated(versions: DataFrame) -> DataFrame:
    """(k, seq, op, n): versions that are there more than once; a well-formed store has none."""
    return versions.groupBy("k", "seq", "op").agg(F.count("*").alias("n")).filter("n > 1")


def validate(batches: DataFrame, count: str = "cnt") -> DataFrame:
    """(bid, status): OK, or why the batch is corrupt.  All or nothing: a faulty batch applies no record."""
    bad = F.exists("ops", lambda o: ~o["op"].isin(0, 1))
    slices = F.exists("ops", lambda o: o["k"].isNull() | ((o["op"] == PUT) & o["v"].isNull()))
    return batches.select("bid", F.when(bad, "unknown tag").when(slices, "bad slice").when(F.size("ops") != F.col(count), "wrong count").otherwise("OK").alias("status"))


def headers(log: DataFrame, batch: Column) -> DataFrame:
    """(bid, base_seq, cnt, rep_size) of the batches that ``batch`` makes of the log."""
    size = batch_bytes(F.sum(record_bytes(F.col("op"), F.col("k"), F.col("v"))))
    return log.groupBy(batch.cast("bigint").alias("bid")).agg(F.min("seq").alias("base_seq"), F.count("*").alias("cnt"), size.cast("bigint").alias("rep_size"))


def frames(log: DataFrame, batch: Column) -> DataFrame:
    """(bid, frame, off): every batch framed by its length, and where the frame begins in the file."""
    framed = headers(log, batch).select("bid", (F.col("rep_size") + FRAME_HEADER).alias("frame"))
    placed = running_sum(framed, F.floor(F.col("bid") / 10_000), [F.col("bid")], F.col("frame"), "off")
    return placed.select("bid", "frame", (F.col("off") - F.col("frame")).alias("off"))


def group_commit(sizes: DataFrame, limit: int = GROUP_COMMIT_BYTES) -> DataFrame:
    """(grp, n, bytes): queued batches join a group until its bytes pass ``limit``; the one that passes it still joins.

    Each cut depends on all batches before it, so the queue of a writer is streamed through one task in order, two
    numbers a batch and constant memory; queues of several writers run side by side in partitions of their own.
    """
    import pyarrow as pa

    def fold(batches):
        group = n = acc = 0
        out = []
        for b in batches:
            for size in b.column(1).to_pylist():
                if acc > limit:
                    out.append((group, n, acc))
                    group, n, acc = group + 1, 0, 0
                n, acc = n + 1, acc + size
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["grp", "n", "bytes"])
            out = []
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (group, n, acc)], ["grp", "n", "bytes"])

    ordered = sizes.select(F.col("bid").cast("bigint"), F.col("size").cast("bigint")).repartition(1).sortWithinPartitions("bid")
    return ordered.mapInArrow(fold, "grp bigint, n bigint, bytes bigint")
