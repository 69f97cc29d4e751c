"""Sorted runs: flush, lookup across runs, compaction, entry encoding and block cuts."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.coding import varint_length
from palimpsest.model import BLOCK_SIZE, DELETE, PUT, RESTART_INTERVAL
from palimpsest.operators.ordered import key_blocks, previous, row_numbers, running_sum
from palimpsest.operators.resolve import live, newest


def generations(log: DataFrame, size: int) -> DataFrame:
    """The memtable generation of every version: ``size`` operations each."""
    return log.withColumn("gen", F.floor((F.col("seq") - 1) / size).cast("bigint"))


def flush(log: DataFrame) -> DataFrame:
    """The newest version of each key in each generation; tombstones stay, they hide older runs."""
    return newest(log, "seq", "gen", "k")


def first_hit(runs: DataFrame) -> DataFrame:
    """Of each key the newest run's entry, and the oldest's for comparison."""
    of = lambda pick, v, op: [pick(F.col("v"), F.col("gen")).alias(v), pick(F.col("op"), F.col("gen")).cast("bigint").alias(op)]
    return runs.groupBy("k").agg(*of(F.max_by, "newest", "nop"), *of(F.min_by, "oldest", "oop"))


def compact(runs: DataFrame, retain: int | None = None) -> DataFrame:
    """O2, O3: merge runs, newest entry of a key wins, deletions drop.

    With ``retain``, the oldest sequence a live snapshot sees, versions still visible to it stay: of each key all versions
    after it and the newest at or before it, tombstones included where they hide nothing below but answer a snapshot.
    """
    if retain is None:
        return live(newest(runs, "gen"))
    old = live(newest(runs.filter(F.col("seq") <= retain)))
    return old.unionByName(runs.filter(F.col("seq") > retain))


def run_stats(log: DataFrame) -> DataFrame:
    """Per generation: versions, entries, tombstones, smallest and largest key (real bounds, for pruning)."""
    per_key = log.groupBy("gen", "k").agg(F.count("*").alias("n"), F.max_by("op", "seq").alias("op"))
    return per_key.groupBy("gen").agg(
        F.sum("n").cast("bigint").alias("versions"), F.count("*").alias("entries"), F.count_if(F.col("op") == DELETE).alias("tombstones"), F.min("k").alias("smallest"), F.max("k").alias("largest")
    )


def dump(runs: DataFrame) -> DataFrame:
    """Every entry of a run as (k, found, deleted, v)."""
    return runs.select("gen", "k", F.lit(True).alias("found"), (F.col("op") == DELETE).alias("deleted"), F.when(F.col("op") == PUT, F.col("v")).alias("v"))


def seek(runs: DataFrame, target: str) -> DataFrame:
    """The entries of each run from the first key >= target on."""
    return runs.filter(F.col("k") >= target).select("gen", "k", "op", "v")


def shared_prefix(a: Column, b: Column) -> Column:
    """Bytes of the common beginning of two texts in UTF-8, of any length.  By halving: of the hexadecimal digits, whether
    ever longer beginnings are equal decides one binary digit of the length at a time."""
    x, y = F.hex(F.encode(a, "utf-8")), F.hex(F.encode(b, "utf-8"))
    most = (F.least(F.length(x), F.length(y)) / 2).cast("int")

    def step(acc, width):
        longer = acc["n"] + width
        same = (longer <= acc["most"]) & (F.substring(acc["x"], 2 * acc["n"] + 1, 2 * width) == F.substring(acc["y"], 2 * acc["n"] + 1, 2 * width))
        return F.struct(acc["x"].alias("x"), acc["y"].alias("y"), acc["most"].alias("most"), F.when(same, longer).otherwise(acc["n"]).alias("n"))

    start = F.struct(x.alias("x"), y.alias("y"), most.alias("most"), F.lit(0).alias("n"))
    widths = F.transform(F.sequence(F.length(F.bin(most)) - 1, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.coalesce(F.aggregate(widths, start, step)["n"], F.lit(0)).cast("bigint")


def entry_prefixes(keys: DataFrame, block: Column | None = None) -> DataFrame:
    """(k, slot, shared): place after the last restart, and bytes that the entry shares with the key before it."""
    block = key_blocks(keys, "k") if block is None else block
    placed = row_numbers(keys, block, [F.col("k")], "i")
    linked = previous(placed, block, F.col("k"), F.col("k"), "p")
    slot = F.pmod(F.col("i") - 1, F.lit(RESTART_INTERVAL))
    return linked.select("k", slot.alias("slot"), F.when((slot == 0) | F.col("p").isNull(), F.lit(0).cast("bigint")).otherwise(shared_prefix(F.col("k"), F.col("p"))).alias("shared"))


def block_cuts(entries: DataFrame, limit: int = BLOCK_SIZE) -> DataFrame:
    """(run, block, entries, bytes): a run's entries in key order, cut once a block has ``limit`` bytes or more.

    ``entries(run, k, size)``.  Every cut depends on the one before: each run is folded in order, runs side by side.
    """
    import pyarrow as pa

    import numpy as np

    def fold(batches):
        held, current, block = None, None, 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                now = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if held is None or not len(held[0]):
                continue
            run, size = held
            total, out, at = np.cumsum(size), [], 0
            ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, len(run))
            for end in ends.tolist():
                open_end = b is not None and end == len(run)  # the run may go on
                while at < end:
                    if run[at] != current:
                        current, block = run[at], 0
                    before = total[at - 1] if at else 0
                    to = int(np.searchsorted(total, before + limit)) + 1  # the entry that passes the limit still joins
                    if to > end:
                        if open_end:
                            break
                        to = end
                    out.append((current, block, to - at, total[to - 1] - before))
                    block, at = block + 1, to
            yield pa.RecordBatch.from_arrays([pa.array([int(x[c]) for x in out], pa.int64()) for c in range(4)], ["run", "block", "entries", "bytes"])
            held = [x[at:] for x in held]

    ordered = entries.select(F.col("run").cast("bigint"), "k", F.col("size").cast("bigint")).repartition("run").sortWithinPartitions("run", "k")
    return ordered.select("run", "size").mapInArrow(fold, "run bigint, block bigint, entries bigint, bytes bigint")


def entry_bytes(k: Column, v: Column) -> Column:
    """Bytes of a block entry that shares nothing: three varints, the key, and a type byte with the value."""
    key, value = F.octet_length(k).cast("bigint"), F.octet_length(v).cast("bigint") + 1
    return F.lit(1).cast("bigint") + varint_length(key) + varint_length(value) + key + value


def offsets(entries: DataFrame, block: Column | None = None) -> DataFrame:
    """Running file offset of ``entries(k, size)`` in key order."""
    block = key_blocks(entries, "k") if block is None else block
    placed = running_sum(entries, block, [F.col("k")], F.col("size"), "end")
    return placed.select("k", "size", (F.col("end") - F.col("size")).alias("off"))
