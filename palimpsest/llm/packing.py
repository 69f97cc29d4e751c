"""Best-fit packing by hierarchical residual packing.

Every partition best-fits its own pieces and emits the bins that are nearly full.  The bins that are not travel on as
items: rounds of groups of bounded size, dealt anew each time, best-fit them again, as a tree, until one group holds what
is left or no two bins fit together.
"""

from __future__ import annotations

import sys
import zlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import written
from palimpsest.llm.tokens import encoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A round that merges fewer than one in so many bins, and the next one too, are the last.
STALLED = 10_000

BIN = "fill int, closed boolean, doc array<bigint>, piece array<int>, length array<int>, crc array<bigint>, at array<int>, ids array<binary>"
BIN_ARROW = pa.schema([("fill", pa.int32()), ("closed", pa.bool_()), ("doc", pa.list_(pa.int64())), ("piece", pa.list_(pa.int32())), ("length", pa.list_(pa.int32())), ("crc", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("ids", pa.list_(pa.binary()))])


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Best-fit decreasing: the bin and the offset of each item.  Residuals are small integers, so a bit set finds the tightest bin."""
    by_residual: dict[int, list[int]] = {}
    open_residuals = bins = 0
    bin_of, at = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        if fits := open_residuals >> size:
            room = size + (fits & -fits).bit_length() - 1
            stack = by_residual[room]
            b = stack.pop()
            if not stack:
                open_residuals ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        bin_of[i], at[i] = b, capacity - room
        if room := room - size:
            by_residual.setdefault(room, []).append(b)
            open_residuals |= 1 << room
    return bin_of, at


def merged(items: list[tuple], capacity: int, slack: int, last: bool) -> pa.RecordBatch:
    """items: (fill, doc, piece, length, crc, at, ids), the last six as lists.  Bins as BIN_ARROW."""
    bin_of, base = best_fit([x[0] for x in items], capacity)
    bins: list[list] = [[0, False, [], [], [], [], [], []] for _ in range(max(bin_of, default=-1) + 1)]
    for x, b, start in zip(items, bin_of, base):
        to = bins[b]
        to[0] += x[0]
        for k in (1, 2, 3, 4, 6):
            to[k + 1 if k < 5 else 7].extend(x[k])
        to[6].extend(start + a for a in x[5])
    for x in bins:
        x[1] = last or x[0] >= capacity - slack
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in bins], f.type) for k, f in enumerate(BIN_ARROW)], schema=BIN_ARROW)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, slack: int = 2, local: int = 50_000, group: int = 65_536, keep_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens; other columns are ignored.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (unsigned 32-bit ids; null unless ``keep_ids``).
    Null text is empty, so it is the end id alone.  Rows that repeat, and null doc_ids, are packed each for itself; an
    empty table gives no rows; texts of any length are cut into as many pieces as they need, and equal sizes fall in any
    order.  Bins with at most ``slack`` free places are emitted at once; a task holds at most
    ``local`` pieces or ``group`` bins at a time.
    """
    import numpy as np

    def first(batches):
        enc, end = encoder(tokenizer), np.uint32(end_id).tobytes()
        held: list[tuple] = []
        for batch in batches:
            encoded = map(enc.encode, batch.column(1).to_pylist())
            for doc, ids in zip(batch.column(0).to_pylist(), encoded):
                ids += end
                for k in range(0, len(ids), 4 * capacity):
                    cut = ids[k : k + 4 * capacity]
                    held.append((len(cut) // 4, [doc], [k // (4 * capacity)], [len(cut) // 4], [zlib.crc32(cut)], [0], [cut if keep_ids else None]))
                if len(held) >= local:
                    yield merged(held, capacity, slack, False)
                    held = []
        if held:
            yield merged(held, capacity, slack, False)

    def again(last: bool):
        def run(table: pa.Table) -> pa.Table:
            columns = [table.column(n).to_pylist() for n in ("fill", "doc", "piece", "length", "crc", "at", "ids")]
            return pa.Table.from_batches([merged(list(zip(*columns)), capacity, slack, last)])

        return run

    level = written(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(first, BIN), "pack")
    full = [level.filter("closed")]
    before, stalled, turn = None, 0, 0
    while n := (rest := level.filter("not closed")).count():
        groups, turn = -(-n // group), turn + 1
        least = [r.fill for r in rest.select("fill").orderBy("fill").limit(2).collect()]
        stalled = stalled + 1 if before is not None and before - n <= n // STALLED else 0
        if groups > 1 and (sum(least) > capacity or stalled > 1):
            full.append(rest)  # no bin takes another
            break
        # The round salts the hash: a bin that found no partner meets others.
        merge = rest.withColumn("g", F.pmod(F.xxhash64("doc", "piece", "crc", F.lit(turn)), F.lit(groups)))
        level, before = written(merge.groupBy("g").applyInArrow(again(groups == 1), BIN), "pack"), n
        full.append(level.filter("closed"))
    bins = full[0]
    for x in full[1:]:
        bins = bins.unionByName(x)
    each = bins.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode(F.arrays_zip("doc", "piece", "length", "crc", "at", "ids")).alias("m"))
    return each.select(
        F.col("m.doc").alias("doc_id"), F.col("m.piece").alias("piece"), (F.col("m.piece").cast("bigint") * capacity).alias("start"), F.col("m.length").cast("bigint").alias("length"),
        F.col("m.crc").alias("ids_crc32"), "sequence_id", F.col("m.at").cast("bigint").alias("offset"), F.col("m.ids").alias("ids"),
    )
