"""SimHash near-duplicates: fingerprints, a segment-popcount grid join, and components.

A fingerprint maps to its bit counts in 32 segments of two bits.  The Manhattan distance of two such vectors never
exceeds the Hamming distance of the fingerprints, so at most ``distance`` of any blocks of segments can differ: of B
blocks, some B - distance agree whole.  Each choice of that many blocks is a grid; fingerprints meet in its cells.  In a
cell they are ranged by their total count, held to the Manhattan distance, and verified exactly.  Counts are written in
unary, two bits a segment, so that the Manhattan distance is that of the bits.  Cells emit a spanning forest of
their links, never all pairs; cells of more than ``HOT`` members are dealt out as pairs of chunks.
"""

from __future__ import annotations

import itertools
import math
import sys
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import drop, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
#: Shingle hashes whose bits are counted at once.
COUNTED = 1 << 18
#: Texts whose shingles are hashed together.
TEXTS = 64
#: Members of a cell that one task compares with each other.
HOT = 4096
#: Groups up to this size are compared by shifted arrays, larger ones row by row.
SMALL = 24
#: Pairs of fingerprints that are compared at the cost of one more row that is dealt to a cell.
PAIRS = 30
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | None, words: int = 3) -> list[int]:
    """XXH64 of every shingle, repeats included, of the text with A-Z lowered; fewer words: of the whole sequence; none: empty."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()
    if len(found) <= words:
        return [xxh64_intdigest(b" ".join(found), SEED)] if found else []
    joined = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    return [xxh64_intdigest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :])]


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text: a bit is 1 if set in over half of its shingles' hashes."""
    return majority([shingle_hashes(t, words) for t in texts])


def majority(texts: list) -> np.ndarray:
    """The fingerprints of texts given as the hashes of their shingles."""
    counts, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, owner = [], []

    def count():
        h = np.concatenate([np.array(x, "<u8") for x in held])
        per = np.array([len(x) for x in held])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(counts, owner, np.add.reduceat(bits, np.append(0, np.cumsum(per)[:-1]), axis=0, dtype=np.int32))
        held.clear()
        owner.clear()

    waiting = 0
    for i, h in enumerate(texts):
        sizes[i] = len(h)
        for k in range(0, len(h), COUNTED):
            held.append(h[k : k + COUNTED])
            owner.append(i)
            waiting += len(held[-1])
            if waiting >= COUNTED:
                count()
                waiting = 0
    if held:
        count()
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (signed 64 bits) of every row of ``docs(doc_id, text)``; null or wordless text: zero."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            fp = np.concatenate([fingerprints(texts[k : k + TEXTS], words) for k in range(0, len(texts), TEXTS)] + [np.zeros(0, "<u8")])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view("<i8"))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def blocks_for(n: int, distance: int) -> int:
    """The number of blocks with the least cost for ``n`` unrelated fingerprints: a row a grid, and the pairs within its cells.
    Any number gives the same links."""
    cost = lambda b: math.comb(b, distance) * (1 + n * 0.375 ** (32 * (b - distance) / b) / PAIRS)
    return min(range(distance + 2, distance + 14), key=cost)


def masks(blocks: int, distance: int) -> list[int]:
    """For each grid, the bits of the segment counts that make its cell (as signed 64 bits)."""
    cut = [round(k * 32 / blocks) for k in range(blocks + 1)]
    part = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cut, cut[1:])]
    return [int(np.uint64(sum(part[k] for k in kept)).astype(np.int64)) for kept in itertools.combinations(range(blocks), blocks - distance)]


def counted(fp: np.ndarray) -> np.ndarray:
    """The counts of the 32 segments in unary: 00, 01 or 11.  Vectors differ in as many bits as their Manhattan distance."""
    ones = np.uint64(0x5555555555555555)
    low, high = fp & ones, (fp >> np.uint64(1)) & ones
    return low | high | (low & high) << np.uint64(1)


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one cell's distinct fingerprints, as index pairs."""
    total = np.bitwise_count(fp).astype(np.int64)
    order = np.argsort(total, kind="stable")
    fp, total = fp[order], total[order]
    vector = counted(fp)
    label = np.arange(len(fp))
    upto = np.searchsorted(total, total + distance, side="right")
    out = []
    for i in range(len(fp) - 1):
        near = np.flatnonzero(np.bitwise_count(vector[i + 1 : upto[i]] ^ vector[i]) <= distance) + i + 1
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= distance]
        if len(near):
            joined, first = np.unique(label[near], return_index=True)
            other = joined != label[i]
            if other.any():
                out += [(order[i], order[j]) for j in near[first[other]]]
                label[np.isin(label, joined[other])] = label[i]
    return out


def cell_links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole cells, rows sorted by cell; ``key`` numbers the cells."""
    size = np.bincount(key)
    a, b = [], []
    small = np.flatnonzero((size[key] > 1) & (size[key] <= SMALL))
    k, f = key[small], fp[small]
    vector = counted(f)
    for d in range(1, SMALL):
        if d >= len(k):
            break
        i = np.flatnonzero(k[:-d] == k[d:])
        if not len(i):
            break
        i = i[np.bitwise_count(vector[i] ^ vector[i + d]) <= distance]
        i = i[np.bitwise_count(f[i] ^ f[i + d]) <= distance]
        a.append(f[i])
        b.append(f[i + d])
    starts = np.cumsum(size) - size
    for c in np.flatnonzero(size > SMALL):
        members = fp[starts[c] : starts[c] + size[c]]
        if pairs := forest(members, distance):
            x = np.array(pairs)
            a.append(members[x[:, 0]])
            b.append(members[x[:, 1]])
    return np.concatenate([*a, np.zeros(0, "<u8")]), np.concatenate([*b, np.zeros(0, "<u8")])


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) that connect every two of ``distinct(fp)`` at ``distance`` or fewer bits, directly or through others as near."""
    grids = masks(blocks_for(distinct.count(), distance), distance)
    counts = F.col("fp").bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(0x5555555555555555))
    vector = counts.bitwiseOR(high).bitwiseOR(F.shiftleft(counts.bitwiseAND(high), 1))  # as ``counted``
    cells = distinct.select("fp", F.posexplode(F.array(*[vector.bitwiseAND(F.lit(m)) for m in grids])).alias("grid", "cell"))
    full = cells.groupBy("grid", "cell").count().filter(F.col("count") > HOT).withColumn("chunks", F.ceil(F.col("count") / HOT).cast("int")).drop("count")
    mine = F.pmod(F.xxhash64("fp", "grid"), F.col("chunks")).cast("int")
    dealt = cells.join(full, ["grid", "cell"], "left").withColumn("mine", mine)
    whole = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: k != F.col("mine")), lambda k: F.struct(F.least(k, F.col("mine")).alias("x"), F.greatest(k, F.col("mine")).alias("y")))
    dealt = dealt.select("grid", "cell", "fp", F.explode(F.when(F.col("chunks").isNull(), whole).otherwise(pairs)).alias("p")).select("grid", "cell", "p.x", "p.y", "fp")
    keys = ["grid", "cell", "x", "y"]

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
                if not len(held[0]):
                    continue
            if held is None:
                return
            new = np.zeros(len(held[0]), bool)
            for x in held[:4]:
                new[1:] |= x[1:] != x[:-1]
            cell = np.cumsum(new)
            cut = len(cell) if batch is None else int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut:
                a, b = cell_links(cell[:cut], held[4][:cut].view("<u8"), distance)
                yield pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], schema=EDGE)
            held = [x[cut:] for x in held]

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """The edges of each of ``parts`` random parts as stars around the smallest node that they reach within the part."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        pairs = [(x, root(x)) for x in list(parent) if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=EDGE)

    return edges.repartition(parts).mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, together: int = 500_000) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges(a, b)`` reaches.

    Parts of at most about ``together`` edges are joined by union-find, a part a task.  While there are several parts,
    rounds of alternating large and small stars follow, each a written table, until nothing changes.
    """
    now = written(edges.select("a", "b").filter("a <> b"), "edges")
    before = None
    while True:
        parts = max(1, -(-now.count() // together))
        after = written(contracted(now, parts), "edges")
        drop(now)
        if parts == 1:
            return after.select(F.col("a").alias("node"), F.col("b").alias("label"))
        now = after
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        after = written(small, "edges")
        drop(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = state


def near_duplicates(docs: DataFrame, distance: int = 3, words: int = 3, like: Fraction | None = None) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hexadecimal digits), component_id.

    With ``like`` the links are texts whose sets of ``words``-word shingles have at least that Jaccard similarity: those that
    fingerprints show, verified exactly, and in an exact join the rest, which differ in more bits (``near_copies``).

    component_id is the smallest doc_id reachable through links of ``distance`` or fewer differing bits, its own
    included; rows that repeat share it; null if no document reached has a doc_id.  Texts without words have
    fingerprint zero and link like any other.  Texts of any length are read whole; other columns are ignored; an empty
    table gives no rows.
    """
    if like is not None:
        from palimpsest.llm import near_copies

        return near_copies.near_copies(docs, distance, words, like)
    digests = written(fingerprint(docs, words), "digests")
    nodes = digests.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = written(links(nodes.select("fp"), distance), "links")
    label = components(edges)
    linked = nodes.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    of = linked.join(lowest, "label").select("fp", "component_id")
    out = digests.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    drop(edges)
    return out
