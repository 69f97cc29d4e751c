"""Document fingerprints by randomised edit embedding.

Every text is read by the same random walk: at step j the character under the pointer is emitted and a random bit of
(j, character) decides whether the pointer moves on.  After an edit two walks fall into step again, so few edits change
few of the emitted characters: edit distance becomes Hamming distance.  A fingerprint samples the emitted characters,
32 steps in every octave of steps, so that texts of any length share their sampled steps.

The walks of many texts run in lockstep, as arrays.  Documents are dealt out by ranges of doc_id; the first document of
each range is also given to the range before it, so each text meets the next one and texts are shuffled once, compressed.

Fingerprints that agree in all sampled places of a band meet in its bucket and are verified; those of one class are alike,
directly or through others.  Buckets of more than HOT members are dealt out as pairs of chunks.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import simhash
from palimpsest.llm.shared import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLES = 32
OCTAVES = 40
PERIOD = 4096
#: Characters whose walks run together; a longer text runs alone.
TOGETHER = 6_000_000
#: Two unrelated emitted characters are equal about this often.
CHANCE = 1 / 16
#: Bands, and sampled places of each, in fingerprints of less than an octave fewer: at a likeness of 0.8, 99 of 100 pairs share one.
BANDS, BAND, SHORT = 20, 7, 5
#: Bytes of text in a range, and sampled rows a range from which the ranges are cut.
RANGE, SAMPLED = 64 << 20, 100
#: Members of a band's bucket that one task compares with each other.
HOT = 2048


def walk_bits(seed: int = 7) -> np.ndarray:
    """PERIOD x 256 random bits; character 0 (the end of a text) never moves on."""
    bits = np.random.default_rng(seed).integers(0, 2, (PERIOD, 256)).astype(np.int64)
    bits[:, 0] = 0
    return bits


def sampled_steps(seed: int = 8) -> np.ndarray:
    """The sampled steps, ascending: all of the first SAMPLES, then SAMPLES of each octave."""
    draw = np.random.default_rng(seed)
    steps = [np.arange(SAMPLES)]
    for k in range(SAMPLES.bit_length() - 1, OCTAVES):
        steps.append(np.sort(_distinct(draw, 2**k)) + 2**k)
    return np.concatenate(steps)


def _distinct(draw, width: int) -> np.ndarray:
    found = np.zeros(0, np.int64)
    while len(found) < SAMPLES:
        found = np.unique(np.append(found, draw.integers(0, width, SAMPLES)))
    return draw.permutation(found)[:SAMPLES]


def fingerprints(texts: list[str], bits: np.ndarray, steps: np.ndarray) -> list[bytes]:
    """One byte a sampled step, up to the end of the walk; equal texts give equal bytes, the empty text none."""
    raw = "\0".join(texts) + "\0"
    code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(length + 1) - 1
    symbol = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
    symbol = symbol.astype(np.uint8)
    symbol[end] = 0
    at, who = end - length, np.arange(len(texts))
    keep = np.flatnonzero(length)
    at, who, end = at[keep], who[keep], end[keep]
    out: list[np.ndarray] = []
    j, now = 0, np.empty(0, np.uint8)
    for step in steps.tolist():
        alive = at < end
        if not alive.any():
            break
        if alive.sum() < 0.9 * len(at) or len(at) < 64:
            at, who, end = at[alive], who[alive], end[alive]
        while j < step:
            stop = min(step, j + 512)
            now, move = np.empty(len(at), np.uint8), np.empty(len(at), np.int64)
            for row in range(j, stop):
                symbol.take(at, out=now, mode="clip")
                bits[row % PERIOD].take(now, out=move, mode="clip")
                np.add(at, move, out=at)
            j = stop
            alive = at < end
            if alive.sum() < 0.9 * len(at):
                at, who, end = at[alive], who[alive], end[alive]
                if not len(at):
                    break
        if not len(at):
            break
        column = np.zeros(len(texts), np.uint8)
        column[who] = symbol[at]
        out.append(column)
    table = np.array(out, np.uint8).T.copy() if out else np.zeros((len(texts), 0), np.uint8)
    return [row.tobytes().rstrip(b"\0") for row in table]


def weights(n: int) -> np.ndarray:
    """Steps that each of the first ``n`` samples stands for."""
    octave = np.maximum(np.arange(n) // SAMPLES - 1, 0)
    return np.where(np.arange(n) < SAMPLES, 1.0, 2.0**octave)


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: the share of steps at which the walks agree, as sampled, less what chance gives; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(v.ljust(n, b"\0"), np.uint8) for v in (a, b))
    w = weights(n)
    return float(max(0.0, (w[x == y].sum() / w.sum() - CHANCE) / (1 - CHANCE)))


#: Sampled places of every band, by the number of places that they are drawn from.
_PLACES: dict[int, np.ndarray] = {}


def _places(upto: int) -> np.ndarray:
    if upto not in _PLACES:
        draw, p = np.random.default_rng([9, upto]), weights(upto) / weights(upto).sum()
        _PLACES[upto] = np.array([draw.choice(upto, min(BAND if upto >= SAMPLES else SHORT, upto), replace=False, p=p) for _ in range(BANDS)])
    return _PLACES[upto]


def levels(n: int) -> tuple[int, ...]:
    """How many of ``n`` samples bands are drawn from: whole octaves, or a power of two of fewer samples, and the step below, so
    that texts on either side of a step still meet."""
    if n < 2:
        return (n,) * (n > 0)
    if n < 2 * SAMPLES:
        top = 1 << (n.bit_length() - 1)
        return top, top // 2
    return n // SAMPLES * SAMPLES, (n // SAMPLES - 1) * SAMPLES


def band_keys(fp: bytes) -> list[tuple[int, int, bytes]]:
    """(level, band, sampled bytes) of every band; the empty fingerprint has none."""
    values = np.frombuffer(fp, np.uint8)
    return [(o, k, row.tobytes()) for o in levels(len(fp)) for k, row in enumerate(values[_places(o)])]


def print_key(fp: bytes) -> int:
    """A fingerprint as a signed 64-bit key."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(fp, 5)).astype(np.int64))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of characters replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


FINGERPRINT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "bands_edited bigint, bands_next bigint, class_id bigint"
)


def fingerprint(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and bands_edited, bands_next: how many bands the fingerprint shares with the edited text's and the next one's.
    class_id is the smallest doc_id of the documents whose fingerprints are at least ``threshold`` alike, directly or through
    others, its own included; null if none of them has a doc_id.

    Null text is empty; documents are in ascending order of doc_id (null ids first, equal ids by a hash of the text) and
    the first follows the last, so a single document follows itself.  Rows that repeat have equal fingerprints and class;
    texts of any length are walked whole; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("key")).withColumn("h", F.xxhash64("text"))
    bits, steps = walk_bits(), sampled_steps()
    size = base.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size.n:
        return spark.createDataFrame([], FINGERPRINT)

    def prints_of(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            fp, low, held = [], 0, 0
            for k, t in enumerate(texts):
                held += len(t)
                if held >= TOGETHER or k + 1 == len(texts):
                    fp += fingerprints(texts[low : k + 1], bits, steps)
                    low, held = k + 1, 0
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(map(print_key, fp), pa.int64()), pa.array(fp, pa.binary())], ["doc_id", "key", "h", "id", "fp"])

    prints = written(base.select("doc_id", "key", "h", "text").mapInArrow(prints_of, "doc_id bigint, key bigint, h bigint, id bigint, fp binary"), "prints")
    label = simhash.components(links(prints.select("id", "fp"), threshold))
    of = prints.select("doc_id", "key", "h", "id").join(label.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    lowest = of.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    classes = written(of.select("key", "h", "label").distinct().join(lowest, "label").select("key", "h", "class_id"), "classes")

    # Ranges of about RANGE bytes, and no fewer than tasks that a shuffle has, cut by sampled rows.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.bytes // RANGE))
    share = max(1, min(1 << 30, (SAMPLED * parts << 30) // size.n))
    some = sorted(tuple(r) for r in prints.filter(F.pmod(F.xxhash64("key", "h"), F.lit(1 << 30)) < share).select("key", "h").collect())
    cuts = sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []
    first, second = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)

    def range_of(key: np.ndarray, h: np.ndarray) -> np.ndarray:
        """How many of the cuts are at or before each (key, h)."""
        low, high = np.searchsorted(first, key, "left"), np.searchsorted(first, key, "right")
        for k in np.unique(low[high > low]):  # keys that are cut within
            tied = (low == k) & (high > low)
            low[tied] += np.searchsorted(second[k : high[tied][0]], h[tied], "right")
        return low.astype(np.int32)

    def dealt(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            part = range_of(b.column("key").to_numpy(), b.column("h").to_numpy())
            texts = [None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(b.column(k) for k in ("extra", "key", "h", "kind", "doc_id")), pa.array(texts, pa.binary())], ["part", "extra", "key", "h", "kind", "doc_id", "text"])

    @F.pandas_udf("int")
    def range_udf(key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_of(key.to_numpy(np.int64), h.to_numpy(np.int64)))

    # One row a range: bounded by the number of ranges.
    least = sorted(tuple(r) for r in prints.select("key", "h").withColumn("part", range_udf("key", "h")).groupBy("part").agg(F.min(F.struct("key", "h")).alias("m")).select("part", "m.key", "m.h").collect())
    before = spark.createDataFrame([(least[k - 1][0], *least[k][1:]) for k in range(len(least))], "part int, key bigint, h bigint")
    follow = base.join(F.broadcast(before.select("key", "h").distinct()), ["key", "h"]).dropDuplicates(["key", "h"]).join(before, ["key", "h"])
    columns = ["extra", "key", "h", "kind", "doc_id", "text"]
    rows = base.withColumns({"extra": F.lit(0), "kind": F.lit(1)}).select(*columns).unionByName(classes.select(F.lit(0).alias("extra"), "key", "h", F.lit(0).alias("kind"), F.col("class_id").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    schema = "part int, extra int, key bigint, h bigint, kind int, doc_id bigint, text binary"
    packed = rows.mapInArrow(dealt, schema).unionByName(_packed(follow.select("part", F.lit(1).alias("extra"), "key", "h", F.lit(1).alias("kind"), "doc_id", "text"), schema))
    ordered = packed.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "extra", "key", "h", "kind")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []
        size, group = 0, None
        for b in batches:
            for part, extra, key, h, kind, doc, z in zip(*(c.to_pylist() for c in b.columns)):
                if not kind:
                    group = doc
                    continue
                held.append((part, extra, doc, unpack(z).decode("utf-8", "surrogatepass"), group))
                size += len(held[-1][3])
                if size >= TOGETHER:
                    yield made(held)
                    held = held[-1:]
                    size = len(held[0][3])
        yield made(held)

    def made(rows):
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        texts = [r[3] for r in rows]
        changed = [edited(texts[i], texts[i + 1]) for i in pairs]
        fp = fingerprints(texts + changed, bits, steps) if pairs else []
        keys = [set(band_keys(f)) for f in fp]
        out = []
        for k, i in enumerate(pairs):
            a, e = fp[i], fp[len(texts) + k]
            out.append((rows[i][2], len(texts[i]), hashlib.sha256(changed[k].encode("utf-8", "surrogatepass")).hexdigest(), a.hex(), e.hex(), likeness(a, e), likeness(a, fp[i + 1]), len(keys[i] & keys[len(texts) + k]), len(keys[i] & keys[i + 1]), rows[i][4]))
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in FINGERPRINT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names)

    return ordered.select("part", "extra", "key", "h", "kind", "doc_id", "text").mapInArrow(run, FINGERPRINT)


def _packed(rows: DataFrame, schema: str) -> DataFrame:
    """Rows with a text, with it compressed."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in b.column(b.num_columns - 1).to_pylist()], pa.binary())], b.schema.names)

    return rows.mapInArrow(run, schema)


def links(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Links (a, b, likeness) between different fingerprints of ``prints(id, fp)`` that share a band and are at least
    ``threshold`` alike, by id: a spanning forest of those of each bucket, so that its classes are those of all the pairs."""

    def bands(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            rows = [(i, xxh64_intdigest(v, o << 8 | k)) for i, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for o, k, v in band_keys(f)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)), pa.array([r[0] for r in rows], pa.int64())], ["bucket", "id"])

    def shared(batches):
        """The members of buckets with several, of rows sorted by bucket and id."""
        bucket = member = None
        for b in batches:
            x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            if bucket is not None:
                x, y = np.append(bucket, x), np.append(member, y)
            if not len(x):
                continue
            new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            x, y = x[new], y[new]
            same = np.append(False, x[1:] == x[:-1])
            several = same | np.append(same[1:], False)
            if bucket is not None and told:
                several[0] = False  # it came with the batch before
            told = bool(several[-1]) or (bucket is not None and told and len(x) == 1)
            bucket, member = x[-1], y[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[several]), pa.array(y[several])], ["bucket", "id"])

    every = prints.select("id", "fp").mapInArrow(bands, "bucket bigint, id bigint")
    members = written(every.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(shared, "bucket bigint, id bigint"), "buckets")
    size = members.groupBy("bucket").count().withColumn("chunks", F.ceil(F.col("count") / HOT).cast("int")).drop("count")
    both = members.join(size, "bucket").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: k != F.col("mine"))
    pair = F.when(F.col("chunks") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(F.transform(others, lambda k: F.struct(F.least(k, F.col("mine")).alias("x"), F.greatest(k, F.col("mine")).alias("y"))))
    wanted = prints.select("id", "fp").join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    dealt = both.select("bucket", "id", F.explode(pair).alias("p")).select("bucket", "p.x", "p.y", "id").join(wanted, "id")

    def forest(table: pa.Table) -> pa.Table:
        found = dict(zip(table.column("id").to_pylist(), table.column("fp").to_pylist()))
        ids = sorted(found)
        raw = [found[i] for i in ids]
        size = np.array([len(r) for r in raw])
        steps = np.array([np.frombuffer(r.ljust(size.max(), b"\0"), np.uint8) for r in raw])
        w = weights(size.max())
        upto = np.append(0, np.cumsum(w))
        label, out = np.arange(len(ids)), []
        for i in range(len(ids) - 1):
            n = np.maximum(size[i], size[i + 1 :])
            agree = (steps[i + 1 :] == steps[i]) @ w - (upto[-1] - upto[n])
            near = np.maximum(0.0, (agree / np.maximum(upto[n], 1) - CHANCE) / (1 - CHANCE))
            for j in np.flatnonzero(near >= threshold) + i + 1:
                if label[i] != label[j]:
                    out.append((ids[i], ids[j], float(near[j - i - 1])))
                    label[label == label[j]] = label[i]
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "likeness"])

    return dealt.groupBy("bucket", "x", "y").applyInArrow(forest, "a bigint, b bigint, likeness double").distinct()


def near_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``links`` of ``prints(fingerprint)``, as hexadecimal digits.

    Rows that repeat count once; null fingerprints link to nothing; an empty table gives no rows.
    """
    distinct = prints.select("fingerprint").filter("fingerprint is not null").distinct()

    def keyed(batches):
        for b in batches:
            fp = [bytes.fromhex(f) for f in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(print_key, fp), pa.int64()), pa.array(fp, pa.binary())], ["fingerprint", "id", "fp"])

    named = written(distinct.mapInArrow(keyed, "fingerprint string, id bigint, fp binary"), "prints")
    side = lambda k: named.select(F.col("id").alias(k), F.col("fingerprint").alias(f"{k}_"))
    return links(named, threshold).join(side("a"), "a").join(side("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"), "likeness")
