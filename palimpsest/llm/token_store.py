"""Token-id files: one zstandard frame a document, a dictionary shared by all files, an offset index in each.

Shard file: MAGIC, dictionary hash (32 bytes), id width (u8), frames, index (one ENTRY a document), index offset (u64),
number of documents (u64), MAGIC.  A reader that wants one document reads the end, the index and that frame alone.
A set of files is its manifest: a task that is run again writes new files, and files that no manifest names don't count.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import file_system, scratch
from palimpsest.llm.tokens import encoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"PLMTOK01"
ENTRY = np.dtype([("doc", "<i8"), ("has_id", "u1"), ("at", "<u8"), ("size", "<u4"), ("n", "<u4")])
HEAD = len(MAGIC) + 32 + 1
#: Bytes of text that train the dictionary.
SAMPLED = 4 << 20


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, sample: int, size: int) -> bytes:
    """A dictionary of at most ``size`` bytes from the whole id arrays of about ``sample`` documents, chosen by a hash of doc_id
    over the whole table, of at most SAMPLED bytes of text together; fewer than 16 give none.

    It decides the size of the files only: any dictionary gives back the same ids.
    """
    import zstandard

    enc = encoder(tokenizer)
    rank = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30))
    share = min(1.0, sample / max(1, docs.count()))
    sizes = docs.select(rank.alias("rank"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), F.col("text").alias("text")).filter(F.col("rank") <= int(share * (1 << 30)))
    texts, held = [], 0
    for r in sizes.filter(F.col("size") <= SAMPLED // 4).orderBy("rank").limit(sample).toLocalIterator():
        held += r["size"]
        if held > SAMPLED:
            break
        texts.append(r.text)
    samples = [np.append(np.frombuffer(enc.encode(t), "<u4"), end_id).astype(f"<u{width}").tobytes() for t in texts]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


class ShardWriter:
    def __init__(self, folder: str, name: str, dictionary: bytes, width: int):
        import zstandard

        self.files, path = file_system(folder)
        self.name, self.path, self.width = name, f"{path}/{name}", width
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=data)
        self.out = self.files.open_output_stream(self.path)
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest() + bytes([width]))
        self.at, self.tokens, self.entries = HEAD, 0, []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        frame = self.compressor.compress(ids.astype(f"<u{self.width}").tobytes())
        self.out.write(frame)
        self.entries.append((doc or 0, doc is not None, self.at, len(frame), len(ids)))
        self.at += len(frame)
        self.tokens += len(ids)

    def close(self) -> tuple:
        self.out.write(np.array(self.entries, ENTRY).tobytes())
        self.out.write(np.array([self.at, len(self.entries)], "<u8").tobytes() + MAGIC)
        self.out.close()
        ids = [e[0] for e in self.entries if e[1]]
        return self.name, len(self.entries), self.tokens, min(ids, default=None), max(ids, default=None)


def parse(content, dictionary: bytes):
    """Yield (doc_id, ids as unsigned 32-bit) of a shard's bytes in file order; refuses a shard of another dictionary."""
    import zstandard

    if bytes(content[: len(MAGIC)]) != MAGIC or bytes(content[-len(MAGIC) :]) != MAGIC:
        raise ValueError("not a token shard")
    if bytes(content[len(MAGIC) : HEAD - 1]) != hashlib.sha256(dictionary).digest():
        raise ValueError("the shard was written with another dictionary")
    width = content[HEAD - 1]
    at, n = np.frombuffer(content[-len(MAGIC) - 16 : -len(MAGIC)], "<u8")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    for e in np.frombuffer(content, ENTRY, int(n), int(at)).tolist():
        yield e[0] if e[1] else None, np.frombuffer(reader.decompress(content[e[2] : e[2] + e[3]]), f"<u{width}").astype("<u4")


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, sample: int = 1000, dictionary_size: int = 65_536, shard_mb: float = 64) -> dict:
    """Encode ``docs(doc_id, text)`` into ``folder`` in ascending doc_id order and return the manifest, which also lies there.

    Null text is empty (the end id alone); null doc_ids come first; rows that repeat are written each; an empty table gives
    a manifest without shards; texts of any length are one frame each.  Only the manifest, a row for each shard, reaches the driver.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    width = 2 if _vocabulary(tokenizer) <= 65_536 else 4
    dictionary = train_dictionary(docs, tokenizer, end_id, width, sample, dictionary_size)
    run = uuid.uuid4().hex

    def shards(batches):
        enc, end, task, writer, k, done = encoder(tokenizer), np.uint32(end_id).tobytes(), TaskContext.get(), None, 0, []
        for b in batches:
            encoded = map(enc.encode, b.column(1).to_pylist())
            for doc, ids in zip(b.column(0).to_pylist(), encoded):
                writer = writer or ShardWriter(folder, f"{run}-{task.partitionId():08d}-{k:05d}-{task.taskAttemptId()}.tok", dictionary, width)
                writer.add(doc, np.frombuffer(ids + end, "<u4"))
                if writer.at >= shard_mb * (1 << 20):
                    done, writer, k = [*done, writer.close()], None, k + 1
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["name", "n_docs", "n_tokens", "first", "last"])

    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    key = F.xxhash64("text")
    ordered = docs.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key)
    rows = sorted((tuple(r) for r in ordered.mapInArrow(shards, "name string, n_docs long, n_tokens long, first long, last long").collect()), key=lambda r: r[0])
    manifest = {"run": run, "dictionary": f"{run}.dict", "sha256": hashlib.sha256(dictionary).hexdigest(), "shards": []}
    start = 0
    for name, n, tokens, first, last in rows:
        manifest["shards"].append({"name": name, "documents": n, "tokens": tokens, "start": start, "first": first, "last": last})
        start += tokens
    for name, content in ((f"{run}.dict", dictionary), (f"{run}.manifest.json", json.dumps(manifest).encode())):
        with files.open_output_stream(f"{path}/{name}") as out:
            out.write(content)
    return manifest


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def read(spark: SparkSession, folder: str, manifest: dict, keep_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, ids (unsigned 32-bit bytes; null unless ``keep_ids``)."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    files, path = file_system(folder)
    with files.open_input_stream(f"{path}/{manifest['dictionary']}") as f:
        dictionary = f.read()

    def documents(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                at, rows = 0, []
                for doc, ids in parse(memoryview(content.as_buffer()), dictionary):
                    raw = ids.tobytes()
                    rows.append((name.rpartition("/")[2], doc, at, len(ids), zlib.crc32(raw), raw if keep_ids else None))
                    at += len(ids)
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["name", "doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    shards = spark.read.format("binaryFile").option("pathGlobFilter", f"{manifest['run']}-*.tok").load(folder).select("path", "content")
    # What a shard's documents start at is a table; a shard that the manifest does not name is not in it.
    starts = spark.createDataFrame([(s["name"], s["start"]) for s in manifest["shards"]], "name string, shard_start bigint")
    found = shards.mapInArrow(documents, f"name string, {schema}").join(starts, "name")
    return found.select("doc_id", (F.col("shard_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "ids")


def read_document(folder: str, manifest: dict, doc_id: int) -> np.ndarray | None:
    """The ids of one document, by index: reads no other document's frame."""
    import zstandard

    files, path = file_system(folder)
    with files.open_input_stream(f"{path}/{manifest['dictionary']}") as f:
        dictionary = f.read()
    named = [s for s in manifest["shards"] if s["last"] is not None]  # ascending: shards of null ids only come first
    for s in named[bisect.bisect_left(named, doc_id, key=lambda s: s["last"]) :][:1]:
        with files.open_input_file(f"{path}/{s['name']}") as f:
            end = f.size() - len(MAGIC) - 16
            at, n = np.frombuffer(f.read_at(16, end), "<u8").tolist()
            index = np.frombuffer(f.read_at(end - at, at), ENTRY)
            for e in index[(index["doc"] == doc_id) & (index["has_id"] == 1)][:1]:
                width = f.read_at(1, HEAD - 1)[0]
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                return np.frombuffer(reader.decompress(f.read_at(int(e["size"]), int(e["at"]))), f"<u{width}").astype("<u4")
    return None


def store_folder(spark: SparkSession) -> str:
    """A new folder among the intermediate tables; ``shared.clear`` deletes it."""
    return scratch(spark, "tokens")
