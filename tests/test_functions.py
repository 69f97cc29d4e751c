"""Codecs, hash and filters against plain Python."""

import random

from pyspark.sql import functions as F

from palimpsest.functions import coding, hashing


def python_varint(n):
    out = []
    while n >= 128:
        out.append(n % 128 + 128)
        n //= 128
    return bytes([*out, n]).hex().upper()


def python_hash(data, seed=hashing.BLOOM_SEED):
    h = seed ^ (len(data) * hashing.MULTIPLIER & 0xFFFFFFFF)
    for i in range(0, len(data) - 3, 4):
        h = (h + int.from_bytes(data[i : i + 4], "little")) * hashing.MULTIPLIER & 0xFFFFFFFF
        h ^= h >> 16
    if rest := data[len(data) // 4 * 4 :]:
        h = (h + int.from_bytes(rest, "little")) * hashing.MULTIPLIER & 0xFFFFFFFF
        h ^= h >> 24
    return h


def test_varints_and_fixed_width(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**35 - 1, 2**40 + 17, 2**53 + 1, 2**56 - 1, 2**56, 2**62 + 12345, 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "n long").select("n", coding.varint_hex(F.col("n")).alias("hex"), coding.varint_value(coding.varint_hex(F.col("n"))).alias("back"), coding.varint_length(F.col("n")).alias("size"), coding.fixed_value(coding.fixed_hex(F.col("n"), 8), 8).alias("fixed"), coding.fixed_hex(F.col("n"), 8).alias("f")).collect()
    for r in rows:
        assert r.hex == python_varint(r.n) and r.back == r.fixed == r.n and r.f == r.n.to_bytes(8, "little").hex().upper()
        assert r.size == len(r.hex) // 2
    unsigned = spark.createDataFrame([(-1,), (-(2**63),)], "n long").select(coding.varint_hex(F.col("n")), coding.varint_value(coding.varint_hex(F.col("n"))), coding.varint_length(F.col("n"))).collect()
    assert [tuple(r) for r in unsigned] == [(python_varint(2**64 - 1), -1, 10), (python_varint(2**63), -(2**63), 10)]
    assert spark.range(1).select(coding.varint_value(F.lit("8080"))).first()[0] is None  # no last byte


def test_hash_of_any_bytes(spark):
    draw = random.Random(1)
    keys = ["", "a", "ab", "abc", "abcd", "é", "日本語"] + ["".join(draw.choice("abcXYZ09é日") for _ in range(draw.randint(0, 23))) for _ in range(200)]
    for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.key_hash(F.col("k")).alias("h"), hashing.key_hash(F.col("k"), 0).alias("h0")).collect():
        assert r.h == python_hash(r.k.encode()) and r.h0 == python_hash(r.k.encode(), 0)


def test_filter_bytes_against_plain_python(spark):
    from palimpsest.sources import files

    draw = random.Random(4)
    groups = {g: sorted({"".join(draw.choice("abcé9") for _ in range(draw.randint(1, 12))) for _ in range(n)}) for g, n in enumerate((1, 5, 7, 300))}
    rows = [(g, k) for g, ks in groups.items() for k in ks]
    keys = spark.createDataFrame(rows, "g int, k string").withColumn("h", hashing.key_hash(F.col("k")))
    for bits in (10, 1, 50):
        got = {r.g: r for r in hashing.bloom_bytes(keys, ["g"], bits_per_key=bits).collect()}
        for g, ks in groups.items():
            want = files.encode_filter([k.encode() for k in ks], bits)
            assert got[g].filter == want.hex().upper() and got[g].n_keys == len(ks)
            assert all(files.filter_lets(want, k.encode()) for k in ks)
            assert all(files.hash32(k.encode()) == python_hash(k.encode()) for k in ks)
    filters = ["", "06", "0006", "FF06", "001F", "0000000000000000" + "06", "FFFFFFFFFFFFFFFF" + "1E", "00FF00", files.encode_filter([b"a"]).hex().upper()]
    asked = [(f, k) for f in filters for k in ("a", "b", "zz")]
    df = spark.createDataFrame(asked, "f string, k string").select("f", "k", hashing.bloom_may_match(F.col("f"), hashing.key_hash(F.col("k"))).alias("ok"))
    assert all(r.ok == files.filter_lets(bytes.fromhex(r.f), r.k.encode()) for r in df.collect())


def test_filters_never_miss_a_key(spark):
    keys = spark.range(500).select((F.col("id") * 31).cast("string").alias("k"))
    bits = F.lit(hashing.filter_bits(500)).cast("bigint")
    at = keys.select(F.explode(hashing.bloom_positions(hashing.key_hash(F.col("k")), bits)).alias("b")).distinct()
    others = spark.range(500).select((F.col("id") * 31 + 1).cast("string").alias("k"))
    passed = lambda ks: ks.select("k", F.explode(hashing.bloom_positions(hashing.key_hash(F.col("k")), bits)).alias("b")).join(at, "b", "left_semi").groupBy("k").count().filter(F.col("count") >= hashing.probes()).count()
    assert passed(keys.withColumn("k", F.col("k"))) >= 450  # positions that coincide within a key count once
    assert passed(others) < 50
    assert hashing.probes() == 6 and hashing.probes(1) == 1 and hashing.probes(100) == 30 and hashing.filter_bits(1) == 64
