"""The 32-bit key hash, cache shards and Bloom filters as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the hash and the filter.
MULTIPLIER = 0xC6A4A793
BLOOM_SEED = 0xBC9F1D34
CACHE_SEED = 0
MASK = 0xFFFFFFFF
BITS_PER_KEY = 10
FEWEST_BITS = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), 0)


def _times(value: Column) -> Column:
    """value * MULTIPLIER mod 2^32 of the value mod 2^32; by halves, as the whole product would overflow."""
    low, high = MULTIPLIER & 0xFFFF, MULTIPLIER >> 16

    def product(h):
        cross = F.shiftleft((F.shiftright(h, 16) * low + h.bitwiseAND(F.lit(0xFFFF)) * high).bitwiseAND(F.lit(0xFFFF)), 16)
        return (h.bitwiseAND(F.lit(0xFFFF)) * low + cross).bitwiseAND(F.lit(MASK))

    return _let(value.bitwiseAND(F.lit(MASK)), product)


def _mixed(value: Column, shift: int) -> Column:
    return _let(_times(value), lambda g: g.bitwiseXOR(F.shiftright(g, shift)))


def key_hash(key: Column, seed: int = BLOOM_SEED) -> Column:
    """The hash of a text's UTF-8 bytes, as a non-negative bigint."""
    return _let(F.hex(F.encode(key, "utf-8")), lambda text: _hash_of_hex(text, seed))


def _hash_of_hex(text: Column, seed: int) -> Column:
    n = F.floor(F.length(text) / 2).cast("int")
    whole, rest = F.floor(n / 4).cast("int"), F.pmod(n, F.lit(4))

    def little(at: Column, size: int) -> Column:
        """The integer of ``size`` bytes from byte ``at`` on, lowest first."""
        return F.conv(F.concat(*[F.substring(text, 2 * (at + k) + 1, F.lit(2)) for k in reversed(range(size))]), 16, 10).cast("bigint")

    words = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: little(4 * i, 4))).otherwise(F.array().cast("array<bigint>"))
    start = F.lit(seed).cast("bigint").bitwiseXOR(_times(n.cast("bigint")))
    body = F.aggregate(words, start, lambda h, w: _mixed(h + w, 16))
    last = F.when(rest == 1, little(4 * whole, 1)).when(rest == 2, little(4 * whole, 2)).otherwise(little(4 * whole, 3))
    return F.when(rest == 0, body).otherwise(_mixed(body + last, 24))


def cache_shard(h: Column) -> Column:
    """The shard of a cache key's hash: its highest four bits."""
    return F.shiftright(h, 28)


def probes(bits_per_key: int = BITS_PER_KEY) -> int:
    return min(30, max(1, int(bits_per_key * 0.69)))


def filter_bits(n_keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """Bits of a filter over ``n_keys``, whole bytes."""
    return (max(FEWEST_BITS, n_keys * bits_per_key) + 7) // 8 * 8


def bloom_bytes(keys: DataFrame, group: list[str], h: str = "h", bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(group, n_keys, filter): the filter over the keys of each group of ``keys``, as upper-case hexadecimal: its bits, lowest
    of a byte first, and a last byte with the number of probes.  ``h`` is the column of key hashes.

    Bits are set byte by byte by partial aggregation; a filter is put together in one row, so groups are what one filter is for.
    """
    sizes = keys.groupBy(*group).agg(F.count("*").alias("n_keys"))
    sizes = sizes.withColumn("_bytes", F.floor((F.greatest(F.lit(FEWEST_BITS), F.col("n_keys") * bits_per_key) + 7) / 8).cast("bigint"))
    at = keys.join(sizes, group).select(*group, F.explode(bloom_positions(F.col(h), F.col("_bytes") * 8, bits_per_key)).alias("_bit"))
    held = at.groupBy(*group, F.shiftright("_bit", 3).alias("_at")).agg(F.bit_or(F.get(F.array(*[F.lit(1 << k) for k in range(8)]), F.pmod("_bit", F.lit(8)).cast("int"))).alias("_byte"))
    # Bytes without a bit are gaps between those that have one.
    listed = F.sort_array(F.collect_list(F.struct("_at", "_byte")))
    zeros = lambda n: F.repeat(F.lit("00"), n.cast("int"))
    filled = F.aggregate("_held", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit("").alias("t")), lambda acc, x: F.struct((x["_at"] + 1).alias("n"), F.concat(acc["t"], zeros(x["_at"] - acc["n"]), F.lpad(F.hex(x["_byte"]), 2, "0")).alias("t")))
    whole = held.groupBy(*group).agg(listed.alias("_held")).withColumn("_f", filled).join(sizes, group)
    return whole.select(*group, "n_keys", F.concat("_f.t", zeros(F.col("_bytes") - F.col("_f.n")), F.lit(f"{probes(bits_per_key):02X}")).alias("filter"))


def bloom_may_match(filter_hex: Column, h: Column) -> Column:
    """whether a filter lets a key hash through: one of fewer than two bytes none, one of more than 30 probes all."""
    size = F.floor(F.length(filter_hex) / 2).cast("bigint")
    k = F.conv(F.substring(filter_hex, -2, 2), 16, 10).cast("bigint")
    delta = F.shiftright(h, 17) + F.pmod(h, F.lit(1 << 17)) * (1 << 15)
    bit = lambda j: F.pmod(F.pmod(h + j * delta, F.lit(1 << 32)), F.greatest((size - 1) * 8, F.lit(1)))
    byte = lambda p: F.conv(F.substring(filter_hex, (2 * F.shiftright(p, 3) + 1).cast("int"), F.lit(2)), 16, 10).cast("bigint")
    set_ = lambda j: _let(bit(j), lambda p: F.pmod(F.floor(byte(p) / F.pow(F.lit(2), F.pmod(p, F.lit(8)))), F.lit(2)) == 1)
    every = F.forall(F.sequence(F.lit(0).cast("bigint"), F.greatest(k - 1, F.lit(0))), set_)
    return F.when(size < 2, False).when(k > 30, True).when(k == 0, True).otherwise(every)


def bloom_positions(h: Column, bits: Column, bits_per_key: int = BITS_PER_KEY) -> Column:
    """The positions a key sets: double hashing by the hash rotated right by 17 bits."""
    delta = F.shiftright(h, 17) + F.pmod(h, F.lit(1 << 17)) * (1 << 15)
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(probes(bits_per_key) - 1).cast("bigint")), lambda j: F.pmod(F.pmod(h + j * delta, F.lit(1 << 32)), bits))
