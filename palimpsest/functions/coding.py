"""Integer and slice codecs as Column expressions (F1 to F3) and the sizes that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.model import BATCH_HEADER, PUT


def varint_length(n: Column) -> Column:
    """Bytes of the varint of an integer; a negative bigint stands for the unsigned 64-bit integer of the same bits."""
    out = F.when(n < 0, 10)
    for size in range(1, 9):
        out = out.when(n < 1 << 7 * size, size)
    return out.otherwise(9).cast("bigint")


def _hex_byte(n: Column) -> Column:
    return F.lpad(F.hex(n), 2, "0")


def varint_hex(n: Column) -> Column:
    """The varint of a 64-bit integer as upper-case hexadecimal: seven bits a byte, lowest first, a set top bit on all but the last."""
    n, size = n.cast("bigint"), varint_length(n)
    out = []
    for k in range(10):
        bits = F.shiftrightunsigned(n, 7 * k).bitwiseAND(F.lit(127))
        out.append(F.when(size > k + 1, _hex_byte(bits + 128)).when(size > k, _hex_byte(bits)).otherwise(""))
    return F.concat(*out)


def varint_value(text: Column) -> Column:
    """The 64-bit integer of an upper-case hexadecimal varint; null past ten bytes or without a last byte."""
    count = F.length(text) / 2
    byte = lambda k: F.conv(F.substring(text, 2 * k + 1, 2), 16, 10).cast("bigint")
    total = F.lit(0).cast("bigint")
    for k in range(10):
        total = total.bitwiseOR(F.when(count > k, F.shiftleft(byte(k).bitwiseAND(F.lit(127)), 7 * k)).otherwise(0))
    last = F.conv(F.substring(text, -2, 2), 16, 10).cast("bigint")
    return F.when((count >= 1) & (count <= 10) & (last < 128), total)


def fixed_hex(n: Column, size: int) -> Column:
    """Little-endian fixed-width bytes as upper-case hexadecimal."""
    wide = F.lpad(F.hex(n), 2 * size, "0")
    return F.concat(*[F.substring(wide, 2 * i + 1, 2) for i in reversed(range(size))])


def fixed_value(text: Column, size: int) -> Column:
    """The integer of ``fixed_hex``; sizes of up to seven bytes, and eight for values below 2^63."""
    return F.conv(F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))]), 16, 10).cast("bigint")


def prefixed_hex(text: Column) -> Column:
    """A length-prefixed slice: the varint of the byte length, then the bytes."""
    return F.concat(varint_hex(F.octet_length(text).cast("bigint")), F.hex(F.encode(text, "utf-8")))


def record_bytes(op: Column, k: Column, v: Column) -> Column:
    """Bytes of a batch record: a tag, the prefixed key and, for a put, the prefixed value."""
    key, value = F.octet_length(k).cast("bigint"), F.octet_length(v).cast("bigint")
    return F.lit(1).cast("bigint") + varint_length(key) + key + F.when(op == PUT, varint_length(value) + value).otherwise(0)


def batch_bytes(records: Column) -> Column:
    """Bytes of a batch whose records have ``records`` bytes in sum."""
    return records + BATCH_HEADER
