"""Byte sizes, encodings and hashes as column functions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3  # fixed values of the published hash


def nbytes(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def varint_length(n: Column) -> Column:
    """Bytes of a 32-bit number in groups of seven bits."""
    more = [(n >= 1 << s).cast("int") for s in (7, 14, 21, 28)]
    return (F.lit(1) + more[0] + more[1] + more[2] + more[3]).cast("long")


def fixed_hex(n: Column, width: int) -> Column:
    """A whole number as little-endian bytes, in hexadecimal."""
    big = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.concat(*(F.substring(big, 2 * i + 1, 2) for i in reversed(range(width))))


def fixed_from_hex(h: Column, width: int) -> Column:
    """The number of little-endian bytes given in hexadecimal; null if there are too few."""
    big = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))))
    return F.when(F.length(h) >= 2 * width, F.conv(big, 16, 10).cast("decimal(20,0)"))


def varint_hex(n: Column, groups: int = 5) -> Column:
    """Seven bits a byte, least first, the high bit set on all but the last."""
    parts = []
    for i in range(groups):
        bits = F.shiftrightunsigned(n.cast("long"), 7 * i)
        byte = bits.bitwiseAND(F.lit(127)) + F.when(bits >= 128, 128).otherwise(0)
        parts.append(F.when((bits > 0) | F.lit(i == 0), F.lpad(F.hex(byte.cast("long")), 2, "0")).otherwise(""))
    return F.concat(*parts)


def varint_from_hex(h: Column, groups: int = 5) -> Column:
    """The number that a varint at the start of the bytes encodes; null if it is cut short or has too many bits."""
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("long")
    value, out = F.lit(0).cast("long"), F.lit(None).cast("long")
    ends = []
    for i in range(groups):
        value = value + F.shiftleft(byte(i).bitwiseAND(F.lit(127).cast("long")), 7 * i)
        ends.append((byte(i) < 128, value))
    for done, v in reversed(ends):
        out = F.when(done, v).otherwise(out)
    limit = F.lit((1 << 32) - 1 if groups == 5 else (1 << 63) - 1)
    return F.when((out >= 0) & (out <= limit), out)


def varint64_from_hex(h: Column) -> Column:
    """The number, up to 2^64 - 1, of a varint of at most ten bytes at the start of the bytes; null if it is cut short or has too many bits."""
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("decimal(38,0)")
    value, out, ends = F.lit(0).cast("decimal(38,0)"), F.lit(None).cast("decimal(38,0)"), []
    for i in range(10):
        value = (value + (byte(i) % 128) * F.lit(str(1 << 7 * i)).cast("decimal(20,0)")).cast("decimal(38,0)")
        ends.append((F.when(F.length(h) >= 2 * i + 2, byte(i) < 128).otherwise(False), value))
    for done, v in reversed(ends):
        out = F.when(done, v).otherwise(out)
    return F.when(out <= F.lit(str((1 << 64) - 1)).cast("decimal(20,0)"), out.cast("decimal(20,0)"))


def let(value: Column, f) -> Column:
    """f(value), with the value written once in the expression, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def slice_from_hex(h: Column) -> Column:
    """A struct of the slice's bytes and the rest after it, in hexadecimal: null if its length or its bytes are cut short."""

    def cut(x: Column, n: Column, head: Column) -> Column:
        whole = F.length(x) >= head + 2 * n
        return F.struct(F.when(whole, x.substr((head + 1).cast("int"), (2 * n).cast("int"))).alias("bytes"), F.when(whole, x.substr((head + 2 * n + 1).cast("int"), F.length(x))).alias("rest"))

    return let(h, lambda x: let(varint_from_hex(x), lambda n: let(2 * varint_length(n), lambda head: cut(x, n, head))))


def internal_key_parts(h: Column) -> tuple[Column, Column, Column]:
    """(user key, seq, op) of an internal key in hexadecimal: null if it is shorter than its trailer or has no such op."""
    n = F.length(h)
    op = F.conv(h.substr(n - 15, F.lit(2)), 16, 10).cast("int")
    ok = (n >= 16) & op.isin(0, 1)
    key = F.decode(F.unhex(h.substr(F.lit(1), n - 16)), "UTF-8")
    return F.when(ok, key), F.when(ok, fixed_from_hex(h.substr(n - 13, F.lit(14)), 7).cast("long")), F.when(ok, op)


def slice_hex(s: Column) -> Column:
    """A string with its length before it, as a varint."""
    return F.concat(varint_hex(F.octet_length(s)), F.hex(s.cast("binary")))


def internal_key_hex(key: Column, seq: Column, op: Column) -> Column:
    """Key bytes, then (seq << 8) | op in eight bytes; null for a sequence number or kind out of range."""
    ok = (seq >= 0) & (seq < 1 << 56) & op.isin(0, 1)
    return F.when(ok, F.concat(F.hex(key.cast("binary")), fixed_hex(op, 1), fixed_hex(seq, 7)))


def user_bytes(key: Column, value: Column) -> Column:
    return nbytes(key) + nbytes(value)


def memtable_bytes(key: Column, value: Column) -> Column:
    return user_bytes(key, value) + 8


def wal_bytes(key: Column, value: Column) -> Column:
    return F.lit(17) + varint_length(nbytes(key)) + nbytes(key) + varint_length(nbytes(value)) + nbytes(value)


def entry_bytes(key: Column, value: Column) -> Column:
    return varint_length(nbytes(key) + 8) + nbytes(key) + 8 + varint_length(nbytes(value)) + nbytes(value)


def index_bytes(key: Column) -> Column:
    return varint_length(nbytes(key) + 8) + nbytes(key) + 24


def bloom_bytes(keys: Column, bits_per_key: int | Column) -> Column:
    """Bytes of the bit array for so many keys: at least 64 bits, rounded up to whole bytes."""
    return F.ceil(F.greatest(F.lit(64), keys * bits_per_key) / 8).cast("long")


def bloom_size(keys: int, bits_per_key: int) -> int:
    """Bits of the same array, for a number."""
    return -(-max(64, keys * bits_per_key) // 8) * 8


def best_hash_count(bits_per_key: Column) -> Column:
    return F.when(bits_per_key >= 44, 30).otherwise(F.least(F.greatest(F.round(bits_per_key * F.log(F.lit(2.0))), F.lit(1)), F.lit(30))).cast("int")


def format_key(n: Column) -> Column:
    return F.concat(F.lit("key"), F.lpad(n.cast("string"), 20, "0"))


def strict_unsigned(s: Column, highest: int = (1 << 64) - 1) -> Column:
    """The number that a string of digits alone writes, leading zeros allowed; null for anything else and beyond the highest."""
    number = F.regexp_replace(s, "^0+(?=[0-9])", "").try_cast("decimal(20,0)")
    return F.when(s.rlike("\\A[0-9]+\\z") & (number <= F.lit(str(highest)).cast("decimal(20,0)")), number)


def operation_key(n: Column) -> Column:
    """The key under which a crash test writes operation n."""
    return F.concat(F.lit("key_"), F.lpad(n.cast("string"), 20, "0"))


def operation_value(n: Column, size: int = 512) -> Column:
    """The value that belongs to it: the number, then one letter up to the size."""
    return F.rpad(F.concat(F.lit("value_"), n.cast("string"), F.lit("_")), F.lit(size), F.char(97 + n % 26))


def operation_of_key(key: Column) -> Column:
    """The operation that such a key names; null for any other key and for operation 0."""
    n = strict_unsigned(F.substr(key, F.lit(5)))
    return F.when(key.startswith("key_") & (n > 0), n)


def bloom_hex(hashes: Column, m: Column, bits: Column) -> Column:
    """A filter as it is stored: the number of hashes in four bytes, that of bits in eight, then the bits."""
    return F.concat(fixed_hex(hashes, 4), fixed_hex(m, 8), F.hex(bits))


def bloom_from_hex(h: Column, most_hashes: int = 30) -> Column:
    """A struct of hashes, m and bits; null if the header is short, the number of hashes not in 1 to the most, or the bits are too few or too many."""
    hashes, m = fixed_from_hex(h, 4), fixed_from_hex(h.substr(F.lit(9), F.lit(16)), 8)
    ok = hashes.between(1, most_hashes) & (F.length(h) == 24 + 2 * F.ceil(m / 8))
    return F.when(ok, F.struct(hashes.cast("int").alias("hashes"), m.cast("long").alias("m"), F.unhex(h.substr(F.lit(25), F.length(h))).alias("bits")))


def fnv1a(keys: Sequence[str], seed: int = 0) -> np.ndarray:
    """Seeded 64-bit FNV-1a of each string, all strings byte by byte at once."""
    data = [k.encode() if isinstance(k, str) else bytes(k) for k in keys]
    sizes = np.array([len(x) for x in data], np.int64)
    padded = np.zeros((len(data), int(sizes.max(initial=0))), np.uint64)
    for i, x in enumerate(data):
        padded[i, : len(x)] = np.frombuffer(x, np.uint8)
    h = np.full(len(data), FNV_OFFSET ^ seed, np.uint64)
    for j in range(padded.shape[1]):
        live = sizes > j
        h[live] = (h[live] ^ padded[live, j]) * np.uint64(FNV_PRIME)
    return h


def double_hashes(keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes from which a filter's bits follow."""
    one, two = fnv1a(keys), fnv1a(keys, 0x9E3779B97F4A7C15)
    return one, np.where(two == 0, np.uint64(0x9E3779B97F4A7C15), two)


def bloom_positions(keys: Sequence[str], bits: np.ndarray | int, hashes: int) -> np.ndarray:
    """The bits, one row for each key, that double hashing picks among so many bits."""
    one, two = double_hashes(keys)
    m = np.asarray(bits, np.uint64).reshape(-1, 1) if np.ndim(bits) else np.uint64(bits)
    return ((one[:, None] + np.arange(hashes, dtype=np.uint64) * two[:, None]) % m).astype(np.int64)
