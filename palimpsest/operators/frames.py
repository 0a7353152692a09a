"""Log frames: checksum, length, payload; written, and read back up to the first that is not sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import codec


def payload_hex(key: Column, seq: Column, op: Column, value: Column) -> Column:
    """One byte of op, eight of seq, then key and value with their lengths."""
    return F.concat(codec.fixed_hex(op, 1), codec.fixed_hex(seq, 8), codec.slice_hex(key), codec.slice_hex(F.coalesce(value, F.lit(""))))


def encode(log: DataFrame) -> DataFrame:
    """log with payload, crc and frame, the latter in hexadecimal."""
    payload = payload_hex(F.col("user_key"), F.col("seq"), F.col("op"), F.col("value"))
    rows = log.withColumn("payload", payload).withColumn("crc", F.crc32(F.unhex("payload")))
    return rows.withColumn("frame", F.concat(codec.fixed_hex(F.col("crc"), 4), codec.fixed_hex(F.length("payload") / 2, 4), F.col("payload")))


def decode(frames: DataFrame) -> DataFrame:
    """frames (frame, ...) with good, user_key, seq, op and value, null where a frame is not good.

    A good frame has a whole header, as many bytes as it says, their checksum, a known op, and slices that end where it does; a
    delete has no value.
    """
    def parsed(h: Column, body: Column, k: Column, v: Column) -> Column:
        said, size = codec.fixed_from_hex(F.substring(h, 1, 8), 4), codec.fixed_from_hex(F.substring(h, 9, 8), 4)
        sound = (F.length(h) >= 16) & (F.length(body) == 2 * size) & (F.crc32(F.unhex(body)).cast("decimal(20,0)") == said)
        op, seq = codec.fixed_from_hex(F.substring(body, 1, 2), 1).cast("int"), codec.fixed_from_hex(F.substring(body, 3, 16), 8)
        good = sound & op.isin(0, 1) & (seq < 1 << 56) & k["bytes"].isNotNull() & (v["rest"] == "") & ((op == 1) | (v["bytes"] == ""))
        text = lambda c: F.decode(F.unhex(c), "UTF-8")
        return F.struct(F.coalesce(good, F.lit(False)).alias("good"), text(k["bytes"]).alias("user_key"), seq.cast("long").alias("seq"), op.alias("op"), F.when(op == 1, text(v["bytes"])).alias("value"))

    body = lambda h: h.substr(F.lit(17), F.length(h))
    after = lambda b: codec.slice_from_hex(b.substr(F.lit(19), F.length(b)))
    parts = lambda h, b: codec.let(after(b), lambda k: codec.let(codec.slice_from_hex(k["rest"]), lambda v: parsed(h, b, k, v)))
    whole = codec.let(F.col("frame"), lambda h: codec.let(body(h), lambda b: parts(h, b)))
    names = ("user_key", "seq", "op", "value")
    kept = [c for c in frames.columns if c not in ("good", *names)]
    return frames.withColumn("parsed_", whole).select(*kept, "parsed_.good", *(F.when(F.col("parsed_.good"), F.col(f"parsed_.{c}")).alias(c) for c in names))
