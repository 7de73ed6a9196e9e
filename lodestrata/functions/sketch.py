"""Sketches from SHA-256: HyperLogLog registers and Bloom filters, as tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTERS = 512
ALPHA = 0.7213 / (1 + 1.079 / REGISTERS)


def _word(digest: Column, first: int) -> Column:
    """32 bits of a hexadecimal digest from digit ``first``."""
    return F.conv(F.substring(digest, first, 8), 16, 10).cast("long")


def registers(items: DataFrame, name: str, item: str) -> DataFrame:
    """name, bucket, rho: at most one row a register survives the map side.

    The hash is the first 64 bits of SHA-256: nine low bits choose the register, rho is the place of the first set bit
    of the other 55 (56 if there is none).
    """
    digest = F.sha2(F.col(item), 256)
    high, low = _word(digest, 1), _word(digest, 9)
    rest = F.shiftleft(high, 23).bitwiseOR(F.shiftright(low, 9))
    rho = F.lit(56) - F.when(rest == 0, 0).otherwise(F.length(F.bin(rest)))
    return items.select(F.col(name).alias("name"), low.bitwiseAND(REGISTERS - 1).alias("bucket"), rho.cast("int").alias("rho")).groupBy("name", "bucket").agg(F.max("rho").alias("rho"))


def merge(regs: DataFrame, into: str) -> DataFrame:
    """The union of all sketches in ``regs``, register by register: nothing is hashed again."""
    return regs.groupBy(F.lit(into).alias("name"), "bucket").agg(F.max("rho").alias("rho"))


def estimate(regs: DataFrame) -> DataFrame:
    """name, registers used, estimate (linear counting for small sets)."""
    s = regs.groupBy("name").agg(F.count(F.lit(1)).alias("used"), F.sum(F.expr("pow(2.0D, -rho)")).alias("z"))
    raw = F.lit(ALPHA * REGISTERS * REGISTERS) / (F.col("z") + REGISTERS - F.col("used"))
    small = REGISTERS * F.log(F.lit(float(REGISTERS)) / (REGISTERS - F.col("used")))
    value = F.when((raw <= 2.5 * REGISTERS) & (F.col("used") < REGISTERS), small).otherwise(raw)
    return s.select("name", "used", F.round(value).cast("long").alias("estimate"))


def bloom_size(capacity: int, rate: float = 0.01) -> tuple[int, int]:
    """Bits and hashes for so many distinct items at a false-positive rate."""
    capacity = max(1, capacity)
    bits = math.ceil(-capacity * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, round(bits / capacity * math.log(2)))


def bloom_bits(items: DataFrame, item: str, bits: int, hashes: int) -> DataFrame:
    """The set bits of a Bloom filter by double hashing."""
    return items.select(F.explode(_places(F.col(item), bits, hashes)).alias("bit")).distinct()


def _places(text: Column, bits: int, hashes: int) -> Column:
    """(h1 + i h2) mod bits, where h1 and h2 are the first two 64-bit words of SHA-256."""
    digest = F.sha2(text, 256)
    if bits < 1 << 31:  # in 64 bits: the remainders of halves
        one, two = (((_word(digest, at) % bits) * ((1 << 32) % bits) + _word(digest, at + 8)) % bits for at in (1, 17))
        return F.array(*[(one + i * two) % bits for i in range(hashes)])
    wide = F.lit(1 << 32).cast("decimal(12,0)")
    one, two = (((_word(digest, at).cast("decimal(12,0)") * wide + _word(digest, at + 8)) % F.lit(bits).cast("decimal(19,0)")).cast("long") for at in (1, 17))
    return F.array(*[((one.cast("decimal(20,0)") + two.cast("decimal(20,0)") * i) % F.lit(bits).cast("decimal(19,0)")).cast("long") for i in range(hashes)])


def bloom_probe(probes: DataFrame, item: str, filter_bits: DataFrame, bits: int, hashes: int) -> DataFrame:
    """item, maybe: whether all its bits are set."""
    asked = probes.select(item).distinct().select(item, F.explode(F.array_distinct(_places(F.col(item), bits, hashes))).alias("bit"))
    hit = asked.join(filter_bits.withColumn("set", F.lit(1)), "bit", "left")
    return hit.groupBy(item).agg((F.count("set") == F.count(F.lit(1))).alias("maybe"))
