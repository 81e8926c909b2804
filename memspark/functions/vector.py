"""Quantisation of vectors to bytes, and hash embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(v: Column) -> Column:
    """struct(codes array<int> of 0 to 255, low, high); null, empty and non-finite vectors give null."""
    low, high = F.array_min(v), F.array_max(v)
    step = F.lit(255.0).cast("float") / (high - low)
    codes = F.when(high == low, F.transform(v, lambda x: F.lit(0))).otherwise(F.transform(v, lambda x: F.rint((x - low) * step).cast("int")))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(v) > 0) & finite, F.struct(codes.alias("codes"), low.alias("low"), high.alias("high")))


def dequantize(q: Column) -> Column:
    step = (q["high"] - q["low"]) / F.lit(255.0).cast("float")
    return F.transform(q["codes"], lambda c: (c.cast("float") * step + q["low"]).cast("float"))


def hash_embedding(c: Column, dim: int = 64) -> Column:
    """A unit vector that depends on the text only (and says nothing of its meaning); of a null text null.

    Its numbers are the little-endian words of SHA-256 of the text, a zero
    character and the number of the block, on [-1, 1).
    """

    def word(h: Column, i: int) -> Column:
        parts = [F.substring(h, 8 * i + 2 * k + 1, 2) for k in (3, 2, 1, 0)]
        return (F.conv(F.concat(*parts), 16, 10).cast("double") / 2.0**32 * 2 - 1).cast("float")

    blocks = [F.sha2(F.concat(c, F.lit("\0" + str(b))), 256) for b in range(-(-dim // 8))]
    v = F.slice(F.flatten(F.transform(F.array(*blocks), lambda h: F.array(*[word(h, i) for i in range(8)]))), 1, dim)
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(c.isNotNull(), F.transform(v, lambda x: F.when(n > 0, (x / n).cast("float")).otherwise(x)))
