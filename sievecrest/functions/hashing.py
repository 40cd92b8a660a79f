"""64-bit image hashes as Column expressions on pixel arrays, and how to compare them.

Hashes are signed ``bigint``; xor, popcount and 16-bit chunks do not depend on the sign.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievecrest.functions.vectors import let, mean

CHUNKS = 4


def bits_to_long(bits: Column) -> Column:
    """Pack an array of booleans, most significant bit first."""
    return F.aggregate(
        bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("bigint"))
    )


def average_hash(px: Column) -> Column:
    """Bit set where a pixel of the 8x8 grid is at least the mean."""
    return let(mean(px.cast("array<double>")), lambda m: bits_to_long(F.transform(px, lambda x: x >= m)))


def difference_hash(px: Column, width: int = 9, height: int = 8) -> Column:
    """Bit set where a pixel is at least its left neighbour, on a 9x8 grid."""
    steps = F.array(*[F.lit(r * width + c + 1) for r in range(height) for c in range(width - 1)])
    return let(px, lambda p: bits_to_long(F.transform(steps, lambda i: F.element_at(p, i + 1) >= F.element_at(p, i))))


def color_hash(r: Column, g: Column, b: Column, bins: int = 4) -> Column:
    """Bit set where a colour bin of the ``bins``^3 histogram is at least the mean bin."""
    width = 256 // bins
    codes = F.zip_with(
        F.zip_with(r, g, lambda x, y: F.floor(x / width) * bins + F.floor(y / width)), b, lambda xy, z: xy * bins + F.floor(z / width)
    )
    total = bins**3
    counts = let(
        codes,
        lambda cs: F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda k: F.size(F.filter(cs, lambda c: c == k))),
    )
    return let(F.size(r) / float(total), lambda m: bits_to_long(F.transform(counts, lambda n: n >= m)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def chunks(h: Column) -> Column:
    """The four 16-bit chunks of a hash, high to low."""
    return F.array(*[F.shiftrightunsigned(h, s).bitwiseAND(F.lit(65535).cast("bigint")) for s in (48, 32, 16, 0)])


def pieces(h: Column, parts: int) -> Column:
    """``parts`` disjoint slices covering all 64 bits: hashes at distance < parts share one."""
    base, extra = divmod(64, parts)
    cuts, at = [], 0
    for i in range(parts):
        size = base + (1 if i < extra else 0)
        cuts.append(F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << size) - 1).cast("bigint")))
        at += size
    return F.array(*cuts)


def digest(data: Column) -> Column:
    return F.sha2(data, 256)


def gray_bytes(px: Column) -> Column:
    """Byte string of 0..255 pixel values."""
    return F.unhex(F.array_join(F.transform(px, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
