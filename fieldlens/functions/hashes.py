"""Perceptual hashes: 256 bits as `d1:` and 64 hex digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.constants import HASH_COLS, HASH_ROWS

WORDS = 8                                   # eight 32-bit words


def is_hash(h: Column) -> Column:
    return F.coalesce(h.rlike("^d1:[0-9a-f]{64}$"), F.lit(False))


def words(h: Column) -> Column:
    """The hash as an array of eight BIGINTs of 32 bits each."""
    return F.array(*[F.conv(F.substring(h, 4 + 8 * i, 8), 16, 10).cast("bigint") for i in range(WORDS)])


def hamming_words(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, WORDS)),
               F.bit_count(a[0].bitwiseXOR(b[0])))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; null across algorithms or for text that is no hash."""
    return F.when(is_hash(a) & is_hash(b), hamming_words(words(a), words(b)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def difference_hash(gray: Column) -> Column:
    """272 gray values (16 rows of 17, row-major) to a hash: is each value below its right neighbour."""
    width = HASH_COLS + 1

    def nibble(k):
        row, start = F.floor(k / 4), (k % 4) * 4
        at = (row * width + start).cast("int")
        return sum((F.when(F.get(gray, at + i) < F.get(gray, at + i + 1), 8 >> i).otherwise(0)
                    for i in range(1, 4)),
                   F.when(F.get(gray, at) < F.get(gray, at + 1), 8).otherwise(0))

    digits = F.transform(F.sequence(F.lit(0), F.lit(HASH_COLS * HASH_ROWS // 4 - 1)),
                         lambda k: F.lower(F.hex(nibble(k).cast("bigint"))))
    return F.when(F.size(gray) == width * HASH_ROWS, F.concat(F.lit("d1:"), F.array_join(digits, "")))
