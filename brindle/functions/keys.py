"""Keys, salted keys and partition numbers. A salt is a column of its own (null: unsalted); text forms are for export and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_key(key: Column, salt: Column | None = None) -> Column:
    """``key``, or ``key#salt`` where there is a salt."""
    if salt is None:
        return key
    return F.when(salt.isNull(), key).otherwise(F.concat(key, F.lit("#"), salt.cast("string")))


def partition_id(key: Column, n: int, salt: Column | None = None) -> Column:
    """CRC32 (IEEE) of the canonical key modulo ``n``."""
    if n <= 0:
        raise ValueError("the number of partitions must be positive")
    return F.pmod(F.crc32(canonical_key(key, salt).cast("binary")), F.lit(n)).cast("int")


def salted_key(key: Column, salt: Column | int | None = None) -> Column:
    """A struct (k, salt); without a salt the key is unsalted."""
    s = salt if isinstance(salt, Column) else F.lit(salt)
    return F.struct(key.alias("k"), s.cast("int").alias("salt"))


def base_key(salted: Column) -> Column:
    return salted["k"]


def is_salted(salted: Column) -> Column:
    return salted["salt"].isNotNull()


def encode_key(salted: Column) -> Column:
    """The text form of a salted key."""
    return canonical_key(salted["k"], salted["salt"])


def decode_key(text: Column) -> Column:
    """The salted key of a text form. More than one ``#``, or a salt that is no integer, gives null."""
    parts = F.split(text, "#", -1)
    salt = F.try_element_at(parts, F.lit(2)).try_cast("int")
    one = F.when(F.size(parts) == 1, salted_key(parts[0]))
    return one.when((F.size(parts) == 2) & salt.isNotNull(), salted_key(F.get(parts, F.lit(0)), salt))


def source_salt(source: Column, splits: Column) -> Column:
    """CRC32 of the source modulo ``splits``; 0 where there are no splits. It depends on the row alone, so a retried task agrees."""
    return F.when(splits > 0, F.pmod(F.crc32(source.cast("binary")), F.nullif(splits, F.lit(0)))).otherwise(0).cast("int")


def row_salt(splits: Column, *identity: Column) -> Column:
    """A salt from what identifies a row (a document and a position, say); spreads like taking turns."""
    text = F.concat_ws(":", *(i.cast("string") for i in identity))
    return F.pmod(F.crc32(text.cast("binary")), splits).cast("int")


def sampled(rate: float, seed: int, *identity: Column) -> Column:
    """True for a share ``rate`` of rows, by a hash of seed and identity: the same rows however the data is partitioned."""
    key = F.concat_ws(":", F.lit(str(seed)), *(i.cast("string") for i in identity))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(1_000_000)) < int(round(rate * 1_000_000))
