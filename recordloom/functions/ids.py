"""Record ids and hash-chosen subsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_BASE = 10**10


def encode_id(text: Column) -> Column:
    """'S1-n' -> n, 'S2-n' and 'S3-n' -> source * 10^10 + n; anything else is null."""
    src = F.regexp_extract(text, r"^S([1-9])-(\d+)$", 1)
    num = F.regexp_extract(text, r"^S([1-9])-(\d+)$", 2)
    value = F.when(src == "1", num.try_cast("long")).otherwise(src.try_cast("long") * SOURCE_BASE + num.try_cast("long"))
    return F.when(src != "", value)


def decode_id(value: Column) -> Column:
    src = F.when(value < SOURCE_BASE, F.lit(1)).otherwise(F.expr(f"{_sql(value)} div {SOURCE_BASE}"))
    return F.concat(F.lit("S"), src.cast("string"), F.lit("-"), (value % SOURCE_BASE).cast("string"))


def _sql(value: Column) -> str:
    return value._jc.toString()


def source_of(value: Column) -> Column:
    """1 for reference records, else the source coded in the id."""
    return F.when(value < SOURCE_BASE, F.lit(1)).otherwise(F.floor(value / SOURCE_BASE)).cast("int")


def hash_part(key: Column, salt: str, parts: int) -> Column:
    """A number from 0 to parts - 1 that only depends on key and salt (first eight digits of an MD5)."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("|" + salt)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % parts


def is_holdout(key: Column, share: float = 0.1, salt: str = "holdout") -> Column:
    """The locked holdout: the same rows at every size and in every run."""
    return hash_part(key, salt, 10_000) < int(share * 10_000)


def fold(key: Column, folds: int, salt: str = "fold") -> Column:
    return hash_part(key, salt, folds).cast("int")
