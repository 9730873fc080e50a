"""The second family's stages: records prepared with their canonical forms, and candidates from the key index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import blocking, classic, names


def preprocess(records: DataFrame) -> DataFrame:
    """id, country, name, rom (romanised name), addr, addr_rom, raw, core (c4b), legal, canon of every record.

    Names and addresses are normalised first; romanised forms are the same where a record's script is Latin (a cache of
    transliterations may replace them: names.romanize)."""
    plain = records.select("id", "country", classic.normalize_name(F.col("name")).alias("name"), classic.normalize_address(F.col("addr")).alias("addr"), F.col("addr").alias("raw"))
    keys = names.canonical_keys(F.col("name"))
    return plain.select("id", "country", "name", F.col("name").alias("rom"), "addr", F.col("addr").alias("addr_rom"), "raw", keys["c4b"].alias("core"), keys["legal"].alias("legal"), classic.canonical_address(F.col("addr"), F.col("country")).alias("canon"))


def key_candidates(norm: DataFrame, k: int = 50, reverse_k: int = 3) -> DataFrame:
    """(s1, cand, score, mask, ranks) by the inverted index over every key family, cut by the keep rule."""
    s1, rec = norm.where("src = 1"), norm.where("src > 1")
    return blocking.kept_key_hits(s1, rec, k, reverse_k)
