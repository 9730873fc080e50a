"""Seeded noise: every choice is a hash of (row key, purpose, seed), so a table is the same in every run and on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import LEGAL_FORMS, words

#: Fixed: neighbours on the keyboard, for typing errors.
NEIGHBOURS = ("qwertyuiopasdfghjklzxcvbnm", "wqretyuioposadfghjkzxlcvbn")


STEPS = 1_000_003


def chance(key: Column, purpose: str, seed: int = 0) -> Column:
    """Uniform in [0, 1), in steps: the first eight digits of an MD5."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(purpose), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % STEPS / STEPS


def pick(key: Column, purpose: str, n: Column, seed: int = 0) -> Column:
    return F.floor(chance(key, purpose, seed) * n).cast("int")


def typo(word: Column, key: Column, seed: int = 0) -> Column:
    """One of: neighbour key, dropped, swapped or doubled letter."""
    at = 1 + pick(key, "place", F.greatest(F.length(word) - 1, F.lit(1)), seed)
    kind = pick(key, "kind", F.lit(4), seed)
    head, ch, tail = F.substring(word, 1, at - 1), F.substring(word, at, F.lit(1)), F.substring(word, at + 1, F.length(word))
    second = F.substring(tail, 1, 1)
    swapped = F.concat(head, second, ch, F.substring(tail, F.lit(2), F.length(word)))
    made = F.when(kind == 0, F.concat(head, F.translate(ch, *NEIGHBOURS), tail)).when(kind == 1, F.concat(head, tail)).when(kind == 2, swapped).otherwise(F.concat(head, ch, ch, tail))
    return F.when(F.length(word) < 3, word).otherwise(made)


def split_legal(name: Column) -> Column:
    """struct<rest, legal> of the last word if it is a legal form."""
    last = F.lower(F.regexp_extract(name, r"(\w+)\W*$", 1))
    found = last.isin(*LEGAL_FORMS)
    return F.struct(F.when(found, F.trim(F.regexp_replace(name, r"\s*\w+\W*$", ""))).otherwise(name).alias("rest"), F.when(found, last).otherwise("").alias("legal"))


def noisy_name(name: Column, key: Column, level: float = 1.0, seed: int = 0) -> Column:
    """Legal form dropped or changed, a word dropped or swapped, words glued, a typing error, alias or website form."""
    parts = words(split_legal(name)["rest"])
    legal = split_legal(name)["legal"]
    hit = lambda what, p: chance(key, what, seed) < min(1.0, p * level)
    n = F.size(parts)
    at = pick(key, "word", F.greatest(n, F.lit(1)), seed)
    dropped = F.when(hit("drop", 0.10) & (n > 2), F.filter(parts, lambda x, i: i != at)).otherwise(parts)
    swapped = F.when(hit("swap", 0.06) & (F.size(dropped) > 1), F.concat(F.slice(dropped, 2, 1), F.slice(dropped, 1, 1), F.slice(dropped, F.lit(3), F.greatest(F.size(dropped), F.lit(1))))).otherwise(dropped)
    typed = F.transform(swapped, lambda x, i: F.when(hit("typo", 0.25) & (i == 0), typo(x, key, seed)).otherwise(x))
    text = F.when(hit("glue", 0.05), F.array_join(typed, "")).otherwise(F.array_join(typed, " "))
    text = F.when(hit("site", 0.03), F.concat(F.lit("www."), F.lower(F.regexp_replace(text, " ", "")), F.lit(".com"))).when(hit("alias", 0.04), F.concat(F.element_at(words(name), 1), F.lit(" dba "), text)).otherwise(text)
    form = F.when(hit("legal", 0.3), "").when(hit("other", 0.1), "llc").otherwise(legal)
    return F.trim(F.concat_ws(" ", text, form))


def change_house(addr: Column, key: Column, seed: int = 0) -> Column:
    """Another first number."""
    return F.regexp_replace(addr, r"^(\D*)\d+", F.concat(F.lit("$1"), (1 + pick(key, "house", F.lit(9000), seed)).cast("string")))


def noisy_address(addr: Column, key: Column, level: float = 1.0, seed: int = 0) -> Column:
    hit = lambda what, p: chance(key, what, seed) < min(1.0, p * level)
    parts = F.split(addr, ", ")
    cut = F.when(hit("cut", 0.15) & (F.size(parts) > 1), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    return F.when(hit("lost", 0.05), "").otherwise(F.regexp_replace(F.array_join(cut, ", "), "(?i)street", F.when(hit("short", 0.4), F.lit("St")).otherwise("Street")))


def noisy_records(s1: DataFrame, src: int, level: float = 1.0, decoys: float = 0.35, seed: int = 0) -> DataFrame:
    """One noisy copy of each reference record (id, name, addr, country, s1) and decoys (s1 -1): house number and legal form changed."""
    # a column of its own: inside a lambda, id would be taken for the new id that the same select makes
    base, k = s1.withColumn("_k", F.concat_ws("/", "id", F.lit(str(src)))), F.col("_k")
    copies = base.select((F.lit(src) * 10**10 + 2 * F.col("id")).alias("id"), F.lit(src).cast("byte").alias("src"), noisy_name(F.col("name"), k, level, seed).alias("name"), noisy_address(F.col("addr"), k, level, seed).alias("addr"), "country", F.col("id").alias("s1"))
    lure = base.where(chance(k, "decoy", seed) < decoys)
    wrong = lure.select((F.lit(src) * 10**10 + 2 * F.col("id") + 1).alias("id"), F.lit(src).cast("byte").alias("src"), F.concat_ws(" ", split_legal(F.col("name"))["rest"], F.lit("llc")).alias("name"), change_house(F.col("addr"), k, seed).alias("addr"), "country", F.lit(-1).cast("long").alias("s1"))
    return copies.unionByName(wrong)
