"""Dictionaries learned from true pairs: votes per key, accepted by support and share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import INDIC, basic, normalize_address, words

#: Fixed: French street abbreviations.
FRENCH_TOKENS = {
    "r": "rue", "av": "avenue", "ave": "avenue", "bd": "boulevard", "bld": "boulevard", "blvd": "boulevard", "imp": "impasse", "ch": "chemin",
    "che": "chemin", "chem": "chemin", "pl": "place", "all": "allee", "rte": "route", "sq": "square", "crs": "cours", "pass": "passage",
    "qu": "quai", "fg": "faubourg", "fbg": "faubourg", "res": "residence", "lot": "lotissement", "st": "saint", "ste": "sainte",
    "prom": "promenade", "cite": "cite", "hameau": "hameau", "sent": "sentier", "voie": "voie",
}


def vote(ballots: DataFrame, totals: DataFrame | None = None, least: int = 2, share: float = 0.5) -> DataFrame:
    """(key, value, n, total): the value most voted for by each key (the least on ties) with enough support.

    ballots: (key, value). totals: (key, total) if a key's occurrences aren't its votes.
    """
    counts = ballots.groupBy("key", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("key").agg(F.max("n").alias("n"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"), F.sum("n").alias("_votes"))
    best = best.withColumnRenamed("_votes", "total") if totals is None else best.drop("_votes").join(totals, "key")
    return best.where((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select("key", "value", "n", "total")


def pair_texts(records: DataFrame, truth: DataFrame, sample: int | None = None) -> DataFrame:
    """(rec, a_name, a_addr, b_name, b_addr) of true pairs; about `sample` of them, a share picked by hash, if there are more."""
    pairs = truth.where("rec >= 0").select("s1", "rec")
    n, many = pairs.count() if sample else 0, 1 << 30
    if sample and n > sample:
        pairs = pairs.where(F.pmod(F.xxhash64("rec"), F.lit(many)) < sample * many // n)
    side = lambda key, p: records.select(F.col("id").alias(key), F.coalesce("name", F.lit("")).alias(f"{p}_name"), F.coalesce("addr", F.lit("")).alias(f"{p}_addr"))
    return pairs.join(side("s1", "a"), "s1").join(side("rec", "b"), "rec")


def aligned(a: Column, b: Column) -> Column:
    """struct<key, value> of tokens at the same place, when both have as many."""
    x, y = words(b), words(a)
    return F.when(F.size(x) == F.size(y), F.zip_with(x, y, lambda k, v: F.struct(k.alias("key"), v.alias("value"))))


def learn_script_tokens(texts: DataFrame) -> DataFrame:
    """Tokens of another script and the reference token at the same place: at least 2 votes and half of all."""
    named = texts.select(basic(F.col("a_name")).alias("a"), F.col("b_name").alias("b")).where(F.col("b").rlike(INDIC))
    ballots = named.select(F.explode(aligned(F.col("a"), F.col("b"))).alias("v")).select("v.*").where(F.col("key").rlike(INDIC))
    return vote(ballots, least=2, share=0.5)


def _components(addr: Column) -> Column:
    return F.filter(F.transform(F.split(addr, ","), lambda x: F.trim(x)), lambda x: x != "")


def learn_components(texts: DataFrame, reference: DataFrame, least: int = 20, share: float = 0.6, state_rows: int = 300, own_share: float = 0.2) -> DataFrame:
    """Unmatched components of at most three words and the state (last component) they stand for."""
    normal = lambda part: F.transform(part, lambda x: basic(x, encoding=False))
    lists = texts.select(normal(_components(F.col("a_addr"))).alias("a"), _components(F.col("b_addr")).alias("raw"))
    rows = lists.select("a", F.explode("raw").alias("c")).withColumn("key", F.when(F.col("c").rlike(INDIC), F.col("c")).otherwise(F.lower("c")))
    rows = rows.where(~F.array_contains("a", basic(F.col("c"), encoding=False)) & (F.size(words(F.col("key"))) <= 3))
    totals = rows.groupBy("key").agg(F.count("*").alias("total"))
    ballots = rows.select("key", F.explode(F.slice(F.col("a"), F.greatest(F.size("a") - 2, F.lit(1)), F.lit(3))).alias("value"))
    comps = reference.select(normal(_components(F.coalesce("addr", F.lit("")))).alias("c")).where(F.size("c") > 0)
    states = comps.groupBy(F.element_at("c", -1).alias("value")).agg(F.count("*").alias("k")).where(F.col("k") >= state_rows).select("value")
    anywhere = comps.select(F.explode("c").alias("plain")).groupBy("plain").agg(F.count("*").alias("_any"))
    best = vote(ballots, totals, least, share).join(states, "value", "left_semi").withColumn("plain", basic(F.col("key"), encoding=False))
    return best.where("plain <> value").join(anywhere, "plain", "left").where(F.coalesce("_any", F.lit(0)) < own_share * F.col("total")).select("key", "value", "n", "total")


def learn_tokens(texts: DataFrame, least: int = 30, share: float = 0.4, own_share: float = 0.2) -> DataFrame:
    """Unmatched address tokens and the longer reference token of the same first letter they abbreviate."""
    lists = texts.select(F.array_distinct(words(normalize_address(F.col("a_addr"))["atok"])).alias("a"), F.array_distinct(words(normalize_address(F.col("b_addr"))["atok"])).alias("b"))
    only = lists.select(F.array_except("b", "a").alias("x"), F.array_except("a", "b").alias("y"), "a")
    rows = only.select(F.explode("x").alias("key"), "y")
    totals = rows.groupBy("key").agg(F.count("*").alias("total"))
    ballots = rows.select("key", F.explode("y").alias("value")).where((F.substring("key", 1, 1) == F.substring("value", 1, 1)) & (F.length("value") > F.length("key")))
    own = only.select(F.explode("a").alias("key")).groupBy("key").agg(F.count("*").alias("_own"))
    best = vote(ballots, totals, least, share).where((F.length("key") >= 2) | F.col("key").isin("n", "s", "e", "w"))
    return best.join(own, "key", "left").where(F.coalesce("_own", F.lit(0)) < own_share * F.col("total")).select("key", "value", "n", "total")


def as_map(table: DataFrame, limit: int = 100_000) -> Column:
    """A learned dictionary as a map column: a literal, for at most `limit` entries (they are on the driver then)."""
    rows = table.select("key", "value").orderBy("key").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} entries: join the table instead")
    return F.map_from_arrays(F.lit([r["key"] for r in rows]), F.lit([r["value"] for r in rows])) if rows else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def boundary_shares(names: DataFrame, column: str, least: int = 20, share: float = 0.5) -> DataFrame:
    """(country, token, position, n, share): tokens that stand mostly at the start or end of names."""
    tokens = names.select("country", words(F.col(column)).alias("t")).where(F.size("t") > 0)
    rows = tokens.select("country", F.posexplode("t").alias("i", "token"), F.size("t").alias("k"))
    counts = rows.groupBy("country", "token").agg(F.count("*").alias("n"), F.sum((F.col("i") == 0).cast("long")).alias("first"), F.sum((F.col("i") == F.col("k") - 1).cast("long")).alias("last"))
    each = counts.select("country", "token", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("position"), (F.col(p) / F.col("n")).alias("share")) for p in ("first", "last")])).alias("s"))
    return each.select("country", "token", "s.position", "n", "s.share").where((F.col("n") >= least) & (F.col("share") >= share))
