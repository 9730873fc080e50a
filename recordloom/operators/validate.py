"""Checks of a grouped-list output: a table of violations, empty when it is right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("duplicate row", "id repeated in a list", "entity in a list", "wrong prefix", "unknown id", "missing entity", "extra entity", "in two lists")


def violations(output: DataFrame, entities: DataFrame, known: DataFrame | None = None, subset_of: DataFrame | None = None) -> DataFrame:
    """rule, entity, id. output: (s1_id, ids); entities and known: (id) as text; subset_of: (s1_id, ids) that must hold all."""
    lists = output.select("s1_id", F.explode(F.filter(F.split(F.coalesce("ids", F.lit("")), ","), lambda x: x != "")).alias("id"))
    found = lambda rule, df: df.select(F.lit(rule).alias("rule"), F.col("s1_id").alias("entity"), "id")
    none = F.lit(None).cast("string").alias("id")
    checks = [
        found("duplicate row", output.groupBy("s1_id").agg(F.count("*").alias("n")).where("n > 1").select("s1_id", none)),
        found("id repeated in a list", lists.groupBy("s1_id", "id").agg(F.count("*").alias("n")).where("n > 1")),
        found("entity in a list", lists.where(F.col("id").startswith("S1-"))),
        found("wrong prefix", lists.where(~F.col("id").rlike(r"^S[123]-\d+$"))),
        found("missing entity", entities.select(F.col("id").alias("s1_id")).join(output.select("s1_id"), "s1_id", "left_anti").select("s1_id", none)),
        found("extra entity", output.select("s1_id").join(entities.select(F.col("id").alias("s1_id")), "s1_id", "left_anti").select("s1_id", none)),
        found("in two lists", lists.distinct().groupBy("id").agg(F.count("*").alias("n"), F.min("s1_id").alias("s1_id")).where("n > 1")),
    ]
    if known is not None:
        checks.append(found("unknown id", lists.join(known.select("id"), "id", "left_anti")))
    if subset_of is not None:
        wide = subset_of.select("s1_id", F.explode(F.split(F.coalesce("ids", F.lit("")), ",")).alias("id"))
        checks.append(found("match not a candidate", lists.join(wide, ["s1_id", "id"], "left_anti")))
    return reduce(DataFrame.unionByName, checks)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.min("entity").alias("example"))
