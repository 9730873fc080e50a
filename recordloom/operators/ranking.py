"""Competition among candidates: ranks, margins, leads, reverse ranks, caps. Every order ends in an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_and_margin(df: DataFrame, scores: dict[str, str], group: str = "rec", tie: str = "s1") -> DataFrame:
    """For each score column: its rank in the group (1 is best) and its distance to the group's best; and n_cand."""
    own = Window.partitionBy(group)
    out = {}
    for suffix, c in scores.items():
        out[f"r_{suffix}"] = F.row_number().over(own.orderBy(F.desc(c), tie))
        out[f"m_{suffix}"] = F.col(c) - F.max(c).over(own)
    return df.withColumns({**out, "n_cand": F.count("*").over(own)})


def top_counts(df: DataFrame, rank: str, target: str = "s1", name: str = "s1_top_cnt") -> DataFrame:
    """How many groups put the target first."""
    return df.withColumn(name, F.sum((F.col(rank) == 1).cast("long")).over(Window.partitionBy(target)))


def context(df: DataFrame, score: str = "score", group: str = "s1", tie: str = "cand", prefix: str = "fwd") -> DataFrame:
    """Rank, size and margin to the best other score (a group of one: the score itself)."""
    own = Window.partitionBy(group)
    ordered = own.orderBy(F.desc(score), tie)
    full = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank, best, second = F.row_number().over(ordered), F.first(score).over(full), F.nth_value(score, 2).over(full)
    other = F.when(rank == 1, F.coalesce(second, F.lit(0.0))).otherwise(best)
    return df.withColumns({f"{prefix}_rank": rank, f"{prefix}_n": F.count("*").over(own), f"{prefix}_margin": F.col(score) - other})


def competition(df: DataFrame, p: str = "p", group: str = "rec", target: str = "s1", name: str | None = None) -> DataFrame:
    """<p>_gap: to the second best for the best (ties count as best), else to the best; <p>_s1top: firsts of the target."""
    name = name or p
    own = Window.partitionBy(group)
    full = own.orderBy(F.desc(p), target).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, second = F.max(p).over(own), F.coalesce(F.nth_value(p, 2).over(full), F.lit(0.0))
    out = df.withColumn("_best", best).withColumn(f"{name}_gap", F.when(F.col(p) >= best, F.col(p) - second).otherwise(F.col(p) - best))
    top = F.sum((F.col(p) >= F.col("_best")).cast("long")).over(Window.partitionBy(target))
    return out.withColumn(f"{name}_s1top", top).drop("_best")


def best_and_lead(df: DataFrame, p: str = "p", group: str = "rec", target: str = "s1") -> DataFrame:
    """The group's best row and its lead over the next (0 where the best score is tied; the score itself when alone)."""
    w = Window.partitionBy(group).orderBy(F.desc(p), target)
    out = df.withColumns({"_n": F.row_number().over(w), "lead": F.col(p) - F.lead(p, 1, 0.0).over(w)})
    return out.where("_n = 1").drop("_n")


def cap_groups(df: DataFrame, limit: int | Column, by: tuple[str, ...], p: str = "p", tie: str = "rec") -> DataFrame:
    """The best rows of each group, at most limit."""
    w = Window.partitionBy(*by).orderBy(F.desc(p), tie)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def prune(df: DataFrame, p: str = "p_prune", keep: int = 6, least: float = 0.002, group: str = "rec", tie: str = "s1") -> DataFrame:
    """The best `keep` of a group above `least`, always its first; with pr_rank and pr_margin."""
    w = Window.partitionBy(group)
    out = df.withColumn("_n", F.row_number().over(w.orderBy(F.desc(p), tie)))
    out = out.where((F.col("_n") <= keep) & ((F.col(p) >= least) | (F.col("_n") == 1)))
    return out.withColumns({"pr_rank": F.col("_n") - 1, "pr_margin": F.col(p) - F.max(p).over(w)}).drop("_n")


def two_sided(df: DataFrame, scores: tuple[str, ...]) -> DataFrame:
    """Rank and gap of each score among the record's and among the entity's candidates, and group sizes."""
    out = df
    for side, tie in (("rec", "s1"), ("s1", "rec")):
        own = Window.partitionBy(side)
        out = out.withColumn(f"n_{side}", F.count("*").over(own))
        for c in scores:
            out = out.withColumns({f"{c}_rank_{side}": F.row_number().over(own.orderBy(F.desc(c), tie)), f"{c}_gap_{side}": F.col(c) - F.max(c).over(own)})
    return out


def sample_per_group(df: DataFrame, limit: int, by: str, key: str, salt: str = "sample") -> DataFrame:
    """A stratified, repeatable sample: the rows of least hash."""
    from recordloom.functions.ids import hash_part

    w = Window.partitionBy(by).orderBy(hash_part(F.col(key), salt, 1 << 31), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
