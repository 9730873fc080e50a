"""Data profiles: nulls, lengths, value counts, duplicates, collisions, overlaps, drift, signal comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import PLACEHOLDERS, edge_flags, metrics


def null_counts(df: DataFrame) -> DataFrame:
    """column, n, n_null, n_empty, n_placeholder: one pass, one row per column."""
    texts = {k for k, t in df.dtypes if t == "string"}
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    aggs = []
    for c in df.columns:
        trimmed = F.trim(F.lower(F.col(c))) if c in texts else F.lit(None)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), count(F.col(c).isNull()).alias("n_null"), count(F.coalesce(trimmed == "", F.lit(False))).alias("n_empty"), count(F.coalesce(trimmed.isin(*PLACEHOLDERS), F.lit(False))).alias("n_placeholder")))
    return df.agg(F.array(*aggs).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def text_profile(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Sum, mean, extremes and sum of squares of the length, and totals of every character class."""
    m = metrics(F.col(column))
    rows = df.select(*(by or []), *[v.alias(k) for k, v in m.items()])
    out = rows.groupBy(*(by or []))
    return out.agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.sum(F.col("n_chars") * F.col("n_chars")).alias("sum_sq_chars"), *[F.sum(k).alias(f"sum_{k}") for k in m])


def describe(df: DataFrame, column: str, by: list[str] | None = None, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Mean, deviation, extremes and exact percentiles (interpolated). These are read off running counts of distinct values, in
    range partitions: a group may have any share of the rows, and none is one task's."""
    from recordloom.operators.runs import segmented_sums

    c, by = F.col(column), by or []
    rows = df.select(F.struct(*[F.col(k) for k in by], F.lit(0).alias("_")).alias("_g"), c.alias("_v"))  # a struct's nulls are equal
    base = rows.groupBy("_g").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    counts = rows.where("_v IS NOT NULL").groupBy("_g", "_v").agg(F.count("*").alias("_k"))
    placed = segmented_sums(counts, "_g", "_v", {"_k": "_down"}).join(base.select("_g", "n"), "_g").withColumn("_first", F.col("n") - F.col("_down"))
    at = lambda i: F.max(F.when((F.col("_first") <= i) & (i < F.col("_first") + F.col("_k")), F.col("_v").cast("double")))
    place = {q: (F.col("n") - 1) * F.lit(float(q)) for q in quantiles}
    ends = [x for i, p in enumerate(place.values()) for x in (at(F.floor(p)).alias(f"_low{i}"), at(F.ceil(p)).alias(f"_high{i}"))]
    out = base.join(placed.groupBy("_g").agg(*ends), "_g", "left") if ends else base
    between = [F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise((F.ceil(p) - p) * F.col(f"_low{i}") + (p - F.floor(p)) * F.col(f"_high{i}")).alias(f"p{round(q * 100)}") for i, (q, p) in enumerate(place.items())]
    return out.select(*[F.col("_g")[k].alias(k) for k in by], "n", "mean", "std", "min", "max", *between)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(top) if top else counts


def duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values that several rows have, over all rows: the columns and n."""
    return df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n")).where("n > 1")


def collisions(df: DataFrame, keys: dict) -> DataFrame:
    """For each key expression: distinct keys, groups of 2, 5 and 10 or more, the largest, and rows in shared keys."""
    def one(name, key):
        groups = df.select(key.alias("k")).where("k IS NOT NULL AND k <> ''").groupBy("k").agg(F.count("*").alias("n"))
        at = lambda m: F.sum((F.col("n") >= m).cast("long"))
        return groups.agg(F.lit(name).alias("key"), F.count("*").alias("n_keys"), at(2).alias("ge2"), at(5).alias("ge5"), at(10).alias("ge10"), F.max("n").alias("largest"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_shared"))

    return reduce(DataFrame.unionByName, [one(k, v) for k, v in keys.items()])


def set_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of each side, of both, and the share of each that both have."""
    x = a.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_s", F.lit(1))
    y = b.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_s", F.lit(2))
    sides = x.union(y).groupBy(column).agg(F.sum("_s").alias("s"))
    n = lambda *v: F.sum(F.col("s").isin(*v).cast("long"))
    return sides.agg(n(1, 3).alias("n_a"), n(2, 3).alias("n_b"), n(3).alias("n_both")).withColumns({"share_a": F.col("n_both") / F.col("n_a"), "share_b": F.col("n_both") / F.col("n_b")})


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def flag_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of rows with each edge-case flag (a row may have several)."""
    flags = df.select(edge_flags(F.col(column)).alias("f"))
    n = flags.count()
    return flags.select(F.explode(F.filter(F.split("f", r"\|"), lambda x: x != "")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / max(1, n))


def drift(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Share of each value on both sides and the difference."""
    def shares(d, name):
        c = d.groupBy(column).agg(F.count("*").alias("_n"))
        total = d.count()
        return c.select(column, (F.col("_n") / max(1, total)).alias(name))

    out = shares(a, "share_a").join(shares(b, "share_b"), column, "full_outer").fillna(0.0, ["share_a", "share_b"])
    return out.withColumn("change", F.col("share_b") - F.col("share_a"))


def signal_comparison(pairs: DataFrame, label: str, signals: list[str]) -> DataFrame:
    """Mean and median of every signal for each label."""
    return pairs.groupBy(label).agg(F.count("*").alias("n"), *[x for s in signals for x in (F.avg(s).alias(f"{s}_mean"), F.percentile(s, F.lit(0.5)).alias(f"{s}_median"))])


def shift_check(train: DataFrame, test: DataFrame, column: str = "country") -> DataFrame:
    """Values of the column that only the test side has, with their rows."""
    return test.join(train.select(column).distinct(), column, "left_anti").groupBy(column).agg(F.count("*").alias("n"))


def pattern_labels(conditions: dict) -> "F.Column":
    """Names of all conditions that hold, in order: the first is the one of most priority."""
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]), lambda x: x.isNotNull())


def label_shares(df: DataFrame, labels: str) -> DataFrame:
    n = df.count()
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / max(1, n))
