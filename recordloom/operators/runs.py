"""Running sums over a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.sources.scratch import table


def running_sums(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Range-partition by the order column, sum inside each partition, and add what lies in partitions before it.

    Only a row of sums per partition crosses to the one task that adds them up. The partitions are written once: Spark samples
    their bounds, and two plans of one partitioning can get two sets of bounds.
    """
    by = F.desc(order) if descending else F.asc(order)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = table(df.repartitionByRange(n, by).withColumn("_part", F.spark_partition_id()), "parts")
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])
    own = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(offsets), "_part")  # a row per partition
    return out.withColumns({name: F.sum(c).over(own) + F.col(f"_before_{c}") for c, name in sums.items()}).drop("_part", *[f"_before_{c}" for c in sums])


def segmented_sums(df: DataFrame, within: str, order: str, sums: dict[str, str]) -> DataFrame:
    """Running sums from the highest value of order down, apart for each value of `within`, of which one may have any share of the rows.

    Range partitions by both columns split a large segment; what its earlier partitions sum up to is added. Only segments that
    lie in several partitions need that: one per boundary between partitions at most.
    """
    by = [F.asc(within), F.desc(order)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = table(df.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), "segments")
    totals = parts.groupBy(within, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    inside = Window.partitionBy(within)
    before = inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_n", F.count("*").over(inside)).where("_n > 1")
    carried = carried.select(within, "_part", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])
    own = Window.partitionBy("_part", within).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(carried), [within, "_part"], "left")  # two rows per partition at most
    return out.withColumns({name: F.sum(c).over(own) + F.coalesce(f"_before_{c}", F.lit(0)) for c, name in sums.items()}).drop("_part", *[f"_before_{c}" for c in sums])
