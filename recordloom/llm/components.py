"""Connected components by repeated minimum-label contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.core import materialize, recorded, release


def connected(links: DataFrame) -> DataFrame:
    """links (a, b) of longs, a != b -> (node, component): component is the smallest node reachable.

    Each round every label takes the least label beside it and links are renamed; a chain of falling labels folds to at
    most half its length, so rounds grow with the logarithm of the links. Joins go against one row per label.
    """
    spark, made = links.sparkSession, []
    with recorded(made):
        labels = _labels(links)
    release(spark, [p for p in made if "/labels-" not in p] + [p for p in made if "/labels-" in p][:-1])  # the last one is the answer
    return labels


def _labels(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.where("a <> b").distinct(), "links")
    labels = None
    while True:
        least = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "least")
        if labels is None:
            labels = least.select(F.col("a").alias("node"), F.col("low").alias("component"))
        else:
            step = least.select(F.col("a").alias("component"), "low")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("low", "component").alias("component"))
        labels = materialize(labels, "labels")
        low_a, low_b = least.select("a", F.col("low").alias("la")), least.select(F.col("a").alias("b"), F.col("low").alias("lb"))
        edges = edges.join(low_a, "a").join(low_b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct()
        edges = materialize(edges, "links")
        if edges.isEmpty():
            return labels
