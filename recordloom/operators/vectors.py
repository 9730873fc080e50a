"""A clustered index of vectors: coarse centroids, every row in the list of its nearest one, queries that look into a few lists.

Centroids are fitted on a bounded sample (SAMPLE rows a list, chosen by hash); all rows are indexed. A search ranks the lists
of each query by inner product with their centroids and compares the query exactly with all rows of the best `probes` lists, in
blocks, so that a list with any share of the rows is many tasks' work. With as many probes as lists it is exact. How many it
takes is measured, not guessed: vectors without clusters need most of the lists, clustered ones a few (``probes_for``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from recordloom.operators.blocking import nearest_vectors

#: Rows for each list in the sample that centroids are fitted on.
SAMPLE = 64


def fit_centroids(base: DataFrame, lists: int, rounds: int = 10) -> np.ndarray:
    """(lists, dim) centroids of the hash-chosen sample, by Lloyd's rounds from its first rows in hash order; fewer than `lists` where
    the sample has fewer rows. The driver gets lists x SAMPLE vectors."""
    place = F.xxhash64("id", F.lit("centroids"))
    x = base.where(F.col("vector").isNotNull()).select("vector").orderBy(place, "id").limit(lists * SAMPLE).toPandas()
    if not len(x):
        return np.zeros((0, 0))
    x = np.stack(x["vector"].to_numpy()).astype(np.float64)
    centres = x[:lists].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(axis=1)
        for c in np.unique(own):
            centres[c] = x[own == c].mean(axis=0)
    return centres


def _with_lists(df: DataFrame, centres: np.ndarray, probes: int | None) -> DataFrame:
    """df with `list` and its `place`: the nearest centroid's, or a row for each of the best `probes` by inner product."""

    def found(parts):
        half = (centres**2).sum(1) / 2 if probes is None else 0.0
        for part in parts:
            if not len(part):
                continue
            near = np.stack(part["vector"].to_numpy()).astype(np.float64) @ centres.T - half
            best = np.argsort(-near, axis=1, kind="stable")[:, : probes or 1]
            out = part.loc[part.index.repeat(best.shape[1])]
            yield out.assign(list=best.ravel().astype(np.int32), place=np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), len(part)))

    schema = StructType([*df.schema.fields, StructField("list", IntegerType()), StructField("place", IntegerType())])
    return df.mapInPandas(found, schema)


def build_index(base: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, vector, list) of every row that has a vector."""
    return _with_lists(base.where(F.col("vector").isNotNull()).select("id", "vector"), centres, None).drop("place")


def probes_for(queries: DataFrame, base: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 10, share: float = 0.95, sample: int = 200) -> int:
    """The least number of probes that finds this share of the exact neighbours of at most `sample` queries, chosen by hash."""
    some = queries.where(F.col("vector").isNotNull()).select("id", "vector").orderBy(F.xxhash64("id", F.lit("probes")), "id").limit(sample)
    one = F.lit(1).alias("_all")
    exact = nearest_vectors(some.select("*", one), base.where(F.col("vector").isNotNull()).select("id", "vector", one), k, "_all")
    ranked = _with_lists(some, centres, max(1, len(centres))).select(F.col("id").alias("s1"), "list", "place")
    home = index.select(F.col("id").alias("cand"), "list")
    at = exact.join(home, "cand").join(ranked, ["s1", "list"]).groupBy("place").agg(F.count("*").alias("n"))
    counts = {r["place"]: r["n"] for r in at.collect()}  # a row per list at most
    total, have = sum(counts.values()), 0
    for place in sorted(counts):
        have += counts[place]
        if have >= share * total:
            return place
    return max(1, len(centres))


def search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 10, probes: int = 8, block_rows: int = 4096) -> DataFrame:
    """(s1, cand, cos, rank): the best k rows by inner product in each query's lists; ties go to the least cand."""
    asked = _with_lists(queries.where(F.col("vector").isNotNull()).select("id", "vector"), centres, min(probes, max(1, len(centres))))
    return nearest_vectors(asked, index, k, "list", block_rows)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of the exact neighbours that were found."""
    hit = exact.select("s1", "cand").join(found.select("s1", "cand", F.lit(1).alias("_hit")), ["s1", "cand"], "left")
    return hit.agg(F.countDistinct("s1").alias("n_queries"), (F.count("_hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall"))


