"""Outputs: grouped id lists, partitioned tables, traces, candidate lists of bounded length, append-only caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.ids import decode_id


def grouped_lists(pairs: DataFrame, population: DataFrame, keep_order: str | None = None) -> DataFrame:
    """s1_id, ids: every entity of population (s1) once, its records joined by commas, '' if none.

    Ids are distinct; sorted as text, or by the order column (first appearance) when keep_order names one.
    """
    rows = pairs.select("s1", decode_id(F.col("rec")).alias("_id"), *([F.col(keep_order).alias("_o")] if keep_order else []))
    if keep_order:
        first = rows.groupBy("s1", "_id").agg(F.min("_o").alias("_o"))
        lists = first.groupBy("s1").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_o", "_id"))), lambda x: x["_id"])).alias("ids"))
    else:
        lists = rows.groupBy("s1").agg(F.concat_ws(",", F.array_sort(F.collect_set("_id"))).alias("ids"))
    all_s1 = population.select("s1").distinct()
    return all_s1.join(lists, "s1", "left").select(decode_id(F.col("s1")).alias("s1_id"), F.coalesce("ids", F.lit("")).alias("ids"))


def write_tsv(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def decision_trace(scored: DataFrame, accepted: DataFrame, threshold: float, score: str = "p") -> DataFrame:
    """Why each pair was kept or rejected."""
    won = accepted.select("rec", F.col("s1").alias("_won")).distinct()
    out = scored.join(won, "rec", "left")
    reason = F.when(F.col("s1") == F.col("_won"), "accepted").when(F.col(score) < threshold, "below threshold").when(F.col("_won").isNotNull(), "another entity won").otherwise("not the best")
    return out.withColumn("decision", reason).drop("_won")


def trim_candidates(candidates: DataFrame, matches: DataFrame, limit: int = 5, score: str = "p") -> DataFrame:
    """At most `limit` records per s1, but always every match: (s1, rec, matched, rank)."""
    marked = candidates.join(matches.select("s1", "rec").distinct().withColumn("matched", F.lit(True)), ["s1", "rec"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    own = Window.partitionBy("s1")
    ranked = marked.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("matched"), F.desc(score), "rec")), "_must": F.sum(F.col("matched").cast("int")).over(own)})
    return ranked.where(F.col("rank") <= F.greatest(F.lit(limit), "_must")).select("s1", "rec", "matched", "rank")


def append_new(known: DataFrame, found: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Rows of found whose key isn't known yet, appended to the cache at path."""
    new = found.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def markdown_table(df: DataFrame, title: str, limit: int = 50) -> str:
    """A report of an aggregate as Markdown (top rows only: it is for people)."""
    rows = df.limit(limit).collect()
    head = f"## {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
