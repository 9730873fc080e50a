"""Exploration of true pairs and hard negatives: simple normalisers, comparison features, records that share an exact key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.similarity import SCORERS
from recordloom.functions.text import fold_ascii, nfkc, squeeze


def folded(value: Column) -> Column:
    """Lower case without accents, spaces squeezed."""
    return squeeze(F.lower(fold_ascii(nfkc(F.coalesce(value, F.lit(""))))))


def alphanumeric(value: Column) -> Column:
    return squeeze(F.regexp_replace(folded(value), r"[^\p{L}\p{N}_\s]", " "))


def latin(value: Column) -> Column:
    """Only ASCII letters and digits, a space for all else."""
    return squeeze(F.regexp_replace(folded(value), "[^a-z0-9]+", " "))


def with_views(records: DataFrame) -> DataFrame:
    """name_basic, name_latin, addr_basic, addr_latin."""
    return records.withColumns({f"{c}_{k}": f(F.col(c)) for c in ("name", "addr") for k, f in (("basic", folded), ("latin", latin))})


def comparison_features(pairs: DataFrame) -> DataFrame:
    """17 comparisons of pairs whose sides a_* and b_* have the views and country."""
    out = {}
    for c, short in (("name", "name"), ("addr", "address")):
        x, y = F.col(f"a_{c}_latin"), F.col(f"b_{c}_latin")
        same = lambda k: F.coalesce((F.col(f"a_{c}_{k}") != "") & (F.col(f"a_{c}_{k}") == F.col(f"b_{c}_{k}")), F.lit(False)).cast("int")  # noqa: E731, B023
        for name, scorer in (("ratio", "ratio"), ("wratio", "weighted_ratio"), ("token_sort", "token_sort_ratio"), ("token_set", "token_set_ratio")):
            out[f"{short}_{name}"] = SCORERS[scorer](x, y)
        out[f"{short}_exact_translit"], out[f"{short}_basic_exact"] = same("latin"), same("basic")
        out[f"{short}_length_ratio"] = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y), F.lit(1))
        m, n = (F.array_distinct(F.regexp_extract_all(v, F.lit(r"\d+"), 0)) for v in (x, y))
        out[f"{short}_numeric_overlap"] = F.size(F.array_intersect(m, n)) / F.greatest(F.size(F.array_union(m, n)), F.lit(1))
    a, b = F.lower(F.trim("a_country")), F.lower(F.trim("b_country"))
    out["country_exact"] = F.coalesce((a != "") & (a == b), F.lit(False)).cast("int")
    return pairs.withColumns(out)


def hard_negatives(s1: DataFrame, rec: DataFrame, truth: DataFrame, max_group: int | None = 500) -> DataFrame:
    """(s1, rec) that share one of the four views exactly and aren't true pairs. Keys that more than max_group records on
    a side have are left out, so no key makes a square of pairs; with None every key counts."""
    def by(view: str) -> DataFrame:
        side = lambda d, name: (lambda k: k.join(k.groupBy("key").agg(F.count("*").alias("_n")).where(F.lit(True) if max_group is None else F.col("_n") <= max_group).drop("_n"), "key"))(d.select(F.col("id").alias(name), F.col(view).alias("key")).where("key <> ''"))
        return side(s1, "s1").join(side(rec, "rec"), "key").select("s1", "rec")

    hits = reduce(DataFrame.union, [by(v) for v in ("name_basic", "name_latin", "addr_basic", "addr_latin")]).distinct()
    return hits.join(truth.where("rec >= 0").select("s1", "rec"), ["s1", "rec"], "left_anti")
