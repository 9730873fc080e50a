"""Evaluation: per-entity counts, macro F-beta, pair precision and recall, curves, confusion with margins, recall of blocking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.when(precision + recall > 0, (1 + b) * precision * recall / (b * precision + recall)).otherwise(0.0)


def per_entity(pred: DataFrame, truth: DataFrame, population: DataFrame, fp_weight: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """(s1, n_true, tp, fp) over the population. fp_weight raises false positives of records that nobody claims.

    With `by`, counts are per s1 and those columns, and only for entities that have a prediction there.
    """
    by = by or []
    people = population.select("s1").distinct()
    true = truth.where("rec >= 0").select("rec", F.col("s1").alias("_true"))
    n_true = true.groupBy(F.col("_true").alias("s1")).agg(F.count("*").alias("n_true"))
    rows = pred.select("rec", "s1", *by).join(true, "rec", "left")
    hit = F.coalesce(F.col("s1") == F.col("_true"), F.lit(False))
    fp = F.when(hit, 0.0).when(F.col("_true").isNull(), fp_weight).otherwise(1.0)
    counts = rows.groupBy("s1", *by).agg(F.sum(hit.cast("long")).alias("tp"), F.sum(fp).alias("fp"))
    out = people.join(counts, "s1", "inner" if by else "left").join(n_true, "s1", "left")
    return out.fillna(0, ["tp", "n_true"]).fillna(0.0, ["fp"])


def entity_f05(tp: Column, fp: Column, n_true: Column) -> Column:
    """An entity without truth scores 1 when nothing is predicted, else 0."""
    predicted = tp + fp
    f = f_beta(tp / F.nullif(predicted, F.lit(0)), tp / F.nullif(n_true, F.lit(0)))
    return F.when(n_true == 0, (predicted == 0).cast("double")).when(predicted == 0, 0.0).otherwise(f)


def score_entities(counts: DataFrame) -> DataFrame:
    """f05 of each entity."""
    return counts.withColumn("f05", entity_f05(F.col("tp"), F.col("fp"), F.col("n_true")))


def macro_f05(pred: DataFrame, truth: DataFrame, population: DataFrame, fp_weight: float = 1.0) -> DataFrame:
    """One row: macro_f05, pair_p, pair_r, n_s1, singleton_acc."""
    rows = score_entities(per_entity(pred, truth, population, fp_weight))
    return rows.agg(
        F.avg("f05").alias("macro_f05"), (F.sum("tp") / F.greatest(F.sum(F.col("tp") + F.col("fp")), F.lit(1.0))).alias("pair_p"), (F.sum("tp") / F.greatest(F.sum("n_true"), F.lit(1))).alias("pair_r"),
        F.count("*").alias("n_s1"), F.avg(F.when(F.col("n_true") == 0, F.col("f05"))).alias("singleton_acc"),
    )


def attach_labels(pairs: DataFrame, truth: DataFrame, folds: int = 3, holdout: float = 0.1) -> DataFrame:
    """true_s1, y, grp (the true entity, else the record), ho, fold."""
    from recordloom.functions.ids import fold, is_holdout

    true = truth.where("rec >= 0").select("rec", F.col("s1").alias("true_s1"))
    out = pairs.join(true, "rec", "left")
    out = out.withColumns({"y": F.coalesce(F.col("s1") == F.col("true_s1"), F.lit(False)).cast("int"), "grp": F.coalesce("true_s1", "rec")})
    return out.withColumns({"ho": is_holdout(F.col("grp"), holdout), "fold": fold(F.col("grp"), folds)})


def confusion(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """tp, fp, fn, tn and n for every combination of `by` with all margins (a cube; null means all)."""
    hit, true = F.col("keep"), F.col("is_true")
    count = lambda c: F.sum(c.cast("long"))
    return pairs.cube(*by).agg(F.grouping_id().cast("int").alias("level"), count(hit & true).alias("tp"), count(hit & ~true).alias("fp"), count(~hit & true).alias("fn"), count(~hit & ~true).alias("tn"), F.count("*").alias("n"))


def outcome_pivot(outcomes: DataFrame, values: list[str]) -> DataFrame:
    """Counts of each outcome per entity, as columns."""
    return outcomes.groupBy("s1").pivot("outcome", values).count().fillna(0)


def grouped_metrics(rows: DataFrame, slices: list[str], value: str) -> DataFrame:
    """Mean and count of a value for each slice column apart (grouping sets): slice, key, n, mean."""
    names = ", ".join(slices)
    sets = ", ".join(f"({s})" for s in slices)
    rows.createOrReplaceTempView("_grouped_metrics")
    labels = " ".join(f"WHEN grouping({s}) = 0 THEN '{s}'" for s in slices)
    keys = ", ".join(f"CAST({s} AS STRING)" for s in slices)
    return rows.sparkSession.sql(f"SELECT CASE {labels} END AS slice, coalesce({keys}) AS key, count(*) AS n, avg({value}) AS mean FROM _grouped_metrics GROUP BY {names} GROUPING SETS ({sets})")


def precision_recall_curve(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(p, tp, fp, precision, recall) at each distinct score, from the top down; running sums go over range partitions."""
    from recordloom.operators.runs import running_sums

    by = scored.groupBy(F.col(p).alias("p")).agg(F.sum(y).cast("long").alias("pos"), F.count("*").alias("n"))
    rows = running_sums(by, "p", {"pos": "tp", "n": "_n"}, descending=True)
    every = scored.agg(F.sum(y).cast("long").alias("n")).first()["n"] or 0
    out = rows.withColumn("fp", F.col("_n") - F.col("tp"))
    return out.select("p", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), (F.col("tp") / F.col("_n")).alias("precision"), (F.col("tp") / F.lit(max(1, every))).alias("recall"))


def best_threshold(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One row: the score from which accepting gives the best F0.5 (the highest on ties), and that F0.5."""
    c = precision_recall_curve(scored, p, y).withColumn("f05", f_beta(F.col("precision"), F.col("recall")))
    return c.agg(F.max_by("p", F.struct(F.round("f05", 12), "p")).alias("threshold"), F.max("f05").alias("f05"))


def ranking_quality(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """roc_auc (ties count half), brier, average_precision over distinct scores."""
    by = scored.groupBy(F.col(p).alias("p")).agg(F.sum(y).cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    from recordloom.operators.runs import running_sums

    rows = running_sums(by, "p", {"pos": "above_pos", "n": "above_n"}, descending=True)
    neg = F.col("n") - F.col("pos")
    totals = rows.agg(F.sum("pos").alias("P"), F.sum(neg).alias("N")).first()
    big_p, big_n = totals["P"] or 0.0, totals["N"] or 0.0
    above = F.col("above_pos") - F.col("pos")  # positives strictly above
    auc = F.sum(neg * (above + F.col("pos") / 2)) / F.lit(max(1.0, big_p * big_n))
    ap = F.sum(F.col("pos") / F.lit(max(1.0, big_p)) * F.col("above_pos") / F.col("above_n"))
    brier = F.sum(F.col("pos") * (1 - F.col("p")) ** 2 + neg * F.col("p") ** 2) / F.lit(max(1.0, big_p + big_n))
    return rows.agg(auc.alias("roc_auc"), ap.alias("average_precision"), brier.alias("brier"))


def blocking_recall(pairs: DataFrame, truth: DataFrame, ranks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Share of true pairs among candidates, at each rank, candidates per record, entities fully and partly found."""
    true = truth.where("rec >= 0").select("rec", "s1")
    found = true.join(pairs.select("rec", "s1", "rank"), ["rec", "s1"], "left")
    per = found.groupBy("s1").agg(F.count("*").alias("n"), F.count("rank").alias("hit"), *[F.sum((F.col("rank") <= k).cast("long")).alias(f"at_{k}") for k in ranks])
    return per.agg((F.sum("hit") / F.sum("n")).alias("recall"), *[(F.coalesce(F.sum(f"at_{k}"), F.lit(0)) / F.sum("n")).alias(f"recall_at_{k}") for k in ranks], F.avg((F.col("hit") == F.col("n")).cast("double")).alias("all_found"), F.avg((F.col("hit") > 0).cast("double")).alias("any_found"))


def family_shares(pairs: DataFrame, truth: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(family, hits, share): of the true pairs among the candidates, those that each key family found."""
    true = pairs.join(truth.where("rec >= 0").select(F.col("rec").alias("cand"), "s1"), ["cand", "s1"], "left_semi")
    sums = true.agg(F.count("*").alias("_n"), *[F.sum(c.cast("long")).alias(k) for k, c in kinds.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("family"), F.coalesce(k, F.lit(0)).alias("hits")) for k in kinds])
    return sums.select(F.explode(rows).alias("f"), "_n").select("f.family", "f.hits", (F.col("f.hits") / F.greatest("_n", F.lit(1))).alias("share"))


def reduction_ratio(pairs: DataFrame, s1: DataFrame, rec: DataFrame, count: Column | None = None) -> DataFrame:
    """(country, pairs, per_s1, reduction): how many of a country's possible pairs blocking leaves out. count: the pairs of a group of
    rows, where they aren't a row each."""
    a = s1.groupBy("country").agg(F.count("*").alias("_a"))
    b = rec.groupBy("country").agg(F.count("*").alias("_b"))
    own = pairs.groupBy("s1").agg((F.count("*") if count is None else count).alias("_p"))  # a row per entity, not per pair, meets the countries
    n = own.join(s1.select(F.col("id").alias("s1"), "country"), "s1").groupBy("country").agg(F.sum("_p").alias("pairs"))
    out = a.join(b, "country", "left").join(n, "country", "left").fillna(0, ["_b", "pairs"])
    return out.select("country", "pairs", (F.col("pairs") / F.col("_a")).alias("per_s1"), (1 - F.col("pairs") / F.greatest(F.col("_a") * F.col("_b"), F.lit(1))).alias("reduction"))


def loss_parts(counts: DataFrame) -> DataFrame:
    """What macro F0.5 would be without false positives, and with all misses found: (now, no_fp, no_fn)."""
    now = score_entities(counts)
    no_fp = score_entities(counts.withColumn("fp", F.lit(0.0))).agg(F.avg("f05").alias("no_fp")).first()["no_fp"]
    no_fn = score_entities(counts.withColumn("tp", F.col("n_true"))).agg(F.avg("f05").alias("no_fn")).first()["no_fn"]
    return now.agg(F.avg("f05").alias("now")).withColumns({"no_fp": F.lit(no_fp), "no_fn": F.lit(no_fn)})


def holdout_report(scored: DataFrame, truth: DataFrame, p: str = "p2", weights: tuple[float, ...] = (1.0, 2.0), threshold: float | None = None) -> DataFrame:
    """(fp_weight, threshold, part, macro_f05, pair_p, pair_r, n_s1, singleton_acc, macro_f05_weighted): quality on the locked
    holdout and on the rest, whose entities are those of the truth, with or without candidates. For each weight of false positives the threshold is tuned on the
    rest, unless one is given; both parts are then judged at weight 1 and at that weight."""
    from recordloom.functions.ids import is_holdout
    from recordloom.operators.decide import assign, tune_threshold

    people = truth.select("s1").distinct().withColumn("_ho", is_holdout(F.col("s1")))
    parts = {"holdout": people.where("_ho").select("s1"), "rest": people.where("NOT _ho").select("s1")}
    rows = []
    for weight in weights:
        cut = threshold if threshold is not None else tune_threshold(scored.where("NOT ho"), truth, parts["rest"], p, fp_weight=weight)
        kept = assign(scored, p, cut)
        for name, population in parts.items():
            weighted = macro_f05(kept, truth, population, weight).first()["macro_f05"]
            own = macro_f05(kept, truth, population).withColumn("macro_f05_weighted", F.lit(weighted).cast("double"))
            rows.append(own.select(F.lit(float(weight)).alias("fp_weight"), F.lit(float(cut)).alias("threshold"), F.lit(name).alias("part"), "*"))
    return reduce(DataFrame.union, rows)
