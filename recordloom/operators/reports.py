"""Analyses over whole results: exact-key recall, effect of a normalisation, failures by kind, country sanity, readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.similarity import jaccard
from recordloom.functions.text import words


def exact_key_recall(s1: DataFrame, rec: DataFrame, truth: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """For each key: share of true pairs with the same key, and median, 95th percentile and maximum of the reference
    records that a record's key meets. Fan-out comes from group sizes; pairs are never listed."""
    true = truth.where("rec >= 0").select("rec", "s1")

    def one(name: str, key: Column) -> DataFrame:
        a = s1.select(F.col("id").alias("s1"), key.alias("ka")).where("ka <> ''")
        b = rec.select(F.col("id").alias("rec"), key.alias("kb")).where("kb <> ''")
        hit = true.join(a, "s1", "left").join(b, "rec", "left").agg(F.avg(F.coalesce(F.col("ka") == F.col("kb"), F.lit(False)).cast("double")).alias("recall"))
        size = a.groupBy(F.col("ka").alias("kb")).agg(F.count("*").alias("n"))
        met = rec.select(F.col("id").alias("rec"), key.alias("kb")).join(size, "kb", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
        fan = met.agg(F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.95)).alias("p95"), F.max("n").alias("largest"))
        h = hit.first()
        return fan.select(F.lit(name).alias("key"), F.lit(h["recall"]).alias("recall"), "median", "p95", "largest")

    return reduce(DataFrame.unionByName, [one(k, v) for k, v in keys.items()])


def combined_key_recall(s1: DataFrame, rec: DataFrame, truth: DataFrame, setups: dict[str, tuple[str, ...]]) -> DataFrame:
    """For each set-up (a name and columns that both sides have): share of true pairs that agree in any of the columns, and median,
    95th percentile and maximum of the reference records that a record meets through any of them.

    A union's size is the sum over combinations of columns, taken with alternating signs, of how many reference records agree
    in all of them: group sizes that meet by key, so no pair is listed. Empty keys meet nothing.
    """
    true = truth.where("rec >= 0").select("rec", "s1")
    some = lambda c: F.nullif(F.col(c), F.lit(""))

    def one(name: str, columns: tuple[str, ...]) -> DataFrame:
        a, b = (d.select("id", *[some(c).alias(c) for c in columns]) for d in (s1, rec))
        sides = true.join(a.toDF("s1", *[f"_a{i}" for i in range(len(columns))]), "s1", "left").join(b.toDF("rec", *[f"_b{i}" for i in range(len(columns))]), "rec", "left")
        same = reduce(lambda x, y: x | y, [F.coalesce(F.col(f"_a{i}") == F.col(f"_b{i}"), F.lit(False)) for i in range(len(columns))])
        met, total = b, F.lit(0)
        for k in range(1, 1 << len(columns)):
            own = [c for i, c in enumerate(columns) if k >> i & 1]
            sizes = a.dropna(subset=own).groupBy(*own).agg(F.count("*").alias(f"_n{k}"))
            met = met.join(sizes, own, "left")
            total = total + F.coalesce(f"_n{k}", F.lit(0)) * (1 if len(own) % 2 else -1)
        n = met.select(total.alias("n"))
        fan = n.agg(F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.95)).alias("p95"), F.max("n").alias("largest"))
        return fan.select(F.lit(name).alias("setup"), F.lit(sides.agg(F.avg(same.cast("double"))).first()[0]).cast("double").alias("recall"), "median", "p95", "largest")

    return reduce(DataFrame.unionByName, [one(k, v) for k, v in setups.items()])


OUTCOMES = ("missed_by_blocking", "removed_by_pruning", "rejected_by_model")


def lineage(truth: DataFrame, blocked: DataFrame, pruned: DataFrame, accepted: DataFrame) -> DataFrame:
    """(rec, s1, outcome, winner): what became of each true pair: TP, or the stage that lost it; winner is the entity that has the
    record now, if any. blocked, pruned and accepted are (rec, s1) tables."""
    true = truth.where("rec >= 0").select("rec", "s1")
    mark = lambda d, name: d.select("rec", "s1", F.lit(True).alias(name)).distinct()
    rows = true.join(mark(blocked, "_b"), ["rec", "s1"], "left").join(mark(pruned, "_p"), ["rec", "s1"], "left").join(accepted.select("rec", F.col("s1").alias("winner")), "rec", "left")
    lost = F.when(F.col("_b").isNull(), OUTCOMES[0]).when(F.col("_p").isNull(), OUTCOMES[1]).otherwise(OUTCOMES[2])
    return rows.select("rec", "s1", F.when(F.col("winner") == F.col("s1"), "TP").otherwise(lost).alias("outcome"), "winner")


def loss_by_cause(lineage_rows: DataFrame, accepted: DataFrame, population: DataFrame) -> DataFrame:
    """(scenario, macro_f05, gain): macro F0.5 as it is, and if one loss alone were mended: each stage's, all false positives,
    predictions for entities without a match, everything. One aggregation over entities."""
    from recordloom.operators.evaluate import entity_f05

    count = lambda c: F.sum(c.cast("long"))
    per = lineage_rows.groupBy("s1").agg(F.count("*").alias("nt"), count(F.col("outcome") == "TP").alias("tp"), *[count(F.col("outcome") == k).alias(k) for k in OUTCOMES])
    wrong = accepted.select("rec", "s1").join(lineage_rows.select("rec", "s1"), ["rec", "s1"], "left_anti").groupBy("s1").agg(F.count("*").alias("fp"))
    rows = population.select("s1").distinct().join(per, "s1", "left").join(wrong, "s1", "left").fillna(0)
    nt, tp, fp = F.col("nt"), F.col("tp"), F.col("fp")
    scenarios = {
        "actual": (tp, fp), "fix blocking misses": (tp + F.col(OUTCOMES[0]), fp), "fix pruning losses": (tp + F.col(OUTCOMES[1]), fp), "fix model rejections": (tp + F.col(OUTCOMES[2]), fp),
        "remove all false positives": (tp, F.lit(0)), "empty prediction for singletons": (tp, F.when(nt > 0, fp).otherwise(0)), "perfect": (nt, F.lit(0)),
    }
    means = rows.agg(*[F.avg(entity_f05(a.cast("double"), b.cast("double"), nt)).alias(k) for k, (a, b) in scenarios.items()])
    listed = means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.col(f"`{k}`").alias("macro_f05"), (F.col(f"`{k}`") - F.col("actual")).alias("gain")) for k in scenarios])).alias("r"))
    return listed.select("r.*")


def normalisation_effect(pairs: DataFrame, before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """Mean token Jaccard of pairs before and after, and how many gained and lost."""
    j = lambda c: jaccard(words(F.col(c[0])), words(F.col(c[1])))
    rows = pairs.select(j(before).alias("x"), j(after).alias("y"))
    return rows.agg(F.count("*").alias("n"), F.avg("x").alias("before"), F.avg("y").alias("after"), F.sum((F.col("y") > F.col("x")).cast("long")).alias("gained"), F.sum((F.col("y") < F.col("x")).cast("long")).alias("lost"))


def failures(scored: DataFrame, accepted: DataFrame, truth: DataFrame, p: str = "p", threshold: float = 0.5) -> DataFrame:
    """What became of each true pair: found, not a candidate, below the threshold, lost to another entity; and each false one."""
    true = truth.where("rec >= 0").select("rec", "s1")
    won = accepted.select("rec", F.col("s1").alias("_won"))
    rows = true.join(scored.select("rec", "s1", F.col(p).alias("_p")), ["rec", "s1"], "left").join(won, "rec", "left")
    kind = F.when(F.col("_won") == F.col("s1"), "found").when(F.col("_p").isNull(), "not a candidate").when(F.col("_won").isNotNull(), "lost to another entity").when(F.col("_p") < threshold, "below the threshold").otherwise("not the best")
    wrong = accepted.select("rec", "s1").join(true, ["rec", "s1"], "left_anti").join(true.select("rec", F.col("s1").alias("_t")), "rec", "left")
    extra = wrong.select(F.when(F.col("_t").isNull(), "accepted a decoy").otherwise("accepted another's record").alias("outcome"))
    return rows.select(kind.alias("outcome")).unionAll(extra).groupBy("outcome").agg(F.count("*").alias("n"))


def failure_patterns() -> Column:
    """Labels of what makes a pair hard, the weightiest first, from a_core, b_core (canonical names), a_atok and b_atok."""
    from recordloom.functions.similarity import SCORERS
    from recordloom.operators.profile import pattern_labels

    a, b = F.col("a_core"), F.col("b_core")
    wa, wb = words(a), words(b)
    alike, shared = F.when((a != "") & (b != ""), SCORERS["token_set_ratio"](a, b)).otherwise(0.0), jaccard(words(F.col("a_atok")), words(F.col("b_atok")))
    glue = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    labels = pattern_labels({
        "same name": a == b, "words glued": (a != "") & (glue(a) == glue(b)) & (F.size(wa) >= 2) & (F.size(wb) < F.size(wa)), "digits inside words": b.rlike(r"\b(?:[a-z]+\d+[a-z]+|\d+[a-z]+\d+)"),
        "part of the name": (alike >= 50) & (alike < 90), "another name": alike < 30, "same address": shared >= 0.5, "no address": F.size(words(F.col("b_atok"))) == 0, "nothing in common": (alike < 30) & (shared < 0.3),
    })
    return F.when(b == "", F.array(F.lit("no name"))).otherwise(labels)


def shift_checks(train: DataFrame, test: DataFrame, accepted: DataFrame) -> DataFrame:
    """(check, value) of results on other data than the models have seen: countries of test that train lacks, and the records in
    them; accepted pairs whose sides are of different countries; entities with a match, and records with an entity, as shares."""
    known = train.select("country").distinct()
    new = test.where(F.col("country").isNotNull()).join(known, "country", "left_anti")
    unseen = new.agg(F.countDistinct("country").cast("double").alias("unseen countries"), F.count("*").cast("double").alias("records in them"))
    side = lambda key, name: test.select(F.col("id").alias(key), F.col("country").alias(name))
    pairs = accepted.select("rec", "s1").join(side("s1", "_a"), "s1").join(side("rec", "_b"), "rec")
    cross = pairs.agg(F.avg((~F.col("_a").eqNullSafe(F.col("_b"))).cast("double")).alias("cross-country pairs"))
    marked = test.select("id", "src").join(accepted.select(F.col("s1").alias("id")).union(accepted.select(F.col("rec").alias("id"))).distinct().withColumn("_m", F.lit(1.0)), "id", "left").fillna(0.0, ["_m"])
    rates = marked.agg(F.avg(F.when(F.col("src") == 1, F.col("_m"))).alias("matched entities"), F.avg(F.when(F.col("src") > 1, F.col("_m"))).alias("claimed records"))
    listed = lambda d: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("value")) for c in d.columns])).alias("r")).select("r.*")
    return reduce(DataFrame.unionByName, [listed(unseen), listed(cross), listed(rates)])


def country_sanity(s1: DataFrame, accepted: DataFrame, rec: DataFrame) -> DataFrame:
    """Per country: matches per entity, share of entities without any, share of records claimed."""
    n = accepted.groupBy("s1").agg(F.count("*").alias("n"))
    a = s1.select(F.col("id").alias("s1"), "country").join(n, "s1", "left").groupBy("country").agg(F.avg(F.coalesce("n", F.lit(0))).alias("matches"), F.avg(F.col("n").isNull().cast("double")).alias("empty"))
    b = rec.select(F.col("id").alias("rec"), "country").join(accepted.select("rec", F.lit(1).alias("_c")), "rec", "left").groupBy("country").agg(F.avg(F.col("_c").isNotNull().cast("double")).alias("claimed"))
    return a.join(b, "country", "full_outer")


def readiness(profile: DataFrame, limits: dict[str, float]) -> DataFrame:
    """check, value, limit, ok: shares of a one-row profile against upper limits."""
    rows = [F.struct(F.lit(k).alias("check"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("limit"), (F.col(k) <= v).alias("ok")) for k, v in limits.items()]
    return profile.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
