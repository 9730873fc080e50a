"""From scores to matches: exclusive assignment, rule sets, threshold search, rescue rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.ids import source_of
from recordloom.operators.evaluate import entity_f05, per_entity, score_entities
from recordloom.operators.ranking import best_and_lead, cap_groups

GRID = tuple(round(0.20 + 0.025 * i, 3) for i in range(31))


def assign(scored: DataFrame, p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Each record to its best entity, if the score reaches the threshold: (rec, s1, p). Ties go to the least s1."""
    w = Window.partitionBy("rec").orderBy(F.desc(p), "s1")
    return scored.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & (F.col(p) >= threshold)).select("rec", "s1", p)


def threshold_curve(scored: DataFrame, truth: DataFrame, population: DataFrame, p: str = "p", grid: tuple[float, ...] = GRID, fp_weight: float = 1.0) -> DataFrame:
    """(threshold, macro_f05) for every threshold of the grid, in one pass: the grid only multiplies assigned rows."""
    best = assign(scored, p, 0.0).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in grid]))).where(F.col(p) >= F.col("threshold"))
    counts = per_entity(best, truth, population, fp_weight, by=["threshold"])
    # entities without an accepted record at a threshold have no row there: they count by their truth alone
    scored_rows = score_entities(counts)
    silent = score_entities(per_entity(scored.select("rec", "s1").limit(0), truth, population)).select(F.col("s1"), F.col("f05").alias("_silent"))
    total = silent.agg(F.sum("_silent").alias("all"), F.count("*").alias("n"))
    gain = scored_rows.join(silent, "s1").groupBy("threshold").agg(F.sum(F.col("f05") - F.col("_silent")).alias("gain"))
    spark = scored.sparkSession
    rows = spark.createDataFrame([(t,) for t in grid], "threshold double").join(gain, "threshold", "left")
    base = total.first()
    return rows.select("threshold", ((F.lit(float(base["all"] or 0.0)) + F.coalesce("gain", F.lit(0.0))) / max(1, base["n"])).alias("macro_f05"))


def tune_threshold(*args, **kwargs) -> float:
    """The first best threshold; values that only differ by the order of summation are equal."""
    return threshold_curve(*args, **kwargs).orderBy(F.desc(F.round("macro_f05", 12)), "threshold").first()["threshold"]


def labelled(best: DataFrame, truth: DataFrame, fp_weight: float = 1.0) -> DataFrame:
    """best with hit (1.0 or 0.0) and fp (what it counts as a false positive): per_entity's terms, by row."""
    true = truth.where("rec >= 0").select("rec", F.col("s1").alias("_true"))
    hit = F.coalesce(F.col("s1") == F.col("_true"), F.lit(False))
    fp = F.when(hit, 0.0).when(F.col("_true").isNull(), fp_weight).otherwise(1.0)
    return best.join(true, "rec", "left").withColumns({"hit": hit.cast("double"), "fp": fp}).drop("_true")


def _entities(truth: DataFrame, population: DataFrame) -> DataFrame:
    """(s1, n_true) of the population."""
    n = truth.where("rec >= 0").groupBy("s1").agg(F.count("*").alias("n_true"))
    return population.select("s1").distinct().join(n, "s1", "left").fillna(0, ["n_true"])


def event_gains(rows: DataFrame, entities: DataFrame, p: str = "p") -> DataFrame:
    """(p, gain): how much the sum of all entities' F0.5 changes at each score, rows of that score being accepted after all higher ones.

    rows: (s1, p, hit, fp), as of labelled; entities: (s1, n_true) and, where they have accepted rows of other kinds, tp0, fp0. Each
    entity's own scores are its events; F0.5 after an event less F0.5 before it is the event's part of the gain.
    """
    from recordloom.operators.runs import segmented_sums

    have = entities if "tp0" in entities.columns else entities.withColumns({"tp0": F.lit(0.0), "fp0": F.lit(0.0)})
    events = rows.groupBy("s1", F.col(p).alias("p")).agg(F.sum("hit").alias("hit"), F.sum("fp").alias("fp"))
    after = segmented_sums(events, "s1", "p", {"hit": "_tp", "fp": "_fp"}).join(have, "s1")
    f = lambda tp, fp: entity_f05(F.round(tp + F.col("tp0"), 6), F.round(fp + F.col("fp0"), 6), F.col("n_true"))
    gain = f(F.col("_tp"), F.col("_fp")) - f(F.col("_tp") - F.col("hit"), F.col("_fp") - F.col("fp"))
    return after.groupBy("p").agg(F.sum(gain).alias("gain"))


def exact_curve(scored: DataFrame, truth: DataFrame, population: DataFrame, p: str = "p", fp_weight: float = 1.0) -> DataFrame:
    """(threshold, macro_f05) at every distinct score that a record's best entity has: one sweep over all events, no grid."""
    from recordloom.operators.runs import running_sums

    entities = _entities(truth, population)
    rows = labelled(assign(scored, p, 0.0), truth, fp_weight)
    base = entities.agg(F.sum((F.col("n_true") == 0).cast("double")).alias("all"), F.count("*").alias("n")).first()
    curve = running_sums(event_gains(rows, entities, p), "p", {"gain": "_gain"}, descending=True)
    return curve.select(F.col("p").alias("threshold"), ((F.lit(base["all"] or 0.0) + F.col("_gain")) / max(1, base["n"])).alias("macro_f05"))


def search_classes(scored: DataFrame, truth: DataFrame, population: DataFrame, by: tuple[str, ...] = ("src", "a_missing"), start: float = 0.5, rounds: int = 2, p: str = "p", fp_weight: float = 1.0) -> tuple[dict[tuple, float], float]:
    """Thresholds of the classes of `by` (a few: they are listed on the driver) by coordinate search on macro F0.5.

    Each record is with its best entity. In turn, one class's threshold moves while the others' stand: what those accept is
    an entity's state, the class's rows are its events, and one sweep gives macro F0.5 at all their scores. A move has to
    gain more than 1e-6; the highest of equally good scores is taken, and above all of them where accepting none is best (infinity).
    """
    from recordloom.operators.runs import running_sums
    from recordloom.sources.scratch import table

    w = Window.partitionBy("rec").orderBy(F.desc(p), "s1")
    best = scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("rec", "s1", p, *by)
    entities = table(_entities(truth, population), "entities")
    rows = table(labelled(best, truth, fp_weight).join(entities.select("s1"), "s1", "left_semi"), "assigned")
    classes = sorted(tuple(r) for r in rows.select(*by).distinct().collect())
    n, found, now = max(1, entities.count()), dict.fromkeys(classes, start), None
    same = lambda c: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(by, c, strict=True)])
    for _ in range(rounds):
        for own in classes:
            passed = [same(c) & (F.col(p) >= t) for c, t in found.items() if c != own]
            others = rows.where(reduce(lambda a, b: a | b, passed, F.lit(False))).groupBy("s1").agg(F.sum("hit").alias("tp0"), F.sum("fp").alias("fp0"))
            state = table(entities.join(others, "s1", "left").fillna(0.0, ["tp0", "fp0"]), "state")
            base = state.agg(F.sum(entity_f05(F.round("tp0", 6), F.round("fp0", 6), F.col("n_true")))).first()[0] or 0.0
            curve = running_sums(event_gains(rows.where(same(own)), state, p), "p", {"gain": "_gain"}, descending=True)
            curve = table(curve.select("p", F.round((F.lit(base) + F.col("_gain")) / n, 9).alias("value")), "curve")
            here, top = curve.agg(F.min_by("value", F.when(F.col("p") >= found[own], F.col("p"))), F.max(F.struct("value", "p"))).first()
            now = round(base / n, 9) if here is None else here
            tried = [(round(base / n, 9), float("inf")), *([(top["value"], top["p"])] if top else [])]
            value, t = max(tried)
            if value > now + 1e-6:
                now, found[own] = value, t
    return found, now or 0.0


def rule_set(scored: DataFrame, thresholds: DataFrame, fallback: float = 0.5, margin: float = 0.0, cap: int = 6, p: str = "p") -> DataFrame:
    """Threshold by (src, a_missing) -> best of an empty (s1, src) from fallback * threshold -> margin -> exclusive record -> cap."""
    rows = scored.join(F.broadcast(thresholds), ["src", "a_missing"])  # a row per source and flag
    own = Window.partitionBy("s1", "src")
    ranked = rows.withColumns({"_n": F.row_number().over(own.orderBy(F.desc(p), "rec")), "_any": F.max((F.col(p) >= F.col("threshold")).cast("int")).over(own)})
    kept = ranked.where((F.col(p) >= F.col("threshold")) | ((F.col("_any") == 0) & (F.col("_n") == 1) & (F.col(p) >= fallback * F.col("threshold"))))
    top = Window.partitionBy("rec")
    w = top.orderBy(F.desc(p), "s1")
    second = F.coalesce(F.nth_value(p, 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    kept = kept.withColumns({"_k": F.row_number().over(w), "_lead": F.col(p) - second}).where((F.col("_k") == 1) & (F.col("_lead") >= margin))
    return cap_groups(kept, cap, ("s1", "src"), p).select("rec", "s1", "src", p)


def final_rules(scored: DataFrame, base: float = 0.5, margin: float = 0.0, rescue: float = 0.3, caps: dict[int, int] | None = None, p: str = "p") -> DataFrame:
    """Best entity with lead; accepted from the base on; a record just below is rescued where its entity has an accepted
    one from another source, or none at all (then its best only); at last the caps per source."""
    best = best_and_lead(scored, p).withColumn("src", source_of(F.col("rec")))
    sure = best.where((F.col(p) >= base) & (F.col("lead") >= margin))
    sources = sure.groupBy("s1").agg(F.collect_set("src").alias("_sources"))
    near = best.join(sure.select("rec"), "rec", "left_anti").where(F.col(p) >= rescue).join(sources, "s1", "left")
    cross = near.where(F.col("_sources").isNotNull() & (F.size(F.array_except("_sources", F.array("src"))) > 0))
    empty = cap_groups(near.where(F.col("_sources").isNull()), 1, ("s1",), p)
    kept = reduce(DataFrame.unionByName, [d.select("rec", "s1", "src", p) for d in (sure, cross, empty)])
    limit = reduce(lambda out, kv: out.when(F.col("src") == kv[0], F.lit(kv[1])), (caps or {2: 5, 3: 6}).items(), F.when(F.lit(False), 0)).otherwise(6)
    return cap_groups(kept, limit, ("s1", "src"), p)


def decoy_ratio(train: DataFrame, test: DataFrame) -> float:
    """How much denser unmatched records are, from records per entity; between 1 and 3."""
    per = lambda d: (lambda r: (r["n"] or 0) / max(1, r["s"] or 0))(d.agg(F.sum((F.col("src") > 1).cast("long")).alias("n"), F.sum((F.col("src") == 1).cast("long")).alias("s")).first())
    a = per(train)
    return min(3.0, max(1.0, per(test) / a)) if a else 1.0


def gray_zone(scored: DataFrame, accepted: DataFrame, threshold: float, share: float = 0.8, p: str = "p") -> DataFrame:
    """Pairs just under the threshold whose record is still free and for which the entity is the best claimant."""
    best = assign(scored, p, share * threshold).where(F.col(p) < threshold)
    return best.join(accepted.select("rec").distinct(), "rec", "left_anti")


def gated_judgement(accepted: DataFrame, gray: DataFrame, verdicts: DataFrame, truth: DataFrame, population: DataFrame) -> DataFrame:
    """The judge's additions only if macro F0.5 doesn't fall with them, on a population with truth."""
    from recordloom.operators.evaluate import macro_f05

    told = apply_judgement(accepted, gray, verdicts)
    value = lambda d: macro_f05(d, truth, population).first()["macro_f05"] or 0.0
    return told if value(told) >= value(accepted) else accepted


def apply_judgement(accepted: DataFrame, gray: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Accepted pairs and the gray pairs that a judge (any source of (rec, s1, verdict)) confirmed."""
    yes = gray.join(verdicts.where("verdict").select("rec", "s1"), ["rec", "s1"], "left_semi")
    return accepted.unionByName(yes.select(*accepted.columns))
