"""Queries of thresholds and decisions over records of two sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import decide, evaluate, ranking, reports
from recordloom.plans.catalog import _BEST, _split, query, short

#: A second source: a record of its own for every scored one, its scores moved a little, its addresses missing elsewhere.
_SECOND = "SELECT rec + 10000000000 AS rec, s1, 3 AS src, (rec + s1) % 4 = 0 AS a_missing, p * 0.85 + (s1 * 31 + rec * 17) % 100 / 1000.0 AS p FROM scored WHERE rec % 3 > 0"
_BOTH = f"both_ AS (SELECT rec, s1, src::INT AS src, a_missing, round(p, 6)::DOUBLE AS p FROM (SELECT rec, s1, src, a_missing, p FROM scored UNION ALL {_SECOND}))"
_TRUE = "tr AS (SELECT s1, rec FROM truth WHERE rec >= 0 UNION ALL SELECT s1, rec + 10000000000 FROM truth WHERE rec >= 0 AND rec % 3 > 0)"
_F05 = "CASE WHEN nt = 0 THEN (tp + fp = 0)::INT::DOUBLE WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / (tp + fp)) * (tp / nt) / (0.25 * (tp / (tp + fp)) + tp / nt) END"


def _both(t):
    """(scored pairs of both sources, truth, population)."""
    rec, s1 = F.col("rec"), F.col("s1")
    second = t.scored.where(rec % 3 > 0).select((rec + 10_000_000_000).alias("rec"), "s1", F.lit(3).alias("src"), ((rec + s1) % 4 == 0).alias("a_missing"), (F.col("p") * 0.85 + (s1 * 31 + rec * 17) % 100 / 1000.0).alias("p"))
    both = t.scored.select("rec", "s1", "src", "a_missing", "p").unionByName(second).withColumn("p", F.round("p", 6))
    more = t.truth.where("rec >= 0 AND rec % 3 > 0").select("s1", (rec + 10_000_000_000).alias("rec"))
    return both, t.truth.select("s1", "rec").unionByName(more), t.s1.select(F.col("id").alias("s1"))


@query(f""", {_BEST}, tr AS (SELECT s1, rec FROM truth WHERE rec >= 0), l AS (SELECT b.s1, p, coalesce(b.s1 = tr.s1, false)::INT AS hit FROM best b LEFT JOIN tr USING (rec)),
g AS (SELECT DISTINCT p AS threshold FROM l), c AS (SELECT threshold, l.s1, sum(hit) AS tp, sum(CASE WHEN hit = 1 THEN 0.0 ELSE 1.0 END) AS fp FROM g JOIN l ON p >= threshold GROUP BY threshold, l.s1),
n AS (SELECT s1, count(*) AS nt FROM tr GROUP BY s1), e AS (SELECT id AS s1, coalesce(nt, 0) AS nt FROM s1 LEFT JOIN n ON n.s1 = s1.id), silent AS (SELECT sum((nt = 0)::INT) AS f, count(*) AS n FROM e),
d AS (SELECT threshold, sum({_F05} - (nt = 0)::INT) AS gain FROM c JOIN e USING (s1) GROUP BY threshold)
SELECT threshold, round((f + gain) / n, 9) AS macro_f05 FROM d, silent""")
def exact_threshold_curve(t):
    """Macro F0.5 at every score, where threshold_curve has a grid."""
    return decide.exact_curve(t.scored, t.truth, t.s1.select(F.col("id").alias("s1"))).withColumn("macro_f05", short("macro_f05"))


_CLASSES = ((2, False), (2, True), (3, False), (3, True))


def _search_sql(rounds: int = 2) -> str:
    """Coordinate search by brute force: macro F0.5 of every score of a class, the other thresholds as they stand."""
    steps, state = [], "t0"
    of = lambda s, a: f"(src = {s} AND a_missing = {str(a).lower()})"
    steps.append("t0 AS (" + " UNION ALL ".join(f"SELECT {s} AS src, {str(a).lower()} AS a_missing, 0.5::DOUBLE AS t" for s, a in _CLASSES) + ")")
    steps.append("rows_ AS (SELECT b.s1, src, a_missing, p, coalesce(b.s1 = tr.s1, false)::INT AS hit, CASE WHEN tr.s1 IS NULL THEN 2.0 WHEN b.s1 = tr.s1 THEN 0.0 ELSE 1.0 END AS wrong FROM (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY rec ORDER BY p DESC, s1) = 1) b LEFT JOIN tr USING (rec))")
    steps.append("ent AS (SELECT id AS s1, coalesce(nt, 0) AS nt FROM s1 LEFT JOIN (SELECT s1, count(*) AS nt FROM tr GROUP BY s1) n ON n.s1 = s1.id)")
    k = 0
    for _ in range(rounds):
        for s, a in _CLASSES:
            k += 1
            steps.append(f"o{k} AS (SELECT ent.s1, nt, coalesce(tp0, 0) AS tp0, coalesce(fp0, 0.0) AS fp0 FROM ent LEFT JOIN (SELECT s1, sum(hit) AS tp0, sum(wrong) AS fp0 FROM rows_ r JOIN {state} USING (src, a_missing) WHERE NOT {of(s, a)} AND p >= t GROUP BY s1) x USING (s1))")
            steps.append(f"q{k} AS (SELECT DISTINCT p AS t FROM rows_ WHERE {of(s, a)} UNION SELECT t FROM {state} WHERE {of(s, a)} UNION SELECT 'infinity'::DOUBLE)")
            steps.append(f"c{k} AS (SELECT t, s1, sum(hit) AS tp1, sum(wrong) AS fp1 FROM q{k} JOIN rows_ ON {of(s, a)} AND p >= t GROUP BY t, s1)")
            steps.append(f"b{k} AS (SELECT sum({_F05}) AS f, count(*) AS n FROM (SELECT nt, tp0 AS tp, fp0 AS fp FROM o{k}))")
            steps.append(f"g{k} AS (SELECT t, sum({_F05} - f0) AS gain FROM (SELECT t, nt, tp0 + tp1 AS tp, fp0 + fp1 AS fp, f0 FROM c{k} JOIN (SELECT *, {_F05} AS f0 FROM (SELECT s1, nt, tp0, fp0, tp0 AS tp, fp0 AS fp FROM o{k})) USING (s1)) GROUP BY t)")
            steps.append(f"v{k} AS (SELECT t, round((f + coalesce(gain, 0)) / n, 9) AS value FROM q{k} LEFT JOIN g{k} USING (t), b{k})")
            steps.append(f"m{k} AS (SELECT t, value FROM v{k} ORDER BY value DESC, t DESC LIMIT 1)")
            steps.append(f"t{k} AS (SELECT src, a_missing, CASE WHEN {of(s, a)} AND m{k}.value > (SELECT value FROM v{k} WHERE v{k}.t = {state}.t) + 1e-6 THEN m{k}.t ELSE {state}.t END AS t FROM {state}, m{k})")
            state = f"t{k}"
    return ", ".join(steps).replace("\n", " ") + f" SELECT src, a_missing, t AS threshold, (SELECT value FROM v{k} WHERE v{k}.t = (SELECT t FROM {state} WHERE {of(*_CLASSES[-1])})) AS macro_f05 FROM {state}"


@query(f", {_BOTH}, {_TRUE}, {_search_sql()}")
def class_thresholds(t):
    """Thresholds by source and missing address, by sweeps over all scores, false positives of free records counted twice."""
    both, truth, people = _both(t)
    found, value = decide.search_classes(both, truth, people, fp_weight=2.0)
    return t.spark.createDataFrame([(s, a, float(x), float(value)) for (s, a), x in found.items()], "src int, a_missing boolean, threshold double, macro_f05 double")


@query(f""", {_BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY p DESC, s1) AS k, p - coalesce(lead(p) OVER (PARTITION BY rec ORDER BY p DESC, s1), 0.0) AS lead_ FROM both_), b AS (SELECT * FROM r WHERE k = 1),
sure AS (SELECT * FROM b WHERE p >= 0.6 AND lead_ >= 0.01), near AS (SELECT b.* FROM b ANTI JOIN sure USING (rec) WHERE b.p >= 0.3),
cross_ AS (SELECT near.* FROM near WHERE EXISTS (SELECT 1 FROM sure WHERE sure.s1 = near.s1 AND sure.src <> near.src)),
empty_ AS (SELECT near.* FROM near ANTI JOIN sure USING (s1) QUALIFY row_number() OVER (PARTITION BY near.s1 ORDER BY near.p DESC, near.rec) = 1),
u AS (SELECT * FROM sure UNION ALL SELECT * FROM cross_ UNION ALL SELECT * FROM empty_)
SELECT rec, s1, src, p FROM u QUALIFY row_number() OVER (PARTITION BY s1, src ORDER BY p DESC, rec) <= CASE src WHEN 2 THEN 1 ELSE 2 END""")
def cross_source_rules(t):
    """final_rules where both sources have records: one that just missed is rescued by an accepted record of the other source."""
    both, _, _ = _both(t)
    return decide.final_rules(both.select("rec", "s1", "p"), 0.6, 0.01, 0.3, {2: 1, 3: 2})


_MD5 = "('0x' || substr(md5(cast(s1 AS string) || '|holdout'), 1, 8))::BIGINT % 10000 < 1000"


@query(f""", {_BOTH}, {_TRUE}, w(fp_weight) AS (VALUES (1.0::DOUBLE), (2.0::DOUBLE)), best2 AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY rec ORDER BY p DESC, s1) = 1),
l AS (SELECT b.s1, sum(coalesce(b.s1 = tr.s1, false)::INT) AS tp, sum((tr.s1 IS NOT NULL AND b.s1 <> tr.s1)::INT) AS wrong, sum((tr.s1 IS NULL)::INT) AS free FROM best2 b LEFT JOIN tr USING (rec) WHERE p >= 0.55 GROUP BY b.s1),
e AS (SELECT s1, CASE WHEN {_MD5} THEN 'holdout' ELSE 'rest' END AS part, coalesce(nt, 0) AS nt, coalesce(tp, 0) AS tp, coalesce(wrong, 0) AS wrong, coalesce(free, 0) AS free FROM (SELECT DISTINCT s1 FROM truth) LEFT JOIN (SELECT s1, count(*) AS nt FROM tr GROUP BY s1) USING (s1) LEFT JOIN l USING (s1)),
f AS (SELECT fp_weight, part, nt, tp, wrong + free AS n_fp, (SELECT {_F05} FROM (SELECT wrong + free AS fp)) AS f1, (SELECT {_F05} FROM (SELECT wrong + fp_weight * free AS fp)) AS fw FROM e, w)
SELECT fp_weight, 0.55::DOUBLE AS threshold, part, round(avg(f1), 9) AS macro_f05, round(sum(tp) / sum(tp + n_fp), 9) AS pair_p, round(sum(tp) / sum(nt), 9) AS pair_r, count(*) AS n_s1, round(avg(f1) FILTER (WHERE nt = 0), 9) AS singleton_acc, round(avg(fw), 9) AS macro_f05_weighted FROM f GROUP BY fp_weight, part""")
def holdout_quality(t):
    both, truth, _ = _both(t)
    out = evaluate.holdout_report(both, truth, "p", threshold=0.55)
    floats = ("macro_f05", "pair_p", "pair_r", "singleton_acc", "macro_f05_weighted")
    return out.select(*[short(c).alias(c) if c in floats else F.col(c) for c in out.columns])


_SETUPS = {"name": ("glued",), "address": ("atok",), "name, address": ("glued", "atok"), "core, postcode": ("core", "post"), "all four": ("glued", "atok", "core", "post")}


def _setup_sql(name: str, columns: tuple[str, ...]) -> str:
    any_ = lambda a, b: " OR ".join(f"({a}.{c} <> '' AND {a}.{c} = {b}.{c})" for c in columns)
    met = " UNION ".join(f"SELECT b.id AS rec, a.id AS s1 FROM norm a JOIN norm b ON a.src = 1 AND b.src = 2 AND a.{c} <> '' AND a.{c} = b.{c}" for c in columns)
    return f"""SELECT '{name}' AS setup, (SELECT avg(coalesce({any_("a", "b")}, false)::INT) FROM truth t LEFT JOIN norm a ON a.id = t.s1 LEFT JOIN norm b ON b.id = t.rec WHERE t.rec >= 0) AS recall,
  quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95, max(n)::BIGINT AS largest FROM (SELECT r.id, count(m.s1) AS n FROM norm r LEFT JOIN ({met}) m ON m.rec = r.id WHERE r.src = 2 GROUP BY r.id)"""


@query(" UNION ALL ".join(_setup_sql(k, v) for k, v in _SETUPS.items()))
def combined_key_recall(t):
    s1, rec = _split(t)
    return reports.combined_key_recall(s1, rec, t.truth, _SETUPS)


_STAGES = f"""b AS (SELECT rec, s1, p FROM scored WHERE rec % 11 > 0), pr AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY p DESC, s1) AS n FROM b QUALIFY n <= 2 AND (p >= 0.35 OR n = 1)),
acc AS (SELECT rec, s1 FROM pr WHERE n = 1 AND p >= 0.6), tr AS (SELECT s1, rec FROM truth WHERE rec >= 0),
lin AS (SELECT tr.rec, tr.s1, acc.s1 AS winner, CASE WHEN acc.s1 = tr.s1 THEN 'TP' WHEN b.rec IS NULL THEN 'missed_by_blocking' WHEN pr.rec IS NULL THEN 'removed_by_pruning' ELSE 'rejected_by_model' END AS outcome
  FROM tr LEFT JOIN b USING (rec, s1) LEFT JOIN pr ON pr.rec = tr.rec AND pr.s1 = tr.s1 LEFT JOIN acc ON acc.rec = tr.rec)"""


def _stages(t):
    blocked = t.scored.where("rec % 11 > 0").select("rec", "s1", "p")
    pruned = ranking.prune(blocked, "p", 2, 0.35).select("rec", "s1", "p")
    accepted = decide.assign(pruned, "p", 0.6)
    return reports.lineage(t.truth, blocked, pruned, accepted), accepted


@query(f", {_STAGES} SELECT rec, s1, outcome, winner FROM lin")
def pair_lineage(t):
    return _stages(t)[0]


def _scenario(name: str, tp: str, fp: str) -> str:
    return f"SELECT '{name}' AS scenario, avg((SELECT {_F05} FROM (SELECT {tp} AS tp, {fp} AS fp))) AS m FROM ent"


@query(f""", {_STAGES}, w AS (SELECT s1, count(*) AS fp FROM (SELECT rec, s1 FROM acc EXCEPT SELECT rec, s1 FROM tr) GROUP BY s1),
l AS (SELECT s1, count(*) AS nt, count(*) FILTER (WHERE outcome = 'TP') AS tp, count(*) FILTER (WHERE outcome = 'missed_by_blocking') AS mb, count(*) FILTER (WHERE outcome = 'removed_by_pruning') AS rp, count(*) FILTER (WHERE outcome = 'rejected_by_model') AS rm FROM lin GROUP BY s1),
ent AS (SELECT id AS s1, coalesce(nt, 0) AS nt, coalesce(tp, 0) AS t, coalesce(mb, 0) AS mb, coalesce(rp, 0) AS rp, coalesce(rm, 0) AS rm, coalesce(fp, 0) AS f FROM s1 LEFT JOIN l ON l.s1 = s1.id LEFT JOIN w ON w.s1 = s1.id),
r AS ({_scenario("actual", "t", "f")} UNION ALL {_scenario("fix blocking misses", "t + mb", "f")} UNION ALL {_scenario("fix pruning losses", "t + rp", "f")} UNION ALL {_scenario("fix model rejections", "t + rm", "f")} UNION ALL {_scenario("remove all false positives", "t", "0")}
  UNION ALL {_scenario("empty prediction for singletons", "t", "CASE WHEN nt > 0 THEN f ELSE 0 END")} UNION ALL {_scenario("perfect", "nt", "0")})
SELECT scenario, round(m, 9) AS macro_f05, round(m - (SELECT m FROM r WHERE scenario = 'actual'), 9) AS gain FROM r""")
def loss_by_cause(t):
    rows, accepted = _stages(t)
    out = reports.loss_by_cause(rows, accepted, t.s1.select(F.col("id").alias("s1")))
    return out.select("scenario", short("macro_f05").alias("macro_f05"), short("gain").alias("gain"))


@query(f""", {_BEST}, acc AS (SELECT rec, s1 FROM best WHERE p >= 0.55 AND s1 % 2 = 1), te AS (SELECT id, src, CASE WHEN id % 7 = 0 THEN 'Else' ELSE country END AS country FROM records WHERE id % 2 = 1), tr AS (SELECT country FROM records WHERE id % 2 = 0),
n AS (SELECT * FROM te WHERE country NOT IN (SELECT country FROM tr)), m AS (SELECT s1 AS id FROM acc UNION SELECT rec FROM acc)
SELECT 'unseen countries' AS "check", count(DISTINCT country)::DOUBLE AS value FROM n UNION ALL SELECT 'records in them', count(*)::DOUBLE FROM n
UNION ALL SELECT 'cross-country pairs', avg((a.country <> b.country)::INT) FROM acc JOIN te a ON a.id = acc.s1 JOIN te b ON b.id = acc.rec
UNION ALL SELECT 'matched entities', avg((id IN (SELECT id FROM m))::INT) FROM te WHERE src = 1 UNION ALL SELECT 'claimed records', avg((id IN (SELECT id FROM m))::INT) FROM te WHERE src > 1""")
def shift_checks(t):
    """Records of odd ids as test data, some of them from a country that those of even ids don't have."""
    odd = F.col("id") % 2 == 1
    test = t.records.where(odd).withColumn("country", F.when(F.col("id") % 7 == 0, "Else").otherwise(F.col("country")))
    return reports.shift_checks(t.records.where(~odd), test, decide.assign(t.scored, "p", 0.55).where("s1 % 2 = 1"))
