"""Queries of the models and of what goes on around them. A model's scores have no SQL; models here learn a rule that they can
learn exactly, and SQL has the rule."""

from __future__ import annotations

from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from recordloom.functions.ids import fold, is_holdout, source_of
from recordloom.operators import blocking, classic, ensembles, evaluate, models, vectors
from recordloom.plans import linkage
from recordloom.plans.catalog import _KEYS, _NAME_F, _W, _split, _words, query, short
from recordloom.plans.catalog_pairs import rounded
from recordloom.sources import scratch
from recordloom.streaming.incremental import match_stream

_HASH = lambda key, salt: f"('0x' || substr(md5(cast({key} AS string) || '|{salt}'), 1, 8))::BIGINT"


@query(f", l AS (SELECT s.rec, s.s1, t.s1 AS true_s1, coalesce(s.s1 = t.s1, false)::INT AS y, coalesce(t.s1, s.rec) AS grp FROM scored s LEFT JOIN (SELECT * FROM truth WHERE rec >= 0) t ON t.rec = s.rec) SELECT *, {_HASH('grp', 'holdout')} % 10000 < 1000 AS ho, ({_HASH('grp', 'fold')} % 3)::INT AS fold FROM l")
def labelled_pairs(t):
    return evaluate.attach_labels(t.scored.select("rec", "s1"), t.truth)


@query(f", l AS (SELECT s.rec, s.s1, p, (s.s1 = s.rec - 20000000000)::INT AS y FROM scored s) SELECT rec, s1, y, CASE WHEN y = 1 OR p >= 0.3 THEN 1.0 ELSE 5.0 END::DOUBLE AS weight FROM l WHERE y = 1 OR p >= 0.3 OR {_HASH('(rec || chr(124) || s1)', 'easy')} % 1000 < 200")
def hard_negative_sample(t):
    rows = t.scored.select("rec", "s1", "p", (F.col("s1") == F.col("rec") - 20000000000).cast("int").alias("y"))
    return models.hard_negatives(rows, "p", 0.2, 0.3).drop("p")


# ---- models that learn a rule ------------------------------------------------------------------------------------------
#: y holds for some values of k; noise says nothing.
_RULE = "p_partkey AS rec, p_partkey AS s1, (p_partkey % 8)::DOUBLE AS k, (p_partkey % 97 / 97)::DOUBLE AS noise, (p_partkey % 8 IN (1, 2, 6))::INT AS y FROM part"


def _rule(t, folds: bool = False):
    key = F.col("p_partkey")
    rows = t.table("part").select(key.cast("long").alias("rec"), key.cast("long").alias("s1"), (key % 8).cast("double").alias("k"), (key % 97 / 97).alias("noise"), (key % 8).isin(1, 2, 6).cast("int").alias("y"))
    return rows.withColumns({"fold": fold(F.col("rec"), 3), "ho": is_holdout(F.col("rec"))}) if folds else rows


_trees = partial(models.fit_trees, rounds=5, depth=4)


def _decided(df, name="p"):
    return df.select("rec", (F.col(name) > 0.5).cast("int").alias("y"))


@query(f"SELECT rec::BIGINT AS rec, y FROM (SELECT {_RULE})")
def boosted_trees(t):
    rows = _rule(t).withColumn("late", F.col("rec") % 5 == 0)
    return _decided(models.predict(models.fit_trees(rows, ["k", "noise"], rounds=10, depth=4, validation="late"), rows, "p"))


@query(f"SELECT rec::BIGINT AS rec, y FROM (SELECT {_RULE})")
def out_of_fold_scores(t):
    return _decided(models.out_of_fold(scratch.table(_rule(t, True)), ["k", "noise"], "p", fit=_trees)[0])


@query(f"SELECT rec::BIGINT AS rec, y FROM (SELECT {_RULE})")
def mean_of_models(t):
    rows = _rule(t)
    fitted = [_trees(rows.where(F.col("rec") % 3 != i), ["k", "noise"], seed=i) for i in range(2)]
    return _decided(models.mean_of(fitted, rows, "p"))


@query(f"SELECT rec::BIGINT AS rec, y FROM (SELECT {_RULE})")
def saved_models(t):
    path = scratch.new_path(t.spark, "model")
    _trees(_rule(t), ["k", "noise"]).write().overwrite().save(path)
    return _decided(models.predict(PipelineModel.load(path), _rule(t), "p"))


@query(f"SELECT rec::BIGINT AS rec, y FROM (SELECT {_RULE})")
def subspace_forests(t):
    rows = _rule(t).withColumns({"k2": F.col("k"), "k3": F.col("k")})
    return _decided(models.mean_of(models.fit_subspace_forests(rows, ["k", "k2", "k3", "noise"], members=3, share=0.75, trees=8), rows, "p"))


@query(f"SELECT rec::BIGINT AS rec, y FROM (SELECT {_RULE})")
def stacked_scores(t):
    """Two scores, each right about half of the values: together they tell."""
    rows = _rule(t, True)
    first, second = F.when(F.col("k") < 4, F.col("y") * 0.9 + 0.05).otherwise(0.5), F.when(F.col("k") >= 4, F.col("y") * 0.9 + 0.05).otherwise(0.5)
    return _decided(models.stack(scratch.table(rows.withColumns({"a": first, "b": second})), ["a", "b"], "p")[0])


@query(f"SELECT rec::BIGINT AS rec, y FROM (SELECT {_RULE})")
def leave_one_out_scores(t):
    rows = scratch.table(_rule(t).withColumn("part", F.concat(F.lit("p"), (F.col("rec") % 3).cast("string"))))
    return _decided(models.leave_one_out(rows, ["k", "noise"], "part", ["p0", "p1", "p2"]))


@query("SELECT unnest(['k', 'noise']) AS feature, unnest([true, false]) AS used")
def feature_importances(t):
    found = models.importances(models.fit_trees(_rule(t), ["k", "noise"], rounds=1, depth=3))
    return t.spark.createDataFrame([(k, v > 0.5) for k, v in found.items()], "feature string, used boolean")


@query("SELECT unnest(['k', 'noise']) AS \"column\", unnest([true, false]) AS matters")
def permutation_importances(t):
    rows = scratch.table(_rule(t))
    fitted = _trees(rows, ["k"])
    right = lambda d: models.predict(fitted, d, "p").agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    return models.permutation_report(rows, ["k", "noise"], right).select("column", (F.col("loss") > 0.2).alias("matters"))


def _kernel_sql() -> str:
    import numpy as np

    rng = np.random.default_rng(1)
    w, b = rng.normal(0, 0.2**0.5, (4, 2)), rng.uniform(0, 2 * np.pi, 4)
    return ", ".join(f"round(sqrt(0.5::DOUBLE) * cos({b[i]:.17g}::DOUBLE + k * ({w[i][0]:.17g})::DOUBLE + noise * ({w[i][1]:.17g})::DOUBLE), 6) AS k{i}" for i in range(4))


@query(f"SELECT rec::BIGINT AS rec, {_kernel_sql()} FROM (SELECT {_RULE})")
def kernel_features(t):
    out, columns = models.kernel_features(_rule(t), ["k", "noise"], n=4)
    return out.select("rec", *[short(c, 6).alias(c[1:]) for c in columns])


@query(""", d AS (SELECT round(p, 2) AS x, avg((s1 = rec - 20000000000)::INT) AS y, count(*) AS w FROM scored GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(w * y) OVER (ORDER BY x) AS cy FROM d),
z AS (SELECT i, x, w, cw, cy, cw - w AS bw, cy - w * y AS by_ FROM o), m AS (SELECT a.i AS a, b.i AS b, (b.cy - a.by_) / (b.cw - a.bw) AS v FROM z a JOIN z b ON b.i >= a.i),
n AS (SELECT a, b, min(v) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS low FROM m), g AS (SELECT b AS i, max(low) AS fit FROM n GROUP BY b)
SELECT DISTINCT x AS p, round(fit, 6) AS calibrated FROM z JOIN g USING (i)""")
def calibrated_scores(t):
    rows = t.scored.select(F.round("p", 2).alias("p"), (F.col("s1") == F.col("rec") - 20000000000).cast("int").alias("y"))
    return models.calibrated(models.calibrate(rows, "p"), rows, "p", "calibrated").select("p", short("calibrated", 6).alias("calibrated")).distinct()


@query("SELECT quantile_cont(p, 0.005) AS threshold FROM scored WHERE s1 = rec - 20000000000")
def recall_threshold(t):
    rows = t.scored.select("p", (F.col("s1") == F.col("rec") - 20000000000).cast("int").alias("y"))
    return t.spark.createDataFrame([(models.recall_threshold(rows, "p", 0.995),)], "threshold double")


@query("SELECT min(p) AS threshold FROM (SELECT p, sum(count(*)) OVER (ORDER BY p DESC) AS kept FROM scored GROUP BY p) WHERE kept <= 1.5 * (SELECT count(*) FROM s1)")
def candidate_budget(t):
    return t.spark.createDataFrame([(models.candidate_budget(t.scored, "p", 1.5, t.s1.count()),)], "threshold double")


@query("SELECT k, count(*) AS n, true AS moved FROM (SELECT " + _RULE + ") GROUP BY k")
def permuted_values(t):
    """Each value as often as before, but most of them in other rows."""
    rows = _rule(t)
    both = models.permuted(rows, "k").join(rows.select("rec", F.col("k").alias("_old")), "rec")
    return both.groupBy("k").agg(F.count("*").alias("n"), (F.avg((F.col("k") != F.col("_old")).cast("double")) > 0.5).alias("moved"))


_FOLDS = f"SELECT p_partkey::BIGINT AS rec, ({_HASH('p_partkey', 'fold')} % 3)::INT AS fold, {_HASH('p_partkey', 'holdout')} % 10000 < 1000 AS ho FROM part"


@query(f"SELECT rec, (CASE WHEN ho THEN fold = 0 ELSE fold = 1 END)::INT AS y FROM ({_FOLDS})")
def unseen_folds(t):
    """The label is whether the fold, which is the only feature, is 0. A model that has seen its own fold would say so. Fold 0's model has seen no
    positive, fold 1's has its cut between 0 and 2, at 1, fold 2's between 0 and 1; holdout rows get the mean of the three."""
    rows = scratch.table(_rule(t, True).withColumns({"k": F.col("fold").cast("double"), "y": (F.col("fold") == 0).cast("int")}))
    return _decided(models.out_of_fold(rows, ["k"], "p", fit=_trees)[0])


@query(f"SELECT rec, (fold = 1)::INT AS y FROM ({_FOLDS})")
def unseen_parts(t):
    """leave_one_out with the same labels: each part is scored by the model of the others."""
    rows = scratch.table(_rule(t, True).withColumns({"k": F.col("fold").cast("double"), "y": (F.col("fold") == 0).cast("int"), "part": F.col("fold").cast("string")}))
    return _decided(models.leave_one_out(rows, ["k"], "part", ["0", "1", "2"]))


@query(f"SELECT rec::BIGINT AS rec, 0.5::DOUBLE AS p FROM (SELECT {_RULE})")
def mean_of_opposites(t):
    """A model of the labels and one of their opposites: their mean says nothing."""
    rows = _rule(t)
    fitted = [_trees(rows.withColumn("y", y), ["k", "noise"]) for y in (F.col("y"), 1 - F.col("y"))]
    return models.mean_of(fitted, rows, "p").select("rec", short("p", 6).alias("p"))


@query(f"SELECT rec::BIGINT AS rec, y FROM (SELECT {_RULE})")
def extra_trees(t):
    rows = scratch.table(_rule(t))
    return _decided(ensembles.score_extra_trees(rows, ensembles.fit_extra_trees(rows, ["k", "noise"], members=2, trees=4, depth=12, least=1), "p"))


_LAND = f"""raw_ AS (SELECT rec, s1, CASE WHEN rec % 5 > 0 THEN k END AS k, noise FROM (SELECT {_RULE})),
st AS (SELECT avg(coalesce(k, 0)) AS mk, stddev_pop(coalesce(k, 0)) AS sk, avg(noise) AS mn, stddev_pop(noise) AS sn, avg((k IS NULL)::INT) AS mi, stddev_pop((k IS NULL)::INT) AS si FROM raw_),
z AS (SELECT rec, s1, (coalesce(k, 0) - mk) / sk AS a, (noise - mn) / sn AS b, ((k IS NULL)::INT - mi) / si AS c FROM raw_, st),
l AS (SELECT *, row_number() OVER (ORDER BY {_HASH("(rec || chr(124) || s1)", "landmarks")} % 2147483648, rec || chr(124) || s1) AS n FROM z QUALIFY n <= 2),
x AS (SELECT z.rec, exp(-((z.a - p.a) ** 2 + (z.b - p.b) ** 2 + (z.c - p.c) ** 2) / 3) AS kp, exp(-((z.a - q.a) ** 2 + (z.b - q.b) ** 2 + (z.c - q.c) ** 2) / 3) AS kq, exp(-((p.a - q.a) ** 2 + (p.b - q.b) ** 2 + (p.c - q.c) ** 2) / 3) AS w FROM z, l p, l q WHERE p.n = 1 AND q.n = 2)"""


@query(f", {_LAND} SELECT rec::BIGINT AS rec, round(kp * (1 / sqrt(1 + w) + 1 / sqrt(1 - w)) / 2 + kq * (1 / sqrt(1 + w) - 1 / sqrt(1 - w)) / 2, 6) AS f0, round(kp * (1 / sqrt(1 + w) - 1 / sqrt(1 - w)) / 2 + kq * (1 / sqrt(1 + w) + 1 / sqrt(1 - w)) / 2, 6) AS f1 FROM x")
def landmark_features(t):
    """Two landmarks: the inverse square root of their kernel has a closed form."""
    rows = _rule(t).withColumn("k", F.when(F.col("rec") % 5 > 0, F.col("k")))
    found = ensembles.landmark_features(rows, ensembles.fit_landmarks(rows, ["k", "noise"], 2), "f")
    return found.select("rec", *[short(F.col("f")[i], 6).alias(f"f{i}") for i in range(2)])


@query(f"SELECT rec::BIGINT AS rec, y FROM (SELECT {_RULE})")
def second_level_scores(t):
    """Trees over two scores, each right about half of the values."""
    rows = _rule(t, True)
    first, second = F.when(F.col("k") < 4, F.col("y") * 0.9 + 0.05).otherwise(0.5), F.when(F.col("k") >= 4, F.col("y") * 0.9 + 0.05).otherwise(0.5)
    return _decided(models.second_level(scratch.table(rows.withColumns({"p2": first, "xe": second})), "p2", "xe", "p", rounds=10)[0])


@query("SELECT id, src FROM (SELECT id, 1 AS src FROM s1 WHERE country IN ('US', 'France') ORDER BY id LIMIT 40) UNION ALL SELECT id, 2 FROM rec WHERE country IN ('US', 'France')")
def restricted_records(t):
    a, b = blocking.restrict(t.s1, t.rec, ("US", "France"), 40)
    return a.select("id", F.lit(1).alias("src")).union(b.select("id", F.lit(2).alias("src")))


# ---- vector index --------------------------------------------------------------------------------------------------------
_EXACT = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT a.id AS s1, b.id AS cand, list_dot_product(a.v, b.v) AS cos FROM e a JOIN e b ON a.id % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY s1 ORDER BY cos DESC, cand))::INT AS rank FROM n)"""


def _vectors(t):
    return scratch.table(t.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")))


@query(f", {_EXACT} SELECT s1, cand, round(cos, 6) AS cos, rank FROM r WHERE rank <= 10")
def indexed_neighbours(t):
    """With as many probes as lists a search is exact: so every row is in the index."""
    v = _vectors(t)
    centres = vectors.fit_centroids(v, 16)
    found = vectors.search(v.where("id % 50 = 0"), vectors.build_index(v, centres), centres, 10, probes=16)
    return found.select("s1", "cand", short("cos", 6).alias("cos"), "rank")


@query(f", {_EXACT} SELECT count(DISTINCT s1) AS n_queries, true AS found FROM r WHERE rank <= 10")
def index_recall(t):
    """Recall against brute force, with the probes that a sample of other queries asks for: 0.9 or more."""
    v = _vectors(t)
    centres, asked = vectors.fit_centroids(v, 16), v.where("id % 50 = 0")
    index = scratch.table(vectors.build_index(v, centres), "index")
    probes = vectors.probes_for(v.where("id % 50 > 0"), v, index, centres)
    exact = blocking.nearest_vectors(asked.withColumn("all", F.lit(1)), v.withColumn("all", F.lit(1)), 10, "all")
    measured = vectors.recall(vectors.search(asked, index, centres, 10, probes=probes), exact)
    return measured.select("n_queries", (F.col("recall") >= 0.9).alias("found"))


@query("SELECT rec, s1, a, b FROM (SELECT rec, s1, CASE WHEN rec % 4 > 0 THEN p END AS a, CASE WHEN s1 % 3 > 0 THEN p END AS b FROM scored) WHERE a IS NOT NULL OR b IS NOT NULL")
def informative_pairs(t):
    rows = t.scored.select("rec", "s1", F.when(F.col("rec") % 4 > 0, F.col("p")).alias("a"), F.when(F.col("s1") % 3 > 0, F.col("p")).alias("b"))
    return models.informative(rows, ["a", "b"])


# ---- second scores -------------------------------------------------------------------------------------------------------
_TWO = "w AS (SELECT rec, s1, p AS p2, (s1 * 31 + rec * 17) % 100 / 100 AS xe FROM scored)"
_LOGIT = lambda c: f"ln(least(greatest({c}, 1e-6), 1 - 1e-6) / (1 - least(greatest({c}, 1e-6), 1 - 1e-6)))"
_RANKED = ", ".join(f"row_number() OVER (PARTITION BY {g} ORDER BY {c} DESC, {tie}) AS {c}_rank_{g}, {c} - max({c}) OVER (PARTITION BY {g}) AS {c}_gap_{g}" for g, tie in (("rec", "s1"), ("s1", "rec")) for c in ("p2", "xe"))


def _two(t):
    return t.scored.select("rec", "s1", F.col("p").alias("p2"), ((F.col("s1") * 31 + F.col("rec") * 17) % 100 / 100).alias("xe"))


@query(f", {_TWO}, o AS (SELECT rec, s1, p2, xe, count(*) OVER (PARTITION BY rec) AS n_rec, count(*) OVER (PARTITION BY s1) AS n_s1, {_RANKED}, {_LOGIT('p2')} AS l_p2, {_LOGIT('xe')} AS l_xe, p2 * xe AS both FROM w) SELECT rec, s1, round(COLUMNS(* EXCLUDE (rec, s1))::DOUBLE, 6) FROM o")
def stack_features(t):
    return rounded(classic.stack_features(_two(t)))


@query(f", {_TWO} SELECT rec, s1, p2, CASE WHEN rec % 3 = 0 THEN (SELECT min(xe) FROM w WHERE rec % 3 > 0) ELSE xe END AS xe FROM w")
def merged_scores(t):
    rows = _two(t)
    return classic.merge_scores(rows.drop("xe"), rows.where(F.col("rec") % 3 > 0).select("rec", "s1", "xe"), "xe")


@query(f", {_TWO} SELECT rec, s1, CASE WHEN rec % 3 > 0 AND s1 % 2 = 0 THEN xe ELSE p2 END AS p2 FROM w")
def overridden_scores(t):
    rows = _two(t)
    other = rows.where(F.col("rec") % 3 > 0).select("rec", "s1", F.col("xe").alias("p2"))
    return classic.override(rows.drop("xe"), other, "p2", F.col("s1") % 2 == 0)


# ---- candidates ------------------------------------------------------------------------------------------------------------
@query("SELECT rec, s1, src, p, (row_number() OVER (PARTITION BY s1, src ORDER BY p DESC, rec))::INT AS rank FROM scored QUALIFY rank <= 2")
def top_per_source(t):
    return blocking.top_k(t.scored.select("rec", "s1", "src", "p"), 2, ("s1", "src"), "p", "rec")


@query("SELECT s1, rec AS cand, max(p) AS cos FROM (SELECT s1, rec, p FROM scored WHERE (s1 + rec) % 4 < 3) WHERE p < 0.5 AND (s1, rec) NOT IN (SELECT s1, rec FROM scored WHERE p >= 0.4) GROUP BY ALL")
def new_neighbours(t):
    rows = t.scored.select("s1", F.col("rec").alias("cand"), F.col("p").alias("cos"), ((F.col("s1") + F.col("rec")) % 4).alias("rank"))
    found = rows.where("cos < 0.5").unionAll(rows.where("cos < 0.5"))
    return blocking.new_neighbours(rows.where("cos >= 0.4"), found, 2)


@query(f"SELECT s.rec, s.s1, s.p FROM scored s JOIN norm a ON a.id = s.s1 JOIN norm b ON b.id = s.rec WHERE len(list_intersect({_words('a.atok')}, {_words('b.atok')})) >= 4")
def shared_addresses(t):
    return blocking.shared_address(t.scored.select("rec", "s1", "p"), t.norm, 4)


_A_FEATURES = (
    "list_transform({0}, lambda w: 'a:' || w) || list_transform({1}, lambda w: 'p:' || w) || list_transform({2}, lambda w: 'n:' || w)"
    " || list_transform(list_filter({2}, lambda w: length(w) >= 3), lambda w: 'x:' || substr(w, 1, 3)) || list_transform(list_filter({2}, lambda w: length(w) >= 3), lambda w: 'y:' || right(w, 3))"
).format(_words("atok"), _words("post"), _words("anum"))
_ITEMS = f"{_words('atok')}[-6:] || {_words('anum')}[1:3] || {_words('post')}[1:1]"
_FEATURES = {
    "name": _NAME_F, "addr": f"list_distinct({_A_FEATURES})", "comb": f"list_distinct(list_transform({_words('core')}, lambda w: 'w:' || w) || {_A_FEATURES})",
    "pair": f"list_distinct(flatten(list_transform({_words('core')}[1:4], lambda w: list_transform({_ITEMS}, lambda x: 'q:' || w || '|' || x))))",
}


def _channel(k: str) -> str:
    cap, top = blocking.CHANNELS[k][1:]
    return f"""
{k}_f AS (SELECT id, src, country, unnest({_FEATURES[k]}) AS feature FROM norm), {k}_i AS (SELECT country, feature, ln(1 + n / count(*)) * {_W} AS idf FROM {k}_f JOIN size USING (country) WHERE src = 1 GROUP BY country, feature, n HAVING count(*) <= {cap}),
{k}_r AS (SELECT id, src, country, feature, idf / sqrt(sum(idf * idf) OVER (PARTITION BY id)) AS w FROM {k}_f JOIN {k}_i USING (country, feature)),
{k}_c AS (SELECT q.id AS rec, s.id AS s1, round(sum(q.w * s.w), 9) AS score FROM {k}_r q JOIN {k}_r s ON q.country = s.country AND q.feature = s.feature AND q.src = 2 AND s.src = 1 GROUP BY ALL),
{k}_t AS (SELECT rec, s1 FROM {k}_c WHERE score > 0.05 QUALIFY row_number() OVER (PARTITION BY rec ORDER BY score DESC, s1) <= {top})"""


def _keyed(name: str, key: str) -> str:
    return f"""
{name}_a AS (SELECT id AS s1, country, {key} AS key, count(*) OVER (PARTITION BY country, {key}) AS n FROM norm WHERE src = 1),
{name}_t AS (SELECT b.rec, a.s1 FROM (SELECT id AS rec, country, {key} AS key FROM norm WHERE src = 2) b JOIN {name}_a a ON a.country = b.country AND a.key = b.key AND a.key <> '' AND n <= 500 LEFT JOIN addr_c c ON c.rec = b.rec AND c.s1 = a.s1
  QUALIFY row_number() OVER (PARTITION BY b.rec ORDER BY coalesce(score, 0) DESC, a.s1) <= 15)"""


_CH = tuple(blocking.CHANNELS)


@query(f""", size AS (SELECT country, count(*) AS n FROM norm WHERE src = 1 GROUP BY country), {", ".join(_channel(k) for k in _CH)}, {_keyed("glue", "glued")}, {_keyed("sort", f"array_to_string(list_sort({_words('core')}), '')")},
u AS ({" UNION ".join(f"SELECT rec, s1 FROM {k}_t" for k in (*_CH, "glue", "sort"))}),
c AS (SELECT u.rec, u.s1, {", ".join(f"coalesce({k}_c.score, 0) AS c_{k}" for k in _CH)} FROM u {" ".join(f"LEFT JOIN {k}_c ON {k}_c.rec = u.rec AND {k}_c.s1 = u.s1" for k in _CH)}),
r AS (SELECT *, {", ".join(f"row_number() OVER (PARTITION BY rec ORDER BY c_{k} DESC, s1) AS r_{k}, c_{k} - max(c_{k}) OVER (PARTITION BY rec) AS m_{k}" for k in _CH)}, count(*) OVER (PARTITION BY rec) AS n_cand FROM c),
o AS (SELECT r.*, sum((r_comb = 1)::INT) OVER (PARTITION BY s1) AS s1_top_cnt, CASE WHEN len({_words('a.anum')}) = 0 OR len({_words('b.anum')}) = 0 THEN 0.5 ELSE ({_words('a.anum')}[1] = {_words('b.anum')}[1])::INT END AS hn_eq, (a.glued = b.glued)::INT AS glued_eq, 2 AS src
  FROM r JOIN norm a ON a.id = s1 JOIN norm b ON b.id = rec)
SELECT rec, s1, round(COLUMNS(* EXCLUDE (rec, s1))::DOUBLE, 9) FROM o""")
def linkage_candidates(t):
    return rounded(linkage.candidates(t.norm, blocking.CHANNELS), digits=9)


@query(f""", {_KEYS}, rsize AS (SELECT country, count(*) AS n FROM norm WHERE src = 1 GROUP BY country),
ridx AS (SELECT keys.country, keys.kind, key, log2((rsize.n + 1) / count(*)) AS weight FROM keys JOIN caps USING (kind) JOIN rsize USING (country) WHERE src = 1 GROUP BY keys.country, keys.kind, key, rsize.n, cap HAVING count(*) <= cap),
found AS (SELECT b.id AS rec, a.id AS s1, round(sum(weight), 9) AS score FROM keys a JOIN keys b ON a.src = 1 AND b.src = 2 AND a.country = b.country AND a.kind = b.kind AND a.key = b.key JOIN ridx ON ridx.country = a.country AND ridx.kind = a.kind AND ridx.key = a.key GROUP BY a.id, b.id)
SELECT rec, s1, score FROM found QUALIFY row_number() OVER (PARTITION BY rec ORDER BY score DESC, s1) = 1 AND score >= 5""")
def streamed_matches(t):
    """The records as a stream of files, matched batch by batch against the reference."""
    base = scratch.new_path(t.spark, "stream")
    records = t.rec.withColumn("src", F.col("src").cast("int"))
    records.repartition(3).write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    match_stream(stream, _split(t)[0], f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("rec", "s1", short("score").alias("score"))


@query(f""", size AS (SELECT country, count(*) AS n FROM norm WHERE src = 1 GROUP BY country), {_channel("addr")} SELECT s1, rec, 2 AS src, score, (row_number() OVER (PARTITION BY s1 ORDER BY score DESC, rec))::INT AS rank FROM addr_c WHERE score > 0.05 QUALIFY rank <= 4""")
def entity_neighbours(t):
    """The other way round: each entity's best records of a source."""
    s1, rec = _split(t)
    f, cap, _ = blocking.CHANNELS["addr"]
    s, q = blocking.channel(s1, rec, f, cap)
    return blocking.nearest_records(s, q, 4, source_of(F.col("id")), (2,))
