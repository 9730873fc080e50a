"""Queries of the learned dictionaries, over true pairs made of the fixture's reference records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import text
from recordloom.operators import decide, evaluate, lexicon
from recordloom.operators.classic import search_thresholds
from recordloom.plans.catalog import _PLACE, _basic, _words, query
from recordloom.sources import scratch

#: Pairs of texts: names partly in another script, addresses with abbreviations.
_TEXTS = """SELECT id AS rec, name AS a_name, concat('Unit ', cast(id % 50 AS string), ', ', addr, ', ', country, ' state') AS a_addr,
  CASE WHEN id % 4 = 0 THEN name ELSE translate(lower(name), 'abcdefghijklmn', 'कखगघचछजझटठडढतथ') END AS b_name,
  concat('Unit ', cast(id % 50 AS string), ', ', replace(replace(addr, 'Street', CASE WHEN id % 5 < 4 THEN 'Strt' ELSE 'Stret' END), 'Ward', CASE WHEN id % 3 = 0 THEN 'Wd' ELSE 'Ward' END), ', ', CASE country WHEN 'US' THEN 'UST' WHEN 'India' THEN 'INS' ELSE 'france state' END) AS b_addr, country FROM s1"""
_INDIC = "'[ऀ-෿]'"


def _texts(t):
    t.s1.createOrReplaceTempView("s1")
    return scratch.table(t.spark.sql(_TEXTS).repartition("rec"), "texts")


@query(f""", x AS ({_TEXTS}), w AS (SELECT {_words(_basic('a_name'))} AS a, {_words('b_name')} AS b FROM x WHERE regexp_matches(b_name, {_INDIC})),
v AS (SELECT unnest(b) AS key, unnest(a) AS value FROM w WHERE len(a) = len(b)), c AS (SELECT key, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY key)::BIGINT AS total, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, value) AS r FROM v WHERE regexp_matches(key, {_INDIC}) GROUP BY key, value)
SELECT key, value, n, total FROM c WHERE r = 1 AND n >= 2 AND n >= 0.5 * total""")
def learned_script_tokens(t):
    return lexicon.learn_script_tokens(_texts(t))


def _atok(addr: str) -> str:
    comps = f"list_filter(list_transform(string_split(coalesce({addr}, ''), ','), lambda c: {_basic('c')}), lambda c: c <> '' AND c NOT IN ({_PLACE}))"
    return rf"list_distinct(list_filter(flatten(list_transform({comps}, lambda c: string_split(c, ' '))), lambda w: NOT regexp_full_match(w, '\d+') AND w NOT IN ({_PLACE})))"


@query(f""", x AS ({_TEXTS}), w AS (SELECT row_number() OVER () AS r, {_atok('a_addr')} AS a, {_atok('b_addr')} AS b FROM x),
o AS (SELECT r, a, list_filter(b, lambda k: NOT list_contains(a, k)) AS ks, list_filter(a, lambda k: NOT list_contains(b, k)) AS vs FROM w),
k AS (SELECT r, vs, unnest(ks) AS key FROM o), tot AS (SELECT key, count(*) AS total FROM k GROUP BY key), v AS (SELECT key, unnest(vs) AS value FROM k),
c AS (SELECT key, value, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, value) AS nth FROM v WHERE key[1] = value[1] AND length(value) > length(key) GROUP BY key, value), own AS (SELECT key, count(*) AS own FROM (SELECT unnest(a) AS key FROM o) GROUP BY key)
SELECT key, value, n, total FROM c JOIN tot USING (key) LEFT JOIN own USING (key) WHERE nth = 1 AND n >= 5 AND n >= 0.4 * total AND (length(key) >= 2 OR key IN ('n', 's', 'e', 'w')) AND coalesce(own, 0) < 0.2 * total""")
def learned_tokens(t):
    return lexicon.learn_tokens(_texts(t), least=5)


_COMPS = lambda a: f"list_filter(list_transform(string_split({a}, ','), lambda c: trim(c)), lambda c: c <> '')"


@query(f""", x AS ({_TEXTS}), w AS (SELECT list_transform({_COMPS('a_addr')}, lambda c: {_basic('c')}) AS a, unnest({_COMPS('b_addr')}) AS c FROM x),
k AS (SELECT a, CASE WHEN regexp_matches(c, {_INDIC}) THEN c ELSE lower(c) END AS key FROM w WHERE NOT list_contains(a, {_basic('c')})), k2 AS (SELECT * FROM k WHERE len({_words('key')}) <= 3),
tot AS (SELECT key, count(*) AS total FROM k2 GROUP BY key), v AS (SELECT key, unnest(a[-3:]) AS value FROM k2), c AS (SELECT key, value, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, value) AS nth FROM v GROUP BY key, value),
r AS (SELECT list_transform({_COMPS('a_addr')}, lambda c: {_basic('c')}) AS c FROM x), st AS (SELECT c[-1] AS value FROM r GROUP BY 1 HAVING count(*) >= 10), any_ AS (SELECT plain, count(*) AS n FROM (SELECT unnest(c) AS plain FROM r) GROUP BY plain)
SELECT key, value, c.n, total FROM c JOIN tot USING (key) SEMI JOIN st USING (value) LEFT JOIN any_ ON any_.plain = {_basic('key')} WHERE nth = 1 AND c.n >= 5 AND c.n >= 0.6 * total AND {_basic('key')} <> value AND coalesce(any_.n, 0) < 0.2 * total""")
def learned_components(t):
    texts = _texts(t)
    return lexicon.learn_components(texts, texts.select(F.col("a_addr").alias("addr")), least=5, state_rows=10)


@query("WITH e AS (SELECT r.id AS rec, name AS b_name, addr AS b_addr FROM rec r) SELECT t.rec, a.name AS a_name, a.addr AS a_addr, b_name, b_addr FROM truth t JOIN s1 a ON a.id = t.s1 JOIN e ON e.rec = t.rec WHERE t.rec >= 0")
def pair_texts(t):
    return lexicon.pair_texts(t.records, t.truth).select("rec", "a_name", "a_addr", "b_name", "b_addr")


# ---- threshold search ----------------------------------------------------------------------------------------------------
_GRID = (0.3, 0.5, 0.7)


@query(f""", best AS (SELECT rec, s1, a_missing, p FROM scored QUALIFY row_number() OVER (PARTITION BY rec ORDER BY p DESC, s1) = 1), g AS (SELECT unnest({list(_GRID)}::DOUBLE[]) AS t), pairs AS (SELECT a.t AS x, b.t AS y FROM g a, g b),
k AS (SELECT x, y, sum((s1 = rec - 20000000000)::INT) AS tp, count(*) AS n FROM pairs, best WHERE p >= CASE WHEN a_missing THEN x ELSE y END GROUP BY x, y), q AS (SELECT x, y, tp, n, tp / n AS pr, tp / (SELECT count(*) FROM truth WHERE rec >= 0) AS re FROM k)
SELECT max(round(1.25 * pr * re / (0.25 * pr + re), 9)) AS f05 FROM q""")
def searched_thresholds(t):
    """The best pair of thresholds, for records with and without address, by search over counts for each step of the grid."""
    best = decide.assign(t.scored.join(t.scored.groupBy("rec").agg(F.max("p").alias("p")), ["rec", "p"]), "p", 0.0).join(t.scored.select("rec", "s1", "a_missing"), ["rec", "s1"])
    step = F.array_max(F.filter(F.array(*[F.lit(g) for g in _GRID]), lambda g: g <= F.col("p")))
    counts = {(r["a_missing"], r["g"]): (r["tp"], r["n"]) for r in best.withColumn("g", step).where("g IS NOT NULL").groupBy("a_missing", "g").agg(F.sum((F.col("s1") == F.col("rec") - 20000000000).cast("long")).alias("tp"), F.count("*").alias("n")).collect()}  # two flags by the grid
    every = t.truth.where("rec >= 0").count()

    def f05(thresholds: dict) -> float:
        tp, n = (sum(v[i] for (flag, g), v in counts.items() if g >= thresholds[flag]) for i in (0, 1))
        return 1.25 * (tp / n) * (tp / every) / (0.25 * tp / n + tp / every) if tp else 0.0

    found, value = search_thresholds(f05, {True: 0.5, False: 0.5}, _GRID)
    return t.spark.createDataFrame([(round(value, 9),)], "f05 double")


@query("SELECT s1, count(*) AS n_true, sum((rec % 2 = 0)::INT)::BIGINT AS even FROM truth WHERE rec >= 0 GROUP BY s1")
def entity_counts(t):
    counts = evaluate.per_entity(t.truth.where("rec >= 0 AND rec % 2 = 0").select("rec", "s1"), t.truth, t.truth.where("rec >= 0").select("s1"))
    return counts.select("s1", "n_true", F.col("tp").alias("even"))


@query(f"SELECT DISTINCT {_basic('name')} AS plain FROM records")
def distinct_plain_names(t):
    return t.records.select(text.basic(F.col("name")).alias("plain")).distinct()
