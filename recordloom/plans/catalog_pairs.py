"""Queries of the pair, cluster and comparison features, with their SQL: string measures as long rows, then pivoted."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import similarity
from recordloom.operators import classic, explore, names, pairs
from recordloom.plans.catalog import _JAC, _PAIRED, _classic_sides, _true_sides, _words, query, short
from recordloom.sources import scratch


def rounded(df, keys=("rec", "s1"), digits: int = 6):
    """Keys as they are, all else as rounded doubles."""
    return df.select(*keys, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in df.columns if c not in keys])


def lcs(a: str, b: str) -> str:
    """SQL of the longest common subsequence's length, by bit-parallel rows; a and b are columns."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = ch THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))::HUGEINT"
    rows = f"list_reduce([{full}] || list_transform(string_split({b}, ''), lambda ch: {mask}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({rows}) END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100::DOUBLE ELSE 200::DOUBLE * ({lcs(a, b)}) / (length({a}) + length({b})) END"


def measures(source: str, wanted: dict[str, tuple[str, str, str]], keys: str = "rec, s1", prefix: str = "m") -> str:
    """CTEs ending in <prefix>(keys, a column per wanted measure): name -> (kind, left column, right column) of source.

    Kinds: ratio, sort, set, partial, part_set (partial over token sets), part_sort, lcs (length)."""
    rows = " UNION ALL ".join(f"SELECT {keys}, '{name}' AS name, '{kind}' AS kind, coalesce({a}, '') AS a, coalesce({b}, '') AS b FROM {source}" for name, (kind, a, b) in wanted.items())
    p = prefix
    joined = lambda x: f"array_to_string({x}, ' ')"
    return f"""
{p}0 AS ({rows}),
{p}1 AS (SELECT *, {_words('a')} AS ta, {_words('b')} AS tb FROM {p}0),
{p}2 AS (SELECT *, list_sort(list_distinct(ta)) AS sa, list_sort(list_distinct(tb)) AS sb FROM {p}1),
{p}3 AS (SELECT *, list_sort(list_intersect(sa, sb)) AS both_, list_sort(list_filter(sa, lambda w: NOT list_contains(sb, w))) AS xa, list_sort(list_filter(sb, lambda w: NOT list_contains(sa, w))) AS xb FROM {p}2),
{p}4 AS (SELECT *, CASE kind WHEN 'sort' THEN {joined('list_sort(ta)')} WHEN 'part_sort' THEN {joined('list_sort(ta)')} WHEN 'set' THEN {joined('both_ || xa')} WHEN 'part_set' THEN {joined('sa')} ELSE a END AS l,
  CASE kind WHEN 'sort' THEN {joined('list_sort(tb)')} WHEN 'part_sort' THEN {joined('list_sort(tb)')} WHEN 'set' THEN {joined('both_ || xb')} WHEN 'part_set' THEN {joined('sb')} ELSE b END AS r, {joined('both_')} AS c FROM {p}3),
{p}5 AS (SELECT {keys}, name, CASE WHEN length(l) <= length(r) THEN l ELSE r END AS s, CASE WHEN length(l) <= length(r) THEN r ELSE l END AS g FROM {p}4 WHERE kind IN ('partial', 'part_set', 'part_sort')),
{p}6 AS (SELECT {keys}, name, length(s) AS n, s, g[greatest(0, i) + 1:i + length(s)] AS w FROM (SELECT *, unnest(range(1 - length(s), length(g))) AS i FROM {p}5 WHERE s <> '')),
{p}7 AS (SELECT {keys}, name, max(200::DOUBLE * ({lcs('s', 'w')}) / (n + length(w))) AS part FROM {p}6 GROUP BY ALL),
{p}8 AS (SELECT {p}4.*, part, CASE WHEN kind IN ('ratio', 'sort', 'set') THEN {_ratio('l', 'r')} END AS r1, CASE WHEN kind = 'set' THEN {_ratio('c', 'l')} END AS r2, CASE WHEN kind = 'set' THEN {_ratio('c', 'r')} END AS r3, CASE WHEN kind = 'lcs' THEN {lcs('l', 'r')} END AS common
  FROM {p}4 LEFT JOIN {p}7 USING ({keys}, name)),
{p}9 AS (SELECT {keys}, name, CASE WHEN kind IN ('ratio', 'sort') THEN r1 WHEN kind = 'lcs' THEN common
  WHEN kind = 'set' THEN CASE WHEN len(sa) = 0 OR len(sb) = 0 THEN 0 WHEN len(both_) > 0 AND (len(xa) = 0 OR len(xb) = 0) THEN 100 WHEN len(both_) > 0 THEN greatest(r1, r2, r3) ELSE r1 END
  WHEN kind = 'part_set' AND (len(sa) = 0 OR len(sb) = 0) THEN 0 WHEN kind = 'part_set' AND len(both_) > 0 THEN 100
  WHEN l = '' AND r = '' THEN 100 WHEN l = '' OR r = '' THEN 0 ELSE part END AS v FROM {p}8),
{p} AS (SELECT {keys}, {', '.join(f"max(v) FILTER (WHERE name = '{name}') AS {name}" for name in wanted)} FROM {p}9 GROUP BY ALL)"""


def _weighted(ratio: str, sort: str, set_: str, partial: str, part_sort: str, part_set: str, a: str, b: str) -> str:
    """SQL of the weighted ratio from its parts."""
    spread = f"(greatest(length({a}), length({b}))::DOUBLE / least(length({a}), length({b})))"
    part = f"(CASE WHEN {spread} <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END)"
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0::DOUBLE WHEN {spread} < 1.5 THEN greatest({ratio}, 0.95::DOUBLE * {sort}, 0.95::DOUBLE * {set_})"
        f" ELSE greatest({ratio}, {part} * {partial}, 0.95::DOUBLE * {part} * greatest({part_sort}, {part_set})) END"
    )


_SIX = {"ratio": "ratio", "token_sort_ratio": "sort", "token_set_ratio": "set", "partial_ratio": "partial", "partial_token_set_ratio": "part_set", "_part_sort": "part_sort", "_lcs": "lcs"}


@query(f""", p AS (SELECT rec, s1, core AS a, b_core AS b FROM ({_PAIRED})), {measures("p", {k: (v, "a", "b") for k, v in _SIX.items()})}
SELECT rec, s1, round(ratio, 6) AS ratio, round(token_sort_ratio, 6) AS token_sort_ratio, round(token_set_ratio, 6) AS token_set_ratio, round(partial_ratio, 6) AS partial_ratio, round(partial_token_set_ratio, 6) AS partial_token_set_ratio,
  round({_weighted("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio", "_part_sort", "partial_token_set_ratio", "a", "b")}, 6) AS weighted_ratio, round(jaro_winkler_similarity(a, b), 6) AS jaro_winkler,
  round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1 ELSE 1 - damerau_levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 6) AS osa_similarity,
  round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1 ELSE _lcs::DOUBLE / greatest(length(a), length(b)) END, 6) AS lcs_similarity FROM p JOIN m USING (rec, s1)""")
def ratio_family(t):
    a, b = F.col("a_core"), F.col("b_core")
    return rounded(_true_sides(t).select("rec", "s1", *[f(a, b).alias(k) for k, f in similarity.SCORERS.items()]))


# ---- the full features of pairs ----------------------------------------------------------------------------------------
def _overlap(source: str, column: str, name: str) -> str:
    """CTEs <name>w, ..., <name>(rec, s1, <name>_wov, _cov_s1, _cov_rec) of weighted token overlap."""
    default = "ln(1 + (SELECT count(*) FROM norm WHERE src = 1))"
    n = name
    return f"""
w{n}0 AS (SELECT token, ln(1 + (SELECT count(*) FROM norm WHERE src = 1) / count(*)) AS idf FROM (SELECT id, unnest(list_distinct({_words(column)})) AS token FROM norm WHERE src = 1) GROUP BY token),
w{n}1 AS (SELECT rec, s1, {_words('a_' + column)} AS x, {_words('b_' + column)} AS y FROM {source}),
w{n}2 AS (SELECT rec, s1, x, y, unnest(list_distinct(x || y)) AS token FROM w{n}1),
w{n}3 AS (SELECT rec, s1, sum(CASE WHEN list_contains(x, token) AND list_contains(y, token) THEN i ELSE 0 END) AS both_, sum(i) AS u, sum(CASE WHEN list_contains(x, token) THEN i ELSE 0 END) AS a, sum(CASE WHEN list_contains(y, token) THEN i ELSE 0 END) AS b
  FROM (SELECT w{n}2.*, coalesce(idf, {default}) AS i FROM w{n}2 LEFT JOIN w{n}0 USING (token)) GROUP BY rec, s1),
{n}_ AS (SELECT p.rec, p.s1, CASE WHEN a > 0 AND b > 0 THEN both_ / u ELSE -1 END AS {n}_wov, CASE WHEN a > 0 AND b > 0 THEN both_ / a ELSE -1 END AS {n}_cov_s1, CASE WHEN a > 0 AND b > 0 THEN both_ / b ELSE -1 END AS {n}_cov_rec FROM {source} p LEFT JOIN w{n}3 USING (rec, s1))"""


_SCORED = "sides AS (SELECT s.rec, s.s1, s.p, " + ", ".join(f"{x}.{c} AS {x}_{c}" for x in "ab" for c in ("core", "legal", "glued", "atok", "anum", "post", "indic")) + " FROM scored s JOIN norm a ON a.id = s.s1 JOIN norm b ON b.id = s.rec)"
_N = lambda c: _words(c)
_NUM = "len(na) = 0 OR len(nb) = 0"


@query(f""", {_SCORED}, {_overlap("sides", "core", "n")}, {_overlap("sides", "atok", "a")},
{measures("sides", {"n_ratio": ("ratio", "a_core", "b_core"), "n_tset": ("set", "a_core", "b_core"), "n_tsort": ("sort", "a_core", "b_core"), "n_partial": ("partial", "a_core", "b_core"), "a_tset": ("set", "a_atok", "b_atok"), "a_ratio": ("ratio", "a_atok", "b_atok"), "a_partial": ("part_set", "a_atok", "b_atok")})},
l AS (SELECT *, {_N('a_anum')} AS na, {_N('b_anum')} AS nb, {_N('a_legal')} AS la, {_N('b_legal')} AS lb, {_N('a_post')} AS pa, {_N('b_post')} AS pb, {_N('a_core')} AS ca, {_N('b_core')} AS cb, {_N('a_atok')} AS ta, {_N('b_atok')} AS tb FROM sides),
fg AS (SELECT glued, count(*) AS n FROM norm WHERE src = 1 GROUP BY glued), ff AS (SELECT string_split(core, ' ')[1] AS word, count(*) AS n FROM norm WHERE src = 1 GROUP BY 1),
o AS (SELECT rec, s1, p AS p_prune, n_wov, n_cov_s1, n_cov_rec, a_wov, a_cov_s1, a_cov_rec, n_ratio, n_tset, n_tsort, n_partial, jaro_winkler_similarity(a_glued, b_glued) AS g_jw, levenshtein(a_glued, b_glued) AS g_lev,
  (a_glued = b_glued)::INT AS g_eq, (a_glued <> '' AND b_glued <> '' AND (contains(a_glued, b_glued) OR contains(b_glued, a_glued)))::INT AS g_contain, {_JAC.format('ca', 'cb')} AS n_jac, len(ca) AS n_ntok_s1, len(cb) AS n_ntok_rec,
  (len(list_distinct(lb)) = len(list_intersect(la, lb)) AND len(list_distinct(la)) = len(list_intersect(la, lb)))::INT AS l_eq, len(list_distinct(lb)) - len(list_intersect(la, lb)) AS l_added, len(list_distinct(la)) - len(list_intersect(la, lb)) AS l_dropped,
  (len(la) > 0 AND len(lb) > 0 AND len(list_intersect(la, lb)) = 0)::INT AS l_conflict, a_tset, a_ratio, a_partial, {_JAC.format('ta', 'tb')} AS a_jac,
  CASE WHEN {_NUM} THEN -1 ELSE (na[1] = nb[1])::INT END AS h_first_eq, CASE WHEN {_NUM} THEN -1 ELSE list_contains(na, nb[1])::INT END AS h_b0_in_a, {_JAC.format('na', 'nb')} AS h_jac,
  CASE WHEN {_NUM} THEN -1 ELSE least(abs(na[1]::DOUBLE - nb[1]::DOUBLE), 1000) / 1000 END AS h_diff, CASE WHEN {_NUM} THEN -1 ELSE least(abs(na[1]::DOUBLE - nb[1]::DOUBLE) / greatest(na[1]::DOUBLE, 1), 10) END AS h_rel, len(na) AS h_n_s1, len(nb) AS h_n_rec,
  CASE WHEN len(pa) = 0 OR len(pb) = 0 THEN -1 ELSE (len(list_intersect(pa, pb)) > 0)::INT END AS post_eq, (b_atok = '' AND b_anum = '')::INT AS a_empty_rec, b_indic::INT AS indic_rec, coalesce(fg.n, 0) AS freq_glued, coalesce(ff.n, 0) AS freq_first
  FROM l JOIN n_ USING (rec, s1) JOIN a_ USING (rec, s1) JOIN m USING (rec, s1) LEFT JOIN fg ON fg.glued = a_glued LEFT JOIN ff ON ff.word = string_split(a_core, ' ')[1])
SELECT rec, s1, round(COLUMNS(* EXCLUDE (rec, s1))::DOUBLE, 6) FROM o""")
def pair_features(t):
    return rounded(pairs.pair_features(t.scored.select("rec", "s1", F.col("p").alias("p_prune")), t.norm))


@query(f""", {_SCORED}, l AS (SELECT *, {_N('a_anum')} AS na, {_N('b_anum')} AS nb FROM sides)
SELECT rec, s1, CASE WHEN len(na) = 0 OR len(nb) = 0 THEN 0.5 ELSE (na[1] = nb[1])::INT END::DOUBLE AS hn_eq, (a_glued = b_glued)::INT::DOUBLE AS glued_eq, 2.0::DOUBLE AS src FROM l""")
def cheap_features(t):
    return rounded(pairs.cheap_features(t.scored.select("rec", "s1"), t.norm))


@query(f""", best AS (SELECT *, max(p) OVER (PARTITION BY rec) AS best, nth_value(p, 2) OVER (PARTITION BY rec ORDER BY p DESC, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM scored),
comp AS (SELECT rec, s1, p, CASE WHEN p >= best THEN p - coalesce(second, 0) ELSE p - best END AS p1_gap, sum((p >= best)::INT) OVER (PARTITION BY s1) AS p1_s1top FROM best),
member AS (SELECT rec AS m, s1, p AS pm FROM best WHERE p >= best AND p >= 0.5), size1 AS (SELECT s1, count(*) AS n FROM member GROUP BY s1),
pr AS (SELECT s.rec, s.s1, member.m, pm, a.core AS a_core, b.core AS b_core, a.glued AS a_glued, b.glued AS b_glued, a.atok AS a_atok, b.atok AS b_atok, {_N('a.anum')} AS na, {_N('b.anum')} AS nb, a.legal AS a_legal, b.legal AS b_legal
  FROM scored s JOIN member ON member.s1 = s.s1 AND member.m <> s.rec JOIN norm a ON a.id = s.rec JOIN norm b ON b.id = member.m),
{measures("pr", {"cn": ("set", "a_core", "b_core"), "ca": ("set", "a_atok", "b_atok")}, "rec, s1, m", "q")},
sims AS (SELECT pr.rec, pr.s1, pm, cn, jaro_winkler_similarity(a_glued, b_glued) AS cg, ca, CASE WHEN len(na) = 0 OR len(nb) = 0 THEN -1 ELSE (na[1] = nb[1])::INT END AS ch, (a_legal = b_legal)::INT AS cl FROM pr JOIN q USING (rec, s1, m)),
agg AS (SELECT rec, s1, count(*) AS cl_n, count(*) AS cl_same_src, avg(pm) AS cl_pmean, max(cn) AS cl_name_max, avg(cn) AS cl_name_mean, max(cg) AS cl_glued_max, max(ca) AS cl_addr_max, avg(ca) AS cl_addr_mean, avg(ch) AS cl_hn_agree, max(ch) AS cl_hn_any, avg(cl) AS cl_legal_agree FROM sims GROUP BY rec, s1),
o AS (SELECT rec, s1, p AS p1, p1_gap, p1_s1top, coalesce(n, 0) AS p1_s1n, coalesce(cl_n, 0) AS cl_n, coalesce(cl_same_src, 0) AS cl_same_src, coalesce(cl_pmean, -1) AS cl_pmean, coalesce(cl_name_max, -2) AS cl_name_max, coalesce(cl_name_mean, -2) AS cl_name_mean, coalesce(cl_glued_max, -2) AS cl_glued_max,
  coalesce(cl_addr_max, -2) AS cl_addr_max, coalesce(cl_addr_mean, -2) AS cl_addr_mean, coalesce(cl_hn_agree, -2) AS cl_hn_agree, coalesce(cl_hn_any, -2) AS cl_hn_any, coalesce(cl_legal_agree, -2) AS cl_legal_agree FROM comp LEFT JOIN size1 USING (s1) LEFT JOIN agg USING (rec, s1))
SELECT rec, s1, round(COLUMNS(* EXCLUDE (rec, s1))::DOUBLE, 6) FROM o""")
def cluster_features(t):
    return rounded(pairs.cluster_features(t.scored.select("rec", "s1", F.col("p").alias("p1")), t.norm, "p1", 0.5))


# ---- comparisons of the exploration ------------------------------------------------------------------------------------
_BASIC = "trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '\\s+', ' ', 'g'))"
_LATIN = "trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'))"
_KINDS = {"ratio": "ratio", "token_sort": "sort", "token_set": "set", "_partial": "partial", "_part_set": "part_set", "_part_sort": "part_sort"}


def _digits(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '\d+'))"


def _compared(name: str, c: str) -> str:
    a, b = f"a_{c}_latin", f"b_{c}_latin"
    parts = [f"{name}_ratio", f"{name}_token_sort", f"{name}_token_set", f"{name}__partial", f"{name}__part_sort", f"{name}__part_set"]
    return f"""{name}_ratio, {_weighted(*parts, a, b)} AS {name}_wratio, {name}_token_sort, {name}_token_set, ({a} <> '' AND {a} = {b})::INT AS {name}_exact_translit, (a_{c}_basic <> '' AND a_{c}_basic = b_{c}_basic)::INT AS {name}_basic_exact,
  least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b}), 1) AS {name}_length_ratio, len(list_intersect({_digits(a)}, {_digits(b)}))::DOUBLE / greatest(len(list_distinct({_digits(a)} || {_digits(b)})), 1) AS {name}_numeric_overlap"""


_VIEWS = ", ".join(f"{f.format(f'{x}.{c}')} AS {x}_{c}_{k}" for x in "ab" for c in ("name", "addr") for k, f in (("basic", _BASIC), ("latin", _LATIN)))


@query(f""", v AS (SELECT t.rec, t.s1, a.country AS a_country, b.country AS b_country, {_VIEWS} FROM truth t JOIN records a ON a.id = t.s1 JOIN records b ON b.id = t.rec),
{measures("v", {f"{n}_{k}": (kind, f"a_{c}_latin", f"b_{c}_latin") for n, c in (("name", "name"), ("address", "addr")) for k, kind in _KINDS.items()})},
o AS (SELECT rec, s1, {_compared("name", "name")}, {_compared("address", "addr")}, (trim(a_country) <> '' AND lower(trim(a_country)) = lower(trim(b_country)))::INT AS country_exact FROM v JOIN m USING (rec, s1))
SELECT rec, s1, round(COLUMNS(* EXCLUDE (rec, s1))::DOUBLE, 6) FROM o""")
def comparison_features(t):
    views = scratch.table(explore.with_views(t.records), "views")
    out = t.truth.where("rec >= 0").select("rec", "s1")
    for side, key in (("a", "s1"), ("b", "rec")):
        out = out.join(views.select(F.col("id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in views.columns if c != "id"]), key)
    found = explore.comparison_features(out)
    return rounded(found.select("rec", "s1", *[c for c in found.columns if c.startswith(("name_", "address_", "country_exact"))]))
