"""Queries of the classic feature family, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import classic, names
from recordloom.plans.catalog import _classic_sides, _collapsed, _words, query
from recordloom.plans.catalog_names import _CANON, _IN, _map
from recordloom.plans.catalog_pairs import measures, rounded
from recordloom.sources import scratch

_STREET = _map(classic.STREETS)
_ADDRESS = rf"array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(addr, '(?i)\bn\s*/\s*a\b', ' ', 'g')), '[^0-9a-z]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: coalesce({_STREET}[w], w)), ' ')"


def _canonical(addr: str, country: str) -> str:
    """SQL of an address with figures for ordinals, directions spelt out, units and fillers left out."""
    tokens = f"list_transform({_words(addr)}, lambda w: coalesce({_STREET}[w], w))"
    us, india, france = (f"lower({country}) = '{c}'" for c in ("us", "india", "france"))
    figure = f"CASE WHEN {us} OR {india} THEN coalesce({_map(classic.ORDINALS)}[l[i]], l[i]) ELSE l[i] END"
    unit = lambda i: f"({us} AND l[{i}] IN ({_IN(classic.UNITS)}) AND coalesce(regexp_matches(l[{i} + 1], '\\d') OR length(l[{i} + 1]) = 1, false))"
    filler = f"(({india} AND (l[i] IN ({_IN(classic.FILLERS['india'])}) OR (l[i] = 'h' AND coalesce(l[i + 1], '') = 'no'))) OR ({france} AND l[i] IN ({_IN(classic.FILLERS['france'])})))"
    said = f"CASE WHEN {us} THEN coalesce({_map(classic.DIRECTIONS)}[{figure}], {figure}) ELSE {figure} END"
    kept = f"list_filter(range(1, len(l) + 1), lambda i: NOT {unit('i')} AND NOT {filler} AND NOT (i > 1 AND {unit('(i - 1)')}))"
    return f"list_transform([{tokens}], lambda l: array_to_string(list_transform({kept}, lambda i: {said}), ' '))[1]"


_SKELETON = f"array_to_string(list_transform({_words('name')}, lambda w: {_collapsed("substr(w, 1, 1) || translate(substr(w, 2), 'aeiouy', '')")}), ' ')"
_SIDES = f"""{_CANON},
adr AS (SELECT id, country, addr AS raw, {_ADDRESS} AS addr, regexp_replace(trim(regexp_replace(lower(replace(name, '&', ' and ')), '[^0-9a-z]+', ' ', 'g')), '^$', '') AS name FROM records),
side AS (SELECT adr.id, country, raw, addr, name, c4b AS core, legal, {_canonical('addr', 'country')} AS canon, {_SKELETON} AS skel,
  list_transform({_words('addr')}, lambda w: coalesce({_STREET}[w], w)) AS t FROM adr JOIN canon USING (id)),
side2 AS (SELECT *, array_to_string(t, ' ') AS full_, coalesce(list_filter(t[1:3], lambda w: regexp_full_match(w, '\\d{{1,4}}[a-z]?'))[1], '') AS house, list_distinct(list_filter(t[1:6], lambda w: regexp_full_match(w, '[a-z]{{4,}}') AND w NOT IN ({_IN(classic.STREET_WORDS)}))) AS streets,
  list_distinct(regexp_extract_all(addr, '\\b\\d{{5,6}}\\b')) AS pins, list_distinct(regexp_extract_all(addr, '\\b\\d{{2,}}\\b')) AS nums FROM side),
cs AS (SELECT t.rec, t.s1, {", ".join(f"{x}.{c} AS {x}_{c}" for x in "ab" for c in ("country", "raw", "addr", "name", "core", "legal", "canon", "skel", "full_", "house", "streets", "pins", "nums"))} FROM truth t JOIN side2 a ON a.id = t.s1 JOIN side2 b ON b.id = t.rec)"""


def _jaccard(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct({x} || {y})) END"


_W = _words
_BASE = {
    "r": ("ratio", "a_name", "b_name"), "ts": ("set", "a_name", "b_name"), "to": ("sort", "a_name", "b_name"), "pa": ("partial", "a_name", "b_name"), "sr": ("ratio", "a_skel", "b_skel"), "st": ("set", "a_skel", "b_skel"),
    "at": ("set", "a_addr", "b_addr"), "ap": ("partial", "a_addr", "b_addr"), "ab": ("set", "a_full_", "b_full_"),
}
_BOTH_N, _BOTH_A = "a_name <> '' AND b_name <> ''", "a_addr <> '' AND b_addr <> ''"


@query(f""", {_SIDES}, {measures("cs", _BASE)},
o AS (SELECT rec, s1, r / 100 AS n_norm_ratio, ts / 100 AS n_norm_tset, "to" / 100 AS n_norm_tsort, jaro_winkler_similarity(a_name, b_name) AS n_norm_jw, r / 100 AS n_rom_ratio, ts / 100 AS n_rom_tset, "to" / 100 AS n_rom_tsort, jaro_winkler_similarity(a_name, b_name) AS n_rom_jw,
  sr / 100 AS n_skel_ratio, st / 100 AS n_skel_tset, greatest(ts, st, r) / 100 AS n_best, (a_name <> '' AND a_name = b_name)::INT AS n_exact_norm, (a_name <> '' AND a_name = b_name)::INT AS n_exact_rom, (a_skel <> '' AND a_skel = b_skel)::INT AS n_exact_skel,
  {_jaccard(_W('a_name'), _W('b_name'))} AS n_tok_jacc_rom, coalesce({_W('a_name')}[1] = {_W('b_name')}[1], false)::INT AS n_first_tok_eq, abs(length(a_name) - length(b_name))::DOUBLE / greatest(length(a_name), length(b_name), 1) AS n_len_diff, abs(len({_W('a_name')}) - len({_W('b_name')})) AS n_tok_cnt_diff,
  CASE WHEN {_BOTH_N} THEN pa / 100 ELSE 0 END AS n_partial_rom, CASE WHEN {_BOTH_A} THEN "at" / 100 ELSE 0 END AS a_norm_tset, CASE WHEN {_BOTH_A} THEN "at" / 100 ELSE 0 END AS a_rom_tset, CASE WHEN {_BOTH_A} THEN ap / 100 ELSE 0 END AS a_rom_partial,
  {_jaccard(_W('a_addr'), _W('b_addr'))} AS a_tok_jacc_rom, {_jaccard('a_nums', 'b_nums')} AS a_num_jacc, (len(list_intersect(a_pins, b_pins)) > 0)::INT AS a_pin_match, (len(a_pins) > 0 AND len(b_pins) > 0 AND len(list_intersect(a_pins, b_pins)) = 0)::INT AS a_pin_conflict,
  (a_country <> '' AND a_country = b_country)::INT AS c_eq, (NOT ({_BOTH_N}))::INT AS n_missing, (NOT ({_BOTH_A}))::INT AS a_missing, ({_BOTH_A} AND a_house <> '' AND a_house = b_house)::INT AS a_house_eq, ({_BOTH_A} AND a_house <> '' AND b_house <> '' AND a_house <> b_house)::INT AS a_house_conflict,
  ({_BOTH_A} AND len(list_intersect(a_streets, b_streets)) > 0)::INT AS a_street_overlap, CASE WHEN {_BOTH_A} THEN ab / 100 ELSE 0 END AS a_abbr_tset, {_jaccard(_W('a_full_'), _W('b_full_'))} AS a_abbr_jacc FROM cs JOIN m USING (rec, s1))
SELECT rec, s1, round(COLUMNS(* EXCLUDE (rec, s1))::DOUBLE, 6) FROM o""")
def classic_base_features(t):
    sides = _classic_sides(t)[1]
    found = classic.base_features(sides)
    return rounded(found.select("rec", "s1", *[c for c in found.columns if c not in sides.columns]))


@query(f", {_SIDES} SELECT id, country, name, name AS rom, addr, addr AS addr_rom, raw, core, legal, canon FROM side")
def preprocessed_records(t):
    return _classic_sides(t)[0]


@query(f", {_SIDES} SELECT id, canon FROM side")
def canonical_addresses(t):
    return _classic_sides(t)[0].select("id", "canon")


@query(f", {_SIDES} SELECT id, full_ AS unified, house, array_to_string(list_sort(streets), ' ') AS streets FROM side2")
def address_parts(t):
    p = classic.address_parts(F.col("addr"))
    return _classic_sides(t)[0].select("id", p.alias("p")).select("id", F.col("p.text").alias("unified"), "p.house", F.array_join(F.array_sort("p.streets"), " ").alias("streets"))


# ---- weighted similarities ---------------------------------------------------------------------------------------------
def _grams(x: str) -> str:
    return f"list_distinct(flatten(list_transform({_words(x)}, lambda w: list_transform(range(1, greatest(length(w), 1) + 1), lambda i: substr(' ' || w || ' ', i, 3)))))"


def _weighted_scores(name: str, source: str, column: str, grams: bool) -> str:
    """CTEs ending in <name>(rec, s1, cos_, jac): cosine and Jaccard by idf of a country's distinct texts."""
    tokens = _grams if grams else (lambda x: f"list_distinct({_words(x)})")
    n = name
    return f"""
{n}t AS (SELECT DISTINCT country, {source} AS text FROM side2 WHERE {source} <> ''), {n}n AS (SELECT country, count(*) AS n FROM {n}t GROUP BY country),
{n}d AS (SELECT country, token, count(*) AS df FROM (SELECT country, unnest({tokens('text')}) AS token FROM {n}t) GROUP BY ALL), {n}i AS (SELECT country, token, ln((1 + n) / (1 + df)) + 1 AS idf FROM {n}d JOIN {n}n USING (country)),
{n}p AS (SELECT rec, s1, a_country AS country, {tokens('a_' + column)} AS x, {tokens('b_' + column)} AS y FROM cs), {n}e AS (SELECT rec, s1, country, x, y, unnest(list_distinct(x || y)) AS token FROM {n}p),
{n}s AS (SELECT rec, s1, sum(CASE WHEN list_contains(x, token) AND list_contains(y, token) THEN idf * idf ELSE 0 END) AS d, sum(CASE WHEN list_contains(x, token) THEN idf * idf ELSE 0 END) AS p, sum(CASE WHEN list_contains(y, token) THEN idf * idf ELSE 0 END) AS q,
  sum(CASE WHEN list_contains(x, token) AND list_contains(y, token) THEN idf ELSE 0 END) AS i, sum(idf) AS u FROM {n}e JOIN {n}i USING (country, token) GROUP BY rec, s1),
{n} AS (SELECT rec, s1, CASE WHEN p * q > 0 THEN d / sqrt(p * q) ELSE 0 END AS cos_, CASE WHEN u > 0 THEN i / u ELSE 0 END AS jac FROM {n}s)"""


_GATE = lambda a, b, v: f"CASE WHEN {a} <> '' AND {b} <> '' THEN {v} ELSE 0::DOUBLE END"
_LEV = lambda a, b: f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1::DOUBLE ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"
_PART = "trim(regexp_replace(lower(p), '[^0-9a-z]+', ' ', 'g'))"


def _components(raw: str) -> str:
    return f"list_distinct(list_filter(list_transform(string_split(coalesce({raw}, ''), ','), lambda p: {_canonical(_PART, 'a_country')}), lambda x: x <> ''))"


@query(f""", {_SIDES}, {_weighted_scores("nc", "name", "name", True)}, {_weighted_scores("nw", "name", "name", False)}, {_weighted_scores("ac", "canon", "canon", True)}, {_weighted_scores("aw", "canon", "canon", False)},
{measures("cs", {"lcs_": ("lcs", "a_name", "b_name"), "tc": ("set", "a_core", "b_core"), "ta": ("set", "a_canon", "b_canon")})},
k AS (SELECT *, {_components('a_raw')} AS ka, {_components('b_raw')} AS kb FROM cs),
o AS (SELECT k.rec, k.s1, coalesce(nc.cos_, 0) AS n_tfidf_char, coalesce(nw.cos_, 0) AS n_tfidf_word, coalesce(nw.jac, 0) AS n_idf_jacc, coalesce(ac.cos_, 0) AS a_tfidf_char, coalesce(aw.cos_, 0) AS a_tfidf_word, coalesce(aw.jac, 0) AS a_idf_jacc,
  {_GATE('a_name', 'b_name', _LEV('a_name', 'b_name'))} AS n_lev_rom, {_GATE('a_name', 'b_name', 'lcs_::DOUBLE / greatest(length(a_name), length(b_name))')} AS n_lcs_rom, {_GATE('a_core', 'b_core', '1 - damerau_levenshtein(a_core, b_core)::DOUBLE / greatest(length(a_core), length(b_core))')} AS n_osa_core,
  {_GATE('a_core', 'b_core', 'jaro_winkler_similarity(a_core, b_core)')} AS n_jw_core, {_GATE('a_core', 'b_core', 'tc / 100')} AS n_tset_core, {_jaccard(_grams('a_name'), _grams('b_name'))} AS n_char3_jacc, {_GATE('a_canon', 'b_canon', _LEV('a_canon', 'b_canon'))} AS a_lev_canon,
  {_GATE('a_canon', 'b_canon', 'ta / 100')} AS a_tset_canon, {_jaccard(_grams('a_canon'), _grams('b_canon'))} AS a_char3_jacc, {_jaccard('ka', 'kb')} AS a_comp_jacc, CASE WHEN len(ka) > 0 AND len(kb) > 0 THEN len(list_intersect(ka, kb))::DOUBLE / least(len(ka), len(kb)) ELSE 0 END AS a_comp_cov
  FROM k JOIN m USING (rec, s1) LEFT JOIN nc USING (rec, s1) LEFT JOIN nw USING (rec, s1) LEFT JOIN ac USING (rec, s1) LEFT JOIN aw USING (rec, s1))
SELECT rec, s1, round(COLUMNS(* EXCLUDE (rec, s1))::DOUBLE, 6) FROM o""")
def classic_extra_features(t):
    r, sides = _classic_sides(t)
    idfs = {(f, g): scratch.table(classic.country_idf(r.select("country", F.col(c).alias("text")), g), "idf") for f, c in (("n", "rom"), ("a", "canon")) for g in (True, False)}
    found = classic.extra_features(sides, idfs)
    return rounded(found.select("rec", "s1", *[c for c in found.columns if c not in sides.columns]))


# ---- decoys and ambiguity ------------------------------------------------------------------------------------------------
_HOUSE = lambda x: rf"regexp_extract_all(regexp_extract({x}, '\d+(?:[/-]\d+)*[a-z]?'), '\d+')"
_DIG = lambda x: rf"regexp_extract_all({x}, '\d+')"
_LEGAL = lambda x: f"list_distinct(list_transform({_words(x)}, lambda w: coalesce({_map(classic.LEGAL_LONG)}[w], w)))"
_COUNT = lambda x, l: f"len(list_filter({l}, lambda y: y = {x}))"  # noqa: E731, E741


@query(f""", {_SIDES}, {measures("cs", {"cn": ("set", "a_core", "b_core"), "ca": ("set", "a_full_", "b_full_")})},
voc AS (SELECT token AS word, count(*) AS n FROM (SELECT unnest({_words('core')}) AS token FROM side2) GROUP BY token), freq AS (SELECT core, count(*) AS n FROM side2 WHERE id < 20000000000 AND core <> '' GROUP BY core),
d AS (SELECT *, {_HOUSE('a_addr')} AS h1, {_HOUSE('b_addr')} AS h2, {_DIG('a_addr')} AS m1, {_DIG('b_addr')} AS m2, {_LEGAL('a_legal')} AS l1, {_LEGAL('b_legal')} AS l2, {_words('a_core')} AS t1, {_words('b_core')} AS t2 FROM cs),
e AS (SELECT *, len(h1) > 0 AND len(h2) > 0 AS both_, len(h1) > 0 AND len(h1) = len(h2) AND h1[1:len(h1) - 1] = h2[1:len(h2) - 1] AS alike, list_filter(range(1, greatest(len(t1), len(t2)) + 1), lambda i: t1[i] IS DISTINCT FROM t2[i]) AS apart FROM d),
g AS (SELECT *, CASE WHEN alike THEN abs(h1[len(h1)]::DOUBLE - h2[len(h2)]::DOUBLE) END AS delta, CASE WHEN len(t1) = len(t2) AND len(t1) >= 2 AND len(apart) = 1 THEN t1[apart[1]] END AS x, CASE WHEN len(t1) = len(t2) AND len(t1) >= 2 AND len(apart) = 1 THEN t2[apart[1]] END AS y FROM e),
o AS (SELECT rec, s1, delta AS d_house_delta, coalesce(delta > 0 AND delta <= 10, false)::INT AS d_house_off_small, CASE WHEN both_ THEN coalesce(list_sum(list_transform(list_distinct(m1 || m2), lambda v: abs({_COUNT('v', 'm1')} - {_COUNT('v', 'm2')}))), 0) ELSE 0 END AS d_num_mismatch,
  (x IS NOT NULL)::INT AS d_one_word_swap, coalesce(vx.n >= 20 AND vy.n >= 20 AND {_LEV('x', 'y')} < 0.6, false)::INT AS d_swap_real_words, (len(l1) > 0 AND len(l2) > 0 AND list_sort(l1) <> list_sort(l2))::INT AS d_legal_conflict,
  (len(t2) = len(t1) + 1 AND len(list_filter(t1, lambda w: NOT list_contains(t2, w))) = 0)::INT AS d_extra_word, (len(t1) = len(t2) + 1 AND len(list_filter(t2, lambda w: NOT list_contains(t1, w))) = 0)::INT AS d_missing_word,
  abs(len(t1) - len(t2)) AS d_core_tok_diff, (len(l1) = 0 AND len(l2) > 0)::INT AS d_legal_added, (len(l1) > 0 AND len(l2) = 0)::INT AS d_legal_dropped, cn / 100 AS c_name, ca / 100 AS c_addr, (a_house <> '' AND a_house = b_house)::INT AS c_house,
  coalesce(fa.n, 0) AS amb_s1_core_freq, coalesce(fb.n, 0) AS amb_t_core_freq, (a_core <> '' AND a_core = b_core)::INT AS amb_core_eq
  FROM g JOIN m USING (rec, s1) LEFT JOIN voc vx ON vx.word = x LEFT JOIN voc vy ON vy.word = y LEFT JOIN freq fa ON fa.core = a_core LEFT JOIN freq fb ON fb.core = b_core)
SELECT rec, s1, round(COLUMNS(* EXCLUDE (rec, s1))::DOUBLE, 6) FROM o""")
def classic_decoy_features(t):
    r, sides = _classic_sides(t)
    found = classic.ambiguity_features(classic.pruner_features(classic.decoy_features(sides, names.token_table(r, "core").withColumnRenamed("token", "word"))), r.where("id < 20000000000"))
    return rounded(found.select("rec", "s1", *[c for c in found.columns if c not in sides.columns]))


@query(f""", g AS (SELECT id, unnest(flatten(list_transform({_words('core')}, lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)) || list_transform(range(1, length(w)), lambda i: substr(' ' || w || ' ', i, 4))))) AS feature FROM norm),
tf AS (SELECT id, feature, 1 + ln(count(*)) AS tf FROM g GROUP BY id, feature), df AS (SELECT feature, ln((1 + (SELECT count(*) FROM norm)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY feature)
SELECT id, feature, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)), 6) AS weight FROM tf JOIN df USING (feature)""")
def classic_ngram_rows(t):
    return rounded(classic.sublinear_rows(t.norm.select("id", F.col("core").alias("text"))), ("id", "feature"))
