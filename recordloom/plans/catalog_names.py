"""Queries of name cleaning, repair, languages and failure patterns, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import text
from recordloom.operators import classic, names, profile, reports
from recordloom.plans.catalog import _SCRIPTED, _basic, _collapsed, _split, _words, query, short
from recordloom.plans.catalog_pairs import measures
from recordloom.sources import scratch


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


_PLAIN = "trim(regexp_replace(lower(replace(name, '&', ' and ')), '[^0-9a-z]+', ' ', 'g'))"
_IN = lambda ws: ", ".join(f"'{w}'" for w in ws)
_ONE = "regexp_full_match(w[i], '[a-z]') AND regexp_full_match(w[i - 1], '[a-z]')"
_CANON = f"""
c0 AS (SELECT id, {_words(_PLAIN)} AS w FROM records),
c1 AS (SELECT id, {_words(f"array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 THEN '' WHEN {_ONE} THEN '' ELSE ' ' END || w[i]), '')")} AS w FROM c0),
c2 AS (SELECT id, list_transform(w, lambda x: coalesce({_map(names.ABBREVIATIONS)}[x], x)) AS w FROM c1),
c3 AS (SELECT id, w, list_filter(w, lambda x, i: NOT regexp_full_match(x, '\\d{{4,}}') AND NOT (x IN ('id', 'no') AND coalesce(regexp_full_match(w[i + 1], '\\d{{4,}}'), false))) AS v FROM c2),
c4 AS (SELECT id, CASE WHEN len(v) > 0 THEN v ELSE w END AS t FROM c3),
c5 AS (SELECT id, t, coalesce(list_max(list_transform(t, lambda x, i: CASE WHEN x NOT IN ({_IN(names.LEGAL_WORDS)}) THEN i END)), 0) AS kept FROM c4),
c6 AS (SELECT *, list_filter(t, lambda x, i: i <= kept AND x NOT IN ({_IN(names.STOPWORDS)})) AS head FROM c5),
c7 AS (SELECT *, list_filter(head, lambda x: x NOT IN ({_IN(names.LEGAL_WORDS)})) AS bare FROM c6),
canon AS (SELECT id, array_to_string(t, ' ') AS c4a, array_to_string(CASE WHEN len(bare) > 0 THEN bare WHEN len(head) > 0 THEN head ELSE t END, ' ') AS c4b, array_to_string(list_filter(t, lambda x, i: i > kept), ' ') AS legal FROM c7)"""


@query(f", {_CANON} SELECT id, c4a, c4b, legal FROM canon")
def canonical_names(t):
    plain = t.records.select("id", classic.normalize_name(F.col("name")).alias("name"))
    return plain.select("id", names.canonical_keys(F.col("name")).alias("k")).select("id", "k.c4a", "k.c4b", "k.legal")


_VOCABULARY = f"v AS (SELECT token AS word, count(*) AS n FROM (SELECT unnest({_words('core')}) AS token FROM norm WHERE src = 1) GROUP BY token)"


def _vocabulary(t):
    return names.token_table(_split(t)[0], "core").withColumnRenamed("token", "word")


_MISREAD = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.OCR.items()) + " ELSE '' END"


@query(f""", {_VOCABULARY}, g AS (SELECT DISTINCT unnest([replace(word, 'o', '0'), replace(word, 's', '5'), translate(word, 'il', 'li'), replace(replace(word, 'i', '1'), 'e', '3')]) AS token FROM v),
o AS (SELECT token FROM g WHERE length(token) >= 3 AND regexp_matches(token, '[0-9li]') AND NOT regexp_matches(token, '^\\d+$|\\d\\d') AND token NOT IN (SELECT word FROM v)
  AND power(2, length(regexp_replace(token, '[^023456789li]', '', 'g'))) * power(3, length(regexp_replace(token, '[^1]', '', 'g'))) <= 256),
c AS (SELECT token, word, n FROM o JOIN v ON length(token) = length(word) WHERE len(list_filter(range(1, length(token) + 1), lambda i: NOT (token[i] = word[i] OR contains({_MISREAD.format('token[i]')}, word[i])))) = 0)
SELECT token, arg_min(word, (-n, word)) AS fixed FROM c GROUP BY token""")
def ocr_repairs(t):
    vocabulary = scratch.table(_vocabulary(t), "vocabulary")
    w = F.col("word")
    noisy = F.array(F.replace(w, F.lit("o"), F.lit("0")), F.replace(w, F.lit("s"), F.lit("5")), F.translate(w, "il", "li"), F.replace(F.replace(w, F.lit("i"), F.lit("1")), F.lit("e"), F.lit("3")))
    return names.ocr_fixes(vocabulary.select(F.explode(noisy).alias("token")).distinct(), vocabulary)


_EXCHANGED = _IN([a + b for a, b in names.OCR_PAIRS] + [b + a for a, b in names.OCR_PAIRS])


@query(f""", {_VOCABULARY}, o AS (SELECT DISTINCT token FROM (SELECT unnest({_words('core')}) AS token FROM norm WHERE src = 2) WHERE length(token) >= 4 AND NOT regexp_full_match(token, '\\d+') AND token NOT IN (SELECT word FROM v)),
d AS (SELECT token, word, n, {_collapsed('token')} = {_collapsed('word')} AS u, levenshtein(token, word) AS e, CASE WHEN length(token) = length(word) THEN list_filter(range(1, length(token) + 1), lambda i: token[i] <> word[i]) END AS apart
  FROM o JOIN v ON length(word) >= 3 AND regexp_full_match(word, '[a-z]+')),
k AS (SELECT *, CASE WHEN u THEN 0.3::DOUBLE WHEN len(apart) <= 2 AND len(list_filter(apart, lambda i: (token[i] || word[i]) NOT IN ({_EXCHANGED}))) = 0 THEN 0.3::DOUBLE * len(apart)
  WHEN len(apart) = 2 AND token[apart[1]:apart[1] + 1] = reverse(word[apart[1]:apart[1] + 1]) THEN 0.5::DOUBLE ELSE e END AS noise FROM d WHERE u OR e <= 2),
r AS (SELECT *, row_number() OVER w AS nth, lead(noise - 0.15::DOUBLE * ln(n)) OVER w AS nxt FROM k WINDOW w AS (PARTITION BY token ORDER BY noise - 0.15::DOUBLE * ln(n), word))
SELECT token, word AS fixed FROM r WHERE nth = 1 AND noise <= CASE WHEN length(token) < 8 THEN 1 ELSE 2 END AND coalesce(nxt, 1e9) - (noise - 0.15::DOUBLE * ln(n)) >= 0.3""")
def token_repairs(t):
    return names.token_repairs(names.token_table(_split(t)[1], "core"), _vocabulary(t))


@query("SELECT id, left(coalesce(name, ''), 120) || ' | ' || left(coalesce(addr, ''), 120) AS shown FROM records")
def display_texts(t):
    return t.records.select("id", text.display_text(F.col("name"), F.col("addr")).alias("shown"))


def _misread(c):
    """UTF-8 read as Latin-1."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def repaired_texts(t):
    return t.table("documents").select("doc_id", F.md5(classic.repair(_misread(F.col("text"))).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def reread_texts(t):
    return t.table("documents").select("doc_id", F.md5(text.reread_as_utf8(_misread(F.col("text"))).cast("binary")).alias("digest"))


_LANGUAGES = {"Bengali": "bn", "Gurmukhi": "pa", "Gujarati": "gu", "Oriya": "or", "Tamil": "ta", "Telugu": "te", "Kannada": "kn", "Malayalam": "ml", "Latin": "en"}
_COUNTS = ", ".join("len(regexp_extract_all(coalesce(name, ''), '\\p{" + k + "}')) AS " + k for k in text.SCRIPTS)
_BY_SCRIPT = f"""v AS ({_SCRIPTED}), c AS (SELECT id, {_COUNTS} FROM v), m AS (SELECT *, {' + '.join(text.SCRIPTS)} AS every, greatest({', '.join(text.SCRIPTS)}) AS most FROM c),
s AS (SELECT id, CASE WHEN every = 0 THEN 'none' {' '.join(f"WHEN {k} = most THEN '{k}'" for k in text.SCRIPTS)} END AS script FROM m), l AS (SELECT id, script, {_map(_LANGUAGES)}[script] AS lang FROM s)"""


def _scripted(t):
    t.records.createOrReplaceTempView("records")
    return t.spark.sql(_SCRIPTED)


@query(f", {_BY_SCRIPT} SELECT id, script, lang FROM l")
def languages_by_script(t):
    return names.language_info(_scripted(t), "name").select("id", "script", "lang")


@query(f", {_BY_SCRIPT} SELECT id, CASE WHEN id % 10 / 10 >= 0.5 AND id % 3 < 2 THEN CASE id % 3 WHEN 0 THEN 'hi' ELSE 'mr' END ELSE lang END AS lang FROM l")
def resolved_languages(t):
    known = names.language_info(_scripted(t), "name")
    model = F.when(F.col("id") % 3 == 0, "hi").when(F.col("id") % 3 == 1, "mr").otherwise("xx")
    return known.select("id", names.resolve_language(F.col("lang"), model, (F.col("id") % 10) / 10, F.array(F.lit("hi"), F.lit("mr"))).alias("lang"))


_INDIC_TOKENS = f"v AS ({_SCRIPTED}), tok AS (SELECT DISTINCT unnest({_words('name')}) AS token FROM v WHERE id % 5 IN (1, 2)), cache AS (SELECT token, translate(token, 'कखगघचछजझটठঅআইঈউ', 'abcdefghijaeiou') AS roman FROM tok WHERE length(token) % 4 > 0)"


def _cache(t):
    """Spellings for most tokens of other scripts."""
    rows = _scripted(t).where("id % 5 IN (1, 2)").select(F.explode(text.words(F.col("name"))).alias("token")).distinct().where("length(token) % 4 > 0")
    return rows.select("token", F.translate("token", "कखगघचछजझটठঅআইঈউ", "abcdefghijaeiou").alias("roman"))


@query(f", {_INDIC_TOKENS} SELECT id, array_to_string(list_transform({_words('name')}, lambda w: CASE WHEN length(w) % 4 > 0 AND id % 5 IN (1, 2) THEN translate(w, 'कखगघचछजझটठঅআইঈউ', 'abcdefghijaeiou') ELSE w END), ' ') AS roman FROM v WHERE id % 5 IN (1, 2)")
def romanized_names(t):
    return names.romanize(_scripted(t).where("id % 5 IN (1, 2)"), "name", _cache(t), "roman").select("id", "roman")


@query(f", {_INDIC_TOKENS}, n AS (SELECT token, count(*) AS count FROM (SELECT unnest({_words('name')}) AS token FROM v) GROUP BY token) SELECT token, count FROM n WHERE regexp_matches(token, '[\\p{{Devanagari}}\\p{{Bengali}}\\p{{Gurmukhi}}\\p{{Gujarati}}\\p{{Oriya}}\\p{{Tamil}}\\p{{Telugu}}\\p{{Kannada}}\\p{{Malayalam}}]') AND token NOT IN (SELECT token FROM cache)")
def missing_tokens(t):
    return names.missing_tokens(_scripted(t), "name", _cache(t))


_SPELT = "name"
for _letter, _sound in zip("कखगघचछजझटठঅআইঈউ", ("k", "kh", "g", "gh", "c", "ch", "j", "jh", "tt", "tth", "a", "aa", "i", "ii", "u"), strict=True):
    _SPELT = f"replace({_SPELT}, '{_letter}', '{_sound}')"


@query(f"WITH v AS ({_SCRIPTED}) SELECT id, {_basic(_SPELT)} AS plain FROM v WHERE id % 5 IN (1, 2)")
def spelt_scripts(t):
    return _scripted(t).where("id % 5 IN (1, 2)").select("id", text.basic(F.col("name")).alias("plain"))


_LETTERED = _SPELT.replace("replace(name,", "replace(r,")


@query(rf"""WITH v AS ({_SCRIPTED}), w AS (SELECT id, unnest({_words('name')}) AS w, generate_subscripts({_words('name')}, 1) AS p FROM v WHERE id % 5 IN (1, 2)),
r AS (SELECT id, p, unnest(rs) AS r, generate_subscripts(rs, 1) AS q FROM (SELECT id, p, regexp_extract_all(w, '[\p{{Devanagari}}]+|[\p{{Bengali}}]+|[^\p{{Devanagari}}\p{{Bengali}}]+') AS rs FROM w)),
s AS (SELECT *, CASE WHEN NOT regexp_matches(r, '[\p{{Devanagari}}\p{{Bengali}}]') THEN NULL WHEN length(r) = 1 THEN 'cache' WHEN length(r) = 2 THEN 'model' ELSE 'sound' END AS source FROM r),
t AS (SELECT *, CASE source WHEN 'cache' THEN translate(r, 'कखगघचछजझটठঅআইঈউ', 'abcdefghijaeiou') WHEN 'model' THEN concat('m', translate(r, 'कखगघचछजझটठঅআইঈউ', 'abcdefghijaeiou')) WHEN 'sound' THEN {_LETTERED} ELSE r END AS o FROM s),
f AS (SELECT id, string_agg(CASE WHEN q = 1 AND p > 1 THEN ' ' ELSE '' END || o, '' ORDER BY p, q) AS roman, string_agg(source, ',' ORDER BY p, q) AS sources FROM t GROUP BY id)
SELECT v.id, coalesce(roman, '') AS roman, coalesce(sources, '') AS sources FROM v LEFT JOIN f USING (id) WHERE v.id % 5 IN (1, 2)""")
def romanized_runs(t):
    """Names that mix scripts inside words: single letters are in the cache, pairs in the model's table, the rest goes by sound."""
    rows = scratch.table(_scripted(t).where("id % 5 IN (1, 2)"), "scripted")
    runs = rows.select(F.explode(text.words(F.col("name"))).alias("w")).select(F.explode(names.script_runs(F.col("w"))).alias("token")).distinct()
    roman = F.translate("token", "कखगघचछजझটठঅআইঈউ", "abcdefghijaeiou")
    other = runs.where(F.col("token").rlike(r"[\p{IsDevanagari}\p{IsBengali}]"))
    cache, model = other.where("length(token) = 1").select("token", roman.alias("roman")), other.where("length(token) = 2").select("token", F.concat(F.lit("m"), roman).alias("roman"))
    return names.romanize_runs(rows, "name", cache, model, "roman").select("id", "roman", F.array_join("roman_sources", ",").alias("sources"))


@query(rf""", {_VOCABULARY}, all_ AS (SELECT sum(n) AS total FROM v), g AS (SELECT DISTINCT token FROM (SELECT unnest({_words('glued')}) AS token FROM norm WHERE src = 2) WHERE length(token) >= 6 AND token NOT IN (SELECT word FROM v)),
h AS (SELECT g.token, i AS start, length(word) AS size, -ln(n / total) AS cost FROM g, range(1, length(token)) u(i), range(2, length(token) - i + 2) q(k), v, all_ WHERE substr(token, i, k) = word),
cuts AS (WITH RECURSIVE walk(token, pos, cost, said) AS (SELECT token, 1::BIGINT, 0.0::DOUBLE, '' FROM g UNION ALL SELECT w.token, w.pos + h.size, w.cost + h.cost, w.said || CASE WHEN w.pos > 1 THEN ' ' ELSE '' END || substr(w.token, w.pos, h.size) FROM walk w JOIN h ON h.token = w.token AND h.start = w.pos)
  SELECT token, said, cost FROM walk WHERE pos = length(token) + 1)
SELECT token, arg_min(said, cost) AS fixed FROM cuts GROUP BY token HAVING arg_min(said, cost) <> token""")
def segmented_words(t):
    tokens = _split(t)[1].select(F.explode(text.words(F.col("glued"))).alias("token")).distinct()
    return names.segmentations(tokens, scratch.table(_vocabulary(t), "vocabulary"))


_SK = lambda w: _collapsed(f"translate(lower({w}), 'aeiouyhw', '')")


@query(f""", {_VOCABULARY}, cache AS (SELECT DISTINCT 'x' || word AS token, replace(replace(word, 'ee', 'i'), 'oo', 'u') || CASE WHEN length(word) % 2 = 0 THEN 'a' ELSE '' END AS roman FROM v),
j AS (SELECT token, roman, word, n FROM cache JOIN v ON {_SK('roman')} = {_SK('word')}), {measures("j", {"r": ("ratio", "roman", "word")}, "token, roman, word, n", "q")},
b AS (SELECT token, arg_max(word, (r, n, word)) AS best FROM q WHERE r >= 80 GROUP BY token) SELECT cache.token, coalesce(best, roman) AS roman FROM cache LEFT JOIN b ON b.token = cache.token""")
def snapped_spellings(t):
    vocabulary = scratch.table(_vocabulary(t), "vocabulary")
    w = F.col("word")
    cache = vocabulary.select(F.concat(F.lit("x"), w).alias("token"), F.concat(F.replace(F.replace(w, F.lit("ee"), F.lit("i")), F.lit("oo"), F.lit("u")), F.when(F.length(w) % 2 == 0, "a").otherwise("")).alias("roman"))
    return names.snap_to_vocabulary(cache, vocabulary)


@query("SELECT id, upper(name) AS loud FROM records")
def mapped_values(t):
    return names.per_distinct(t.records.select("id", "name"), "name", F.upper, "loud").select("id", "loud")


_TITLE = "|".join(names.TITLES)


@query(rf""", d AS (SELECT id, regexp_replace(lower(coalesce(name, '')), '^.*?\b(?:dba|d b a|aka|a k a|doing business as|trading as|t a|also known as|formerly)\b\s*(\S)', '\1') AS s FROM records),
w AS (SELECT id, regexp_replace(regexp_replace(s, '^www[ .]|[ .](?:com|net|org|in|fr|biz)$', '', 'g'), '\bm/s\b\.?', ' ', 'g') AS s FROM d)
SELECT id, trim(regexp_replace(regexp_replace(trim(regexp_replace(s, '\s+', ' ', 'g')), '^(?:(?:{_TITLE})\.? )+', ''), '\s+', ' ', 'g')) AS cleaned FROM w""")
def cleaned_names(t):
    return t.records.select("id", names.clean_name(F.col("name")).alias("cleaned"))


# ---- patterns of what was lost ---------------------------------------------------------------------------------------
_PATTERNS = f""", {_CANON}, p AS (SELECT t.rec, t.s1, a.c4b AS a_core, b.c4b AS b_core, x.atok AS a_atok, y.atok AS b_atok, r.name AS b_name FROM truth t JOIN canon a ON a.id = t.s1 JOIN canon b ON b.id = t.rec JOIN norm x ON x.id = t.s1 JOIN norm y ON y.id = t.rec JOIN records r ON r.id = t.rec),
{measures("p", {"tset": ("set", "a_core", "b_core")})},
f AS (SELECT p.*, coalesce(tset, 0) AS tset, {_words('a_core')} AS wa, {_words('b_core')} AS wb, {_words('a_atok')} AS xa, {_words('b_atok')} AS xb FROM p JOIN m USING (rec, s1)),
g AS (SELECT *, CASE WHEN len(xa) = 0 OR len(xb) = 0 THEN 0 ELSE len(list_intersect(xa, xb))::DOUBLE / len(list_distinct(xa || xb)) END AS jac, a_core <> '' AND replace(a_core, ' ', '') = replace(b_core, ' ', '') AND len(wa) >= 2 AND len(wb) < len(wa) AS glued FROM f),
h AS (SELECT rec, s1, CASE WHEN b_core = '' THEN ['no name'] ELSE list_filter([CASE WHEN a_core = b_core THEN 'same name' END, CASE WHEN glued THEN 'words glued' END, CASE WHEN regexp_matches(b_core, '\\b(?:[a-z]+\\d+[a-z]+|\\d+[a-z]+\\d+)') THEN 'digits inside words' END,
  CASE WHEN tset >= 50 AND tset < 90 THEN 'part of the name' END, CASE WHEN tset < 30 THEN 'another name' END, CASE WHEN jac >= 0.5 THEN 'same address' END, CASE WHEN len(xb) = 0 THEN 'no address' END, CASE WHEN tset < 30 AND jac < 0.3 THEN 'nothing in common' END], lambda z: z IS NOT NULL) END AS labels FROM g)"""


def _lost(t):
    plain = t.records.select("id", classic.normalize_name(F.col("name")).alias("name"))
    keys = names.canonical_keys(F.col("name"))["c4b"]
    rows = scratch.table(plain.select("id", keys.alias("core")).join(t.norm.select("id", "atok"), "id"), "canonical")
    out = t.truth.where("rec >= 0").select("rec", "s1")
    for side, key in (("a", "s1"), ("b", "rec")):
        out = out.join(rows.select(F.col("id").alias(key), F.col("core").alias(f"{side}_core"), F.col("atok").alias(f"{side}_atok")), key)
    return out.withColumn("labels", reports.failure_patterns())


@query(f"{_PATTERNS} SELECT rec, s1, array_to_string(labels, '; ') AS labels, coalesce(labels[1], 'other') AS first FROM h")
def failure_patterns(t):
    return _lost(t).select("rec", "s1", F.array_join("labels", "; ").alias("labels"), F.coalesce(F.get("labels", F.lit(0)), F.lit("other")).alias("first"))


@query(f"{_PATTERNS}, u AS (SELECT unnest(labels) AS label FROM h) SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM h) AS share FROM u GROUP BY label")
def pattern_shares(t):
    return profile.label_shares(_lost(t), "labels")


@query(f"SELECT count(*) AS n, round(avg(x), 9) AS before, round(avg(y), 9) AS after, sum((y > x)::INT)::BIGINT AS gained, sum((y < x)::INT)::BIGINT AS lost FROM (SELECT CASE WHEN len(p) = 0 OR len(q) = 0 THEN 0 ELSE len(list_intersect(p, q))::DOUBLE / len(list_distinct(p || q)) END AS x, CASE WHEN len(r) = 0 OR len(s) = 0 THEN 0 ELSE len(list_intersect(r, s))::DOUBLE / len(list_distinct(r || s)) END AS y FROM (SELECT {_words('a.name')} AS p, {_words('b.name')} AS q, {_words('x.core')} AS r, {_words('y.core')} AS s FROM truth t JOIN records a ON a.id = t.s1 JOIN records b ON b.id = t.rec JOIN norm x ON x.id = t.s1 JOIN norm y ON y.id = t.rec))")
def normalisation_effect(t):
    out = t.truth.where("rec >= 0").select("rec", "s1")
    raw = t.records.select("id", "name").join(t.norm.select("id", "core"), "id")
    for side, key in (("a", "s1"), ("b", "rec")):
        out = out.join(raw.select(F.col("id").alias(key), F.col("name").alias(f"{side}_name"), F.col("core").alias(f"{side}_core")), key)
    found = reports.normalisation_effect(out, ("a_name", "b_name"), ("a_core", "b_core"))
    return found.select("n", short("before").alias("before"), short("after").alias("after"), "gained", "lost")
