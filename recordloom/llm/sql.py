"""DuckDB SQL for the queries that SQL can express."""

from recordloom.llm import audit, chat, codes, quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_REPEATS = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 49] AS s FROM d, unnest(range(1, octet_length(b) - 48)) u(i)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE w.doc_id > f.first),
g AS (SELECT doc_id, i, CASE WHEN i > 50 + lag(i, 1, -999) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM c),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
p AS (SELECT doc_id, span, min(i) AS a, max(i) + 49 AS z FROM n GROUP BY doc_id, span),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1 AS from_byte FROM p),
t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed, max(z) AS last_byte,
        string_agg(CASE WHEN a > from_byte THEN hex(b[from_byte:a - 1]) ELSE '' END, '' ORDER BY a) AS head FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || CASE WHEN octet_length(b) > coalesce(last_byte, 0) THEN hex(b[coalesce(last_byte, 0) + 1:octet_length(b)]) ELSE '' END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

_ESCAPE = r"regexp_replace(regexp_replace(regexp_replace({0}, '\\', '\\\\', 'g'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST)', '[\\\1', 'g')"

_CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
    len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]')) + 4 AS tokens,
    length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")}) + {len(chat.OPEN + chat.CLOSE + chat.END)} AS chars FROM t),
b AS (SELECT *, pos = 1 AND role = 'system' AS lead FROM a),
c AS (SELECT *, CASE WHEN lead THEN 0 ELSE tokens END AS cost FROM b),
d AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
r AS (SELECT *, greatest({chat.BUDGET - chat.HISTORY} - coalesce(max(tokens) FILTER (WHERE lead) OVER (PARTITION BY conv_id), 0), {chat.BUDGET // 4}) AS room FROM d),
e AS (SELECT *, CASE WHEN lead THEN 0 ELSE start // room END AS home FROM r),
c2 AS (SELECT *, 2 * home + (NOT lead AND start + cost > (home + 1) * room AND sum(cost) OVER (PARTITION BY conv_id, home) > room)::INT AS cut FROM e),
f AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY cut) - 1 AS w FROM c2),
win AS (SELECT conv_id, w, min(start) AS from_token FROM f GROUP BY conv_id, w),
extra AS (
  SELECT f.conv_id, sum(f.chars) AS chars FROM f JOIN win ON win.conv_id = f.conv_id
    AND ((f.lead AND win.w > 0) OR (NOT f.lead AND win.w = f.w + 1 AND f.start + f.cost - f.tokens >= win.from_token - {chat.HISTORY})) GROUP BY f.conv_id),
g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars, max(w) + 1 AS n_windows FROM f GROUP BY conv_id)
SELECT g.conv_id, g.n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (g.chars + coalesce(extra.chars, 0))::BIGINT AS formatted_chars, n_windows::BIGINT AS n_windows
FROM g LEFT JOIN extra USING (conv_id)
"""


def _quality() -> str:
    share = quality.ALPHA / len(quality.RULES)
    tests = [(k, c) for k, grid in quality.RULES.items() for c in grid]
    values = ", ".join(f"({i}, '{k}', {c})" for i, (k, c) in enumerate(tests))
    return rf"""
WITH words AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
rows AS (SELECT row_number() OVER () AS r, * FROM words),
five AS (SELECT r, i, w[i:i + 4] AS s FROM rows, unnest(range(1, len(w) - 3)) u(i)),
twice AS (SELECT r, s FROM five GROUP BY r, s HAVING count(*) > 1),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM five JOIN twice USING (r, s), range(5) q(k) GROUP BY r),
stats AS (
  SELECT r, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM rows LEFT JOIN hit USING (r)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    1000 * n_symbols // greatest(n_words, 1) AS symbol_rate, 1000 * n_dup_lines // greatest(n_words, 1) AS dup_line_rate,
    1000 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate FROM stats),
long_form AS (UNPIVOT base ON symbol_rate, dup_line_rate, word_length, repeat_rate INTO NAME rule VALUE v),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
tests(nth, rule, cut) AS (VALUES {values}),
counts AS (
  SELECT lang, nth, l.rule, cut, count(*) AS n, count(*) FILTER (WHERE v > cut) AS x
  FROM long_form l SEMI JOIN good USING (doc_id) JOIN tests ON tests.rule = l.rule WHERE NOT base_failed GROUP BY lang, nth, l.rule, cut),
level AS (SELECT {quality.DELTA} / (count(DISTINCT coalesce(lang, '~null')) * {len(tests)}) AS level FROM counts),
tail AS (
  SELECT lang, rule, cut, nth, CASE WHEN x >= n * {share} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({share}) + (n - k) * ln({1 - share}))) FROM range(0, x + 1) q(k)) END AS p FROM counts),
cuts AS (SELECT lang, rule, arg_min(cut, nth) AS cut FROM tail, level WHERE p <= level GROUP BY lang, rule),
broken AS (SELECT DISTINCT r FROM long_form l JOIN cuts ON cuts.rule = l.rule AND cuts.lang IS NOT DISTINCT FROM l.lang WHERE v > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken.r IS NULL AS kept
FROM base LEFT JOIN broken USING (r)
"""


_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM w, unnest(range(1, greatest(len(w) - 3, 2))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have.n >= 85 * (x.n + y.n - both_have.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
c AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""



def _audit() -> str:
    orders = ", ".join(f"('{o}')" for o in audit.ORDERS)
    bit = "(1 << (ascii({0}) - 65))"
    return rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
told AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w LEFT JOIN told USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
o(filter_order) AS (VALUES {orders}),
s AS (
  SELECT filter_order, step::INTEGER AS step, {bit.format("filter_order[step]")} AS own,
    coalesce((SELECT sum({bit.format("filter_order[k]")}) FROM range(1, step) q(k)), 0)::BIGINT AS before FROM o, range(1, 6) u(step)),
r AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (WHERE mask & (before | own) = 0) AS kept, sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS removed,
    sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0) AS redundant, sum(n) FILTER (WHERE mask = own) AS unique_fails,
    sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS good_lost, sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM r
"""


def _codes() -> str:
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = lambda k: f"a{k} AS (SELECT r, p.part, arg_min(entry, {far} * {codes.ENTRIES} + entry) AS entry, min({far}) AS d FROM p JOIN b{k} USING (part) GROUP BY r, p.part)"
    update = lambda k: f"""g{k} AS (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{k} JOIN p USING (r, part), range(1, len(x) + 1) u(i) GROUP BY part, entry, i),
m{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM g{k} GROUP BY part, entry),
b{k + 1} AS (SELECT part, entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry))"""  # noqa: E731
    rounds = ",\n".join(f(k) for k in range(codes.ROUNDS) for f in (assign, update))
    return rf"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, e[part * (len(e) // {codes.PARTS}) + 1:(part + 1) * (len(e) // {codes.PARTS})] AS x FROM v, range({codes.PARTS}) u(part)),
b0 AS (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {codes.ENTRIES}),
{rounds},
{assign(codes.ROUNDS)},
done AS (SELECT r, string_agg(lpad(printf('%x', entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{codes.ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{codes.ROUNDS}) AS codebooks_sha256
FROM v JOIN done USING (r)
"""


ORACLES = {"op3_repeats": _REPEATS, "op5_chat": _CHAT, "op6_quality": _quality(), "op7_minhash": _NEAR, "op12_audit": _audit(), "op13_codes": _codes()}
