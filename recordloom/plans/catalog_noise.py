"""Queries of the seeded noise, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import text
from recordloom.operators import synth
from recordloom.plans.catalog import _words, query


def _chance(key: str, purpose: str) -> str:
    return f"(('0x' || substr(md5({key} || '|{purpose}|0'), 1, 8))::BIGINT % {synth.STEPS} / {synth.STEPS})"


def _pick(key: str, purpose: str, n: str) -> str:
    return f"floor({_chance(key, purpose)} * {n})::INT"


def _typo(w: str, key: str) -> str:
    at = f"(1 + {_pick(key, 'place', f'greatest(length({w}) - 1, 1)')})"
    head, ch, tail = f"substr({w}, 1, {at} - 1)", f"substr({w}, {at}, 1)", f"substr({w}, {at} + 1)"
    kinds = f"CASE {_pick(key, 'kind', '4')} WHEN 0 THEN {head} || translate({ch}, '{synth.NEIGHBOURS[0]}', '{synth.NEIGHBOURS[1]}') || {tail} WHEN 1 THEN {head} || {tail} WHEN 2 THEN {head} || substr({tail}, 1, 1) || {ch} || substr({tail}, 2) ELSE {head} || {ch} || {ch} || {tail} END"
    return f"CASE WHEN length({w}) < 3 THEN {w} ELSE {kinds} END"


@query(f"SELECT p_partkey, {_typo("p_name", "(p_partkey::VARCHAR)")} AS typed FROM part")
def typing_errors(t):
    return t.table("part").select("p_partkey", synth.typo(F.col("p_name"), F.col("p_partkey")).alias("typed"))


_LAST = r"lower(regexp_extract(name, '(\w+)\W*$', 1))"
_FORMS = ", ".join(f"'{k}'" for k in text.LEGAL_FORMS)
_REST = rf"CASE WHEN {_LAST} IN ({_FORMS}) THEN trim(regexp_replace(name, '\s*\w+\W*$', '')) ELSE name END"


def _noisy(source: str, level: float, key: str) -> str:
    """CTEs ending in noisy(id, k, name, addr, country, ...): every record of source once, with noise."""
    hit = lambda what, p: f"{_chance('k', what)} < {min(1.0, p * level)!r}"
    return rf"""
z0 AS (SELECT *, {key} AS k FROM {source}),
z1 AS (SELECT *, {_REST} AS rest, CASE WHEN {_LAST} IN ({_FORMS}) THEN {_LAST} ELSE '' END AS legal FROM z0),
z2 AS (SELECT *, {_words('rest')} AS parts FROM z1), z3 AS (SELECT *, {_pick('k', 'word', 'greatest(len(parts), 1)')} AS nth FROM z2),
z4 AS (SELECT *, CASE WHEN {hit('drop', 0.10)} AND len(parts) > 2 THEN list_filter(parts, lambda x, i: i - 1 <> nth) ELSE parts END AS dropped FROM z3),
z5 AS (SELECT *, CASE WHEN {hit('swap', 0.06)} AND len(dropped) > 1 THEN dropped[2:2] || dropped[1:1] || dropped[3:] ELSE dropped END AS swapped FROM z4),
z6 AS (SELECT *, swapped[1] AS first FROM z5), z7 AS (SELECT *, CASE WHEN {hit('typo', 0.25)} AND len(swapped) > 0 THEN [{_typo('first', 'k')}] || swapped[2:] ELSE swapped END AS typed FROM z6),
z8 AS (SELECT *, CASE WHEN {hit('glue', 0.05)} THEN array_to_string(typed, '') ELSE array_to_string(typed, ' ') END AS joined FROM z7),
z9 AS (SELECT *, CASE WHEN {hit('site', 0.03)} THEN 'www.' || lower(replace(joined, ' ', '')) || '.com' WHEN {hit('alias', 0.04)} THEN {_words('name')}[1] || ' dba ' || joined ELSE joined END AS shown,
  CASE WHEN {hit('legal', 0.3)} THEN '' WHEN {hit('other', 0.1)} THEN 'llc' ELSE legal END AS form, string_split(addr, ', ') AS pieces FROM z8),
noisy AS (SELECT id, k, name AS said, addr AS place, country, rest, trim(shown || ' ' || form) AS name,
  CASE WHEN {hit('lost', 0.05)} THEN '' ELSE regexp_replace(array_to_string(CASE WHEN {hit('cut', 0.15)} AND len(pieces) > 1 THEN pieces[1:len(pieces) - 1] ELSE pieces END, ', '), '(?i)street', CASE WHEN {hit('short', 0.4)} THEN 'St' ELSE 'Street' END, 'g') END AS addr FROM z9)"""


@query(f", {_noisy("s1", 1.0, "id::VARCHAR")} SELECT id, name, addr FROM noisy")
def noisy_texts(t):
    key = F.col("id").cast("string")
    return t.s1.select("id", synth.noisy_name(F.col("name"), key).alias("name"), synth.noisy_address(F.col("addr"), key).alias("addr"))


_HOUSE = rf"regexp_replace(place, '^(\D*)\d+', '\1' || (1 + {_pick('k', 'house', '9000')}))"


@query(f", {_noisy("s1", 1.0, "id::VARCHAR")} SELECT id, {_HOUSE} AS addr FROM noisy")
def changed_houses(t):
    return t.s1.select("id", synth.change_house(F.col("addr"), F.col("id").cast("string")).alias("addr"))


@query(f", {_noisy("s1", 1.6, "(id::VARCHAR || '/3')")} SELECT 30000000000 + 2 * id AS id, 3 AS src, name, addr, country, id AS s1 FROM noisy UNION ALL SELECT 30000000000 + 2 * id + 1, 3, rest || ' llc', {_HOUSE}, country, -1 FROM noisy WHERE {_chance('k', 'decoy')} < 0.6")
def noisy_records(t):
    return synth.noisy_records(t.s1, 3, 1.6, 0.6).withColumn("src", F.col("src").cast("int"))
