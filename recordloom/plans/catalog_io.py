"""Queries of the scans, outputs and checks: tables written to the shared folder and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import ids
from recordloom.operators import decide, profile, reports, validate
from recordloom.plans.catalog import query, short
from recordloom.sources import scratch, sinks
from recordloom.sources import tables as sources


def _tsv_split(t) -> str:
    """A folder with train_source1.tsv and train_source2.tsv."""
    folder = scratch.new_path(t.spark, "split")
    for src, rows in ((1, t.s1), (2, t.rec)):
        out = rows.select(ids.decode_id(F.col("id")).alias("entity_id"), F.col("name").alias("business_name"), F.col("addr").alias("business_address"), "country")
        sinks.write_tsv(out, f"{folder}/train/train_source{src}.tsv")
    return folder


@query("SELECT id, src::INT AS src, name, addr, country FROM records")
def split_of_files(t):
    return sources.load_split(t.spark, _tsv_split(t), "train", (1, 2)).withColumn("src", F.col("src").cast("int"))


@query("SELECT 'train' AS split, unnest([1, 2]) AS source")
def discovered_files(t):
    return sources.split_files(t.spark, _tsv_split(t)).select("split", "source")


@query("SELECT 'S1-' || id AS id FROM s1")
def first_column_ids(t):
    return sources.first_column_ids(sources.read_tsv(t.spark, f"{_tsv_split(t)}/train/train_source1.tsv"))


@query("SELECT count(*) AS n FROM (SELECT * FROM s1 LIMIT 50)")
def limited_scan(t):
    return sources.read_tsv(t.spark, f"{_tsv_split(t)}/train/train_source1.tsv", limit=50).agg(F.count("*").alias("n"))


@query("SELECT id, id % 10 = 0 AS odd FROM s1")
def checked_scan(t):
    path = scratch.new_path(t.spark, "lines")
    line = F.when(F.col("id") % 10 == 0, F.concat_ws("\t", F.col("id").cast("string"), "name")).otherwise(F.concat_ws("\t", F.col("id").cast("string"), "name", "addr", "country"))
    t.s1.select(line.alias("value")).write.text(path)
    rows = sources.read_tsv_checked(t.spark, path, header=False)
    return rows.select(F.col("entity_id").cast("long").alias("id"), F.col("bad_line").isNotNull().alias("odd"))


@query("SELECT s1, rec FROM truth")
def truth_of_files(t):
    path = scratch.new_path(t.spark, "truth")
    lists = sinks.grouped_lists(t.truth.where("rec >= 0"), t.truth.select("s1"))
    sinks.write_tsv(lists.toDF(*sources.TRUTH_COLUMNS), path)
    return sources.load_truth(t.spark, path)


@query("SELECT word, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def counted_words(t):
    path = scratch.new_path(t.spark, "words")
    counts = t.table("part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    lines = counts.select(F.concat_ws("\t", "word", F.col("count").cast("string")).alias("value"))
    lines.unionAll(t.spark.createDataFrame([("cut",)], "value string")).write.text(path)  # a line that was cut off
    return sources.word_counts(t.spark, path)


@query("SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def best_of_part_files(t):
    path = scratch.new_path(t.spark, "parts")
    rows = t.table("events").select("user_id", "event_type", "value", "event_id")
    for k in range(3):
        rows.where(F.col("event_id") % 3 <= k).write.parquet(f"{path}/a{k}/b")
    return sources.best_of_parts(t.spark, path, ["user_id", "event_type"], "value").select("user_id", "event_type", "value", "event_id")


@query("SELECT s1, rec, p, 2 AS src FROM scored WHERE ('0x' || substr(md5(cast(s1 AS string) || '|sample'), 1, 8))::BIGINT % 10000 < 3000")
def sampled_candidates(t):
    path = scratch.new_path(t.spark, "candidates")
    t.scored.select("s1", "rec", "p").write.parquet(f"{path}/part-US-0")
    return sources.sampled_candidates(t.spark, path, 0.3)


_COUNTED = ("region", "nation", "customer", "part", "orders", "lineitem")


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM {k}" for k in _COUNTED))
def row_counts(t):
    return t.spark.createDataFrame([(k, sources.row_count(t.spark, f"{t.sf_dir}/{k}.parquet")) for k in _COUNTED], "name string, n long")


@query("SELECT id, name, country FROM s1")
def partitioned_tables(t):
    path = scratch.new_path(t.spark, "by-country")
    sinks.write_partitioned(t.s1.select("id", "name", "country"), path, "country")
    sinks.write_partitioned(t.spark.read.parquet(path).where("country = 'US'").select("id", "name", "country"), f"{path}-again", "country")
    return t.spark.read.parquet(path).where("country <> 'US'").select("id", "name", "country").unionByName(t.spark.read.parquet(f"{path}-again").select("id", "name", "country"))


@query("SELECT word, max(n) AS n FROM (SELECT p_brand AS word, 1::BIGINT AS n FROM part WHERE p_size < 20 UNION ALL SELECT p_brand, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size < 20) THEN 1::BIGINT ELSE 2::BIGINT END FROM part) GROUP BY word")
def appended_cache(t):
    path, words = scratch.new_path(t.spark, "cache"), t.table("part")
    words.where("p_size < 20").select(F.col("p_brand").alias("word"), F.lit(1).cast("long").alias("n")).distinct().write.parquet(path)
    sinks.append_new(scratch.table(t.spark.read.parquet(path)), words.select(F.col("p_brand").alias("word"), F.lit(2).cast("long").alias("n")), ["word"], path)
    return t.spark.read.parquet(path)


@query("SELECT 'S1-' || s1 AS s1_id, coalesce(string_agg('S2-' || (rec - 20000000000), ',' ORDER BY o, rec), '') AS ids FROM (SELECT id AS s1 FROM s1) LEFT JOIN (SELECT s1, rec, -p AS o FROM scored WHERE p >= 0.4) USING (s1) GROUP BY s1")
def ordered_id_lists(t):
    # negative ids sort like numbers within a score: the fixture's scores of an entity differ
    return sinks.grouped_lists(t.scored.where("p >= 0.4").withColumn("o", -F.col("p")), t.s1.select(F.col("id").alias("s1")), "o")


@query("SELECT * FROM (SELECT 0 AS n, '## Regions' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| r_regionkey | r_name |' UNION ALL SELECT 3, '|---|---|' UNION ALL SELECT 4 + r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region)")
def markdown_report(t):
    text = sinks.markdown_table(t.table("region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "Regions")
    return t.spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")


# ---- checks --------------------------------------------------------------------------------------------------------------
#: Match lists with one fault of each kind: (s1_id, ids).
_BAD = [("S1-1", "S2-1,S2-1"), ("S1-2", "S2-2"), ("S1-2", "S2-2"), ("S1-3", "S1-9,S2-3"), ("S1-4", "X-5,S2-4"), ("S1-5", "S2-2,S2-999999999"), ("S1-99999999", "S2-7"), ("S1-6", "")]
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _BAD)


@query(f"""WITH out_(s1_id, ids) AS (VALUES {_VALUES}), l AS (SELECT s1_id, unnest(list_filter(string_split(ids, ','), lambda x: x <> '')) AS id FROM out_), known AS (SELECT 'S2-' || (id - 20000000000) AS id FROM rec),
e AS (SELECT 'S1-' || id AS id FROM s1 WHERE id <= 8), wide AS (SELECT 'S1-' || s1 AS s1_id, 'S2-' || (rec - 20000000000) AS id FROM scored),
f AS (SELECT 'duplicate row' AS rule, s1_id AS entity FROM out_ GROUP BY s1_id HAVING count(*) > 1 UNION ALL SELECT 'id repeated in a list', s1_id FROM l GROUP BY s1_id, id HAVING count(*) > 1 UNION ALL SELECT 'entity in a list', s1_id FROM l WHERE id LIKE 'S1-%'
  UNION ALL SELECT 'wrong prefix', s1_id FROM l WHERE NOT regexp_full_match(id, 'S[123]-\\d+') UNION ALL SELECT 'missing entity', id FROM e WHERE id NOT IN (SELECT s1_id FROM out_) UNION ALL SELECT 'extra entity', s1_id FROM out_ WHERE s1_id NOT IN (SELECT id FROM e)
  UNION ALL SELECT 'in two lists', min(s1_id) FROM (SELECT DISTINCT s1_id, id FROM l) GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown id', s1_id FROM l WHERE id NOT IN (SELECT id FROM known) UNION ALL SELECT 'match not a candidate', s1_id FROM l ANTI JOIN wide USING (s1_id, id))
SELECT rule, count(*) AS n, min(entity) AS example FROM f GROUP BY rule""")
def faulty_outputs(t):
    bad = t.spark.createDataFrame(_BAD, "s1_id string, ids string")
    known, people = t.rec.select(ids.decode_id(F.col("id")).alias("id")), t.s1.where("id <= 8").select(ids.decode_id(F.col("id")).alias("id"))
    wide = sinks.grouped_lists(t.scored, t.s1.select(F.col("id").alias("s1")))
    return validate.summary(validate.violations(bad, people, known, wide))


@query("""WITH p AS (SELECT avg((name = '')::INT) AS empty_names, avg((addr = '')::INT) AS empty_addresses, avg((length(name) > 40)::INT) AS long_names FROM records)
SELECT "check", round(value, 9) AS value, "limit", value <= "limit" AS ok FROM (SELECT unnest(['empty_names', 'empty_addresses', 'long_names']) AS "check", unnest([empty_names, empty_addresses, long_names]) AS value, unnest([0.05, 0.5, 0.2])::DOUBLE AS "limit" FROM p)""")
def readiness_checks(t):
    share = lambda c: F.avg(c.cast("double"))
    p = t.records.agg(share(F.col("name") == "").alias("empty_names"), share(F.col("addr") == "").alias("empty_addresses"), share(F.length("name") > 40).alias("long_names"))
    return reports.readiness(p, {"empty_names": 0.05, "empty_addresses": 0.5, "long_names": 0.2}).withColumn("value", short("value"))


@query("""WITH g AS (SELECT s.rec, s.s1, s.p FROM scored s QUALIFY row_number() OVER (PARTITION BY rec ORDER BY p DESC, s1) = 1), a AS (SELECT * FROM g WHERE p >= 0.7), z AS (SELECT * FROM g WHERE p < 0.7 AND p >= 0.8 * 0.7)
SELECT rec, s1, p FROM a UNION ALL SELECT rec, s1, p FROM z WHERE s1 = rec - 20000000000""")
def judged_matches(t):
    accepted = decide.assign(t.scored, "p", 0.7)
    gray = decide.gray_zone(t.scored, accepted, 0.7).select("rec", "s1", "p")
    verdicts = gray.select("rec", "s1", (F.col("s1") == F.col("rec") - 20000000000).alias("verdict"))
    return decide.gated_judgement(accepted, gray, verdicts, t.truth, t.s1.select(F.col("id").alias("s1")))


@query("SELECT least(3.0, greatest(1.0, (SELECT count(*) FROM rec) / (SELECT count(*) FROM s1) / (SELECT count(*) / (SELECT count(*) FROM s1) FROM rec WHERE id % 3 = 0)))::DOUBLE AS ratio")
def decoy_density(t):
    return t.spark.createDataFrame([(decide.decoy_ratio(t.records.where("src = 1 OR id % 3 = 0"), t.records),)], "ratio double")


@query("SELECT country, name, count(*) AS n FROM rec GROUP BY country, name HAVING count(*) > 1")
def repeated_records(t):
    return profile.duplicates(t.rec, ["country", "name"])
