"""Plans and sizes over tables whose files are far smaller than their rows."""

import pytest
from pyspark.sql import functions as F

from recordloom.plans import catalog, catalog_io, catalog_lexicon
from recordloom.sources import scratch


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A context over 1,000,000 parts of few names; its normalised records are of few words."""
    at = tmp_path_factory.mktemp("wide")
    k = F.col("id")
    part = spark.range(1_000_000).select(
        k.alias("p_partkey"), F.concat(F.lit("part "), k % 50).alias("p_name"), F.concat(F.lit("Brand#"), k % 25).alias("p_brand"), F.concat(F.lit("TYPE "), k % 30).alias("p_type"),
        (k % 50).cast("int").alias("p_size"), (k % 100).cast("double").alias("p_retailprice"),
    )
    part.coalesce(1).write.parquet(f"{at}/part.parquet")
    t = catalog.Context(spark, str(at))
    norm = t.records.select("id", "src", "country", F.substring(F.lower("name"), 1, 7).alias("core"), F.lit("ltd").alias("legal"), F.lower("country").alias("glued"), F.lower("country").alias("atok"), F.lit("1").alias("anum"), F.lit("").alias("post"), F.lit(False).alias("indic"))
    t._made["norm"] = scratch.table(norm, "normalized")
    return t


def _broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_searched_thresholds_broadcasts_no_table_of_pairs(wide):
    assert _broadcasts(wide.scored.join(wide.scored.groupBy("rec").agg(F.max("p").alias("p")), ["rec", "p"])) == 0
    assert catalog_lexicon.searched_thresholds(wide).first()[0] > 0


def test_weighted_token_overlap_broadcasts_no_records(wide):
    assert _broadcasts(catalog.weighted_token_overlap(wide)) == 0


def test_faulty_outputs_broadcasts_no_ids_or_candidates(wide):
    assert _broadcasts(catalog_io.faulty_outputs(wide)) == 0


def test_token_jaccard_broadcasts_no_records(wide):
    assert _broadcasts(catalog.token_jaccard(wide)) == 0


def test_blocking_leaves_no_table_that_it_made_on_the_way(spark):
    from recordloom.operators import blocking

    t = catalog.Context(spark, "/root/testdata/sf0.001")
    before = set(scratch._made.get(spark.sparkContext.applicationId, []))
    norm = t.norm
    found = blocking.block(norm.where("src = 1"), norm.where("src > 1"), {k: blocking.CHANNELS[k] for k in ("name", "addr")})
    left = {p.rsplit("/", 1)[1].split("-")[0] for p in set(scratch._made[spark.sparkContext.applicationId]) - before}
    assert found.count() > 0
    assert "cosines" in left and not left & {"rows", "groups", "postings", "needs", "asked"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


@pytest.fixture(scope="module")
def small(spark):
    t = catalog.Context(spark, "/root/testdata/sf0.001")
    assert t.norm.count() > 0
    return t


def _no_row_per_pair_is_dealt_out(df) -> bool:
    import re

    return len(re.findall(r"Exchange hashpartitioning\(s1#\d+L?, cand#", df._jdf.queryExecution().executedPlan().toString())) == 0


def test_kept_candidates_deals_out_no_row_per_pair_and_key(small):
    out = catalog.kept_candidates(small)
    assert _no_row_per_pair_is_dealt_out(out) and "hits-" not in out._jdf.queryExecution().executedPlan().toString()


def test_key_candidates_deals_out_no_row_per_pair_and_key(small):
    assert _no_row_per_pair_is_dealt_out(catalog.key_candidates(small))


def test_inverted_index_join_deals_out_no_row_per_pair_and_key(small):
    assert _no_row_per_pair_is_dealt_out(catalog.inverted_index_join(small))


def test_groups_of_the_key_join_follow_the_entities(spark):
    from recordloom.operators import blocking

    assert [blocking.join_groups(spark.range(n)) for n in (0, 300, 100_000)] == [1, 1, 13]


def test_family_shares_makes_the_true_pairs_only(small):
    from recordloom.operators import blocking

    assert "explode(_c" not in catalog.family_shares(small)._jdf.queryExecution().executedPlan().toString()
    s1, rec = catalog._split(small)
    keys, index = blocking.record_keys(rec), blocking.build_index(blocking.record_keys(rec), rec)
    true = small.truth.where("rec >= 0").select("s1", F.col("rec").alias("cand"))
    some = blocking.index_join_of(true.union(true), blocking.record_keys(s1), blocking.postings(keys, index))
    every = blocking.index_join(blocking.record_keys(s1), keys, index).join(true, ["s1", "cand"], "left_semi")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.select(*some.columns).collect()))


def test_reduction_ratio_deals_out_no_row_per_pair(small):
    assert _no_row_per_pair_is_dealt_out(catalog.reduction_ratio(small))


def test_key_families_deals_out_no_row_per_pair_and_key(small):
    assert _no_row_per_pair_is_dealt_out(catalog.key_families(small))


def test_calibration_fits_a_row_per_score(spark, monkeypatch):
    from recordloom.operators import models

    rows = spark.range(4000).select((F.col("id") % 20 / 20).alias("p"), ((F.col("id") * 7 % 20 + F.col("id") % 3) % 20 < F.col("id") % 20).cast("int").alias("y"))
    own, seen = models.IsotonicRegression.fit, []
    monkeypatch.setattr(models.IsotonicRegression, "fit", lambda self, df, *a: seen.append(df.count()) or own(self, df, *a))
    got = models.calibrated(models.calibrate(rows, "p"), rows, "p", "c").select("p", "c").distinct().orderBy("p").collect()
    plain = own(models.IsotonicRegression(featuresCol="x", labelCol="y"), rows.select(F.col("p").alias("x"), F.col("y").cast("double").alias("y")))
    want = plain.transform(rows.select(F.col("p").alias("x"))).select("x", "prediction").distinct().orderBy("x").collect()
    assert seen == [20] and [round(r["c"], 9) for r in got] == [round(r["prediction"], 9) for r in want]


def test_description_reads_percentiles_off_running_counts(spark):
    from recordloom.operators import profile

    rows = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, (F.col("id") * 7919 % 1013) / 8).alias("v"))
    rows = rows.union(spark.createDataFrame([(9, None), (8, 2.5)], "g long, v double"))
    out = profile.describe(rows, "v", ["g"])
    assert "percentile(" not in out._jdf.queryExecution().executedPlan().toString()
    want = rows.groupBy("g").agg(F.count("v"), F.min("v"), F.max("v"), *[F.percentile("v", F.lit(q)) for q in (0.25, 0.5, 0.75)])
    short = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    key = lambda r: str(r[0])
    assert sorted((short(r) for r in out.select("g", "n", "min", "max", "p25", "p50", "p75").collect()), key=key) == sorted((short(r) for r in want.collect()), key=key)
    assert profile.describe(rows, "v").count() == 1


def test_preparation_is_spread_beyond_the_files_of_the_input(wide):
    """A small file of many rows is read by one or two tasks; normalising them isn't theirs."""
    from recordloom.plans import classic_family  # noqa: F401

    t = catalog.Context(wide.spark, wide.sf_dir)
    seen = []
    own, scratch.table = scratch.table, lambda df, name="table": seen.append((name, df)) or df
    try:
        t.norm, catalog._classic_sides(t), catalog_lexicon._texts(t)
    finally:
        scratch.table = own
    for name, df in seen:
        assert "REPARTITION_BY_COL" in df._jdf.queryExecution().executedPlan().toString(), name
    assert sorted(n for n, _ in seen) == ["classic", "normalized", "texts"]


def test_vector_products_exist_for_a_strip_of_queries_at_a_time(spark, monkeypatch):
    from recordloom.operators import blocking

    v = spark.range(600).select("id", F.lit("a").alias("country"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")).alias("vector"))
    rows = lambda: sorted(map(tuple, blocking.nearest_vectors(v, v, 3).collect()))
    whole = rows()
    monkeypatch.setattr(blocking, "_STRIP", 7)
    assert rows() == whole and len(whole) == 1800


def test_key_families_share_what_they_have_in_common(small):
    """Sounds, house and street are evaluated once per record, not in every family and for every word of it."""
    plan = catalog.blocking_keys(small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("plot") == 1


@pytest.fixture(scope="module")
def joined(small):
    """The key join without names apart or Arrow, a row per pair."""
    from recordloom.operators import blocking

    s1, rec = catalog._split(small)
    keys = blocking.record_keys(rec)
    return scratch.table(blocking.index_join(blocking.record_keys(s1), keys, blocking.build_index(keys, rec)), "joined")


def _rows(df, columns) -> list:
    return sorted(map(tuple, df.select(*columns).collect()))


def _work(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_candidates_sorts_no_row_per_pair(small, joined):
    """Ranks and reverse ranks are found in Arrow; pairs travel as arrays."""
    from recordloom.operators import blocking
    from recordloom.plans import classic_family

    for k, reverse_k in ((3, 1), (1, 0), (50, 3)):
        out = classic_family.key_candidates(small.norm, k, reverse_k)
        assert " Window " not in _work(out) and "explode(_c" not in _work(out)
        want = blocking.keep_candidates(joined.withColumn("cos", F.lit(0.0)), k, 0, reverse_k)
        assert _rows(out, out.columns) == _rows(want, out.columns)


def test_keys_of_names_that_records_share(small):
    """Names that many have, up to and over the caps, and a country apart; copies of a record; records without a name or an address."""
    from recordloom.operators import blocking

    schema = "id long, src int, country string, core string, anum string, atok string, post string"
    one = lambda i, src, core, at=("12", "market square", "110001"), country="US": (i, src, country, core, *at)
    rows = [one(i, 1, "alpha beta") for i in range(9)] + [one(20, 1, "gamma"), one(21, 1, ""), one(22, 1, None), one(23, 1, "alpha beta", ("", "", "")), one(24, 1, "beta alpha", (None, None, None))]
    rows += [one(1000 + i, 2, "alpha beta", ("12", "market square", str(110000 + i))) for i in range(90)] + [one(2000 + i, 2, "gamma delta", country="India") for i in range(5)]
    rows += [one(3000 + i, 2, "gamma", (str(i), "", "")) for i in range(101)] + [one(4000, 2, ""), one(4001, 2, None), one(4002, 2, "beta alpha")]
    norm = small.spark.createDataFrame(rows, schema)
    s1, rec = norm.where("src = 1"), norm.where("src = 2")
    keys = blocking.record_keys(rec)
    want = blocking.index_join(blocking.record_keys(s1), keys, blocking.build_index(keys, rec))
    assert _rows(blocking.key_hits(s1, rec), want.columns) == _rows(want, want.columns) and want.count() > 900
    pairs = want.select("s1", "cand")
    assert _rows(blocking.key_hits_of(pairs, s1, rec), want.columns) == _rows(want, want.columns)
    assert blocking.key_hits(s1.where("id < 0"), rec).count() == blocking.kept_key_hits(s1, rec.where("id < 0")).count() == 0


def test_reduction_ratio_counts_pairs_where_they_are_made(small, joined):
    from recordloom.operators import blocking

    out = blocking.key_counts(*catalog._split(small), "s1")
    assert _rows(out, ["s1", "n"]) == _rows(joined.groupBy("s1").agg(F.count("*").alias("n")), ["s1", "n"])
    assert "explode(_c" not in _work(catalog.reduction_ratio(small))


def test_key_families_counts_pairs_where_they_are_made(small, joined):
    from recordloom.operators import blocking

    out = blocking.key_counts(*catalog._split(small), "mask").groupBy("mask").agg(F.sum("n").alias("n"))
    assert _rows(out, ["mask", "n"]) == _rows(joined.groupBy("mask").agg(F.count("*").alias("n")), ["mask", "n"])
    assert "explode(_c" not in _work(catalog.key_families(small))


def test_family_shares_deals_out_shared_keys_only(small, joined):
    from recordloom.operators import blocking

    true = small.truth.where("rec >= 0").select("s1", F.col("rec").alias("cand"))
    out = blocking.key_hits_of(true.union(true), *catalog._split(small))
    assert _rows(out, joined.columns) == _rows(joined.join(true, ["s1", "cand"], "left_semi"), joined.columns)
    assert "kind#" not in "".join(x.split(")")[0] for x in _work(catalog.family_shares(small)).split("hashpartitioning(cand#")[1:])


def test_hits_of_ids_of_any_distance():
    """Ids that fit in one word with their entity's number, and ids that don't, negative ones among them."""
    import numpy as np
    import pyarrow as pa

    from recordloom.operators import blocking

    for far in (20_000_000_000, 2**62):
        rows = [(5, 1.5, 1, [far, -far]), (-5, 2.0, 2, [7]), (5, 0.25, 4, [far, 7]), (-5, 1.0, 1, [7, far])]
        lists = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("s1", "weight", "_bit", "_c"))})
        got = [x.tolist() for x in blocking._hits_of(lists)]
        assert list(zip(*got, strict=True)) == [(-5, 7, 3.0, 3), (-5, far, 1.0, 1), (5, -far, 1.5, 1), (5, 7, 0.25, 4), (5, far, 1.75, 5)]
    assert blocking._places(-np.array([1.0, 2.0, 2.0, 5.0]), np.array([1, 1, 1, 2])).tolist() == [3, 1, 2, 1]


def test_kept_candidates_deals_pairs_out_packed(small):
    """Pairs leave their group of entities packed, once; no window deals them out by entity and by record."""
    plan = catalog.kept_candidates(small)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "scores#" in plan
