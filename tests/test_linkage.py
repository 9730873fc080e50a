"""The pipeline on a noisy fixture, and the operators that have no SQL."""

import math
import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from recordloom.functions import text
from recordloom.operators import blocking, decide, evaluate, lexicon, models, names, pairs, ranking, synth, validate
from recordloom.operators.runs import running_sums
from recordloom.plans import catalog, catalog_models, linkage
from recordloom.sources import sinks
from recordloom.sources import tables as sources
from recordloom.sources.scratch import table
from recordloom.streaming.incremental import match_stream

WORDS = "red blue green amber silver golden iron copper stone river forest ocean market bakery studio garden".split()
CHANNELS = {"name": (blocking.name_features, 200, 5), "addr": (blocking.address_features, 200, 5)}


@pytest.fixture(scope="module")
def world(spark):
    rows = [(i, 1, f"{WORDS[i % 16]} {WORDS[(i * 7 + 3) % 16]} {WORDS[(i * 5 + i // 16) % 16]} {'Ltd' if i % 3 else 'Inc'}", f"{i * 13 % 900 + 1} {WORDS[i * 3 % 16]} Street, Ward {i % 9}, {110000 + i}", "US" if i % 2 else "India") for i in range(120)]
    s1 = spark.createDataFrame(rows, "id long, src byte, name string, addr string, country string")
    noisy = synth.noisy_records(s1, 2, 0.6, 0.3).unionByName(synth.noisy_records(s1, 3, 1.0, 0.3, seed=5))
    noisy = spark.createDataFrame(noisy.collect(), noisy.schema)
    truth = noisy.select("s1", F.col("id").alias("rec")).where("s1 >= 0")
    records = s1.unionByName(noisy.drop("s1"))
    norm = linkage.normalize(records)
    return {"s1": s1, "records": records, "truth": truth, "norm": spark.createDataFrame(norm.collect(), norm.schema)}


def test_noise_is_repeatable(spark, world):
    again = synth.noisy_records(world["s1"], 2, 0.6, 0.3)
    assert sorted(again.collect()) == sorted(synth.noisy_records(world["s1"], 2, 0.6, 0.3).collect())
    assert again.where("s1 = -1").count() > 10


def test_blocking_finds_true_pairs(world):
    found = blocking.block(world["norm"].where("src = 1"), world["norm"].where("src > 1"), CHANNELS)
    ranked = ranking.rank_and_margin(found, {"name": "c_name"}).withColumn("rank", F.col("r_name"))
    assert evaluate.blocking_recall(ranked, world["truth"]).first()["recall"] > 0.9


def test_train_and_predict(spark, world, monkeypatch, tmp_path):
    import functools

    monkeypatch.setattr(models, "fit_trees", functools.partial(models.fit_trees, rounds=3, depth=3))
    monkeypatch.setattr(models.out_of_fold, "__defaults__", ("fold", 3, "ho", models.fit_trees))
    scored, fitted = linkage.train(world["norm"], world["truth"], channels=CHANNELS)
    assert {"p1", "p2", "cl_n", "p1_gap"} <= set(scored.columns) and 0.2 <= fitted.threshold <= 0.95
    people = world["s1"].select(F.col("id").alias("s1"))
    got = evaluate.macro_f05(decide.assign(scored, "p2", fitted.threshold), world["truth"], people).first()
    assert got["macro_f05"] > 0.8 and got["pair_p"] > 0.9
    accepted = linkage.predict(world["norm"], fitted, channels=CHANNELS)
    linkage.save(spark, fitted, str(tmp_path))
    again = linkage.load(spark, str(tmp_path))
    assert (again.columns, again.threshold, len(again.second)) == (fitted.columns, fitted.threshold, len(fitted.second))
    both = models.mean_of(again.second, models.mean_of(fitted.second, models.with_columns_of(scored, fitted.columns[2]), "x"), "y")
    assert both.where("x <> y").isEmpty() and both.where("x > 0.5").count() > 50
    assert linkage.retune(scored, world["truth"]) == fitted.threshold
    assert accepted.groupBy("rec").count().where("count > 1").isEmpty() and accepted.count() > 100
    lists = sinks.grouped_lists(accepted, people)
    assert validate.violations(lists, world["s1"].select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias("id"))).isEmpty()


def test_lexicon_learns_abbreviations(spark):
    rows = [(i, 1, "A", f"{i} High street, Tamil Nadu") for i in range(40)] + [(10**10 * 2 + i, 2, "A", f"{i} High st, TN") for i in range(40)]
    records = spark.createDataFrame(rows, "id long, src byte, name string, addr string")
    truth = spark.createDataFrame([(i, 10**10 * 2 + i) for i in range(40)], "s1 long, rec long")
    texts = lexicon.pair_texts(records, truth)
    assert ("st", "street") in {(r["key"], r["value"]) for r in lexicon.learn_tokens(texts).collect()}
    comps = lexicon.learn_components(texts, records.where("src = 1"), least=20, state_rows=30)
    assert {(r["key"], r["value"]) for r in comps.collect()} == {("tn", "tamil nadu")}


def test_lexicon_learns_script_tokens(spark):
    texts = spark.createDataFrame([("ram stores", "राम stores")] * 3 + [("other name", "राम stores")], "a_name string, b_name string")
    assert [(r["key"], r["value"], r["n"]) for r in lexicon.learn_script_tokens(texts).collect()] == [("राम", "ram", 3)]


def test_name_repairs(spark):
    vocabulary = spark.createDataFrame([("golden", 50), ("river", 40), ("solo", 9)], "word string, count long")
    df = spark.createDataFrame([(1, "g0lden rlver"), (2, "goldenriver s0l0"), (3, None)], "id long, name string")
    fixed = {r["id"]: r["f"] for r in names.fix_ocr(df, "name", vocabulary, "f").collect()}
    assert fixed[1] == "golden river" and fixed[2] == "goldenriver solo" and fixed[3] == ""
    repaired = {r["id"]: r["f"] for r in names.repair_tokens(df, "name", vocabulary, "f").collect()}
    assert repaired[1].endswith("river")
    assert names.segment(df, "name", vocabulary, "f").where("id = 2").first()["f"] == "golden river s0l0"
    many = vocabulary.union(spark.range(60_000).select(F.concat(F.lit("x"), F.col("id").cast("string")), F.lit(1000)))
    assert names.segment(df, "name", many, "f").where("id = 2").first()["f"] == "golden river s0l0"  # rare words of a large vocabulary too
    keys = spark.createDataFrame([("the green bolt co pvt ltd",)], "n string").select(names.canonical_keys(F.col("n")).alias("k")).first()["k"]
    assert tuple(keys) == ("the green bolt company private limited", "green bolt", "company private limited")
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["p c id 13896 bros", "limited east co", "ltd", "the 12345", ""])], "i int, n string").orderBy("i")
    assert [tuple(r["k"]) for r in rows.select(names.canonical_keys(F.col("n")).alias("k")).collect()] == [("pc brothers", "brothers", ""), ("limited east company", "east", "company"), ("limited", "limited", "limited"), ("the", "the", ""), ("", "", "")]
    clean = spark.createDataFrame([("Dr. M/s Foo trading as Bar Baz.com",)], "n string").select(names.clean_name(F.col("n"))).first()[0]
    assert clean == "bar baz"
    cache = spark.createDataFrame([("राम", "raam")], "token string, roman string")
    roman = names.romanize(spark.createDataFrame([(1, "राम lal")], "id long, name string"), "name", cache, "r").first()["r"]
    assert roman == "raam lal"
    mixed = spark.createDataFrame([(1, "Café राम42कমা lal"), (2, ""), (3, None)], "id long, name string")
    model = spark.createDataFrame([("क", "ka"), ("राम", "unused")], "token string, roman string")
    got = {r["id"]: (r["r"], r["r_sources"]) for r in names.romanize_runs(mixed, "name", cache, model, "r").collect()}
    assert got[1] == ("Café raam42kamaa lal", ["cache", "model", "sound"]) and got[2] == got[3] == ("", [])


def test_pair_feature_values(spark):
    cols = "id long, src int, core string, legal string, glued string, atok string, anum string, post string, indic boolean"
    norm = spark.createDataFrame([(1, 1, "blue ring", "ltd", "bluering", "main street", "12 5", "110011", False), (2, 1, "red ring", "", "redring", "", "", "", False), (20000000001, 2, "blue ring", "inc", "bluering", "main st", "5", "110011", False)], cols)
    got = pairs.pair_features(spark.createDataFrame([(20000000001, 1), (20000000001, 2)], "rec long, s1 long"), norm).orderBy("s1").collect()
    assert got[0]["g_eq"] == 1 and got[0]["n_tset"] == 100 and got[0]["l_conflict"] == 1 and got[0]["h_first_eq"] == 0 and got[0]["h_b0_in_a"] == 1 and got[0]["post_eq"] == 1 and got[0]["h_diff"] == 0.007
    assert got[1]["h_first_eq"] == -1 and got[1]["a_jac"] == -1 and got[1]["post_eq"] == -1 and round(got[1]["n_jac"], 3) == 0.333


def test_tsv_round_trip(spark, tmp_path):
    (tmp_path / "train").mkdir()
    for n in (1, 2, 3):
        (tmp_path / "train" / f"train_source{n}.tsv").write_text(f'entity_id\tbusiness_name\tbusiness_address\tcountry\nS{n}-1\tA "quoted", name\t\tUS\n')
    rows = sorted(sources.load_split(spark, str(tmp_path), "train").collect())
    assert [(r["id"], r["src"], r["name"], r["addr"]) for r in rows] == [(1, 1, 'A "quoted", name', ""), (20000000001, 2, 'A "quoted", name', ""), (30000000001, 3, 'A "quoted", name', "")]
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    assert sorted(map(tuple, sources.load_truth(spark, str(tmp_path / "truth.tsv")).collect())) == [(1, 20000000001), (1, 30000000001), (2, -1)]
    out = spark.createDataFrame([("S1-1", "S2-1,S3-1"), ("S1-2", "")], "s1_id string, ids string")
    sinks.write_tsv(out, str(tmp_path / "out"), True)
    assert sorted(map(tuple, sources.read_tsv(spark, str(tmp_path / "out"), ("s1_id", "ids")).collect())) == [("S1-1", "S2-1,S3-1"), ("S1-2", "")]


def test_validator_finds_each_fault(spark):
    out = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-2", "S1-1,X9"), ("S1-2", ""), ("S1-9", "S2-1")], "s1_id string, ids string")
    people = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "id string")
    known = spark.createDataFrame([("S2-1",)], "id string")
    rules = {r["rule"] for r in validate.summary(validate.violations(out, people, known)).collect()}
    assert rules == set(validate.RULES)


def test_models(spark, world):
    df = spark.createDataFrame([(i, i, i % 2, i % 3, False, (i % 2) * 0.6 + (i % 7) / 20, float(i % 5)) for i in range(90)], "rec long, s1 long, y int, fold int, ho boolean, q double, x double")
    out, fitted = models.out_of_fold(df, ["q", "x"], "p", fit=lambda d, c: models.fit_trees(d, c, rounds=2, depth=2))
    assert out.where("(p > 0.5) <> (y = 1)").count() < 5 and len(fitted) == 3
    iso = models.calibrate(out, "p")
    assert models.calibrated(iso, out, "p", "c").where("c < 0 OR c > 1").isEmpty()
    stacked, _ = models.stack(out.withColumn("r", F.col("q") * 0.9 + 0.05), ["p", "r"], "z")
    assert stacked.where("(z > 0.5) <> (y = 1)").count() < 5
    mixed = models.permuted(df, "q")
    assert mixed.count() == 90 and sorted(r[0] for r in mixed.select("q").collect()) == sorted(r[0] for r in df.select("q").collect())
    wide, cols = models.kernel_features(df, ["q", "x"], 4)
    assert len(cols) == 4 and models.fit_logistic(wide, cols) is not None
    assert models.recall_threshold(out, "p", 0.9) > 0
    forests = models.fit_subspace_forests(df, ["q", "x"], members=2, trees=3)
    assert models.mean_of(forests, df, "m").where("m IS NULL").isEmpty()


def test_stream_matches_batches(spark, world, tmp_path):
    new = world["records"].where("src = 2").drop("_x")
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    match_stream(stream, world["norm"].where("src = 1"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    right = got.join(world["truth"], ["rec", "s1"], "left_semi").count()
    assert right > 80 and got.groupBy("rec").count().where("count > 1").isEmpty()


def test_nearest_vectors_over_blocks(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(60, 4))
    df = spark.createDataFrame([(i, "a" if i < 40 else "b", v[i].tolist()) for i in range(60)], "id long, country string, vector array<double>")
    got = {(r["s1"], r["rank"]): r["cand"] for r in blocking.nearest_vectors(df, df, 3, block_rows=7).collect()}
    for i in range(60):
        inside = [j for j in range(60) if (j < 40) == (i < 40)]
        best = sorted(inside, key=lambda j: (-(v[i] @ v[j]), j))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == best


def test_candidates_of_common_words(spark):
    """A word that more than 60 reference records share still makes candidates."""
    rows = [(i, 1, "zebra", f"{i + 1} Road {i}", "US") for i in range(70)] + [(1000, 2, "zebra quux", "", "US")]
    norm = linkage.normalize(spark.createDataFrame(rows, "id long, src byte, name string, addr string, country string"))
    assert catalog_models.linkage_candidates(SimpleNamespace(norm=norm)).where("rec = 1000").count() >= blocking.CHANNELS["name"][2]
    capped = {k: (f, 60, n) for k, (f, _, n) in blocking.CHANNELS.items()}
    assert linkage.candidates(norm, capped).where("rec = 1000").count() == 0  # what caps of 60 left


def sound(w):
    if w.isdigit():
        return w
    t = w.translate(str.maketrans(*text.LOOKALIKES))
    for a, b in text.SOUNDS:
        t = t.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", t[0] + re.sub("[aeiou]", "", t[1:])) or w


def brute_keys(r):
    t, a = (r["core"] or "").split(), f"{r['anum']} {r['atok']} {r['post']}".split()
    if not t:
        return set()
    n, sk, words = len(t), [sound(w) for w in t], [w for w in a if w.isalpha() and len(w) >= 4]
    house = next((w for w in a if w[0].isdigit() and len(w) <= 6), None)
    street = next((w for w in words if w not in blocking.STREET_WORDS), None)
    run = lambda size, most: ["".join(t[i : i + size]) for i in range(n - size + 1)][:most]
    long = [w for w in dict.fromkeys(t) if len(w) >= 3][:5]
    found = {
        "core": [r["core"]], "tok": [w for w in t if len(w) >= 2], "skelbi": [f"{x}|{y}" for x, y in zip(sk, sk[1:])][:6] if n > 1 else sk, "pre": ["|".join(w[:4] for w in t[:2])],
        "join": run(2, 3) + run(3, 2) + (["".join(t)] if 2 <= n <= 5 else []) + [w for w in t if len(w) >= 8], "sorted": [" ".join(sorted(set(t)))] if n > 1 else [],
        "acro": ["".join(w[0] for w in t)] if n > 1 else [w for w in t if 2 <= len(w) <= 5 and w.isalpha()], "addrpc": [f"{w}|{sk[0][:3]}" for w in a if w.isdigit() and 5 <= len(w) <= 6][:2],
        "nameaddr": [f"{sk[0]}|{w}" for w in [x for x in a if x.isdigit() and len(x) <= 4][:2] + words[:2]],
        "addrbi": [f"b|{x}|{y}" for x, y in zip(a, a[1:])][:2] + ([f"h|{house}|{street}"] if house and street else []),
        "subset": [f"{w}|{house or street}" for w in long + [f"{x}|{y}" for i, x in enumerate(long) for y in long[i + 1 :]]] if house or street else [],
    }
    return {(k, v) for k, vs in found.items() for v in vs}


def test_index_over_every_family(spark, world):
    rows = world["norm"].where("src < 3").collect()
    keys = {r["id"]: {(r["country"], *k) for k in brute_keys(r)} for r in rows}
    s1, rec = ([r["id"] for r in rows if r["src"] == i] for i in (1, 2))
    df = Counter(k for i in rec for k in keys[i])
    size = Counter(r["country"] for r in rows if r["src"] == 2)
    want = {}
    for a in s1:
        for b in rec:
            shared = [k for k in keys[a] & keys[b] if df[k] <= blocking.KEY_CAPS[k[1]]]
            if shared:
                want[a, b] = (sum(math.log2((size[k[0]] + 1) / df[k]) for k in shared), sum({1 << blocking.KEY_TYPES.index(k[1]) for k in shared}))
    t = SimpleNamespace(norm=world["norm"].where("src < 3"))
    got = {(r["s1"], r["cand"]): r for r in catalog.inverted_index_join(t).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k]["score"] - v) < 1e-6 and got[k]["mask"] == m for k, (v, m) in want.items())
    assert len({k for keys_ in keys.values() for _, k, _ in keys_}) == len(blocking.KEY_CAPS)


def test_skeletons_of_every_name(spark):
    names = ["K12x Bakerry", "mississippi", "acme incorporated", "k1122xx puzzz", "", None, "Aeiou", "bbookkeeper"]
    norm = spark.createDataFrame(list(enumerate(names)), "id long, glued string")
    want = {i: re.sub(r"(.)\1+", r"\1", re.sub("[aeiouyhw]", "", (x or "").lower())) for i, x in enumerate(names)}
    assert dict(map(tuple, catalog.consonant_skeletons(SimpleNamespace(norm=norm)).collect())) == want


def test_hard_negatives_of_a_hot_key(spark):
    rows = [(i, 1, "Zebra", f"{i} Road", "US") for i in range(501)] + [(1000, 2, "zebra", "x", "US"), (1001, 2, "zebra", "y", "US")]
    records = spark.createDataFrame(rows, "id long, src byte, name string, addr string, country string")
    truth = spark.createDataFrame([(0, 1000)], "s1 long, rec long")
    got = catalog.hard_negative_pairs(SimpleNamespace(records=records, truth=truth)).collect()
    assert len(got) == 1001 and {tuple(r) for r in got} == {(s, r) for s in range(501) for r in (1000, 1001)} - {(0, 1000)}


def test_running_numbers_of_sampled_bounds(spark):
    """More rows than Spark samples for its range bounds, and columns that the sums don't need."""
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"), F.lit(1).alias("one"), (F.col("id") % 9).alias("other"))
    got = running_sums(rows, "h", {"one": "nth"}).where("other >= 0").select("h", "nth").orderBy("h").collect()
    assert [r["nth"] for r in got] == list(range(1, 20_001))


def test_permuted_values_stay_the_same(spark):
    part = spark.range(20_000).select(F.col("id").alias("p_partkey"))
    got = catalog_models.permuted_values(SimpleNamespace(table=lambda _: part)).collect()
    assert sorted(map(tuple, got)) == [(float(k), 2500) for k in range(8)]


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_addresses_of_all_records_are_not_broadcast(spark, world):
    found, norm = table(world["truth"].select("rec", "s1")), table(world["norm"])
    assert "Broadcast" not in planned(blocking.shared_address(found, norm, 1))
    assert blocking.shared_address(found, norm, 0).count() == found.count()


def test_keys_of_all_records_are_not_broadcast(spark, world):
    s1, rec = (blocking.record_keys(world["norm"].where(c)) for c in ("src = 1", "src = 2"))
    index = blocking.build_index(s1, world["norm"].where("src = 1"))
    known = table(blocking.postings(s1, index))
    assert "Broadcast" not in planned(blocking.postings_join(rec, known))
    assert blocking.index_join(rec, s1, index).count() > 100


def test_nearest_rows_over_blocks(spark, world):
    """What top_k of all pairs gives, with ties and copies, over many blocks."""
    norm = world["norm"].union(world["norm"].where("src = 1").withColumn("id", F.col("id") + 1000))
    s, q = blocking.channel(norm.where("src = 1"), norm.where("src > 1"), blocking.combined_features, 200)
    want = blocking.top_k(blocking.cosine_pairs(q, s), 5).select("rec", "s1", "score", "rank").collect()
    for rows in (40, 1000):
        found = blocking.nearest_rows(q, s, 5, query_rows=rows, reference_rows=rows)
        assert sorted(found.select("rec", "s1", "score", "rank").collect()) == sorted(want) and len(want) > 500


def test_cosines_of_pairs_over_blocks(spark, world):
    norm = world["norm"]
    mats = {k: blocking.channel(norm.where("src = 1"), norm.where("src > 1"), f, 50) for k, (f, _, _) in blocking.CHANNELS.items()}
    same = norm.where("src > 1").select(F.col("id").alias("rec"), "country").join(norm.where("src = 1").select(F.col("id").alias("s1"), "country"), "country")
    pairs = table(same.where("(rec + s1) % 7 < 2").select("rec", "s1"))
    want = pairs
    for k, (s, q) in mats.items():
        want = blocking.row_cosine(want, q, s, f"c_{k}")
    for rows in (50, 1000):
        got = blocking.block_cosines(pairs, mats, rows, rows).select(want.columns)
        assert sorted(got.collect()) == sorted(want.collect()) and pairs.count() > 1000


def test_products_and_cosines_come_in_rounds(spark, world):
    """What is on the move at once is bounded; the rounds together are the whole."""
    norm = world["norm"]
    mats = {k: blocking.channel(norm.where("src = 1"), norm.where("src > 1"), f, 200) for k, (f, _, _) in blocking.CHANNELS.items()}
    s, q = mats["comb"]
    rounds = blocking.nearest_rounds(q, s, 5, query_rows=150, at_once=500)
    hits = [tuple(r) for x in rounds for r in x.select("rec", "s1", "score", "rank").collect()]
    want = [tuple(r) for r in blocking.nearest_rows(q, s, 5).select("rec", "s1", "score", "rank").collect()]
    assert len(rounds) > 1 and sorted(hits) == sorted(want) and len(want) > 200
    pairs = table(spark.createDataFrame([r[:2] for r in want], "rec long, s1 long"))
    rounds = blocking.cosine_rounds(pairs, list(mats), blocking.packed_channels(mats), 150, at_once=100)
    found = [tuple(r) for x in rounds for r in x.collect()]
    assert len(rounds) > 1 and sorted(found) == sorted(tuple(r) for r in blocking.block_cosines(pairs, mats).collect()) and len(found) == len(want)
