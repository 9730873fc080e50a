"""Ensemble members and the vector index against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from recordloom.operators import blocking, decide, ensembles, evaluate, runs, vectors


def plain_trees(x, y, columns, trees, members, depth, least, seed, importance):
    """The same trees, one at a time, node by node, over rows in memory."""
    nodes = {}

    def grow(t, n, rows, own, level):
        value = y[rows].mean() if len(rows) else 0.0
        nodes[t, n] = (None, 0.0, value)
        if level == depth or not 0 < y[rows].sum() < len(rows):
            return
        tried, options, cuts = ensembles.candidates(own, seed, t, n), {}, {}
        for c in tried:
            v = x[rows, columns.index(c)]
            cuts[c] = v.min() + ensembles.uniform(seed, t, n, c, "cut") * (v.max() - v.min())
            left = v <= cuts[c]
            options[c] = (len(rows), y[rows].sum(), left.sum(), y[rows][left].sum())
        best = ensembles.best_split(options, tried, least)
        if best:
            left = x[rows, columns.index(best)] <= cuts[best]
            nodes[t, n] = (best, cuts[best], value)
            grow(t, 2 * n + 1, rows[left], own, level + 1)
            grow(t, 2 * n + 2, rows[~left], own, level + 1)

    for t in range(trees * members):
        grow(t, 0, np.arange(len(x)), ensembles.draw_columns(columns, importance, seed, t // trees), 0)

    def score(row):
        total = 0.0
        for t in range(trees * members):
            n = 0
            while nodes[t, n][0]:
                n = 2 * n + 1 + (row[columns.index(nodes[t, n][0])] > nodes[t, n][1])
            total += nodes[t, n][2]
        return total / (trees * members)

    return nodes, [score(r) for r in x]


def test_extra_trees_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    columns = [f"c{i}" for i in range(9)]
    x = np.round(rng.normal(size=(300, 9)), 3)
    y = (x[:, 0] + x[:, 3] > 0.3).astype(float)
    rows = [(i, *map(float, r), int(b)) for i, (r, b) in enumerate(zip(x, y, strict=True))]
    rows[7] = (7, None, *rows[7][2:])
    x[7, 0] = ensembles.MISSING
    df = spark.createDataFrame(rows, "rec long, " + ", ".join(f"{c} double" for c in columns) + ", y int").repartition(3)
    importance = {"c0": 5.0, "c3": 4.0}
    model = ensembles.fit_extra_trees(df, columns, members=2, trees=3, depth=5, least=4, importance=importance)
    nodes, scores = plain_trees(x, y, columns, 3, 2, 5, 4, 1, importance)
    assert model.nodes.keys() == nodes.keys() and all(model.nodes[k][0] == v[0] and np.allclose(model.nodes[k][1:], v[1:]) for k, v in nodes.items())
    got = {r["rec"]: r["p_trees"] for r in ensembles.score_extra_trees(df, model).collect()}
    assert np.allclose([got[i] for i in range(300)], scores)
    table = model.table(spark)
    assert table.count() == len(nodes) and table.where("column IS NOT NULL").count() == sum(v[0] is not None for v in nodes.values())
    assert {c for t in range(2) for c in ensembles.draw_columns(columns, importance, 1, t)} >= {"c0"}
    none = ensembles.fit_extra_trees(df.where("false"), columns, members=1, trees=1)
    assert set(ensembles.score_extra_trees(df, none).toPandas()["p_trees"]) == {0.0}


def test_landmark_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    rows = [(i, 0, *map(float, r), int(r[0] ** 2 + r[1] ** 2 < 1)) for i, r in enumerate(x)]
    rows[5] = (5, 0, None, *rows[5][3:])
    df = spark.createDataFrame(rows, "rec long, s1 long, a double, b double, c double, y int")
    every = ensembles.fit_landmarks(df, ["a", "b", "c"], 200)
    assert every.indicators == ["a"]
    f = np.array([r["kernel"] for r in sorted(ensembles.landmark_features(df, every).collect())])
    part = df.orderBy("rec").toPandas()
    z = every.standardised(part)
    assert np.abs(z).max() <= 6 and np.allclose(f @ f.T, ensembles.kernel(z, z), atol=1e-3)  # all rows as landmarks: exact
    few = ensembles.fit_landmarks(df, ["a", "b", "c"], 40)
    fitted = ensembles.fit_landmark_model(df, few)
    told = ensembles.score_landmark_model(df, few, fitted).select("y", "p_kernel").toPandas()
    assert ((told["p_kernel"] > 0.5) == (told["y"] == 1)).mean() > 0.9  # a circle: no line does that


def test_ensemble_is_out_of_fold(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0, float(i % 3), float(rng.random()), int(i % 3 == 0), i % 3, i % 10 == 9, 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "rec long, s1 long, k double, noise double, y int, fold int, ho boolean, p double")
    out, _ = ensembles.ensemble(df, ["k", "noise"], "p", landmarks=8, members=1, trees=8, depth=6, least=2)
    got = out.where("NOT ho").groupBy("fold").agg(F.max("p_trees").alias("p")).collect()
    assert {r["fold"]: r["p"] for r in got}[0] < 0.5  # no model of fold 0 has seen its label
    assert out.count() == 300 and out.where("p_stack IS NULL").count() == 0


def test_vector_index(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 8))
    v = np.concatenate([middles[rng.integers(0, 12, 600)] + rng.normal(scale=0.1, size=(600, 8)), np.tile(middles[0], (300, 1))])  # a hot vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    centres = vectors.fit_centroids(df, 10)
    index = vectors.build_index(df, centres)
    assert index.count() == 900 and centres.shape == (10, 8)
    asked = df.where("id % 50 = 0")
    exact = blocking.nearest_vectors(asked.where("vector IS NOT NULL").withColumn("b", F.lit(1)), df.where("vector IS NOT NULL").withColumn("b", F.lit(1)), 5, "b")
    want = sorted(map(tuple, exact.select("s1", "cand", "rank").collect()))
    assert sorted(map(tuple, vectors.search(asked, index, centres, 5, 10, block_rows=50).select("s1", "cand", "rank").collect())) == want
    probes = vectors.probes_for(df, df, index, centres, 5)
    found = vectors.recall(vectors.search(asked, index, centres, 5, probes), exact).first()
    assert probes < 10 and found["n_queries"] == 18 and found["recall"] >= 0.9
    none = df.where("false")
    empty = vectors.fit_centroids(none, 4)
    assert vectors.probes_for(none, none, vectors.build_index(none, empty), empty) == 1


def test_segmented_sums_over_a_hot_segment(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 5)) if i % 3 else 7, float(i % 97) / 97, float(i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "s1 long, p double, v double").groupBy("s1", "p").agg(F.sum("v").alias("v")).union(spark.createDataFrame([(7, float(i) + 2, 1.0) for i in range(1500)], "s1 long, p double, v double"))
    got = {(r["s1"], r["p"]): r["c"] for r in runs.segmented_sums(df, "s1", "p", {"v": "c"}).collect()}
    plain = [tuple(r) for r in df.collect()]
    assert len(got) == len(plain)
    for s, p, _ in plain[::37]:
        assert abs(got[s, p] - sum(v for a, b, v in plain if a == s and b >= p)) < 1e-6


def test_sweeps_equal_trials(spark):
    """The exact curve and the search by class against macro_f05 of each threshold."""
    rng = np.random.default_rng(8)
    truth = spark.createDataFrame([(s, 100 * s + j) for s in range(1, 15) for j in range(s % 4)] + [(s, -1) for s in range(4, 15, 4)], "s1 long, rec long")
    rows = [(100 * s + j, int(s if rng.random() < 0.7 else rng.integers(1, 15)), round(float(rng.random()), 1), int(j % 2), bool(s % 2)) for s in range(1, 15) for j in range(5)]
    scored = spark.createDataFrame(rows, "rec long, s1 long, p double, src int, a_missing boolean")
    people = truth.select("s1").distinct()
    value = lambda kept: evaluate.macro_f05(kept, truth, people, 2.0).first()["macro_f05"]
    for r in decide.exact_curve(scored, truth, people, fp_weight=2.0).collect():
        assert abs(r["macro_f05"] - value(decide.assign(scored, "p", r["threshold"]))) < 1e-9
    found, best = decide.search_classes(scored, truth, people, start=0.3, rounds=1, fp_weight=2.0)
    passed = [F.struct("src", "a_missing") == F.struct(F.lit(s).alias("src"), F.lit(a).alias("a_missing")) for s, a in found]
    kept = scored.where(F.coalesce(*[F.when(c, F.col("p") >= t) for c, t in zip(passed, found.values(), strict=True)]))
    assert abs(value(kept.select("rec", "s1")) - best) < 1e-6 and best >= value(decide.assign(scored, "p", 0.3))
