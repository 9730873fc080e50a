"""The pipeline on a small folder, against plain versions of its stages."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    make = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    passage = make(60)
    rows = []
    for i in range(40):
        t = make(80)
        rows.append((i, t if i % 7 else t + " " + passage, "en", "s", 0))
    rows += [(100, rows[3][1], "en", "s", 0), (101, rows[4][1] + " end", "en", "t", 0), (102, None, "en", "s", 0), (103, "short text", "en", "s", 0), (104, "12 " * 50, None, "s", 0), (105, "a b c d e " * 30, "en", "s", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    plain = {d: t for d, t, *_ in rows}
    good = {d for d, t in plain.items() if brute.rules(t)[0] >= 10 and 100 * brute.rules(t)[4] <= 20 * brute.rules(t)[0]}
    assert {r["doc_id"] for r in seen["quality rules"].collect()} == good
    assert {r["doc_id"] for r in seen["language ID"].collect()} == good
    near = brute.near([(d, plain[d]) for d in sorted(good)])
    kept = {d for d, (_, c) in near.items() if d == c}
    assert {r["doc_id"] for r in seen["near-dedup"].collect()} == kept and 100 not in kept and 101 not in kept
    cut = brute.repeats([(d, plain[d]) for d in kept])
    left = {r["doc_id"]: r["text"] for r in seen["repeat removal"].collect()}
    assert {d: len(t.encode()) for d, t in left.items()} == {d: n - gone for d, (n, gone, _, _) in cut.items()}
    assert sum(gone for _, gone, _, _ in cut.values()) > 1000
    pieces = seen["packing"].collect()
    assert {r["doc_id"] for r in pieces} == kept


def test_run_equals_the_stages(spark, folder):
    path, _ = folder
    want = spark.read.parquet(f"{path}/packing")
    got = pipeline.run(spark, path).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_near_dedup_links_from_80_per_cent(spark):
    from recordloom.llm import minhash

    assert minhash.banding(85) == (24, 6) and minhash.margin(85) == 0.71 and minhash.banding(80) == (29, 5)
    rows = []
    for k in range(20):
        for kind, n in enumerate((45, 43)):  # one changed word of n + 4: 40 of 50 shingles shared, 38 of 48
            own = [f"k{k}n{kind}w{i}" for i in range(n + 4)]
            rows += [(100 * k + 10 * kind, " ".join(own)), (100 * k + 10 * kind + 1, " ".join([*own[:20], "changed", *own[21:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect()}
    assert left == {d for d, _ in rows} - {100 * k + 1 for k in range(20)}
    assert minhash.near_duplicates(docs, 85).where("not kept").count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, _lang_pred string, _n_bytes string, n_words string, kept string, row string, `group` string, _doc string"


def odd_rows():
    rng = np.random.default_rng(1)
    make = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 9000, n))
    base, other, long = make(70), make(70), make(30_000)
    texts = [(3, base), (5, other), (5, base), (5, other), (None, make(60)), (None, None), (7, ""), (8, long), (9, "short"), (None, base), (11, make(90))]
    return [(d, t, "en", "s", -1, "mine", "mine", "mine", "mine", "mine", "mine", "mine") for d, t in texts]


def test_odd_rows_go_through_every_stage(spark, folder, tmp_path):
    """Repeated rows, one id with two texts, null ids and texts, a long text, and columns named as the stages' own."""
    path, _ = folder
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    good = [r for r in rows if r[1] and len(r[1].split()) >= 10]
    want = {"quality rules": good, "language ID": good, "near-dedup": [r for i, r in enumerate(good) if i in (0, 1, 4, 5, 7)]}
    assert [r[0] for r in want["near-dedup"]] == [3, 5, None, 8, 11]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name in want:
            assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, want[name]))
        if name == "repeat removal":
            assert docs.columns == [f.name for f in spark.createDataFrame([], ODD).schema]
            assert all(set(r[5:]) == {"mine"} and r["n_chars"] == len(r["text"]) for r in docs.collect()) and docs.count() == 5
    assert {r["doc_id"] for r in docs.collect()} == {3, 5, None, 8, 11}


def test_an_empty_table_stays_empty(spark, folder):
    path, _ = folder
    docs = spark.createDataFrame([], ODD)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
