"""Similarity kernels over batches against plain versions, dynamic programming and known values."""

import numpy as np
import plain_similarity as plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import similarity as s

short = st.text("abc ", max_size=9)
odd = st.one_of(short, st.text("ab c", min_size=50, max_size=200), st.text(max_size=12))


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(short, short)
@settings(max_examples=150, deadline=None)
def test_plain_lcs(a, b):
    assert plain.lcs_length(a, b) == lcs(a, b)


@given(st.lists(st.tuples(odd, odd), max_size=30))
@settings(max_examples=60, deadline=None)
def test_batches_equal_the_plain_versions(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    for name, kernel in s.KERNELS.items():
        want = [plain.KERNELS[name](x, y) for x, y in pairs]
        assert np.allclose(kernel(a, b), want, atol=1e-9), name
    assert s.osa_distances(a, b).tolist() == [plain.osa_distance(x, y) for x, y in pairs]


@pytest.mark.parametrize("table", [64, 1 << 21])
def test_slices_of_any_size(monkeypatch, table):
    """Many pairs of words of 1 to 3 machine words, over tables of any size."""
    monkeypatch.setattr(s, "TABLE", table)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdeé漢 "), n)) for n in rng.integers(0, 190, 120)]
    a, b = texts, [texts[i] if i % 3 else t[::-1] for i, t in zip(rng.integers(0, 120, 120), texts, strict=True)]
    assert s.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b, strict=True)]
    assert np.allclose(s.jaro_winklers(a, b), [plain.jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])
    assert s.osa_distances(a[:30], b[:30]).tolist() == [plain.osa_distance(x, y) for x, y in zip(a[:30], b[:30], strict=True)]


@given(short, short)
@settings(max_examples=100, deadline=None)
def test_ranges_and_symmetry(a, b):
    for name, k in s.KERNELS.items():
        top = 100.0 if name.endswith("ratio") else 1.0
        assert 0 <= k([a], [b])[0] <= top + 1e-9
    assert s.ratios([a], [b]) == s.ratios([b], [a])
    assert s.osa_distances([a], [b]) == s.osa_distances([b], [a])


def test_known_values(spark):
    assert round(s.jaro_winklers(["martha"], ["marhta"])[0], 4) == 0.9611
    assert s.osa_distances(["ca", "ab"], ["abc", "ba"]).tolist() == [3, 1]
    assert s.token_set_ratios(["blue ring"], ["ring blue ltd"])[0] == 100.0 and s.token_sort_ratios(["b a"], ["a b"])[0] == 100.0
    assert s.partial_ratios(["ring"], ["a blue ring x"])[0] == 100.0 and s.ratios([""], [""])[0] == 100.0
    df = spark.createDataFrame([("abc", "abd"), (None, "x"), ("", ""), ("abc", "abd")], "a string, b string")
    got = df.select(s.SCORERS["ratio"](F.col("a"), F.col("b")).alias("r"), s.several("ratio", "jaro_winkler")(F.col("a"), F.col("b")).alias("s"))
    assert sorted(round(r["r"], 3) for r in got.collect()) == [0.0, 66.667, 66.667, 100.0]
    assert all(r["s"]["ratio"] == r["r"] for r in got.collect()) and got.where("false").count() == 0
    assert [r[0] for r in df.select(s.jaccard(F.split("a", ""), F.split("b", ""), -1.0)).limit(1).collect()] == [0.5]
