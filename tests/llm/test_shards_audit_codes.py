"""Sharding, filter audit and vector codes against plain versions."""

import hashlib
import re
import sys
import zlib
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from recordloom.llm import audit, codes, sharding
from recordloom.llm.sharding import Boundaries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(text):
    return hashlib.sha256((text or "").encode()).hexdigest()[:32]


def size(text):
    return len((text or "").encode()) + 16


def plain_capacity(sizes, shards):
    """Smallest capacity of contiguous shards by trying all of them from below."""
    c = max([-(-sum(sizes) // shards), *sizes]) if sizes else 0
    while True:
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        if used <= shards:
            return c
        c += 1


DOCS = "doc_id long, text string, source string, shard string, slot string, key string, piece string"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, s, "own", "own", "own", "own") for d, t, s in rows], DOCS).repartition(3)


def many(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(i, f"text {i} " + "é" * int(rng.integers(0, 300)), f"s{i % 3}") for i in range(n)]
    rows += [(n + i, "the same text for all", None) for i in range(copies)]
    return rows + [(n + copies, None, ""), (n + copies + 1, "", "s1"), (None, "no id", "s1"), (None, "no id", "s1"), (1, rows[1][1], "s2")]


def check_shards(spark, rows, shards):
    got = sharding.assign(documents(spark, rows), shards, names=("put", "place")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), str(r["source"]), r["shard"]) for r in got) == sorted((str(d), str(t), str(s), "own") for d, t, s in rows)
    per = {}
    for r in got:
        per.setdefault(r["put"], []).append(r)
    for own in per.values():
        assert sorted(r["place"] for r in own) == list(range(len(own)))
    home = {}
    for r in got:
        assert home.setdefault(r["text"] or "", r["put"]) == r["put"]
    groups = {}
    for _, t, _ in rows:
        groups[key(t)] = groups.get(key(t), 0) + size(t)
    own = sharding.alone(sorted(((k, n, 1) for k, n in groups.items()), key=lambda g: (-g[1], g[0])), sum(groups.values()), shards)
    rest = [n for k, n in sorted(groups.items()) if k not in {k for k, _, _ in own}]
    sizes = [sum(size(r["text"]) for r in per.get(i, [])) for i in range(shards)]
    assert [sizes[i] for i in range(len(own))] == [n for _, n, _ in own]
    assert max(sizes[len(own) :], default=0) == plain_capacity(rest, shards - len(own))
    return sizes


def test_shards_are_minimax_and_atomic(spark):
    sizes = check_shards(spark, many(400, 1), 7)
    assert max(sizes) - min(sizes) <= 2 * 700  # two of the largest groups
    hot = check_shards(spark, many(300, 2, copies=3000), 6)
    assert hot[0] == 3000 * 37 and max(hot[1:]) < 1.2 * min(hot[1:])
    check_shards(spark, many(2, 3), 40)  # more shards than groups
    assert sharding.assign(documents(spark, [(1, "a", None)]).where("false"), 3, names=("a", "b")).count() == 0


def test_a_very_long_text_and_a_coarse_count(spark, monkeypatch):
    rows = [*many(300, 4), (9999, "w" * 200_000, "s1")]
    monkeypatch.setattr(sharding, "DIGITS", 0)  # one bucket at first: every boundary is found by refining
    monkeypatch.setattr(sharding, "FINER", 1)
    assert max(check_shards(spark, rows, 5)) == 200_016


def test_boundaries_count_finer_only_where_a_cut_is_searched():
    b = Boundaries({"a": (10, 1, 1), "b": (10, 3, 3), "c": (10, 1, 1)})
    assert (b.floor(10), b.floor(9), b.ceil(21)) == (10, 0, 30) and not b.wanted
    assert b.floor(15) == 10 and b.wanted == {"b"}
    exact = Boundaries({str(i): (s, 1, 1) for i, s in enumerate([5, 5, 5, 5, 1])})
    c = exact.capacity(3, 5, exact.total)
    assert c == 10 and exact.cuts(c, 3) == [5, 15]  # greedily the last shard would be 1


def plain_audit(rows, labels):
    ids = {}
    for d, t, _ in rows:
        if d is not None:
            ids[t or ""] = min(ids.get(t or "", d), d)

    def fails(d, t):
        t = t or ""
        w = WORD.findall(t)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > ids[t]}

    judged = [(s or "", fails(d, t), any(q == 1 for i, q, _ in labels if i == d and d is not None), any(x == 1 for i, _, x in labels if i == d and d is not None)) for d, t, s in rows]
    out = set()
    for part in {s for s, *_ in judged}:
        own = [r for r in judged if r[0] == part]
        total, found = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                total[f] += len(gone)
                redundant = sum(r[1][f] for r in own) - len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                found.append((part, order, step, len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out |= {(*r, total[r[1][r[2] - 1]]) for r in found}
    return out


def test_audit(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["LOUD", "#tag", "A&B"]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (0, 3, 150, 220, 400, 1500, 5000) for _ in range(4)] + ["same " * 250, None, "", " \t\n", "漢字😀 " * 300]
    rows = [(int(i), texts[rng.integers(len(texts))], ["a", "b", "", None][rng.integers(4)]) for i in range(300)]
    rows += [(None, texts[5], "a"), (None, texts[5], None), (7, rows[7][1], "b"), (7, rows[7][1], "a"), (8, "another text of 8", "a"), (2000, texts[5], "alone")]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in rng.integers(0, 300, 150)] + [(None, 1, 1), (3, None, None)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(audit.mask_counts(documents(spark, rows), told)).collect()
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[k] for k in names) for r in got} == plain_audit(rows, labels) and len(got) == 600 * 4
    assert audit.audit(audit.mask_counts(documents(spark, rows).where("false"), told)).count() == 0


def test_removal_polynomial():
    counts = np.random.default_rng(0).integers(0, 1 << 33, (3, audit.MASKS))
    f = audit.coefficients(counts)
    masks = np.arange(audit.MASKS)
    assert (audit.corners(f) == np.array([[c[(masks & t) != 0].sum() for t in masks] for c in counts])).all()
    want = [[sum(int(c[m]) * 120 // int(m).bit_count() for m in masks if m >> i & 1) for i in range(5)] for c in counts]
    assert audit.shapley(f).tolist() == want


def plain_codes(rows, rounds=6, entries=16):
    rows = sorted(((i is None, i or 0, [int(np.floor(4096 * float(x))) for x in v]), i, label) for i, v, label in rows if v and not any(x is None or not np.isfinite(x) for x in v) and len(v) % 8 == 0)
    dim = len(rows[0][0][2])
    rows = [(i, v[2], label) for v, i, label in rows if len(v[2]) == dim]
    part = dim // 8
    cut = lambda v: [v[p * part : (p + 1) * part] for p in range(8)]
    books = [[cut(v)[p] for _, v, _ in rows[:entries]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, p: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(x, p)[1] for p, x in enumerate(cut(v))] for _, v, _ in rows]
        for p in range(8):
            for e in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), o in zip(rows, own, strict=True) if o[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, label, [near(x, p) for p, x in enumerate(cut(v))]) for i, v, label in rows]
    error = lambda f: sum(d for d, _ in f)
    sums = {}
    for _, label, f in found:
        sums[label] = sums.get(label, 0) + error(f)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), error(f), sums[label]) for i, label, f in found), sha


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "own") for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)


@pytest.mark.parametrize("dim", [8, 24, 64])
def test_codes(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(0, 0.2, (60, dim)).astype(np.float32)
    rows = [(int(i), base[rng.integers(60)].tolist() if i % 2 else rng.normal(0, 1, dim).astype(np.float32).tolist(), [0, 1, None][i % 3]) for i in range(200)]
    rows += [(300 + i, base[0].tolist(), 7) for i in range(100)]  # a hot vector
    rows += [(0, rows[0][1], 0), (None, rows[5][1], None), (500, None, 1), (501, [], 1), (502, [float("nan")] * dim, 1), (503, [float("inf")] + [0.0] * (dim - 1), 1), (504, [None] + [0.5] * (dim - 1), 1), (505, [0.5] * (dim + 8), 1), (506, [0.5] * 3, 1)]
    model = codes.train(vectors(spark, rows))
    got = codes.encode(model).collect()
    want, sha = plain_codes(rows)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got) == want and model.sha256() == sha


def test_codes_of_few_or_no_vectors(spark):
    rows = [(2, [0.25] * 16, None), (1, [-0.3] * 16, 3), (3, [0.25] * 16, None)]
    model = codes.train(vectors(spark, rows))
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in codes.encode(model).collect()) == plain_codes(rows)[0]
    none = codes.train(vectors(spark, rows).where("false"))
    assert codes.encode(none).count() == 0 and len(none.sha256()) == 64
    with pytest.raises(Exception, match="too large"):
        codes.encode(codes.train(vectors(spark, [(1, [1e9] * 16, 1)]))).collect()


def test_bounds_are_conservative():
    rng = np.random.default_rng(3)
    for scale in (1, 50, 1 << 26):
        x, book = rng.integers(-scale, scale + 1, (3000, 8)), rng.integers(-scale, scale + 1, (16, 8))
        book[9] = book[4]  # a tie
        d = ((x[:, None, :] - book) ** 2).sum(axis=2)
        own, far = codes.nearest(x, book)
        assert (own == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
        for starts in codes.levels(8):
            size, xm, xr = codes._blocks(x, starts)
            _, cm, cr = codes._blocks(book, starts)
            bound = (size * (xm[:, None] - cm) ** 2 + (xr[:, None] - cr) ** 2).sum(axis=2)
            assert (bound * (1 - 1e-9) - 1 <= d).all()


def test_crc_of_no_text(spark):
    from recordloom.llm.queries import op11_sharding  # noqa: F401

    got = spark.sql("SELECT crc32(encode(coalesce(CAST(NULL AS STRING), ''), 'UTF-8')) c").first()["c"]
    assert got == zlib.crc32(b"") and brute.crc([]) == got and F is not None
