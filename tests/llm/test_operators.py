"""Every operator on odd rows, against the plain versions in brute.py."""

import hashlib
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from recordloom.llm import audio, chat, components, language, minhash, packing, pieces, quality, queries, repeats, tokens, toxicity, wavelet
from recordloom.llm.core import bounded_ids, materialize, memory, one_text, recorded, release, worker

WORDS = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "ember", "falcon", "garden", "harbor", "island"]


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 12, n), rng.integers(0, 9, n), strict=True))


BASE = sentence(1, 120)
NEAR = BASE.split()
NEAR[60] = "changed"
TEXTS = [
    BASE, BASE, " ".join(NEAR), sentence(2, 40) + " " + sentence(1, 30), None, "", " \n\t ", "one two", "One  two", sentence(3, 9), "éà ß 漢字 😀 " * 30,
    "same line here\nsame line here\n\n" * 8, sentence(4, 20_000), "x" * 49, "x" * 50, "y" * 200, "y" * 200 + "z", "<|endoftext|> ▁▁ don't \\ \x00 \x1f", sentence(5, 60) + "\n" + sentence(6, 60), sentence(6, 60) + "!",
]
IDS = list(range(100, 100 + len(TEXTS)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, ["en", "fr", None][i % 3], "s", len(t or ""), "clash", "clash", "clash") for i, (d, t) in enumerate(zip(IDS, TEXTS, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    """The library as it loads the file, apart from the operators' own object."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def by_id(df):
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r for r in rows}


def test_token_memo_equals_the_library(tokenizer):
    texts = [t or "" for t in TEXTS] + ["a  b\t\nc", "'90s don't ", "1½²x", " ſtraße ʰa", "\x1c\x1d", "é b", "a <|endoftext|> b", "<|endoftext|>", "漢 <|endoftext|><|endoftext|>", "<|endoftext"]
    assert [x.tolist() for x in tokens.encoder(tokens.default_path()).encode_all(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_wavelet(docs, empty, tokenizer):
    shards = wavelet.write_shards(docs, shard_tokens=3000)
    got, start = by_id(wavelet.document_table(shards)), 0
    for d, t in zip(IDS, TEXTS, strict=True):
        own = brute.token_ids(t, tokenizer)
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(own), brute.crc(own))
        start += len(own)
    assert shards.count() > 3 and wavelet.document_table(wavelet.write_shards(empty)).count() == 0


def test_wavelet_of_one_repeated_id(spark, tokenizer):
    texts = [sentence(200 + k, 20 + k) for k in range(40)]
    df = spark.createDataFrame([(7, t) for t in texts] + [(None, t) for t in texts], "doc_id long, text string").repartition(3)
    shards = wavelet.write_shards(df, shard_tokens=2000)
    assert shards.select("part").distinct().count() > 2  # neither id is one task's alone
    rows = sorted(wavelet.document_table(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None] * 40 + [7] * 40
    assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1])
    assert sorted(r["ids_crc32"] for r in rows[40:]) == sorted(brute.crc(brute.token_ids(t, tokenizer)) for t in texts)


def test_wavelet_rank_and_select():
    ids = np.random.default_rng(0).integers(0, 300, 20_000).astype(np.uint16) ** 2 % 40_000
    ids = ids.astype(tokens.DTYPE)
    w = wavelet.WaveletMatrix.build(ids)
    assert (w.decode() == ids).all()
    for i in (0, 1, 4095, 4096, 9999, 19_999):
        assert w.access(i) == ids[i]
    for token in (int(ids[0]), int(ids[777]), 39_999):
        at = np.flatnonzero(ids == token)
        assert w.rank(token, 12_345) == (at < 12_345).sum() and w.rank(token, len(ids)) == len(at)
        assert [w.select(token, k) for k in (0, len(at) - 1)] == ([at[0], at[-1]] if len(at) else [-1, -1])
        assert w.select(token, len(at)) == -1
    assert wavelet.WaveletMatrix.build(np.zeros(5, tokens.DTYPE)).decode().tolist() == [0] * 5


def test_repeats(docs, empty, monkeypatch):
    want = brute.repeats(list(zip(IDS, TEXTS, strict=True)))
    for size in (1 << 21, 2000):
        monkeypatch.setattr(repeats, "CHUNK_BYTES", size)
        got = by_id(repeats.remove_repeats(docs, prefix="_"))
        assert {d: (r["_n_bytes"], r["_n_removed"], r["_n_spans"], r["_kept_sha256"]) for d, r in got.items()} == want
    assert got[IDS[0]]["kept"] == "clash" and got[IDS[4]]["text"] is None and got[IDS[1]]["text"] == ""
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_of_one_doc_id_and_random_texts(spark):
    rng = np.random.default_rng(3)
    parts = ["".join(rng.choice(list("ab"), 60)) for _ in range(12)]
    texts = [(i, "".join(parts[k] for k in rng.integers(0, 12, rng.integers(1, 6)))) for i in range(60)]
    got = by_id(repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == brute.repeats(texts)
    alone = repeats.remove_repeats(spark.createDataFrame([(k, sentence(90 + k, 40)) for k in range(3)], "doc_id long, text string").repartition(1))
    assert [r["n_removed"] for r in alone.collect()] == [0, 0, 0]
    twice = repeats.remove_repeats(spark.createDataFrame([(1, BASE), (1, BASE), (2, BASE)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in twice) == [(1, 0), (1, 0), (2, len(BASE))]


def test_maximal_repeats_of_a_suffix_array():
    text = [b"AB" + b"c" * 60 + b"XY", b"DE" + b"c" * 60 + b"ZW"]
    sizes = np.array([64, 64])
    found = repeats.SuffixArray(np.frombuffer(b"".join(text), np.uint8), sizes).maximal_repeats()
    assert (60, 2) in {(length, stop - first) for length, first, stop in found}
    groups = {length for length, _, _ in found}
    assert max(groups) == 60 and all(50 <= g <= 60 for g in groups)


def repeats_of(rows, texts):
    """{(string, places)} of maximal_repeats, each checked: equal bytes at all places, and no place left out."""
    groups = {}
    for r in rows:
        groups.setdefault((r["repeat"], r["length"], r["occurrences"]), set()).add((r["doc_id"], r["start"]))
    out = set()
    for (_, length, n), places in groups.items():
        strings = {texts[d].encode()[i : i + length] for d, i in places}
        assert len(strings) == 1 and len(places) == n > 1 and length >= 50 and len({d for d, _ in places}) > 1
        own = strings.pop()
        everywhere = {(d, i) for d, t in texts.items() for i in range(len(t.encode())) if t.encode().startswith(own, i)}
        assert len(own) == length and places == everywhere
        out.add((own, frozenset(places)))
    assert len(out) == len(groups)
    return out


def whole(repeat, groups):
    """Is the repeat, with just its places, inside one group?"""
    own, places = repeat
    return any(frozenset((d, i + k) for d, i in p) == places for s, p in groups if len(p) == len(places) for k in range(len(s) - len(own) + 1) if s.startswith(own, k))


def test_maximal_repeats_have_all_occurrences(spark, monkeypatch):
    a, b, c = sentence(8, 30), sentence(9, 60), sentence(10, 25)
    texts = {1: a + " mid " + b, 2: "other start " + a + " end", 3: "third " + a + " fin " + b + "!", 4: b, 5: c + " x " + c, 6: c, 7: "no repeat here", 8: sentence(11, 300), 9: sentence(11, 300), 10: "", 11: "q" * 300, 12: "q" * 290}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for size in (1 << 21, 400):
        monkeypatch.setattr(repeats, "CHUNK_BYTES", size)
        got = repeats_of(repeats.maximal_repeats(df).collect(), texts)
        plain = brute.unbranched_repeats(texts.items())
        assert len(plain) > 5 and all(whole(x, got) for x in plain)
        # whole repeats of any length: copies, and what three documents have
        assert (texts[8].encode(), frozenset({(8, 0), (9, 0)})) in got
        assert any(len(s) >= len(a) and len(p) == 3 for s, p in got) and any(s.startswith(c.encode()) and len(p) == 3 for s, p in got)
        # every repeated window is in a group that has just its places
        inside = {}
        for s, p in got:
            for i in range(len(s) - 49):
                inside.setdefault(s[i : i + 50], []).append(frozenset((d, j + i) for d, j in p))
        for w, p in brute.window_places(texts.items()).items():
            if len({d for d, _ in p}) > 1:
                assert frozenset(p) in inside[w]
    assert repeats.maximal_repeats(df.limit(0)).count() == 0


def test_maximal_repeats_of_random_texts(spark):
    rng = np.random.default_rng(12)
    parts = ["".join(rng.choice(list("abcd"), n)) for n in (40, 55, 70, 90, 130)]
    texts = {i: "".join(parts[k] for k in rng.integers(0, 5, rng.integers(1, 6))) for i in range(25)}
    got = repeats_of(repeats.maximal_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)
    assert all(whole(x, got) for x in brute.unbranched_repeats(texts.items()))


def test_a_region_whose_bytes_differ_from_the_compared_ones_stays(spark, monkeypatch):
    """Were two regions' hashes to agree by chance, the check hash would keep the bytes."""
    row = {"doc_ids": np.array([2], "<i8").tobytes(), "lengths": np.array([len(BASE)], "<i8").tobytes(), "n_bytes": len(BASE), "bytes": repeats.zstandard.compress(BASE.encode())}
    chunk = repeats.Chunk(row)
    places = repeats.Places(chunk)
    n = len(places.entries)
    answer = repeats._structured(repeats.ANSWER, entry=np.arange(n), first=np.zeros(n), windows=places.entries["size"] - 49, doc=np.ones(n), check=places.checks())
    pack = lambda a: [repeats.zstandard.compress(a.tobytes())]
    assert repeats._covered(chunk, pack(answer)).all()
    answer["check"] ^= np.uint64(1)
    assert not repeats._covered(chunk, pack(answer)).any()


def test_packing(docs, empty, tokenizer):
    rows = packing.pack(docs).collect()
    ids = {d: brute.token_ids(t, tokenizer) for d, t in zip(IDS, TEXTS, strict=True)}
    for r in rows:
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == brute.crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    for d, own in ids.items():
        assert sorted(x for r in rows if r["doc_id"] == d for x in range(r["start"], r["start"] + r["length"])) == list(range(len(own)))
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert sequences.get(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(sequences.values())[1:] == [1024] * (len(sequences) - 1) and sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(empty).count() == 0


def test_packing_repeated_rows(spark):
    df = spark.createDataFrame([(1, BASE), (1, BASE), (None, "x")], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_projection_of_hashed_vectors():
    ids = np.random.default_rng(1).integers(0, 50_000, 500)
    hashed = np.bincount(packing.buckets(ids), minlength=1 << packing.HASHED)  # the document's vector
    assert len(hashed) == 1 << packing.HASHED and (hashed @ packing.projection() == packing.weights()[ids].sum(axis=0)).all()


def test_hilbert_neighbours_touch():
    side = 1 << 3
    cells = np.stack(np.meshgrid(np.arange(side), np.arange(side), indexing="ij"), -1).reshape(-1, 2)
    order = cells[np.argsort(packing.hilbert(cells, 3))]
    assert sorted(packing.hilbert(cells, 3).tolist()) == list(range(side * side))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "[\\INST", "a\\\\</s>\\", None, "", "x] y", "line\n[/INST]</s>", "long word " * 300]
    rows = [(7, i, ["system", "user", "assistant", "tool] x", None][i % 5] if i else "system", t) for i, t in enumerate(odd)] + [(8, 0, "assistant", "a"), (8, 0, "assistant", "a"), (None, 1, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(turns, budget=40, history=20)
    back = chat.read_back(windows).collect()
    for conv in (7, 8, None):
        got = [(r["role"], r["text"]) for r in sorted((r for r in back if r["conv_id"] == conv and r["fresh"]), key=lambda r: (r["window_id"], r["nth"]))]
        want = [((r[2] or ""), r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        assert got == want
        loss = [r["text"] for r in sorted((r for r in back if r["conv_id"] == conv and r["loss"]), key=lambda r: (r["window_id"], r["nth"]))]
        assert loss == [t for role, t in want if role == "assistant"]
    assert len([r for r in back if r["conv_id"] == 7 and not r["fresh"]]) > 3  # repeated system turn and history
    first = {r["window_id"]: r for r in back if r["conv_id"] == 7 and r["nth"] == 0}
    assert all(r["role"] == "system" for r in first.values())
    for w in windows.collect():
        for s in w["spans"]:
            assert w["formatted"][s["begin"] + s["length"] :].startswith(chat.END)
    assert chat.format_windows(turns.limit(0)).count() == 0


def test_chat_windows_keep_to_the_budget(spark):
    rng = np.random.default_rng(8)
    rows = [(c, i, "system" if not i and c % 2 else ["user", "assistant"][i % 2], sentence(100 * c + i, int(rng.integers(1, 60)) if i % 13 else 4)) for c in range(6) for i in range(60)]
    rows += [(9, 0, "system", sentence(1, 20)), (9, 1, "user", sentence(2, 300)), (9, 2, "assistant", sentence(3, 5))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    budget, history = 200, 40
    windows = chat.format_windows(turns, budget, history).collect()
    long = [w for w in windows if w["n_tokens"] > budget]
    assert len(long) == 1 and long[0]["conv_id"] == 9  # its turn alone is longer
    tokens = {(r["conv_id"], r["turn"]): r["n"] for r in turns.select("conv_id", "turn", chat.n_tokens(F.col("text")).alias("n")).collect()}
    for c in range(6):
        mine = sorted((w for w in windows if w["conv_id"] == c), key=lambda w: w["window_id"])
        assert [w["window_id"] for w in mine] == list(range(len(mine)))
        lead = tokens[c, 0] if c % 2 else 0
        room, fresh = budget - history - lead, [sum(s["fresh"] for s in w["spans"]) for w in mine]
        assert sum(fresh) == 60
        at = 0
        for w, n in zip(mine, fresh, strict=True):  # consecutive new turns that fit the room, beside the system turn and the history
            own = [tokens[c, k] for k in range(at, at + n)]
            assert sum(own) - (lead if at == 0 else 0) <= room
            assert w["n_tokens"] - sum(own) <= history + lead
            at += n
        # cuts at multiples of the room: no more than two windows for each
        assert len(mine) <= 2 * (1 + (sum(tokens[c, k] for k in range(60)) - lead) // room)


def test_quality(spark, docs, empty):
    stats = quality.with_stats(docs.select("doc_id", "lang", "text"))
    got = by_id(stats)
    for d, t in zip(IDS, TEXTS, strict=True):
        r = got[d]
        n = brute.rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged = quality.judge(stats, quality.calibrate(stats, no_labels))
    assert judged.where("kept = base_failed").count() == 0
    assert quality.judge(quality.with_stats(empty.select("doc_id", "lang", "text")), quality.calibrate(stats, no_labels)).count() == 0


def test_quality_cutoffs_keep_their_guarantee(spark):
    n = 3000
    rows = [(i, "en", 1000, 5000, 700 if i < 3 else 5, 0, 0, False) for i in range(n)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)] + [(5, 1, 0)], "doc_id long, quality int, toxic int")
    cut = quality.calibrate(stats, labels).first()
    # 3 rejections of 3000 are certified at 0.5 %: P(Bin(3000, 0.005) <= 3) is about 2e-4 < 0.05 / 20
    assert cut["cut_symbol_rate"] == 50 and cut["cut_word_length"] == 7000
    few = quality.calibrate(stats.where("doc_id < 300"), labels).first()
    assert few["cut_symbol_rate"] is None


@pytest.mark.parametrize("n, x, p", [(10, 2, 0.3), (1000, 3, 0.01), (100_000, 400, 0.005), (50, 0, 0.1)])
def test_binomial_tail(spark, n, x, p):
    from math import exp, lgamma, log

    exact = sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)) for k in range(x + 1))
    got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(x).cast("long"), p)).first()[0]
    assert abs(got - exact) < 1e-7 * max(exact, 1e-3)


def test_near_duplicates(spark, docs, empty):
    want = brute.near(list(zip(IDS, TEXTS, strict=True)))
    got = by_id(minhash.near_duplicates(docs))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())
    assert got[IDS[1]]["component_id"] == IDS[0] and got[IDS[2]]["component_id"] == IDS[0]
    assert minhash.near_duplicates(empty).count() == 0
    twice = minhash.near_duplicates(spark.createDataFrame([(1, BASE), (1, BASE), (1, "a b")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and all(r["component_id"] == 1 for r in twice)


def test_one_of_each_group_and_null_ids(spark):
    other = sentence(77, 60)
    rows = [(3, BASE, 1), (5, BASE, 2), (5, other, 3), (None, BASE, 4), (None, "alone " + sentence(78, 50), 5), (None, "", 6), (9, None, 7), (9, None, 8), (3, BASE, 9), (None, sentence(79, 50), 10), (None, sentence(79, 50), 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `group` int").repartition(3)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert (None, 3, False) in got and (5, 3, False) in got and (5, 5, True) in got and (None, None, True) in got
    left = minhash.one_of_each_group(df).collect()
    assert left[0].asDict().keys() == {"doc_id", "text", "group"}
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted((d or 0, t or "") for d, t, n in rows if n in (1, 3, 5, 6, 7, 8, 10))
    assert minhash.one_of_each_group(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1 << 21, 900])
def test_near_duplicate_families(spark, monkeypatch, limit):
    """Copies of copies, chains and classes over block borders."""
    monkeypatch.setattr(minhash, "CLUSTER_SHINGLES", limit)
    rng = np.random.default_rng(5)
    texts = []
    for family in range(4):
        now = sentence(50 + family, 150).split()
        for _ in range(25):
            own = list(now)
            for k in rng.integers(0, len(own), rng.integers(0, 6)):
                own[k] = f"new{rng.integers(0, 1000)}"
            texts.append(" ".join(own))
            if rng.random() < 0.4:
                now = own
    rows = list(enumerate(texts))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute.near(rows)


def test_bbit_estimate():
    rng = np.random.default_rng(0)
    a, own = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64)), rng.integers(0, 1 << 63, 300).astype(np.uint64)
    b = np.unique(np.concatenate([a[300:], own]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(minhash.estimate(minhash.signature(minhash.minima(a)), minhash.signature(minhash.minima(b))[None])[0] - true) < 0.15


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}


def test_merge_dropout(docs, empty):
    model = pieces.model_at(pieces.default_path())
    plain = pieces.Pieces(model, 0.0, 1)
    for t in filter(None, TEXTS):
        if "▁" not in t and "\x00" not in t:
            assert plain.encode(t).tolist() == model.library.encode(t)
    got = by_id(pieces.encode(docs))
    assert all(r["lossless"] for r in got.values())
    for d, t in zip(IDS, TEXTS, strict=True):
        assert pieces.decode(np.frombuffer(got[d]["ids"], "<u2"), model) == (t or "") if t else got[d]["n_pieces"] == 0
    assert got[IDS[0]]["ids"] == got[IDS[1]]["ids"]
    other = by_id(pieces.encode(docs, dropout=0.5, seed=99))
    assert other[IDS[0]]["ids"] != got[IDS[0]]["ids"] and other[IDS[0]]["n_pieces"] > 1.2 * len(plain.encode(BASE)) and all(r["lossless"] for r in other.values())
    assert pieces.encode(empty).count() == 0


def test_merge_dropout_of_every_occurrence():
    model = pieces.model_at(pieces.default_path())
    table, long = pieces.Pieces(model, 0.1, 17), "abcdefghij" * 30
    cuts = {}
    for k in range(200):
        text = f"{k} " + "extraordinary " * 50 + long
        ids = table.encode(text)
        # nothing remembered: the same
        assert pieces.Pieces(model, 0.1, 17).encode(text).tolist() == ids.tolist() and pieces.decode(ids, model) == text
        shown = " ".join(model.pieces[i] for i in ids.tolist())
        cuts[k] = [x.replace(" ", "|") for x in re.findall(r"▁(?:(?!▁).)*y(?= ?▁)", shown) if x.replace(" ", "") == "▁extraordinary"]
    assert min(len(set(c)) for c in cuts.values()) > 4  # inside one document
    assert len({c[0] for c in cuts.values()}) > 4  # among documents
    for rate in (0.0, 0.1, 0.5, 1.0):
        found = pieces.skips(7, np.arange(20_000), 0, rate)
        assert max(abs((found >> np.uint32(i) & 1).mean() - rate) for i in range(32)) < 0.02


def plain_agenda(unit, model, skipped):
    """The agenda as its definition says: all candidates anew at each step, the best rank first, then the leftmost."""
    symbols, gone, steps = list(unit.replace(" ", "▁")), set(), 0
    while True:
        ways = [(model.rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in model.rank and i not in gone]
        if not ways:
            return [model.ids[s] for s in symbols], steps
        _, i = min(ways)
        steps += 1
        if skipped >> (steps - 1) & 1:
            gone.add(i)
            continue
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        # places behind move up; the pairs beside the new symbol are new candidates
        gone = {g - (g > i) for g in gone if g not in (i - 1, i, i + 1)}


@pytest.mark.parametrize("rate", [0.1, 0.5])
def test_merge_dropout_against_a_plain_agenda(rate):
    model = pieces.model_at(pieces.default_path())
    rng = np.random.default_rng(6)
    letters = list("etaoinshrdlucmfwypvbgkqjxzéüñß")
    units = [" " * (k % 3) + "".join(rng.choice(letters, n)) for n in (*range(1, 30), 40, 63, 64, 65, 100, 200) for k in range(12)]
    units += [" internationalization", " the", " thethethethethethethethe", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "....", " !!", "\t"] * 4
    if any(len(set(u) - set("".join(model.ids))) for u in units):
        units = [u for u in units if set(u.replace(" ", "▁")) <= set(model.ids)]
    words = 3 * 210 // 32 + 1
    bits = pieces.skips(99, np.arange(len(units))[:, None], np.arange(words), rate)
    table = pieces.Pieces(model, rate, 1)
    ids, begin, size, steps = table._cut_all(units, bits)
    for k, unit in enumerate(units):
        skipped = int.from_bytes(bits[k].tobytes(), "little")
        want = plain_agenda(unit, model, skipped)
        assert (ids[begin[k] : begin[k] + size[k]].tolist(), steps[k]) == want == pieces.segment(unit, model, skipped)
    text = "".join(f" {u.strip()}" for u in units if u.strip())
    got, at = table.encode(text).tolist(), 0
    cut = (pieces._PLAIN_UNITS if pieces._PLAIN.fullmatch(text) else pieces._UNITS).findall(" " + text)
    own = pieces.skips(pieces.variant(text, 1), np.arange(len(cut))[:, None], np.arange(words), rate)
    for unit, b in zip(cut, own, strict=True):
        want = plain_agenda(unit, model, int.from_bytes(b.tobytes(), "little"))[0]
        assert got[at : at + len(want)] == want
        at += len(want)
    assert at == len(got)


def test_merge_dropout_memory_starts_anew(monkeypatch):
    model = pieces.model_at(pieces.default_path())
    texts = [sentence(k, 40) + " 漢字 ▁ " + "ab" * 80 for k in range(30)] + ["", "x"]
    want = [x.tolist() for x in pieces.Pieces(model, 0.1, 17).encode_all(texts)]
    monkeypatch.setattr(pieces, "MEMORY", 50)
    monkeypatch.setattr(pieces, "BATCH", 100)
    table = pieces.Pieces(model, 0.1, 17)
    assert [x.tolist() for x in table.encode_all(texts)] == want == [table.encode(t).tolist() for t in texts]


def test_language(spark, empty):
    sounds = {"en": "the of and tion ing", "de": "der und schaft ung ich", "fr": "eau les que ment oux", "es": "cion los que mente ado"}
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(sounds[k].split()) + rng.choice(["", " "]) for _ in range(40)), k) for i in range(240) for k in [list(sounds)[i % 4]]]
    rows += [(1000, None, "en"), (1001, "123 !!", None), (1002, "", "de"), (1003, rows[2][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = by_id(language.predict(df, language.train(df)))
    held = [r for r in got.values() if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 50 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert [(got[d]["lang_pred"], got[d]["score"]) for d in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003]["lang_pred"] == got[2]["lang_pred"] and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language.train(empty)
    assert {r["lang_pred"] for r in language.predict(df, nothing).collect()} == {"und"} and language.predict(empty, nothing).count() == 0


def test_language_models_against_plain_versions():
    rng = np.random.default_rng(3)
    kinds = {"en": "the of and", "de": "der und ich", "fr": "les que oux", "es": "los que ado"}
    langs = [k for k in kinds for _ in range(30)]
    texts = [" ".join(rng.choice([*kinds[k].split(), "abc", "xyz"], 25)) for k in langs]
    model = language.fit([language.counted(t) for t in texts], langs)
    x = np.array([np.bincount(language.trigrams(t), minlength=language.DIMS) / len(language.trigrams(t)) for t in texts])
    assert set(model["models"]) == {("germanic", "romance"), ("de", "en"), ("es", "fr")}
    for (a, b), w in model["models"].items():
        label = np.array([model["family"][k] if a == "germanic" else k for k in langs])
        rows = (label == a) | (label == b)
        y, own = np.where(label[rows] == a, 1.0, -1.0), np.column_stack([x[rows] * np.sqrt(language.DIMS), np.ones(rows.sum())])
        plain = np.append(w[:-1] / np.sqrt(language.DIMS), w[-1]).astype(float)
        # squared hinge with C = 1 and balanced classes: the loss's slope vanishes at its minimum
        slack = np.maximum(0, 1 - y * (own @ plain)) * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
        assert np.abs(plain - 2 * (slack * y) @ own).max() < 1e-3 * np.abs(plain).max()
    packed = language._packed(model)
    for t, row in zip(texts, x, strict=True):
        margin = {pair: row @ w[:-1] + w[-1] for pair, w in model["models"].items()}
        near, far = ("de", "en"), ("es", "fr")
        duel = near if margin["germanic", "romance"] > 0 else far  # the family first, then the pair inside it
        assert language.classify(t, packed)[0] == duel[int(margin[duel] < 0)]


def test_bounded_ids_of_one_large_class(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 > 0, "big").otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("k"))
    rows = rows.union(rows.limit(10)).union(spark.createDataFrame([(1, None)], rows.schema))
    picked = bounded_ids(rows, 30, "k", 4)
    got = picked.groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"big": 30, "c0": 30, "c1": 30, "c2": 30}
    assert picked.distinct().count() == 120 and sorted(map(tuple, picked.collect())) == sorted(map(tuple, bounded_ids(rows.repartition(7), 30, "k", 4).collect()))
    assert bounded_ids(rows.limit(0), 30, "k", 4).count() == 0


def test_bounded_ids_count_ids_not_rows(spark):
    """A class of few ids in many rows keeps them all; a sample has one row of each."""
    few = spark.range(100_000).select((F.col("id") % 20).alias("doc_id"), F.lit("few").alias("k"))
    rows = few.union(spark.range(1000, 4000).select("id", F.lit("many"))).union(spark.range(50).select(F.lit(None).cast("long"), F.lit("few")))
    got = bounded_ids(rows, 150, "k", 4).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"few": 20, "many": 150}
    texts = few.withColumn("text", F.when(F.col("doc_id") > 0, F.concat(F.lit("t"), (F.rand(1) * 5).cast("int").cast("string"))))
    one = one_text(texts, "doc_id", "k").collect()
    assert len(one) == 20 and {r["text"] for r in one if r["doc_id"] == 0} == {None} and all(r["text"] for r in one if r["doc_id"])


def test_training_on_one_id_of_many_rows(spark):
    """Rows of one id are one row of the sample, for languages and for toxicity; predictions still cover every row."""
    base = [(i, sentence(i, 20) if i % 2 else "le la les des une " * 6 + str(i), "en" if i % 2 else "fr") for i in range(60)]
    rows = base + [(1000, f"the same id again {i}", "en") for i in range(500)] + [(None, "no id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = language.predict(docs, language.train(docs, 30))
    assert found.count() == len(rows) and found.where("doc_id % 2 = 0 AND doc_id < 60 AND lang_pred = 'fr'").count() >= 28
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in [*range(60), 1000, 1000]], "doc_id long, quality int, bad boolean")
    told = labels.withColumn("toxic", F.col("bad").cast("int"))
    model = toxicity.train(docs, told, queries.CATEGORIES, 40)
    assert toxicity.score(docs.withColumn("p_toxic", F.lit("clash")), model, list(queries.CATEGORIES)).count() == len(rows)


def test_toxicity_chain_against_plain_versions():
    rng = np.random.default_rng(4)
    vocabulary = [f"word{chr(97 + i)}" for i in range(12)] + ["vile", "scum"]
    y = np.array([(i % 3 == 0, i % 4 == 0) for i in range(240)]).astype(int)
    texts = [" ".join([*rng.choice(vocabulary[:12], 8), *(["scum"] if b and rng.random() < 0.9 else []), *(["vile"] if a and rng.random() < 0.9 else [])]) for a, b in y]
    folds = rng.integers(0, 3, 240)
    model = toxicity.fit_chain(texts, y, folds)
    names = sorted({p for t in texts for w in t.split() for p in toxicity.parts(w)})
    x = np.array([[n in {p for w in toxicity.tokens(t) for p in toxicity.parts(w)} for n in names] for t in texts], float)
    earlier = np.zeros((240, 0))
    for k in range(2):
        def sloped(w, chain, bias, rows, k=k, earlier=earlier):
            """Slope of the balanced logistic loss with l2 1e-3 at a model: none over the features it uses, the chain and the bias."""
            used = w != 0
            own, on = np.column_stack([x[rows][:, used], earlier[rows]]), y[rows, k]
            m = own @ np.concatenate([w[used], chain]) + bias
            e = (1 / (1 + np.exp(-m)) - on) * np.where(on > 0, 0.5 / on.sum(), 0.5 / (1 - on).sum())
            return max(np.abs(own.T @ e + 1e-3 * np.concatenate([w[used], chain])).max(), abs(e.sum()))

        w = np.array([model["weights"].get(n, np.zeros(2))[k] for n in names])
        assert sloped(w, model["chains"][k], model["biases"][k], np.arange(240)) < 1e-3
        out = np.zeros(240)
        for f in range(3):  # out of fold: no model scores a row that it has seen
            rows = toxicity.Rows(texts)
            fw, chain, bias = rows.fit(y[:, k].astype(float), earlier, folds != f)
            full = np.array([dict(zip(rows.names, fw, strict=True)).get(n, 0.0) for n in names])
            assert sloped(full, chain, bias, np.flatnonzero(folds != f)) < 1e-3
            out[folds == f] = (x @ full + earlier @ chain + bias)[folds == f]
        earlier = np.column_stack([earlier, np.clip(out, -6, 6)])
    assert len(model["chains"][1]) == 1
    scorer = toxicity.Scorer(model)
    for i, t in enumerate(texts[:50]):
        first = sum(model["weights"][p][0] for p in names if p in model["weights"] and x[i, names.index(p)]) + model["biases"][0]
        second = sum(model["weights"][p][1] for p in names if p in model["weights"] and x[i, names.index(p)]) + model["chains"][1][0] * np.clip(first, -6, 6) + model["biases"][1]
        assert np.allclose(scorer.score(t), [1 / (1 + np.exp(-m)) for m in (first, second)])


def test_toxicity(spark, empty):
    bad = ["vile", "scumbag", "wretch", "idiotic"]
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(400):
        toxic, low = i % 4 == 0, i % 5 == 0
        own = sentence(i, 40).split()
        for _ in range(3):
            own[rng.integers(0, 40)] = rng.choice(bad) if toxic else "fine"
        rows.append((i, " ".join(own) + (" spam spam" if low else "")))
        marks.append((i, 0 if low else 1, int(toxic)))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks[:300], (5, None, 1), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels, queries.CATEGORIES)
    got = by_id(toxicity.score(df, model, list(queries.CATEGORIES)))
    assert all((got[i]["p_toxic"] >= 0.5) == bool(t) for i, _, t in marks[300:])
    assert len(model["chains"][1]) == 1  # the second model takes the first one's log-odds
    assert got[900]["p_toxic"] == got[901]["p_toxic"] < 0.5
    none = toxicity.train(df, labels.limit(0), queries.CATEGORIES)
    assert none is None and toxicity.score(df, none, ["toxic"]).where("p_toxic > 0").count() == 0
    assert toxicity.score(empty, model, ["low_quality", "toxic"]).count() == 0


def test_audio(docs, empty):
    got = by_id(audio.features(audio.store(docs)))
    for d, t in zip(IDS, TEXTS, strict=True):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[d]
        media = audio.wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert all(0 <= s["begin_s"] < s["end_s"] for s in r["spans"])
    assert got[IDS[0]]["feature"] == got[IDS[1]]["feature"] and got[IDS[0]]["feature"] != got[IDS[3]]["feature"]
    import pyarrow as pa

    tensor = pa.ipc.open_stream(got[IDS[12]]["log_mel"]).read_all()["log_mel"].combine_chunks()
    assert tensor.type.shape == [16, 32] and len(tensor) == -(-got[IDS[12]]["n_frames"] // 16)
    assert audio.features(audio.store(empty)).count() == 0


def test_wav_is_readable():
    import io
    import wave

    with wave.open(io.BytesIO(audio.wav(b"abc" * 64))) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate(), f.readframes(192)) == (1, 1, audio.RATE, b"abc" * 64)


def test_audio_blocks_make_the_frames_of_the_whole_file(monkeypatch):
    """Payloads of a block and 192 or 384 bytes more, of two blocks, and of many."""
    rng, unit = np.random.default_rng(1), audio.UNIT
    for n in (1, 2, 3, 7, 8, 9, 10, 16, 17, 40):
        media = audio.wav(rng.integers(0, 256, n * unit).astype(np.uint8).tobytes())
        monkeypatch.setattr(audio, "BLOCK", unit * 4096)
        whole = audio.analyse(media)
        monkeypatch.setattr(audio, "BLOCK", unit * 8)
        parts = audio.analyse(media)
        assert parts["n_frames"] == whole["n_frames"] == max(1, n - 1)
        assert np.abs(parts["patches"].astype(int) - whole["patches"].astype(int)).max() <= 1 and len(parts["patches"]) == len(whole["patches"])
        assert [s["begin_s"] for s in parts["spans"]] == [s["begin_s"] for s in whole["spans"]]


def test_audio_features_against_plain_versions():
    raw = (BASE + "é漢").encode()
    data = np.frombuffer(raw.ljust(-(-len(raw) // 192) * 192), np.uint8)
    x = (data.astype(float) - 128) / 128
    up, down, taps = audio.UP, audio.DOWN, audio.TAPS
    # resampling: zeros stuffed in, one windowed-sinc filter, every DOWN-th value
    t = np.arange(up * taps) - (up * taps - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(up * taps)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    y = np.convolve(stuffed, h * up / h.sum())[: len(stuffed) : down]
    assert np.allclose(audio.resample(x.astype(np.float32)), y, atol=1e-5)
    # log-mel: frame by frame, band by band, triangle by triangle
    rate, rows = audio.RATE * up / down, []
    centres = [700 * (10 ** (k * 2595 * np.log10(1 + rate / 2 / 700) / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    for at in range(0, len(y) - audio.FRAME + 1, audio.HOP):
        power = np.abs(np.fft.rfft(y[at : at + audio.FRAME] * np.hanning(audio.FRAME))) ** 2
        bands = []
        for low, mid, high in zip(centres, centres[1:], centres[2:]):
            bands.append(sum(p * max(0, min((f - low) / (mid - low), (high - f) / (high - mid))) for f, p in zip(np.arange(len(power)) * rate / audio.FRAME, power)))
        rows.append([10 * np.log10(b + 1e-10) + 100 for b in bands])
    found = audio.analyse(audio.wav(data.tobytes()))
    mel = np.array(rows)
    assert found["n_frames"] == len(mel) and np.allclose(audio.log_mel(y.astype(np.float32)), mel, atol=0.05)
    # segments: a switch that goes on at the upper and off below the lower threshold
    energy, spans, on = mel.mean(axis=1), [], None
    for k, e in enumerate([*energy, -1e9]):
        if on is None and e >= np.median(energy) + 3:
            on = k
        elif on is not None and e < np.median(energy) - 1:
            spans.append((on, k))
            on = None
    assert len(spans) > 0 and audio.segments(energy).tolist() == [list(s) for s in spans]
    second = audio.HOP / rate
    assert [(round(s["begin_s"] / second), round(s["end_s"] / second)) for s in found["spans"]] == spans


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 500 * np.arange(12_000) / 12_000).astype(np.float32)
    y = audio.resample(x)
    assert len(y) == 8000 and np.argmax(np.abs(np.fft.rfft(y))) == 500 and 0.8 < np.abs(y[100:-100]).max() < 1.2


def test_hysteresis():
    e = np.array([0, 0, 0, 0, 5, 1, 1, 0, -2, 0, 0, 5, 0], float)
    assert audio.segments(e).tolist() == [[4, 8], [11, 13]]


def test_release_deletes_recorded_tables_only(spark):
    made: list[str] = []
    before = materialize(spark.range(2), "kept")
    with recorded(made):
        inside = materialize(spark.range(3), "gone")
    assert len(made) == 1 and inside.count() == 3
    release(spark, made)
    assert before.count() == 2 and made == []
    outer: list[str] = []
    with recorded(outer):
        found = components.connected(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
        materialize(spark.range(1), "after")
    assert found.count() == 3 and [p.rsplit("/", 1)[1].split("-")[0] for p in outer] == ["labels", "after"]
    with pytest.raises(Exception):
        spark.read.parquet(inside.inputFiles()[0]).count()


def test_null_doc_ids_stay_null(spark):
    df = spark.createDataFrame([(None, BASE), (1, BASE), (2, None)], "doc_id long, text string")
    for made in (wavelet.document_table(wavelet.write_shards(df)), repeats.remove_repeats(df), packing.pack(df), minhash.near_duplicates(df), pieces.encode(df), audio.features(audio.store(df))):
        assert {r["doc_id"] for r in made.collect()} == {None, 1, 2}


def test_workers_forget_what_other_operators_remember(spark):
    """Spark hands a Python worker to the next operator's tasks: the vocabulary's pieces and the hash tables don't add up."""

    def sizes(batches, *own):
        import pyarrow as pa

        def seen(_):
            tokens.encoder(tokens.default_path()), repeats._powers(repeats._P, 10)
            yield from ()

        for keep in own:
            list(worker(seen, *keep)(iter(())))
            list(worker(lambda _: iter(()), *keep)(iter(())))  # the next task
            yield pa.RecordBatch.from_pydict({"tokens": [len(memory("tokens"))], "powers": [len(memory("powers"))]})

    asked = [("tokens",), ("powers",), (), ("tokens", "powers")]
    got = spark.range(1).coalesce(1).mapInArrow(lambda b: sizes(b, *asked), "tokens long, powers long").collect()
    assert [tuple(r) for r in got] == [(1, 0), (0, 1), (0, 0), (1, 1)]
