"""Odd rows that other tests don't have: very long texts, repeated rows, null ids, columns of clashing names."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_operators import BASE, sentence

from recordloom.llm import audio, chat, language, packing, quality, queries, toxicity


def test_packing_follows_the_curve(spark):
    """Documents come in the order of their curve key, then doc_id; like documents are neighbours."""
    rows = [(int(i), sentence(i % 4, 200) + f" {i}") for i in range(60)] + [(100 + i, "漢字 かな 交じり " * 60 + str(i)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    pieces = sorted(packing.pack(docs).select("sequence_id", "offset", "start", "doc_id", "curve_key").collect())
    order = [(r["curve_key"], r["doc_id"]) for r in pieces if r["start"] == 0]
    assert order == sorted(order) and len(order) == 80 and [d for _, d in order] != sorted(d for _, d in order)
    places = [i for i, (_, d) in enumerate(order) if d >= 100]
    assert places[-1] - places[0] == 19  # the other script's documents lie side by side


def test_quality_of_repeated_rows_null_ids_long_texts_and_clashes(spark):
    long = sentence(9, 60_000)
    rows = [(1, "en", BASE, "own"), (1, "en", BASE, "own"), (None, None, BASE, "own"), (2, "en", long, "own"), (3, "en", None, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, kept string")
    stats = quality.with_stats(docs)
    told = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(stats, quality.calibrate(stats, told)).collect()
    assert len(got) == 5 and all(isinstance(r["kept"], bool) for r in got)  # columns of the operator's names are replaced
    by = sorted((str(r["doc_id"]), r["n_words"], r["n_repeat_words"], r["kept"]) for r in got)
    want = [("1", *brute.rules(BASE)[::4], True)] * 2 + [("2", *brute.rules(long)[::4], True), ("3", 0, 0, False), ("None", *brute.rules(BASE)[::4], True)]
    assert by == want


def test_toxicity_of_long_texts_null_ids_and_clashes(spark):
    rows = [(i, ("vile scum " if i % 3 == 0 else "kind words ") + sentence(i, 10), "own") for i in range(90)] + [(None, "vile scum", "own"), (500, "kind " * 100_000 + "vile scum", "own"), (0, "vile scum again", "own"), (0, "vile scum again", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels, queries.CATEGORIES, 60), list(queries.CATEGORIES)).collect()
    assert len(got) == 94 and all(isinstance(r["p_toxic"], float) for r in got)
    bad = {r["doc_id"]: r["p_toxic"] for r in got}
    assert min(bad[None], bad[500], bad[3]) > max(bad[1], bad[2])


def test_language_of_long_and_repeated_texts(spark):
    say = {"en": "the quick brown fox and the lazy dog ", "fr": "le renard brun et le chien paresseux "}
    rows = [(i, say[k] * 3 + str(i), k) for i in range(60) for k in [("en", "fr")[i % 2]]] + [(900, say["fr"] * 20_000, "fr"), (901, say["en"], "en"), (901, say["en"], "en"), (None, say["fr"], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    got = language.predict(docs, language.train(docs, 40)).collect()
    assert len(got) == 64 and all(isinstance(r["score"], float) for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] == 900} == {"fr"} and [r["lang_pred"] for r in got if r["doc_id"] == 901] == ["en", "en"]
    assert {r["lang_pred"] for r in got if r["doc_id"] is None} == {"fr"}


def test_audio_of_repeated_rows_and_a_text_over_a_block(spark):
    long = sentence(3, 150_000)
    assert len(long) > audio.BLOCK
    docs = spark.createDataFrame([(1, BASE, "own"), (1, BASE, "own"), (2, long, "own")], "doc_id long, text string, feature string")
    got = audio.features(audio.store(docs)).collect()
    assert len(got) == 3 and len({r["feature"] for r in got if r["doc_id"] == 1}) == 1
    (r,) = [r for r in got if r["doc_id"] == 2]
    assert r["n_frames"] == r["payload_bytes"] // audio.UNIT - 1 and all(s["end_s"] <= r["payload_bytes"] / audio.RATE for s in r["spans"])


def test_chat_with_clashing_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q", "own"), (1, 1, "assistant", "a", "own")], "conv_id long, turn long, role string, text string, tokens string")
    plain = chat.format_windows(turns.drop("tokens")).collect()
    extra = chat.format_windows(turns.withColumns({"pos": F.lit("own"), "formatted": F.lit("own"), "window_id": F.lit("own")})).collect()
    assert [r.asDict() for r in extra] == [r.asDict() for r in plain]
