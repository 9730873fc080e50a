"""Stage skipping, the feature store and the command line."""

from pyspark.sql import functions as F

from recordloom.__main__ import main
from recordloom.plans.stages import Stages
from recordloom.sources import tables as sources


def test_stage_is_skipped_until_something_changes(spark, tmp_path):
    calls, stages = [], Stages(spark, str(tmp_path / "work"))
    spark.range(3).write.parquet(str(tmp_path / "in"))

    def make():
        calls.append(1)
        return spark.read.parquet(str(tmp_path / "in"))

    for _ in range(2):
        assert stages.run("a", make, [str(tmp_path / "in")]).count() == 3
    assert len(calls) == 1
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "in"))
    assert stages.run("a", make, [str(tmp_path / "in")]).count() == 5 and len(calls) == 2
    stages.run("a", make, [str(tmp_path / "in")], {"k": 1})
    assert len(calls) == 3


def test_feature_groups_join(spark, tmp_path):
    base = spark.range(4).select(F.col("id").alias("rec"), F.col("id").alias("s1"))
    stages = Stages(spark, str(tmp_path))
    got = stages.features({"x": (1, lambda: base.withColumn("x", F.lit(1))), "y": (2, lambda: base.withColumn("y", F.col("rec") * 2))})
    assert sorted(map(tuple, got.select("rec", "s1", "x", "y").collect())) == [(i, i, 1, 2 * i) for i in range(4)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "data" / "train").mkdir(parents=True)
    for n in (1, 2, 3):
        rows = "".join(f"S{n}-{i}\tBlue Ring {i} Ltd\t{i} Main Street, 11001{i}\tUS\n" for i in range(5))
        (tmp_path / "data" / "train" / f"train_source{n}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + rows)
    (tmp_path / "data" / "train" / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\tS2-{i},S3-{i}\n" for i in range(5)))
    common = ["--data", str(tmp_path / "data"), "--work", str(tmp_path / "work")]
    for command, said in (("raw", "15 records"), ("norm", "15 records"), ("block", "pairs"), ("profile", "Missing values")):
        main([command, *common])
        assert said in capsys.readouterr().out


def test_every_command(spark, tmp_path, monkeypatch, capsys):
    """Every command on a small folder of TSV files."""
    import functools

    from recordloom import __main__ as command
    from recordloom.functions.ids import decode_id
    from recordloom.operators import models, synth
    from recordloom.sources import sinks

    words = "red blue green amber silver golden iron copper stone river forest ocean market bakery studio garden".split()
    rows = [(i, 1, f"{words[i % 16]} {words[(i * 7 + 3) % 16]} {words[(i * 5 + i // 16) % 16]} Ltd", f"{i * 13 % 900 + 1} {words[i * 3 % 16]} Street, Ward {i % 9}, {110000 + i}", "US") for i in range(1, 61)]
    s1 = spark.createDataFrame(rows, "id long, src byte, name string, addr string, country string")
    noisy = {2: synth.noisy_records(s1, 2, 0.6, 0.3), 3: synth.noisy_records(s1, 3, 0.6, 0.3, seed=5)}
    for split in ("train", "test"):
        for k, d in ((1, s1), *noisy.items()):
            out = d.select(decode_id(F.col("id")).alias("entity_id"), F.col("name").alias("business_name"), F.col("addr").alias("business_address"), "country")
            sinks.write_tsv(out, f"{tmp_path}/data/{split}/{split}_source{k}.tsv")
    truth = noisy[2].unionByName(noisy[3]).where("s1 >= 0").select("s1", F.col("id").alias("rec"))
    sinks.write_tsv(sinks.grouped_lists(truth, s1.select(F.col("id").alias("s1"))).toDF("source1_entity_id", "matched_entity_ids"), f"{tmp_path}/data/train/train_ground_truth.tsv")
    monkeypatch.setattr(models, "fit_trees", functools.partial(models.fit_trees, rounds=2, depth=3))
    monkeypatch.setattr(models.out_of_fold, "__defaults__", ("fold", 3, "ho", models.fit_trees))

    def run(name, *more):
        capsys.readouterr()
        command.main([name, "--data", f"{tmp_path}/data", "--work", f"{tmp_path}/work", *more])
        return capsys.readouterr().out

    n = int(run("raw").split()[0])
    assert n > 150 and int(run("preprocess").split()[0]) == n and 0 < int(run("slice", "--share", "0.5").split()[0]) < n
    assert int(run("index").split()[0]) > 100 and int(run("block").split()[0]) > 100
    threshold = run("train")
    assert threshold == run("retune") and "macro_f05" in run("evaluate")
    run("predict", "--split", "test")
    found = sources.read_tsv(spark, f"{tmp_path}/work/matches_test", sources.TRUTH_COLUMNS)
    assert found.count() == 60 and found.where("matched_entity_ids <> ''").count() > 40
    run("decide", "--split", "test", "--threshold", "1.1")
    assert sources.read_tsv(spark, f"{tmp_path}/work/matches_test", sources.TRUTH_COLUMNS).where("matched_entity_ids <> ''").isEmpty()
    assert len(run("validate", "--split", "test").strip().split("\n")) == 4 and "Names" in run("profile")  # no fault
