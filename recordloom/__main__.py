"""python -m recordloom COMMAND --data FOLDER --work FOLDER: the linkage pipeline, stage by stage.

raw: TSV sources and truth to tables. slice: a density-preserving share of them. norm: learn the lexicon and normalise. block:
candidates. train: models, scores and threshold of the train split. predict: scores and match lists of a split by the saved
models. evaluate: quality of the train split's decisions on the
locked holdout and on the rest, at both weights of false positives. retune: the threshold anew from saved scores. decide: match lists
anew from saved scores and a threshold. validate: faults of match lists. profile: a report. preprocess, index: the second
family's prepared records, and candidates from the key index.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from recordloom.functions.ids import decode_id
from recordloom.operators import decide, evaluate, profile, validate
from recordloom.plans import classic_family, linkage
from recordloom.plans.stages import Stages
from recordloom.sources import scratch, sinks
from recordloom.sources import tables as sources


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="recordloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("raw", "slice", "norm", "block", "train", "predict", "evaluate", "retune", "decide", "validate", "profile", "preprocess", "index"))
    parser.add_argument("--data", required=True)
    parser.add_argument("--work", required=True)
    parser.add_argument("--split", default="train")
    parser.add_argument("--threshold", type=float)
    parser.add_argument("--share", type=float, default=0.1)
    parser.add_argument("--force", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("recordloom").getOrCreate()
    stages = Stages(spark, a.work)
    raw = lambda split: stages.run(f"raw_{split}", lambda: sources.load_split(spark, a.data, split), [f"{a.data}/{split}"], {"split": split}, a.force and a.command == "raw")
    truth = lambda: stages.run("truth", lambda: sources.load_truth(spark, f"{a.data}/train/train_ground_truth.tsv"), [f"{a.data}/train"])

    def norm(split: str):
        inputs = [f"{a.work}/raw_train", f"{a.work}/raw_{split}"]
        return stages.run(f"norm_{split}", lambda: linkage.normalize(raw(split), linkage.learn_lexicon(raw("train"), truth())), inputs, {"split": split}, a.force and a.command == "norm")

    def write_lists(threshold: float) -> None:
        """Match lists of the split from its saved scores."""
        people = norm(a.split).where("src = 1").select(F.col("id").alias("s1"))
        kept = decide.assign(spark.read.parquet(f"{a.work}/scores_{a.split}"), "p2", threshold)
        sinks.write_tsv(sinks.grouped_lists(kept, people).toDF("source1_entity_id", "matched_entity_ids"), f"{a.work}/matches_{a.split}")

    if a.command == "raw":
        print(raw(a.split).count(), "records")
    elif a.command == "norm":
        print(norm(a.split).count(), "records")
    elif a.command == "block":
        rows = norm(a.split)
        print(stages.run(f"candidates_{a.split}", lambda: linkage.candidates(rows), [f"{a.work}/norm_{a.split}"], {"split": a.split}, a.force).count(), "pairs")
    elif a.command == "preprocess":
        print(stages.run(f"classic_{a.split}", lambda: classic_family.preprocess(raw(a.split)), [f"{a.work}/raw_{a.split}"], {"split": a.split}, a.force).count(), "records")
    elif a.command == "index":
        rows = norm(a.split)
        print(stages.run(f"index_{a.split}", lambda: classic_family.key_candidates(rows), [f"{a.work}/norm_{a.split}"], {"split": a.split}, a.force).count(), "pairs")
    elif a.command == "slice":
        sources.dev_slice(raw("train"), truth(), a.share).write.mode("overwrite").parquet(f"{a.work}/slice")
        print(spark.read.parquet(f"{a.work}/slice").count(), "records")
    elif a.command == "train":
        scored, fitted = linkage.train(norm("train"), truth())
        scored.write.mode("overwrite").parquet(f"{a.work}/scores_train")
        linkage.save(spark, fitted, f"{a.work}/models")
        print("threshold", fitted.threshold)
    elif a.command == "predict":
        fitted = linkage.load(spark, f"{a.work}/models")
        linkage.score(norm(a.split), fitted).write.mode("overwrite").parquet(f"{a.work}/scores_{a.split}")
        write_lists(a.threshold or fitted.threshold)
    elif a.command == "evaluate":
        scored = spark.read.parquet(f"{a.work}/scores_train")
        print(sinks.markdown_table(evaluate.holdout_report(scored, truth(), threshold=a.threshold), "Quality"))
    elif a.command == "retune":
        print("threshold", linkage.retune(spark.read.parquet(f"{a.work}/scores_train"), truth()))
    elif a.command == "decide":
        write_lists(a.threshold or linkage.load(spark, f"{a.work}/models").threshold)
    elif a.command == "validate":
        lists = sources.read_tsv(spark, f"{a.work}/matches_{a.split}", sources.TRUTH_COLUMNS).toDF("s1_id", "ids")
        ids = raw(a.split).select(decode_id(F.col("id")).alias("id"), "src")
        found = validate.summary(validate.violations(lists, ids.where("src = 1").select("id"), ids.where("src > 1").select("id")))
        print(sinks.markdown_table(found, "Faults"))
    else:
        print(sinks.markdown_table(profile.null_counts(raw(a.split)), "Missing values"))
        print(sinks.markdown_table(profile.text_profile(raw(a.split), "name", ["country"]), "Names"))
    scratch.clear(spark)


if __name__ == "__main__":
    main()
