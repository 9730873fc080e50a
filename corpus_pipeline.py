"""From raw documents to packed training sequences, each stage one operator of recordloom.llm.

Stages take (spark, docs, sf_dir); what each returns is written as Parquet and read again as the next one's docs. All
but the last return the columns of docs as they came, whatever else they are called: columns that a stage adds on the way get
names that docs doesn't use.

Defined results: null and empty texts fail the quality rules, so later stages don't see them in a run (each takes them all
the same); rows of one doc_id with several texts are judged one by one; of rows that are repeated exactly, near-dedup keeps
one; null doc_ids stay, behind others in near-dedup and ahead of them in repeat removal; an empty table stays empty.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import language, minhash, packing, quality, repeats
from recordloom.llm.core import materialize, recorded, release, small_batches

#: Packing and classifiers aren't expressible in SQL; tests hold run() against a plain version.
ORACLE_SQL = None

#: Per cent from which the near-dedup stage links a pair.
SIMILARITY = 80


_made: list[str] = []


def _stage(function):
    """A stage's scratch tables go when the next one starts: by then its result has been written and read again."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _made)
        small_batches(spark)
        with recorded(_made):
            return function(spark, docs, sf_dir)

    return run


def _unused(docs: DataFrame, *names: str) -> str:
    """What to put before these names so that docs has none of them."""
    taken, prefix = {c.lower() for c in docs.columns}, "_"
    while any((prefix + k).lower() in taken for k in names):
        prefix += "_"
    return prefix


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and no rule's certified cutoff."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # the statistics cost far more than a second reading of the rows, so they are computed once and kept beside them
    rows = materialize(quality.with_stats(docs.select(F.struct("*").alias("_doc"), "doc_id", "lang", "text")).drop("text"), "quality")
    cutoffs = materialize(quality.calibrate(rows, labels), "cutoffs")
    return quality.judge(rows, cutoffs).where("kept").select("_doc.*")


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    model = language.train(docs)
    before = _unused(docs, "lang_pred", "lang_score")
    names = (f"{before}lang_pred", f"{before}lang_score")
    return language.predict(docs, model, names).where(F.col(names[0]) != language.UND).select(*docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each_group(docs, SIMILARITY)


@_stage
def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; n_chars counted again."""
    cleaned = repeats.remove_repeats(docs, prefix=_unused(docs, *repeats.ADDED))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences along the curve."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("repeat removal", repeat_removal),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Here each result is kept as a table of the shared folder until the process ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
