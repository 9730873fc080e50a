"""The linkage pipeline: normalise, block, prune, score twice (alone, then with clusters), assign, report.

Stages end in tables where a model has to be fitted; everything between is one lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.ids import fold, is_holdout
from recordloom.functions.text import INDIC, normalize_address, normalize_name
from recordloom.operators import blocking, decide, evaluate, lexicon, models, pairs, ranking
from recordloom.sources.scratch import table


@dataclass
class Lexicon:
    """Learned dictionaries as (key, value) tables; empty tables are fine."""

    script_tokens: DataFrame | None = None
    components: DataFrame | None = None
    tokens: DataFrame | None = None
    plain_components: DataFrame | None = None
    french: dict = field(default_factory=lambda: dict(lexicon.FRENCH_TOKENS))


def learn_lexicon(records: DataFrame, truth: DataFrame, sample: int = 600_000) -> Lexicon:
    texts = lexicon.pair_texts(records, truth, sample)
    return Lexicon(lexicon.learn_script_tokens(texts), lexicon.learn_components(texts, records.where("src = 1")), lexicon.learn_tokens(texts))


def normalize(records: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """id, src, country, core, legal, glued, atok, anum, post, indic. French rows use the French tokens and no component map."""
    from recordloom.functions.text import literal_map

    lex = lex or Lexicon()
    as_map = lambda t: lexicon.as_map(t) if t is not None else None
    script, comps, tokens, plain = as_map(lex.script_tokens), as_map(lex.components), as_map(lex.tokens), as_map(lex.plain_components)
    name = normalize_name(F.col("name"), script)
    # one pass over the address: the country picks the maps
    none, french = F.lit(None).cast("map<string,string>"), F.col("country") == "France"
    own_tokens = F.when(french, literal_map(lex.french)).otherwise(none if tokens is None else tokens)
    own_comps, own_plain = (None if m is None else F.when(french, none).otherwise(m) for m in (comps, plain))
    rows = records.withColumns({"_n": name, "_a": normalize_address(F.col("addr"), own_tokens, own_comps, script, own_plain)})
    return rows.select("id", "src", "country", "_n.core", "_n.legal", "_n.glued", "_a.atok", "_a.anum", "_a.post", F.coalesce(F.col("name").rlike(INDIC), F.lit(False)).alias("indic"))


def candidates(norm: DataFrame, channels: dict | None = None) -> DataFrame:
    """Blocked pairs with cosines, ranks, margins and cheap features."""
    norm = table(norm, "normalized")
    s1, rec = norm.where("src = 1"), norm.where("src > 1")
    names = list(channels or blocking.CHANNELS)
    ranked = blocking.block(s1, rec, channels, lambda found: ranking.rank_and_margin(found, {k: f"c_{k}" for k in names}))
    lead = "r_comb" if "comb" in names else f"r_{names[0]}"
    return pairs.cheap_features(ranking.top_counts(ranked, lead), norm)


def rule_score(features: DataFrame) -> DataFrame:
    """p without training: a fixed logistic blend of name, address and number agreement (for tables without truth)."""
    z = -6.0 + 0.05 * F.col("n_tset") + 2.0 * F.col("g_jw") + 0.02 * F.col("a_tset") + 1.5 * F.greatest("h_first_eq", F.lit(0.0)) + F.greatest("post_eq", F.lit(0.0)) - F.col("l_conflict")
    return features.withColumn("p", 1 / (1 + F.exp(-z)))


_PASSES = ("pruner", "first", "second")


@dataclass
class Fitted:
    pruner: list
    first: list
    second: list
    columns: tuple[list[str], list[str], list[str]]
    threshold: float


def save(spark: SparkSession, fitted: Fitted, folder: str) -> None:
    """Models as pyspark.ml folders, columns and threshold as a table beside them."""
    rows = []
    for name, members, columns in zip(_PASSES, (fitted.pruner, fitted.first, fitted.second), fitted.columns, strict=True):
        for i, m in enumerate(members):
            m.write().overwrite().save(f"{folder}/{name}_{i}")
        rows.append((name, len(members), columns, float(fitted.threshold)))
    spark.createDataFrame(rows, "name string, members int, columns array<string>, threshold double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/about")


def load(spark: SparkSession, folder: str) -> Fitted:
    """What save wrote."""
    about = {r["name"]: r for r in spark.read.parquet(f"{folder}/about").collect()}  # a row per pass
    members = [[PipelineModel.load(f"{folder}/{k}_{i}") for i in range(about[k]["members"])] for k in _PASSES]
    return Fitted(*members, tuple(list(about[k]["columns"]) for k in _PASSES), about[_PASSES[0]]["threshold"])


def retune(scored: DataFrame, truth: DataFrame, p: str = "p2") -> float:
    """The threshold again, from saved out-of-fold scores alone: the holdout's rows and entities are left out."""
    people = truth.select("s1").distinct().where(~is_holdout(F.col("s1")))
    return decide.tune_threshold(scored.where("NOT ho"), truth, people, p)


def train(norm: DataFrame, truth: DataFrame, checkpoint=table, channels: dict | None = None, rounds: int | None = None) -> tuple[DataFrame, Fitted]:
    """Scored pairs (p1, p2, out of fold) and the fitted models. checkpoint(df, name) writes a table and reads it back. The pruner is
    cross-fitted on two halves; both passes boost for as long as the held-out fold gains, `rounds` at most (None: as fit_trees says)."""
    long = models.fit_trees if rounds is None else partial(models.fit_trees, rounds=rounds)
    cand = checkpoint(evaluate.attach_labels(candidates(norm, channels), truth), "candidates")
    cheap = models.feature_columns(cand)
    halves = cand.withColumn("_half", fold(F.col("grp"), 2, "half"))
    scored, pruner = models.out_of_fold(halves, cheap, "p_prune", fold="_half", folds=2)
    scored = scored.drop("_half")
    kept = checkpoint(ranking.prune(scored), "pruned")
    feats = checkpoint(pairs.pair_features(kept, norm), "features")
    cols = models.feature_columns(feats)
    p1, first = models.out_of_fold(feats, cols, "p1", fit=long, early=True)
    p1 = checkpoint(p1, "pass1")
    clustered = checkpoint(pairs.cluster_features(p1, norm, "p1", 0.5), "clusters")
    cols2 = [*cols, *[c for c in clustered.columns if c.startswith(("cl_", "p1"))]]
    p2, second = models.out_of_fold(clustered, cols2, "p2", fit=long, early=True)
    p2 = checkpoint(p2, "pass2")
    return p2, Fitted(pruner, first, second, (cheap, cols, cols2), retune(p2, truth))


def score(norm: DataFrame, fitted: Fitted, checkpoint=table, channels: dict | None = None) -> DataFrame:
    """Candidates of new records with p1 and p2."""
    cand = candidates(norm, channels)
    kept = ranking.prune(models.mean_of(fitted.pruner, models.with_columns_of(cand, fitted.columns[0]), "p_prune"))
    feats = checkpoint(models.mean_of(fitted.first, models.with_columns_of(pairs.pair_features(kept, norm), fitted.columns[1]), "p1"), "pass1")
    clustered = models.with_columns_of(pairs.cluster_features(feats, norm, "p1", 0.5), fitted.columns[2])
    return models.mean_of(fitted.second, clustered, "p2")


def predict(norm: DataFrame, fitted: Fitted, checkpoint=table, channels: dict | None = None) -> DataFrame:
    """(rec, s1, p2) of accepted pairs on new records."""
    return decide.assign(score(norm, fitted, checkpoint, channels), "p2", fitted.threshold)
