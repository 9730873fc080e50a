"""Training and scoring on pyspark.ml: boosted trees with cross-fitting, calibration, ensembles, stacking."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = ("rec", "s1", "y", "grp", "ho", "fold", "true_s1", "src", "country")


def feature_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that aren't ids, labels or scores of a pass."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [c for c, t in df.dtypes if t in numeric and c not in META and c not in skip and not c.startswith(("p1", "p2", "p3"))]


def informative(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have at least one of the columns."""
    return df.dropna(how="all", subset=columns)


def with_columns_of(df: DataFrame, columns: list[str], missing: float = -1.0) -> DataFrame:
    """All of columns, filled where the table lacks them or has null."""
    out = df.withColumns({c: F.lit(missing) for c in columns if c not in df.columns})
    return out.fillna(missing, columns)


def fit_trees(df: DataFrame, columns: list[str], label: str = "y", rounds: int = 20, depth: int = 5, weight: str | None = None, seed: int = 1, validation: str | None = None) -> PipelineModel:
    """Gradient-boosted trees; with a validation indicator column, boosting stops when that loss stops falling."""
    options = {"weightCol": weight} if weight else {}
    options |= {"validationIndicatorCol": validation} if validation else {}
    trees = GBTClassifier(labelCol=label, featuresCol="_x", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed, **options)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep"), trees]).fit(df)


def predict(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(df.drop("_x", "rawPrediction", "probability", "prediction"))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def mean_of(models: list[PipelineModel], df: DataFrame, name: str) -> DataFrame:
    """Mean probability of several models."""
    out = df
    for i, m in enumerate(models):
        out = predict(m, out, f"_m{i}")
    total = reduce(lambda a, b: a + b, [F.col(f"_m{i}") for i in range(len(models))])
    return out.withColumn(name, total / len(models)).drop(*[f"_m{i}" for i in range(len(models))])


def out_of_fold(df: DataFrame, columns: list[str], name: str, fold: str = "fold", folds: int = 3, holdout: str = "ho", fit=fit_trees, *, early: bool = False) -> tuple[DataFrame, list[PipelineModel]]:
    """Every training row is scored by the model that didn't see its group; holdout rows by the mean of all models. With early,
    boosting of a fold's model stops when the loss on the fold's own rows does: they choose its length, they aren't fitted."""
    train = df.where(~F.col(holdout))
    if early:
        models = [fit(train.withColumn("_late", F.col(fold) == k), columns, validation="_late") for k in range(folds)]
    else:
        models = [fit(train.where(F.col(fold) != k), columns) for k in range(folds)]
    out = df
    for k, m in enumerate(models):
        out = predict(m, out, f"_f{k}")
    own = reduce(lambda acc, k: acc.when(F.col(fold) == k, F.col(f"_f{k}")), range(folds), F.when(F.lit(False), 0.0))
    mean = reduce(lambda a, b: a + b, [F.col(f"_f{k}") for k in range(folds)]) / folds
    return out.withColumn(name, F.when(F.col(holdout), mean).otherwise(own)).drop(*[f"_f{k}" for k in range(folds)]), models


def hard_negatives(df: DataFrame, p: str, easy_share: float = 0.2, hard_from: float = 0.05) -> DataFrame:
    """All positives and hard negatives; a hash-chosen share of the easy ones, with weight 1 / share."""
    from recordloom.functions.ids import hash_part

    hard = (F.col("y") == 1) | (F.col(p) >= hard_from)
    kept = df.where(hard | (hash_part(F.concat_ws("|", "rec", "s1"), "easy", 1000) < int(easy_share * 1000)))
    return kept.withColumn("weight", F.when(hard, 1.0).otherwise(1 / easy_share))


def calibrate(df: DataFrame, p: str, label: str = "y"):
    """Isotonic regression of the label on the score. Equal scores are one row of their mean label, weighted by their number: the fit
    is the same, and no task gets all rows of a score."""
    rows = df.select(F.col(label).cast("double").alias("_y"), F.col(p).cast("double").alias("_x"))
    by_score = rows.groupBy("_x").agg(F.avg("_y").alias("_y"), F.count("*").cast("double").alias("_w"))
    return IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w").fit(by_score)


def calibrated(model, df: DataFrame, p: str, name: str) -> DataFrame:
    out = model.transform(df.withColumn("_x", F.col(p).cast("double")))
    return out.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction"))).drop("_x", "prediction")


def fit_subspace_forests(df: DataFrame, columns: list[str], label: str = "y", members: int = 3, share: float = 0.6, trees: int = 20, seed: int = 1) -> list[PipelineModel]:
    """Random forests over random subsets of the columns."""
    import random

    out = []
    for i in range(members):
        own = sorted(random.Random(seed + i).sample(columns, max(1, round(share * len(columns)))))
        out.append(Pipeline(stages=[VectorAssembler(inputCols=own, outputCol="_x", handleInvalid="keep"), RandomForestClassifier(labelCol=label, featuresCol="_x", numTrees=trees, seed=seed + i)]).fit(df))
    return out


def kernel_features(df: DataFrame, columns: list[str], n: int = 32, gamma: float = 0.1, seed: int = 1) -> tuple[DataFrame, list[str]]:
    """Random Fourier features of the RBF kernel, as native expressions: sqrt(2/n) * cos(w.x + b)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, (2 * gamma) ** 0.5, (n, len(columns))), rng.uniform(0, 2 * np.pi, n)
    names = [f"_k{i}" for i in range(n)]
    scale = (2 / n) ** 0.5
    exprs = {name: F.lit(scale) * F.cos(reduce(lambda acc, cw: acc + F.col(cw[0]) * float(cw[1]), zip(columns, w[i], strict=True), F.lit(float(b[i])))) for i, name in enumerate(names)}
    return df.withColumns(exprs), names


def fit_logistic(df: DataFrame, columns: list[str], label: str = "y", reg: float = 1e-4) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep"), LogisticRegression(labelCol=label, featuresCol="_x", regParam=reg)]).fit(df)


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(q / (1 - q))


def stack(df: DataFrame, scores: list[str], name: str, fold: str = "fold", holdout: str = "ho") -> tuple[DataFrame, list[PipelineModel]]:
    """Logistic regression over the log-odds of several scores, out of fold."""
    rows = df.withColumns({f"_l_{s}": logit(F.col(s)) for s in scores})
    out, models = out_of_fold(rows, [f"_l_{s}" for s in scores], name, fold, holdout=holdout, fit=fit_logistic)
    return out.drop(*[f"_l_{s}" for s in scores]), models


def second_level(df: DataFrame, p: str, x: str, name: str, fold: str = "fold", folds: int = 3, holdout: str = "ho", rounds: int = 40) -> tuple[DataFrame, list[PipelineModel]]:
    """Boosted trees over two scores' log-odds, ranks and gaps, out of fold; boosting stops when the held-out fold's loss does."""
    from functools import partial

    from recordloom.operators.classic import stack_features

    rows = stack_features(df, p, x)
    made = [c for c in rows.columns if c not in df.columns]
    out, models = out_of_fold(rows, [p, x, *made], name, fold, folds, holdout, partial(fit_trees, rounds=rounds), early=True)
    return out.drop(*made), models


def importances(model: PipelineModel) -> dict[str, float]:
    columns = model.stages[0].getInputCols()
    return dict(sorted(zip(columns, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda kv: -kv[1]))


def permuted(df: DataFrame, column: str, salt: str = "permute") -> DataFrame:
    """column with its values dealt to other rows: rows paired by running number in two hash orders."""
    from recordloom.functions.ids import hash_part
    from recordloom.operators.runs import running_sums

    key = F.concat_ws("|", "rec", "s1")
    numbered = lambda d, s: running_sums(d.withColumns({"_h": hash_part(key, s, 1 << 31) * 1_000_003 + F.pmod(F.xxhash64(key), F.lit(1_000_003)), "_one": F.lit(1)}), "_h", {"_one": "_nth"}).drop("_h", "_one")
    left = numbered(df, salt + "a")
    right = numbered(df.select("rec", "s1", column), salt + "b").select("_nth", F.col(column).alias("_new"))
    return left.drop(column).join(right, "_nth").withColumnRenamed("_new", column).drop("_nth")


def candidate_budget(df: DataFrame, p: str, per_entity: float, entities: int) -> float:
    """The least score that keeps no more than so many candidates an entity, over all entities."""
    keep = int(per_entity * entities)
    at = df.groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"))
    from recordloom.operators.runs import running_sums

    found = running_sums(at, "p", {"n": "kept"}, descending=True).where(F.col("kept") <= keep).agg(F.min("p")).first()[0]
    return float(found if found is not None else 1.0)


def permutation_report(df: DataFrame, columns: list[str], score, salt: str = "permute") -> DataFrame:
    """(column, loss): how much score(df), a number, falls when a column's values are dealt to other rows."""
    base = score(df)
    return df.sparkSession.createDataFrame([(c, float(base - score(permuted(df, c, salt)))) for c in columns], "column string, loss double")


def recall_threshold(df: DataFrame, p: str, recall: float = 0.995) -> float:
    """The largest score that keeps at least this share of positives."""
    value = df.where("y = 1").agg(F.percentile(p, F.lit(1 - recall))).first()[0]
    return float(value or 0.0)


def leave_one_out(df: DataFrame, columns: list[str], by: str, values: list[str], name: str = "p") -> DataFrame:
    """Each value's rows scored by a model of all other values."""
    parts = [predict(fit_trees(df.where(F.col(by) != v), columns), df.where(F.col(by) == v), name) for v in values]
    return reduce(DataFrame.unionByName, parts)
