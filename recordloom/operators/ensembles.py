"""Members that err unlike boosting: extremely randomised trees and a landmark kernel model, for the stack.

Trees grow level by level, all at once: rows stay where they are, each task walks them down the trees so far and returns its
part of the open nodes' statistics, and only those sums are shuffled. The driver holds the trees, at most trees x 2^depth nodes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

MISSING = -1.0  # fixed: what a tree sees for a missing value


def uniform(*key) -> float:
    """A number in [0, 1) that depends on the key only."""
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) / 16**13


def draw_columns(columns: list[str], importance: dict[str, float] | None, seed: int, member: int) -> list[str]:
    """A member's columns: a random number of them, between a sixth and half (4 and 5 at least), drawn by importance with a floor
    of a tenth shared by all. Weighted keys u^(1/w): the largest win."""
    n = len(columns)
    total = sum((importance or {}).get(c, 0.0) for c in columns)
    share = {c: 0.9 * (importance or {}).get(c, 0.0) / total + 0.1 / n if total > 0 else 1 / n for c in columns}
    low, high = max(4, n // 6), max(5, n // 2)
    size = min(n, low + int(uniform(seed, member, "size") * (high - low + 1)))
    keys = {c: max(uniform(seed, member, "column", c), 1e-12) ** (1 / share[c]) for c in columns}
    return sorted(sorted(columns, key=lambda c: (-keys[c], c))[:size], key=columns.index)


def candidates(columns: list[str], seed: int, tree: int, node: int) -> list[str]:
    """The columns that a node tries: the square root of the member's number, by keyed order."""
    return sorted(columns, key=lambda c: (uniform(seed, tree, node, c), c))[: max(1, round(len(columns) ** 0.5))]


@dataclass
class Trees:
    """Nodes by (tree, node), children of a node being 2n + 1 and 2n + 2: column (null in a leaf), threshold (left if not above), value."""

    columns: list[str]
    nodes: dict[tuple[int, int], tuple[str | None, float, float]] = field(default_factory=dict)
    trees: int = 0

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, n, *v) for (t, n), v in sorted(self.nodes.items())], "tree int, node int, column string, threshold double, value double")

    def walk(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node of the tree that each row comes to."""
        at = np.zeros(len(x), np.int64)
        place = {c: i for i, c in enumerate(self.columns)}
        open_ = [0] if (tree, 0) in self.nodes else []
        while open_:
            below = []
            for n in open_:
                column, cut, _ = self.nodes[tree, n]
                if column is not None:
                    own = np.flatnonzero(at == n)
                    at[own] = 2 * n + 1 + (x[own, place[column]] > cut)
                    below += [c for c in (2 * n + 1, 2 * n + 2) if (tree, c) in self.nodes]
            open_ = below
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean of the leaves' shares of positives."""
        total = np.zeros(len(x))
        for t in range(self.trees):
            at = self.walk(x, t)
            known, place = np.unique(at, return_inverse=True)
            total += np.array([self.nodes[t, int(n)][2] for n in known])[place]
        return total / max(1, self.trees)


def _matrix(part: pd.DataFrame, columns: list[str]) -> np.ndarray:
    x = part[columns].to_numpy(np.float64, na_value=np.nan)
    return np.clip(np.nan_to_num(x, nan=MISSING, posinf=1e6, neginf=-1e6), -1e6, 1e6)


def fit_extra_trees(df: DataFrame, columns: list[str], label: str = "y", members: int = 8, trees: int = 5, depth: int = 10, least: int = 40, importance: dict[str, float] | None = None, seed: int = 1) -> Trees:
    """members x trees extremely randomised trees; a member's trees share its columns. At each node, every tried column gets one
    random threshold between the node's least and largest value, and the best of these (Gini, then first tried) splits it, if both
    sides keep `least` rows."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("_y"))
    model = Trees(columns, trees=members * trees)
    own = {t: draw_columns(columns, importance, seed, t // trees) for t in range(model.trees)}
    open_ = {(t, 0) for t in range(model.trees)}

    def pieces(kind: str, tried: dict, cuts: dict):
        """A function for mapInPandas: this task's part of the open nodes' statistics."""

        def run(parts):
            best: dict = {}
            for part in parts:
                x, y = _matrix(part, columns), part["_y"].to_numpy()
                for t in sorted({t for t, _ in tried}):
                    at = model.walk(x, t)
                    for n in [n for u, n in tried if u == t]:
                        inside = np.flatnonzero(at == n)
                        if not len(inside):
                            continue
                        for c in tried[t, n]:
                            v = x[inside, columns.index(c)]
                            key = (t, n, c)
                            if kind == "range":
                                a, z = best.get(key, (np.inf, -np.inf))
                                best[key] = min(a, v.min()), max(z, v.max())
                            else:
                                left = v <= cuts[key]
                                b = best.get(key, (0.0, 0.0, 0.0, 0.0))
                                best[key] = b[0] + len(v), b[1] + y[inside].sum(), b[2] + left.sum(), b[3] + y[inside][left].sum()
            names = ["a", "z"] if kind == "range" else ["n", "pos", "n_left", "pos_left"]
            yield pd.DataFrame([(*k, *map(float, v)) for k, v in best.items()], columns=["tree", "node", "column", *names])

        return run

    for level in range(depth + 1):
        tried = {(t, n): candidates(own[t], seed, t, n) for t, n in open_}
        if not tried:
            break
        key = "tree int, node int, column string"
        spans = rows.mapInPandas(pieces("range", tried, {}), key + ", a double, z double").groupBy("tree", "node", "column").agg(F.min("a").alias("a"), F.max("z").alias("z")).collect()
        cuts = {(r["tree"], r["node"], r["column"]): r["a"] + uniform(seed, r["tree"], r["node"], r["column"], "cut") * (r["z"] - r["a"]) for r in spans}
        sums = rows.mapInPandas(pieces("counts", tried, cuts), key + ", n double, pos double, n_left double, pos_left double")
        sums = sums.groupBy("tree", "node", "column").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "n_left", "pos_left")]).collect()
        found: dict = {}
        for r in sums:  # a row per open node and tried column
            found.setdefault((r["tree"], r["node"]), {})[r["column"]] = (r["n"], r["pos"], r["n_left"], r["pos_left"])
        below = set()
        for at in sorted(open_):
            options = found.get(at, {})
            n, pos = next(iter(options.values()))[:2] if options else (0.0, 0.0)
            value, split = (pos / n if n else 0.0), None
            if level < depth and 0 < pos < n:
                split = best_split(options, tried[at], least)
            model.nodes[at] = (split, float(cuts[(*at, split)]) if split else 0.0, value)
            if split:
                below |= {(at[0], 2 * at[1] + 1), (at[0], 2 * at[1] + 2)}
        open_ = below
    return model


def best_split(options: dict[str, tuple], tried: list[str], least: int) -> str | None:
    """The column whose random cut leaves the least Gini impurity, both sides having `least` rows; the first tried on ties."""
    best, name = np.inf, None
    for c in tried:
        n, pos, n_left, pos_left = options[c]
        n_right, pos_right = n - n_left, pos - pos_left
        if min(n_left, n_right) < max(1, least):
            continue
        impurity = round(2 * (pos_left * (n_left - pos_left) / n_left + pos_right * (n_right - pos_right) / n_right) / n, 12)
        if impurity < best:
            best, name = impurity, c
    return name


def score_extra_trees(df: DataFrame, model: Trees, name: str = "p_trees") -> DataFrame:
    """df with the trees' mean share of positives."""
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    return df.mapInPandas(lambda parts: (part.assign(**{name: model.score(_matrix(part, model.columns))}) for part in parts), schema)


# ---- landmark kernel features ------------------------------------------------------------------------------------------
CLIP = 6.0  # fixed: standardised values beyond are cut
RARELY = 0.001  # fixed: a column that is missing more often gets an indicator


@dataclass
class Landmarks:
    """columns and indicators, their means and deviations, landmarks (n, d) in standardised units, inverse square root of their kernel."""

    columns: list[str]
    indicators: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    points: np.ndarray
    root: np.ndarray

    def standardised(self, part: pd.DataFrame) -> np.ndarray:
        x = part[self.columns].to_numpy(np.float64, na_value=np.nan)
        missing = part[self.indicators].isna().to_numpy(np.float64)
        z = np.hstack([np.nan_to_num(x), missing])
        return np.clip((z - self.mean) / self.deviation, -CLIP, CLIP)

    def features(self, part: pd.DataFrame) -> np.ndarray:
        return kernel(self.standardised(part), self.points) @ self.root


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """RBF with gamma 1 / dimensions."""
    far = (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T
    return np.exp(-np.maximum(far, 0) / a.shape[1])


def fit_landmarks(df: DataFrame, columns: list[str], n: int = 64, key: tuple[str, ...] = ("rec", "s1"), salt: str = "landmarks") -> Landmarks:
    """n rows of least hash are the landmarks. Missing values count as 0 and, in columns that lack more than one in a thousand,
    also have an indicator; all are standardised over all rows and cut at 6 deviations."""
    from recordloom.functions.ids import hash_part

    known = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    gone = [F.col(c).isNull().cast("double") for c in columns]
    stats = df.agg(*[f(x) for x in (*known, *gone) for f in (F.avg, F.stddev_pop)]).first()
    number = lambda i: float(stats[i] or 0.0)
    indicators = [c for i, c in enumerate(columns) if number(2 * (len(columns) + i)) > RARELY]
    kept = [*range(len(columns)), *[len(columns) + columns.index(c) for c in indicators]]
    mean, deviation = np.array([number(2 * i) for i in kept]), np.array([number(2 * i + 1) or 1.0 for i in kept])
    names = F.concat_ws("|", *key)
    picked = df.select(*columns, hash_part(names, salt, 1 << 31).alias("_h"), names.alias("_k")).orderBy("_h", "_k").limit(n).toPandas()
    out = Landmarks(columns, indicators, mean, deviation, np.zeros((0, len(kept))), np.zeros((0, 0)))
    out.points = out.standardised(picked)
    values, vectors = np.linalg.eigh(kernel(out.points, out.points))
    out.root = (vectors / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T
    return out


def landmark_features(df: DataFrame, model: Landmarks, name: str = "kernel") -> DataFrame:
    """df with an array of kernel features: products of two rows' arrays approximate their kernel."""
    schema = StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])
    return df.mapInPandas(lambda parts: (part.assign(**{name: list(model.features(part))}) for part in parts), schema)


def fit_landmark_model(df: DataFrame, model: Landmarks, label: str = "y", reg: float = 1e-5):
    """Logistic regression over the kernel features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = landmark_features(df, model, "_k").select(F.col(label).cast("double").alias("_label"), array_to_vector("_k").alias("_x"))
    return LogisticRegression(labelCol="_label", featuresCol="_x", regParam=reg).fit(rows)


def score_landmark_model(df: DataFrame, model: Landmarks, fitted, name: str = "p_kernel") -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = fitted.transform(landmark_features(df, model, "_k").withColumn("_x", array_to_vector("_k")))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("_k", "_x", "rawPrediction", "probability", "prediction")


def ensemble(df: DataFrame, columns: list[str], p: str, name: str = "p_stack", fold: str = "fold", folds: int = 3, holdout: str = "ho", landmarks: int = 64, **trees) -> tuple[DataFrame, list]:
    """The given scores, extra trees' and the kernel model's, each out of fold, stacked by logistic regression."""
    from recordloom.operators.models import stack
    from recordloom.sources.scratch import table

    train, out, fitted = df.where(~F.col(holdout)), df, []
    for k in range(folds):
        inside = train.where(F.col(fold) != k)
        forest, points = fit_extra_trees(inside, columns, **trees), fit_landmarks(inside, columns, landmarks)
        member = (forest, points, fit_landmark_model(inside, points))
        fitted.append(member)
        out = score_landmark_model(score_extra_trees(out, forest, f"_t{k}"), points, member[2], f"_l{k}")
    pick = lambda c: F.when(F.col(holdout), sum((F.col(f"{c}{k}") for k in range(folds)), F.lit(0.0)) / folds).otherwise(F.coalesce(*[F.when(F.col(fold) == k, F.col(f"{c}{k}")) for k in range(folds)]))
    out = out.withColumns({"p_trees": pick("_t"), "p_kernel": pick("_l")}).drop(*[f"{c}{k}" for c in ("_t", "_l") for k in range(folds)])
    stacked, models = stack(table(out, "members"), [p, "p_trees", "p_kernel"], name, fold, holdout=holdout)
    return stacked, [fitted, models]
