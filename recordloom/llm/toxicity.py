"""Toxicity by a classifier chain.

Categories are predicted in a fixed order. Each has a linear (logistic) model over the presence of words and word
beginnings that tell its classes apart; from the second on a model also takes the log-odds of the earlier categories.
While training, those are out-of-fold predictions, so later models learn from probabilities as uncertain as in use.
Training takes at most ``PER_CLASS`` labelled documents of each combination of labels, picked by hash.

Folds go by the text's hash, so an out-of-fold score never comes from a model that has seen a copy of its document.

Defined results: null or empty text has no features and gets the models' bias alone; a category with one class in its
labels gets that class's rate; rows with a null label aren't trained on; without labelled documents all probabilities are
0; repeated rows are scored alike; a repeated label row counts once, and a document with several labels has the largest;
an empty table of documents gives no rows; of a very long text the set of distinct words is held; columns named like an
added one are replaced, all others kept.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from recordloom.llm.core import bounded_ids, one_text

FOLDS = 3
#: Bound of the training sample: documents of a combination of labels; and that on combinations.
PER_CLASS = 1000
MAX_CLASSES = 16
#: A category's model takes the features whose share differs between its classes by so many standard errors, at most so many.
Z, MAX_FEATURES = 4.5, 20_000
#: and by at least this ratio (as a logarithm): words that merely go with a language or a length don't pass.
ODDS = 1.4
MEMORY = 300_000
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]{2,}")


def parts(word: str) -> list[str]:
    """Features of a lower-case word: itself, and its first 4, 5 and 6 letters when longer."""
    return [word, *[word[:k] + "*" for k in (4, 5, 6) if len(word) > k]]


def tokens(text: str | None) -> set[str]:
    return set(TOKEN.findall((text or "").lower()))


class Rows:
    """Sparse 0/1 rows over the features that occur in at least three documents."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        row, col = [], []
        for i, t in enumerate(texts):
            own = {known.setdefault(f, len(known)) for w in tokens(t) for f in parts(w)}
            row.append(np.full(len(own), i, np.int32))
            col.append(np.fromiter(own, np.int32, len(own)))
        row, col = np.concatenate(row), np.concatenate(col)
        seen = np.bincount(col, minlength=len(known)) >= 3
        keep, to = seen[col], np.cumsum(seen) - 1
        self.names = [f for f, s in zip(known, seen, strict=True) if s]
        self.row, self.col, self.n = row[keep], to[col[keep]], len(texts)

    def select(self, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Features that tell the classes apart on the rows of a mask."""
        d, pick = len(self.names), rows[self.row]
        both = np.bincount(self.col[pick], minlength=d)
        ones = np.bincount(self.col[pick], y[self.row[pick]], d)
        n1, n = max(1.0, (y * rows).sum()), rows.sum()
        n0, p = max(1.0, n - n1), both / max(1, n)
        z = np.abs(ones / n1 - (both - ones) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        half = 0.5  # of a document, so that shares of 0 compare
        odds = np.abs(np.log((ones + half) / (n1 + 1)) - np.log((both - ones + half) / (n0 + 1)))
        best = np.argsort(-z, kind="stable")[:MAX_FEATURES]
        return np.sort(best[(z[best] >= Z) & (odds[best] >= ODDS)])

    def fit(self, y: np.ndarray, extra: np.ndarray, rows: np.ndarray, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
        """Logistic regression with balanced classes on the rows of a mask, by accelerated gradient steps."""
        chosen = self.select(y, rows)
        to = np.full(len(self.names), -1)
        to[chosen] = np.arange(len(chosen))
        pick = rows[self.row] & (to[self.col] >= 0)
        r, c, d = self.row[pick], to[self.col[pick]], len(chosen)
        share = np.where(y > 0, 0.5 / max(1, (y * rows).sum()), 0.5 / max(1, ((1 - y) * rows).sum())) * rows
        w = past = np.zeros(d + extra.shape[1] + 1)
        size = np.bincount(r, minlength=self.n) + (extra**2).sum(axis=1) + 1
        rate = 4 / np.average(size, weights=share)  # most rows; the step halves where it overshoots
        last = np.inf
        for k in range(steps):
            z = w + k / (k + 3) * (w - past)
            past = w
            m = np.bincount(r, z[c], self.n) + extra @ z[d:-1] + z[-1]
            loss = (np.logaddexp(0, np.where(y > 0, -m, m)) * share).sum() + l2 / 2 * (z[:-1] ** 2).sum()
            if loss > last * 1.01:
                rate, past = rate / 2, w
            last = min(last, loss)
            e = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y) * share
            g = np.concatenate([np.bincount(c, e[r], d), extra.T @ e, [e.sum()]])
            g[:-1] += l2 * z[:-1]
            w = z - rate * g
        full = np.zeros(len(self.names))
        full[chosen] = w[:d]
        return full, w[d:-1], float(w[-1])

    def margins(self, w: np.ndarray, chain: np.ndarray, bias: float, extra: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + extra @ chain + bias


def fit_chain(texts: list[str], labels: np.ndarray, folds: np.ndarray) -> dict:
    """labels: (n, categories) of 0/1. Per category: weights by feature, those of the earlier categories, bias, decision cut."""
    x = Rows(texts)
    extra = np.zeros((len(texts), 0))
    weights, chains, biases, cuts = {}, [], [], []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        w, chain, bias = x.fit(y, extra, np.ones(len(texts), bool))
        out = np.zeros(len(texts))
        for f in range(FOLDS):
            inside = folds != f
            if inside.any() and not inside.all():
                out = np.where(inside, out, x.margins(*x.fit(y, extra, inside), extra))
        for i in np.flatnonzero(w):
            weights.setdefault(x.names[i], np.zeros(labels.shape[1]))[k] = w[i]
        chains.append(chain)
        biases.append(bias)
        cuts.append(best_cut(out, y))
        extra = np.column_stack([extra, np.clip(out, -6, 6)])
    return {"weights": weights, "chains": chains, "biases": biases, "cuts": cuts}


def best_cut(margins: np.ndarray, y: np.ndarray) -> float:
    """The probability from which out-of-fold decisions have the best F1, half way to the next score below; 0.5 without
    both classes."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-margins, kind="stable")
    m, hit = margins[order], np.cumsum(y[order])
    last = np.append(m[1:] < m[:-1], True)  # cuts lie between different scores
    f1 = np.where(last, 2 * hit / (np.arange(1, len(y) + 1) + y.sum()), -1)
    k = int(np.argmax(f1))
    low = m[k + 1] if k + 1 < len(m) else m[k] - 1
    return float(1 / (1 + np.exp(-np.clip((m[k] + low) / 2, -30, 30))))


class Scorer(dict):
    """word -> its features that have weights, remembered."""

    def __init__(self, model: dict):
        super().__init__()
        self.model, self.known = model, model["weights"].keys()

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found = tuple(p for p in parts(word) if p in self.known)
        return found

    def score(self, text: str | None) -> list[float]:
        own = set().union(*map(self.__getitem__, tokens(text)))
        base = sum((self.model["weights"][f] for f in sorted(own)), np.zeros(len(self.model["biases"])))
        margins: list[float] = []
        for k, (chain, bias) in enumerate(zip(self.model["chains"], self.model["biases"], strict=True)):
            margins.append(float(base[k] + bias + np.dot(chain, np.clip(margins, -6, 6))))
        return [float(1 / (1 + np.exp(-np.clip(m, -30, 30)))) for m in margins]


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], per_class: int = PER_CLASS) -> dict | None:
    """categories: name -> SQL expression over labels, in chain order. None if there is nothing to learn from."""
    names = list(categories)
    own = labels.select("doc_id", *[F.expr(e).cast("int").alias(k) for k, e in categories.items()]).dropna()
    own = own.groupBy("doc_id").agg(*[F.max(k).alias(k) for k in names])
    own = own.withColumn("_class", F.concat_ws("", *names))
    sample = bounded_ids(own, per_class, "_class", MAX_CLASSES)
    picked = F.broadcast(sample.join(own, ["doc_id", "_class"]))  # at most per_class * MAX_CLASSES ids, each with one row below
    rows = one_text(docs.select("doc_id", "text").join(picked, "doc_id"), "doc_id", *names)

    def reduced(batches):
        """What the models look at: each text's set of words, and its fold."""
        for batch in batches:
            texts = [t.as_py() or "" for t in batch["text"]]
            own = pa.array([" ".join(sorted(tokens(t))) for t in texts], pa.string())
            fold = pa.array([zlib.crc32(t.encode("utf-8", "replace")) % FOLDS for t in texts], pa.int32())  # copies share a fold
            yield pa.RecordBatch.from_arrays([own, fold, *[batch[k] for k in names]], names=["_words", "_fold", *names])

    def fitted(batches):
        rows = sorted(x for batch in batches for x in zip(*(batch[k].to_pylist() for k in ("_words", "_fold", *names)), strict=True))
        if rows:
            model = fit_chain([x[0] for x in rows], np.array([x[2:] for x in rows]), np.array([x[1] for x in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # only the sample moves to the one task that fits it: the scan stays spread
    kinds = ", ".join(f"`{k}` int" for k in names)
    found = rows.select("text", *names).mapInArrow(reduced, f"_words string, _fold int, {kinds}").repartition(1).mapInArrow(fitted, "model binary").first()
    return found and pickle.loads(found["model"])


def score(docs: DataFrame, model: dict | None, categories: list[str]) -> DataFrame:
    """docs with p_<category> columns; every other column is kept."""
    names = [f"p_{k}" for k in categories]
    kept = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights per category

    def scored(batches):
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            found = [scorer.score(t.as_py()) if scorer is not None else [0.0] * len(names) for t in batch["text"]]
            columns = [pa.array([x[k] for x in found], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return kept.mapInArrow(scored, StructType([*kept.schema.fields, *[StructField(n, DoubleType()) for n in names]]))
