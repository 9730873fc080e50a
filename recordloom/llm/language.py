"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside it.

Features are hashed byte trigrams of the lower-cased text, as shares of all its trigrams, so a document's margin is the
mean of the weights of its trigrams and whole texts of any length are scored in one pass. Every binary model is a linear
SVM with squared hinge loss, fitted by Newton steps on the active rows. Training takes at most ``PER_LANGUAGE``
documents of a language, picked by hash, and a family's model at most ``PER_FAMILY`` of them.

Defined results: null text, or text without a letter, is `und` with score 0; with no training rows everything is `und`;
one learned language is always predicted with score 1; null languages are never learned; with more than ``MAX_LANGUAGES``
the most frequent (ties: the least name) are learned; repeated rows are predicted alike; an empty table gives no rows and
nothing to learn; a very long text is scored whole, its weights summed in blocks; other columns are kept by ``predict``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.core import bounded_ids, crc_mod, one_text, worker

DIMS = 1 << 13
#: The bound of the training sample, and that on the number of languages with a model.
PER_LANGUAGE = 600
MAX_LANGUAGES = 64
#: Rows that one model of two families is fitted on at most, so that its kernel matrix stays small.
PER_FAMILY = 2400
UND = "und"
#: Fixed table: language -> family. A language that isn't listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
    "ru": "slavic", "uk": "slavic", "bg": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic",
    "hi": "indic", "mr": "indic", "ne": "indic", "bn": "indic",
}


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """Hashed places of the trigrams of the text between two spaces."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - 13)).astype(np.int64)


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 12) -> np.ndarray:
    """Primal L2-SVM in the span of the rows: w = x.T @ a; y is +-1. Newton on the rows inside the margin."""
    k = x @ x.T + 1.0  # the bias is a constant feature
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    active = np.ones(len(y), bool)
    for _ in range(steps):
        a = np.zeros(len(y))
        a[active] = np.linalg.solve(k[np.ix_(active, active)] + np.diag(1 / (2 * c * weight[active])), y[active])
        now = y * (k @ a) < 1
        if (now == active).all() or not now.any():
            break
        active = now
    return np.append(a @ x, a.sum())


def counted(text: str) -> tuple[bytes, bytes, int]:
    """Places of the text's trigrams, how often each comes, and how many there are."""
    at, n = np.unique(trigrams(text), return_counts=True)
    return at.astype("<u2").tobytes(), n.astype("<u4").tobytes(), int(n.sum())


def fit(rows: list[tuple[bytes, bytes, int]], langs: list[str]) -> dict:
    """rows as ``counted``. {"family": {...}, "models": {(a, b): weights, positive for a}} over families and over the languages
    of each family."""
    known = sorted(set(langs))
    family = {k: FAMILIES.get(k, f"={k}") for k in known}
    lang = np.array(langs)
    group = np.array([family[k] for k in langs]) if langs else lang

    def shares(picked: np.ndarray) -> np.ndarray:
        x = np.zeros((len(picked), DIMS), np.float32)
        for k, i in enumerate(picked.tolist()):
            at, n, total = rows[i]
            x[k, np.frombuffer(at, "<u2")] = np.sqrt(DIMS) * np.frombuffer(n, "<u4") / total
        return x

    def fewer(all_of: np.ndarray) -> np.ndarray:
        """At most half of PER_FAMILY, taken at equal steps: every language keeps its share."""
        return all_of[:: -(-2 * len(all_of) // PER_FAMILY)] if 2 * len(all_of) > PER_FAMILY else all_of

    models = {}
    for names, labels in ((sorted(set(family.values())), group), *[([k for k in known if family[k] == f], lang) for f in sorted(set(family.values()))]):
        for a, b in combinations(names, 2):
            both = np.concatenate([fewer(np.flatnonzero(labels == a)), fewer(np.flatnonzero(labels == b))])
            w = svm(shares(both), np.where(labels[both] == a, 1.0, -1.0))
            models[a, b] = np.append(w[:-1] * np.sqrt(DIMS), w[-1]).astype(np.float32)
    return {"family": family, "models": models}


def _vote(names: list[str], margins: dict) -> tuple[str, float]:
    """Winner by votes, then by summed margins; its confidence is the least of its duels."""
    if len(names) == 1:
        return names[0], 1.0
    duel = lambda a, b: margins[a, b] if (a, b) in margins else -margins[b, a]
    best = max(names, key=lambda a: (sum(duel(a, b) > 0 for b in names if b != a), sum(duel(a, b) for b in names if b != a), a))
    least = min(duel(best, b) for b in names if b != best)
    return best, float(1 / (1 + np.exp(-np.clip(4 * least, -30, 30))))


def classify(text: str | None, model: dict) -> tuple[str, float]:
    if text is None or not model["family"] or not has_letter(text):
        return UND, 0.0
    at = trigrams(text)
    pairs, table = model["pairs"], model["table"]
    # one pass over the text: the weights of all pairs, in blocks of bounded size
    total = np.zeros(len(pairs))
    for i in range(0, len(at), 1 << 18):
        total += table.take(at[i : i + (1 << 18)], axis=0).sum(axis=0, dtype=np.float64)
    margins = dict(zip(pairs, total / len(at) + model["bias"], strict=True))
    families = sorted(set(model["family"].values()))
    family, sure = _vote(families, margins)
    lang, own = _vote([k for k, f in model["family"].items() if f == family], margins)
    return lang, sure * own


def _packed(model: dict) -> dict:
    pairs = list(model["models"])
    w = np.stack([model["models"][p] for p in pairs], axis=1) if pairs else np.zeros((DIMS + 1, 0), np.float32)
    return {"family": model["family"], "pairs": pairs, "table": np.ascontiguousarray(w[:-1]), "bias": w[-1].astype(np.float64)}


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Fit on documents with a language, never on those whose crc32(doc_id) mod 3 is 1."""
    import pickle

    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
    sample = bounded_ids(rows, per_language, "lang", MAX_LANGUAGES)
    picked = one_text(rows.join(F.broadcast(sample), ["doc_id", "lang"]), "doc_id", "lang")  # at most per_language * MAX_LANGUAGES rows

    def featured(batches):
        for batch in batches:
            found = [(*counted(t), k) for t, k in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True) if has_letter(t)]
            kinds = {"at": pa.binary(), "n": pa.binary(), "total": pa.int64(), "lang": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    def fitted(batches):
        rows = sorted(x for batch in batches for x in zip(*(batch[k].to_pylist() for k in ("lang", "at", "n", "total")), strict=True))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_packed(fit([x[1:] for x in rows], [x[0] for x in rows])))], pa.binary())], names=["model"])

    # only the sample's trigram counts (at most 48 KB a document) move to the one task that fits them: the scan stays spread
    found = picked.select("text", "lang").mapInArrow(worker(featured), "at binary, n binary, total long, lang string").repartition(1).mapInArrow(worker(fitted), "model binary").first()
    return pickle.loads(found["model"]) if found else _packed(fit([], []))


def predict(docs: DataFrame, model: dict, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the prediction and its score added; every other column is kept (columns of these names are replaced)."""
    kept = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x at most MAX_LANGUAGES^2 / 2 weights

    def scored(batches):
        for batch in batches:
            found = [classify(t.as_py(), shared.value) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*batch.schema.names, *names])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*kept.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return kept.mapInArrow(worker(scored), schema)
