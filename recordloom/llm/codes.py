"""Vectors as short codes: one codebook per part of the components, in exact integers.

A component x becomes floor(4096 x); a vector is cut into 8 equal consecutive parts. Codebooks start as the parts of the
16 smallest ids and go through 6 rounds of assigning and averaging. The nearest entry is found by segment-mean lower bounds:
with a part cut into blocks, sum of |block| (mean_x - mean_c)^2 + (|residual_x| - |residual_c|)^2 is at most the squared
distance. Blocks of the whole part, then halves, then quarters filter the entries that can't be nearest; bounds are lowered by
more than they can be rounded by, and what survives gets its exact integer distance. So results don't depend on the filter.

Each round is one pass over the vectors' table that returns sums and counts per part and entry; the driver holds the codebooks
(16 entries of a vector's length in all) and nothing that grows with the rows.

Defined results: rows whose vector is null, empty, no multiple of 8 long, of another length than the first one's (by id), or with
a null or non-finite component are dropped; null ids come after all others; equal ids go by vector, and repeated rows
are assigned alike; fewer than 16 vectors make as many entries; an empty table has no codes; other columns are ignored.
A component so large that distances could leave 63 bits (32,768 at 64 components, 2,048 at 1,024) is an error, not a wrong code.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.core import materialize, worker

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that can be coded, components as integers."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.coalesce(F.forall(e, lambda x: F.abs(x) < float("inf")), F.lit(False))  # NaN is above infinity
    fits = (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)
    return vectors.where(fits & finite).select("vec_id", "label", F.transform(e, lambda x: F.floor(x * SCALE)).alias("v"))


def levels(length: int) -> list[np.ndarray]:
    """Starts of the blocks, coarse to fine: the whole, halves, quarters, as long as a block has two components."""
    out, n = [], 1
    while n == 1 or n <= min(4, length // 2):
        out.append(np.arange(n) * length // n)
        n *= 2
    return out


def _blocks(v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per block: components, mean, length of what the mean leaves (from exact integers)."""
    size = np.diff(np.append(starts, v.shape[1]))
    sums, squares = np.add.reduceat(v, starts, axis=1), np.add.reduceat(v * v, starts, axis=1)
    return size, sums / size, np.sqrt((size * squares - sums * sums) / size)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row of x: the nearest entry of the book (ties to the lower index) and its squared distance, exactly."""
    fine = levels(x.shape[1])
    exact = lambda rows, entries: ((x[rows] - book[entries]) ** 2).sum(axis=1)
    least = lambda bound: bound * (1 - 1e-9) - 1
    size, xm, xr = _blocks(x, fine[0])
    _, cm, cr = _blocks(book, fine[0])
    bound = size[0] * (xm - cm[:, 0]) ** 2 + (xr - cr[:, 0]) ** 2
    best = exact(np.arange(len(x)), bound.argmin(axis=1))
    rows, entries = np.nonzero(least(bound) <= best[:, None])
    for starts in fine[1:]:
        size, xm, xr = _blocks(x, starts)
        _, cm, cr = _blocks(book, starts)
        bound = (size * (xm[rows] - cm[entries]) ** 2 + (xr[rows] - cr[entries]) ** 2).sum(axis=1)
        near = least(bound) <= best[rows]
        rows, entries = rows[near], entries[near]
    d = exact(rows, entries)
    own, first = np.unique(rows, return_index=True)  # rows come in order, entries ascending inside a row
    lowest = np.minimum.reduceat(d, first) if len(own) else d
    hit = np.flatnonzero(d == np.repeat(lowest, np.diff(np.append(first, len(d)))))
    _, at = np.unique(rows[hit], return_index=True)
    return entries[hit[at]], lowest


def _matrix(batch, dim: int) -> np.ndarray:
    v = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    if len(v) and int(np.abs(v).max()) * (dim // PARTS) >= 1 << 30:
        raise ArithmeticError("vector components are too large for exact distances in 64 bits")
    return v


def _parts(v: np.ndarray) -> list[np.ndarray]:
    return np.split(v, PARTS, axis=1)


def _sums(batches, books: np.ndarray):
    """One row per (part, entry) of a task: how many parts came to it, and their sums."""
    sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
    for batch in batches:
        for p, x in enumerate(_parts(_matrix(batch, PARTS * books.shape[2]))):
            own, _ = nearest(x, books[p])
            np.add.at(sums[p], own, x)
            counts[p] += np.bincount(own, minlength=len(counts[p]))
    p, e = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])


def _codes(batches, books: np.ndarray):
    for batch in batches:
        v = _matrix(batch, PARTS * books.shape[2])
        own, far = zip(*[nearest(x, books[p]) for p, x in enumerate(_parts(v))], strict=True)
        code = np.stack(own, axis=1).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([row.tobytes().hex() for row in code], pa.string()), pa.array(np.sum(far, axis=0), pa.int64())], names=["vec_id", "label", "code", "error"])


@dataclass
class Codebooks:
    """(part, entry, position) integers, and the table of the vectors that they were fitted on."""

    books: np.ndarray
    vectors: DataFrame

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def train(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> Codebooks:
    """Codebooks of all rows of vectors (vec_id, embedding, label)."""
    rows = materialize(integers(vectors), "vectors")
    order = [F.asc_nulls_last("vec_id"), "v"]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return Codebooks(np.zeros((PARTS, 0, 0), np.int64), rows)
    dim = len(first[0]["v"])
    rows = rows.where(F.size("v") == dim)
    seeds = np.array([r["v"] for r in rows.orderBy(*order).limit(entries).collect()], np.int64)
    books = seeds.reshape(len(seeds), PARTS, dim // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = rows.mapInArrow(worker(lambda b, c=books: _sums(b, c)), "part int, entry int, n long, sums array<long>")
        cells = sums.select("part", "entry", "n", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
        for r in cells.collect():  # a number per component of an entry
            books[r["part"], r["entry"], r["pos"]] = r["s"] // r["n"]
    return Codebooks(books, rows)


def encode(model: Codebooks) -> DataFrame:
    """(vec_id, label, code, error, label_error) of the model's rows. Labels meet their sums by a join that Spark sizes itself."""
    schema = "vec_id long, label int, code string, error long"
    if not model.books.size:
        return model.vectors.sparkSession.createDataFrame([], schema + ", label_error long")
    books = model.books
    coded = materialize(model.vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "v").mapInArrow(worker(lambda b: _codes(b, books)), schema), "codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
