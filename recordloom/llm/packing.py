"""Sequence packing along a Hilbert curve.

Documents become hashed bag-of-token vectors, projected by a fixed random matrix to ``DIMS`` dimensions; each dimension
is cut at the normal quantiles of its own mean and deviation over all documents, and the cell's Hilbert index is the sort
key. Range-sorted by (key, doc_id), documents form one stream of ids that is cut every 1024 ids: sequences hold
neighbours on the curve and only the last sequence is padded.

Defined results: null or empty text is the end id alone; ties in the key go by doc_id, then crc32; repeated rows are
packed each; very long documents span many sequences; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.core import materialize, partitions, worker
from recordloom.llm.tokens import DTYPE, default_path, encoder

LENGTH = 1024
DIMS = 4
BITS = 8
#: Dimensions of the hashed vectors, whatever the vocabulary.
HASHED = 14


def buckets(ids: np.ndarray) -> np.ndarray:
    """The dimension of a token in the hashed vector."""
    return (ids.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - HASHED)).astype(np.int64)


def projection(seed: int = 7) -> np.ndarray:
    """The fixed matrix: dimension of the hashed vector -> DIMS weights of +-1."""
    return np.random.default_rng(seed).integers(0, 2, (1 << HASHED, DIMS)).astype(np.float64) * 2 - 1


def weights(seed: int = 7) -> np.ndarray:
    """The matrix seen from every 16-bit token: hashing and projecting in one lookup."""
    return projection(seed)[buckets(np.arange(1 << 16))]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, d): Gray-code the transposed bits (the published transpose method)."""
    x = cells.T.astype(np.uint64).copy()
    d, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        p = q - one
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        t = np.where((x[d - 1] & q) != 0, t ^ (q - one), t)
    x ^= t
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = index << one | (x[i] >> np.uint64(b) & one)
    return index


def _vectors(batches, path: str):
    tokenizer, matrix = encoder(path), weights()
    for batch in batches:
        out = {"ids": [], "n": [], "v": []}
        for ids in tokenizer.encode_all(batch["text"].to_pylist()):
            out["n"].append(len(ids) + 1)
            out["ids"].append(ids.tobytes() + b"\0\0")
            out["v"].append(matrix.take(ids, axis=0).sum(axis=0) / max(1, len(ids)) ** 0.5)
        v = np.array(out["v"]).reshape(-1, DIMS)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out["ids"], pa.binary()), pa.array(out["n"], pa.int64()), pa.array([zlib.crc32(x) for x in out["ids"]], pa.int64()), *[pa.array(v[:, i]) for i in range(DIMS)]], names=["doc_id", "ids", "n_tokens", "tie", *[f"v{i}" for i in range(DIMS)]])


def _keys(batches, means: list[float], deviations: list[float]):
    from statistics import NormalDist

    edges = np.array([NormalDist().inv_cdf(k / (1 << BITS)) for k in range(1, 1 << BITS)])
    for batch in batches:
        v = np.stack([np.asarray(batch[f"v{i}"]) for i in range(DIMS)], axis=1)
        cells = np.searchsorted(edges, (v - means) / deviations)
        yield pa.RecordBatch.from_arrays([batch["row_id"], batch["doc_id"], batch["n_tokens"], batch["tie"], pa.array(hilbert(cells).astype(np.int64))], names=["row_id", "doc_id", "n_tokens", "tie", "key"])


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids, curve_key."""
    spark, path = docs.sparkSession, tokenizer or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, ids binary, n_tokens long, tie long, " + ", ".join(f"v{i} double" for i in range(DIMS))
    encoded = rows.mapInArrow(worker(lambda b: _vectors(b, path), "tokens"), schema)
    encoded = materialize(encoded.withColumn("row_id", F.monotonically_increasing_id()), "packing-ids")
    spread = encoded.agg(*[f(f"v{i}") for i in range(DIMS) for f in (F.avg, F.stddev_pop)]).first()
    means, deviations = [spread[2 * i] or 0.0 for i in range(DIMS)], [spread[2 * i + 1] or 1.0 for i in range(DIMS)]
    keys = encoded.select("row_id", "doc_id", "n_tokens", "tie", *[f"v{i}" for i in range(DIMS)]).mapInArrow(worker(lambda b: _keys(b, means, deviations)), "row_id long, doc_id long, n_tokens long, tie long, key long")
    order = ["key", "doc_id", "tie", "row_id"]
    ranged = materialize(keys.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "packing-order")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a number per partition
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    first = spark.createDataFrame(before, "part int, part_start long")
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("end", F.sum("n_tokens").over(own)).join(first, "part")
    placed = placed.select("row_id", F.col("key").alias("curve_key"), (F.col("end") - F.col("n_tokens") + F.col("part_start")).alias("at"))
    joined = encoded.select("row_id", "doc_id", "ids").join(placed, "row_id").select("doc_id", "ids", "curve_key", "at")
    return joined.mapInArrow(worker(lambda b: _pieces(b, length)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long, ids binary")


def _pieces(batches, length: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key", "ids"]
    kinds = [pa.int64()] * 8 + [pa.binary()]
    for batch in batches:
        out = []
        for doc, ids, key, at in zip(*(batch[k].to_pylist() for k in ("doc_id", "ids", "curve_key", "at")), strict=True):
            n, start = len(ids) // 2, 0
            while start < n:
                offset = (at + start) % length
                size = min(length - offset, n - start)
                own = ids[2 * start : 2 * (start + size)]
                out.append((doc, start, size, zlib.crc32(np.frombuffer(own, DTYPE).astype("<u4").tobytes()), n, (at + start) // length, offset, key, own))
                start += size
        for i in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 20_000], strict=True), kinds, strict=True)], names=names)
