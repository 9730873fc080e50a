"""Token ids in wavelet-matrix shards.

A shard is one row of one Parquet file: the ids of consecutive documents (ascending doc_id), each document ended by id
0, over the shard's own alphabet (its distinct ids, ascending). Bit plane l holds, packed, the l-th highest bit of every
symbol in the order that the planes above give; zeros[l] counts the plane's zeros and ranks[l] the ones before each block
of 4096 bits. So access, rank (counting) and select (occurrence lookup) read one file, without decoding the shard.
Spark's committer writes the files, hence lost executors and any file system Spark knows are fine.

Defined results: null text is empty and gives one id, 0; rows of one doc_id (or of none) go by their text's size, then the
text, and may fill several tasks; null doc_ids come first; a shard closes after ``shard_tokens`` ids, between documents, so a very long document has a longer shard; an empty
table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.core import materialize, partitions
from recordloom.llm.tokens import DTYPE, default_path, encoder

SHARD_TOKENS = 1 << 18
BLOCK = 4096
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id
SCHEMA = "part int, seq int, doc_ids binary, lengths binary, n_tokens long, alphabet binary, planes array<binary>, zeros array<long>, ranks array<binary>"


class WaveletMatrix:
    """A shard's ids with access, rank and select."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[bytes], zeros: list[int], ranks: list[bytes]):
        self.n, self.alphabet, self.zeros = n, alphabet, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.flatnonzero(np.bincount(ids, minlength=1)).astype(DTYPE)
        table = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, DTYPE)
        table[seen] = np.arange(len(seen))
        x, planes, zeros, ranks = table[ids], [], [], []
        for bit in reversed(range(max(1, (len(seen) - 1).bit_length()))):
            on = (x & DTYPE.type(1 << bit)).astype(bool)
            packed = np.packbits(on)
            ones, rest = np.flatnonzero(on), np.flatnonzero(~on)
            x = np.concatenate([x.take(rest), x.take(ones)])
            planes.append(packed.tobytes())
            zeros.append(len(rest))
            edges = np.arange(0, len(on) + 1, BLOCK)
            ranks.append(np.searchsorted(ones, edges).astype("<u4").tobytes())
        return cls(len(ids), seen, planes, zeros, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones in the first i bits of a plane: the block's count and at most 4096 bits more."""
        block = i // BLOCK
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (i + 7) // 8], count=i - block * BLOCK)
        return int(self.ranks[level][block]) + int(bits.sum(dtype=np.int64))

    def access(self, i: int) -> int:
        symbol = 0
        for level, zeros in enumerate(self.zeros):
            bit = self.planes[level][i >> 3] >> (7 - (i & 7)) & 1
            ones = self._ones(level, i)
            symbol, i = symbol << 1 | int(bit), zeros + ones if bit else i - ones
        return int(self.alphabet[symbol])

    def _symbol(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the symbol's run begins below the last plane, and where its first i places' share ends."""
        lo, hi = 0, i
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (zeros + a, zeros + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i ids."""
        symbol = self._symbol(token)
        if symbol is None:
            return 0
        lo, hi = self._range(symbol, i)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0), or -1."""
        symbol = self._symbol(token)
        if symbol is None or k >= self.rank(token, self.n):
            return -1
        i = self._range(symbol, 0)[0] + k
        for level in reversed(range(len(self.zeros))):
            i = self._place(level, symbol >> (len(self.zeros) - 1 - level) & 1, i)
        return i

    def _place(self, level: int, bit: int, i: int) -> int:
        """Where the bit that went to place i stands in its plane: search the blocks, then one block."""
        starts = self.ranks[level].astype(np.int64)
        want = i - self.zeros[level] if bit else i
        starts = starts if bit else np.minimum(np.arange(len(starts), dtype=np.int64) * BLOCK, self.n) - starts
        block = int(np.searchsorted(starts, want, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], count=min(BLOCK, self.n - block * BLOCK))
        return block * BLOCK + int(np.flatnonzero(bits == bit)[want - int(starts[block])])

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        x = np.zeros(self.n, DTYPE)
        for level in reversed(range(len(self.zeros))):
            on, zeros, y = np.unpackbits(self.planes[level], count=self.n).view(bool), self.zeros[level], np.empty(self.n, DTYPE)
            y[np.flatnonzero(~on)] = x[:zeros]
            y[np.flatnonzero(on)] = x[zeros:] | DTYPE.type(1 << (len(self.zeros) - 1 - level))
            x = y
        return self.alphabet[x] if self.n else x


def _shards(batches: Iterator[pa.RecordBatch], path: str, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    tokenizer, part = encoder(path), TaskContext.get().partitionId()
    seq, ids, docs, lengths, total = 0, [], [], [], 0

    def close() -> pa.RecordBatch:
        matrix = WaveletMatrix.build(np.concatenate(ids))
        known = np.array([NO_ID if d is None else d for d in docs], "<i8")
        row = [part, seq, known.tobytes(), np.array(lengths, "<i8").tobytes(), matrix.n, matrix.alphabet.tobytes(), [p.tobytes() for p in matrix.planes], matrix.zeros, [r.tobytes() for r in matrix.ranks]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "seq", "doc_ids", "lengths", "n_tokens", "alphabet", "planes", "zeros", "ranks"])

    end = np.zeros(1, DTYPE)
    for batch in batches:
        for doc, own in zip(batch["doc_id"].to_pylist(), tokenizer.encode_all(batch["text"].to_pylist()), strict=True):
            ids += [own, end]
            docs.append(doc)
            lengths.append(len(own) + 1)
            total += lengths[-1]
            if total >= shard_tokens:
                yield close()
                seq, ids, docs, lengths, total = seq + 1, [], [], [], 0
    if docs:
        yield close()


def write_shards(docs: DataFrame, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS, tokenizer_partitions: int | None = None) -> DataFrame:
    """Write the shards (one table in the shared folder) and return them as read back."""
    path = tokenizer or default_path()
    n = tokenizer_partitions or partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    place = [F.col("doc_id"), F.octet_length("text")]
    ordered = rows.repartitionByRange(n, *place).sortWithinPartitions(*place, "text")
    return materialize(ordered.mapInArrow(lambda batches: _shards(batches, path, shard_tokens), SCHEMA), "wavelet")


def open_shard(row) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], np.frombuffer(row["alphabet"], DTYPE), row["planes"], row["zeros"], row["ranks"])


def document_table(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = shards.sparkSession
    # one small row per shard; the running sum over range partitions needs only a number per partition on the driver
    sizes = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    from pyspark.sql import Window

    first = spark.createDataFrame([(p, b) for p, b in before.items()], "part int, part_start long") if before else spark.createDataFrame([], "part int, part_start long")
    starts = shards.select("part", "seq", "n_tokens").withColumn("own", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens"))
    starts = starts.join(first, "part").select("part", "seq", (F.col("own") + F.col("part_start")).alias("shard_start"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = open_shard(row).decode().astype("<u4")
                lengths = np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                docs = np.frombuffer(row["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(docs), pa.int32()), pa.array([row["seq"]] * len(docs), pa.int32()), pa.array(docs, mask=docs == NO_ID), pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())], names=["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(read, "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
