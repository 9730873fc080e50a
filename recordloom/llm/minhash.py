"""Near-duplicate groups by b-bit MinHash.

Each document is its set of distinct word shingles (64-bit hashes). ``MINIMA`` minima give a packed signature of their
``2`` low bits and band keys of some minima each (``banding``); equal sets are one class from then on. Classes that share a
band key are candidates. Stars inside the band buckets (every class with the bucket's least one) give coarse clusters
without any pair list; the sets of a cluster are then compared in memory: popcounts of the packed signatures estimate
every pair's similarity, corrected for chance collisions, pairs estimated over the margin are confirmed on the full
sets, and only a spanning set of links leaves the task. Clusters above ``CLUSTER_SHINGLES`` are dealt out in blocks and
pairs of blocks, so no task ever holds an unbounded group and no pair is lost.

Bands and margin follow from the threshold: a pair at 85 per cent shares no band with probability (1 - 0.85^6)^24 = 1e-5,
one at 80 with (1 - 0.8^5)^29 = 1e-5, and either is underestimated by the margin of four standard errors with probability
below 1e-4.

Defined results: empty or null text has an empty set, linked with nothing; a text of fewer words than a shingle is one
shingle; repeated rows (also of one doc_id with several texts) are judged each; null doc_ids are linked like others,
reported with component null only if the whole group has none, and not kept beside a row with an id; a very long text's
set is held whole by one task; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.components import connected
from recordloom.llm.core import materialize, partitions, tidy, worker

WORDS = 5
SIMILARITY = 85  # per cent
MINIMA = 160  # 2 bits each: five 64-bit words
MISSED = 1.2e-5  # a pair at the threshold shares no band with this probability at most
CLUSTER_SHINGLES = 1 << 21
MEMORY = 100_000  # words whose hashes a worker remembers
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_RNG = np.random.default_rng(20_240_229)
_A = _RNG.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def banding(similarity: int) -> tuple[int, int]:
    """(bands, rows): the longest rows for which the minima give enough bands."""
    found = []
    for rows in range(1, MINIMA + 1):
        miss = math.log1p(-((similarity / 100) ** rows)) if similarity < 100 else -math.inf
        found.append((max(1, math.ceil(math.log(MISSED) / miss)), rows))
    return max((x for x in found if x[0] * x[1] <= MINIMA), key=lambda x: x[1])


def margin(similarity: int) -> float:
    """The threshold less four standard errors of the estimate."""
    agree = 0.25 + 0.75 * similarity / 100
    return math.floor(similarity - 400 * math.sqrt(agree * (1 - agree) / MINIMA) / 0.75) / 100


class Words(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def shingles(text: str | None, words: Words, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    found = _WORD.findall((text or "").translate(_LOWER))
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(size, len(h))
    if not width:
        return h
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0xC6A4A7935BD1E995) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, (s[i : i + 2048, None] * _A + _B).min(axis=0))
    return low


def signature(low: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, packed: uint64[MINIMA / 32]."""
    bits = (_mix(low) & np.uint64(3)).reshape(-1, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = low[: bands * rows].reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = _mix(key * np.uint64(0xC6A4A7935BD1E995) + cut[:, k])
    return key.view(np.int64)


def estimate(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal 2-bit fields, corrected for the quarter that agree by chance."""
    x = others ^ own
    differ = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1)
    return (1 - differ / MINIMA - 0.25) / 0.75


def similar(a: int, b: int, both: np.ndarray | int, similarity: int = SIMILARITY) -> np.ndarray | bool:
    return 100 * both >= similarity * (a + b - both)


def _set_hash(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signed(batches, similarity: int):
    words, (bands, rows) = Words(), banding(similarity)
    for batch in batches:
        seen: dict = {}
        out = []
        for text in batch["text"]:
            s = shingles(text.as_py(), words)
            key = _set_hash(s)
            if key not in seen:
                low = minima(s) if len(s) else None
                seen[key] = (len(s), key, signature(low).tobytes() if len(s) else None, band_keys(low, bands, rows).tolist() if len(s) else [])
            out.append(seen[key])
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], *columns], names=["doc_id", "text_hash", "n_shingles", "set_hash", "signature", "bands"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def compare(nodes: list[int], sets: list[np.ndarray], signatures: np.ndarray, sides: list[int] | None = None, similarity: int = SIMILARITY) -> list[tuple[int, int]]:
    """Spanning links among the sets of one cluster (or only between the two sides of a pair of blocks)."""
    n = len(nodes)
    order = sorted(range(n), key=lambda i: (len(sets[i]), nodes[i]))
    forest, sizes = _Forest(n), np.array([len(sets[i]) for i in order])
    signs, side = signatures[order], np.array([sides[i] for i in order]) if sides else None
    universe = np.unique(np.concatenate(sets))
    width = -(-len(universe) // 8)
    dense = n > 8 and n * width <= 1 << 26  # sets as bits, at most 64 MB; else sorted arrays
    if dense:
        bits = np.zeros((n, -(-width // 8) * 8), np.uint8)
        for k, i in enumerate(order):
            own = np.zeros(len(universe), np.uint8)
            own[np.searchsorted(universe, sets[i])] = 1
            bits[k, :width] = np.packbits(own)
        bits = bits.view(np.uint64)
    links, least = [], margin(similarity)
    for k in range(1, n):
        first = int(np.searchsorted(sizes[:k], -(-similarity * sizes[k] // 100)))  # a smaller set can't be similar enough
        if first == k:
            continue
        near = first + np.flatnonzero(estimate(signs[k], signs[first:k]) >= least)
        if side is not None:
            near = near[side[near] != side[k]]
        mine = forest.root(k)
        near = [j for j in near.tolist() if forest.root(j) != mine]
        for at in range(0, len(near), 256):
            part = near[at : at + 256]
            if dense:
                both = np.bitwise_count(bits[part] & bits[k]).sum(axis=1, dtype=np.int64)
            else:
                own = sets[order[k]]
                both = np.array([(own.take(np.searchsorted(own, sets[order[j]]), mode="clip") == sets[order[j]]).sum() for j in part])
            for j in np.array(part)[similar(sizes[k], sizes[part], both, similarity)].tolist():
                if forest.root(j) != forest.root(k):
                    forest.join(j, k)
                    links.append((nodes[order[j]], nodes[order[k]]))
    return links


def _linked(batches, similarity: int):
    """Rows sorted by (cluster, left, right): one comparison for each task key as it ends."""
    now, nodes, sets, signs, sides = None, [], [], [], []

    def done():
        left, right = now[1:]
        found = compare(nodes, sets, np.stack(signs), sides if left != right else None, similarity) if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for cluster, left, right, block, node, members, sign in zip(*(batch[k].to_pylist() for k in ("cluster", "left", "right", "block", "node", "members", "signature")), strict=True):
            if (cluster, left, right) != now:
                if now:
                    yield done()
                now, nodes, sets, signs, sides, held = (cluster, left, right), [], [], [], [], set()
            if node in held:  # a repeated row
                continue
            held.add(node)
            nodes.append(node)
            sets.append(np.frombuffer(members, np.uint64))
            signs.append(np.frombuffer(sign, np.uint64))
            sides.append(block)
    if now:
        yield done()


def _members(batches):
    """The set of every document that stands for a class, once for each task: a class's row may be repeated any number of times."""
    words, seen = Words(), set()
    for batch in batches:
        keep, sets = [], []
        for i, (node, text, key) in enumerate(zip(batch["node"].to_pylist(), batch["text"], batch["set_hash"], strict=True)):
            if node in seen:
                continue
            s = shingles(text.as_py(), words)
            if _set_hash(s) == key.as_py():
                seen.add(node)
                keep.append(i)
                sets.append(s.tobytes())
        if keep:
            rest = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*[rest[k] for k in ("cluster", "blocks", "block", "node", "signature")], pa.array(sets, pa.binary())], names=["cluster", "blocks", "block", "node", "signature", "members"])


def _with_hash(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def _groups(docs: DataFrame, similarity: int) -> DataFrame:
    """docs' rows as doc_id, text_hash, n_shingles, group (null for empty sets) and component_id, the group's least doc_id."""
    rows = _with_hash(docs)
    signed = rows.mapInArrow(worker(partial(_signed, similarity=similarity)), "doc_id long, text_hash long, n_shingles long, set_hash binary, signature binary, bands array<long>")
    signed = materialize(signed.withColumn("row", F.monotonically_increasing_id()), "minhash")
    # one class per distinct set; its node is the number of one of its rows
    classes = signed.where("n_shingles > 0").groupBy("set_hash").agg(F.min(F.struct("row", "doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least_doc"), F.min("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("set_hash", F.col("first.row").alias("node"), F.col("first.doc_id").alias("of_doc"), F.col("first.text_hash").alias("of_text"), "least_doc", "n_shingles", "signature", "bands"), "classes")
    keyed = classes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = keyed.join(buckets, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    clusters = connected(stars).withColumnRenamed("component", "cluster")
    tidy(docs.sparkSession)
    sized = classes.select("node", "set_hash", "of_doc", "of_text", "n_shingles", "signature").join(clusters, "node")
    blocks = sized.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES).cast("int").alias("blocks"))
    sized = sized.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = rows.join(sized, (F.col("text_hash") == F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("text", "cluster", "blocks", "block", "node", "signature", "set_hash")
    sets = texts.mapInArrow(worker(_members), "cluster long, blocks int, block int, node long, signature binary, members binary")
    # a block meets itself and every other block of its cluster
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = sets.withColumn("other", F.explode(others)).withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("other", "blocks")
    spread = dealt.repartition(partitions(docs.sparkSession), "cluster", "left", "right").sortWithinPartitions("cluster", "left", "right")
    links = spread.select("cluster", "left", "right", "block", "node", "members", "signature").mapInArrow(worker(partial(_linked, similarity=similarity)), "a long, b long")
    groups = connected(links)
    tidy(docs.sparkSession)
    own = classes.select("set_hash", "node", "least_doc").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = own.groupBy("group").agg(F.min("least_doc").alias("component_id"))
    answer = own.join(least, "group").select("set_hash", "group", "component_id")
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_hash").join(answer, "set_hash", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "group", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """docs' rows as doc_id, n_shingles, component_id, kept (row for row); similarity: per cent from which pairs are linked."""
    out = _groups(docs, similarity).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row of the least doc_id (null ids last; then of the least
    text hash) stays, and only one of rows that are repeated; rows without words stay. All columns as they are."""
    found = _groups(docs, similarity).where(F.col("group").isNotNull())
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    same = found.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n"))  # rows without words have no group
    best = same.groupBy("group").agg(F.min(place).alias("best"))
    judged = materialize(same.join(best, "group").select("doc_id", "text_hash", "n", (place == F.col("best")).alias("head")), "judged")
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    found = (F.col("_hash") == F.col("text_hash")) & F.col("_id").eqNullSafe(F.col("doc_id"))
    # what goes is joined, not what stays: it is less, and as long as Spark may broadcast it no text moves
    kept = rows.join(judged.where("not head or n > 1"), found, "left_anti")
    again = Window.partitionBy("_hash", "_id").orderBy(F.lit(0))
    once = rows.join(judged.where("head and n > 1"), found, "left_semi").withColumn("_nth", F.row_number().over(again)).where("_nth = 1")  # ranked before the shuffle too
    return kept.select("_doc.*").unionAll(once.select("_doc.*"))
