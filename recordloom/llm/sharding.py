"""Contiguous shards of the smallest capacity.

Rows of equal text are one atomic group; groups lie in the order of their texts' hash. A group that alone reaches the mean of
what is left takes a shard of its own, ahead of the others. Over the rest, the smallest capacity with which contiguous shards
suffice is found by binary search, each capacity checked greedily (fill a shard as far as it goes, then the next one).
Among the cuts that this capacity allows, each one lies as near as possible to an even share of what is left, so that a
greedy remainder doesn't make the last shard small.

The check needs no list of groups. Bytes are counted by leading digits of the hash; a search that lands inside a bucket of several
groups has this bucket counted by two more digits, and is repeated until no cut of it lies in one. The driver sees bucket counts
only: at most 4,096 and 256 for each bucket that a cut was searched in, whatever the number of groups.

Defined results: null and empty texts are one group of 16 bytes a row; repeated rows have a slot each; null doc_ids are rows
like others; a very long text is a group like others; with fewer groups than shards the other shards stay empty; of an
empty table there is nothing; other columns come along, and may be called shard or slot where other names are asked for.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.core import materialize, partitions

SHARDS = 40
#: Bytes that a row takes beside its text.
ROW_BYTES = 16
#: Hash digits of the first count, and by how many a bucket is refined.
DIGITS, FINER = 3, 2


def group_key(text: Column) -> Column:
    """128 bits of the text's SHA-256 in hex: the group, and its place in the order."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


@dataclass
class Boundaries:
    """Where groups can be cut, as far as counted: buckets {leading digits: (bytes, rows, groups)} in order."""

    buckets: dict[str, tuple[int, int, int]]
    wanted: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.names = sorted(self.buckets)
        self.ends, self.rows = [0], [0]
        for name in self.names:
            self.ends.append(self.ends[-1] + self.buckets[name][0])
            self.rows.append(self.rows[-1] + self.buckets[name][1])
        self.total = self.ends[-1]

    def _inside(self, i: int) -> None:
        """A search met the inside of bucket i."""
        if self.buckets[self.names[i]][2] > 1:
            self.wanted.add(self.names[i])

    def floor(self, at: int) -> int:
        """The last boundary at or before at."""
        i = bisect_right(self.ends, at) - 1
        if self.ends[i] < at < self.total:
            self._inside(i)
        return self.ends[i]

    def ceil(self, at: int) -> int:
        """The first boundary at or after at."""
        i = bisect_left(self.ends, max(at, 0))
        if self.ends[i] > max(at, 0):
            self._inside(i - 1)
        return self.ends[i]

    def fits(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.floor(at + capacity)
        return at >= self.total

    def capacity(self, shards: int, largest: int, most: int) -> int:
        """The smallest capacity that fits, most being one that does."""
        low, high = max(-(-self.total // shards), largest), most
        while low < high:
            middle = (low + high) // 2
            if self.fits(middle, shards):
                high = middle
            else:
                low = middle + 1
        return high

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Ends of all shards but the last one, none over the capacity."""
        least = [self.total]  # where the last j shards can begin at the earliest
        for _ in range(shards - 1):
            least.append(self.ceil(least[-1] - capacity))
        out, at = [], 0
        for left in range(shards - 1, 0, -1):
            even = at + (self.total - at) // (left + 1)
            below, above = self.floor(even), self.ceil(even)
            near = below if even - below <= above - even else above
            at = min(max(near, least[left]), self.floor(at + capacity))
            out.append(at)
        return out


def alone(largest: list[tuple[str, int, int]], total: int, shards: int) -> list[tuple[str, int, int]]:
    """The groups (key, bytes, rows), largest first, that take a shard each: those that reach the mean of what is left."""
    out = []
    for group in largest:
        if len(out) == shards - 1 or group[1] * (shards - len(out)) < total:
            break
        out.append(group)
        total -= group[1]
    return out


@dataclass
class Plan:
    """own: groups with a shard of their own, in order; starts: least key of each later shard (None: empty), from the second one."""

    own: list[str]
    starts: list[str | None]
    shares: list[float]  # of a shard, the larger of its share of bytes and of rows
    capacity: int

    def shard(self, key: Column) -> Column:
        base, cuts = len(self.own), [s for s in self.starts if s is not None]
        later = F.lit(base)
        if cuts:
            later = later + F.size(F.filter(F.array(*map(F.lit, cuts)), lambda s: s <= key))
        if not self.own:
            return later.cast("int")
        place = F.create_map(*[F.lit(x) for pair in zip(self.own, range(base), strict=True) for x in pair])
        return F.coalesce(F.try_element_at(place, key), later).cast("int")


def plan(groups: DataFrame, shards: int) -> Plan:
    """groups: key, bytes, rows; one row each. The driver gets the `shards` largest ones and bucket counts."""
    largest = [tuple(r) for r in groups.select("key", "bytes", "rows").orderBy(F.desc("bytes"), "key").limit(shards + 1).collect()]
    total, rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    own = alone(largest, total, shards)
    rest = groups.where(~F.col("key").isin([k for k, _, _ in own])) if own else groups
    left = shards - len(own)
    most = max([n for _, n, _ in largest[len(own) :]], default=0)
    counted = lambda names, by: {r[0]: (r[1], r[2], r[3]) for r in names.groupBy(by.alias("at")).agg(F.sum("bytes"), F.sum("rows"), F.count("*")).collect()}
    found = Boundaries(counted(rest, F.substring("key", 1, DIGITS)))
    capacity = found.total
    while True:
        capacity = found.capacity(left, most, capacity)
        cuts = found.cuts(capacity, left)
        if not found.wanted:
            break
        own_length = lambda n: F.substring("key", 1, n).isin([x for x in found.wanted if len(x) == n])
        lengths = sorted({len(x) for x in found.wanted})
        finer, inside = F.lit(None).cast("string"), F.lit(False)
        for n in lengths:
            finer, inside = F.coalesce(F.when(own_length(n), F.substring("key", 1, n + FINER)), finer), inside | own_length(n)
        found = Boundaries({k: v for k, v in found.buckets.items() if k not in found.wanted} | counted(rest.where(inside), finer))
    at = [bisect_left(found.ends, c) for c in cuts]
    edges = [0, *at, len(found.names)]
    sizes = [(n, r) for _, n, r in own] + [(found.ends[z] - found.ends[a], found.rows[z] - found.rows[a]) for a, z in zip(edges, edges[1:], strict=False)]
    shares = [max(n / total, r / rows) if total else 0.0 for n, r in sizes]
    return Plan([k for k, _, _ in own], [found.names[i] if i < len(found.names) else None for i in at], shares, max([capacity, *[n for _, n, _ in own]]))


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text", names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """docs with shard (int) and slot (long, gapless from 0 in each shard, in hashed order).

    Rows are dealt by shard and piece, a shard having as many pieces as its share of bytes or rows asks for (about four per
    shuffle partition in all), so no task has more than a piece, not even of one text's copies. They are written so, with all
    their columns; slots follow from the pieces' counts, a row per piece.
    """
    sized = docs.select(group_key(F.col(text)).alias("key"), row_size(F.col(text)).alias("size"))
    groups = materialize(sized.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    made = plan(groups, shards)
    deal = 4 * partitions(docs.sparkSession)
    pieces = F.array(*[F.lit(max(1, round(deal * share))) for share in made.shares])
    rows = docs.select(F.struct("*").alias("doc"), group_key(F.col(text)).alias("key"), F.xxhash64(F.col("doc_id")).alias("salt"))
    rows = rows.withColumn("shard", made.shard(F.col("key")))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("key", "salt"), F.get(pieces, F.col("shard"))).cast("int"))
    own = Window.partitionBy("shard", "piece").orderBy("key", "salt")
    placed = materialize(rows.withColumn("place", F.row_number().over(own) - 1).drop("key", "salt"), "shards")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    out = placed.join(F.broadcast(starts), ["shard", "piece"])  # a row per piece: 4 per shuffle partition and 1 per shard at most
    return out.select("doc.*", F.col("shard").alias(names[0]), (F.col("start") + F.col("place")).cast("long").alias(names[1]))
