"""Removal of byte strings that an earlier document has, by common-prefix intervals of a suffix array.

Every 50-byte window has an anchor: its rightmost 16-byte string of least hash. The anchor depends on the window's bytes
only, so equal windows have equal anchors at equal places, and it is enough to compare the windows that an anchor owns:
its region (at most 84 bytes). Regions are gathered by (anchor, region) hash in sorted, packed lists, once a chunk of
documents; anchors of one document need nothing more. For every anchor that several documents have, the bytes of its
distinct regions (classes) are fetched, and each task builds the enhanced suffix array of its classes (window suffixes,
sorted, with common prefix lengths) and scans it with a stack: every interval of the common-prefix tree whose occurrences
have different left neighbours is a maximal repeat group, and so is a class that occurs more than once. The groups together
give, for each window, the least document that has it; a window is removed when its document is later than that one.

Classes stand for all their occurrences, which share anchor and region hash (64 bits each); before a byte is removed a
third hash of the region must agree with that of the fetched bytes, else the byte stays. Chunks are written once and
addressed by (chunk, entry), so repeated doc_ids and ties are exact.

``maximal_repeats`` lists the groups with all occurrences. Groups of neighbouring regions that have the same occurrences are
joined, so a repeat is reported whole, however long, as long as no part of it that fills a region occurs more often; where
one does, the repeat is reported in parts, and that part as a group of its own.

Defined results: null or empty text has no bytes; texts under 50 bytes keep all; two rows of the same doc_id never
remove each other's bytes; null doc_ids are taken as the earliest (a doc_id of the least long is taken for null); very long documents are a chunk of
their own; an empty table gives no rows; columns named like an added one are replaced (``prefix`` avoids that), all other
columns are carried along unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from recordloom.llm.core import materialize, memory, partitions, tidy, worker

LENGTH = 50
SEED = 16
ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
CHUNK_BYTES = 1 << 21
U = np.uint64
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_CHECK = 0xD1342543DE82EF95
#: Bytes of input for each bucket of anchors.
BUCKET_BYTES = 1 << 23
ONCE, REPEATED, SEVERAL = 0, 1, 2
#: An entry of a packed list: hashes, least doc_id of the chunk, place in the chunk, size, and whether it comes once, again in
#: one document, or in several documents of the chunk.
ENTRY = np.dtype([("anchor", "<u8"), ("region", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("size", "u1"), ("spread", "u1")])


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _string_hash(prefix: np.ndarray, start: np.ndarray, size: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Hash of many substrings from prefix hashes: H[i + n] - H[i] * P^n."""
    return _spread(prefix[start + size] - prefix[start] * powers[size])


def _anchors(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every SEED-byte string, and for every window start the place of its anchor."""
    h, step, factor = buf.astype(U) + U(1), 1, _P
    while step < SEED:  # SEED is a power of two
        n = len(h) - step
        h = h[:n] * U(factor) + h[step:]
        step, factor = 2 * step, factor * factor & _MASK
    h = _spread(h)
    # upper half of the hash, then the place from the right: the least key is the rightmost place of the least hash
    low = U(0xFFFFFFFF)
    least, have, want = (h & ~low) | (low - np.arange(len(h), dtype=U)), 1, LENGTH - SEED + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return h, (low - (least & low)).astype(np.int64)


class Chunk:
    """Concatenated texts with their documents."""

    def __init__(self, row: dict):
        self.docs = np.frombuffer(row["doc_ids"], "<i8")
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.buf = np.frombuffer(zstandard.decompress(row["bytes"]) if row["n_bytes"] else b"", np.uint8)
        self.ends = np.cumsum(self.lengths)

    def regions(self) -> dict[str, np.ndarray]:
        """Every anchor occurrence: document's index, first window, windows, anchor's place, hashes."""
        n = len(self.buf) - LENGTH + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return {"doc": none, "at": none, "windows": none, "anchor": none.astype(U), "region": none.astype(U)}
        seeds, at = _anchors(self.buf)
        inside = np.zeros(n + 1, np.int8)  # windows that don't cross a document's end
        starts, stops = self.ends - self.lengths, self.ends - LENGTH + 1
        long = self.lengths >= LENGTH
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, stops[long], -1)
        inside = np.cumsum(inside, dtype=np.int8)[:n].astype(bool)
        edge = np.empty(n, bool)
        edge[0] = True
        edge[1:] = (at[1:n] != at[: n - 1]) | ~inside[: n - 1]
        first = np.flatnonzero(edge & inside)
        bound = np.append(np.flatnonzero(edge | ~inside), n)
        windows = bound[np.searchsorted(bound, first, side="right")] - first
        prefix = _prefix_hashes(self.buf)
        powers = np.array([pow(_P, k, 1 << 64) for k in range(2 * LENGTH)], U)
        size = windows + LENGTH - 1
        anchor = at[first]
        doc = np.searchsorted(self.ends, first, side="right")
        region = _string_hash(prefix, first, size, powers) ^ (anchor - first).astype(U) * U(0xA24BAED4963EE407)
        return {"doc": doc, "at": first, "windows": windows, "anchor": _spread(seeds[anchor] + U(_P)), "region": region}  # minima are small numbers: spread them again

    def entries(self) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """The chunk's distinct (anchor, region)s, sorted; its occurrences; the entry of each of them."""
        r = self.regions()
        doc_id = self.docs[r["doc"]] if len(self.docs) else r["doc"]
        order = np.lexsort((r["region"], r["anchor"]))
        a, g, d = r["anchor"][order], r["region"][order], doc_id[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (g[1:] != g[:-1])
        first = np.flatnonzero(new)
        out = np.empty(len(first), ENTRY)
        if len(first):
            pick = order[first]  # any occurrence: the bytes are the same
            out["anchor"], out["region"], out["doc"] = a[first], g[first], np.minimum.reduceat(d, first)
            again = np.diff(np.append(first, len(a))) > 1
            out["spread"] = np.where(np.maximum.reduceat(d, first) != out["doc"], SEVERAL, np.where(again, REPEATED, ONCE))
            out["at"], out["size"] = r["at"][pick], r["windows"][pick] + LENGTH - 1
        entry = np.empty(len(a), np.int64)
        entry[order] = np.cumsum(new) - 1
        return out, r, entry


def _prefix_hashes(buf: np.ndarray, p: int = _P) -> np.ndarray:
    """H[i] = hash of the first i bytes, mod 2^64: a scan by blocks, each a weighted running sum."""
    # sum of b[j] * p^-j, times p^i: p is odd, so it has an inverse mod 2^64
    inverse = pow(p, -1, 1 << 64)
    n = len(buf)
    down = _powers(inverse, n)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum((buf.astype(U) + U(1)) * down, out=total[1:])
    return total * _powers(p, n + 1) * U(inverse)


def _check_hashes(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of substrings by another base than the regions' own."""
    powers = np.array([pow(_CHECK, k, 1 << 64) for k in range(2 * LENGTH)], U)
    return _string_hash(_prefix_hashes(buf, _CHECK), at, size, powers)


def _powers(base: int, n: int) -> np.ndarray:
    known = memory("powers")
    table = known.get(base)
    if table is None or len(table) < n:
        table = np.ones(max(n, CHUNK_BYTES + 2), U)
        have = 1
        while have < len(table):
            step = min(have, len(table) - have)
            table[have : have + step] = table[:step] * U(pow(base, have, 1 << 64))
            have += step
        if len(table) <= 1 << 23:
            known[base] = table
    return table[:n]


def _chunks(batches: Iterator[pa.RecordBatch], doc_id: str, text: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch[text]]
        rest = batch.select([k for k in batch.schema.names if k != text])
        at = 0
        while at < len(raw):
            stop, size = at, 0
            while stop < len(raw) and (stop == at or size + len(raw[stop]) <= CHUNK_BYTES):
                size += len(raw[stop])
                stop += 1
            ids = [np.iinfo(np.int64).min if d is None else d for d in batch[doc_id].slice(at, stop - at).to_pylist()]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rest.slice(at, stop - at))
            values = [part << 32 | seq, np.array(ids, "<i8").tobytes(), np.array([len(b) for b in raw[at:stop]], "<i8").tobytes(), size, zstandard.compress(b"".join(raw[at:stop]), 3), sink.getvalue().to_pybytes(), [t.is_valid for t in batch[text].slice(at, stop - at)]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["chunk", "doc_ids", "lengths", "n_bytes", "bytes", "rest", "known"])
            seq, at = seq + 1, stop


CHUNKS = "chunk long, doc_ids binary, lengths binary, n_bytes long, bytes binary, rest binary, known array<boolean>"


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch[k][i].as_py() for k in batch.schema.names}


def _lists(batches, buckets: int):
    """One packed list of entries for each bucket of the anchor hash."""
    for row in _rows(batches):
        entries = Chunk(row).entries()[0]
        bucket = ((entries["anchor"] >> U(32)) * U(buckets) >> U(32)).astype(np.int64)  # entries are sorted by it
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(edges[1:] > edges[:-1])
        packed = [_pack(entries[edges[b] : edges[b + 1]]) for b in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()), pa.array(edges[full], pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "chunk", "base", "entries"])


def _pack(entries: np.ndarray) -> bytes:
    """Columns one after the other, anchors as differences: sorted hashes and small numbers compress."""
    delta = np.diff(entries["anchor"], prepend=U(0))
    parts = [np.uint64(len(entries)).tobytes(), delta.view(np.uint8).reshape(-1, 8).T.tobytes(), entries["region"].tobytes()]
    docs, place = np.unique(entries["doc"], return_inverse=True)
    planes = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4).T.tobytes()
    parts += [np.uint64(len(docs)).tobytes(), docs.tobytes(), planes(place.astype("<u4")), planes(entries["at"])]
    parts += [np.ascontiguousarray(entries[k]).tobytes() for k in ("size", "spread")]
    return zstandard.compress(b"".join(parts), 1)


def _unpack(data: bytes) -> np.ndarray:
    raw, at = zstandard.decompress(data), 8
    n = int(np.frombuffer(raw[:8], "<u8")[0])
    out = np.empty(n, ENTRY)

    def take(width: int, count: int, planes: bool) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(raw, np.uint8, width * count, at)
        at += width * count
        part = part.reshape(width, count).T if planes else part.reshape(count, width)
        return np.ascontiguousarray(part).view(f"<u{width}").ravel()

    out["anchor"] = np.cumsum(take(8, n, True))
    out["region"] = take(8, n, False)
    docs = take(8, int(take(8, 1, False)[0]), False).view("<i8")
    out["doc"] = docs[take(4, n, True)]
    out["at"] = take(4, n, True)
    for k in ("size", "spread"):
        out[k] = take(1, n, False)
    return out


KINDS = "kind string, bucket int, chunk long, data binary"
MEMBER = np.dtype([("entry", "<u4"), ("kind", "<u4")])  # kind: number of the class in its bucket
CLASS = np.dtype([("kind", "<u4"), ("doc", "<i8"), ("at", "<u4"), ("size", "u1"), ("again", "u1")])


def _compared(batches, everything: bool):
    """Per bucket, of the anchors that several documents have: the classes, each at one place (fetch), and the entries that
    belong to them (member); unless everything is asked for, without those entries that no document is earlier than."""
    now, lists = None, []

    def done():
        parts = [_unpack(x[2]) for x in lists]
        e = np.concatenate(parts)
        source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        entry = np.concatenate([np.arange(len(p)) + x[1] for p, x in zip(parts, lists, strict=True)])
        order = np.lexsort((e["doc"], e["region"], e["anchor"]))
        e, source, entry = e[order], source[order], entry[order]
        new_anchor = np.ones(len(e), bool)
        new_anchor[1:] = e["anchor"][1:] != e["anchor"][:-1]
        new_region = new_anchor.copy()
        new_region[1:] |= e["region"][1:] != e["region"][:-1]
        anchor, firsts = np.cumsum(new_anchor) - 1, np.flatnonzero(new_anchor)
        if not len(e):
            return
        low, high = np.minimum.reduceat(e["doc"], firsts), np.maximum.reduceat(e["doc"], firsts)
        shared = ((low != high) | (np.maximum.reduceat(e["spread"], firsts) == SEVERAL))[anchor]  # else the anchor is in one document only
        heads = np.flatnonzero(new_region)
        again = (np.maximum.reduceat(e["spread"], heads) > ONCE) | (np.diff(np.append(heads, len(e))) > 1)
        region = np.cumsum(new_region) - 1
        kind = np.cumsum(new_region & shared) - 1
        named = shared if everything else shared & ((e["doc"] > low[anchor]) | (e["spread"] == SEVERAL))
        names, buckets, chunks, data = [], [], [], []

        def put(name, which, values):
            if not len(which):
                return
            which = which[np.argsort(source[which], kind="stable")]
            edges = np.flatnonzero(np.diff(source[which], prepend=-1))
            for first, stop in zip(edges, np.append(edges[1:], len(which)), strict=True):
                names.append(name)
                buckets.append(now)
                chunks.append(lists[source[which[first]]][0])
                data.append(values(which[first:stop]).tobytes())

        put("member", np.flatnonzero(named), lambda i: _structured(MEMBER, entry=entry[i], kind=kind[i]))
        put("fetch", np.flatnonzero(shared & new_region), lambda i: _structured(CLASS, kind=kind[i], doc=e["doc"][i], at=e["at"][i], size=e["size"][i], again=again[region[i]]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(buckets, pa.int32()), pa.array(chunks, pa.int64()), pa.array(data, pa.binary())], names=["kind", "bucket", "chunk", "data"])

    for batch in batches:
        for bucket, chunk, base, entries in zip(*(batch[k].to_pylist() for k in ("bucket", "chunk", "base", "entries")), strict=True):
            if bucket != now:
                if lists:
                    yield from done()
                now, lists = bucket, []
            lists.append((chunk, base, entries))
    if lists:
        yield from done()


def _structured(dtype: np.dtype, /, **columns) -> np.ndarray:
    out = np.empty(len(next(iter(columns.values()))), dtype)
    for k, v in columns.items():
        out[k] = v
    return out


def _fetched(batches):
    """The bytes of asked regions: per bucket, classes and concatenated bytes."""
    for batch in batches:
        names, data = [], []
        for row in _pylist(batch):
            chunk = Chunk(row)
            for ask in row["asks"]:
                e = np.frombuffer(ask["data"], CLASS)
                size = e["size"].astype(np.int64)
                place = np.repeat(e["at"].astype(np.int64) - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                names.append(ask["bucket"])
                data.append(zstandard.compress(len(e).to_bytes(8, "little") + e.tobytes() + chunk.buf[place].tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])


def _pylist(batch):
    for i in range(batch.num_rows):
        yield {k: batch[k][i].as_py() for k in batch.schema.names}


class SuffixArray:
    """Enhanced suffix array of the window suffixes of separate regions, as far as the regions reach."""

    WIDTH = 2 * LENGTH - SEED

    def __init__(self, regions: np.ndarray, sizes: np.ndarray):
        """regions: bytes of all regions, one after the other."""
        starts = np.cumsum(sizes) - sizes
        windows = sizes - LENGTH + 1
        region = np.repeat(np.arange(len(sizes)), windows)
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        at, left = starts[region] + offset, sizes[region] - offset
        padded = np.concatenate([regions + np.uint8(1), np.zeros(self.WIDTH + 8, np.uint8)])  # UTF-8 has no byte 255; 0 ends a region
        self._eights = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
        order = self._sorted(at, left)
        self.region, self.offset, at, left = region[order], offset[order], at[order], left[order]
        self.lcp = np.minimum(self._common(at, left), np.minimum(left[1:], left[:-1]))
        self.left = np.where(self.offset > 0, padded[at - 1].astype(np.int64), 256 + self.region)  # no left neighbour: unlike any other

    def _word(self, at: np.ndarray, left: np.ndarray, begin: int) -> np.ndarray:
        """Bytes begin to begin + 7 of suffixes as numbers that sort like them, 0 behind a region's end."""
        over = np.clip(8 * (8 - (left - begin)), 0, 64).astype(U)
        here = self._eights[np.minimum(at + begin, len(self._eights) - 1)].astype(U)
        return np.where(over < U(64), here >> np.minimum(over, U(63)) << np.minimum(over, U(63)), U(0))

    def _sorted(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Order of the suffixes: by their first eight bytes, then those that are still alike by further bytes, and so on."""
        if not len(at):
            return np.zeros(0, np.int64)
        order = np.argsort(key := self._word(at, left, 0))
        key = key[order]
        alike = np.arange(len(at))  # places in order that aren't settled
        new = np.concatenate([[True], key[1:] != key[:-1]])  # where a group of suffixes without a difference yet begins
        begin = 8
        while begin < self.WIDTH:
            more = ~(new & np.append(new[1:], True))  # groups of two and more
            alike, new = alike[more], new[more]
            if not len(alike):
                break
            group = np.cumsum(new) - 1
            width = (64 - int(group[-1]).bit_length()) // 8  # bytes that fit behind the group's number
            own = order[alike]
            key = self._word(at[own], left[own], begin) >> U(64 - 8 * width)
            if width < 8:
                key |= group.astype(U) << U(8 * width)
            by = np.argsort(key)
            order[alike], key = own[by], key[by]  # groups stay where they are
            new |= np.concatenate([[True], key[1:] != key[:-1]])
            begin += width
        return order

    def _common(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Equal bytes at the beginning of neighbours."""
        out = np.zeros(max(0, len(at) - 1), np.int64)
        alike = np.arange(len(out))
        for begin in range(0, self.WIDTH, 8):
            if not len(alike):
                break
            differ = self._word(at[alike], left[alike], begin) ^ self._word(at[alike + 1], left[alike + 1], begin)
            out[alike] += sum((differ < U(1 << 64 - 8 * n)).astype(np.int64) for n in range(1, 9))  # leading bytes without a difference
            alike = alike[differ == 0]
        return out

    def maximal_repeats(self) -> list[tuple[int, int, int]]:
        """(length, first, stop) of the tree's intervals of LENGTH or more with different left neighbours."""
        found = []
        long = np.flatnonzero(np.diff(np.concatenate([[False], self.lcp >= LENGTH, [False]]).astype(np.int8)))
        for first, stop in zip(long[::2].tolist(), long[1::2].tolist(), strict=True):  # runs of lcp[first:stop]
            own, side = self.lcp[first:stop].tolist(), self.left[first : stop + 1].tolist()
            stack: list[list] = []  # [length, first, the common left neighbour or None]
            for i, depth in enumerate([*own, 0]):
                begin, same = first + i, side[i]
                while stack and stack[-1][0] > depth:
                    length, begin, had = stack.pop()
                    same = had if had == same else None
                    if same is None:
                        found.append((length, begin, first + i + 1))
                    if stack and stack[-1][0] >= depth:
                        stack[-1][2] = same = stack[-1][2] if stack[-1][2] == same else None
                if depth and (not stack or stack[-1][0] < depth):
                    stack.append([depth, begin, same])
                elif depth:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == same else None
        return found


#: An occurrence of a group in a class of its bucket.
OCCURRENCE = np.dtype([("group", "<u4"), ("kind", "<u4"), ("offset", "u1"), ("length", "u1")])
RUN = np.dtype([("first", "u1"), ("windows", "u1"), ("doc", "<i8")])


def _resolved(batches, everything: bool):
    """Per bucket: for every class, the least document of each of its windows, as runs, and its check hash; if everything is
    asked for, also the occurrences of the groups in the classes."""
    now, held = None, []

    def done():
        entries, text = [], []
        for data in held:
            raw = zstandard.decompress(data)
            n = int.from_bytes(raw[:8], "little")
            entries.append(np.frombuffer(raw, CLASS, n, 8))
            text.append(np.frombuffer(raw, np.uint8, offset=8 + n * CLASS.itemsize))
        e, text = np.concatenate(entries), np.concatenate(text)
        length = e["size"].astype(np.int64)
        checks = np.empty(len(e), U)
        checks[e["kind"]] = _check_hashes(text, np.cumsum(length) - length, length)
        array = SuffixArray(text, length)
        groups = array.maximal_repeats()
        size = length - LENGTH + 1
        base = np.cumsum(size) - size
        low = np.repeat(e["doc"], size)  # a class is a group of its own: all of it has its least document
        reach, first, stop = (np.array(x, np.int64) for x in (zip(*groups, strict=True) if groups else ([], [], [])))
        occurrences = b""
        if groups:
            # least document of each interval; the appended place keeps its end in range
            doc = np.minimum.reduceat(np.append(e["doc"][array.region], np.iinfo(np.int64).max), np.column_stack([first, stop]).ravel())[::2]
            # all windows inside every occurrence of every group
            group, k = _spread_out(stop - first)
            row = first[group] + k
            start = base[array.region[row]] + array.offset[row]
            part, k = _spread_out((reach - LENGTH + 1)[group])
            np.minimum.at(low, start[part] + k, doc[group[part]])
            if everything:
                occurrences = _structured(OCCURRENCE, group=group, kind=e["kind"][array.region[row]], offset=array.offset[row], length=reach[group]).tobytes()
        if everything:
            # a class that comes more than once is a leaf of several occurrences, unless other regions begin with all of it
            beside = np.maximum(np.append(array.lcp, 0), np.append(0, array.lcp))
            leaf = (array.offset == 0) & (e["again"][array.region] > 0) & (beside < length[array.region])
            again = np.sort(array.region[leaf])
            occurrences += _structured(OCCURRENCE, group=len(groups) + np.arange(len(again)), kind=e["kind"][again], offset=np.zeros(len(again)), length=length[again]).tobytes()
        of = np.repeat(np.arange(len(e)), size)
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (low[1:] != low[:-1])]))
        new = new[np.argsort(e["kind"][of[new]], kind="stable")]  # runs by class
        stops = np.append(np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (low[1:] != low[:-1])])), len(low))
        runs = _structured(RUN, first=new - base[of[new]], windows=stops[np.searchsorted(stops, new) + 1] - new, doc=low[new])
        counts = np.bincount(e["kind"][of[new]], minlength=len(e))
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *[pa.array([x], pa.binary()) for x in (checks.tobytes(), counts.astype("<u1").tobytes(), runs.tobytes(), occurrences)]], names=["bucket", "checks", "counts", "runs", "occurrences"])

    for batch in batches:
        for bucket, data in zip(batch["bucket"].to_pylist(), batch["data"].to_pylist(), strict=True):
            if bucket != now:
                if held:
                    yield done()
                now, held = bucket, []
            held.append(data)
    if held:
        yield done()


def _spread_out(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number within its owner of each of sum(counts) things."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


ANSWER = np.dtype([("entry", "<u4"), ("first", "u1"), ("windows", "u1"), ("doc", "<i8"), ("check", "<u8")])


def _answered(batches):
    """Members of a bucket (grouped by chunk) with the runs of their classes: answers for each chunk."""
    for batch in batches:
        for row in _pylist(batch):
            checks, counts = np.frombuffer(row["checks"], "<u8"), np.frombuffer(row["counts"], "u1").astype(np.int64)
            runs, stops = np.frombuffer(row["runs"], RUN), np.cumsum(counts)
            chunks, data = [], []
            for m in row["members"]:
                e = np.frombuffer(m["data"], MEMBER)
                n = counts[e["kind"]]
                pick = np.repeat(stops[e["kind"]] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
                answer = _structured(ANSWER, entry=np.repeat(e["entry"], n), first=runs["first"][pick], windows=runs["windows"][pick], doc=runs["doc"][pick], check=np.repeat(checks[e["kind"]], n))
                chunks.append(m["chunk"])
                data.append(zstandard.compress(answer.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(data, pa.binary())], names=["chunk", "data"])


class Places:
    """A chunk's occurrences by entry."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        self.entries, self.all, entry = chunk.entries()
        self.order = np.argsort(entry, kind="stable")
        self.bounds = np.searchsorted(entry[self.order], np.arange(len(self.entries) + 1))

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each entry asked for, and the place in the question of each."""
        k = self.bounds[which + 1] - self.bounds[which]
        pick = np.repeat(self.bounds[which] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        return self.order[pick], np.repeat(np.arange(len(which)), k)

    def checks(self) -> np.ndarray:
        """The check hash of every entry."""
        return _check_hashes(self.chunk.buf, self.entries["at"].astype(np.int64), self.entries["size"].astype(np.int64))


def _covered(chunk: Chunk, answers: list[bytes]) -> np.ndarray:
    """Which bytes of the chunk go: the windows that an earlier document has, where the region is the one that was compared."""
    n = len(chunk.buf)
    if not answers or not n:
        return np.zeros(n, bool)
    places = Places(chunk)
    answer = np.concatenate([np.frombuffer(zstandard.decompress(data), ANSWER) for data in answers])
    answer = answer[places.checks()[answer["entry"]] == answer["check"]]
    doc_id, mark = chunk.docs[places.all["doc"]], np.zeros(n + LENGTH, np.int32)
    for part in np.array_split(answer, 1 + len(answer) // (1 << 18)):  # a few million windows at a time
        at, asked = places.of(part["entry"].astype(np.int64))
        later = doc_id[at] > part["doc"][asked]
        at, asked = at[later], asked[later]
        start = places.all["at"][at] + part["first"][asked]
        mark += np.bincount(start, minlength=len(mark)).astype(np.int32)
        mark -= np.bincount(start + part["windows"][asked].astype(np.int64) + LENGTH - 1, minlength=len(mark)).astype(np.int32)
    return np.cumsum(mark)[:n] > 0


def _kept(batches, names: list[str], text: str, prefix: str):
    """The documents of every chunk without the covered bytes, other columns as they were."""
    for batch in batches:
        for row in _pylist(batch):
            chunk = Chunk(row)
            gone = _covered(chunk, row["answers"] or [])
            rest = pa.ipc.open_stream(row["rest"]).read_next_batch()
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], text: []}
            for stop, length, known in zip(chunk.ends.tolist(), chunk.lengths.tolist(), row["known"], strict=True):
                off = gone[stop - length : stop]
                left = chunk.buf[stop - length : stop][~off].tobytes()
                out["n_bytes"].append(length)
                out["n_removed"].append(length - len(left))
                out["n_spans"].append(int((off[1:] & ~off[:-1]).sum() + off[:1].sum()))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out[text].append(left.decode("utf-8", "ignore") if known else None)  # a character cut in two goes wholly
            kinds = {"kept_sha256": pa.string(), text: pa.string()}
            columns = {k if k == text else prefix + k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()} | {k: rest[k] for k in rest.schema.names}
            yield pa.RecordBatch.from_arrays([columns[k] for k in names], names=names)


def _dealt(rows: DataFrame) -> DataFrame:
    """Buckets in turn to the partitions, as many to each."""
    n = partitions(rows.sparkSession)
    return rows.repartitionById(n, F.col("bucket") % n)


def _stages(docs: DataFrame, doc_id: str, text: str, everything: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks; members and fetches by bucket; the resolved buckets."""
    spark = docs.sparkSession
    chunks = materialize(docs.withColumn(doc_id, F.col(doc_id).cast("long")).mapInArrow(worker(lambda b: _chunks(b, doc_id, text)), CHUNKS), "chunks", "none")
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = min(1 << 30, max(2 * partitions(spark), -(-size // BUCKET_BYTES)))  # a bucket's work is bounded whatever the input
    lists = chunks.mapInArrow(worker(lambda b: _lists(b, buckets), "powers"), "bucket int, chunk long, base long, entries binary")
    lists = _dealt(lists).sortWithinPartitions("bucket", "chunk")
    found = materialize(lists.mapInArrow(worker(lambda b: _compared(b, everything), "powers"), KINDS), "repeats")
    tidy(spark)  # the lists are the largest shuffle
    asks = found.where("kind = 'fetch'").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias("asks"))  # bounded by the chunk
    fetched = chunks.drop("rest", "known").join(asks, "chunk").mapInArrow(worker(_fetched, "powers"), "bucket int, data binary")
    fetched = _dealt(fetched).sortWithinPartitions("bucket")
    resolved = materialize(fetched.mapInArrow(worker(lambda b: _resolved(b, everything), "powers"), "bucket int, checks binary, counts binary, runs binary, occurrences binary"), "resolved")
    tidy(spark)
    members = found.where("kind = 'member'").groupBy("bucket").agg(F.collect_list(F.struct("chunk", "data")).alias("members"))  # bounded by the bucket
    return chunks, members, resolved


def _placed(batches):
    """Members of a bucket (grouped by chunk) with the groups' occurrences in their classes: (group, entry, offset, length) for
    each chunk."""
    for batch in batches:
        for row in _pylist(batch):
            found = np.frombuffer(row["occurrences"], OCCURRENCE)
            found = found[np.argsort(found["kind"], kind="stable")]
            for m in row["members"]:
                e = np.frombuffer(m["data"], MEMBER)
                first, stop = (np.searchsorted(found["kind"], e["kind"], side=side) for side in ("left", "right"))
                of, k = _spread_out(stop - first)
                own = found[first[of] + k]
                n = len(own)
                columns = [pa.array(np.full(n, m["chunk"]), pa.int64()), pa.array(row["bucket"] << 32 | own["group"].astype(np.int64)), pa.array(e["entry"][of].astype(np.int64)), pa.array(own["offset"].astype(np.int64)), pa.array(own["length"].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "group", "entry", "offset", "length"])


def _located(batches):
    """Every occurrence of the asked groups in the chunk's documents."""
    for batch in batches:
        for row in _pylist(batch):
            chunk, asks = Chunk(row), row["asks"]
            places = Places(chunk)
            group, entry, offset, length = (np.array([a[k] for a in asks], np.int64) for k in ("group", "entry", "offset", "length"))
            at, asked = places.of(entry)
            doc = places.all["doc"][at]
            start = places.all["at"][at] + offset[asked] - (chunk.ends - chunk.lengths)[doc]
            least = np.iinfo(np.int64).min
            ids = chunk.docs[doc]
            columns = [pa.array(group[asked]), pa.array(length[asked]), pa.array(ids, mask=ids == least), pa.array(np.full(len(doc), row["chunk"])), pa.array(doc), pa.array(start)]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "length", "doc_id", "chunk", "nth", "start"])


def maximal_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of repeated strings that two or more documents have, one row for each occurrence: repeat (a number), length (in
    bytes), occurrences (how many), doc_id, start (in bytes, in that document).

    A group is an interval of a bucket's tree; intervals whose occurrences are the same but for a shift, and whose windows
    adjoin, are joined to one group. Sums over the occurrences that don't change with the shift tell which are."""
    chunks, members, resolved = _stages(docs.select(doc_id, text), doc_id, text, everything=True)
    asks = resolved.select("bucket", "occurrences").join(members, "bucket").mapInArrow(worker(_placed, "powers"), "chunk long, group long, entry long, offset long, length long")
    asks = asks.groupBy("chunk").agg(F.collect_list(F.struct("group", "entry", "offset", "length")).alias("asks"))  # bounded by the chunk
    found = chunks.select("chunk", "doc_ids", "lengths", "n_bytes", "bytes").join(asks, "chunk").mapInArrow(worker(_located, "powers"), "group long, length long, doc_id long, chunk long, nth long, start long")
    found = materialize(found, "occurrences")
    wide = lambda c: c.cast("decimal(38,0)")
    mark = wide(F.xxhash64("chunk", "nth") % (1 << 30))
    least = F.min(F.struct("chunk", "nth", "start")).alias("first")
    groups = found.groupBy("group").agg(F.first("length").alias("length"), F.count("*").alias("n"), least, F.sum(mark).alias("m0"), F.sum(mark * wide(F.col("start"))).alias("m1"))
    several = found.groupBy("group").agg(F.min(F.struct("chunk", "nth")).alias("a"), F.max(F.struct("chunk", "nth")).alias("b")).where("a <> b").select("group")
    groups = groups.join(several, "group").withColumn("m1", F.col("m1") - F.col("m0") * wide(F.col("first.start")))
    line = Window.partitionBy("n", "m0", "m1", "first.chunk", "first.nth").orderBy("first.start", "group")
    end = F.col("first.start") + F.col("length")
    before = F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("head", F.coalesce(F.col("first.start") > before - LENGTH + 1, F.lit(True)))
    groups = groups.withColumn("nth_of_line", F.sum(F.col("head").cast("int")).over(line))
    joined = groups.groupBy("n", "m0", "m1", F.col("first.chunk").alias("c"), F.col("first.nth").alias("d"), "nth_of_line").agg(F.min_by("group", F.struct("first.start", "group")).alias("group"), (F.max(end) - F.min("first.start")).alias("length"))
    return found.drop("length").join(joined.select("group", "length", F.col("n").alias("occurrences")), "group").select(F.col("group").alias("repeat"), "length", "occurrences", "doc_id", "start")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the repeated bytes taken out of text, and n_bytes, n_removed, n_spans, kept_sha256 added (after prefix)."""
    added = [(prefix + k, StringType() if k == "kept_sha256" else LongType()) for k in ADDED]
    docs = docs.drop(*[k for k, _ in added])
    chunks, members, resolved = _stages(docs, doc_id, text)
    answers = members.join(resolved.drop("occurrences"), "bucket").mapInArrow(worker(_answered, "powers"), "chunk long, data binary")
    answers = answers.groupBy("chunk").agg(F.collect_list("data").alias("answers"))  # bounded by the chunk
    joined = chunks.join(answers, "chunk", "left")
    fields = [StructField(f.name, LongType() if f.name == doc_id else f.dataType) for f in docs.schema.fields] + [StructField(k, t) for k, t in added]
    names = [f.name for f in fields]
    return joined.mapInArrow(worker(lambda b: _kept(b, names, text, prefix), "powers"), StructType(fields))
