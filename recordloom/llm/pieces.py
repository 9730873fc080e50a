"""Encoding with a SentencePiece BPE model under seeded merge-dropout, and decoding.

Text is cut before every run of word marks, and between letters and other characters (no piece of such a model joins
them, which ``Model`` checks), so units are segmented alone. Inside a unit an agenda holds candidate merges by (score, place). A popped
candidate is skipped, for good, when a hash keyed by (seed, document, place of the unit in the text, how many candidates
of the unit came before it) falls under the dropout rate; otherwise its two symbols become one and new neighbours enter
the agenda. So every occurrence of a word has decisions of its own, repeatably. Dropout 0 gives the library's own segmentation.
Characters without a piece are written as bytes, and so is a literal word mark: decoding is lossless for every text.

A document is known by its text's hash, ``variant``. Cuts are remembered by unit and set of skipped candidates, whatever
the occurrence; those not yet known are made together, as rows of a matrix. ``_by_heap`` is the same agenda for one unit:
it serves very long units and rare characters, and tests hold both against a plain list.

Defined results: null or empty text has no pieces; rows of equal text are encoded alike; very long texts are handled unit by
unit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
DROPOUT = 0.1
SEED = 17
#: Cuts remembered by a worker, about 250 bytes each.
MEMORY = 600_000
#: Letters, without the superscripts and fractions that count as word characters.
_LETTER = re.compile(r"[^\W\d_²³¹¼-¾]")
#: Spaces and what follows: a run of letters or of anything else.
_UNITS = re.compile(r" *[^\W\d_²³¹¼-¾]+| *(?:(?! )[\W\d_²³¹¼-¾])+| +")
#: The same cut, faster, for texts of these characters alone.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LATIN}]*")
_PLAIN_UNITS = re.compile(rf" *[{_LATIN}]+| *[^ {_LATIN}]+| +")


class Model:
    """Pieces and scores of a SentencePiece BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if self.library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        plain = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        score = {self.pieces[i]: self.library.get_score(i) for i in plain}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in score.items()}
        if any("\0" in p for p in self.ids):
            raise ValueError("a piece holds the character that sets literal marks apart")
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback, so decoding would lose text")
        joined = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False) if a != MARK}
        if any(b == MARK or bool(_LETTER.match(a)) != bool(_LETTER.match(b)) for a, b in joined):
            raise ValueError("a piece joins letters to other characters or to a later mark: units can't be segmented alone")


_models: dict[str, Model] = {}


def model_at(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Units above this length are segmented one by one with a heap; shorter ones together, as rows of a matrix.
HEAP_FROM = 64
#: Candidates decided by one word of hash bits.
WIDTH = 32
#: Units handled together.
BATCH = 1 << 17


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return h ^ h >> np.uint32(16)


def skips(keys: np.ndarray, places: np.ndarray, words: np.ndarray, dropout: float) -> np.ndarray:
    """32 decisions for each (key of a document, place of a unit, number of a word), broadcast: bit i is set, with the dropout
    rate, where the candidate number 32 * word + i of that unit is skipped. The rate counts in steps of 2^-16."""
    limit = round(dropout * 65536)
    keys, places, words = (np.asarray(x).astype(np.uint32) for x in (keys, places, words))
    out = np.full(np.broadcast_shapes(keys.shape, places.shape, words.shape), 0xFFFFFFFF if limit > 65535 else 0, np.uint32)
    if not 0 < limit < 65536:
        return out
    own = _mix(_mix(keys + places * np.uint32(0x9E3779B1)) + words * np.uint32(0x85EBCA77))
    for k in range((limit & -limit).bit_length() - 1, 16):  # the rate's binary digits from the lowest set one on
        bits = _mix(own + np.uint32((k + 1) * 0xC2B2AE3D & 0xFFFFFFFF))
        out = out | bits if limit >> k & 1 else out & bits
    return out


def segment(unit: str, model: Model, skipped: int) -> tuple[list[int], int]:
    """Ids of one unit and the number of its candidates, those at the set bits of skipped left out. unit has its spaces as
    spaces; a literal mark stays apart and becomes bytes."""
    if MARK in unit:
        symbols = [MARK if c == " " else "\0" + MARK if c == MARK else c for c in unit]
    else:
        symbols = list(unit.replace(" ", MARK))
    symbols, steps = _by_heap(symbols, model.rank.get, skipped)
    out = list(map(model.ids.get, symbols))
    if None not in out:
        return out, steps
    out = []
    for s in symbols:
        known = model.ids.get(s)
        if known is None:
            out += [model.bytes[b] for b in s.removeprefix("\0" if s == "\0" + MARK else "").encode("utf-8", "replace")]
        else:
            out.append(known)
    return out, steps


def _by_heap(symbols: list[str | None], rank, skipped: int) -> tuple[list[str], int]:
    """The agenda is a heap of (rank, place); places are those of the first symbols."""
    n, step = len(symbols), 0
    skip = bin(skipped)[:1:-1]  # one character a candidate: shifts of a long integer would grow with the square
    right, left = [*range(1, n), -1], list(range(-1, n - 1))
    shift = max(1, n.bit_length())  # a place fits in the low bits of an entry, however long the unit is
    now = [rank(symbols[i] + symbols[i + 1]) for i in range(n - 1)] + [None]  # the candidate at each place
    agenda = [r << shift | i for i, r in enumerate(now) if r is not None]
    heapq.heapify(agenda)

    def consider(i: int, piece: str) -> None:
        now[i] = r = rank(piece)
        if r is not None:
            heapq.heappush(agenda, r << shift | i)

    while agenda:
        entry = heapq.heappop(agenda)
        r, i = entry >> shift, entry & (1 << shift) - 1
        if now[i] != r:
            continue
        now[i], step = None, step + 1
        if skip[step - 1 : step] == "1":
            continue
        j = right[i]
        symbols[i], symbols[j], now[j], k = symbols[i] + symbols[j], None, None, right[j]
        right[i] = k
        if k >= 0:
            left[k] = i
            consider(i, symbols[i] + symbols[k])
        if (h := left[i]) >= 0:
            consider(h, symbols[h] + symbols[i])
    return [s for s in symbols if s is not None], step


class Merges:
    """Which two pieces make a third: a hash table over packed pairs of ids, looked up for whole arrays."""

    NONE = np.iinfo(np.int32).max
    EDGE = 0xFFFF  # stands beside the first and the last symbol, and where a symbol has gone
    BITS = 20

    def __init__(self, model: Model):
        found = [(a << 16 | b, model.rank[p], i) for p, i in model.ids.items() for k in range(1, len(p)) if (a := model.ids.get(p[:k])) is not None and (b := model.ids.get(p[k:])) is not None]
        keys, rank, made = (np.array(x, np.uint64) for x in (zip(*found, strict=True) if found else ([], [], [])))
        order = np.argsort(self._slot(keys), kind="stable")
        self.keys, slot = keys[order], self._slot(keys)[order]
        self.first = np.searchsorted(slot, np.arange((1 << self.BITS) + 1)).astype(np.int32)
        # the last entry stands for pairs that make nothing
        self.rank, self.made = np.append(rank[order], self.NONE).astype(np.int32), np.append(made[order], self.EDGE).astype(np.int32)
        self.letters = np.full(0x250, -1, np.int32)  # ids of single characters; any other goes unit by unit
        for c in range(0x250):
            self.letters[c] = model.ids.get(MARK if c == 32 else chr(c), -1)
        if len(model.pieces) >= self.EDGE:
            raise ValueError("ids are packed in 16 bits")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entries of the pairs; the last one for those that make nothing."""
        key = a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)
        slot = self._slot(key)
        at, stop = self.first[slot], self.first[slot + 1]
        out = np.full(len(key), len(self.keys), np.int32)
        left = np.flatnonzero(at < stop)
        while len(left):
            here = at[left]
            hit = self.keys[here] == key[left]
            out[left[hit]] = here[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out

    def segment(self, symbols: np.ndarray, lengths: np.ndarray, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Many units at once, each a row of lengths[k] symbols; skipped: (units, words) of decisions. Each row's agenda is the
        ranks of its neighbours' merges, of which the least is next, the leftmost of equals: one candidate of every row at a
        time. Returns all ids, one unit after the other, the number of each unit's ids, and that of its candidates."""
        n, size = len(lengths), int(lengths.max(initial=0))
        width = size + 2
        ids, steps = np.full((n, size), self.EDGE, np.uint16), np.zeros(n, np.int32)
        sym = np.full((n, width), self.EDGE, np.int32)
        inside = np.arange(size) < lengths[:, None]
        sym[:, 1:-1][inside] = symbols
        pair = np.full((n, width), len(self.keys), np.int32)
        pair[:, 1:-2] = self.find(sym[:, 1:-2].ravel(), sym[:, 2:-1].ravel()).reshape(n, -1)
        rank = self.rank[pair]
        place = np.arange(width, dtype=np.int32)
        right = np.broadcast_to(np.minimum(place + 1, width - 1), (n, width)).copy()
        left = np.broadcast_to(np.maximum(place - 1, 0), (n, width)).copy()
        rows, step = np.arange(n), 0
        while len(rows):
            # flat views of the rows that still have candidates
            s, p, r, after, before = (x.reshape(-1) for x in (sym, pair, rank, right, left))
            base = np.arange(len(rows)) * width
            while True:
                at = base + rank.argmin(axis=1)
                on = np.flatnonzero(r[at] != self.NONE)
                if 4 * len(on) < 3 * len(rows):
                    break
                steps[rows[on]] += 1
                word = step // WIDTH
                skip = (skipped[rows[on], word] >> np.uint32(step % WIDTH) & np.uint32(1)).astype(bool) if word < skipped.shape[1] else np.zeros(len(on), bool)
                step += 1
                at = at[on]
                r[at[skip]] = self.NONE
                i, row = at[~skip], base[on[~skip]]
                j = row + after[i]
                k = row + after[j]
                made = self.made[p[i]]
                s[i], s[j] = made, self.EDGE
                after[i], before[k], r[j] = k - row, i - row, self.NONE
                h = row + before[i]
                both = self.find(np.concatenate([made, s[h]]), np.concatenate([s[k], made]))
                p[i], p[h] = both[: len(i)], both[len(i) :]
                r[i], r[h] = self.rank[p[i]], self.rank[p[h]]
            done = np.ones(len(rows), bool)
            done[on] = False
            ids[rows[done]] = sym[done, 1:-1]
            rows = rows[on]
            sym, pair, rank, right, left = (x[on] for x in (sym, pair, rank, right, left))
        kept = ids != self.EDGE
        return ids[kept], kept.sum(axis=1), steps


class Pieces:
    """Cuts that have come up, for one (dropout, seed), as an automaton: a unit's first cut is the one without skips, and from
    a cut the bit of its first skipped candidate leads to the cut with that candidate left out.

    A cut has its ids, and the candidates after its last skipped one as bits: it holds for an occurrence none of whose
    decisions skips one of those. A cut with more candidates than one word decides is made anew for every occurrence.
    """

    def __init__(self, model: Model, dropout: float, seed: int):
        self.model, self.dropout, self.seed, self.merges = model, dropout, seed, Merges(model)
        self._start_anew()

    def _start_anew(self) -> None:
        self.of: dict[str, int] = {}
        self.units: list[str] = []  # by cut
        self.n, self.used = 0, 0
        self.ids = np.zeros(1 << 16, np.uint16)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.open, self.skipped = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.long, self.next = np.zeros(0, bool), np.zeros((0, WIDTH), np.int32)

    def _cut_all(self, units: list[str], skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where each unit's begin, their numbers and those of candidates; skipped: (units, words)."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.merges.letters[np.minimum(codes, len(self.merges.letters) - 1)]
        symbols[codes >= len(self.merges.letters)] = -1
        owner = np.repeat(np.arange(len(units)), lengths)
        alone = lengths > HEAP_FROM
        alone[owner[symbols < 0]] = True
        begin, size, steps = (np.zeros(len(units), np.int64) for _ in range(3))
        parts, used = [np.zeros(0, np.uint16)], 0
        for low, high in ((0, 6), (6, 10), (10, 15), (15, 24), (24, 40), (40, HEAP_FROM)):
            mine = ~alone & (lengths > low) & (lengths <= high)
            rows = np.flatnonzero(mine)
            if len(rows):
                found, size[rows], steps[rows] = self.merges.segment(symbols[mine[owner]], lengths[rows], skipped[rows])
                begin[rows] = used + np.cumsum(size[rows]) - size[rows]
                parts.append(found)
                used += len(found)
        for k in np.flatnonzero(alone).tolist():
            ids, steps[k] = segment(units[k], self.model, int.from_bytes(skipped[k].astype("<u4").tobytes(), "little"))
            parts.append(np.array(ids, np.uint16))
            begin[k], size[k] = used, len(ids)
            used += len(ids)
        return np.concatenate(parts), begin, size, steps

    def _learn(self, units: list[str], skipped: np.ndarray) -> np.ndarray:
        """Numbers of the new cuts of these units, made with exactly these candidates left out."""
        ids, begin, size, steps = self._cut_all(units, skipped[:, None])
        first, self.n = self.n, self.n + len(units)
        grow = lambda x, n: x if len(x) >= n else np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), x.dtype)])
        self.ids = grow(self.ids, self.used + len(ids))
        self.begin, self.size, self.open, self.skipped, self.long, self.next = (grow(x, self.n) for x in (self.begin, self.size, self.open, self.skipped, self.long, self.next))
        new = slice(first, self.n)
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[new], self.size[new] = self.used + begin, size
        self.used += len(ids)
        last = np.frexp(skipped.astype(np.float64))[1]  # bits up to the last skipped candidate
        every = (np.uint64(1) << np.minimum(steps, WIDTH).astype(np.uint64)) - np.uint64(1)
        self.open[new] = (every >> last.astype(np.uint64) << last.astype(np.uint64)).astype(np.uint32)
        self.skipped[new], self.long[new], self.next[new] = skipped, steps > WIDTH, -1
        self.units += units
        return np.arange(first, self.n)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        held: list[list[str]] = []
        keys, total = [], 0
        for text in texts:
            held.append((_PLAIN_UNITS if _PLAIN.fullmatch(text) else _UNITS).findall(" " + text) if text else [])
            keys.append(variant(text, self.seed))
            total += len(held[-1])
            if total >= BATCH:
                out += self._encode(held, keys)
                held, keys, total = [], [], 0
        return out + (self._encode(held, keys) if held else [])

    def _encode(self, held: list[list[str]], keys: list[int]) -> list[np.ndarray]:
        if self.n > MEMORY:
            self._start_anew()
        counts = np.fromiter(map(len, held), np.int64, len(held))
        units = [u for own in held for u in own]
        key = np.repeat(np.array(keys, np.uint32), counts)
        place = np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts, counts)
        bits = skips(key, place, 0, self.dropout)
        cut = np.fromiter(map(self.of.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(cut < 0).tolist()
        if missing:
            unknown = list(dict.fromkeys(units[k] for k in missing))
            self.of |= zip(unknown, self._learn(unknown, np.zeros(len(unknown), np.uint32)).tolist(), strict=True)
            cut[missing] = [self.of[units[k]] for k in missing]
        moving = np.arange(len(units))
        while len(moving):
            moving = moving[~self.long[cut[moving]]]
            left = bits[moving] & self.open[cut[moving]]
            moving, left = moving[left > 0], left[left > 0]
            bit = np.frexp((left & (~left + np.uint32(1))).astype(np.float64))[1] - 1  # the first one
            to = self.next[cut[moving], bit]
            wanted = np.unique(cut[moving][to < 0] * WIDTH + bit[to < 0])
            if len(wanted):
                was, which = wanted // WIDTH, wanted % WIDTH
                made = self._learn([self.units[k] for k in was.tolist()], self.skipped[was] | np.uint32(1) << which.astype(np.uint32))
                self.next[was, which] = made
                to = self.next[cut[moving], bit]
            cut[moving] = to
        long = np.flatnonzero(self.long[cut])
        size, begin = self.size[cut].astype(np.int64), self.begin[cut]
        ids = self.ids
        if len(long):  # each merge makes two new candidates at most, so there are less than three for each character
            own = [units[k] for k in long.tolist()]
            words = 3 * max(map(len, own)) // WIDTH + 1
            step, parts, used = max(1, (1 << 22) // words), [ids[: self.used]], self.used
            for a in range(0, len(own), step):
                at = long[a : a + step]
                found, first, size[at], _ = self._cut_all(own[a : a + step], skips(key[at, None], place[at, None], np.arange(words), self.dropout))
                begin[at] = used + first
                parts.append(found)
                used += len(found)
            ids = np.concatenate(parts)
        ends = np.cumsum(size)
        flat = ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        stops = np.append(0, ends)[np.cumsum(counts)]
        return np.split(flat, stops[:-1])


def variant(text: str, seed: int = SEED) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"), seed)


def decode(ids: np.ndarray, model: Model) -> str:
    """The text: pieces joined, bytes decoded, marks back to spaces, without the leading one."""
    out = bytearray()
    for i in ids.tolist():
        out += bytes([model.byte_of[i]]) if i in model.byte_of else model.pieces[i].replace(MARK, " ").encode()
    return out[1:].decode("utf-8", "replace")


class Decoder(list):
    """id -> bytes, for joins in one call."""

    def __init__(self, model: Model):
        super().__init__(bytes([model.byte_of[i]]) if i in model.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(model.pieces))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, variant, n_pieces, ids (packed 16-bit), lossless: whether the decoded ids give the text again."""
    where = path or default_path()

    def encoded(batches):
        model = model_at(where)
        decoder = Decoder(model)
        table = Pieces(model, dropout, seed)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch["text"]]
            out = []
            for doc, text, ids in zip(batch["doc_id"].to_pylist(), texts, table.encode_all(texts), strict=True):
                out.append((doc, variant(text, seed) - (1 << 31), len(ids), ids.astype("<u2").tobytes(), decoder.decode(ids) == text))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["doc_id", "variant", "n_pieces", "ids", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encoded, "doc_id long, variant int, n_pieces long, ids binary, lossless boolean")
