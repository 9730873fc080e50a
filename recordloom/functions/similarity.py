"""String similarities. Levenshtein, Jaccard and containment are native; the others are kernels over whole Arrow batches: each
distinct pair of a batch once, all pairs a character at a time, a text's positions as bits of 64-bit words. Scale is 0 to
100 for the ratio family, 0 to 1 for normalised similarities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

ONE, FULL, WORD = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), 64
#: Entries of the table of character positions that a slice of pairs may have: 16 MB.
TABLE = 1 << 21

Texts = "np.ndarray | list[str]"


def _lengths(x: Texts) -> np.ndarray:
    return np.fromiter(map(len, x), np.int64, len(x))


class Pairs:
    """Pairs of texts as two matrices of character numbers (0 behind a text's end), right texts longest first.

    A pair's right text is read character by character; the positions of each character in its left text are bits.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, size: int):
        self.n, self.a, self.b, self.la, self.lb, self.size = len(la), a, b, la, lb, size

    def positions(self) -> list[np.ndarray]:
        """Per word of 64 positions: bits of the left text's places, at pair * size + character."""
        out, base = [], np.arange(self.n) * self.size
        for start in range(0, max(self.a.shape[1], 1), WORD):
            table = np.zeros(self.n * self.size, np.uint64)
            for i in range(start, min(start + WORD, self.a.shape[1])):
                table[base + self.a[:, i]] |= ONE << np.uint64(i - start)
            table[base] = 0  # behind the end
            out.append(table)
        return out

    def steps(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(place, how many pairs reach it, where their right characters are in a table); right texts are longest first."""
        base, live = np.arange(self.n) * self.size, self.n
        for j in range(self.b.shape[1]):
            while self.lb[live - 1] <= j:
                live -= 1
            yield j, live, base[:live] + self.b[:live, j]


def _slices(a: Texts, b: Texts) -> Iterator[tuple[np.ndarray, Pairs]]:
    """The pairs in slices of like lengths whose tables are bounded, longest right texts first in each."""
    la, lb = _lengths(a), _lengths(b)
    flat = np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.zeros(int(flat.max(initial=0)) + 1, bool)
    known[flat] = True
    numbers = np.cumsum(known, dtype=np.int32)
    codes, size = np.append(numbers[flat], np.int32(0)), int(numbers[-1]) + 1
    ends = np.cumsum(np.concatenate([la, lb]))
    begins = ends - np.concatenate([la, lb])

    def matrix(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        place = np.arange(int(lengths.max(initial=0)))
        return np.where(place < lengths[:, None], codes[np.minimum(begins[at][:, None] + place, len(codes) - 1)], 0)

    order = np.lexsort((-lb, -(la // WORD)))
    start = 0
    while start < len(order):
        words = int(la[order[start]]) // WORD + 1
        at = order[start : start + max(1, min(16_384, TABLE // (words * size)))]
        at = at[: int((la[at] // WORD == words - 1).sum())]  # neighbours with as many words
        start += len(at)
        yield at, Pairs(matrix(at, la[at]), matrix(at + len(la), lb[at]), la[at], lb[at], size)


def lcs_lengths(a: Texts, b: Texts) -> np.ndarray:
    """Lengths of the longest common subsequences: bit-parallel rows, a left text's words linked by their carries. The longer text
    goes left where it is one word: fewer steps; else the shorter one: fewer words."""
    out, a, b = np.zeros(len(a), np.int64), np.asarray(a, object), np.asarray(b, object)
    la, lb = _lengths(a), _lengths(b)
    swap = np.where(np.maximum(la, lb) < WORD, la < lb, la > lb)
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    for at, p in _slices(a, b):
        tables = p.positions()
        rows = [np.full(p.n, FULL) for _ in tables]
        for _, live, place in p.steps():
            carry = np.zeros(live, np.uint64)
            for row, table in zip(rows, tables, strict=True):
                r = row[:live]
                hit = r & table[place]
                total = r + hit
                if len(rows) > 1:
                    over = total < hit
                    total += carry
                    over |= total < carry
                row[:live] = total | (r - hit)
                carry = over.astype(np.uint64) if len(rows) > 1 else carry
        for w, row in enumerate(rows):
            inside = _below(p.la - WORD * w)
            out[at] += np.bitwise_count(~row & inside)
    return out


def _below(k: np.ndarray) -> np.ndarray:
    """Words with the lowest k bits set, k cut to 0 and 64."""
    k = np.clip(k, 0, WORD)
    return np.where(k == WORD, FULL, (ONE << np.minimum(k, WORD - 1).astype(np.uint64)) - ONE)


def jaro_winklers(a: Texts, b: Texts) -> np.ndarray:
    """Jaro, raised by up to four equal first characters when over 0.7. Each right character takes the first free equal one of
    the left text inside its reach."""
    out = np.zeros(len(a))
    for at, p in _slices(a, b):
        tables = p.positions()
        used = [np.zeros(p.n, np.uint64) for _ in tables]
        matched = np.zeros(p.b.shape, bool)
        reach = np.maximum(p.la, p.lb) // 2 - 1
        for j, live, place in p.steps():
            free = np.ones(live, bool)
            for w, (own, table) in enumerate(zip(used, tables, strict=True)):
                near = _below(j + reach[:live] + 1 - WORD * w) & ~_below(j - reach[:live] - WORD * w)
                can = np.where(free, table[place] & near & ~own[:live], np.uint64(0))
                first = can & (~can + ONE)
                own[:live] |= first
                free &= first == 0
            matched[:live, j] = ~free
        bits = np.arange(WORD, dtype=np.uint64)
        left = np.concatenate([(u[:, None] >> bits & ONE).astype(bool) for u in used], axis=1)[:, : p.a.shape[1]]
        m = matched.sum(axis=1)
        unlike = p.a[left] != p.b[matched]  # both in order of pairs, then places
        swaps = np.bincount(np.repeat(np.arange(p.n), m), unlike, p.n) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(m > 0, (m / p.la + m / p.lb + (m - swaps) / m) / 3, 0.0)
        wide = min(p.a.shape[1], p.b.shape[1])
        score[(p.la == p.lb) & (p.a[:, :wide] == p.b[:, :wide]).all(axis=1)] = 1.0
        n = min(4, p.a.shape[1], p.b.shape[1])
        equal = (p.a[:, :n] == p.b[:, :n]) & (p.a[:, :n] > 0)
        same = np.logical_and.accumulate(equal, axis=1).sum(axis=1)
        out[at] = np.where(score > 0.7, score + 0.1 * same * (1 - score), score)
    return out


def osa_distances(a: Texts, b: Texts) -> np.ndarray:
    """Edits with swaps of neighbours, no substring edited twice: vertical differences as bits (Hyyro's recurrences)."""
    out = np.zeros(len(a), np.int64)
    for at, p in _slices(a, b):
        if p.a.shape[1] > WORD:
            out[at] = _osa_rows(p)
            continue
        (table,) = p.positions()
        up, down, diagonal, before = np.full(p.n, FULL), np.zeros(p.n, np.uint64), np.zeros(p.n, np.uint64), np.zeros(p.n, np.uint64)
        last = ONE << np.maximum(p.la - 1, 0).astype(np.uint64)
        far = p.la.copy()
        for _, live, place in p.steps():
            hit, vp, vn = table[place], up[:live], down[:live]
            swap = ((~diagonal[:live] & hit) << ONE) & before[:live]
            d = (((hit & vp) + vp) ^ vp) | hit | vn | swap
            hp, hn = vn | ~(d | vp), d & vp
            far[:live] += ((hp & last[:live]) != 0).astype(np.int64) - ((hn & last[:live]) != 0)
            hp, hn = hp << ONE | ONE, hn << ONE
            up[:live], down[:live], diagonal[:live], before[:live] = hn | ~(d | hp), hp & d, d, hit
        out[at] = np.where(p.la == 0, p.lb, far)
    return out


def _osa_rows(p: Pairs) -> np.ndarray:
    """The same for left texts over 64 characters, cell by cell for all pairs at once."""
    before, last = None, np.tile(np.arange(p.b.shape[1] + 1), (p.n, 1)).T
    out = np.where(p.la == 0, p.lb, 0)
    for i in range(1, p.a.shape[1] + 1):
        row = np.empty_like(last)
        row[0] = i
        for j in range(1, p.b.shape[1] + 1):
            cost = np.minimum(np.minimum(last[j], row[j - 1]) + 1, last[j - 1] + (p.a[:, i - 1] != p.b[:, j - 1]))
            if i > 1 and j > 1:
                swapped = (p.a[:, i - 1] == p.b[:, j - 2]) & (p.a[:, i - 2] == p.b[:, j - 1])
                cost = np.where(swapped, np.minimum(cost, before[j - 2] + 1), cost)
            row[j] = cost
        before, last = last, row
        done = p.la == i
        out[done] = last[p.lb[done], np.flatnonzero(done)]
    return out


def _share(common: np.ndarray, total: np.ndarray, scale: float, empty: float) -> np.ndarray:
    return np.where(total > 0, scale * common / np.maximum(total, 1), empty)


def ratios(a: Texts, b: Texts) -> np.ndarray:
    """Normalised insert/delete similarity."""
    return _share(lcs_lengths(a, b), _lengths(a) + _lengths(b), 200.0, 100.0)


def _sorted_tokens(x: Texts) -> list[str]:
    return [" ".join(sorted(t.split())) for t in x]


def token_sort_ratios(a: Texts, b: Texts) -> np.ndarray:
    return ratios(_sorted_tokens(a), _sorted_tokens(b))


def token_set_ratios(a: Texts, b: Texts) -> np.ndarray:
    """Common tokens against each side's, and the sides against each other: the best. The common tokens begin both sides, so that
    their ratio to a side follows from the lengths."""
    out = np.zeros(len(a))
    left, right, core, where = [], [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = set(x.split()), set(y.split())
        if not x or not y:
            continue
        if (x & y) and (x <= y or y <= x):
            out[i] = 100.0
            continue
        both = sorted(x & y)
        left.append(" ".join([*both, *sorted(x - y)]))
        right.append(" ".join([*both, *sorted(y - x)]))
        core.append(len(" ".join(both)))
        where.append(i)
    if where:
        n, la, lb = np.array(core), _lengths(left), _lengths(right)
        best = ratios(left, right)
        best = np.maximum(best, np.where(n > 0, np.maximum(200.0 * n / (n + la), 200.0 * n / (n + lb)), 0.0))
        out[where] = best
    return out


def partial_ratios(a: Texts, b: Texts) -> np.ndarray:
    """Best ratio of the shorter text against any window of the longer, windows cut at its ends included. Whole windows first;
    cut ones only where their length still lets them win."""
    a, b = np.asarray(a, object), np.asarray(b, object)
    swap = _lengths(a) > _lengths(b)
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    n, m = _lengths(short), _lengths(long)
    out = np.where((n == 0) & (m == 0), 100.0, 0.0)
    inside = np.flatnonzero([s != "" and s in t for s, t in zip(short, long, strict=True)]).astype(np.int64)
    out[inside] = 100.0

    def tried(pair: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        for k in range(0, len(pair), 100_000):
            own, windows = pair[k : k + 100_000], [long[i][x:y] for i, x, y in zip(pair[k : k + 100_000], begin[k : k + 100_000], end[k : k + 100_000], strict=True)]
            useful = np.flatnonzero([w[0] in short[i] or w[-1] in short[i] for i, w in zip(own, windows, strict=True)]).astype(np.int64)
            own, windows = own[useful], [windows[x] for x in useful]
            np.maximum.at(out, own, ratios(short[own], windows))

    todo = np.flatnonzero((n > 0) & (out < 100))
    count = (m - n + 1)[todo]
    pair = np.repeat(todo, count)
    begin = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    tried(pair, begin, begin + n[pair])
    count = (n - 1)[todo]
    pair = np.repeat(todo, count)
    size = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + 1  # of a cut window
    wins = 200.0 * size / (n[pair] + size) > out[pair]
    pair, size = pair[wins], size[wins]
    tried(np.concatenate([pair, pair]), np.concatenate([np.zeros_like(size), m[pair] - size]), np.concatenate([size, m[pair]]))
    return out


def partial_token_set_ratios(a: Texts, b: Texts) -> np.ndarray:
    out, left, right, where = np.zeros(len(a)), [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = set(x.split()), set(y.split())
        if x & y:
            out[i] = 100.0
        elif x and y:
            left.append(" ".join(sorted(x)))
            right.append(" ".join(sorted(y)))
            where.append(i)
    if where:
        out[where] = partial_ratios(left, right)
    return out


def weighted_ratios(a: Texts, b: Texts) -> np.ndarray:
    """Best of the ratios, those on tokens and on parts taken down by how unlike the lengths are."""
    a, b = np.asarray(a, object), np.asarray(b, object)
    la, lb = _lengths(a), _lengths(b)
    out, some = np.zeros(len(a)), (la > 0) & (lb > 0)
    spread = np.maximum(la, lb) / np.maximum(np.minimum(la, lb), 1)
    for where, close in ((np.flatnonzero(some & (spread < 1.5)), True), (np.flatnonzero(some & (spread >= 1.5)), False)):
        if not len(where):
            continue
        x, y = a[where], b[where]
        base = ratios(x, y)
        if close:
            out[where] = np.maximum(base, 0.95 * np.maximum(token_sort_ratios(x, y), token_set_ratios(x, y)))
        else:
            part = np.where(spread[where] <= 8, 0.9, 0.6)
            tokens = np.maximum(partial_ratios(_sorted_tokens(x), _sorted_tokens(y)), partial_token_set_ratios(x, y))
            out[where] = np.maximum(base, np.maximum(part * partial_ratios(x, y), 0.95 * part * tokens))
    return out


def osa_similarities(a: Texts, b: Texts) -> np.ndarray:
    longest = np.maximum(_lengths(a), _lengths(b))
    return np.where(longest > 0, 1 - osa_distances(a, b) / np.maximum(longest, 1), 1.0)


def lcs_similarities(a: Texts, b: Texts) -> np.ndarray:
    return _share(lcs_lengths(a, b), np.maximum(_lengths(a), _lengths(b)), 1.0, 1.0)


#: name -> function of two lists of texts.
KERNELS: dict[str, Callable] = {
    "ratio": ratios, "token_sort_ratio": token_sort_ratios, "token_set_ratio": token_set_ratios, "partial_ratio": partial_ratios, "partial_token_set_ratio": partial_token_set_ratios,
    "weighted_ratio": weighted_ratios, "jaro_winkler": jaro_winklers, "osa_similarity": osa_similarities, "lcs_similarity": lcs_similarities,
}


def _distinct(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a batch, and each row's place among them."""
    (ca, ua), (cb, ub) = pd.factorize(a.fillna("")), pd.factorize(b.fillna(""))
    pairs, place = np.unique(ca.astype(np.int64) * max(1, len(ub)) + cb, return_inverse=True)
    n = max(1, len(ub))
    return np.asarray(ua, object)[pairs // n], np.asarray(ub, object)[pairs % n], place


def several(*names: str) -> Callable[[Column, Column], Column]:
    """A struct of several similarities of two columns: one pass over the batch's distinct pairs."""

    @F.pandas_udf(StructType([StructField(k, DoubleType()) for k in names]))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y, place = _distinct(a, b)
        return pd.DataFrame({k: KERNELS[k](x, y)[place] if len(x) else np.zeros(0) for k in names})

    return lambda x, y: run(x, y)


def _pairwise(kernel):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y, place = _distinct(a, b)
        return pd.Series(kernel(x, y)[place] if len(x) else np.zeros(0), dtype="float64")

    run.__name__ = kernel.__name__
    return lambda x, y: run(x, y)


#: name -> function of two columns; nulls count as empty.
SCORERS = {k: _pairwise(f) for k, f in KERNELS.items()}


def gated(scorer, a: Column, b: Column) -> Column:
    """A similarity that is 0 where either side is empty."""
    return F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), scorer(a, b)).otherwise(0.0)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two token arrays; `empty` where either has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def contains_either(a: Column, b: Column) -> Column:
    return (F.coalesce(a != "", F.lit(False)) & F.coalesce(b != "", F.lit(False)) & (a.contains(b) | b.contains(a))).cast("double")
