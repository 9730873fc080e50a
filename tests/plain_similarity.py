"""Plain versions of the similarity kernels, a pair at a time."""


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows (one big integer per row)."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised insert/delete similarity."""
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    core = " ".join(both)
    left, right = " ".join([*both, *only_x]), " ".join([*both, *only_y])
    best = ratio(left, right) if both else ratio(" ".join(only_x), " ".join(only_y))
    return max(best, ratio(core, left), ratio(core, right)) if both else best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against any window of the longer, windows cut at its ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, best = len(short), 0.0
    for i in range(1 - n, len(long)):
        window = long[max(0, i) : i + n]
        if 200.0 * min(n, len(window)) / (n + len(window)) > best and (window[-1] in short or window[0] in short):
            best = max(best, ratio(short, window))
            if best == 100.0:
                break
    return best


def partial_token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    return 100.0 if x & y else partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))


def weighted_ratio(a: str, b: str) -> float:
    """Best of the ratios, those on tokens and on parts taken down by how unlike the lengths are."""
    if not a or not b:
        return 0.0
    base, spread = ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(base, 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    part = 0.9 if spread <= 8 else 0.6
    tokens = max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_token_set_ratio(a, b))
    return max(base, part * partial_ratio(a, b), 0.95 * part * tokens)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by up to four equal first characters when over 0.7."""
    score, same = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return score + 0.1 * same * (1 - score) if score > 0.7 else score


def osa_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours, no substring edited twice."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def osa_similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1 - osa_distance(a, b) / longest if longest else 1.0


def lcs_similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return lcs_length(a, b) / longest if longest else 1.0


KERNELS = {k.__name__: k for k in (ratio, token_sort_ratio, token_set_ratio, partial_ratio, partial_token_set_ratio, weighted_ratio, jaro_winkler, osa_similarity, lcs_similarity)}
