"""Plain versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def token_ids(text, tokenizer):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def repeats(docs):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)}; docs: [(doc_id, text)] with distinct ids."""
    first, out = {}, {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        own = [b[i : i + 50] for i in range(len(b) - 49)]
        for i, w in enumerate(own):
            if first.get(w, d) < d:
                gone[i : i + 50] = True
        for w in own:
            first.setdefault(w, d)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[d] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def window_places(docs):
    """{50-byte string: its places (doc, start)}"""
    at = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            at.setdefault(b[i : i + 50], set()).add((d, i))
    return at


def unbranched_repeats(docs):
    """{(string, its places)} of the repeats of two or more documents whose every window has the same places but for the
    shift, as long as they can be made."""
    texts, at = {d: (t or "").encode() for d, t in docs}, window_places(docs)
    moved = lambda places, k: frozenset((d, i + k) for d, i in places)
    out = set()
    for places in at.values():
        if len({d for d, _ in places}) < 2:
            continue
        d, i = min(places)
        first, last = i, i
        while first > 0 and moved(at[texts[d][first - 1 : first + 49]], i - first + 1) == moved(places, 0):
            first -= 1
        while last + 51 <= len(texts[d]) and moved(at[texts[d][last + 1 : last + 51]], i - last - 1) == moved(places, 0):
            last += 1
        out.add((texts[d][first : last + 50], moved(places, first - i)))
    return out


def shingle_set(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(docs):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {d: shingle_set(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {}
    for ids in by.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), n in pairs.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    t = text or ""
    words = WORD.findall(t)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)
