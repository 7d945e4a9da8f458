"""Brute-force versions of the training-data operators, written without Spark."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import numpy as np
import regex
import xxhash

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return regex.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text: str | None, k: int = 4) -> int:
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows: list[tuple[int, str | None]], bits: int = 4) -> dict[int, tuple[str, int]]:
    fp = {i: simhash(t) for i, t in rows}
    ids = sorted(fp)
    values = np.array([fp[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return {d: (f"{fp[d]:016x}", ids[find(k)]) for k, d in enumerate(ids)}


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def line_dedup(rows: list[tuple[int, str | None]], limit: int = 10) -> dict[int, tuple[int, int, str]]:
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for n, (_, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            docs[key(x)].add(n)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(docs[key(x)]) < limit]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def substring_dedup(rows: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple[int, int, list[str]]]:
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = WORD.findall(t or "")
        gone = set()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone.update(range(k, k + window))
            seen.add(w)
        kept = [x for k, x in enumerate(words) if k not in gone]
        out[i] = (len(words), len(gone), kept)
    return out


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


MEASURES = ("symbols", "dup_lines", "repeats", "capitals", "marks")
CUTOFFS = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)


def tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k) in exact fractions."""
    q = Fraction(p)
    return float(sum(comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k + 1)))


def quality_values(text: str | None) -> tuple[bool, list[float]]:
    """Whether the base rules fail, and the measures."""
    n_words, chars, symbols, dup_lines, repeats = base_counts(text)
    lines = sum(1 for x in (text or "").split("\n") if WORD.search(x))
    capitals, marks = (sum(c in kind for c in text or "") for kind in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?"))
    pairs = ((symbols, chars), (dup_lines, lines), (repeats, n_words), (capitals, chars), (marks, chars))
    return n_words < 10 or 100 * repeats > 20 * n_words, [a / max(1, b) for a, b in pairs]


def quality_kept(rows: list[tuple[int, str | None, str | None]], labels: dict[int, bool], alpha: float = 0.02, delta: float = 0.05) -> tuple[dict[int, bool], dict[str, dict[int, float]]]:
    """The verdict on each (doc_id, text, stratum) and the cutoffs of each stratum."""
    values = {i: quality_values(t) for i, t, _ in rows}
    strata = defaultdict(list)
    for i, _, s in rows:
        if i in labels and not values[i][0]:
            strata[s or ""].append(i)
    votes = {}
    for s, ids in strata.items():
        votes[s] = Counter()
        for i in ids:
            levels = [sum(x > c for c in CUTOFFS) for x in values[i][1]]
            if not labels[i] and max(levels):
                votes[s][levels.index(max(levels))] += 1
    total, cutoffs = sum(sum(v.values()) for v in votes.values()), {}
    for s, ids in strata.items():
        good, bad = [values[i][1] for i in ids if labels[i]], [values[i][1] for i in ids if not labels[i]]
        cutoffs[s] = {}
        for m, n in votes[s].items():
            a, d, best = alpha * n / sum(votes[s].values()), delta * n / total, 0
            for c in reversed(CUTOFFS):  # from the loosest on
                k = sum(x[m] > c for x in good)
                if not good or k >= len(good) * a or tail(k, len(good), a) > d:
                    break
                if (caught := sum(x[m] > c for x in bad)) > best:
                    best, cutoffs[s][m] = caught, c
    return {i: not values[i][0] and all(values[i][1][m] <= c for m, c in cutoffs.get(s or "", {}).items()) for i, _, s in rows}, cutoffs
