"""The operators again, slow and plain, to hold the fast ones against."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


# ------------------------------------------------------------- sliding sentence spans

def pieces(text: str) -> list[str]:
    return re.findall(r"[^.!?\n]*[.!?\n][.!?\n \t\r]*|[^.!?\n]+", text)


def dedup_spans(docs: list[tuple[int, str]]) -> dict[int, tuple[str, int]]:
    """docs (doc_id, text) of distinct ids -> (text, pieces removed)."""
    first: dict[tuple, tuple[int, int]] = {}
    spans = []
    for i, text in docs:
        sent = [(k, tuple(words(p))) for k, p in enumerate(pieces(text)) if words(p)]
        for at in range(len(sent)):
            if len(sent[at][1]) >= 25:
                run = sent[at : at + 1]
            else:
                run = next((sent[at : at + m] for m in (2, 3, 4) if at + m <= len(sent) and (m == 4 or sum(len(x[1]) for x in sent[at : at + m]) >= 12)), None)
            if run:
                key = tuple(x[1] for x in run)
                spans.append((key, i, run[0][0], run[-1][0]))
                first[key] = min(first.get(key, (i, run[0][0])), (i, run[0][0]))
    gone = defaultdict(set)
    for key, i, a, b in spans:
        if first[key] != (i, a):
            gone[i] |= set(range(a, b + 1))
    return {i: ("".join(p for k, p in enumerate(pieces(text)) if k not in gone[i]), len(gone[i])) for i, text in docs}


# ------------------------------------------------------------- near duplicates

def shingles(text: str | None) -> set:
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


def near_pairs(docs: list[tuple[int, str]], least: float = 0.5) -> set[tuple[int, int]]:
    sets = [(i, shingles(t)) for i, t in docs]
    out = set()
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            both = len(a & b)
            if both and both / (len(a) + len(b) - both) >= least:
                out.add((min(i, j), max(i, j)))
    return out


def roots(pairs: set[tuple[int, int]]) -> dict[int, int]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in list(up)}


# ------------------------------------------------------------- leaks

def align(a: list, b: list) -> int:
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = max(0, m[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), m[i - 1][j] - 1, m[i][j - 1] - 1)
            best = max(best, m[i][j])
    return best


def leaks(docs: list[tuple[int, str]], items: list[tuple[int, str]], least: float = 0.5) -> dict[tuple[int, int], float]:
    out = {}
    for i, t in docs:
        for j, q in items:
            if words(q):
                s = align(words(q), words(t)) / (2 * len(words(q)))
                if s >= least:
                    out[i, j] = s
    return out


# ------------------------------------------------------------- modified Kneser-Ney

class KneserNey:
    def __init__(self, texts: list[str], order: int = 5):
        self.order = order
        self.n: dict[int, Counter] = {order: Counter(g for t in texts for g in self.grams(t, order))}
        for k in range(order - 1, 0, -1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.off, self.total, self.left = {}, {}, {}
        for k, n in self.n.items():
            c = Counter(n.values())
            y = c[1] / (c[1] + 2 * c[2]) if c[1] + c[2] else 0.5
            d = [max(0.05, min(j - 0.05, j - (j + 1) * y * c[j + 1] / c[j])) if c[j] and c[j + 1] else j * 0.5 for j in (1, 2, 3)]
            self.total[k], self.left[k] = Counter(), Counter()
            for g, v in n.items():
                self.total[k][g[:-1]] += v
                self.left[k][g[:-1]] += d[min(v, 3) - 1]
            self.off[k] = d

    @staticmethod
    def grams(text: str, k: int) -> list[bytes]:
        raw = bytes(k - 1) + text.encode()
        return [raw[j : j + k] for j in range(len(raw) - k + 1)]

    def p(self, gram: bytes) -> float:
        k = len(gram)
        if k == 0:
            return 1 / 256
        total = self.total[k].get(gram[:-1], 0)
        if not total:
            return self.p(gram[1:])
        v = self.n[k].get(gram, 0)
        own = (v - self.off[k][min(v, 3) - 1]) / total if v else 0.0
        return own + self.left[k][gram[:-1]] / total * self.p(gram[1:])

    def perplexity(self, text: str) -> float:
        g = self.grams(text, self.order)
        return 2 ** (-sum(math.log2(self.p(x)) for x in g) / len(g))
