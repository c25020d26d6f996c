"""Pairs of names by their Ratcliff/Obershelp ratio: SequenceMatcher's, computed for many pairs at once."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

#: From this length on SequenceMatcher leaves frequent letters out; such names are given to it one pair at a time.
LONG = 200
#: Buckets of letters: two letters in one make a bound looser, never wrong.
LETTERS = 64
#: Lists of fewer pairs are compared together with others.
FEW = 1 << 14
_CELLS = 1 << 21


def least_matched(la: int, lb: int, ratio: float) -> int:
    """The fewest matched letters that give ``ratio``."""
    m = max(0, int(ratio * (la + lb) / 2) - 1)
    while m <= min(la, lb) and la + lb and 2.0 * m / (la + lb) < ratio:
        m += 1
    return m


def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The letters that SequenceMatcher matches, for each row of a (n, la) and b (n, lb) of code points.

    The longest common run comes first, of equals the first in a, then in b; then what is left and right of it. A run
    that ends at a cell is the same in every part of the table, but for what lies before the part."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    out = np.zeros(n, np.int32)
    step = max(1, _CELLS // max(1, la * lb))
    i, j = np.arange(la, dtype=np.int16)[:, None], np.arange(lb, dtype=np.int16)[None, :]
    for at in range(0, n, step) if la and lb else ():
        run = (a[at : at + step, :, None] == b[at : at + step, None, :]).astype(np.uint8)
        for k in range(1, la):
            run[:, k, 1:] *= run[:, k - 1, :-1] + 1
        who = np.arange(len(run))
        box = np.tile(np.array([0, la, 0, lb], np.int16), (len(run), 1))
        first = True
        while len(who):
            top, end, left, right = (box[:, k, None, None] for k in range(4))
            cut = run if first else run[who]
            if not first:
                room = np.minimum(np.maximum(i - top + 1, 0) * (i < end), np.maximum(j - left + 1, 0) * (j < right)).astype(np.uint8)
                cut = np.minimum(cut, room)
            flat = cut.reshape(len(who), -1)
            best = flat.argmax(1)
            size = flat[np.arange(len(who)), best].astype(np.int16)
            np.add.at(out, at + who, size)
            ei, ej = (best // lb + 1).astype(np.int16), (best % lb + 1).astype(np.int16)
            before = np.stack([box[:, 0], ei - size, box[:, 2], ej - size], 1)
            after = np.stack([ei, box[:, 1], ej, box[:, 3]], 1)
            box, who, size = np.concatenate([before, after]), np.concatenate([who, who]), np.concatenate([size, size])
            some = (size > 0) & (box[:, 0] < box[:, 1]) & (box[:, 2] < box[:, 3])
            box, who, first = box[some], who[some], False
    return out


class Names:
    """Distinct names by length, with how often their letters occur."""

    def __init__(self, names: list[str], ratio: float):
        self.names, self.ratio = names, ratio
        self.length = np.array([len(s) for s in names], np.int64)
        self.place = np.zeros(len(names), np.int64)
        self.text: dict[int, np.ndarray] = {}
        self.letters = np.zeros((len(names), LETTERS), np.uint8)
        for n in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == n)
            self.place[at] = np.arange(len(at))
            if n >= LONG:
                continue
            self.text[n] = np.array([names[k] for k in at], f"U{max(n, 1)}").view(np.uint32).reshape(len(at), -1)[:, :n]
            for k in range(n):
                self.letters[at, self.text[n][:, k] % LETTERS] += 1
        top = int(self.length.max(initial=0)) + 1
        self.least = np.full((top, top), 1 << 30, np.int64)
        for x in np.unique(self.length).tolist():
            for y in np.unique(self.length).tolist():
                self.least[x, y] = least_matched(x, y, ratio)

    def among(self, x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the numbers x and y of names, each of one list once, whose longest common subsequence allows the ratio:
        no more letters than its can match. Names of over 64 letters are bounded by their lengths and letters alone."""
        x, y = x[np.lexsort((x, self.length[x]))], np.array(sorted(y.tolist(), key=self.names.__getitem__), np.int64)
        for type_, low, high in ((np.uint32, 0, 32), (np.uint64, 33, 64), (None, 65, 1 << 30)):
            rows = x[(self.length[x] >= low) & (self.length[x] <= high)]
            if type_ is None:
                tall = max(1, _CELLS // LETTERS // max(1, len(y)))
                every = ((np.repeat(rows[k : k + tall], len(y)), np.tile(y, len(rows[k : k + tall]))) for k in range(0, len(rows), tall))
            else:
                every = self._common(rows, y, type_) if len(rows) else ()
            for i, j in every:
                keep = (i < j) if same else np.ones(len(i), bool)
                yield i[keep], j[keep]

    def _common(self, x: np.ndarray, y: np.ndarray, type_: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The subsequences of all x with one y at a time, a bit a letter of x (Hyyro). What y and the one before it in the
        alphabet begin with is not done again."""
        masks: dict[str, np.ndarray] = {}
        for k, who in enumerate(x.tolist()):
            for at, c in enumerate(self.names[who]):
                if c not in masks:
                    masks[c] = np.zeros(len(x), type_)
                masks[c][k] |= type_(1 << at)
        width, lx = 8 * np.dtype(type_).itemsize, self.length[x]
        need: dict[int, np.ndarray | None] = {}
        steps, last = [np.full(len(x), ~type_(0))], ""
        out, held = [], 0
        u = np.empty(len(x), type_)
        for who in y.tolist():
            b = self.names[who]
            n = len(b)
            if n not in need:
                m = np.where(np.minimum(lx, n) >= self.least[lx, n], self.least[lx, n], width + 1)
                need[n] = np.maximum(width - m, -1).astype(np.int16) if (m <= width).any() else None
            if need[n] is None:
                continue
            same = 0
            while same < min(n, len(last)) and b[same] == last[same]:
                same += 1
            del steps[same + 1 :]
            for c in b[same:]:
                v = steps[-1]
                if c in masks:
                    np.bitwise_and(v, masks[c], out=u)
                    w = v + u
                    np.subtract(v, u, out=u)
                    v = np.bitwise_or(w, u, out=w)
                steps.append(v)
            last = b
            hit = np.flatnonzero(np.bitwise_count(steps[-1]) <= need[n])
            out.append((x[hit], np.full(len(hit), who)))
            held += len(hit)
            if held > _CELLS // 8:
                yield np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])
                out, held = [], 0
        if held:
            yield np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])

    def judged(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair whether its ratio is reached with x first, and with y first."""
        there, back = np.zeros(len(x), bool), np.zeros(len(x), bool)
        lx, ly = self.length[x], self.length[y]
        long = (lx >= LONG) | (ly >= LONG)
        for k in np.flatnonzero(long).tolist():
            a, b = self.names[x[k]], self.names[y[k]]
            there[k], back[k] = SequenceMatcher(None, a, b).ratio() >= self.ratio, SequenceMatcher(None, b, a).ratio() >= self.ratio
        at = np.flatnonzero(~long)
        common = np.zeros(len(x), np.int64)
        for k in range(0, len(at), FEW):
            p = at[k : k + FEW]
            common[p] = np.minimum(self.letters[x[p]], self.letters[y[p]]).sum(1, dtype=np.int64)
        # a bucket that two letters share counts the lesser of their sums, which is no less than the sum of the lesser ones
        at = at[common[at] >= self.least[lx[at], ly[at]]]
        kind = lx[at] * LONG + ly[at]
        order = at[np.argsort(kind, kind="stable")]
        kinds, begin = np.unique(np.sort(kind), return_index=True)
        for kind, s, e in zip(kinds.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
            n, m = divmod(kind, LONG)
            p = order[s:e]
            a, b = self.text[n][self.place[x[p]]], self.text[m][self.place[y[p]]]
            there[p], back[p] = matched(a, b) >= self.least[n, m], matched(b, a) >= self.least[n, m]
        return there, back


def found(batches: Iterator[pa.RecordBatch], ratio: float, years: int) -> Iterator[pa.RecordBatch]:
    """(m, n, there, back), m < n: of each row's lists x and y (structs of name and ages; a null age is any) the names that are
    alike, and in which order. Ages are looked at modulo 64, so some pairs of no fitting age may be among them."""
    one = np.uint64(1)

    def ages(of: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        exact, wide = np.zeros(len(of), np.uint64), np.zeros(len(of), np.uint64)
        who = np.repeat(np.arange(len(of)), of.value_lengths().to_numpy())
        flat = of.flatten()
        any_ = flat.is_null().to_numpy(zero_copy_only=False)
        v = flat.fill_null(0).to_numpy().astype(np.int64)
        np.bitwise_or.at(exact, who, np.where(any_, ~np.uint64(0), one << (v % 64).astype(np.uint64)))
        for d in range(-years, years + 1):
            np.bitwise_or.at(wide, who, np.where(any_, ~np.uint64(0), one << ((v + d) % 64).astype(np.uint64)))
        return exact, wide

    def told(names: Names, x: np.ndarray, y: np.ndarray, age: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        fit = (age[0][x] & age[3][y]) != 0
        fit &= np.minimum(names.length[x], names.length[y]) >= names.least[names.length[x], names.length[y]]
        x, y = x[fit], y[fit]
        there, back = names.judged(x, y)
        some = there | back
        rows = []
        for i, j, t, b in zip(x[some].tolist(), y[some].tolist(), there[some].tolist(), back[some].tolist()):
            m, n = names.names[i], names.names[j]
            rows.append((m, n, t, b) if m < n else (n, m, b, t))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.bool_(), pa.bool_()))], names=["m", "n", "there", "back"])

    for batch in batches:
        same = batch.column("same").to_pylist()
        sides = [batch.column(c) for c in ("x", "y")]
        offset, base = [], 0
        texts: list[str] = []
        ages_of = []
        for s in sides:
            n = s.value_lengths().to_numpy()
            offset.append(base + np.concatenate([[0], np.cumsum(n)]))
            flat = s.flatten()
            texts += flat.field("name").to_pylist()
            ages_of.append(ages(flat.field("ages")))
            base += len(flat)
        at = {s: k for k, s in enumerate(dict.fromkeys(texts))}
        number = np.array([at[s] for s in texts], np.int64)
        age = [np.zeros(len(at), np.uint64) for _ in range(4)]
        for k in range(2):
            got = np.concatenate([ages_of[0][k], ages_of[1][k]])
            age[k][number] = got
            age[k + 2][number] = got
        names = Names(list(at), ratio)
        xs, ys, held = [], [], 0
        for k in range(len(same)):
            x, y = number[offset[0][k] : offset[0][k + 1]], number[offset[1][k] : offset[1][k + 1]]
            if len(x) * len(y) > FEW:
                for i, j in names.among(x, y, same[k]):
                    yield from told(names, i, j, age)
                continue
            i, j = np.repeat(x, len(y)), np.tile(y, len(x))
            if same[k]:
                i, j = i[i < j], j[i < j]
            xs.append(i)
            ys.append(j)
            held += len(i)
            if held > _CELLS:
                i, j = np.concatenate(xs), np.concatenate(ys)
                yield from told(names, i, j, age)
                xs, ys, held = [], [], 0
        if held:
            i, j = np.concatenate(xs), np.concatenate(ys)
            yield from told(names, i, j, age)
