"""Navigable small-world graph over 128-bit Hamming codes, searched with expanding beams.

Nodes are inserted in rounds. A new node searches the graph so far and keeps its OWN nearest as links;
they gain the reverse link, of which a node keeps the BACK nearest. Links of early nodes are long, so
the graph stays navigable. Entry points are early nodes and the neighbours in sorted orders of the
rotated codes. All queries of a round advance together, in numpy.
"""

from __future__ import annotations

import numpy as np

OWN, BACK, SEEDS, WIDTH, FULL = 8, 12, 4, 3, 4
ROTATIONS = 8
_ID = np.uint64(0xFFFFFFFF)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def distance(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.bitwise_count(codes[a, 0] ^ codes[b, 0])
    return x + np.bitwise_count(codes[a, 1] ^ codes[b, 1])


def _keys(codes: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """dist << 40 | id << 1 | 1 (not expanded yet) for every id (-1: none) against its row's query."""
    d = np.bitwise_count(codes[q, 0][:, None] ^ codes[ids, 0]) + np.bitwise_count(codes[q, 1][:, None] ^ codes[ids, 1])
    key = (d.astype(np.uint64) << np.uint64(40)) | (ids.astype(np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    key[ids < 0] = _NONE
    return key


def _merge(keys: np.ndarray, ef: int) -> np.ndarray:
    """The ``ef`` nearest distinct nodes of each row; of a node's two keys the expanded one stays."""
    keys.sort(axis=1)
    same = (keys[:, 1:] >> np.uint64(1)) == (keys[:, :-1] >> np.uint64(1))
    keys[:, 1:][same] = _NONE
    keys.sort(axis=1)
    if keys.shape[1] < ef:
        keys = np.pad(keys, ((0, 0), (0, ef - keys.shape[1])), constant_values=_NONE)
    return keys[:, :ef].copy()


class Graph:
    def __init__(self, codes: np.ndarray):
        self.codes = codes
        n = self.n = len(codes)
        self.links = np.full((n, OWN + BACK), -1, np.int32)
        self.near = self._rotations()
        self._build()

    def _rotations(self) -> np.ndarray:
        """Neighbours of each node in the sorted orders of its rotated codes."""
        n = self.n
        out = np.full((n, ROTATIONS * 4), -1, np.int32)
        a, b = self.codes[:, 0], self.codes[:, 1]
        for r in range(ROTATIONS):
            s = np.uint64(r * 128 // ROTATIONS % 64)
            x, y = (a, b) if r < ROTATIONS // 2 else (b, a)
            head = x if s == 0 else (x << s) | (y >> (np.uint64(64) - s))
            order = np.argsort(head, kind="stable")
            for k, step in enumerate((-2, -1, 1, 2)):
                src = slice(max(0, -step), n - max(0, step))
                dst = slice(max(0, step), n + min(0, step))
                if abs(step) < n:
                    out[order[src], r * 4 + k] = order[dst]
        return out

    def _build(self) -> None:
        done = min(self.n, 256)
        at = np.arange(done)
        if done > 1:
            self._link(at, _merge(_keys(self.codes, at, np.where(at[None, :] == at[:, None], -1, at[None, :])), OWN))
        while done < self.n:
            new = np.arange(done, min(self.n, done + max(256, min(done // 2, 4096))))
            near = self.near[new]
            near = np.where(near < new[:, None], near, -1)  # only what is inserted, this round included
            early = (new[:, None] * 7919 + np.arange(SEEDS)[None, :] * 31) % min(done, 256)
            keys = _merge(_keys(self.codes, new, np.concatenate([near, early], 1)), 2 * OWN)
            keys = self._walk(new, keys, 2 * OWN, below=new)
            self._link(new, keys[:, :OWN])
            done += len(new)

    def _link(self, new: np.ndarray, keys: np.ndarray) -> None:
        ids = ((keys >> np.uint64(1)) & _ID).astype(np.int64)
        ids[keys == _NONE] = -1
        self.links[new, : ids.shape[1]] = ids
        src = np.repeat(new, ids.shape[1])
        dst = ids.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        old = np.unique(dst)
        back = self.links[old, OWN:]
        r, c = np.nonzero(back >= 0)
        dst = np.concatenate([dst, old[r]])
        src = np.concatenate([src, back[r, c]])
        order = np.lexsort((src, distance(self.codes, src, dst), dst))
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        rank = np.arange(len(dst)) - np.repeat(first, np.diff(np.r_[first, len(dst)]))
        ok = rank < BACK
        self.links[dst[ok], OWN + rank[ok]] = src[ok]

    def _walk(self, q: np.ndarray, keys: np.ndarray, ef: int, below: np.ndarray | None = None) -> np.ndarray:
        """Expand the nearest unexpanded nodes of every beam until none is left in it."""
        live = np.arange(len(q))
        while len(live):
            k = keys[live]
            open_ = ((k & np.uint64(1)) == 1) & (k != _NONE)
            some = open_.any(axis=1)
            live, k, open_ = live[some], k[some], open_[some]
            if not len(live):
                break
            pick = open_ & (np.cumsum(open_, axis=1) <= WIDTH)
            rank = np.cumsum(pick, axis=1) - 1
            r, c = np.nonzero(pick)
            chosen = np.full((len(live), WIDTH), -1, np.int64)
            chosen[r, rank[r, c]] = ((k[r, c] >> np.uint64(1)) & _ID).astype(np.int64)
            k[r, c] &= ~np.uint64(1)
            nb = self.links[chosen]
            nb[chosen < 0] = -1
            nb = nb.reshape(len(live), -1)
            if below is not None:
                nb[nb >= below[live][:, None]] = -1
            keys[live] = _merge(np.concatenate([k, _keys(self.codes, q[live], nb)], 1), ef)
        return keys

    def search(self, q: np.ndarray, ef: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in q, neighbour) of every pair found within ``radius``. While all of a beam is
        within the radius, it may hide more: the beam doubles and walks on. In a crowd that fills a beam of FULL
        times its width, the rest is read off the codes themselves, which costs less than a walk over all of it."""
        most = FULL * ef
        start = np.concatenate([q[:, None], self.near[q]], 1)
        keys = self._walk(q, _merge(_keys(self.codes, q, start), ef), ef)
        rows, found = [], []
        left = np.arange(len(q))
        while len(left):
            full = (keys[:, -1] >> np.uint64(40)) <= radius
            full &= keys.shape[1] < self.n
            r, c = np.nonzero((keys[~full] >> np.uint64(40)) <= radius)
            rows.append(left[~full][r])
            found.append(((keys[~full][r, c] >> np.uint64(1)) & _ID).astype(np.int64))
            left, keys = left[full], keys[full]
            if len(left) and ef >= most:
                i, j = exact(self.codes, q[left], radius)
                rows.append(left[i])
                found.append(j)
                break
            if len(left):
                ef *= 2
                parts = []
                step = max(1, (1 << 20) // ef)
                for s in range(0, len(left), step):
                    k = np.pad(keys[s : s + step], ((0, 0), (0, ef - keys.shape[1])), constant_values=_NONE)
                    # the nodes that were cut off are found again through the links of expanded ones
                    k[k != _NONE] |= np.uint64(1)
                    parts.append(self._walk(q[left[s : s + step]], k, ef))
                keys = np.concatenate(parts)
        i, j = np.concatenate(rows), np.concatenate(found)
        ok = q[i] != j
        return i[ok], j[ok]


def exact(codes: np.ndarray, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    rows, found = [], []
    step = max(1, (1 << 21) // max(1, len(codes)))
    for s in range(0, len(q), step):
        p = q[s : s + step]
        d = np.bitwise_count(codes[p, 0][:, None] ^ codes[None, :, 0]) + np.bitwise_count(codes[p, 1][:, None] ^ codes[None, :, 1])
        i, j = np.nonzero(d <= radius)
        ok = p[i] != j
        rows.append(i[ok] + s)
        found.append(j[ok])
    return np.concatenate(rows), np.concatenate(found)


def recall(true: tuple[np.ndarray, np.ndarray], found: tuple[np.ndarray, np.ndarray], n: int) -> float:
    """Mean over the queries that have neighbours of the part of them that is found."""
    i, j = true
    hit = np.isin(i * n + j, found[0] * n + found[1])
    return float((np.bincount(i, hit) / np.maximum(1, np.bincount(i)))[np.unique(i)].mean())


def neighbours(codes: np.ndarray, radius: int, ef: int = 16, audit: int = 64, least: float = 0.95):
    """Yield (i, j) arrays of pairs within ``radius`` for every node as a query. Sampled queries are held
    against exact search, more of them until ``audit`` have a neighbour or all are drawn; below the wanted recall
    the beam doubles, and past 8 times its first width the shard is searched exactly."""
    n = len(codes)
    if n < 2:
        return
    if n <= 512:
        yield exact(codes, np.arange(n), radius)
        return
    g = Graph(codes)
    order = np.argsort((np.arange(n) * 2654435761) % (1 << 32), kind="stable")
    ti, tj, drawn = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while drawn < n and len(np.unique(ti)) < audit:
        more = order[drawn : drawn + 4 * audit]
        i, j = exact(codes, more, radius)
        ti, tj, drawn = np.r_[ti, drawn + i], np.r_[tj, j], drawn + len(more)
    sample = order[:drawn]
    width = ef
    while len(ti) and width <= 8 * ef:
        if recall((ti, tj), g.search(sample, width, radius), n) >= least:
            break
        width *= 2
    step = 4096
    for s in range(0, n, step):
        q = np.arange(s, min(n, s + step))
        i, j = g.search(q, width, radius) if width <= 8 * ef else exact(codes, q, radius)
        yield q[i], j
