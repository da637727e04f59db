"""A hierarchical navigable small-world graph over one shard, built and searched in NumPy batches.

Nodes are numbered by falling level, so layer l is the first `sizes[l]` nodes. `layers[l]` holds
their neighbours, padded with -1.
"""

from __future__ import annotations

import numpy as np

M = 12
BUILD_BEAM = 32
_SEED_NODES = 48
_BATCH = 1024


def levels(n: int, seed: int) -> np.ndarray:
    """Falling levels of n nodes, geometric with mean 1 / ln(M)."""
    u = np.random.default_rng(seed).random(n)
    return -np.sort(-(-np.log(np.maximum(u, 1e-12)) / np.log(M)).astype(np.int64))


class Graph:
    def __init__(self, vectors: np.ndarray, level: np.ndarray, layers: list[np.ndarray] | None = None):
        self.vectors = vectors
        self.sizes = [int(np.count_nonzero(level >= k)) for k in range(int(level[0]) + 1)]
        self.layers = layers if layers is not None else self._build()

    def _build(self) -> list[np.ndarray]:
        self.layers = [np.full((s, M if k else 2 * M), -1, dtype=np.int32) for k, s in enumerate(self.sizes)]
        for k in range(len(self.sizes) - 1, -1, -1):
            size, at = self.sizes[k], 0
            while at < size:
                upto = min(size, max(_SEED_NODES, min(2 * at, at + _BATCH)))
                self._insert(k, at, upto)
                at = upto
        return self.layers

    def _insert(self, k: int, lo: int, hi: int) -> None:
        q = self.vectors[lo:hi]
        within = q @ q.T
        np.fill_diagonal(within, -2)
        take = min(BUILD_BEAM, hi - lo)
        ids = np.argpartition(-within, take - 1, axis=1)[:, :take] + lo
        sims = np.take_along_axis(within, ids - lo, axis=1)
        if lo:
            entry = self.descend(q, k)
            entry = np.where(entry < lo, entry, 0)  # what is above may not be in this layer yet
            far, far_sims = self.beam(q, entry, k, BUILD_BEAM, lo)
            ids, sims = np.concatenate([far, ids], axis=1), np.concatenate([far_sims, sims], axis=1)
        ids = np.where(sims > -1.5, ids, -1)
        chosen = self._select(ids, sims, M)
        self.layers[k][lo:hi, :M] = chosen
        src, col = np.nonzero(chosen >= 0)
        self._back(k, chosen[src, col], src + lo)

    def _select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Diverse neighbours: nearer to the node than to one chosen before, then the nearest others."""
        order = np.argsort(-np.where(ids >= 0, sims, -3), axis=1, kind="stable")[:, : 2 * most + 8]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.vectors[np.maximum(ids, 0)]
        cross = v @ v.transpose(0, 2, 1)
        keep = np.zeros(ids.shape, dtype=bool)
        closest = np.full(ids.shape, -3.0, dtype=np.float32)
        count = np.zeros(len(ids), dtype=np.int64)
        for i in range(ids.shape[1]):
            ok = (ids[:, i] >= 0) & (closest[:, i] < sims[:, i]) & (count < most)
            keep[:, i] = ok
            count += ok
            closest = np.where(ok[:, None], np.maximum(closest, cross[:, i]), closest)
        rank = np.where(keep, 0, np.where(ids >= 0, 1, 2))
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.full((len(ids), most), -1, dtype=np.int32)
        out[:, : first.shape[1]] = np.take_along_axis(ids, first, 1)
        return out

    def _back(self, k: int, to: np.ndarray, node: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        to, node = to[order], node[order]
        who, begin, n = np.unique(to, return_index=True, return_counts=True)
        width = self.layers[k].shape[1]
        new = int(min(n.max(), 4 * width)) if len(n) else 0
        if not new:
            return
        slot = np.arange(len(to)) - np.repeat(begin, n)
        fresh = np.full((len(who), new), -1, dtype=np.int32)
        ok = slot < new
        fresh[np.repeat(np.arange(len(who)), n)[ok], slot[ok]] = node[ok]
        for a in range(0, len(who), _BATCH):
            own = who[a : a + _BATCH]
            pool = np.concatenate([self.layers[k][own], fresh[a : a + _BATCH]], axis=1)
            pool = np.where(pool == own[:, None], -1, pool)
            same = np.sort(pool, axis=1)
            if (same[:, 1:] == same[:, :-1])[same[:, 1:] >= 0].any():
                same[:, 1:][same[:, 1:] == same[:, :-1]] = -1
                pool = same
            sims = np.einsum("bpd,bd->bp", self.vectors[np.maximum(pool, 0)], self.vectors[own])
            self.layers[k][own] = self._select(pool, sims, width)

    def descend(self, q: np.ndarray, until: int = 0) -> np.ndarray:
        """The node that greedy search reaches in the layers above `until`."""
        at = np.zeros(len(q), dtype=np.int64)
        for k in range(len(self.sizes) - 1, until, -1):
            best = np.einsum("bd,bd->b", self.vectors[at], q)
            live = np.arange(len(q))
            while len(live):
                nb = self.layers[k][at[live]]
                sims = np.einsum("bpd,bd->bp", self.vectors[np.maximum(nb, 0)], q[live])
                sims[nb < 0] = -3
                j = sims.argmax(axis=1)
                top = sims[np.arange(len(live)), j]
                up = top > best[live]
                at[live[up]], best[live[up]] = nb[np.arange(len(live)), j][up], top[up]
                live = live[up]
        return at

    def beam(self, q: np.ndarray, entry: np.ndarray, k: int, width: int, live: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest nodes met by beam search in layer k; -2 marks empty places of sims."""
        n, step = len(q), 8
        seen = np.zeros((n, live or self.sizes[k]), dtype=bool)
        ids = np.zeros((n, width), dtype=np.int64)
        sims = np.full((n, width), -2, dtype=np.float32)
        done = np.ones((n, width), dtype=bool)
        ids[:, 0], done[:, 0] = entry, False
        sims[:, 0] = np.einsum("bd,bd->b", self.vectors[entry], q)
        seen[np.arange(n), entry] = True
        rows = np.arange(n)
        while len(rows):
            open_ = np.where(done[rows], -3, sims[rows])
            pick = np.argpartition(-open_, step - 1, axis=1)[:, :step] if width > step else np.argsort(-open_, axis=1)
            ok = np.take_along_axis(open_, pick, 1) > -2
            some = ok.any(axis=1)
            rows, pick, ok = rows[some], pick[some], ok[some]
            if not len(rows):
                break
            done[rows[:, None], pick] = True
            nb = self.layers[k][ids[rows[:, None], pick]]
            nb = np.where(ok[:, :, None], nb, -1).reshape(len(rows), -1)
            r, c = np.nonzero(nb >= 0)
            node = nb[r, c].astype(np.int64)
            fresh = ~seen[rows[r], node]
            r, node = r[fresh], node[fresh]
            key = np.sort(r * seen.shape[1] + node)
            key = key[np.diff(key, prepend=-1) > 0]
            r, node = np.divmod(key, seen.shape[1])
            seen[rows[r], node] = True
            s = np.einsum("ed,ed->e", self.vectors[node], q[rows[r]])
            count = np.bincount(r, minlength=len(rows))
            most = int(count.max()) if len(count) else 0
            if not most:
                continue
            slot = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            more_ids = np.zeros((len(rows), most), dtype=np.int64)
            more_sims = np.full((len(rows), most), -2, dtype=np.float32)
            more_ids[r, slot], more_sims[r, slot] = node, s
            all_sims = np.concatenate([sims[rows], more_sims], axis=1)
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[rows] = np.take_along_axis(all_sims, top, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], more_ids], axis=1), top, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], more_sims <= -2], axis=1), top, 1)
        return ids, sims

    def scan(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) of at least that similarity, by comparing with every node."""
        return np.nonzero(q @ self.vectors.T >= least)

    def within(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of at least that similarity; a beam that is more than half full of such is
        widened, and what would need a quarter of the nodes is compared with all of them."""
        n = self.sizes[0]
        todo, entry = np.arange(len(q)), self.descend(q)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(todo):
            if 4 * width >= n:
                r, c = self.scan(q[todo], least)
                found.append((todo[r], c))
                break
            ids, sims = self.beam(q[todo], entry[todo], 0, width)
            hit = sims >= least
            wide = 2 * hit.sum(axis=1) > width
            r, c = np.nonzero(hit & ~wide[:, None])
            found.append((todo[r], ids[r, c]))
            todo, width = todo[wide], 4 * width
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
