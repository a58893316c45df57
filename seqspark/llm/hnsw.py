"""Hierarchical navigable small-world graph in flat neighbour arrays, built and searched by batches in numpy.

Nodes are numbered by falling level, so a layer's nodes are the first ones and its links are one integer array of
(nodes x most links), -1 where there is none. A batch of nodes or queries walks the graph in step. Vectors get one
more coordinate that gives all the same length, so that nearness by inner product is nearness by distance.
"""

from __future__ import annotations

import numpy as np


class Graph:
    """An index over the rows of `vectors` (float32); `seeds` (uint64, spread evenly) set the levels."""

    def __init__(self, vectors: np.ndarray, seeds: np.ndarray, links: int = 16, ef: int = 64):
        n = len(vectors)
        self.most, self.ef = links, ef
        uniform = (seeds.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.floor(-np.log(1.0 - uniform) / np.log(links)).astype(np.int64)
        self.row = np.argsort(-level, kind="stable")
        level = level[self.row]
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        rest = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0))
        self.x = np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)[self.row]
        self.layers = [
            np.full((int((level >= k).sum()), links * (2 if k == 0 else 1)), -1, np.int32)
            for k in range(int(level.max(initial=0)) + 1)]
        done = 0
        while done < n:
            same = int(np.searchsorted(-level, -level[done], side="right"))
            end = min(same, done + min(512, max(32, done)))
            self._insert(done, end, int(level[done]))
            done = end

    def _insert(self, begin: int, end: int, level: int) -> None:
        q = self.x[begin:end]
        entry = np.zeros((end - begin, 1), np.int64)
        for k in range(len(self.layers) - 1, level, -1):
            entry, _ = self._search(k, q, entry, 1, min(begin, len(self.layers[k])))
        inner = q @ q.T
        np.fill_diagonal(inner, -np.inf)
        near = np.argsort(-inner, axis=1)[:, :self.most]
        near_sims = np.take_along_axis(inner, near, axis=1)
        for k in range(level, -1, -1):
            ids, sims = self._search(k, q, entry, self.ef, begin)
            entry = ids[:, :max(1, min(8, ids.shape[1]))] if begin else entry
            near_ids = np.where(np.isfinite(near_sims), near + begin, -1)
            ids, sims = _by_nearness(np.concatenate([ids, near_ids], 1), np.concatenate([sims, near_sims], 1), self.ef)
            chosen = self._choose(ids, sims, self.most)
            self.layers[k][begin:end, :self.most] = chosen
            own, place = np.nonzero(chosen >= 0)
            self._link_back(k, chosen[own, place], own + begin)

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates by nearness: those nearer to the node than to any chosen before, then the nearest others."""
        b, c = ids.shape
        x = self.x[np.maximum(ids, 0)]
        between = x @ x.transpose(0, 2, 1)
        valid, nearest = ids >= 0, np.full((b, c), -np.inf, np.float32)
        chosen, count = np.zeros((b, c), bool), np.zeros(b, np.int64)
        for j in range(c):
            ok = valid[:, j] & (count < most) & (nearest[:, j] < sims[:, j])
            chosen[:, j] = ok
            count += ok
            nearest[ok] = np.maximum(nearest[ok], between[ok, j])
        place = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(valid, place, 1), np.take_along_axis(ids, place, 1), -1)
        return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link_back(self, k: int, targets: np.ndarray, sources: np.ndarray) -> None:
        if not len(targets):
            return
        layer = self.layers[k]
        width = layer.shape[1]
        order = np.argsort(targets, kind="stable")
        targets, sources = targets[order], sources[order]
        nodes, first, counts = np.unique(targets, return_index=True, return_counts=True)
        for begin in range(0, len(nodes), 1024):
            some, n = nodes[begin:begin + 1024], counts[begin:begin + 1024]
            new = np.full((len(some), int(n.max())), -1, np.int64)
            row = np.repeat(np.arange(len(some)), n)
            start = first[begin]
            new[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = sources[start:start + len(row)]
            ids = np.concatenate([layer[some], new], axis=1)
            sims = np.einsum("bcd,bd->bc", self.x[np.maximum(ids, 0)], self.x[some])
            ids, sims = _by_nearness(ids, np.where(ids >= 0, sims, -np.inf), 2 * width)
            full = ids.shape[1] > width
            over = (ids[:, width] >= 0) if full else np.zeros(len(some), bool)
            layer[some, :min(width, ids.shape[1])] = ids[:, :width]
            if over.any():
                layer[some[over]] = self._choose(ids[over], sims[over], width)

    def _search(self, k: int, q: np.ndarray, entry: np.ndarray, ef: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The `ef` nearest nodes found in layer `k` among its first `n`, nearest first, and their inner products."""
        b = len(q)
        if not n:
            return np.full((b, 1), -1, np.int64), np.full((b, 1), -np.inf, np.float32)
        links, wide = self.layers[k], 1 if ef < 8 else 4
        seen = np.zeros((b, n), bool)
        rows = np.arange(b)[:, None]
        ids = np.full((b, max(ef, entry.shape[1])), -1, np.int64)
        ids[:, :entry.shape[1]] = entry
        seen[rows, np.maximum(entry, 0)] = True
        sims = np.full(ids.shape, -np.inf, np.float32)
        sims[:, :entry.shape[1]] = np.where(
            entry >= 0, np.einsum("bcd,bd->bc", self.x[np.maximum(entry, 0)], q), -np.inf)
        expanded = ids < 0
        ids, sims, expanded = _by_nearness(ids, sims, ef, expanded)
        while True:
            open_ = ~expanded
            row, column = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= wide))
            if not len(row):
                return ids, sims
            expanded[row, column] = True
            next_ = links[ids[row, column]]
            key = np.repeat(row, links.shape[1]) * n + next_.reshape(-1)
            key = np.unique(key[(next_ >= 0).reshape(-1)])
            at, node = np.divmod(key, n)
            fresh = ~seen[at, node]
            at, node = at[fresh], node[fresh]
            if not len(at):
                continue
            seen[at, node] = True
            found = np.einsum("pd,pd->p", q[at], self.x[node])
            sizes = np.bincount(at, minlength=b)
            more, more_sims = np.full((b, sizes.max()), -1, np.int64), np.full((b, sizes.max()), -np.inf, np.float32)
            place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            more[at, place], more_sims[at, place] = node, found
            ids, sims, expanded = _by_nearness(
                np.concatenate([ids, more], 1), np.concatenate([sims, more_sims], 1), ef,
                np.concatenate([expanded, more < 0], 1))

    def search(self, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Rows of the `k` nearest vectors found for each query, nearest first; -1 beyond what there is."""
        q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        ef = max(ef, k)
        out = np.full((len(q), k), -1, np.int64)
        step = max(16, min(512, (1 << 24) // max(1, len(self.x))))
        for a in range(0, len(q), step):
            part = q[a:a + step]
            entry = np.zeros((len(part), 1), np.int64)
            for layer in range(len(self.layers) - 1, 0, -1):
                entry, _ = self._search(layer, part, entry, 1, len(self.layers[layer]))
            ids, _ = self._search(0, part, entry, ef, len(self.x))
            ids = ids[:, :k]
            out[a:a + step, :ids.shape[1]] = np.where(ids >= 0, self.row[np.maximum(ids, 0)], -1)
        return out


def _by_nearness(ids: np.ndarray, sims: np.ndarray, most: int, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first `most` columns in order of falling `sims`."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return tuple(np.take_along_axis(x, order, 1) for x in (ids, sims, *others))
