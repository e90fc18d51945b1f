"""A hierarchical navigable small-world graph over one shard of unit vectors, in flat arrays.

Nodes are numbered so that every layer is a prefix: layer 0 holds all of them, each layer above a sixteenth of the one
below.  A layer is two arrays, the neighbours of every node and their similarities.  Nodes are inserted in batches of at
most the number already there: a batch is searched together, all its beams moving one step at a time, so that each step is
a few array operations for the whole batch.
"""

from __future__ import annotations

import numpy as np

FAN, TOP, BATCH = 16, 1024, 2048
ONE = 1 << 22  # steps of similarity; few enough that float32 keeps them
_NONE = np.int64(1) << 62


def _pack(sim: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Keys that sort by similarity descending, then node; the lowest bit is free for 'expanded'."""
    q = ((1.0 - np.clip(sim, -1.0, 1.0)) * ONE).astype(np.int64)
    return (q << 32) | (node.astype(np.int64) << 1)


def _node(key: np.ndarray) -> np.ndarray:
    return ((key >> 1) & 0x7FFFFFFF).astype(np.int32)


class Graph:
    def __init__(self, vectors: np.ndarray, links: int = 16, beam: int = 24):
        self.x, self.m, self.beam = np.ascontiguousarray(vectors, dtype=np.float32), links, beam
        sizes = [len(self.x)]
        while sizes[-1] > TOP:
            sizes.append(max(TOP // 2, sizes[-1] // FAN))
        self.sizes = sizes  # of layer 0, 1, ...
        self.nbr = [np.full((n, 2 * links), -1, np.int32) for n in sizes]
        self.sim = [np.full((n, 2 * links), -2.0, np.float32) for n in sizes]
        top = len(sizes) - 1
        n = sizes[top]
        if n > 1:
            s = self.x[:n] @ self.x[:n].T
            np.fill_diagonal(s, -2.0)
            k = min(2 * links, n - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            self.nbr[top][:, :k], self.sim[top][:, :k] = best, np.take_along_axis(s, best, 1)
        for layer in range(top - 1, -1, -1):
            there = sizes[layer + 1]
            self.nbr[layer][:there], self.sim[layer][:there] = self.nbr[layer + 1], self.sim[layer + 1]
            while there < sizes[layer]:
                upto = min(sizes[layer], there + min(BATCH, there))
                self._insert(layer, there, upto)
                there = upto
        self._reach()

    def _reach(self, rounds: int = 30) -> None:
        """Lists keep the best links only, so a small tight group may be linked from nowhere else.  Every node that can't
        be reached from the top gets a link, in two columns of their own, from the reachable node most similar to it."""
        n = self.sizes[0]
        if len(self.sizes) == 1:
            return
        self.nbr[0] = np.concatenate([self.nbr[0], np.full((n, 2), -1, np.int32)], 1)
        seen = np.zeros(n, bool)
        front = np.arange(self.sizes[-1], dtype=np.int32)
        for _ in range(rounds):
            while len(front):
                seen[front] = True
                front = np.unique(self.nbr[0][front])
                front = front[front >= 0]
                front = front[~seen[front]]
            lost = np.flatnonzero(~seen)
            if not len(lost):
                return
            lost = lost[:BATCH]
            near = _node(self._beam(self.x[lost], 0, n, self.beam))
            free = (self.nbr[0][near, -2:] < 0).any(2)
            pick = near[np.arange(len(lost)), free.argmax(1)]
            ok = free.any(1)
            pick, first = np.unique(pick[ok], return_index=True)
            lost = lost[ok][first]
            slot = np.where(self.nbr[0][pick, -2] < 0, -2, -1)
            self.nbr[0][pick, slot] = lost
            front = lost.astype(np.int32)

    def _insert(self, layer: int, start: int, end: int) -> None:
        q, m = self.x[start:end], self.m
        keys = self._beam(q, layer, start, self.beam)[:, : 2 * m]
        s = q @ q.T
        s = (s + s.T) / 2  # the same number from both ends
        np.fill_diagonal(s, -2.0)
        k = min(m, len(q) - 1)
        if k > 0:
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            keys = np.sort(np.concatenate([keys, _pack(np.take_along_axis(s, near, 1), near + start)], 1), 1)
        keys = keys[:, :m]
        node, ok = _node(keys), keys < _NONE
        sim = 1.0 - (keys >> 32).astype(np.float32) / ONE
        w = keys.shape[1]
        self.nbr[layer][start:end, :w] = np.where(ok, node, -1)
        self.sim[layer][start:end, :w] = np.where(ok, sim, -2.0)
        # links back: the new nodes of each old one, best first, merged into its list
        u, v, b = node[ok], np.broadcast_to(np.arange(start, end, dtype=np.int32)[:, None], node.shape)[ok], sim[ok]
        order = np.lexsort((-b, u))
        u, v, b = u[order], v[order], b[order]
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        rank = np.arange(len(u)) - np.repeat(first, np.diff(np.r_[first, len(u)]))
        row = np.cumsum(np.r_[0, u[1:] != u[:-1]])
        fit = rank < 2 * m
        whose = u[first]
        nb, sb = np.full((len(whose), 2 * m), -1, np.int32), np.full((len(whose), 2 * m), -2.0, np.float32)
        nb[row[fit], rank[fit]], sb[row[fit], rank[fit]] = v[fit], b[fit]
        nb, sb = np.concatenate([self.nbr[layer][whose], nb], 1), np.concatenate([self.sim[layer][whose], sb], 1)
        # the same link may come from both sides of one batch
        key = np.sort(np.where(nb >= 0, _pack(sb, nb), _NONE), 1)
        key[:, 1:][key[:, 1:] == key[:, :-1]] = _NONE
        key = np.sort(key, 1)[:, : 2 * m]
        self.nbr[layer][whose] = np.where(key < _NONE, _node(key), -1)
        self.sim[layer][whose] = np.where(key < _NONE, 1.0 - (key >> 32).astype(np.float32) / ONE, -2.0)

    def _beam(self, q: np.ndarray, layer: int, limit: int, beam: int, own: np.ndarray | None = None, starts: int = 6, steps: int = 200) -> np.ndarray:
        """Sorted keys of the best nodes of a layer (numbers below ``limit``) found for each query; own: see search."""
        top = len(self.sizes) - 1
        n = min(self.sizes[top], limit)
        s = q @ self.x[:n].T
        k = min(starts if top > layer else beam, n)  # nothing walks on from a layer that is the top itself
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        # in the form that _walk uses, so that a node has one key wherever it is met
        keys = np.sort(_pack(np.matmul(self.x[best], q[:, :, None])[:, :, 0], best), 1)
        for at in range(top - 1, layer - 1, -1):
            width = beam if at == layer else max(starts, 8)
            if at == 0 and own is not None:
                mine = _pack(np.einsum("ij,ij->i", self.x[np.maximum(own, 0)], q), own)[:, None]
                keys = np.sort(np.concatenate([keys, np.where(own[:, None] >= 0, mine, _NONE)], 1), 1)
                keys[:, 1:][(_node(keys[:, 1:]) == _node(keys[:, :-1])) & (keys[:, 1:] < _NONE)] = _NONE
                keys = np.sort(keys, 1)
            keys = self._walk(q, at, keys & ~np.int64(1), width, steps)
            keys &= ~np.int64(1)
        return keys

    def _walk(self, q: np.ndarray, layer: int, keys: np.ndarray, width: int, steps: int) -> np.ndarray:
        nbr, x = self.nbr[layer], self.x
        if keys.shape[1] < width:
            keys = np.concatenate([keys, np.full((len(q), width - keys.shape[1]), _NONE)], 1)
        live = np.arange(len(q))
        for _ in range(steps):
            mine = keys[live]
            todo = ((mine & 1) == 0) & (mine < _NONE)
            go = todo.any(1)
            live, mine, todo = live[go], mine[go], todo[go]
            if not len(live):
                break
            pick = todo.argmax(1)
            rows = np.arange(len(live))
            cur = _node(mine[rows, pick])
            mine[rows, pick] |= 1
            near = nbr[cur]
            sims = np.matmul(x[np.maximum(near, 0)], q[live][:, :, None])[:, :, 0]
            new = np.where(near >= 0, _pack(sims, near), _NONE)
            new[new > mine[:, -1:]] = _NONE
            both = np.sort(np.concatenate([mine, new], 1), 1)
            # a node met again has the same key but for the flag: keep the expanded one
            same = (both[:, 1:] >> 1) == (both[:, :-1] >> 1)
            if same.any():
                same &= both[:, 1:] < _NONE
                both[:, :-1][same] = _NONE
                both = np.sort(both, 1)
            keys[live] = both[:, :width]
        return keys

    def search(self, q: np.ndarray, k: int, beam: int | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of about the k most similar nodes for each query, best first; -1 where there are fewer.

        The beam is at least twice k; a graph of one layer is compared as a whole.
        own: the query's own node, or -1 if it isn't in the graph; its links are a way into its neighbourhood that the
        walk from the top may miss.
        """
        width = max(2 * k, beam or self.beam)
        nodes, sims = [], []
        for i in range(0, len(q), BATCH):
            part = np.ascontiguousarray(q[i : i + BATCH], dtype=np.float32)
            keys = self._beam(part, 0, len(self.x), width, None if own is None else own[i : i + BATCH])
            node = _node(keys)
            again = np.triu(node[:, :, None] == node[:, None, :], 1).any(1) & (keys < _NONE)
            if again.any():
                keys = np.sort(np.where(again, _NONE, keys), 1)
            keys = keys[:, :k]
            if keys.shape[1] < k:
                keys = np.concatenate([keys, np.full((len(part), k - keys.shape[1]), _NONE)], 1)
            node = np.where(keys < _NONE, _node(keys), -1)
            nodes.append(node)
            sims.append(np.where(node >= 0, np.matmul(self.x[np.maximum(node, 0)], part[:, :, None])[:, :, 0], -2.0))
        return np.concatenate(nodes), np.concatenate(sims)
