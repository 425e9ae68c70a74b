"""A hierarchical navigable small-world graph over one shard of unit vectors, in numpy.

Many queries walk the graph side by side, so that every step is a few array operations.
"""

from functools import cached_property

import numpy as np

_NONE = -np.inf
_STEPS = 4
#: Numbers held at once, 32 MB of them: long vectors are worked on in shorter batches.
_FLOATS = 4_000_000


class Graph:
    """links[level] holds the neighbours of each node, -1 where there is none; levels the top level of each node."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, degree: int = 16):
        self.vectors = vectors
        self.levels = levels
        self.degree = degree
        n = len(vectors)
        tops = int(levels.max()) + 1 if n else 1
        self.links = [np.full((n, degree * (2 if level == 0 else 1)), -1, np.int32) for level in range(tops)]
        self.entry = -1

    @classmethod
    def built(cls, vectors: np.ndarray, ids: np.ndarray, *, degree: int = 16, beam: int = 64) -> "Graph":
        """Insert in batches that grow with the graph; members of a batch are candidates for each other."""
        rng = np.random.default_rng(int(np.bitwise_xor.reduce(ids.astype(np.int64)) & 0x7FFFFFFF) if len(ids) else 0)
        levels = np.floor(-np.log(1 - rng.random(len(ids))) / np.log(degree)).astype(np.int32)
        graph = cls(vectors, levels, degree)
        done = 0
        while done < len(vectors):
            size = min(len(vectors) - done, max(1, min(128, done // 2)))
            graph._insert(np.arange(done, done + size), beam)
            done += size
        return graph

    def _insert(self, new: np.ndarray, beam: int) -> None:
        if self.entry < 0:
            self.entry = int(new[0])
            return
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        start = np.full((len(new), 1), self.entry, np.int32)
        top = int(self.levels[self.entry])
        for level in range(top, -1, -1):
            wide = beam if (self.levels[new] >= level).any() else 1
            ids, sims = self._walk(level, self.vectors[new], start, wide)
            found[level] = ids, sims
            start = ids[:, :1]
        peers = self.vectors[new] @ self.vectors[new].T
        np.fill_diagonal(peers, _NONE)
        for level in range(min(top, int(self.levels[new].max())) + 1):
            mine = np.flatnonzero(self.levels[new] >= level)
            ids, sims = found[level]
            there = np.where(self.levels[new] >= level, peers[mine], _NONE)
            ids = np.hstack([ids[mine], np.where(there > _NONE, new[None, :], -1)])
            chosen = self._chosen(new[mine], ids, np.hstack([sims[mine], there]), level)
            self.links[level][new[mine]] = chosen
            self._link_back(new[mine], chosen, level)
        for level in range(top + 1, int(self.levels[new].max()) + 1):
            mine = new[self.levels[new] >= level]
            if len(mine) > 1:
                sims = self.vectors[mine] @ self.vectors[mine].T
                np.fill_diagonal(sims, _NONE)
                ids = np.where(sims > _NONE, mine[None, :], -1)
                self.links[level][mine] = self._chosen(mine, ids, sims, level)
        highest = new[np.argmax(self.levels[new])]
        if self.levels[highest] > top:
            self.entry = int(highest)

    def _chosen(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, level: int) -> np.ndarray:
        """Neighbours in different directions first: a candidate nearer to a chosen one waits; gaps are filled by nearness."""
        most = self.links[level].shape[1]
        keep = min(ids.shape[1], 3 * most)
        rows = max(1, _FLOATS // (keep * (keep + self.vectors.shape[1])))
        if len(ids) > rows:
            parts = range(0, len(ids), rows)
            return np.vstack([self._chosen(nodes[i : i + rows], ids[i : i + rows], sims[i : i + rows], level) for i in parts])
        order = np.argsort(-sims, axis=1, kind="stable")[:, :keep]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        real = ids >= 0
        among = self.vectors[np.where(real, ids, 0)]
        among = np.einsum("bid,bjd->bij", among, among, optimize=True)
        nearest = np.full(ids.shape, _NONE)
        rank = np.full(ids.shape, np.inf)
        count = np.zeros(len(ids), int)
        for t in range(keep):
            take = real[:, t] & (nearest[:, t] < sims[:, t]) & (count < most)
            rank[take, t] = t
            count += take
            nearest = np.where(take[:, None], np.maximum(nearest, among[:, :, t]), nearest)
        waiting = real & np.isinf(rank)
        rank = np.where(waiting, keep + np.arange(keep), rank)
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.full((len(ids), most), -1, np.int32)
        out[:, : order.shape[1]] = np.where(
            np.isinf(np.take_along_axis(rank, order, 1)), -1, np.take_along_axis(ids, order, 1)
        )
        return out

    def _link_back(self, nodes: np.ndarray, chosen: np.ndarray, level: int) -> None:
        a, b = np.repeat(nodes, chosen.shape[1]), chosen.reshape(-1)
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        targets, first, counts = np.unique(b, return_index=True, return_counts=True)
        if not len(targets):
            return
        extra = np.full((len(targets), int(counts.max())), -1, np.int64)
        extra[np.repeat(np.arange(len(targets)), counts), np.arange(len(b)) - np.repeat(first, counts)] = a
        listed = self.links[level][targets]
        width = listed.shape[1] + extra.shape[1]
        chosen = np.empty_like(listed)
        rows = max(1, _FLOATS // (width * max(width, self.vectors.shape[1])))
        for i in range(0, len(targets), rows):
            at, before, new = targets[i : i + rows], listed[i : i + rows], extra[i : i + rows]
            # Two members of a batch may have named each other.
            new = np.where((new[:, :, None] == before[:, None, :]).any(axis=2), -1, new)
            ids = np.hstack([before, new])
            sims = np.einsum("bkd,bd->bk", self.vectors[np.maximum(ids, 0)], self.vectors[at])
            chosen[i : i + rows] = self._chosen(at, ids, np.where(ids >= 0, sims, _NONE), level)
        self.links[level][targets] = chosen

    def _walk(self, level: int, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` best nodes met from `start`, best first; -1 where fewer were met."""
        q, n = len(queries), len(self.vectors)
        rows = np.arange(q)[:, None]
        met = np.zeros((q, n + 1), bool)
        met[:, n] = True
        ids = np.full((q, beam), -1, np.int32)
        sims = np.full((q, beam), _NONE)
        open_ = np.zeros((q, beam), bool)
        width = min(beam, start.shape[1])
        ids[:, :width] = start[:, :width]
        there = ids[:, :width] >= 0
        sims[:, :width] = np.where(
            there, np.einsum("qkd,qd->qk", self.vectors[np.maximum(ids[:, :width], 0)], queries), _NONE
        )
        open_[:, :width] = there
        met[rows, np.where(there, ids[:, :width], n)] = True
        links = self.links[level]
        steps = min(_STEPS, beam)
        busy = np.flatnonzero(open_.any(axis=1))
        while len(busy):
            pick = np.argsort(np.where(open_[busy], -sims[busy], np.inf), axis=1)[:, :steps] if beam > 1 else np.zeros((len(busy), 1), int)
            wanted = np.take_along_axis(open_[busy], pick, 1)
            open_[busy[:, None], pick] = False
            near = links[np.maximum(np.take_along_axis(ids[busy], pick, 1), 0)]
            near = np.where(wanted[:, :, None], near, -1).reshape(len(busy), -1)
            near = np.where(near < 0, n, near)
            near.sort(axis=1)
            again = np.zeros(near.shape, bool)
            again[:, 1:] = near[:, 1:] == near[:, :-1]
            again |= met[busy[:, None], near]
            met[busy[:, None], near] = True
            fresh = ~again
            s = np.full(near.shape, _NONE)
            at = np.nonzero(fresh)
            s[at] = np.einsum("kd,kd->k", self.vectors[near[at]], queries[busy[at[0]]])
            all_ids = np.hstack([ids[busy], np.where(fresh, near, -1)])
            all_sims = np.hstack([sims[busy], s])
            all_open = np.hstack([open_[busy], fresh])
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[busy], sims[busy] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            open_[busy] = np.take_along_axis(all_open, best, 1)
            busy = busy[open_[busy].any(axis=1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(queries), 1), self.entry, np.int32)
        for level in range(int(self.levels[self.entry]), 0, -1):
            start = self._walk(level, queries, start, 1)[0]
        # From the entry too: what it reaches can be met by every query.
        start = np.hstack([start, np.where(start == self.entry, -1, self.entry)])
        return self._walk(0, queries, start, beam)

    @cached_property
    def lost(self) -> np.ndarray:
        """Nodes that no links lead to from the entry. Asked for once the graph is complete."""
        met = np.zeros(len(self.vectors), bool)
        now = np.array([self.entry])
        while len(now):
            met[now] = True
            near = np.unique(self.links[0][now])
            near = near[near >= 0]
            now = near[~met[near]]
        return np.flatnonzero(~met)

    def within(self, queries: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """Nodes with similarity of `least` or more, per query.

        A beam that ends above `least` may have left some out, so it is widened until its
        last node lies below. At half of the shard a beam is as dear as the shard itself, which is then read whole.
        Lost nodes are compared with every query.
        """
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        width = _STEPS * self.links[0].shape[1] * self.vectors.shape[1]
        together = max(8, min(256, 4 * _FLOATS // width))
        for begin in range(0, len(queries), together):
            todo, wide = np.arange(begin, min(begin + together, len(queries))), beam
            while len(todo):
                if 2 * wide >= len(self.vectors):
                    sims = queries[todo] @ self.vectors.T
                    for i, row in zip(todo, sims, strict=True):
                        out[i] = np.flatnonzero(row >= least)
                    break
                ids, sims = self.search(queries[todo], wide)
                whole = sims[:, -1] < least
                apart = queries[todo[whole]] @ self.vectors[self.lost].T >= least
                for i, row, s, more in zip(todo[whole], ids[whole], sims[whole], apart, strict=True):
                    out[i] = row[s >= least].astype(np.int64)
                    if more.any():
                        out[i] = np.union1d(out[i], self.lost[more])
                todo, wide = todo[~whole], 2 * wide
        return out
