"""A hierarchical navigable small-world graph over unit vectors, built and searched for many vectors at a time."""

from __future__ import annotations

import io

import numpy as np

LINKS, BUILD_BEAM, RATIO, TOP = 16, 48, 16, 256
LANES, EXPAND = 512, 4
REPAIRS = 4  # links that a node takes on for nodes which no walk reaches


def similarities(vectors, ids, queries) -> np.ndarray:
    """Of each query to the vectors of its row of ``ids``; any number for -1."""
    return np.matmul(vectors.take(ids, axis=0, mode="wrap"), queries[:, :, None])[:, :, 0]


def search_level(vectors, neighbours, queries, entries, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of a beam search in one level, best first; -1 where fewer were reached.

    ``entries`` has the starting ids of each query, -1 for none.
    """
    out_ids, out_sims = [], []
    for low in range(0, len(queries), LANES):
        q = queries[low : low + LANES]
        start = entries[low : low + LANES]
        n, width = len(q), max(beam, start.shape[1])
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf, np.float32)
        ids[:, : start.shape[1]] = start
        there = start >= 0
        sims[:, : start.shape[1]] = np.where(there, np.einsum("qd,qed->qe", q, vectors[start]), -np.inf)
        done = ids < 0
        seen = np.zeros((n, len(vectors) + 1), bool)  # the last column takes the -1
        seen[np.arange(n)[:, None], start] = True
        active = np.arange(n)
        while len(active):
            open_sims = np.where(done[active], -np.inf, sims[active])
            best = np.argpartition(-open_sims, min(EXPAND, width - 1), axis=1)[:, :EXPAND]
            going = np.isfinite(np.take_along_axis(open_sims, best, 1))
            alive = going.any(1)
            active, best, going = active[alive], best[alive], going[alive]
            if not len(active):
                break
            rows = active[:, None]
            found = np.where(going[:, :, None], neighbours[ids[rows, best]], -1).reshape(len(active), -1)
            done[rows, best] = True
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[rows, found]] = -1
            found = -np.sort(-found, axis=1)  # most have been seen: only what is new is compared
            found = found[:, : int((found >= 0).sum(1).max(initial=0))]
            seen[rows, found] = True
            new = np.where(found >= 0, similarities(vectors, found, q[active]), np.float32(-np.inf))
            all_sims = np.concatenate([sims[active], new], axis=1)
            all_ids = np.concatenate([ids[active], found], axis=1)
            all_done = np.concatenate([done[active], found < 0], axis=1)
            keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            keep += np.arange(len(active))[:, None] * all_sims.shape[1]
            sims[active], ids[active], done[active] = all_sims.take(keep), all_ids.take(keep), all_done.take(keep)
        order = np.argsort(-sims, axis=1)[:, :beam]
        out_ids.append(np.where(np.isfinite(np.take_along_axis(sims, order, 1)), np.take_along_axis(ids, order, 1), -1))
        out_sims.append(np.take_along_axis(sims, order, 1))
    if not out_ids:
        return np.zeros((0, beam), np.int64), np.zeros((0, beam), np.float32)
    return np.concatenate(out_ids), np.concatenate(out_sims)


def choose(vectors, candidates, sims, links: int) -> np.ndarray:
    """Of each row's candidates (best first) those not closer to one already chosen, then the best of the rest."""
    n, c = candidates.shape
    own = vectors.take(candidates, axis=0, mode="wrap")
    between = np.matmul(own, own.transpose(0, 2, 1))
    chosen = np.zeros((n, c), bool)
    for i in range(c):
        close = np.where(chosen, between[:, i, :], -np.inf).max(1)
        chosen[:, i] = (candidates[:, i] >= 0) & (close < sims[:, i]) & (chosen.sum(1) < links)
    rank = np.where(candidates < 0, 3 * c, np.where(chosen, 0, c) + np.arange(c))
    order = np.argsort(rank, axis=1)[:, :links]
    picked = np.take_along_axis(candidates, order, 1)
    return picked


class Graph:
    """Levels from the lowest up: node ids of the level, and neighbours by place in the level."""

    def __init__(self, vectors: np.ndarray, seed: int = 7, links: int = LINKS, beam: int = BUILD_BEAM):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        order = np.random.default_rng(seed).permutation(len(vectors))
        self.nodes, self.neighbours = [], []
        members = order
        while True:
            self.nodes.append(members)
            if len(members) <= TOP:
                break
            members = members[: max(TOP, len(members) // RATIO)]
        for level in range(len(self.nodes) - 1, -1, -1):
            self.neighbours.insert(0, self._link(level, 2 * links if level == 0 else links, links, beam))

    def _link(self, level, width, links, beam):
        """Insert a level's nodes in growing batches; each is linked to what a beam search and its own batch offer."""
        own = self.vectors[self.nodes[level]]
        n = len(own)
        neighbours = np.full((n, width), -1, np.int64)
        done = 0
        while done < n:
            batch = np.arange(done, min(n, max(done * 2, TOP), done + 2048))
            near = own[batch] @ own[batch].T
            np.fill_diagonal(near, -np.inf)
            k = min(beam, len(batch) - 1)
            ids = sims = None
            if k > 0:
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                ids, sims = batch[top], np.take_along_axis(near, top, 1)
            if done:
                far_ids, far_sims = search_level(own[:done], neighbours[:done], own[batch], self._entries(level, own[batch], done), beam)
                ids = far_ids if ids is None else np.concatenate([ids, far_ids], axis=1)
                sims = far_sims if sims is None else np.concatenate([sims, far_sims], axis=1)
            if ids is not None:
                order = np.argsort(-sims, axis=1)[:, :beam]
                picked = choose(own, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), links)
                neighbours[batch, : picked.shape[1]] = picked
                self._back(own, neighbours, batch, picked)
            done = batch[-1] + 1
        return self._repair(own, neighbours)

    @staticmethod
    def _repair(own, neighbours):
        """Every node is reached from the first and has a link to it: where not, the nearest reached node links to it."""
        n = len(own)
        reached = np.zeros(n, bool)
        linked = np.bincount(neighbours[neighbours >= 0], minlength=n) > 0
        taken = np.zeros(n, int)
        extra = np.full((n, REPAIRS), -1, np.int64)

        def walk(nodes):
            while len(nodes):
                reached[nodes] = True
                nodes = np.unique(np.concatenate([neighbours[nodes].ravel(), extra[nodes].ravel()]))
                nodes = nodes[nodes >= 0]
                nodes = nodes[~reached[nodes]]

        walk(np.zeros(1, int))
        while n > 1:
            lost = np.flatnonzero(~reached | ~linked)
            if not len(lost):
                break
            hosts = np.flatnonzero(reached & (taken < REPAIRS))
            found = []
            for low in range(0, len(lost), 256):
                part = lost[low : low + 256]
                sims = own[part] @ own[hosts].T
                sims[part[:, None] == hosts] = -np.inf
                found.append(np.where(np.isfinite(sims).any(1), hosts[sims.argmax(1)], -1))
            host = np.concatenate(found)
            lost, host = lost[host >= 0], host[host >= 0]
            order = np.argsort(host, kind="stable")
            lost, host = lost[order], host[order]
            starts = np.flatnonzero(np.append(True, host[1:] != host[:-1]))
            slot = taken[host] + np.arange(len(host)) - np.repeat(starts, np.diff(np.append(starts, len(host))))
            lost, host, slot = (x[slot < REPAIRS] for x in (lost, host, slot))
            extra[host, slot] = lost
            np.add.at(taken, host, 1)
            linked[lost] = True
            walk(lost[~reached[lost]])
        return np.concatenate([neighbours, extra[:, : taken.max(initial=0)]], axis=1)

    @staticmethod
    def _back(own, neighbours, batch, picked):
        """Links back; a node with too many keeps its own choice of them."""
        to, back = picked.ravel(), np.repeat(batch, picked.shape[1])
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        if not len(to):
            return
        starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        sizes = np.diff(np.append(starts, len(to)))
        width, nodes = neighbours.shape[1], to[starts]
        for low in range(0, len(nodes), 1024):
            part, s, z = nodes[low : low + 1024], starts[low : low + 1024], np.minimum(sizes[low : low + 1024], 4 * width)
            extra = np.full((len(part), z.max()), -1, np.int64)
            at = np.arange(z.max())[None, :]
            inside = at < z[:, None]
            extra[inside] = back[(s[:, None] + at)[inside]]
            all_ids = np.concatenate([neighbours[part], extra], axis=1)
            all_ids.sort(axis=1)
            all_ids[:, 1:][all_ids[:, 1:] == all_ids[:, :-1]] = -1
            sims = np.where(all_ids >= 0, similarities(own, all_ids, own[part]), np.float32(-np.inf))
            order = np.argsort(-sims, axis=1)[:, : 2 * width]
            all_ids, sims = np.take_along_axis(all_ids, order, 1), np.take_along_axis(sims, order, 1)
            full = (all_ids >= 0).sum(1) > width
            keep = all_ids[:, :width].copy()
            if full.any():
                keep[full] = choose(own, all_ids[full], sims[full], width)
            neighbours[part] = keep

    def _entries(self, level, queries, limit=None):
        """Starting places in ``level`` for each query, from the levels above: their nodes come first in every level."""
        top = len(self.nodes) - 1
        if level == top:
            return np.zeros((len(queries), 1), np.int64)
        own = self.vectors[self.nodes[top]]
        places = np.argsort(-(queries @ own.T), axis=1)[:, :2]
        for k in range(top - 1, level, -1):
            places, _ = search_level(self.vectors[self.nodes[k]], self._at(k), queries, places, 8)
            places = places[:, :2]
        if limit is not None and limit < len(self.nodes[level + 1]):
            places = np.where(places < limit, places, 0)
        return places

    def _at(self, level):
        return self.neighbours[level - len(self.nodes)]  # the upper levels are there first

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector numbers, similarities) of each query's beam in the lowest level."""
        q = np.ascontiguousarray(queries, np.float32)
        ids, sims = search_level(self.vectors[self.nodes[0]], self.neighbours[0], q, self._entries(0, q), beam)
        return np.where(ids >= 0, self.nodes[0][ids], -1), sims

    def to_bytes(self, whole: bool = True) -> bytes:
        """Without the vectors unless ``whole``: they are then given to ``from_bytes`` again."""
        out = io.BytesIO()
        np.savez(out, levels=len(self.nodes), **({"vectors": self.vectors} if whole else {}),
                 **{f"nodes{i}": x.astype(np.int32) for i, x in enumerate(self.nodes)},
                 **{f"links{i}": x.astype(np.int32) for i, x in enumerate(self.neighbours)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, vectors: np.ndarray | None = None) -> Graph:
        found, self = np.load(io.BytesIO(data)), cls.__new__(cls)
        levels = int(found["levels"])
        self.vectors = found["vectors"] if vectors is None else np.ascontiguousarray(vectors, np.float32)
        self.nodes = [found[f"nodes{i}"].astype(np.int64) for i in range(levels)]
        self.neighbours = [found[f"links{i}"].astype(np.int64) for i in range(levels)]
        return self
