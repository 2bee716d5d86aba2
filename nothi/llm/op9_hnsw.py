"""Nearest neighbours by a hierarchical navigable small-world graph per shard.

A shard holds some sixteen thousand distinct vectors (a parameter: memory is about a kilobyte a vector). Every node draws a top layer; each layer is a
flat array of neighbour numbers, a row per node. Nodes enter the graph in groups, high layers first: a group searches the graph as built so far, layer by layer, all
its nodes in step, looks at its own members too, and of the candidates keeps one only if it is nearer to the node than to any neighbour kept before; links run both
ways and lists that overflow are chosen anew by that rule. A group is at most a quarter of the graph. Nodes that the entry point would not reach
are linked from their nearest reached node by a last column. A shard's graph is written once. Queries visit the shards in rounds,
descend from the top layer, all queries of a block in step, and search the lowest with a list of ``ef``; the shards' results, with distances in
double precision on the original vectors, are merged. Every vector is indexed.

Vectors that are null, empty or zero, or hold a null or non-finite component, take no part; neither do null vec_ids. Rows that share the
query's vec_id are its own. Of rows that repeat a query's vec_id the smallest vector asks; repeated rows are each listed. Vectors of another length than the query's are not found
by it. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from nothi.llm import common, vectors

K, EVERY, SHARD, QUERIES = 10, 100, 16384, 32768
LINKS, CANDIDATES, EF, GROUP, STEP = 16, 40, 224, 1024, 512


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0)


class Graph:
    """layers[0] is the lowest; layers[l][node] holds neighbour numbers, -1 where there is none."""

    def __init__(self, rows: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = -1, links: int = LINKS, candidates: int = CANDIDATES, group: int = GROUP, seed: int = 1):
        self.x, self.layers, self.entry = np.ascontiguousarray(rows, np.float32), layers, entry
        self.norms = (self.x * self.x).sum(1)
        if layers is None:
            self._build(links, candidates, group, seed)

    def _build(self, links: int, candidates: int, group: int, seed: int) -> None:
        n, r = len(self.x), np.random.default_rng(seed)
        level = np.minimum((-np.log(r.random(n) + 1e-12) / math.log(links)).astype(int), 12)
        order = np.lexsort((r.random(n), -level))
        self.layers = [np.full((n, links * (1 if l else 2)), -1, np.int32) for l in range(level.max() + 1 if n else 0)]
        if not n:
            return
        self.entry, at = int(order[0]), 1
        while at < n:
            new = order[at : at + max(1, min(group, at // 4))]
            begin = np.full(len(new), self.entry)
            for l in reversed(range(len(self.layers))):
                here = np.flatnonzero(level[new] >= l)
                above = np.flatnonzero(level[new] < l)
                if len(above):
                    begin[above] = self._walk(self.layers[l], self.x[new[above]], begin[above], 1)[0][:, 0]
                if len(here):
                    near, far = self._walk(self.layers[l], self.x[new[here]], begin[here], candidates)
                    begin[here] = near[:, 0]
                    self._link(self.layers[l], new[here], near, far, links)
            at += len(new)
        self._join_up()

    def _link(self, flat: np.ndarray, nodes: np.ndarray, near: np.ndarray, far: np.ndarray, links: int) -> None:
        """Links a group's nodes to the best of what they found and of each other, and back."""
        if len(nodes) > 1:
            own = squared(self.x[nodes], self.x[nodes])
            np.fill_diagonal(own, np.inf)
            c = min(near.shape[1], len(nodes) - 1)
            mates = np.argpartition(own, c - 1, axis=1)[:, :c]
            near, far = np.concatenate([near, nodes[mates]], axis=1), np.concatenate([far, np.take_along_axis(own, mates, axis=1)], axis=1)
        to = self._chosen(near, far, links)
        flat[nodes, : to.shape[1]] = to
        a, k = np.nonzero(to >= 0)
        back, forth = to[a, k], nodes[a]
        self._add(flat, back, forth)

    def _add(self, flat: np.ndarray, at: np.ndarray, new: np.ndarray) -> None:
        """Adds new[i] to the list of at[i]; lists that overflow are chosen anew."""
        room = flat.shape[1]
        d = ((self.x[at] - self.x[new]) ** 2).sum(1)
        order = np.lexsort((d, at))
        at, new = at[order], new[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        # Of very many that come at once the nearest suffice to fill a list.
        held = place < room
        at, new, place = at[held], new[held], place[held]
        who, row = np.unique(at, return_inverse=True)
        both = np.full((len(who), room + place.max() + 1 if len(place) else room), -1, np.int64)
        both[:, :room] = flat[who]
        both[row, room + place] = new
        twice = (both[:, :room, None] == both[:, None, room:]).any(axis=1) & (both[:, room:] >= 0)
        both[:, room:][twice] = -1
        count = (both >= 0).sum(axis=1)
        fits = count <= room
        first = np.argsort(both[fits] < 0, axis=1, kind="stable")[:, :room]
        flat[who[fits]] = np.take_along_axis(both[fits], first, axis=1)
        who, both = who[~fits], both[~fits]
        for at_ in range(0, len(who), STEP):
            w, b = who[at_ : at_ + STEP], both[at_ : at_ + STEP]
            gap = np.where(b >= 0, self.norms[b] - 2 * np.einsum("qkd,qd->qk", self.x[b], self.x[w]) + self.norms[w][:, None], np.inf)
            flat[w] = self._chosen(b, gap, room)

    def _chosen(self, near: np.ndarray, far: np.ndarray, links: int) -> np.ndarray:
        """For each row of candidates and their distances the ones to link to, -1 where there are fewer."""
        out = np.full((len(near), links), -1, np.int32)
        for at in range(0, len(near), STEP):
            order = np.argsort(far[at : at + STEP], axis=1, kind="stable")
            cand, d = np.take_along_axis(near[at : at + STEP], order, axis=1), np.take_along_axis(far[at : at + STEP], order, axis=1)
            some = np.isfinite(d) & (cand >= 0)
            c = max(1, int(some.sum(axis=1).max(initial=0)))
            cand, d, some = cand[:, :c], d[:, :c], some[:, :c]
            y, norm = self.x[cand], self.norms[cand]
            between = norm[:, :, None] + norm[:, None, :] - 2 * (y @ y.transpose(0, 2, 1))
            kept, count = np.zeros(cand.shape, bool), np.zeros(len(cand), int)
            for j in range(c):
                kept[:, j] = some[:, j] & ~((between[:, j, :j] < d[:, j : j + 1]) & kept[:, :j]).any(axis=1) & (count < links)
                count += kept[:, j]
            # Places that are left go to the nearest of the others.
            kept |= some & ~kept & (np.cumsum(some & ~kept, axis=1) <= (links - count)[:, None])
            first = np.argsort(~kept, axis=1, kind="stable")[:, :links]
            out[at : at + STEP, : first.shape[1]] = np.where(np.take_along_axis(kept, first, axis=1), np.take_along_axis(cand, first, axis=1), -1)
        return out

    def _join_up(self) -> None:
        """A last column of the lowest layer, by which a walk from the entry point reaches every node."""
        flat = self.layers[0]
        reached, bridge = np.zeros(len(flat), bool), np.full(len(flat), -1, np.int32)
        front = np.array([self.entry])
        while True:
            while len(front):
                reached[front] = True
                to = np.unique(flat[front])
                to = to[to >= 0]
                front = to[~reached[to]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                break
            inside = np.flatnonzero(reached & (bridge < 0))
            d = squared(self.x[lost[:1]], self.x[inside])[0]
            bridge[inside[np.argmin(d)]] = lost[0]
            front = lost[:1]
        self.layers[0] = np.concatenate([flat, bridge[:, None]], axis=1)

    def _walk(self, flat: np.ndarray, queries: np.ndarray, begin: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer by all queries in step: (nodes, squared distances) by distance, -1 and inf where there is none."""
        q, n = len(queries), len(self.x)
        norms = self.norms
        own = (queries * queries).sum(1)
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, n + 1), bool)
        seen[:, n] = True
        best, d = np.full((q, ef), -1, np.int64), np.full((q, ef), np.inf, np.float32)
        done = np.ones((q, ef), bool)
        best[:, 0] = begin
        d[:, 0] = norms[begin] - 2 * (self.x[begin] * queries).sum(1) + own
        done[:, 0] = False
        seen[rows[:, 0], begin] = True
        live = np.arange(q)
        while len(live):
            at = np.argmin(np.where(done[live], np.inf, d[live]), axis=1)
            more = ~done[live, at]
            live, at = live[more], at[more]
            if not len(live):
                break
            done[live, at] = True
            to = flat[best[live, at]].astype(np.int64)
            to[to < 0] = n
            new = ~seen[live[:, None], to]
            seen[live[:, None], to] = True
            safe = np.where(new, to, 0)
            far = norms[safe] - 2 * np.einsum("qkd,qd->qk", self.x[safe], queries[live]) + own[live][:, None]
            far = np.where(new, far, np.inf)
            all_d, all_best = np.concatenate([d[live], far], axis=1), np.concatenate([best[live], safe], axis=1)
            all_done = np.concatenate([done[live], ~new], axis=1)
            first = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
            i = np.arange(len(live))[:, None]
            d[live], best[live], done[live] = all_d[i, first], all_best[i, first], all_done[i, first]
        order = np.argsort(d, axis=1)
        return best[rows, order], d[rows, order]

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """Nodes nearest to each query, -1 where there are fewer than ef."""
        queries, out = np.ascontiguousarray(queries, np.float32), []
        for at in range(0, len(queries), STEP):
            block = queries[at : at + STEP]
            begin = np.full(len(block), self.entry)
            for flat in reversed(self.layers[1:]):
                begin = self._walk(flat, block, begin, 1)[0][:, 0]
            nodes, d = self._walk(self.layers[0], block, begin, min(ef, len(self.x)))
            out.append(np.where(np.isinf(d), -1, nodes))
        return np.concatenate(out) if out else np.empty((0, ef), np.int64)


def shard_top(graph: Graph, x: np.ndarray, ids: np.ndarray, begin: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int = EF):
    """(query_id, vec_id, distance) of the k best of one shard for each query; node i has the vec_ids from begin[i] to begin[i + 1]."""
    out = ([], [], [])
    for query_id, query, nodes in zip(query_ids.tolist(), queries, graph.search(queries, max(ef, 2 * k))):
        nodes = nodes[nodes >= 0]
        d = np.sqrt(((x[nodes] - query) ** 2).sum(1))
        members, far = [], []
        for node, distance in zip(nodes.tolist(), d.tolist()):
            # Of equal vectors the smallest ids come first; the query's own rows are left out.
            same = ids[begin[node] : begin[node + 1]]
            same = same[same != query_id][:k]
            members.append(same)
            far.append(np.full(len(same), distance))
        if members:
            members, far = np.concatenate(members), np.concatenate(far)
            first = np.lexsort((members, far))[:k]
            for c, v in zip(out, (np.full(len(first), query_id), members[first], far[first])):
                c.append(v)
    return [np.concatenate(c) if c else np.empty(0) for c in out]


def search(vectors_: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD, query_rows: int = QUERIES, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = vectors.usable(vectors_, zero_too=False)
    candidates, shards = vectors.sharded(rows, shard_rows, k)

    def build(ids, copies, rows):
        x, node_of = np.unique(rows, axis=0, return_inverse=True)
        node_of, ids = np.repeat(node_of.ravel(), copies), np.repeat(ids, copies)
        order = np.lexsort((ids, node_of))
        begin = np.searchsorted(node_of[order], np.arange(len(x) + 1)).astype(np.int32)
        graph = Graph(x)
        widths = np.array([graph.entry, *(layer.shape[1] for layer in graph.layers)], np.int32)
        return ids[order], x, [begin, widths, *graph.layers]

    def visit(ids, x, lists, query_ids, queries):
        begin, (entry, *widths), *layers = lists
        return shard_top(Graph(x, [flat.reshape(-1, w) for flat, w in zip(layers, widths)], int(entry)), x, ids, begin, query_ids, queries, k, ef)

    return vectors.searched(vectors.indexed(candidates, shards, build), rows, every, query_rows, visit, "double", k, ascending=True)


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
