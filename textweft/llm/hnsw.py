"""A navigable small-world hierarchy over one shard, in flat numpy arrays.

Points are in random order and layer l holds the first n_l of them, so a layer
is a prefix.  Every layer stores ``2 * degree`` neighbours a point in one int32
array: ``degree`` chosen by the point itself, spread over directions, and
``degree`` that chose it; a place without a neighbour holds the point itself.
The top layer, of at most TOP points, is compared as a whole.

Searches run for groups of nearby queries at once: what one query of a group
reaches is compared with all of them, so distances are matrix products and a
round costs two passes over the product.  Points are inserted in batches, whose
points see one another directly; what an insertion finds is remembered for both
sides, so the graph knows its points' neighbours when it stands.
"""

from __future__ import annotations

import numpy as np

TOP = 256
NONE = np.float32(-3.0)


class Hierarchy:
    """Cosine similarity over unit vectors ``x`` (float32, one row a point).

    degree: links a point chooses; build: candidates an insertion keeps; keep:
    neighbours remembered for every point; batch: points inserted at once.
    """

    def __init__(self, x: np.ndarray, degree: int = 12, build: int = 32, keep: int = 6, shrink: int = 16, group: int = 128, batch: int = 2048, seed: int = 1):
        self.degree, self.build, self.keep, self.group, self.batch = degree, build, keep, group, batch
        self.order = np.random.default_rng(seed).permutation(len(x))
        self.x = np.ascontiguousarray(x[self.order])
        n = len(x)
        sizes = [n]
        while sizes[-1] > TOP:
            sizes.append(max(TOP, sizes[-1] // shrink))
        self.sizes = sizes[::-1]
        self.layers: list[np.ndarray] = []
        self.stamp = np.zeros(n, np.int32)
        self.mark = np.zeros(n, np.int32)
        self.tick = 0
        #: neighbours remembered (positions in the given ``x``, or those of guests) and their similarities
        self.best_i = np.full((n, keep), -1, np.int64)
        self.best_s = np.full((n, keep), NONE, np.float32)
        for size in self.sizes:
            self._layer(size, last=size == n)

    # -- building -------------------------------------------------------
    def _layer(self, size: int, last: bool) -> None:
        d = self.degree
        adj = np.repeat(np.arange(size, dtype=np.int32)[:, None], 2 * d, 1)
        done = self.sizes[len(self.layers) - 1] if self.layers else 0
        if done:
            adj[:done] = self.layers[-1]
            if last:
                # the upper layers' points have not met those below; they meet one another here
                self._remember_top(done)
        while done < size:
            upto = min(size, done + self.batch) if done else size
            fresh = np.arange(done, upto, dtype=np.int32)
            starts, order = self._descend(self.x[done:upto]) if self.layers else (None, np.arange(upto))
            forward = np.empty((upto - done, d), np.int32)
            near = np.empty((upto - done, d), np.float32)
            found = []
            for g in range(0, len(order), self.group):
                pick = order[g : g + self.group]
                entry = np.unique(starts[pick]) if starts is not None else fresh[:0]
                ids, sims = self._search(adj, self.x[done + pick], np.concatenate([entry, fresh]), self.build, own=len(entry) + pick)
                forward[pick], near[pick] = self._spread_out(ids, sims, done + pick)
                found.append((pick, ids, sims))
            if last:
                pick, ids, sims = (np.concatenate(part) for part in zip(*found, strict=True))
                self._remember(done + pick, ids, sims)
            adj[done:upto, :d] = forward
            self._reverse(adj, done, upto, forward, near)
            done = upto
        self.layers.append(adj)

    def _spread_out(self, ids: np.ndarray, sims: np.ndarray, me: np.ndarray):
        """Of each row's candidates, best first, ``degree`` that are nearer to the point than to one another; then the nearest of the rest."""
        d = self.degree
        out = np.repeat(me.astype(np.int32)[:, None], d, 1)
        near = np.full((len(ids), d), NONE, np.float32)
        real = sims > NONE
        v = self.x[np.where(real, ids, 0)]
        among = v @ v.transpose(0, 2, 1)
        kept = np.zeros(ids.shape, bool)
        most = np.full(ids.shape, NONE, np.float32)
        for c in range(ids.shape[1]):
            good = real[:, c] & (sims[:, c] > most[:, c])
            kept[:, c] = good
            np.maximum(most, among[:, :, c], out=most, where=good[:, None])
        rank = np.argsort(np.where(kept, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :d]
        fine = np.take_along_axis(real, rank, 1)
        w = rank.shape[1]
        out[:, :w] = np.where(fine, np.take_along_axis(ids, rank, 1), out[:, :w])
        near[:, :w] = np.where(fine, np.take_along_axis(sims, rank, 1), NONE)
        return out, near

    def _reverse(self, adj: np.ndarray, done: int, upto: int, forward: np.ndarray, near: np.ndarray) -> None:
        """Give every chosen point the nearest ``degree`` of those that chose it."""
        d = self.degree
        source = np.repeat(np.arange(done, upto, dtype=np.int32), d)
        target, sim = forward.ravel(), near.ravel()
        some = target != source
        source, target, sim = source[some], target[some], sim[some]
        old_t = np.unique(target)
        old = adj[old_t, d:]
        rows, cols = np.nonzero(old != old_t[:, None])
        if len(rows):
            o_t, o_s = old_t[rows], old[rows, cols]
            o_sim = np.einsum("ij,ij->i", self.x[o_t], self.x[o_s])
            source, target, sim = np.concatenate([o_s, source]), np.concatenate([o_t, target]), np.concatenate([o_sim, sim])
        keep, rank = first_of(target, sim, d)
        adj[old_t, d:] = old_t[:, None]
        adj[target[keep], d + rank] = source[keep]

    # -- what is found on the way ---------------------------------------
    def _remember_top(self, n: int) -> None:
        """Neighbours of the points of the upper layers among one another."""
        for a in range(0, n, self.group):
            upto = min(n, a + self.group)
            pick = np.arange(a, upto)
            start = np.unique(np.concatenate([pick, self.layers[-1][pick, : self.degree].ravel()])).astype(np.int32)
            ids, sims = self._search(self.layers[-1], self.x[a:upto], start, self.build, own=np.searchsorted(start, pick))
            self._merge(pick, ids, sims)

    def _remember(self, me: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Take over what the new points ``me`` found, and offer them to what they found.

        Points of one batch see all of one another, so of those only their own side counts.
        """
        self._merge(me, ids, sims)
        source = np.repeat(me, ids.shape[1])
        target, sim = ids.ravel(), sims.ravel()
        self.offer(self.order[source], target, sim, (sim > NONE) & (target < me.min()))

    def _merge(self, me: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        w = min(self.keep, ids.shape[1])
        self.best_s[me, :w] = sims[:, :w]
        self.best_i[me, :w] = np.where(sims[:, :w] > NONE, self.order[np.maximum(ids[:, :w], 0)], -1)

    def offer(self, name: np.ndarray, target: np.ndarray, sim: np.ndarray, some: np.ndarray) -> None:
        """Put ``name`` into the lists of the points ``target`` where it is nearer than what is there."""
        some = np.flatnonzero(some)
        some = some[sim[some] > self.best_s[target[some], -1]]
        if not len(some):
            return
        name, target, sim = name[some], target[some], sim[some]
        touched = np.unique(target)
        target = np.concatenate([np.repeat(touched, self.keep), target])
        name = np.concatenate([self.best_i[touched].ravel(), name])
        sim = np.concatenate([self.best_s[touched].ravel(), sim])
        keep, rank = first_of(target, sim, self.keep)
        self.best_i[target[keep], rank] = name[keep]
        self.best_s[target[keep], rank] = sim[keep]

    # -- searching ------------------------------------------------------
    def _descend(self, q: np.ndarray, starts: int = 3):
        """Entry points in the lowest finished layer for each query, and an order that puts nearby queries together."""
        top = self.sizes[0]
        starts = min(starts, top)
        entry = np.empty((len(q), starts), np.int32)
        for a in range(0, len(q), 4096):
            s = q[a : a + 4096] @ self.x[:top].T
            p = np.argpartition(-s, starts - 1, axis=1)[:, :starts] if starts < top else np.broadcast_to(np.arange(top), s.shape)
            o = np.argsort(-np.take_along_axis(s, p, 1), axis=1)
            entry[a : a + 4096] = np.take_along_axis(p, o, 1)
        order = np.argsort(entry[:, 0], kind="stable")
        for adj in self.layers[1:]:
            fresh = np.empty_like(entry)
            for g in range(0, len(order), self.group):
                pick = order[g : g + self.group]
                ids, _ = self._search(adj, q[pick], np.unique(entry[pick]), max(8, starts))
                fresh[pick] = ids[:, :starts]
            fresh = np.where(fresh >= 0, fresh, entry)
            order = order[np.lexsort((fresh[order, 0], entry[order, 0]))]
            entry = fresh
        return entry, order

    def _search(self, adj: np.ndarray, q: np.ndarray, ids: np.ndarray, ef: int, own: np.ndarray | None = None, rounds: int = 20):
        """The best ``ef`` found for each query of a group, best first; -1 where there are fewer.

        ids: distinct points to start from.  own: the place in ``ids`` of the
        point each query is, which is no result.  Every point that is among the
        best of a query when it is met is followed once, until none is new.
        """
        self.tick += 1
        tick, stamp, mark = self.tick, self.stamp, self.mark
        row = np.arange(len(q))
        top_s = np.full((len(q), ef), NONE, np.float32)
        top_i = np.full((len(q), ef), -1, np.int32)
        stamp[ids] = tick
        for turn in range(rounds):
            s = q @ self.x.take(ids, axis=0).T
            if turn:
                # most of what is met later is near to none
                some = (s > worst[:, None]).any(0)  # noqa: F821
                ids, s = ids[some], s.compress(some, axis=1)
                if not len(ids):
                    break
            elif own is not None:
                s[row, own] = NONE
            both = np.concatenate([top_s, s], axis=1)
            w = both.shape[1]
            worst = np.partition(both, w - ef, axis=1)[:, w - ef]
            at = np.flatnonzero(both >= worst[:, None])
            if len(at) != top_s.size:  # ties
                at = (np.sort(np.argpartition(both, w - ef, axis=1)[:, w - ef :], axis=1) + row[:, None] * w).ravel()
            top_s = both.ravel()[at].reshape(top_s.shape)
            col = at.reshape(top_s.shape) - row[:, None] * w
            old = col < ef
            top_i = np.where(old, np.take_along_axis(top_i, np.minimum(col, ef - 1), 1), ids[np.maximum(col - ef, 0)])
            fresh = np.zeros(len(ids), bool)
            fresh[col[~old] - ef] = True
            nb = adj.take(ids[fresh], axis=0).ravel()
            nb = nb[stamp[nb] != tick]
            if not len(nb):
                break
            k = np.arange(len(nb), dtype=np.int32)
            mark[nb] = k
            ids = nb[mark[nb] == k]
            stamp[ids] = tick
        o = np.argsort(-top_s, axis=1)
        top_s = np.take_along_axis(top_s, o, 1)
        return np.where(top_s > NONE, np.take_along_axis(top_i, o, 1), -1), top_s

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """What is remembered for every point, best first: positions (-1 where there are fewer) and similarities."""
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(back))
        return self.best_i[back], self.best_s[back]

    def query(self, q: np.ndarray, k: int, ef: int = 32, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``k`` nearest points found (positions in the given ``x``) and their similarities.

        With ``names`` the queries are offered, by these, to the points they find.
        """
        ef = max(ef, k)
        out_i = np.full((len(q), k), -1, np.int64)
        out_s = np.full((len(q), k), NONE, np.float32)
        if not len(self.x) or not len(q):
            return out_i, out_s
        layers, self.layers = self.layers, self.layers[:-1]
        entry, order = self._descend(q) if self.layers else (np.zeros((len(q), 1), np.int32), np.arange(len(q)))
        self.layers = layers
        for g in range(0, len(order), self.group):
            pick = order[g : g + self.group]
            start = np.unique(entry[pick]) if len(layers) > 1 else np.arange(len(self.x), dtype=np.int32)
            ids, sims = self._search(layers[-1], q[pick], start, ef)
            out_i[pick] = np.where(ids[:, :k] >= 0, self.order[np.maximum(ids[:, :k], 0)], -1)
            out_s[pick] = sims[:, :k]
            if names is not None:
                self.offer(np.repeat(names[pick], ids.shape[1]), ids.ravel(), sims.ravel(), sims.ravel() > NONE)
        return out_i, out_s


def first_of(group: np.ndarray, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ``most`` largest values of each group, and their rank in it."""
    order = np.lexsort((-value, group))
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    keep = rank < most
    return order[keep], rank[keep]
