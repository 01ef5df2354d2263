"""Shortest paths of a graph that falls into small pieces without a few hubs, as arrays.

What a piece sees of a source elsewhere is how far each hub is from it and by how many shortest paths; what a source sees of a vertex elsewhere is how far it is
from each hub and by how many paths without a hub between. So vertices fall into classes, searches stay within a piece and the hubs, and the sums over all
sources and vertices are exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Numbers of hubs that are tried; vertices that pieces are joined up to, and up to which one is a matrix; columns and cells of a step; distance of what isn't reached.
HUBS, JOINED, MATRIX, COLUMNS, CELLS, NEVER = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32), 96, 1024, 256, 1 << 22, 1 << 20
#: How many times cheaper than a search of the whole graph from each vertex the pieces must be.
GAIN = 16


def _components(a: np.ndarray, b: np.ndarray, n: int, inner: np.ndarray) -> np.ndarray:
    """The smallest vertex that each one of inner hangs together with inside of it."""
    on = inner[a] & inner[b]
    a, b, label = a[on], b[on], np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def _spread(a: np.ndarray, b: np.ndarray, n: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances from start along a to b, and how many shortest paths there are."""
    far, paths, hops = np.full(n, NEVER, np.int32), np.zeros(n), 0
    far[start], paths[start] = 0, 1.0
    front = paths
    while True:
        on = front[a] > 0
        got = np.bincount(b[on], front[a[on]], n)
        new = (got > 0) & (far == NEVER)
        if not new.any():
            return far, paths
        hops += 1
        far[new] = hops
        front = np.where(new, got, 0.0)
        paths = paths + front


def _classes(*rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each column of rows that are equal, and a column of each class."""
    code = np.zeros(rows[0].shape[1], np.int64)
    for row in (x for r in rows for x in r):
        own = np.unique(row, return_inverse=True)[1].reshape(-1)
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1].reshape(-1)
    return code, np.unique(code, return_index=True)[1]


def hubs(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray | None:
    """The vertices of the highest degrees without which a graph is searched in pieces at the least cost; None if that gains little."""
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    order, best = np.argsort(-degree, kind="stable"), None
    most = n * (n + len(a)) / GAIN
    for q in HUBS:
        if q > n:
            break
        inner = np.ones(n, bool)
        inner[order[:q]] = False
        label = _components(a, b, n, inner)
        size = np.bincount(label[inner], minlength=n).astype(float)
        arcs = np.bincount(label[a[inner[a] & inner[b]]], minlength=n)
        cost = float((size * (size * (1 + q) + arcs)).sum())
        if best is None or cost < best[0]:
            best = cost, order[:q]
    if best is None or best[0] > most:
        return None
    g = Pieces(a, b, n, best[1])
    return best[1] if len(g.sources) * len(g.targets) * max(len(best[1]), 1) <= most else None


class Pieces:
    """A graph's arcs a to b, without loops and repeats, and its hubs."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int, hubs: np.ndarray, counted: bool = True):
        """counted: classes tell numbers of paths, not of distances only."""
        self.n, self.hubs, self.q = n, hubs, len(hubs)
        q, number = self.q, np.full(n, -1)
        number[hubs] = np.arange(q)
        inner = number < 0
        self._laid_out(a, b, number, inner)
        none = (np.zeros((q, n), np.int32), np.zeros((q, n)))
        stack = lambda found: tuple(map(np.stack, zip(*found, strict=True))) if found else none
        #: To each hub from everywhere; from each hub, and to it, without a hub between: distances and numbers of paths, a row a hub.
        self.to, self.to_paths = stack([_spread(b, a, n, h) for h in hubs])
        self.out, self.out_paths = stack([_spread(a[x], b[x], n, h) for h in hubs for x in [inner[b] & (inner[a] | (a == h))]])
        self.back, self.back_paths = stack([_spread(b[x], a[x], n, h) for h in hubs for x in [inner[a] & (inner[b] | (b == h))]])
        #: From hub to hub without one between: distances and numbers of paths.
        self.leap, self.leaps = np.full((q, q), NEVER), np.zeros((q, q))
        for x, y in zip(number[a[~inner[a] & ~inner[b]]], number[b[~inner[a] & ~inner[b]]], strict=True):
            self.leap[x, y], self.leaps[x, y] = 1, 1.0
        v, h = self.ends_out
        for x in range(q):
            for y in range(q):
                far = self.out[x, v[h == y]] + 1
                if x != y and len(far) and (least := far.min()) < NEVER and least <= self.leap[x, y]:
                    more = self.out_paths[x, v[h == y]][far == least].sum()
                    self.leap[x, y], self.leaps[x, y] = least, more + (self.leaps[x, y] if least == self.leap[x, y] else 0.0)
        vertices = np.flatnonzero(inner)
        self.source, self.sources = _classes(self.to, *((self.to_paths,) if counted else ())) if q else (np.zeros(n, int), np.zeros(1, int))
        self.target, found = _classes(self.out[:, vertices], *((self.out_paths[:, vertices],) if counted else ())) if q else (np.zeros(0, int), np.zeros(0, int))
        self.targets = vertices[found]
        self.of_source, self.of_target = np.bincount(self.source, minlength=len(self.sources)), np.bincount(self.target, minlength=len(found))
        self._seen: dict[bytes, tuple] = {}

    def _laid_out(self, a: np.ndarray, b: np.ndarray, number: np.ndarray, inner: np.ndarray) -> None:
        """Vertices by pieces, small ones that the same hubs lead to joined."""
        n = self.n
        label, vertices = _components(a, b, n, inner), np.flatnonzero(inner)
        led, mask = ~inner[a] & inner[b], np.zeros(n, np.int64)
        np.bitwise_or.at(mask, label[b[led]], np.int64(1) << number[a[led]])
        size = np.bincount(label[vertices], minlength=n)
        full = np.flatnonzero(size)
        full = full[np.lexsort((full, mask[full]))]
        before = np.cumsum(size[full]) - size[full]
        key = _classes(np.stack([mask[full], before // JOINED]))[0] if len(full) else full
        of = np.zeros(n, np.int64)
        of[full] = key
        piece = np.where(inner, of[label], -1)
        self.count = int(key.max(initial=-1)) + 1
        self.own = vertices[np.argsort(piece[vertices], kind="stable")]
        self.first = np.searchsorted(piece[self.own], np.arange(self.count + 1))
        self.place = np.full(n, -1)
        self.place[self.own] = np.arange(len(self.own)) - self.first[piece[self.own]]

        def sorted_by(at: np.ndarray, *more: np.ndarray) -> tuple:
            order = np.argsort(piece[at], kind="stable")
            return (*(x[order] for x in more), np.searchsorted(piece[at][order], np.arange(self.count + 1)))

        both, out = inner[a] & inner[b], inner[a] & ~inner[b]
        self.arcs = sorted_by(a[both], self.place[a[both]], self.place[b[both]])
        self.led = sorted_by(b[led], self.place[b[led]], number[a[led]])
        self.leave = sorted_by(a[out], self.place[a[out]], number[b[out]], a[out])
        self.ends_out = self.leave[2], self.leave[1]

    def piece(self, k: int | None) -> tuple:
        """Vertices of a piece (none: none), pushes along its arcs and against them, which hubs lead to a vertex and which it leads to."""
        if k is None:
            return np.zeros(0, int), lambda x: x, lambda x: x, np.zeros((0, self.q)), np.zeros((0, self.q))
        cut = lambda x: [c[x[-1][k] : x[-1][k + 1]] for c in x[:-1]]
        ids, (a, b) = self.own[self.first[k] : self.first[k + 1]], cut(self.arcs)
        led, leave = np.zeros((len(ids), self.q)), np.zeros((len(ids), self.q))
        (v, h), (w, g, _) = cut(self.led), cut(self.leave)
        led[v, h], leave[w, g] = 1.0, 1.0
        if not len(a):
            return ids, np.zeros_like, np.zeros_like, led, leave
        if len(ids) <= MATRIX:
            matrix = np.zeros((len(ids), len(ids)))
            matrix[b, a] = 1.0
            return ids, lambda x: matrix @ x, lambda x: matrix.T @ x, led, leave
        from .graph import _pusher

        return ids, _pusher(a, b, np.add), _pusher(b, a, np.add), led, leave

    def forward(self, push: Callable, led: np.ndarray, far_hubs: np.ndarray, hub_paths: np.ndarray, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Distances (-1: never) and numbers of paths of a piece's vertices, a column a source: one of the piece, or one elsewhere (start is None)."""
        far, paths = np.full((len(led), far_hubs.shape[1]), -1, np.int32), np.zeros((len(led), far_hubs.shape[1]))
        if start is not None:
            far[start, np.arange(len(start))], paths[start, np.arange(len(start))] = 0, 1.0
        front, hops, last = paths, 0, int(np.where(far_hubs < NEVER, far_hubs, -1).max(initial=-1))
        while True:
            got = push(front) + led @ np.where(far_hubs == hops, hub_paths, 0.0)
            new, hops = (got > 0) & (far < 0), hops + 1
            if not new.any() and hops > last:
                return far, paths, hops
            far[new] = hops
            front = np.where(new, got, 0.0)
            paths = paths + front

    def _shares(self, far_hubs: np.ndarray, hub_paths: np.ndarray, far: np.ndarray, paths: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What is owed to each hub as the last one before vertices elsewhere, by rows of hubs: for each column of sources."""
        out, some = np.zeros(far_hubs.shape), max(1, CELLS // max(1, self.q * far.shape[1]))
        for k in range(0, far_hubs.shape[1], some):
            own = slice(k, k + some)
            total = far_hubs[:, own, None] + far[:, None]
            least = total.min(0)
            way = np.where((total == least) & (least < NEVER), paths[:, None], 0.0)
            sigma = np.einsum("hsv,hs->sv", way, hub_paths[:, own])
            out[:, own] = np.einsum("hsv,sv->hs", way, np.divide(weight, sigma, out=np.zeros_like(sigma), where=sigma > 0))
        return out

    def elsewhere(self, kinds: np.ndarray) -> np.ndarray:
        """_shares of all vertices for classes of sources."""
        s, t = self.sources[kinds], self.targets
        return self._shares(self.to[:, s], self.to_paths[:, s], self.out[:, t], self.out_paths[:, t], self.of_target)

    def between(self, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Two hubs and how many of the paths from one to the other, without a hub between, go through each of ids."""
        for x, y in zip(*np.nonzero(self.leaps), strict=True):
            on = self.out[x, ids] + self.back[y, ids] == self.leap[x, y]
            yield x, y, np.where(on, self.out_paths[x, ids] * self.back_paths[y, ids], 0.0)

    def _visitors(self, k: int, ids: np.ndarray, led: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sources elsewhere as far as a piece can tell them apart: how far hubs are, numbers of paths (as shares), how many sources."""
        on = led.any(0)
        if on.tobytes() not in self._seen:
            far, paths = self.to[:, self.sources], np.where(on[:, None], self.to_paths[:, self.sources], 0.0)
            far = np.where(on[:, None], far, NEVER)
            far = np.where(far < NEVER, far - far.min(0), NEVER)
            paths = np.where(far < NEVER, paths / np.maximum(paths.max(0), 1.0), 0.0)
            kind, first = _classes(far, paths)
            self._seen[on.tobytes()] = kind, far[:, first], paths[:, first], np.bincount(kind, self.of_source)
        kind, far, paths, many = self._seen[on.tobytes()]
        many = many - np.bincount(kind[self.source[ids]], minlength=len(many))
        on = (many > 0) & (far < NEVER).any(0)
        return far[:, on], paths[:, on], many[on]

    def owed(self, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """What all searches owe to each vertex and to each two hubs, as told by one of so many parts of the pieces. What vertices between two
        hubs are owed for those comes last (across), when all parts are known."""
        out, leaps, q = np.zeros(self.n), np.zeros((self.q, self.q)), self.q
        mine = [*range(part, self.count, parts), *([None] if part == 0 and q else [])]
        kinds = np.unique(np.concatenate([self.source[self.hubs if k is None else self.own[self.first[k] : self.first[k + 1]]] for k in mine] or [np.zeros(0, int)]))
        table = self.elsewhere(kinds) if q else np.zeros((0, len(kinds)))
        for k in mine:
            ids, push, pull, led, leave = self.piece(k)
            inside, every = np.zeros((q, q)), self.hubs if k is None else ids
            for x in range(q):
                inside[x] = np.where(self.out[x, ids][:, None] + 1 == self.leap[x], self.out_paths[x, ids][:, None] * leave, 0.0).sum(0)
            own_leaps, around = np.zeros((q, q)), self.leaps - inside
            for c in range(0, len(every), COLUMNS):
                s = every[c : c + COLUMNS]
                hub_far, hub_paths = self.to[:, s], self.to_paths[:, s]
                far, paths, hops = self.forward(push, led, hub_far, hub_paths, None if k is None else np.arange(c, c + len(s)))
                owed, hub_owed = np.zeros_like(paths), table[:, np.searchsorted(kinds, self.source[s])]
                if q and len(ids):
                    hub_owed = hub_owed - self._shares(hub_far, hub_paths, self.out[:, ids], self.out_paths[:, ids], np.ones(len(ids)))
                for d in range(hops, 0, -1):
                    given = np.divide(1.0, paths, out=np.zeros_like(paths), where=far == d)
                    given[far == d] += owed[far == d]
                    at = hub_far == d
                    hub_given = np.where(at, np.divide(1.0, hub_paths, out=np.zeros_like(hub_paths), where=at) + hub_owed, 0.0)
                    owed += np.where(far == d - 1, pull(given) + leave @ hub_given, 0.0)
                    more = np.where(hub_far == d - 1, led.T @ given, 0.0)
                    if at.any():
                        for x in range(q):
                            step = np.where(hub_far[x] + self.leap[x][:, None] == d, hub_given, 0.0)
                            more[x] += around[x] @ step
                            own_leaps[x] += step @ np.where(hub_far[x] < NEVER, hub_paths[x], 0.0)
                    hub_owed = hub_owed + more
                out[ids] += np.where(far > 0, paths * owed, 0.0).sum(1)
                out[self.hubs] += np.where((hub_far > 0) & (hub_far < NEVER), hub_paths * hub_owed, 0.0).sum(1)
            leaps += own_leaps
            if not len(ids) or not q:
                continue
            for x, y, through in self.between(ids):
                out[ids] -= own_leaps[x, y] * through
            hub_far, hub_paths, many = self._visitors(k, ids, led)
            for c in range(0, len(many), COLUMNS):
                own = slice(c, c + COLUMNS)
                far, paths, hops = self.forward(push, led, hub_far[:, own], hub_paths[:, own], None)
                owed = np.zeros_like(paths)
                for d in range(hops, 1, -1):
                    given = np.divide(1.0, paths, out=np.zeros_like(paths), where=far == d)
                    given[far == d] += owed[far == d]
                    owed += np.where(far == d - 1, pull(given), 0.0)
                out[ids] += (paths * owed) @ many[own]
        return out, leaps

    def across(self, leaps: np.ndarray) -> np.ndarray:
        """What vertices are owed as ways between two hubs for all searches."""
        out = np.zeros(self.n)
        for x, y, through in self.between(self.own):
            out[self.own] += leaps[x, y] * through
        return out

    def reached(self, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sources of one of so many parts of the pieces: how many vertices each reaches, and the sum of their distances."""
        told, t = [], self.targets
        cost: dict[int, tuple[int, int]] = {}
        for k in [*range(part, self.count, parts), *([None] if part == 0 and self.q else [])]:
            ids, push, _, led, _ = self.piece(k)
            every = self.hubs if k is None else ids
            for c in range(0, len(every), COLUMNS):
                s = every[c : c + COLUMNS]
                hub_far = self.to[:, s]
                far = self.forward(push, led, hub_far, np.minimum(self.to_paths[:, s], 1.0), None if k is None else np.arange(c, c + len(s)))[0]
                r, total = (far > 0).sum(0), np.where(far > 0, far, 0).sum(0, dtype=np.int64)
                on = hub_far < NEVER
                r, total = r + (on & (hub_far > 0)).sum(0), total + np.where(on, hub_far, 0).sum(0, dtype=np.int64)
                if self.q:
                    for kind in np.unique(self.source[s]):
                        if kind not in cost:
                            least = (self.to[:, self.sources[kind]][:, None] + self.out[:, t]).min(0)
                            cost[kind] = int(self.of_target[least < NEVER].sum()), int((least * self.of_target)[least < NEVER].sum())
                    own = np.array([cost[x] for x in self.source[s]]).T
                    r, total = r + own[0], total + own[1]
                    if len(ids):
                        least = np.full((len(ids), len(s)), NEVER)
                        for x in range(self.q):
                            least = np.minimum(least, self.out[x, ids][:, None] + hub_far[x])
                        r, total = r - (least < NEVER).sum(0), total - np.where(least < NEVER, least, 0).sum(0, dtype=np.int64)
                told.append((s, r, total))
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*told, strict=True)) if told else (np.zeros(0, np.int64),) * 3
