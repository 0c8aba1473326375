"""Many searches of one part of a proximity graph at once, and its construction from them.

The same layered graph as :mod:`hnsw`'s, as arrays: ``links[level]`` has a row a
slot, filled up with the number of slots.  All searches take a step together:
each expands the nearest slot that it keeps and has not expanded, as a heap would
give it, and the new neighbours of all of them are a few array operations.  Only
slots that a search meets are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions.kernels import strict_bounds

Array = np.ndarray

#: Searches that take steps together, and slots that are added together (never more than there are already).
TOGETHER, ADDED = 512, 512
#: In place of a slot that is not there; above every other number, and odd.
NONE = np.iinfo(np.int64).max


class Flat:
    def __init__(self, ids: Array, vectors: Array, level: Array, m: int, links: list[Array] | None = None):
        self.ids, self.vectors, self.level, self.m = ids, vectors, level, m
        n, top = len(ids), int(level.max())
        self.links = links or [np.full((n, m if at else 2 * m), n, np.int32) for at in range(top + 1)]
        self.entry = int(np.flatnonzero(level == top)[0])

    @classmethod
    def of(cls, table: pa.Table, m: int) -> Flat:
        """A part from its rows: id, slot, level, embedding and links (as ids)."""
        table = table.sort_by("slot")
        ids, level = table.column("id").to_numpy(), table.column("level").to_numpy()
        own, n = table.column("links").combine_chunks(), len(ids)
        lists = own.flatten()
        met, by_id = lists.flatten().to_numpy(), np.argsort(ids)
        slots = by_id[np.searchsorted(ids, met, sorter=by_id)].astype(np.int32)
        first = np.concatenate([[0], np.cumsum(np.diff(own.offsets.to_numpy()))])
        begin = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        links = []
        for at in range(int(level.max()) + 1):
            stands = np.flatnonzero(level >= at)
            a, b = begin[first[stands] + at], begin[first[stands] + at + 1]
            place = np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
            padded = np.full((n, max(1, int((b - a).max()))), n, np.int32)
            padded[np.repeat(stands, b - a), place] = slots[np.repeat(a, b - a) + place]
            links.append(padded)
        dim = len(table.column("embedding")[0])
        return cls(ids, table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim), level, m, links)

    def rows(self) -> list[tuple[int, int, bool, list[float], list[list[int]]]]:
        """As :meth:`hnsw.Part.rows`."""
        named = [[self.ids[own[own < len(self.ids)]].tolist() for own in level] for level in self.links]
        return [(i, at, False, v, [named[a][s] for a in range(at + 1)]) for s, (i, at, v) in enumerate(zip(self.ids.tolist(), self.level.tolist(), self.vectors.tolist(), strict=True))]

    # Search

    def _far(self, x: Array, i: Array, slots: Array) -> Array:
        apart = self.vectors[slots] - x[i]
        return np.einsum("ij,ij->i", apart, apart)

    def _descend(self, x: Array, start: int, down_to: Array) -> Array:
        """For each search the nearest slot that a greedy walk finds on each level above its ``down_to``."""
        n, best = len(self.ids), np.full(len(x), start)
        d = self._far(x, np.arange(len(x)), best)
        for level in range(int(self.level[start]), 0, -1):
            at = np.flatnonzero(down_to < level)
            while len(at):
                near = self.links[level][best[at]]
                row, column = np.nonzero(near < n)
                all_ = np.full(near.shape, np.inf)
                all_[row, column] = self._far(x, at[row], near[row, column])
                nearest = all_.argmin(axis=1)[:, None]
                found = np.take_along_axis(all_, nearest, 1)[:, 0]
                moves = found < d[at]
                best[at[moves]], d[at[moves]] = np.take_along_axis(near, nearest, 1)[moves, 0], found[moves]
                at = at[moves]
        return best

    def _around(self, x: Array, start: Array, level: int, ef: int, k: int = 0, queue: tuple[int, int] | None = None, bounds: tuple | None = None) -> tuple[Array, Array, dict[str, Array]]:
        """Distances and slots, a row a search, of the ``ef`` nearest that a best-first search of a level meets, and counters.

        With ``k`` those of the k nearest of all that it meets; with a ``queue`` (size, warm-up) and ``bounds`` see :class:`hnsw.Bounds`.

        What is kept is one sorted number each: a distance's leading bits, the slot, and whether it has been expanded.
        """
        n, c, links = len(self.ids), len(x), self.links[level]
        every, low_bits = np.arange(c), n.bit_length() + 1
        number = lambda d, j: ((d.view(np.int64) >> low_bits) << low_bits) | (j.astype(np.int64) << 1)
        kept = np.full((c, ef), NONE)
        kept[:, 0] = number(self._far(x, every, start), start)
        seen = np.zeros(c * (n + 1), bool)
        seen[every * (n + 1) + n] = seen[every * (n + 1) + start] = True
        counts = {"distances": np.ones(c, np.int64), "pruned": np.zeros(c, np.int64), "hops": np.zeros(c, np.int64)}
        if k:
            met = np.full((c, k), NONE)
            met[:, 0] = kept[:, 0]
        if queue is not None:
            (size, warmup), told, low, (squares, powers, sizes) = queue, np.zeros(c, np.int64), np.full((c, queue[0]), np.inf), bounds
            own = np.abs(x)
            less = (x * x).sum(axis=1) - own.sum(axis=1) * 2.0**-12 - 1e-9
        at = every
        while True:
            done = (kept[at] & 1).astype(bool)
            best = done.argmin(axis=1)  # what is kept is in order
            live = ~done[np.arange(len(at)), best]
            at, best = at[live], best[live]
            if not len(at):
                break
            near = links[(kept[at, best] & ((1 << low_bits) - 1)) >> 1]
            kept[at, best] |= 1
            counts["hops"][at] += 1
            place = (at * (n + 1))[:, None] + near
            row, column = np.nonzero(~seen[place])
            i, j = at[row], near[row, column]
            seen[place[row, column]] = True
            if queue is not None:
                lows = np.maximum(0.0, less[i] + squares[j] - 3 * np.einsum("ij,ij->i", powers[j], x[i]) - np.einsum("ij,ij->i", sizes[j], own[i]))
                limit = np.where(told >= warmup, low[every, np.clip(told, 1, size) - 1], np.inf)
                stays = lows <= limit[i]
                counts["pruned"] += np.bincount(i[~stays], minlength=c)
                row, column, i, j, lows = (a[stays] for a in (row, column, i, j, lows))
            counts["distances"] += np.bincount(i, minlength=c)
            news = np.full(near.shape, NONE)
            news[row, column] = number(self._far(x, i, j), j)
            if k:
                met[at] = np.sort(np.concatenate([met[at], news], axis=1), axis=1)[:, :k]
            some = news.min(axis=1) < kept[at, -1]
            rows, news = at[some], news[some]
            both = np.sort(np.concatenate([kept[rows], news], axis=1), axis=1)[:, :ef]
            kept[rows] = both
            if queue is not None:
                more = np.full(near.shape, np.inf)
                more[row, column] = lows
                entered = np.where((news <= both[:, -1:]) & (news < NONE), more[some], np.inf)
                low[rows] = np.sort(np.concatenate([low[rows], entered], axis=1), axis=1)[:, :size]
                told[rows] += np.isfinite(entered).sum(axis=1)
        best = met if k else kept
        slot = np.where(best == NONE, n, (best & ((1 << low_bits) - 1)) >> 1)
        d, (row, column) = np.full(slot.shape, np.inf), np.nonzero(slot < n)
        d[row, column] = self._far(x, row, slot[row, column])
        order = np.lexsort((slot, d), axis=-1)
        return np.take_along_axis(d, order, 1), np.take_along_axis(slot, order, 1), counts

    def search(self, x: Array, k: int, ef: int, queue: tuple[int, int] | None = None) -> tuple[Array, Array, Array, dict[str, Array]]:
        """Places of queries, and the slots and distances of their k nearest, as columns; and counters, a number a query.

        As :meth:`hnsw.Part.search` with ``Stop(k, ef)`` or, with ``ef`` below k, ``Decoupled(k, ef)``, and with ``Bounds(*queue)``.
        """
        bounds = None
        if queue is not None:
            squares, powers, sizes = strict_bounds(self.vectors)
            bounds = (squares, powers, np.abs(powers) + sizes * 2.0**-9)
        parts, n = [], len(self.ids)
        for a in range(0, len(x), TOGETHER):
            some = x[a : a + TOGETHER]
            start = self._descend(some, self.entry, np.zeros(len(some), np.int64))
            d, slot, counts = self._around(some, start, 0, ef, k if ef < k else 0, queue, bounds)
            row, column = np.nonzero(slot[:, :k] < n)
            parts.append((row + a, slot[row, column], d[row, column], counts))
        counts = {c: np.concatenate([p[3][c] for p in parts]) for c in parts[0][3]} | {"upper": np.full(len(x), self.level[self.entry])}
        return *(np.concatenate([p[i] for p in parts]) for i in range(3)), counts

    # Construction

    def _thin(self, d: Array, slots: Array, most: int) -> Array:
        """See :meth:`hnsw.Part._thin`: a row a slot of candidates, nearest first, filled up with the number of slots."""
        n, out = len(self.ids), np.full((len(d), most), len(self.ids))
        for a in range(0, len(d), 256):
            near, own = d[a : a + 256], slots[a : a + 256]
            there = own < n
            v = self.vectors[np.where(there, own, 0)]
            squares = np.einsum("rij,rij->ri", v, v)
            apart = np.maximum(squares[:, :, None] + squares[:, None, :] - 2 * (v @ v.transpose(0, 2, 1)), 0.0)
            keep, kept, all_ = np.zeros(there.shape, bool), np.zeros(len(near), np.int64), there.sum(axis=1) <= most
            for c in range(near.shape[1]):
                hidden = (keep[:, :c] & (apart[:, c, :c] < near[:, c : c + 1])).any(axis=1)
                keep[:, c] = there[:, c] & (kept < most) & (all_ | ~hidden)
                kept += keep[:, c]
            first = np.argsort(~keep, axis=1, kind="stable")[:, :most]
            out[a : a + 256, : first.shape[1]] = np.where(np.take_along_axis(keep, first, 1), np.take_along_axis(own, first, 1), n)
        return out

    def _back(self, level: int, src: Array, dst: Array) -> None:
        """Link ``dst`` to ``src`` as well; lists that would be too long are thinned."""
        n, links = len(self.ids), self.links[level]
        new = ~(links[dst] == src[:, None]).any(axis=1)
        order = np.lexsort((src[new], dst[new]))
        src, dst = src[new][order], dst[new][order]
        target, first, count = np.unique(dst, return_index=True, return_counts=True)
        have, place = (links[target] < n).sum(axis=1), np.arange(len(dst)) - np.repeat(first, count)
        fits = have + count <= links.shape[1]
        each = np.repeat(fits, count)
        links[dst[each], np.repeat(have, count)[each] + place[each]] = src[each]
        full = target[~fits]
        if len(full):
            near = np.full((len(full), int(count[~fits].max())), n)
            near[np.repeat(np.arange(len(full)), count[~fits]), place[~each]] = src[~each]
            near = np.concatenate([links[full], near], axis=1)
            d, (row, column) = np.full(near.shape, np.inf), np.nonzero(near < n)
            d[row, column] = self._far(self.vectors[full], row, near[row, column])
            nearest = np.lexsort((near, d), axis=-1)[:, : 3 * links.shape[1]]
            links[full] = self._thin(np.take_along_axis(d, nearest, 1), np.take_along_axis(near, nearest, 1), links.shape[1])

    def _add(self, a: int, b: int, ef: int) -> None:
        """Link the slots from a to b: each with what a search finds and with the others of them."""
        n, new, x = len(self.ids), np.arange(a, b), self.vectors[a:b]
        level, top = self.level[a:b], int(self.level[self.entry])
        start = self._descend(x, self.entry, level)
        squares = (x * x).sum(axis=1)
        mates = np.maximum(squares[:, None] + squares - 2 * (x @ x.T), 0.0)
        np.fill_diagonal(mates, np.inf)
        for at in range(int(level.max()), -1, -1):
            own = np.flatnonzero(level >= at)
            d, slot = mates[np.ix_(own, own)], np.broadcast_to(np.where(np.eye(len(own), dtype=bool), n, new[own]), (len(own), len(own)))
            if len(own) > ef:
                pick = np.argpartition(d, ef - 1, axis=1)[:, :ef]
                d, slot = np.take_along_axis(d, pick, 1), np.take_along_axis(slot, pick, 1)
            if at <= top:
                found, there, _ = self._around(x[own], start[own], at, ef)
                start[own] = there[:, 0]
                d, slot = np.concatenate([found, d], axis=1), np.concatenate([there, slot], axis=1)
            order = np.lexsort((slot, d), axis=-1)[:, :ef]
            links = self._thin(np.take_along_axis(d, order, 1), np.take_along_axis(slot, order, 1), self.m)
            self.links[at][new[own], : self.m] = links
            row, column = np.nonzero(links < n)
            self._back(at, new[own][row], links[row, column])
        if level.max() > top:
            self.entry = a + int(level.argmax())


def built(ids: Array, vectors: Array, level: Array, m: int, ef: int) -> Flat:
    """The graph of vectors, which are added in their order, many at once."""
    flat = Flat(ids, vectors, level, m)
    flat.entry, a = 0, 1
    while a < len(ids):
        b = min(len(ids), a + min(a, ADDED))
        flat._add(a, b, ef)
        a = b
    return flat
