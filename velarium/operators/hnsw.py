"""One part of a proximity graph in memory: layered construction, repair, deletion and search.

Slots number the part's vectors.  ``links[level][slot]`` holds a slot's
neighbours on a level; a slot of level n stands on levels 0 to n.  Search
descends greedily through the upper levels and spreads out on level 0.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import numpy as np

Found = list[tuple[float, int]]


class Stop:
    """When a base-level search is done, and which of the admitted slots it returns.

    The plain condition: ``ef`` slots are kept, and the search ends when the
    nearest open one is farther than all of them.
    """

    def __init__(self, k: int, ef: int):
        self.k, self.ef = k, ef
        self.kept: list[tuple[float, int]] = []  # heap of (-distance, -slot)

    def takes(self, d: float) -> bool:
        """Whether a slot at this distance is worth keeping (and going on from)."""
        return len(self.kept) < self.ef or d < -self.kept[0][0]

    def done(self, d: float) -> bool:
        """Whether the search ends when the nearest open slot is this far away."""
        return len(self.kept) >= self.ef and d > -self.kept[0][0]

    def add(self, d: float, slot: int) -> None:
        heapq.heappush(self.kept, (-d, -slot))
        if len(self.kept) > self.ef:
            heapq.heappop(self.kept)

    def result(self) -> Found:
        return sorted((-d, -s) for d, s in self.kept)[: self.k]


class Decoupled(Stop):
    """``ef`` below k: the search spreads with ``ef``, the result keeps its own k nearest of all that it met."""

    def __init__(self, k: int, ef: int):
        super().__init__(k, ef)
        self.met: list[tuple[float, int]] = []

    def seen(self, d: float, slot: int) -> None:
        heapq.heappush(self.met, (-d, -slot))
        if len(self.met) > self.k:
            heapq.heappop(self.met)

    def result(self) -> Found:
        return sorted((-d, -s) for d, s in self.met)


class Within(Stop):
    """All slots within a radius: at least ``least`` nearest ones are returned, at most ``k``.

    The radius may end the search once ``ef`` slots are kept.
    """

    def __init__(self, radius: float, k: int, least: int, ef: int):
        super().__init__(k, k)
        self.radius, self.least, self.before = radius, least, max(least, min(ef, k))

    def done(self, d: float) -> bool:
        return (len(self.kept) >= self.before and d > self.radius) or super().done(d)

    def result(self) -> Found:
        found = super().result()
        return [(d, s) for n, (d, s) in enumerate(found) if d <= self.radius or n < self.least]


class Documents(Stop):
    """k distinct documents, a document being as near as its nearest slot; ``ef`` documents are kept meanwhile."""

    def __init__(self, document: Callable[[int], int], k: int, ef: int):
        super().__init__(k, max(ef, k))
        self.document, self.best = document, {}

    def _farthest(self) -> float:
        while True:  # the heap may hold a document's former, farther place
            d, s = -self.kept[0][0], -self.kept[0][1]
            if self.best.get(self.document(s)) == (d, s):
                return d
            heapq.heappop(self.kept)

    def takes(self, d: float) -> bool:
        return len(self.best) < self.ef or d < self._farthest()

    def done(self, d: float) -> bool:
        return len(self.best) >= self.ef and d > self._farthest()

    def add(self, d: float, slot: int) -> None:
        doc = self.document(slot)
        if doc in self.best and self.best[doc] <= (d, slot):
            return
        self.best[doc] = (d, slot)
        heapq.heappush(self.kept, (-d, -slot))
        if len(self.best) > self.ef:
            self._farthest()
            del self.best[self.document(-heapq.heappop(self.kept)[1])]

    def result(self) -> Found:
        return sorted(self.best.values())[: self.k]


class Bounds:
    """The second queue of a search: the least lower bounds of kept slots.

    It holds ``size`` of them and prunes once ``warmup`` slots are kept and as
    many bounds are in it.  ``batched``: bounds of an expanded slot's
    neighbours enter together, after all of them were looked at.
    """

    def __init__(self, size: int, warmup: int, batched: bool = False):
        self.size, self.warmup, self.batched = size, warmup, batched
        self.low: list[float] = []
        self.waiting: list[float] = []
        self.kept = 0

    def limit(self) -> float:
        return -self.low[0] if self.kept >= self.warmup and len(self.low) >= min(self.size, self.warmup) else np.inf

    def add(self, bound: float) -> None:
        self.kept += 1
        if self.batched:
            self.waiting.append(bound)
        else:
            self._push(bound)

    def settle(self) -> None:
        for bound in self.waiting:
            self._push(bound)
        self.waiting = []

    def _push(self, bound: float) -> None:
        heapq.heappush(self.low, -bound)
        if len(self.low) > self.size:
            heapq.heappop(self.low)


class Part:
    def __init__(self, dim: int, m: int, ef: int):
        self.m, self.ef = m, ef
        self.vectors = np.zeros((16, dim))
        self.ids: list[int] = []
        self.at: dict[int, int] = {}
        self.level: list[int] = []
        self.links: list[list[list[int]]] = []  # of slot: one list a level
        self.deleted: set[int] = set()
        self.entry = -1

    def _cap(self, level: int) -> int:
        return self.m if level else 2 * self.m

    def _distances(self, slots: list[int], q: np.ndarray) -> np.ndarray:
        return ((self.vectors[slots] - q) ** 2).sum(axis=1)

    # Construction

    def _descend(self, q: np.ndarray, start: int, down_to: int) -> int:
        """The nearest slot that a greedy walk finds on each level above ``down_to``, from the top."""
        best, d = start, float(self._distances([start], q)[0])
        for level in range(self.level[start], down_to, -1):
            while True:
                near = self.links[best][level] if level < len(self.links[best]) else []
                if not near:
                    break
                all_ = self._distances(near, q)
                n = int(all_.argmin())
                if all_[n] >= d:
                    break
                best, d = near[n], float(all_[n])
        return best

    def _around(self, q: np.ndarray, start: int, level: int, ef: int, but: int = -1) -> Found:
        """The ``ef`` nearest slots that a best-first search of a level meets."""
        d = float(self._distances([start], q)[0])
        open_, kept, seen = [(d, start)], [(-d, -start)], {start, but}
        while open_:
            d, s = heapq.heappop(open_)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            new = [j for j in (self.links[s][level] if level < len(self.links[s]) else ()) if j not in seen]
            seen.update(new)
            for j, dj in zip(new, self._distances(new, q).tolist() if new else (), strict=True):
                if len(kept) < ef or dj < -kept[0][0]:
                    heapq.heappush(open_, (dj, j))
                    heapq.heappush(kept, (-dj, -j))
                    if len(kept) > ef:
                        heapq.heappop(kept)
        return sorted((-d, -s) for d, s in kept if -s != but)

    def _thin(self, near: Found, most: int) -> list[int]:
        """Of candidates, nearest first, those that no kept one is nearer to than the centre is."""
        if len(near) <= most:
            return [s for _, s in near]
        keep: list[int] = []
        for d, s in near:
            if not keep or (self._distances(keep, self.vectors[s]) >= d).all():
                keep.append(s)
                if len(keep) == most:
                    break
        return keep

    def _relink(self, slot: int, level: int, candidates: Iterable[int]) -> None:
        """The slot's links on a level, thinned from the candidates."""
        some = sorted(set(candidates) - {slot})
        ranked = sorted(zip(self._distances(some, self.vectors[slot]).tolist(), some, strict=True)) if some else []
        self.links[slot][level] = self._thin(ranked, self._cap(level))

    def _connect(self, slot: int) -> None:
        """Link the slot both ways on all its levels."""
        q = self.vectors[slot]
        start = self._descend(q, self.entry, self.level[slot])
        for level in range(min(self.level[slot], self.level[self.entry]), -1, -1):
            near = self._around(q, start, level, self.ef, but=slot)
            if not near:
                continue
            start = near[0][1]
            self.links[slot][level] = self._thin(near, self.m)
            for j in self.links[slot][level]:
                own = self.links[j][level]
                if slot not in own:
                    if len(own) < self._cap(level):
                        own.append(slot)
                    else:
                        self._relink(j, level, [*own, slot])

    def insert(self, id_: int, vector: np.ndarray, level: int, reuse: bool = False) -> None:
        """Add a vector, or move an id that is there; ``reuse``: a deleted slot is taken over first."""
        if id_ in self.at:
            self.move(self.at[id_], vector)
            return
        if reuse and self.deleted:
            slot = min(self.deleted)
            self.deleted.discard(slot)
            del self.at[self.ids[slot]]
            self.ids[slot], self.at[id_] = id_, slot
            self.move(slot, vector)
            return
        slot = len(self.ids)
        if slot == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[slot] = vector
        self.ids.append(id_)
        self.at[id_] = slot
        self.level.append(level)
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = slot
            return
        self._connect(slot)
        if level > self.level[self.entry]:
            self.entry = slot

    def move(self, slot: int, vector: np.ndarray) -> None:
        """Give a slot another vector: its old neighbourhood is closed behind it, then it is linked anew."""
        self.deleted.discard(slot)
        holders = [[s for s in range(len(self.ids)) if level < len(self.links[s]) and slot in self.links[s][level]] for level in range(len(self.links[slot]))]
        for level, own in enumerate(holders):
            ring = set(own) | set(self.links[slot][level])
            wider = ring.union(*(self.links[s][level] for s in ring)) - {slot}
            for s in own:
                self._relink(s, level, wider)
        self.vectors[slot] = vector
        self.links[slot] = [[] for _ in self.links[slot]]
        if len(self.ids) > 1:
            if self.entry == slot:  # start elsewhere while it has no links
                others = [s for s in range(len(self.ids)) if s != slot]
                self.entry = max(others, key=lambda s: (self.level[s], -s))
            self._connect(slot)
            if self.level[slot] > self.level[self.entry]:
                self.entry = slot

    # Search

    def search(self, q: np.ndarray, stop: Stop, admit: np.ndarray | None = None, bounds: tuple | None = None, queue: Bounds | None = None) -> tuple[Found, dict[str, int]]:
        """(distance, slot) of what the condition keeps, and counters.

        Deleted slots, and those that ``admit`` (a mask) leaves out, are passed
        through but not returned.  With ``bounds`` (of
        :func:`kernels.strict_bounds`) and a ``queue`` for them, a slot whose
        lower bound exceeds all in the queue is dropped before its distance is
        computed.
        """
        from ..functions.kernels import lower_bounds

        counts = {"distances": 0, "pruned": 0, "hops": 0, "upper": 0}
        if self.entry < 0:
            return [], counts
        start = self._descend(q, self.entry, 0)
        counts["upper"] = self.level[self.entry]
        free = lambda s: s not in self.deleted and (admit is None or bool(admit[s]))
        d = float(self._distances([start], q)[0])
        open_, seen = [(d, start)], {start}
        counts["distances"] = 1
        met = getattr(stop, "seen", None)
        if free(start):
            stop.add(d, start)
            if met:
                met(d, start)
        while open_:
            d, s = heapq.heappop(open_)
            if stop.done(d):
                break
            counts["hops"] += 1
            new = [j for j in self.links[s][0] if j not in seen]
            seen.update(new)
            lows = lower_bounds(q, tuple(b[new] for b in bounds)).tolist() if bounds is not None and new else [0.0] * len(new)
            if queue is not None:
                limit = queue.limit()
                stays = [n for n, b in enumerate(lows) if b <= limit]
                counts["pruned"] += len(new) - len(stays)
                new, lows = [new[n] for n in stays], [lows[n] for n in stays]
            counts["distances"] += len(new)
            for j, dj, b in zip(new, self._distances(new, q).tolist() if new else (), lows, strict=True):
                ok = free(j)
                if ok and met:
                    met(dj, j)
                if stop.takes(dj):
                    heapq.heappush(open_, (dj, j))
                    if ok:
                        stop.add(dj, j)
                        if queue is not None:
                            queue.add(b)
            if queue is not None:
                queue.settle()
        return stop.result(), counts

    def scan(self, q: np.ndarray, stop: Stop, admit: np.ndarray | None = None) -> tuple[Found, dict[str, int]]:
        """:meth:`search` for a condition that leaves no slot out: also those that no link reaches are looked at."""
        n = len(self.ids)
        d = ((self.vectors[:n] - q) ** 2).sum(axis=1)
        for s in np.argsort(d, kind="stable").tolist():
            if s not in self.deleted and (admit is None or admit[s]):
                stop.add(float(d[s]), s)
        return stop.result(), {"distances": n, "pruned": 0, "hops": n, "upper": 0}

    # Rows

    def rows(self) -> list[tuple[int, int, bool, list[float], list[list[int]]]]:
        """id, level, deleted, vector and links (as ids) of every slot."""
        return [(self.ids[s], self.level[s], s in self.deleted, self.vectors[s].tolist(), [[self.ids[j] for j in own] for own in self.links[s]]) for s in range(len(self.ids))]

    @classmethod
    def of(cls, rows: list[tuple], m: int, ef: int) -> Part:
        """A part from its rows, in the order of their slots."""
        part = cls(len(rows[0][3]), m, ef)
        part.ids = [r[0] for r in rows]
        part.at = {r[0]: s for s, r in enumerate(rows)}
        part.level = [r[1] for r in rows]
        part.deleted = {s for s, r in enumerate(rows) if r[2]}
        part.vectors = np.array([r[3] for r in rows], np.float64)
        part.links = [[[part.at[j] for j in own] for own in r[4]] for r in rows]
        part.entry = max(range(len(rows)), key=lambda s: (part.level[s], -s))
        return part
