"""One shard's hierarchical proximity graph, on numpy arrays: geometric levels, beam search, diverse links."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearloom.functions import distances
from nearloom.operators.policies import Documents, Policy, Radius

GOLDEN = 0.6180339887498949


def level_of(label: Column, links: int, seed: int) -> Column:
    """The level of a label's vector: geometric, from a low-discrepancy sequence over the labels begun at ``seed``."""
    turn = (label + 1 + seed) * F.lit(GOLDEN)
    unit = 1.0 - (turn - F.floor(turn))
    return F.floor(-F.log(unit) / F.log(F.lit(float(max(links, 2))))).cast("int")


def levels_of(labels: np.ndarray, links: int, seed: int) -> np.ndarray:
    """:func:`level_of` for an array."""
    turn = (labels + 1 + seed) * GOLDEN
    return np.floor(-np.log(1.0 - (turn - np.floor(turn))) / np.log(float(max(links, 2)))).astype(int)


_NONE = np.zeros(0, np.int64)


class _Best:
    """What a beam has found that it may return, and whether it may stop at a distance."""

    def __init__(self, width: int, policy: Policy | None, docs: np.ndarray | None):
        self.width, self.docs = width, docs
        self.radius = policy.epsilon if isinstance(policy, Radius) and policy.most is None else None
        self.per_doc: dict[int, float] | None = {} if isinstance(policy, Documents) else None
        # One document more than asked for tells where the answer ends.
        self.want = max(width, policy.count + 1) if isinstance(policy, Documents) else width
        self.heap: list[tuple[float, int]] = []  # the farthest first
        self.bar = np.inf  # farther ones cannot help

    def add(self, d: float, n: int) -> None:
        heapq.heappush(self.heap, (-d, n))
        if self.per_doc is not None:
            doc = int(self.docs[n])
            if d < self.per_doc.get(doc, np.inf):
                self.per_doc[doc] = d
                if len(self.per_doc) >= self.want:
                    self.bar = sorted(self.per_doc.values())[self.want - 1]
            while -self.heap[0][0] > self.bar:
                heapq.heappop(self.heap)
        elif len(self.heap) >= self.width:
            if self.radius is None or -self.heap[0][0] > self.radius:
                if len(self.heap) > self.width:
                    heapq.heappop(self.heap)
            self.bar = max(-self.heap[0][0], -np.inf if self.radius is None else self.radius)

    def nearest_first(self) -> list[tuple[float, int]]:
        return sorted((-d, n) for d, n in self.heap)


class Graph:
    """A graph over the rows of ``x``, built in their order; ``levels`` has one per row.

    ``hops`` and ``computed`` count the nodes that searches expanded and the
    distances that they computed.
    """

    def __init__(self, x: np.ndarray, space: str, links: int = 16, ef_construction: int = 200, levels: np.ndarray | None = None):
        self.x, self.space, self.links, self.ef_construction = x, space, links, max(ef_construction, links)
        self.out: list[dict[int, np.ndarray]] = []  # per level, links of a node
        self.top: int | None = None
        self.hops = self.computed = 0
        for node, level in enumerate(levels_of(np.arange(len(x)), links, 100) if levels is None else levels):
            self._add(node, int(level))

    @classmethod
    def packed(cls, x: np.ndarray, space: str, links: int, ef_construction: int, top: int, heads: bytes, ends: bytes) -> Graph:
        """The graph that :meth:`pack` wrote, which can be searched and changed."""
        g = cls(np.zeros((0, x.shape[1])), space, links, ef_construction)
        g.x, g.top = x, None if top < 0 else top
        flat = np.frombuffer(ends, np.int32).astype(np.int64)
        at = 0
        for level, node, degree in np.frombuffer(heads, np.int32).reshape(-1, 3).tolist():
            while len(g.out) <= level:
                g.out.append({})
            g.out[level][node] = flat[at : at + degree]
            at += degree
        return g

    def pack(self) -> tuple[int, bytes, bytes]:
        """The entry node (-1: none), ``(level, node, degree)`` of each list of links, and all links; 32-bit numbers."""
        self.reach_all()
        rows = list(self.edges())
        heads = np.array([(level, src, len(dst)) for level, src, dst in rows], np.int32).reshape(-1, 3)
        ends = np.concatenate([np.zeros(0, np.int64), *(dst for _, _, dst in rows)]).astype(np.int32)
        return -1 if self.top is None else self.top, heads.tobytes(), ends.tobytes()

    @classmethod
    def restore(cls, x: np.ndarray, space: str, edges: Iterable[tuple[int, int, np.ndarray]]) -> Graph:
        g = cls(np.zeros((0, x.shape[1])), space)
        g.x = x
        for level, src, dst in edges:
            while len(g.out) <= level:
                g.out.append({})
            g.out[level][src] = np.asarray(dst, np.int64)
        g.top = min(g.out[-1]) if g.out else None
        return g

    def edges(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for level, nodes in enumerate(self.out):
            for src, dst in nodes.items():
                yield level, src, dst

    def _to(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        self.computed += len(nodes)
        return distances.exact(self.space, q, self.x[nodes])

    def _beam(self, q: np.ndarray, start: list[tuple[float, int]], width: int, level: int, allowed: np.ndarray | None = None, policy: Policy | None = None, docs: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The ``width`` nearest found from ``start``, nearest first.

        Nodes that are not ``allowed`` are passed through but not found.  A
        radius without a limit keeps all inside it, ``width`` or more; a
        number of documents keeps the vectors of so many documents.
        """
        seen = np.zeros(len(self.x), bool)
        seen[[n for _, n in start]] = True
        open_ = list(start)
        heapq.heapify(open_)
        best = _Best(width, policy, docs)
        for d, n in start:
            if allowed is None or allowed[n]:
                best.add(d, n)
        while open_:
            d, node = heapq.heappop(open_)
            if d > best.bar:
                break
            near = self.out[level].get(node)
            if near is None or not len(near):
                continue
            self.hops += 1
            near = near[~seen[near]]
            seen[near] = True
            for dn, n in zip(self._to(q, near).tolist(), near.tolist(), strict=True):
                if dn < best.bar or len(best.heap) < width:
                    heapq.heappush(open_, (dn, n))
                    if allowed is None or allowed[n]:
                        best.add(dn, n)
        return best.nearest_first()

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of ``found``, nearest first, those nearer to the centre than to any kept before."""
        if len(found) < most:
            return [n for _, n in found]
        kept: list[int] = []
        for d, n in found:
            if len(kept) == most:
                break
            if not kept or (self._to(self.x[n], np.array(kept)) >= d).all():
                kept.append(n)
        return kept

    def _add(self, node: int, level: int) -> None:
        before = len(self.out)
        while len(self.out) <= level:
            self.out.append({})
        if self.top is None:
            self.top = node
            for lv in range(level + 1):
                self.out[lv][node] = np.zeros(0, np.int64)
            return
        q = self.x[node]
        near = [(float(self._to(q, np.array([self.top]))[0]), self.top)]
        for lv in range(before - 1, -1, -1):
            near = self._beam(q, near[:1] if lv > level else near, 1 if lv > level else self.ef_construction, lv)
            if lv > level:
                continue
            chosen = self._diverse(near, self.links)
            self.out[lv][node] = np.array(chosen, np.int64)
            most = 2 * self.links if lv == 0 else self.links
            for n in chosen:
                back = np.append(self.out[lv][n], node)
                if len(back) > most:
                    d = self._to(self.x[n], back)
                    order = np.argsort(d, kind="stable")
                    back = np.array(self._diverse([(float(d[i]), int(back[i])) for i in order], most), np.int64)
                self.out[lv][n] = back
        for lv in range(before, level + 1):
            self.out[lv][node] = np.zeros(0, np.int64)
        if level >= before:
            self.top = node

    def insert(self, x: np.ndarray, levels: np.ndarray) -> None:
        """Append the rows of ``x`` as nodes."""
        first = len(self.x)
        self.x = np.concatenate([self.x, x]) if len(x) else self.x
        for i, level in enumerate(levels):
            self._add(first + i, int(level))

    def unlink(self, nodes: np.ndarray) -> None:
        """Take ``nodes`` out of the graph and mend the links of those that led to them.

        A node that is left with less than half of the links that it may have
        chooses anew among its other neighbours and those that it reached
        through what went, two steps away; where whole neighbourhoods go,
        through more steps.  The rows of ``x`` stay.
        """
        gone = np.zeros(len(self.x), bool)
        gone[nodes] = True
        for level, lists in enumerate(self.out):
            most = 2 * self.links if level == 0 else self.links
            torn = [n for n, ends in lists.items() if len(ends) and not gone[n] and gone[ends].any()]
            before = {n: lists[n] for n in torn}
            for n in torn:
                rest = before[n][~gone[before[n]]]
                if 2 * len(rest) >= most:  # enough are left, and what comes back links to it again
                    lists[n] = rest
                    continue
                pool, past = set(before[n].tolist()), set()
                while lost := [m for m in pool if gone[m] and m not in past]:
                    past.update(lost)
                    pool.update(*(lists.get(m, _NONE).tolist() for m in lost))
                    if len(pool) - len(past) > most:
                        break
                near = np.array(sorted(m for m in pool if not gone[m] and m != n), np.int64)
                if len(near) < most:  # none has to be left out
                    lists[n] = near
                    continue
                d = self._to(self.x[n], near)
                order = np.argsort(d, kind="stable")
                lists[n] = np.array(self._diverse([(float(d[i]), int(near[i])) for i in order], most), np.int64)
            for n in nodes.tolist():
                lists.pop(n, None)
        while self.out and not self.out[-1]:
            self.out.pop()
        if self.top is None or gone[self.top]:
            self.top = min(self.out[-1]) if self.out else None

    def update(self, nodes: np.ndarray, x: np.ndarray) -> None:
        """Move ``nodes`` to the rows of ``x``: their neighbourhoods are mended, and they are linked anew where they are now."""
        levels = np.zeros(len(self.x), int)
        for level, lists in enumerate(self.out):
            levels[[n for n in nodes.tolist() if n in lists]] = level
        self.unlink(nodes)
        self.x = self.x.copy()
        self.x[nodes] = x
        for n in nodes.tolist():
            self._add(n, int(levels[n]))

    def remove(self, nodes: np.ndarray) -> np.ndarray:
        """Take ``nodes`` out for good; the others are numbered anew.  Returns the old numbers of those that stay."""
        self.unlink(nodes)
        stay = np.setdiff1d(np.arange(len(self.x)), nodes)
        new = np.full(len(self.x), -1, np.int64)
        new[stay] = np.arange(len(stay))
        self.out = [{int(new[n]): new[ends] for n, ends in lists.items()} for lists in self.out]
        self.top = None if self.top is None else int(new[self.top])
        self.x = self.x[stay]
        return stay

    def reach_all(self) -> None:
        """Give each node that no link leads to on level 0 one from a node that it links to.

        Choosing diverse links may drop the last link to a node.  Where there
        is no room for one more, the farthest end that others lead to gives way.
        """
        if len(self.x) < 2 or not self.out:
            return
        lists, most = self.out[0], 2 * self.links
        inbound = np.bincount(np.concatenate([_NONE, *lists.values()]), minlength=len(self.x))
        for node in np.flatnonzero(inbound == 0).tolist():
            own = lists[node].tolist()
            for n in [*own, *(m for m in range(len(self.x)) if m != node and m not in own)]:
                ends = lists[n]
                if len(ends) >= most:
                    spare = np.flatnonzero(inbound[ends] > 1)
                    if not len(spare):
                        continue
                    far = spare[self._to(self.x[n], ends[spare]).argmax()]
                    inbound[ends[far]] -= 1
                    ends = np.delete(ends, far)
                lists[n] = np.append(ends, node)
                inbound[node] = 1
                break

    def search(self, q: np.ndarray, width: int, allowed: np.ndarray | None = None, policy: Policy | None = None, docs: np.ndarray | None = None) -> np.ndarray:
        """Nodes found by a beam of ``width``, nearest first; see :meth:`_beam`."""
        if self.top is None:
            return np.zeros(0, np.int64)
        near = [(float(self._to(q, np.array([self.top]))[0]), self.top)]
        for lv in range(len(self.out) - 1, 0, -1):
            near = self._beam(q, near[:1], 1, lv)
        return np.array([n for _, n in self._beam(q, near[:1], width, 0, allowed, policy, docs)], np.int64)
