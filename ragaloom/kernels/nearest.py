"""The nearest of many contours for each query of a block, without comparing all pairs in full."""

from __future__ import annotations

import numpy as np

#: The directions that the queries are projected on hold this part of their squares.
KEPT = 0.999
#: Contours of a batch that are compared at once, and pairs that are compared in full at once.
BATCH, PAIRS = 1024, 2048


def standardised(contours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows less their means, over their population deviations, and which rows these are; flat rows are left out."""
    deviation = contours.std(axis=1)
    kept = deviation >= 1e-6
    return (contours[kept] - contours[kept].mean(axis=1, keepdims=True)) / deviation[kept, None], kept


class Asked:
    """A block of queries, and for each the distance (``worst``) beyond which nothing is wanted any more.

    A product of two contours is at most that of their projections plus that of the lengths of what the projections
    leave out (Cauchy-Schwarz). So one narrow product in single precision, whose error is allowed for, tells the pairs
    that may be within ``worst``. Queries without values that are all finite match nothing.
    """

    def __init__(self, ids: np.ndarray, contours: np.ndarray, top: int, exclude_self: bool = False) -> None:
        fine = np.isfinite(contours).all(axis=1)
        self.ids, self.contours, self.top = ids[fine], np.ascontiguousarray(contours[fine]), top
        self.place = {x: i for i, x in enumerate(self.ids)} if exclude_self else {}
        self.squares = np.einsum("ij,ij->i", self.contours, self.contours)
        self.length = float(np.sqrt(self.squares.max(initial=0))) or 1.0
        scaled = self.contours / self.length
        values, directions = np.linalg.eigh(scaled.T @ scaled)
        held = np.cumsum(values[::-1])
        self.directions = np.ascontiguousarray(directions[:, ::-1][:, : int(np.searchsorted(held, KEPT * held[-1])) + 1])
        shadows, rest = self._projected(scaled)
        self.narrow = np.column_stack([shadows, rest, np.ones(len(rest))]).astype(np.float32)
        self.worst = np.full(len(self.ids), np.inf)

    def _projected(self, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shadows = scaled @ self.directions
        return shadows, np.sqrt(np.maximum(np.einsum("ij,ij->i", scaled, scaled) - np.einsum("ij,ij->i", shadows, shadows), 0))

    def own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, contour) pairs of one id, which don't match."""
        pairs = [(self.place[x], j) for j, x in enumerate(ids) if x in self.place] if self.place else []
        return tuple(np.array(pairs, dtype=np.int64).reshape(-1, 2).T)

    def bound(self, ids: np.ndarray, contours: np.ndarray) -> None:
        """``worst`` of the queries without one, from these contours: a little more than the distance of the last wanted."""
        if len(contours) <= self.top:
            return
        squares, (mine, theirs) = np.einsum("ij,ij->i", contours, contours), self.own(ids)
        error = 8 * (contours.shape[1] + 8) * np.finfo(float).eps
        unbound = np.flatnonzero(np.isinf(self.worst))
        for start in range(0, len(unbound), 512):
            rows = unbound[start : start + 512]
            d = self.squares[rows, None] + squares[None] - 2 * self.contours[rows] @ contours.T
            here = np.isin(mine, rows)
            d[np.searchsorted(rows, mine[here]), theirs[here]] = np.inf
            last = np.partition(d, self.top - 1, axis=1)[:, self.top - 1]
            self.worst[rows] = np.sqrt(np.maximum(last, 0) + error * (self.squares[rows] + squares.max()))

    def within(self, contours: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, contour) pairs, in the queries' order: all whose distance is at most ``worst``, and some others."""
        squares = np.einsum("ij,ij->i", contours, contours)
        length = float(np.sqrt(squares.max(initial=0))) or 1.0
        shadows, rest = self._projected(contours / length)
        both = length * self.length
        narrow = np.column_stack([shadows, rest, -squares / (2 * both)]).astype(np.float32)
        least = (self.squares - (worst + 1e-8) ** 2) / (2 * both)
        error = 2.0**-23 * ((narrow.shape[1] + 8) * (2 + length / self.length) + np.abs(np.where(np.isinf(least), 0, least)))
        return np.divmod(np.flatnonzero(self.narrow @ narrow.T >= (least - error).astype(np.float32)[:, None]), len(contours))


class Nearest:
    """The ``top`` nearest of all contours added, for each query; distances are rounded to 9 places, ties go to the smaller id."""

    def __init__(self, asked: Asked) -> None:
        self.asked, self.worst = asked, asked.worst.copy()
        self.query, self.distance, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)

    def add(self, ids: np.ndarray, contours: np.ndarray) -> None:
        """Contours without values that are all finite match nothing."""
        fine = np.isfinite(contours).all(axis=1)
        ids, contours = ids[fine], contours[fine]
        for start in range(0, len(ids), BATCH):
            self._add(ids[start : start + BATCH], contours[start : start + BATCH])

    def _add(self, ids: np.ndarray, contours: np.ndarray) -> None:
        asked = self.asked
        query, place = asked.within(contours, self.worst)
        mine, theirs = asked.own(ids)
        if len(mine):
            other = ~np.isin(query * len(ids) + place, mine * len(ids) + theirs)
            query, place = query[other], place[other]
        found = [(self.query, self.distance, self.ids)]
        for start in range(0, len(query), PAIRS):
            q, c = query[start : start + PAIRS], place[start : start + PAIRS]
            apart = asked.contours[q] - contours[c]
            d = np.round(np.sqrt(np.einsum("ij,ij->i", apart, apart)), 9)
            near = d <= self.worst[q] + 1e-9
            found.append((q[near], d[near], ids[c[near]]))
        if any(len(q) for q, _, _ in found[1:]):
            self.query, self.distance, self.ids = (np.concatenate(x) for x in zip(*found, strict=True))
            self._cut()

    def _cut(self) -> None:
        order = np.lexsort((self.distance, self.query))
        query, distance, ids = self.query[order], self.distance[order], self.ids[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        count = np.diff(first, append=len(query))
        full = count >= self.asked.top
        last = np.full(len(first), np.inf)
        last[full] = distance[first[full] + self.asked.top - 1]
        at = query[first]
        self.worst[at] = np.minimum(self.worst[at], last)
        kept = distance <= np.repeat(last, count)
        query, distance, ids = query[kept], distance[kept], ids[kept]
        tied = np.flatnonzero(np.isin(query, np.flatnonzero(np.bincount(query) > self.asked.top)))
        if len(tied):  # more than wanted at the last distance
            drop, seen, before = [], 0, -1
            for i in sorted(tied.tolist(), key=lambda i: (query[i], distance[i], ids[i])):
                seen, before = (seen + 1 if query[i] == before else 1), query[i]
                if seen > self.asked.top:
                    drop.append(i)
            query, distance, ids = (np.delete(x, drop) for x in (query, distance, ids))
        self.query, self.distance, self.ids = query, distance, ids
