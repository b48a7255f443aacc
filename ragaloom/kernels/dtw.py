"""Dynamic time warping of two series, by the published recurrence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def costs(a: np.ndarray, b: np.ndarray, window: int | None = None, free_start: bool = False) -> np.ndarray:
    """Accumulated squared costs, one more row and column than the series; ``free_start`` lets a path begin anywhere in b."""
    n, m = len(a), len(b)
    table = np.full((n + 1, m + 1), np.inf)
    table[0, 0] = 0.0
    if free_start:
        table[0, :] = 0.0
    reach = max(n, m) if window is None else max(window, abs(n - m) + 1)
    local = (a[:, None] - b[None, :]) ** 2
    for d in range(2, n + m + 1):  # cells of one anti-diagonal don't depend on each other
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        i = i[np.abs(2 * i - d) < reach] if window is not None else i
        j = d - i
        table[i, j] = local[i - 1, j - 1] + np.minimum(np.minimum(table[i - 1, j], table[i, j - 1]), table[i - 1, j - 1])
    return table


def distance(a: np.ndarray, b: np.ndarray, window: int | None = None) -> float:
    """Root of the least summed squares along a path, over frames that aren't 0; infinite if a series has none."""
    a, b = a[a != 0], b[b != 0]
    return float(np.sqrt(costs(a, b, window)[-1, -1])) if len(a) and len(b) else float("inf")


def path_length(table: np.ndarray) -> int:
    """Cells on the best path, diagonal steps first among equals."""
    i, j, n = table.shape[0] - 1, table.shape[1] - 1, 0
    while i > 0 and j > 0:
        n += 1
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda s: table[s])
    return n


def similarity(a: np.ndarray, b: np.ndarray, window: int | None = None) -> float:
    """1 / (1 + distance / length of the path); 0 if a series is empty or no path fits the window."""
    a, b = a[a != 0], b[b != 0]
    if not len(a) or not len(b):
        return 0.0
    table = costs(a, b, window)
    if not np.isfinite(table[-1, -1]):
        return 0.0
    return 1.0 / (1.0 + float(np.sqrt(table[-1, -1])) / max(path_length(table), 1))


def subsequence_similarity(query: np.ndarray, reference: np.ndarray, by_length: int = 2) -> float:
    """The best match of the query anywhere in the reference; the distance is divided ``by_length`` times by the query's length."""
    a, b = query[query != 0], reference[reference != 0]
    if not len(a) or not len(b):
        return 0.0
    least = float(np.sqrt(costs(a, b, free_start=True)[-1, 1:].min()))
    return 1.0 / (1.0 + least / len(a) ** by_length)


@dataclass(frozen=True)
class Matcher:
    """How two series are compared. The recurrence is that of steps of one weight; ``step_pattern`` names the pattern
    that a caller has in mind and changes nothing."""

    window: int | None = None
    step_pattern: str = "symmetric2"

    def distance(self, a: np.ndarray, b: np.ndarray) -> float:
        return distance(a, b, self.window)

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        return similarity(a, b, self.window)

    def subsequence(self, a: np.ndarray, b: np.ndarray) -> float:
        return subsequence_similarity(a, b)
