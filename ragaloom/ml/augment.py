"""Changes to training vectors: on single vectors while learning, and on columns of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A change takes a vector and a source of random numbers, and gives a new vector.
Change = Callable[[np.ndarray, np.random.Generator], np.ndarray]


class Compose:
    """Changes one after the other, from left to right."""

    def __init__(self, changes: list[Change]) -> None:
        self.changes = list(changes)

    def __call__(self, x: np.ndarray, draw: np.random.Generator) -> np.ndarray:
        for change in self.changes:
            x = change(x, draw)
        return x


class Roll:
    """Turns the pitch classes by up to ``most`` places either way, as another tonic would."""

    def __init__(self, most: int = 11) -> None:
        self.most = most

    def __call__(self, x: np.ndarray, draw: np.random.Generator) -> np.ndarray:
        return np.roll(x, int(draw.integers(-self.most, self.most + 1)))


class Offset:
    """Adds one number of cents, up to ``most`` either way, to all voiced frames; unvoiced ones stay 0."""

    def __init__(self, most: float = 100.0) -> None:
        self.most = most

    def __call__(self, x: np.ndarray, draw: np.random.Generator) -> np.ndarray:
        return np.where(x != 0, x + draw.uniform(-self.most, self.most), x)


class Noise:
    """Adds Gaussian noise of a deviation to every value."""

    def __init__(self, deviation: float = 0.01) -> None:
        self.deviation = deviation

    def __call__(self, x: np.ndarray, draw: np.random.Generator) -> np.ndarray:
        return x + draw.normal(0.0, self.deviation, x.shape)


def usual(mode: str = "pcd") -> Compose:
    """The usual changes for what a model reads."""
    if mode == "pcd":
        return Compose([Roll(), Noise(0.01)])
    if mode == "contour":
        return Compose([Offset(), Noise(2.0)])
    raise ValueError(f"unknown mode {mode!r}")


def offset(contour: Column, cents: Column) -> Column:
    """The contour with ``cents`` added to its voiced frames; unvoiced ones stay 0, and a null stays null."""
    return F.transform(contour, lambda x: F.when(x != 0, x + cents).otherwise(x))
