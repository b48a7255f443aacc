"""Pitch as expressions: cents, folds, bins. Numbers are doubles; no Python runs in any of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_voiced(hz: Column) -> Column:
    """Positive and finite; null is unvoiced."""
    return F.coalesce((hz > 0) & ~F.isnan(hz) & (hz < float("inf")), F.lit(False))


def sanitised(hz: Column) -> Column:
    """The frequency, or 0 where it is null, not finite or negative."""
    return F.when(is_voiced(hz), hz.cast("double")).otherwise(F.lit(0.0))


def cents(hz: Column, tonic: Column) -> Column:
    """Cents above the tonic; 0 where the frame is unvoiced or the tonic isn't positive."""
    return F.when(is_voiced(hz) & (tonic > 0), 1200.0 * F.log2(hz.cast("double") / tonic)).otherwise(F.lit(0.0))


def floored(x: Column, n: float) -> Column:
    """Floored modulo: a tiny negative gives n itself, not 0."""
    rest = x % F.lit(float(n))
    return F.when(rest < 0, rest + F.lit(float(n))).otherwise(rest)


def histogram_bin(c: Column, bins: int = 120) -> Column:
    """Bin of the octave-folded cents; the right edge belongs to the last bin."""
    return F.least(F.floor(floored(c, 1200) / F.lit(1200.0 / bins)), F.lit(bins - 1)).cast("int")


def class_bin(c: Column, classes: int) -> Column:
    """Class of the octave-folded cents among ``classes`` equal ones."""
    return F.least(F.floor(floored(c, 1200) * F.lit(float(classes)) / F.lit(1200.0)), F.lit(classes - 1)).cast("int")


def semitone_class(c: Column) -> Column:
    """Pitch class by the nearest semitone, halves to even."""
    return F.pmod(F.rint(c / 100.0), F.lit(12)).cast("int")


def similarity(distance: Column, scale: float = 1.0) -> Column:
    """1 / (1 + distance / scale)."""
    return 1.0 / (1.0 + distance / F.lit(float(scale)))


def clamped(x: Column) -> Column:
    """Into [0, 1]; null and not finite values give 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(F.lit(0.0))


def duration(samples: Column, rate: Column) -> Column:
    """Seconds of so many samples; 0 where the rate is 0."""
    return F.coalesce(F.try_divide(samples.cast("double"), rate), F.lit(0.0))
