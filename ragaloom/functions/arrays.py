"""Contours as arrays: expressions over one row's array, without shuffle and without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragaloom.functions import pitch


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; a lambda would work out what it uses again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def voiced(frequencies: Column) -> Column:
    """The voiced frames, in order, as doubles."""
    return F.filter(F.transform(frequencies, lambda x: x.cast("double")), pitch.is_voiced)


def without_zeros(contour: Column) -> Column:
    """The frames that aren't exactly 0; a frame exactly on the tonic goes too."""
    return F.filter(contour, lambda x: x != 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    """Null for an empty array."""
    return let(values, lambda v: F.try_divide(total(v), F.size(v).cast("double")))


def deviation(values: Column, centre: Column) -> Column:
    """Population standard deviation around a given mean."""
    return let(values, lambda v: let(centre, lambda m: F.sqrt(F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)), F.size(v).cast("double")))))


def median(values: Column) -> Column:
    """Exact median; null for an empty array."""

    def body(v: Column) -> Column:
        ordered, n = F.sort_array(v), F.size(v)
        return F.when(n > 0, (F.get(ordered, ((n - 1) / 2).cast("int")) + F.get(ordered, (n / 2).cast("int"))) / 2.0)

    return let(values, body)


def resampled(values: Column, points: int) -> Column:
    """Linear interpolation at ``points`` places evenly spread from the first value to the last."""

    def body(v: Column) -> Column:
        n = F.size(v)

        def at(place: Column, low: Column) -> Column:
            left = F.get(v, low)
            return left + (place - low) * (F.coalesce(F.get(v, low + 1), left) - left)

        places = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k.cast("double") * (n - 1) / F.lit(float(max(points - 1, 1))))
        return F.when(n > 0, let(places, lambda p: F.zip_with(p, F.transform(p, lambda x: F.floor(x).cast("int")), at)))

    return let(values, body)


def smoothed(values: Column, window: int = 5) -> Column:
    """Moving average with the edges repeated; an even window reaches one further back, and it is at most the length."""

    def body(v: Column) -> Column:
        n = F.size(v)
        w = F.least(F.lit(window), n)
        back = F.floor(w / 2).cast("int")

        def at(x: Column, i: Column) -> Column:
            near = F.transform(F.sequence(i - back, i - back + w - 1), lambda j: F.get(v, F.greatest(F.lit(0), F.least(n - 1, j))))
            return total(near) / w

        return F.when((n > 0) & F.lit(window > 1), F.transform(v, at)).otherwise(v)

    return let(values, body)


def pooled(values: Column, factor: int = 4) -> Column:
    """Means of blocks of ``factor`` values; the last block may be shorter."""

    def body(v: Column) -> Column:
        n = F.size(v)
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / factor).cast("int"))
        return F.when(n > 0, F.transform(blocks, lambda b: mean(F.slice(v, b * factor + 1, F.lit(factor))))).otherwise(v)

    return let(values, body)


def interpolated(values: Column) -> Column:
    """Zeros filled by straight lines between their neighbours; before the first and after the last value held.

    Each value that isn't 0 writes the places from its own to the next one's, so the work follows the length.
    """
    known = F.filter(F.transform(values, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda s: s["x"] != 0)

    def filled(k: Column) -> Column:
        n = F.size(k)
        first, last = F.get(k, F.lit(0)), F.get(k, n - 1)

        def stretch(j: Column) -> Column:
            before, after = F.get(k, j), F.get(k, j + 1)
            slope = (after["x"] - before["x"]) / (after["i"] - before["i"])
            return F.transform(F.sequence(before["i"], after["i"] - 1), lambda i: before["x"] + slope * (i - before["i"]))

        between = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), stretch))).otherwise(F.array().cast("array<double>"))
        whole = F.concat(F.array_repeat(first["x"], first["i"]), between, F.array_repeat(last["x"], F.size(values) - last["i"]))
        return F.when(n > 0, whole).otherwise(values.cast("array<double>"))

    return let(known, filled)


def fixed_length(values: Column, length: int) -> Column:
    """The middle of a longer array; a shorter one padded by zeros, the odd one on the right."""

    def body(v: Column) -> Column:
        n = F.size(v)
        pad = F.lit(length) - n
        left = F.floor(pad / 2).cast("int")
        padded = F.concat(F.array_repeat(F.lit(0.0), left), v, F.array_repeat(F.lit(0.0), pad - left))
        return F.when(n >= length, F.slice(v, F.floor((n - length) / 2).cast("int") + 1, F.lit(length))).otherwise(padded)

    return let(values, body)


def segments(values: Column, length: int) -> Column:
    """Consecutive pieces of ``length`` values; the last may be shorter."""

    def body(v: Column) -> Column:
        n = F.size(v)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(length)), lambda i: F.slice(v, i + 1, F.lit(length)))).otherwise(F.array())

    return let(values, body)


def standardised(values: Column) -> Column:
    """Less the mean, over the population deviation; null where that is under 1e-6."""
    scaled = lambda v, m, s: F.when(s >= 1e-6, F.transform(v, lambda x: (x - m) / s))
    return let(values, lambda v: let(mean(v), lambda m: let(deviation(v, m), lambda s: scaled(v, m, s))))


def encoded(frequencies: Column, tonic: Column, points: int = 500, least: int = 50) -> Column:
    """A contour for matching: voiced cents, resampled and standardised; null with fewer than ``least`` voiced frames."""
    in_cents = lambda heard: F.transform(heard, lambda x: 1200.0 * F.log2(x / tonic))
    return let(voiced(frequencies), lambda heard: F.when((tonic > 0) & (F.size(heard) >= least), standardised(resampled(in_cents(heard), points))))


def preprocessed(contour: Column, window: int = 5, factor: int = 4) -> Column:
    """Silence dropped, smoothed, pooled: what time warping compares."""
    return pooled(smoothed(without_zeros(contour), window), factor)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of one length."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def class_distribution(contour: Column) -> Column:
    """Shares of the twelve pitch classes among frames that aren't 0; zeros if there is none."""

    def shares(kinds: Column) -> Column:
        n = F.greatest(F.size(kinds), F.lit(1)).cast("double")
        return F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.size(F.filter(kinds, lambda x: x == k)) / n)

    return let(F.transform(without_zeros(contour), pitch.semitone_class), shares)


def rolled(values: Column, shift: Column) -> Column:
    """The array turned right by ``shift`` places."""
    return let(values, lambda v: F.transform(v, lambda x, i: F.get(v, F.pmod(i - shift, F.size(v)))))


def softmax(values: Column) -> Column:
    powers = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(let(values, powers), lambda p: let(total(p), lambda t: F.transform(p, lambda x: x / t)))


def argmax(values: Column) -> Column:
    """The first place of the greatest value, from 0."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def band_means(values: Column, bands: int = 24) -> Column:
    """Means of ``bands`` stretches of nearly one length; 0 for a stretch without values."""

    def body(v: Column) -> Column:
        n = F.size(v)
        begin = lambda b: F.floor(b * n / bands).cast("int")
        stretch = lambda b: let(F.slice(v, begin(b) + 1, begin(b + 1) - begin(b)), lambda x: F.when(F.size(x) > 0, total(x) / F.size(x)).otherwise(F.lit(0.0)))
        return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), stretch)

    return let(values, body)
