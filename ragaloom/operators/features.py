"""Histograms, n-grams and feature vectors of pitch series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragaloom.functions import arrays, pitch

CLASSES, COARSE, BINS = 12, 6, 120


def tonics(frames: DataFrame, fallback: float = 0.0) -> DataFrame:
    """(track_id, tonic): exact median of the voiced frames; the fallback for a track without any."""
    return frames.groupBy("track_id").agg(F.coalesce(F.median(F.when(pitch.is_voiced(F.col("hz")), F.col("hz"))), F.lit(fallback)).alias("tonic"))


def in_cents(frames: DataFrame, tonic: DataFrame) -> DataFrame:
    """The voiced frames with ``cents`` above their track's tonic and ``at``, their place among the voiced ones."""
    joined = frames.filter(pitch.is_voiced(F.col("hz"))).join(tonic.filter("tonic > 0"), "track_id")
    by_track = Window.partitionBy("track_id").orderBy("idx")
    return joined.withColumn("cents", 1200.0 * F.log2(F.col("hz") / F.col("tonic"))).withColumn("at", F.row_number().over(by_track) - 1)


def histogram(cents: DataFrame, bins: int = BINS) -> DataFrame:
    """(track_id, bin, share): octave-folded; shares over the frames plus 1e-9."""
    counts = cents.groupBy("track_id", pitch.histogram_bin(F.col("cents"), bins).alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy("track_id")) + 1e-9)).drop("n")


def grams(cents: DataFrame, length: int, classes: int, mode: str = "presence") -> DataFrame:
    """(track_id, gram array, share) of runs of ``length`` classes. By presence each distinct run counts once; ``count`` counts all."""
    by_track = Window.partitionBy("track_id").orderBy("at")
    kinds = cents.select("track_id", "at", pitch.class_bin(F.col("cents"), classes).alias("c"))
    runs = kinds.select("track_id", F.array("c", *[F.lead("c", i).over(by_track) for i in range(1, length)]).alias("gram")).filter(~F.array_contains(F.transform("gram", lambda x: x.isNull()), True))
    counts = runs.groupBy("track_id", "gram").agg((F.lit(1) if mode == "presence" else F.count("*")).alias("n"))
    return counts.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy("track_id")) + 1e-9)).drop("n")


def contours(frames: DataFrame) -> DataFrame:
    """(track_id, frequencies): a track's frames in order; a track is one recording, so its array is bounded."""
    return frames.groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "hz"))), lambda s: s["hz"]).alias("frequencies"))


def vectors(series: DataFrame, least: int = 10) -> DataFrame:
    """(track_id, features array<double>) of 480: histogram, pairs of 12 classes, triples of 6; null below ``least`` voiced frames.

    ``series`` has track_id, frequencies and tonic. All is array expressions over one row; nothing is shuffled.
    """

    def spread(keys, width: int):
        """A vector with 1 / (distinct + 1e-9) at each distinct key."""
        share = lambda d: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(F.array_contains(d, k), 1.0 / (F.size(d) + 1e-9)).otherwise(0.0))
        return arrays.let(F.array_distinct(keys), share)

    def vector(c):
        n = F.size(c)
        places = lambda less: F.sequence(F.lit(0), n - less)
        folded = arrays.let(F.transform(c, lambda x: pitch.histogram_bin(x)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.size(F.filter(h, lambda x: x == k)) / (n + 1e-9)))
        pairs = arrays.let(F.transform(c, lambda x: pitch.class_bin(x, CLASSES)), lambda p: F.transform(places(2), lambda i: F.get(p, i) * CLASSES + F.get(p, i + 1)))
        triples = arrays.let(F.transform(c, lambda x: pitch.class_bin(x, COARSE)), lambda q: F.transform(places(3), lambda i: (F.get(q, i) * COARSE + F.get(q, i + 1)) * COARSE + F.get(q, i + 2)))
        return F.when(n >= max(least, 3), F.concat(folded, spread(pairs, CLASSES**2), spread(triples, COARSE**3)))

    cents = F.transform(arrays.voiced(F.col("frequencies")), lambda x: 1200.0 * F.log2(x / F.col("tonic")))
    return series.select("track_id", F.when(F.col("tonic") > 0, arrays.let(cents, vector)).alias("features"))


def model_input(frequencies: Column, tonic: Column, mode: str) -> Column:
    """What a net of the mode reads: the shares of pitch classes, or the contour in cents with 0 where unvoiced; null
    without a tonic."""
    cents = F.transform(frequencies.cast("array<double>"), lambda x: F.when(x > 0, 1200.0 * F.log2(x / tonic)).otherwise(0.0))
    if mode not in ("pcd", "contour"):
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(tonic > 0, arrays.class_distribution(cents) if mode == "pcd" else cents)
