"""Rhythmic cycles from beat times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tala and confidence by beats in a cycle.
TALA_OF = {8: ("Adi", 0.9), 14: ("Misra", 0.7), 7: ("Misra Chapu", 0.75), 6: ("Rupaka", 0.7), 5: ("Khanda Chapu", 0.75), 3: ("Rupaka", 0.65)}


def intervals(beats: DataFrame) -> DataFrame:
    """(track_id, k, interval) between successive beats (track_id, t in seconds); k from 0."""
    w = Window.partitionBy("track_id").orderBy("t")
    return beats.select("track_id", (F.row_number().over(w) - 2).alias("k"), (F.col("t") - F.lag("t").over(w)).alias("interval")).filter("k >= 0")


def periods(gaps: DataFrame, least: int = 3, most: int = 12) -> DataFrame:
    """(track_id, period): the lag of highest autocorrelation among ``least``..``most``, the first of equals; 0 if none is positive."""
    by_track = Window.partitionBy("track_id")
    centred = gaps.withColumn("n", F.count("*").over(by_track)).withColumn("c", F.col("interval") - F.avg("interval").over(by_track))
    w = by_track.orderBy("k")
    lagged = centred.select("track_id", "n", "c", *[F.lag("c", i).over(w).alias(f"c{i}") for i in range(least, most + 1)])
    sums = lagged.groupBy("track_id").agg(F.first("n").alias("n"), F.sum(F.col("c") * F.col("c")).alias("norm"), *[F.sum(F.col("c") * F.col(f"c{i}")).alias(f"s{i}") for i in range(least, most + 1)])
    tried = F.array(*[F.when((F.col("n") > i) & (F.col("norm") > 1e-18), F.struct((F.col(f"s{i}") / F.col("norm")).alias("score"), F.lit(-i).alias("k"))) for i in range(least, most + 1)])
    best = F.array_max(F.filter(tried, lambda x: x.isNotNull() & x["score"].isNotNull()))
    return sums.select("track_id", F.when((F.col("n") >= 2 * least) & (best["score"] > 0), -best["k"]).otherwise(0).cast("int").alias("period"))


def classified(beats_per_cycle: Column) -> Column:
    """(tala_name, confidence) by beats in a cycle."""
    name, sure = F.lit("Unknown"), F.lit(0.2)
    for beats, (tala, confidence) in TALA_OF.items():
        name, sure = F.when(beats_per_cycle == beats, tala).otherwise(name), F.when(beats_per_cycle == beats, confidence).otherwise(sure)
    return F.struct(name.alias("tala_name"), sure.alias("confidence"))


def analysed(beats: DataFrame, least: int = 3, most: int = 12) -> DataFrame:
    """(track_id, tala_name, confidence, cycle_duration_seconds, beats_per_cycle, tempo_bpm) for each track with a beat.

    A cycle is the dominant period times the median interval; without a period the whole span is one cycle. Fewer than
    two beats, or a median interval that isn't positive, give Unknown.
    """
    gaps = intervals(beats)
    whole = beats.groupBy("track_id").agg(F.count("*").alias("n_beats"), (F.max("t") - F.min("t")).alias("span"))
    middle = gaps.groupBy("track_id").agg(F.median("interval").alias("middle"))
    x = whole.join(middle, "track_id", "left").join(periods(gaps, least, most), "track_id", "left")
    clear = F.col("middle") > 0
    x = x.withColumn("cycle", F.when(clear, F.when(F.col("period") > 0, F.col("period") * F.col("middle")).otherwise(F.col("span"))))
    x = x.withColumn("beats", F.when(clear & (F.col("cycle") > 0), F.rint(F.col("cycle") / F.col("middle")).cast("int")))
    told = classified(F.coalesce("beats", F.lit(0)))
    few = F.col("n_beats") < 2
    return x.select(
        "track_id", F.when(few, "Unknown").otherwise(told["tala_name"]).alias("tala_name"), F.when(few, 0.0).otherwise(told["confidence"]).alias("confidence"),
        F.when(F.col("cycle") > 0, F.col("cycle")).alias("cycle_duration_seconds"), F.when(F.col("beats") > 0, F.col("beats")).alias("beats_per_cycle"),
        F.when(clear, 60.0 / F.col("middle")).otherwise(0.0).alias("tempo_bpm"),
    )


def demoted(found: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Unknown where the confidence is under the threshold; the other columns stay."""
    return found.withColumn("tala_name", F.when(F.col("confidence") < threshold, "Unknown").otherwise(F.col("tala_name")))


def true_beats(beats_per_cycle: Column, bpm: Column, sama_interval: Column) -> Column:
    """Annotated beats in a cycle; else from tempo and the seconds between samas; values that are no numbers count as missing."""
    given, tempo, gap = (F.expr("1") * c.try_cast("double") for c in (beats_per_cycle, bpm, sama_interval))
    return F.when(given > 0, F.rint(given)).when((tempo > 0) & (gap > 0), F.rint(tempo * gap / 60.0)).cast("int")
