"""Ranks and runs in an order, without giving all rows of a key to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragaloom.operators.skew import attach
from ragaloom.session import written

#: Slices that the rows of a key are cut into.
SLICES = 64


def sliced(df: DataFrame, column: str, slices: int = SLICES) -> Column:
    """The slice (0 to ``slices`` - 1) of a row by approximate quantiles of a numeric or time column; it grows with the
    column, and equal values share a slice. Nulls, which sort first, are in slice 0."""
    kind = df.schema[column].dataType.typeName()
    number = F.unix_micros(F.col(column).cast("timestamp")) if "timestamp" in kind else F.col(column).cast("double")
    cuts = df.select(F.percentile_approx(number, [i / slices for i in range(1, slices)], 2000)).first()[0] or []
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: c < number)) if cuts else F.lit(0)


def by_letters(column: Column) -> Column:
    """The slice of a text by its first three characters; it grows with the order of texts."""
    letter = lambda i: F.ascii(F.substring(column, i, 1)).cast("long")
    return F.coalesce(letter(1) * (1 << 42) + letter(2) * (1 << 21) + letter(3), F.lit(0).cast("long"))


def ranked(df: DataFrame, keys: list[str], piece: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its rank (long, from 1) among the rows of its key by ``order``; without keys, among all rows.

    ``piece`` cuts a key's rows into slices and must grow with the order. A task ranks a slice of a key; to that come
    the rows of the slices before it, from a table of counts by key and slice. So a key that holds most rows, or all,
    is spread over its slices. Null keys are a key. The columns _k, _s and _n must not occur.
    """
    held = written(df.withColumn("_s", piece).withColumn("_k", F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("_")))), "ranked")
    counts = held.groupBy("_k", "_s").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_k", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    within = held.withColumn(name, F.row_number().over(Window.partitionBy("_k", "_s").orderBy(*order)).cast("long"))
    return attach(within, counts, ["_k", "_s"]).withColumn(name, F.col(name) + F.col("_n")).select(*df.columns, name)


def runs(df: DataFrame, key: str, piece: Column, order: list[Column], hit: Column) -> DataFrame:
    """(key, n): the length of every unbroken run of rows for which ``hit`` holds (null doesn't), by key and ``order``.

    A task looks at a slice of a key (see ``ranked``). Runs that reach neither end of their slice are whole; those that
    do, at most two a slice, are joined over the slices' ends. Null keys are a key.
    """
    own = Window.partitionBy(key, "_s").orderBy(*order)
    both = Window.partitionBy(key, "_s", "_hit").orderBy(*order)
    rows = df.withColumn("_s", piece).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumn("_i", F.row_number().over(own)).withColumn("_island", F.col("_i") - F.row_number().over(both))
    sizes = rows.groupBy(key, "_s").agg(F.count("*").alias("_size"))
    found = rows.filter("_hit").groupBy(key, "_s", "_island").agg(F.min("_i").alias("_from"), F.max("_i").alias("_to"))
    found = written(found.withColumnRenamed(key, "_key"), "runs")
    ends = sizes.select(F.col(key).alias("_key2"), F.col("_s").alias("_s2"), "_size")
    told = found.join(ends, F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("_s") == F.col("_s2"))).select("_key", "_s", "_from", (F.col("_to") - F.col("_from") + 1).alias("n"), (F.col("_from") == 1).alias("at_start"), (F.col("_to") == F.col("_size")).alias("at_end"))
    whole = told.filter("not at_start and not at_end").select("_key", "n")
    # slices of a key that have rows follow each other without a gap in this numbering
    placed = sizes.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy("_s"))).select(F.col(key).alias("_key2"), F.col("_s").alias("_s2"), "_place")
    edge = told.filter("at_start or at_end").join(placed, F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("_s") == F.col("_s2")))
    w = Window.partitionBy("_key").orderBy("_place", "_from")
    follows = F.col("at_start") & F.lag("at_end").over(w) & (F.lag("_place").over(w) == F.col("_place") - 1)
    groups = edge.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    joined = groups.groupBy("_key", "_g").agg(F.sum("n").alias("n")).select("_key", "n")
    return whole.unionByName(joined).select(F.col("_key").alias(key), "n")
