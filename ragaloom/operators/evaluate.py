"""Scores of rankings and classifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval(ranks: DataFrame) -> DataFrame:
    """One row: top1, top3, top5, mrr and n of ``ranks`` (rank of the right answer, null if absent); zeros if empty."""
    hit = lambda k: F.coalesce(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), F.lit(0.0))
    return ranks.agg(hit(1).alias("top1"), hit(3).alias("top3"), hit(5).alias("top5"), F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"), F.count("*").alias("n"))


def confusion(told: DataFrame) -> DataFrame:
    """(label, prediction, n)."""
    return told.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def by_class(told: DataFrame) -> DataFrame:
    """(label, n, accuracy) for each label that occurs."""
    return told.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def accuracy(told: DataFrame) -> DataFrame:
    """One row: n evaluated (label known), correct, accuracy; a null prediction is wrong, 0 if nothing was evaluated."""
    right = F.coalesce((F.col("label") == F.col("prediction")).cast("long"), F.lit(0).cast("long"))
    return told.filter("label is not null").agg(F.count("*").alias("n"), F.coalesce(F.sum(right), F.lit(0)).alias("correct"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"))


def epochs(batches: DataFrame) -> DataFrame:
    """(epoch, loss, accuracy) of ``batches`` (epoch, loss, correct, n): means weighted by the rows of a batch; 0 without rows."""
    n = F.greatest(F.sum("n"), F.lit(1))
    return batches.groupBy("epoch").agg((F.coalesce(F.sum(F.col("loss") * F.col("n")), F.lit(0.0)) / n).alias("loss"), (F.coalesce(F.sum("correct"), F.lit(0)) / n).alias("accuracy"))


def stop_epoch(losses: DataFrame, patience: int = 8) -> DataFrame:
    """One row: best_epoch, best_loss and last_epoch of ``losses`` (epoch, loss), if training ends once ``patience`` epochs
    in a row bring no lower loss. An epoch counts as better only if it is lower than all before it. Epochs are few."""
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)  # one row for each epoch of one training
    x = losses.withColumn("better", F.coalesce(F.col("loss") < F.min("loss").over(before), F.lit(True)))
    since = x.withColumn("best", F.max(F.when(F.col("better"), F.col("epoch"))).over(Window.orderBy("epoch")))
    end = since.agg(F.coalesce(F.min(F.when(F.col("epoch") - F.col("best") >= patience, F.col("epoch"))), F.max("epoch")).alias("last_epoch"))
    return since.join(F.broadcast(end), F.col("epoch") == F.col("last_epoch")).select(F.col("best").alias("best_epoch"), "last_epoch").join(
        losses.select(F.col("epoch").alias("best_epoch"), F.col("loss").alias("best_loss")), "best_epoch").select("best_epoch", "best_loss", "last_epoch")


def weighted_loss(told: DataFrame) -> DataFrame:
    """One row: the mean of -ln of the probability given to the right label, over ``told`` (n rows each of a ``loss``)."""
    return told.agg(F.coalesce(F.sum(F.col("loss") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("loss"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def tala_validated(truth: DataFrame, told: DataFrame) -> DataFrame:
    """One row: evaluated, correct, skipped, failed, accuracy (null if none was evaluated) of ``told`` (track_id,
    beats_per_cycle, problem) by ``truth`` (track_id, beats, null where nothing is annotated).

    Tracks without annotation, or that weren't told at all, are skipped; those with a problem failed.
    """
    both = truth.join(told, "track_id", "left")
    skipped = F.col("beats").isNull() | F.col("beats_per_cycle").isNull() & F.col("problem").isNull()
    failed = ~skipped & F.col("problem").isNotNull()
    fine = ~skipped & ~failed
    right = fine & (F.col("beats") == F.col("beats_per_cycle"))
    return both.agg(F.count_if(fine).alias("evaluated"), F.count_if(right).alias("correct"), F.count_if(skipped).alias("skipped"), F.count_if(failed).alias("failed"), (F.count_if(right) / F.nullif(F.count_if(fine), F.lit(0))).alias("accuracy"))
