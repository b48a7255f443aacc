"""Queries of the classifiers and of live features; results of models are compared by rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragaloom.functions import pitch
from ragaloom.ml import nets, raga
from ragaloom.plans import series_queries
from ragaloom.session import table
from ragaloom.streaming import live


def _rows(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def _top(kind):
    def run(spark, d):
        rows = _rows(spark, d)
        return raga.top(raga.fit(rows, kind), rows, "vec_id").withColumn("confidence", F.round("confidence", 6))

    return run


def l02_svm_top(spark, d):
    """The linear machine on random features that stands for the RBF kernel."""
    rows = _rows(spark, d)
    rows = rows.withColumn("features", raga.random_features(F.col("features"), 64))
    return raga.top(raga.fit(rows, "svm"), rows, "vec_id")


def l09_net_top(spark, d):
    """The net of two hidden layers, trained by Adam with early stopping on a fifth of the rows that it doesn't see."""
    dealt = raga.folds(_rows(spark, d), "label", "vec_id")
    labels = [r[0] for r in dealt.select("label").distinct().orderBy("label").collect()]
    net, _ = nets.train(nets.Net("pcd", labels, inputs=64), dealt.filter("fold > 0"), dealt.filter("fold = 0"))
    return nets.top(net, _rows(spark, d), "vec_id").withColumn("confidence", F.round("confidence", 6))


def l07_invariants(spark, d):
    """Each row has three labels by the forest, ranked by confidences that are in order."""
    told = l03_forest_top(spark, d).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("rank", "raga_name", "confidence"))).alias("x"))
    falling = F.col("x")[0]["confidence"] >= F.col("x")[1]["confidence"]
    return told.select("vec_id", F.size("x").alias("n"), F.size(F.array_distinct("x.raga_name")).alias("labels"), falling.alias("falling"))


l03_forest_top, l04_network_top = _top("forest"), _top("mlp")


def z01_windows(spark, d):
    """Pitch-class shares in windows of six hours, by the plan that a stream runs."""
    frames = table(spark, d, "events").select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("hz"))
    w = live.windows(frames, "6 hours")
    return w.select("track_id", F.unix_seconds("start").alias("start"), "n", "n_voiced", F.round("mean_hz", 6).alias("mean_hz"), F.round(F.get("shares", F.lit(0)), 6).alias("share_0"))


def z02_cube(spark, d):
    return table(spark, d, "tracks_meta").rollup("raga", "title").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("g"))


def z03_track_sketch(spark, d):
    """Approximate and exact distinct frequencies."""
    f = series_queries.frames(spark, d).filter(pitch.is_voiced(F.col("hz")))
    return f.agg(F.countDistinct("hz").alias("exact"), (F.abs(F.approx_count_distinct("hz", 0.02) / F.countDistinct("hz") - 1) < 0.1).alias("near"))


QUERIES = {"l03_forest_top": l03_forest_top, "l04_network_top": l04_network_top} | {f.__name__: f for f in (l02_svm_top, l07_invariants, l09_net_top, z01_windows, z02_cube, z03_track_sketch)}
SQL = {
    "l07_invariants": "SELECT vec_id, 3::INT AS n, 3::INT AS labels, true AS falling FROM embeddings",
    "z01_windows": """SELECT user_id AS track_id, (epoch(ts)::BIGINT - epoch(ts)::BIGINT % 21600) AS start, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_voiced, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_hz,
      round(count(*) FILTER (event_type <> 'error' AND (round_even(12 * log2(value / 130.0::DOUBLE), 0)::BIGINT % 12 + 12) % 12 = 0) / greatest(1, count(*) FILTER (event_type <> 'error'))::DOUBLE, 6) AS share_0 FROM (SELECT *, ts AS t FROM events) GROUP BY user_id, start""",
    "z02_cube": "SELECT raga, title, count(*) AS n, grouping(raga, title)::INT AS g FROM tracks_meta GROUP BY ROLLUP (raga, title)",
    "z03_track_sketch": f"WITH {series_queries.FRAMES} SELECT count(DISTINCT hz) AS exact, true AS near FROM f WHERE hz > 0",
}
