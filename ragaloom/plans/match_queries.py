"""Contour matching and its scores over ``embeddings`` and the contour catalog, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragaloom.functions import arrays
from ragaloom.operators import evaluate, match
from ragaloom.plans import series_queries
from ragaloom.session import table


def contours(spark, d):
    z = arrays.standardised(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("track_id"), "label", z.alias("contour")).filter("contour is not null")


def _ranked(spark, d):
    c = contours(spark, d)
    return match.top_matches(c, c, 5, 64, exclude_self=True)


def j03_leave_one_out(spark, d):
    return _ranked(spark, d).select("query_id", "rank", "track_id", F.round("similarity", 6).alias("similarity"))


def j01_contour_matches(spark, d):
    """Queries are the vectors whose id is divisible by 50; each finds itself first."""
    c = contours(spark, d)
    return match.top_matches(c.filter("track_id % 50 = 0"), c, 5, 64).select("query_id", "rank", "track_id", F.round("similarity", 6).alias("similarity"))


def _labelled(spark, d):
    labels = contours(spark, d).select("track_id", "label")
    named = _ranked(spark, d).join(labels, "track_id").join(labels.select(F.col("track_id").alias("query_id"), F.col("label").alias("target")), "query_id")
    return named.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("target"), F.col("rank"))).alias("rank"))


def w07_first_rank(spark, d):
    return _labelled(spark, d).select("query_id", F.coalesce("rank", F.lit(-1)).alias("rank"))


def a12_retrieval(spark, d):
    e = evaluate.retrieval(_labelled(spark, d))
    return e.select(*[F.round(c, 6).alias(c) for c in ("top1", "top3", "top5", "mrr")], "n")


def d12_matches(spark, d):
    """Each pitch series against the contour catalog."""
    asked = match.encode(series_queries.series(spark, d), 500)
    catalog = table(spark, d, "composition_catalog_contours").filter("contour is not null and size(contour) = 500").select("track_id", "contour")
    return match.top_matches(asked.select(F.col("track_id").cast("string").alias("track_id"), "contour"), catalog, 3, 500, raw=True).select("query_id", "rank", "track_id", F.round("similarity", 5).alias("similarity"))


def d13_warped_matches(spark, d):
    """By subsequence time warping, which is the default: the vectors whose id is divisible by 50 against all."""
    c = contours(spark, d)
    return match.warped_matches(c.filter("track_id % 50 = 0"), c, 3).withColumn("similarity", F.round("similarity", 6))


def d09_banded_matches(spark, d):
    """By time warping of whole contours within a band of 100: the vectors whose id is divisible by 50 against all."""
    c = contours(spark, d)
    return match.warped_matches(c.filter("track_id % 50 = 0"), c, 3, window=100, subsequence=False).withColumn("similarity", F.round("similarity", 6))


def d13_invariants(spark, d):
    """Queries and ranks of both ways of warping; by whole contours each query comes first for itself, with similarity 1."""
    both = d13_warped_matches(spark, d).select(F.lit("subsequence").alias("way"), "query_id", "rank", "track_id", "similarity").unionByName(d09_banded_matches(spark, d).select(F.lit("whole").alias("way"), "query_id", "rank", "track_id", "similarity"))
    own = (F.col("rank") == 1) & (F.col("similarity") == 1) & (F.col("way") == "whole")
    return both.groupBy("way").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("n_queries"), F.count_if(own).alias("n_own"), F.count_if((F.col("similarity") < 0) | (F.col("similarity") > 1)).alias("n_outside"))


def a11_pair_distances(spark, d):
    c = contours(spark, d)
    return match.pair_distances(c.filter("track_id % 50 = 0"), c).select("query_id", "track_id", F.round("distance", 5).alias("distance"))


def k03_top_classes(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.posexplode(arrays.softmax(F.transform("embedding", lambda x: x.cast("double")))).alias("class", "p"))
    w = Window.partitionBy("vec_id").orderBy(F.desc(F.round("p", 9)), "class")
    return p.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("vec_id", "class", F.round("p", 6).alias("p"), "rank")


QUERIES = {f.__name__: f for f in (j03_leave_one_out, j01_contour_matches, w07_first_rank, a12_retrieval, d12_matches, d13_warped_matches, d09_banded_matches, d13_invariants, a11_pair_distances, k03_top_classes)}

_Z = """z AS (SELECT vec_id, label, k, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) WINDOW w AS (PARTITION BY vec_id)),
  dist AS (SELECT a.vec_id AS query_id, b.vec_id AS track_id, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 9) AS d FROM z a JOIN z b ON a.k = b.k WHERE {0} GROUP BY ALL),
  r AS (SELECT query_id, track_id, (row_number() OVER (PARTITION BY query_id ORDER BY d, track_id))::INT AS rank, d FROM dist QUALIFY rank <= 5)"""
_LOO = _Z.format("a.vec_id <> b.vec_id")
_FIRST = f"""WITH {_LOO}, l AS (SELECT vec_id, label FROM embeddings), s AS (SELECT r.query_id, min(CASE WHEN a.label = b.label THEN rank END) AS rank
  FROM r JOIN l a ON a.vec_id = r.track_id JOIN l b ON b.vec_id = r.query_id GROUP BY r.query_id)"""
SQL = {
    "d13_invariants": f"""WITH {_Z.split("dist AS")[0].rstrip().rstrip(",")}, q AS (SELECT count(DISTINCT vec_id) AS n FROM z WHERE vec_id % 50 = 0 AND x IS NOT NULL), a AS (SELECT least(3, count(DISTINCT vec_id)) AS k FROM z WHERE x IS NOT NULL)
      SELECT way, q.n * a.k AS n, q.n AS n_queries, CASE WHEN way = 'whole' THEN q.n ELSE 0 END AS n_own, 0::BIGINT AS n_outside FROM q, a, (VALUES ('whole'), ('subsequence')) w(way)""",
    "j03_leave_one_out": f"WITH {_LOO} SELECT query_id, rank, track_id, round(1 / (1 + d / 64), 6) AS similarity FROM r",
    "j01_contour_matches": f"WITH {_Z.format('a.vec_id % 50 = 0')} SELECT query_id, rank, track_id, round(1 / (1 + d / 64), 6) AS similarity FROM r",
    "a11_pair_distances": f"WITH {_Z.format('a.vec_id % 50 = 0')} SELECT query_id, track_id, round(d, 5) AS distance FROM dist",
    "w07_first_rank": f"{_FIRST} SELECT query_id, coalesce(rank, -1)::INT AS rank FROM s",
    "a12_retrieval": f"{_FIRST} SELECT round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS top3, round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS top5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) AS n FROM s",
    "k03_top_classes": """WITH e AS (SELECT vec_id, k - 1 AS class, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings))
      SELECT vec_id, class::INT AS class, round(p, 6) AS p, (row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 9) DESC, class))::INT AS rank FROM e QUALIFY rank <= 3""",
    "d12_matches": f"""WITH {series_queries.FRAMES}, x AS ({series_queries.RESAMPLED.format("cents", 499)}),
      q AS (SELECT track_id::VARCHAR AS id, k, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM x WHERE track_id IN (SELECT track_id FROM v GROUP BY track_id HAVING count(*) >= 50) WINDOW w AS (PARTITION BY track_id)),
      u AS (SELECT track_id, unnest(contour)::DOUBLE AS x, generate_subscripts(contour, 1) - 1 AS k FROM composition_catalog_contours WHERE contour IS NOT NULL),
      ok AS (SELECT track_id FROM u GROUP BY track_id HAVING count(*) = 500 AND bool_and(isfinite(x)) AND stddev_pop(CASE WHEN isfinite(x) THEN x END) >= 1e-6),
      cc AS (SELECT track_id AS id, k, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x FROM u SEMI JOIN ok USING (track_id) WINDOW w AS (PARTITION BY track_id)),
      dd AS (SELECT q.id AS query_id, cc.id AS track_id, round(sqrt(sum((q.x - cc.x) * (q.x - cc.x))), 9) AS d FROM q JOIN cc USING (k) GROUP BY ALL)
      SELECT query_id, track_id, (row_number() OVER (PARTITION BY query_id ORDER BY d, track_id))::INT AS rank, round(1 / (1 + d / 500), 5) AS similarity FROM dd QUALIFY rank <= 3""",
}
