"""Pitch and beat queries over ``events`` (a user is a track, a value a frame's frequency, errors are unvoiced), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragaloom.functions import arrays, pitch
from ragaloom.ml import augment, nets, raga
from ragaloom.operators import features, tala
from ragaloom.session import table
from ragaloom.sources import files



def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, idx, hz)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hz = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), (F.row_number().over(w) - 1).alias("idx"), hz.alias("hz"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, t seconds)."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), seconds.alias("t"))


def voiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return features.in_cents(f, features.tonics(f))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return features.contours(f).join(features.tonics(f), "track_id")


FRAMES = """f AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value END AS hz FROM events),
t AS (SELECT track_id, coalesce(quantile_cont(CASE WHEN hz > 0 THEN hz END, 0.5), 0) AS tonic FROM f GROUP BY track_id),
v AS (SELECT track_id, idx, hz, tonic, 1200::DOUBLE * log2(hz / tonic) AS cents, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS ix
  FROM f JOIN t USING (track_id) WHERE hz > 0 AND tonic > 0),
o AS (SELECT *, CASE WHEN m < 0 THEN m + 1200 ELSE m END AS oct FROM (SELECT *, cents - 1200 * trunc(cents / 1200) AS m FROM v)),
c AS (SELECT f.track_id, f.idx, hz, CASE WHEN hz > 0 AND tonic > 0 THEN 1200::DOUBLE * log2(hz / tonic) ELSE 0 END AS cents FROM f JOIN t USING (track_id))"""
GAPS = """b AS (SELECT user_id AS track_id, epoch_us(ts) / 1e6::DOUBLE AS t FROM events),
g AS (SELECT track_id, row_number() OVER w - 2 AS k, t - lag(t) OVER w AS gap FROM b WINDOW w AS (PARTITION BY track_id ORDER BY t)),
i AS (SELECT track_id, k, gap FROM g WHERE k >= 0)"""
PERIOD = f"""{GAPS}, z AS (SELECT track_id, k, gap - avg(gap) OVER (PARTITION BY track_id) AS c, count(*) OVER (PARTITION BY track_id) AS n FROM i),
s AS (SELECT a.track_id, any_value(a.n) AS n, lag_.l AS l, sum(a.c * b.c) AS s FROM z a JOIN range(3, 13) lag_(l) ON true JOIN z b ON a.track_id = b.track_id AND b.k = a.k - lag_.l GROUP BY a.track_id, lag_.l),
norm AS (SELECT track_id, sum(c * c) AS norm FROM z GROUP BY track_id),
best AS (SELECT track_id, arg_max(l, s / norm - l * 1e-12) AS l, max(s / norm) AS top, any_value(n) AS n FROM s JOIN norm USING (track_id) WHERE norm > 1e-18 AND l < n GROUP BY track_id),
p AS (SELECT track_id, CASE WHEN best.n >= 6 AND top > 0 THEN l ELSE 0 END AS period FROM (SELECT DISTINCT track_id FROM z) LEFT JOIN best USING (track_id))"""



def _r(c) -> F.Column:
    return F.round(c, 6)


def f01_cents(spark, d):
    f = frames(spark, d)
    return f.join(features.tonics(f), "track_id").select("track_id", "idx", _r(pitch.cents(F.col("hz"), F.col("tonic"))).alias("cents"))


def f02_octave_fold(spark, d):
    return voiced(spark, d).select("track_id", "idx", _r(pitch.floored(F.col("cents"), 1200)).alias("folded"))


def f03_class_bins(spark, d):
    c = F.col("cents")
    return voiced(spark, d).select("track_id", "idx", pitch.class_bin(c, 12).alias("pc12"), pitch.class_bin(c, 6).alias("pc6"), pitch.histogram_bin(c).alias("bin"))


def f04_similarity(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dist = F.sqrt(arrays.total(F.transform("v", lambda x: x * x)))
    return e.select("vec_id", _r(pitch.similarity(dist, 64)).alias("scaled"), _r(pitch.similarity(dist)).alias("plain"))


def p01_voiced(spark, d):
    return frames(spark, d).filter(pitch.is_voiced(F.col("hz"))).groupBy("track_id").agg(F.count("*").alias("n"), _r(F.sum("hz")).alias("sum_hz"))


def p02_unvoiced_dropped(spark, d):
    s = series(spark, d)
    c = F.transform("frequencies", lambda x: pitch.cents(x, F.col("tonic")))
    return s.select("track_id", F.size(arrays.without_zeros(c)).alias("n"))


def p03_sanitised(spark, d):
    raw = table(spark, d, "events").select(F.col("user_id").alias("track_id"), F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")).alias("hz"))
    return raw.groupBy("track_id").agg(F.count_if(pitch.sanitised(F.col("hz")) == 0).alias("n_zero"), _r(F.sum(pitch.sanitised(F.col("hz")))).alias("sum_hz"))


def p05_evidence(spark, d):
    s = series(spark, d)
    n = F.size(arrays.voiced(F.col("frequencies")))
    return s.select("track_id", n.alias("n_voiced"), ((F.col("tonic") > 0) & (n >= 10)).alias("raga_ok"), arrays.encoded(F.col("frequencies"), F.col("tonic"), 500).isNotNull().alias("contour_ok"))


def a01_tonic(spark, d):
    return features.tonics(frames(spark, d)).select("track_id", _r(F.col("tonic")).alias("tonic"))


def a02_class_distribution(spark, d):
    s = series(spark, d)
    p = arrays.class_distribution(F.transform("frequencies", lambda x: pitch.cents(x, F.col("tonic"))))
    return s.select("track_id", F.posexplode(p).alias("pitch_class", "share")).select("track_id", "pitch_class", _r(F.col("share")).alias("share"))


def a03_histogram(spark, d):
    return features.histogram(voiced(spark, d)).select("track_id", "bin", _r(F.col("share")).alias("share"))


def a04_pairs(spark, d):
    return features.grams(voiced(spark, d), 2, 12).select("track_id", F.col("gram")[0].alias("a"), F.col("gram")[1].alias("b"), _r(F.col("share")).alias("share"))


def a05_triples(spark, d):
    g = F.col("gram")
    return features.grams(voiced(spark, d), 3, 6).select("track_id", g[0].alias("a"), g[1].alias("b"), g[2].alias("c"), _r(F.col("share")).alias("share"))


def a06_vectors(spark, d):
    v = features.vectors(series(spark, d))
    return v.select("track_id", F.posexplode("features").alias("pos", "x")).filter("x <> 0").select("track_id", "pos", _r(F.col("x")).alias("x"))


def a10_moments(spark, d):
    heard = voiced(spark, d)
    return heard.groupBy("track_id").agg(_r(F.avg("cents")).alias("mean"), _r(F.stddev_pop("cents")).alias("deviation"))


def a21_duration(spark, d):
    """A track's frames over its rate, here its unvoiced frames; 0 where the rate is 0."""
    n = frames(spark, d).groupBy("track_id").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("hz") == 0).alias("rate"))
    return n.select("track_id", _r(pitch.duration(F.col("n"), F.col("rate"))).alias("seconds"))


def a22_pooled(spark, d):
    s = series(spark, d)
    return s.select("track_id", F.posexplode(arrays.pooled(F.col("frequencies"), 4)).alias("block", "x")).select("track_id", "block", _r(F.col("x")).alias("x"))


def a23_frame_counts(spark, d):
    return frames(spark, d).groupBy("track_id").agg(F.count("*").alias("n"), F.count_if(pitch.is_voiced(F.col("hz"))).alias("n_voiced"))


def w01_intervals(spark, d):
    return tala.intervals(beats(spark, d)).select("track_id", F.col("k").cast("int").alias("k"), _r(F.col("interval")).alias("gap"))


def w02_neighbours(spark, d):
    w = Window.partitionBy("track_id").orderBy("at")
    x = voiced(spark, d).select("track_id", "at", _r(F.col("cents")).alias("a"), _r(F.lead("cents", 1).over(w)).alias("b"), _r(F.lead("cents", 2).over(w)).alias("c"))
    return x.filter("b is not null").select("track_id", F.col("at").cast("int").alias("ix"), "a", "b", "c")


def _smooth(window: int):
    def run(spark, d):
        return series(spark, d).select("track_id", F.posexplode(arrays.smoothed(F.col("frequencies"), window)).alias("idx", "x")).select("track_id", "idx", _r(F.col("x")).alias("x"))

    return run


def w04_interpolated(spark, d):
    return series(spark, d).select("track_id", F.posexplode(arrays.interpolated(F.col("frequencies"))).alias("idx", "x")).select("track_id", "idx", _r(F.col("x")).alias("x"))


def w05_resampled(spark, d):
    return series(spark, d).select("track_id", F.posexplode(arrays.resampled(arrays.voiced(F.col("frequencies")), 500)).alias("k", "x")).select("track_id", "k", _r(F.col("x")).alias("x"))


def w06_period(spark, d):
    return tala.periods(tala.intervals(beats(spark, d)))


def w10_segments(spark, d):
    s = series(spark, d).select("track_id", F.posexplode(arrays.segments(F.col("frequencies"), 30)).alias("piece", "x"))
    return s.select("track_id", "piece", F.size("x").alias("n"), _r(arrays.total(F.col("x"))).alias("sum_hz"))


def w12_fixed_length(spark, d):
    return series(spark, d).select("track_id", F.posexplode(arrays.fixed_length(F.col("frequencies"), 64)).alias("pos", "x")).select("track_id", "pos", _r(F.col("x")).alias("x"))


def d07_preprocessed(spark, d):
    return series(spark, d).select("track_id", F.posexplode(arrays.preprocessed(F.col("frequencies"))).alias("block", "x")).select("track_id", "block", _r(F.col("x")).alias("x"))


def d11_encoded(spark, d):
    e = series(spark, d).select("track_id", arrays.encoded(F.col("frequencies"), F.col("tonic"), 500).alias("e"))
    return e.filter("e is not null").select("track_id", F.posexplode("e").alias("k", "x")).select("track_id", "k", _r(F.col("x")).alias("x"))


def d15_tala(spark, d):
    t = tala.analysed(beats(spark, d))
    return t.select("track_id", "tala_name", "confidence", F.round("cycle_duration_seconds", 4).alias("cycle"), "beats_per_cycle", F.round("tempo_bpm", 4).alias("tempo"))


def d14_cycle(spark, d):
    return tala.analysed(beats(spark, d), 3, 12).select("track_id", F.round("cycle_duration_seconds", 4).alias("cycle"))


def p11_demoted(spark, d):
    return tala.demoted(tala.analysed(beats(spark, d))).select("track_id", "tala_name", "confidence")


def f05_tempo(spark, d):
    return tala.analysed(beats(spark, d)).select("track_id", F.round("tempo_bpm", 4).alias("tempo"), "beats_per_cycle")


def p15_clamped(spark, d):
    return table(spark, d, "events").select("event_id", _r(pitch.clamped((F.col("value") - 50) / 100)).alias("x"))


def f23_softmax(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", arrays.argmax(F.col("v")).alias("best"), _r(F.array_max(arrays.softmax(F.col("v")))).alias("top"))


def l13_rolled(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", arrays.rolled(F.transform("embedding", lambda x: x.cast("double")), F.lit(3)).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", _r(F.col("x")).alias("x"))


def l14_offset(spark, d):
    c = F.transform("frequencies", lambda x: pitch.cents(x, F.col("tonic")))
    return series(spark, d).select("track_id", F.posexplode(augment.offset(c, F.lit(25.0))).alias("idx", "x")).select("track_id", "idx", _r(F.col("x")).alias("x"))


def a25_bands(spark, d):
    """Means of 24 stretches of a track's frames."""
    return series(spark, d).select("track_id", F.posexplode(arrays.band_means(F.col("frequencies"))).alias("band", "x")).select("track_id", "band", _r(F.col("x")).alias("x"))


def l15_noisy(spark, d):
    """Frames, and those that noise changed: all that are voiced."""
    noisy = series(spark, d).select("track_id", "frequencies", raga.noisy(F.col("frequencies"), 2.0).alias("v"))
    changed = F.filter(F.zip_with("frequencies", "v", lambda x, y: x != y), lambda c: c)
    return noisy.select("track_id", F.size("v").alias("n"), F.size(changed).alias("n_changed"))


def l17_model_inputs(spark, d):
    """What the nets read: 12 shares, whose sum is 1, and 4000 cents."""
    x = series(spark, d).select("track_id", *[nets.fitting(features.model_input(F.col("frequencies"), F.col("tonic"), m), m).alias(m) for m in ("pcd", "contour")])
    return x.filter("pcd is not null").select("track_id", F.size("pcd").alias("n_pcd"), F.round(arrays.total(F.col("pcd")), 6).alias("share"), F.size("contour").alias("n_contour"))


def p19_subsets(spark, d):
    """The sizes and sums of the parts of a feature vector: one for each kind of feature in it."""
    v = features.vectors(series(spark, d)).filter("features is not null")
    parts = F.array(*[F.struct(F.lit(n).alias("name"), raga.subset(F.col("features"), n).alias("x")) for n in raga.SUBSETS])
    return v.select("track_id", F.explode(parts).alias("p")).select("track_id", "p.name", F.size("p.x").alias("n"), F.round(arrays.total(F.col("p.x")), 6).alias("total"))


def s06_annotations(spark, d):
    """Pitch with its times where a track is annotated; sections where nobody annotated any."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    timed = table(spark, d, "events").groupBy(F.col("user_id").alias("track_id")).agg(F.sort_array(F.collect_list(seconds)).alias("times"))
    told = files.annotations(timed.join(series(spark, d), "track_id"))
    return told.select("track_id", F.size("pitch.times").alias("n_times"), F.size("pitch.frequencies").alias("n"), _r(F.col("tonic")).alias("tonic"), F.col("sections").isNotNull().alias("has_sections"))


def s10_pitch_of(spark, d):
    """The series of every asked id, null for those that there is none of."""
    asked = table(spark, d, "embeddings").select("vec_id")
    return files.pitch_of(series(spark, d), asked).select("track_id", F.size("frequencies").alias("n"), _r(F.col("tonic")).alias("tonic"))


QUERIES = {f.__name__: f for f in (
    a25_bands, l15_noisy, l17_model_inputs, p19_subsets, s06_annotations, s10_pitch_of,
    f01_cents, f02_octave_fold, f03_class_bins, f04_similarity, f05_tempo, f23_softmax, p01_voiced, p02_unvoiced_dropped, p03_sanitised, p05_evidence, p11_demoted, p15_clamped,
    a01_tonic, a02_class_distribution, a03_histogram, a04_pairs, a05_triples, a06_vectors, a10_moments, a21_duration, a22_pooled, a23_frame_counts,
    w01_intervals, w02_neighbours, w04_interpolated, w05_resampled, w06_period, w10_segments, w12_fixed_length, d07_preprocessed, d11_encoded, d14_cycle, d15_tala, l13_rolled, l14_offset,
)} | {"w03_smoothed_odd": _smooth(5), "w03_smoothed_even": _smooth(4)}
QUERIES = {("s" + k if k.startswith("p") else k): f for k, f in QUERIES.items()}


def _smooth_sql(w: int) -> str:
    return f"""WITH {FRAMES}, n AS (SELECT track_id, count(*) AS n, least({w}, count(*)) AS w FROM f GROUP BY track_id)
    SELECT a.track_id, a.idx::INT AS idx, round(avg(b.hz), 6) AS x FROM f a JOIN n USING (track_id) JOIN range(0, {w}) k(k) ON k.k < n.w
    JOIN f b ON b.track_id = a.track_id AND b.idx = greatest(0, least(n.n - 1, a.idx - n.w // 2 + k.k)) GROUP BY a.track_id, a.idx"""


PCD = """SELECT track_id, k.k::INT AS pitch_class, round(count(CASE WHEN pc = k.k THEN 1 END) / greatest(count(pc), 1)::DOUBLE, 6) AS share
  FROM (SELECT track_id, CASE WHEN cents <> 0 THEN (round_even(cents / 100, 0)::BIGINT % 12 + 12) % 12 END AS pc FROM c) JOIN range(0, 12) k(k) ON true GROUP BY track_id, k.k"""
RESAMPLED = """SELECT track_id, k.k AS k, a.{0} + (k.k * (n - 1) / {1}::DOUBLE - a.ix) * (coalesce(b.{0}, a.{0}) - a.{0}) AS x
  FROM (SELECT track_id, count(*) AS n FROM v GROUP BY track_id) JOIN range(0, {1} + 1) k(k) ON true
  JOIN v a USING (track_id) LEFT JOIN v b ON b.track_id = a.track_id AND b.ix = a.ix + 1 WHERE a.ix = floor(k.k * (n - 1) / {1}::DOUBLE)"""
TALA_CASE = """CASE beats WHEN 8 THEN 'Adi' WHEN 14 THEN 'Misra' WHEN 7 THEN 'Misra Chapu' WHEN 6 THEN 'Rupaka' WHEN 5 THEN 'Khanda Chapu' WHEN 3 THEN 'Rupaka' ELSE 'Unknown' END"""
SURE_CASE = """CASE beats WHEN 8 THEN 0.9::DOUBLE WHEN 14 THEN 0.7 WHEN 7 THEN 0.75 WHEN 6 THEN 0.7 WHEN 5 THEN 0.75 WHEN 3 THEN 0.65 ELSE 0.2 END"""
CYCLES = f"""{PERIOD}, m AS (SELECT track_id, quantile_cont(gap, 0.5) AS m FROM i GROUP BY track_id),
w AS (SELECT track_id, count(*) AS nb, max(t) - min(t) AS span FROM b GROUP BY track_id),
y AS (SELECT *, CASE WHEN m > 0 THEN CASE WHEN period > 0 THEN period * m ELSE span END END AS cycle FROM w LEFT JOIN m USING (track_id) LEFT JOIN p USING (track_id)),
q AS (SELECT *, CASE WHEN m > 0 AND cycle > 0 THEN round_even(cycle / m, 0)::INT END AS beats FROM y)"""
SQL = {
    "a25_bands": f"""WITH {FRAMES}, n AS (SELECT track_id, count(*) AS n FROM f GROUP BY track_id)
      SELECT n.track_id, b.b::INT AS band, round(coalesce(avg(hz), 0), 6) AS x FROM n JOIN range(0, 24) b(b) ON true LEFT JOIN f ON f.track_id = n.track_id AND idx >= b.b * n // 24 AND idx < (b.b + 1) * n // 24 GROUP BY n.track_id, b.b""",
    "l15_noisy": f"WITH {FRAMES} SELECT track_id, count(*)::INT AS n, count(*) FILTER (hz <> 0)::INT AS n_changed FROM f GROUP BY track_id",
    "l17_model_inputs": f"WITH {FRAMES} SELECT track_id, 12 AS n_pcd, CASE WHEN count(*) FILTER (cents <> 0) > 0 THEN 1.0::DOUBLE ELSE 0 END AS share, 4000 AS n_contour FROM c WHERE track_id IN (SELECT track_id FROM t WHERE tonic > 0) GROUP BY track_id",
    "p19_subsets": f"""WITH {FRAMES} SELECT track_id, name, size AS n, total::DOUBLE AS total FROM (SELECT track_id FROM v GROUP BY track_id HAVING count(*) >= 10), (VALUES ('histogram', 120, 1), ('pairs', 264, 2), ('all', 480, 3)) s(name, size, total)""",
    "s06_annotations": f"WITH {FRAMES} SELECT track_id, count(*)::INT AS n_times, count(*)::INT AS n, round(any_value(tonic), 6) AS tonic, false AS has_sections FROM f JOIN t USING (track_id) GROUP BY track_id",
    "s10_pitch_of": f"WITH {FRAMES} SELECT vec_id AS track_id, n::INT AS n, round(tonic, 6) AS tonic FROM embeddings LEFT JOIN (SELECT track_id, count(*) AS n FROM f GROUP BY track_id) x ON track_id = vec_id LEFT JOIN t ON t.track_id = vec_id",
    "f01_cents": f"WITH {FRAMES} SELECT track_id, idx::INT AS idx, round(cents, 6) AS cents FROM c",
    "f02_octave_fold": f"WITH {FRAMES} SELECT track_id, idx::INT AS idx, round(oct, 6) AS folded FROM o",
    "f03_class_bins": f"WITH {FRAMES} SELECT track_id, idx::INT AS idx, least(11, floor(oct * 12 / 1200))::INT AS pc12, least(5, floor(oct * 6 / 1200))::INT AS pc6, least(119, floor(oct / 10))::INT AS bin FROM o",
    "f04_similarity": "SELECT vec_id, round(1 / (1 + d / 64), 6) AS scaled, round(1 / (1 + d), 6) AS plain FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS d FROM embeddings)",
    "f05_tempo": f"WITH {CYCLES} SELECT track_id, round(CASE WHEN m > 0 THEN 60 / m ELSE 0 END, 4) AS tempo, CASE WHEN beats > 0 THEN beats END AS beats_per_cycle FROM q",
    "f23_softmax": "SELECT vec_id, (list_position(v, m) - 1)::INT AS best, round(1 / list_sum(list_transform(v, lambda x: exp(x - m))), 6) AS top FROM (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(embedding::DOUBLE[]) AS m FROM embeddings)",
    "p01_voiced": f"WITH {FRAMES} SELECT track_id, count(*) AS n, round(sum(hz), 6) AS sum_hz FROM f WHERE hz > 0 GROUP BY track_id",
    "p02_unvoiced_dropped": f"WITH {FRAMES} SELECT track_id, count(CASE WHEN cents <> 0 THEN 1 END)::INT AS n FROM c GROUP BY track_id",
    "p03_sanitised": "SELECT user_id AS track_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS n_zero, round(coalesce(sum(value) FILTER (event_type <> 'error'), 0), 6) AS sum_hz FROM events GROUP BY user_id",
    "p05_evidence": f"""WITH {FRAMES}, n AS (SELECT track_id, count(*) FILTER (hz > 0) AS n FROM f GROUP BY track_id), x AS ({RESAMPLED.format("cents", 499)}), dev AS (SELECT track_id, stddev_pop(x) AS s FROM x GROUP BY track_id)
      SELECT track_id, n::INT AS n_voiced, tonic > 0 AND n >= 10 AS raga_ok, tonic > 0 AND n >= 50 AND coalesce(s, 0) >= 1e-6 AS contour_ok FROM n JOIN t USING (track_id) LEFT JOIN dev USING (track_id)""",
    "p11_demoted": f"WITH {CYCLES} SELECT track_id, CASE WHEN nb < 2 OR {SURE_CASE} < 0.4 THEN 'Unknown' ELSE {TALA_CASE} END AS tala_name, CASE WHEN nb < 2 THEN 0 ELSE {SURE_CASE} END AS confidence FROM q",
    "p15_clamped": "SELECT event_id, round(coalesce(greatest(0, least(1, (value - 50) / 100)), 0), 6) AS x FROM events",
    "a01_tonic": f"WITH {FRAMES} SELECT track_id, round(tonic, 6) AS tonic FROM t",
    "a02_class_distribution": f"WITH {FRAMES} {PCD}",
    "a03_histogram": f"WITH {FRAMES} SELECT track_id, bin, round(n / (sum(n) OVER (PARTITION BY track_id) + 1e-9), 6) AS share FROM (SELECT track_id, least(119, floor(oct / 10))::INT AS bin, count(*) AS n FROM o GROUP BY ALL)",
    "a04_pairs": f"WITH {FRAMES}, k AS (SELECT track_id, pc AS a, lead(pc) OVER (PARTITION BY track_id ORDER BY ix) AS b FROM (SELECT *, least(11, floor(oct * 12 / 1200))::INT AS pc FROM o)) SELECT track_id, a, b, round(1 / (count(*) OVER (PARTITION BY track_id) + 1e-9), 6) AS share FROM (SELECT DISTINCT * FROM k WHERE b IS NOT NULL)",
    "a05_triples": f"WITH {FRAMES}, k AS (SELECT track_id, pc AS a, lead(pc) OVER w AS b, lead(pc, 2) OVER w AS c FROM (SELECT *, least(5, floor(oct * 6 / 1200))::INT AS pc FROM o) WINDOW w AS (PARTITION BY track_id ORDER BY ix)) SELECT track_id, a, b, c, round(1 / (count(*) OVER (PARTITION BY track_id) + 1e-9), 6) AS share FROM (SELECT DISTINCT * FROM k WHERE c IS NOT NULL)",
    "a06_vectors": f"""WITH {FRAMES}, k AS (SELECT track_id, ix, least(119, floor(oct / 10))::INT AS h, least(11, floor(oct * 12 / 1200))::INT AS p, least(5, floor(oct * 6 / 1200))::INT AS q, count(*) OVER (PARTITION BY track_id) AS n FROM o),
      e AS (SELECT track_id, h, n, p * 12 + lead(p) OVER w AS pp, (q * 6 + lead(q) OVER w) * 6 + lead(q, 2) OVER w AS qqq FROM k WHERE n >= 10 WINDOW w AS (PARTITION BY track_id ORDER BY ix))
      SELECT track_id, h AS pos, round(count(*) / (any_value(n) + 1e-9), 6) AS x FROM e GROUP BY track_id, h
      UNION ALL SELECT track_id, 120 + pp, round(1 / (count(*) OVER (PARTITION BY track_id) + 1e-9), 6) FROM (SELECT DISTINCT track_id, pp FROM e WHERE pp IS NOT NULL)
      UNION ALL SELECT track_id, 264 + qqq, round(1 / (count(*) OVER (PARTITION BY track_id) + 1e-9), 6) FROM (SELECT DISTINCT track_id, qqq FROM e WHERE qqq IS NOT NULL)""",
    "a10_moments": f"WITH {FRAMES} SELECT track_id, round(avg(cents), 6) AS mean, round(stddev_pop(cents), 6) AS deviation FROM v GROUP BY track_id",
    "a21_duration": f"WITH {FRAMES} SELECT track_id, round(CASE WHEN count(*) FILTER (hz = 0) = 0 THEN 0 ELSE count(*) / (count(*) FILTER (hz = 0))::DOUBLE END, 6) AS seconds FROM f GROUP BY track_id",
    "a22_pooled": f"WITH {FRAMES} SELECT track_id, (idx // 4)::INT AS block, round(avg(hz), 6) AS x FROM f GROUP BY ALL",
    "a23_frame_counts": f"WITH {FRAMES} SELECT track_id, count(*) AS n, count(*) FILTER (hz > 0) AS n_voiced FROM f GROUP BY track_id",
    "w01_intervals": f"WITH {GAPS} SELECT track_id, k::INT AS k, round(gap, 6) AS gap FROM i",
    "w02_neighbours": f"WITH {FRAMES} SELECT * FROM (SELECT track_id, ix::INT AS ix, round(cents, 6) AS a, round(lead(cents) OVER w, 6) AS b, round(lead(cents, 2) OVER w, 6) AS c FROM v WINDOW w AS (PARTITION BY track_id ORDER BY ix)) WHERE b IS NOT NULL",
    "w03_smoothed_odd": _smooth_sql(5),
    "w03_smoothed_even": _smooth_sql(4),
    "w04_interpolated": f"""WITH {FRAMES}, k AS (SELECT track_id, idx, hz, last_value(CASE WHEN hz <> 0 THEN idx END IGNORE NULLS) OVER b AS i0, last_value(CASE WHEN hz <> 0 THEN hz END IGNORE NULLS) OVER b AS x0,
      first_value(CASE WHEN hz <> 0 THEN idx END IGNORE NULLS) OVER a AS i1, first_value(CASE WHEN hz <> 0 THEN hz END IGNORE NULLS) OVER a AS x1 FROM f
      WINDOW b AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT track_id, idx::INT AS idx, round(CASE WHEN hz <> 0 THEN hz ELSE coalesce(x0 + (x1 - x0) * (idx - i0) / (i1 - i0)::DOUBLE, x0, x1, 0) END, 6) AS x FROM k""",
    "w05_resampled": f"WITH {FRAMES}, x AS ({RESAMPLED.format('hz', 499)}) SELECT track_id, k::INT AS k, round(x, 6) AS x FROM x",
    "w06_period": f"WITH {PERIOD} SELECT track_id, period::INT AS period FROM p",
    "w10_segments": f"WITH {FRAMES} SELECT track_id, (idx // 30)::INT AS piece, count(*)::INT AS n, round(sum(hz), 6) AS sum_hz FROM f GROUP BY ALL",
    "w12_fixed_length": f"""WITH {FRAMES}, n AS (SELECT track_id, count(*) AS n FROM f GROUP BY track_id)
      SELECT n.track_id, k.k::INT AS pos, round(coalesce(f.hz, 0), 6) AS x FROM n JOIN range(0, 64) k(k) ON true LEFT JOIN f ON f.track_id = n.track_id
      AND f.idx = k.k + CASE WHEN n >= 64 THEN (n - 64) // 2 ELSE -((64 - n) // 2) END""",
    "d07_preprocessed": f"""WITH {FRAMES}, z AS (SELECT track_id, hz, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS ix, count(*) OVER (PARTITION BY track_id) AS n FROM f WHERE hz <> 0),
      s AS (SELECT a.track_id, a.ix, avg(b.hz) AS x FROM z a JOIN range(0, 5) k(k) ON k.k < least(5, a.n) JOIN z b ON b.track_id = a.track_id AND b.ix = greatest(0, least(a.n - 1, a.ix - least(5, a.n) // 2 + k.k)) GROUP BY a.track_id, a.ix)
      SELECT track_id, (ix // 4)::INT AS block, round(avg(x), 6) AS x FROM s GROUP BY ALL""",
    "d11_encoded": f"""WITH {FRAMES}, x AS ({RESAMPLED.format("cents", 499)}), z AS (SELECT track_id, k, x, avg(x) OVER (PARTITION BY track_id) AS m, stddev_pop(x) OVER (PARTITION BY track_id) AS s FROM x)
      SELECT track_id, k::INT AS k, round((x - m) / s, 6) AS x FROM z WHERE s >= 1e-6 AND track_id IN (SELECT track_id FROM v GROUP BY track_id HAVING count(*) >= 50)""",
    "d14_cycle": f"WITH {CYCLES} SELECT track_id, round(CASE WHEN cycle > 0 THEN cycle END, 4) AS cycle FROM q",
    "d15_tala": f"""WITH {CYCLES} SELECT track_id, CASE WHEN nb < 2 THEN 'Unknown' ELSE {TALA_CASE} END AS tala_name, CASE WHEN nb < 2 THEN 0 ELSE {SURE_CASE} END AS confidence,
      round(CASE WHEN cycle > 0 THEN cycle END, 4) AS cycle, CASE WHEN beats > 0 THEN beats END AS beats_per_cycle, round(CASE WHEN m > 0 THEN 60 / m ELSE 0 END, 4) AS tempo FROM q""",
    "l13_rolled": "SELECT vec_id, p.p::INT AS pos, round(embedding[((p.p - 3) % len(embedding) + len(embedding)) % len(embedding) + 1]::DOUBLE, 6) AS x FROM embeddings JOIN range(0, 64) p(p) ON true",
    "l14_offset": f"WITH {FRAMES} SELECT track_id, idx::INT AS idx, round(CASE WHEN cents <> 0 THEN cents + 25 ELSE cents END, 6) AS x FROM c",
}
SQL = {("s" + k if k.startswith("p") else k): q for k, q in SQL.items()}
