import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ragaloom.functions import arrays, pitch, text
from ragaloom.kernels import audio, dtw
from ragaloom.operators import catalog, evaluate, features, ranks, tala


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression.alias("x")).first()["x"]


def array(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_cents_and_bins(spark):
    c = lambda hz, t: one(spark, pitch.cents(F.lit(hz), F.lit(t)))
    assert (c(220.0, 220.0), c(440.0, 220.0), c(0.0, 220.0), c(440.0, 0.0), c(float("nan"), 220.0)) == (0, 1200, 0, 0, 0)
    assert abs(c(220 * 2 ** (7 / 12), 220.0) - 700) < 1e-6
    tiny = F.lit(-1e-14)
    assert one(spark, F.array(pitch.histogram_bin(tiny), pitch.class_bin(tiny, 12), pitch.class_bin(tiny, 6))) == [119, 11, 5]
    assert one(spark, F.array(*[pitch.semitone_class(F.lit(x)) for x in (50.0, 150.0, 250.0)])) == [0, 2, 2]


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        (lambda: arrays.smoothed(array(10, 20, 30, 40, 50, 60), 5), [16, 22, 30, 40, 48, 54]),
        (lambda: arrays.smoothed(array(10, 20, 30, 40, 50, 60), 4), [12.5, 17.5, 25, 35, 45, 52.5]),
        (lambda: arrays.smoothed(array(10, 20), 5), [10, 15]),
        (lambda: arrays.interpolated(array(0, 100, 0, 0, 400, 0)), [100, 100, 200, 300, 400, 400]),
        (lambda: arrays.interpolated(array(0, 0)), [0, 0]),
        (lambda: arrays.pooled(array(1, 2, 3, 4, 10), 4), [2.5, 10]),
        (lambda: arrays.fixed_length(array(1, 2, 3), 6), [0, 1, 2, 3, 0, 0]),
        (lambda: arrays.fixed_length(array(1, 2, 3, 4, 5), 2), [2, 3]),
        (lambda: arrays.encoded(array(200, 400, 200, 400, 800), F.lit(200.0), 9, 1), [-1.237437, -0.441942, 0.353553, -0.441942, -1.237437, -0.441942, 0.353553, 1.149049, 1.944544]),
        (lambda: arrays.encoded(array(200, 400, 200, 400, 800), F.lit(100.0), 9, 1), [-1.237437, -0.441942, 0.353553, -0.441942, -1.237437, -0.441942, 0.353553, 1.149049, 1.944544]),
        (lambda: arrays.class_distribution(array(700, 700, 1200, 1200, 0)), [0.5, 0, 0, 0, 0, 0, 0, 0.5, 0, 0, 0, 0]),
        (lambda: arrays.rolled(array(1, 2, 3), F.lit(1)), [3, 1, 2]),
    ],
)
def test_arrays(spark, expression, want):
    assert one(spark, expression()) == pytest.approx(want, abs=1e-5)


def test_gates(spark):
    assert one(spark, arrays.encoded(array(*[200] * 60), F.lit(200.0), 9)) is None
    assert one(spark, arrays.encoded(array(*range(100, 149)), F.lit(200.0), 9)) is None
    assert one(spark, arrays.median(F.array().cast("array<double>"))) is None
    assert one(spark, arrays.median(array(3, 1, 2, 10))) == 2.5


@pytest.mark.parametrize(("classes", "want"), [([0, 1, 0, 1, 0], {(0, 1): 0.5, (1, 0): 0.5}), ([0, 0, 0, 1], {(0, 0): 0.5, (0, 1): 0.5})])
def test_pairs_count_once(spark, classes, want):
    df = spark.createDataFrame([(1, i, 100.0 * c + 20) for i, c in enumerate(classes)], "track_id long, at long, cents double")
    assert {tuple(r["gram"]): round(r["share"], 6) for r in features.grams(df, 2, 12).collect()} == want
    counted = {tuple(r["gram"]): r["share"] for r in features.grams(df, 2, 12, "count").collect()}
    assert sum(counted.values()) == pytest.approx(1)


def test_vectors(spark):
    df = spark.createDataFrame([("a", [220.0 * 2 ** (i % 7 / 12) for i in range(40)], 220.0), ("few", [220.0] * 9, 220.0), ("none", [220.0] * 40, 0.0), ("null", None, 220.0)], "track_id string, frequencies array<double>, tonic double")
    got = {r["track_id"]: r["features"] for r in features.vectors(df).collect()}
    assert len(got["a"]) == 480 and sum(got["a"][:120]) == pytest.approx(1) and got["few"] is None and got["none"] is None and got["null"] is None


def cyclic(beats, interval, cycles, accent=0.15):
    t, out = 0.0, [0.0]
    for i in range(beats * cycles):
        t += interval * (1 - accent if i % beats == beats - 1 else 1)
        out.append(t)
    return out


@pytest.mark.parametrize(("beats", "interval", "cycles", "most", "name", "period"), [(8, 0.5, 6, 12, "Adi", 8), (7, 0.4, 8, 12, "Misra Chapu", 7), (11, 0.5, 6, 12, "Unknown", 11), (14, 0.5, 6, 16, "Misra", 14)])
def test_tala(spark, beats, interval, cycles, most, name, period):
    df = spark.createDataFrame([("a", t) for t in cyclic(beats, interval, cycles)] + [("b", 1.0)], "track_id string, t double")
    got = {r["track_id"]: r for r in tala.analysed(df, 3, most).collect()}
    assert got["a"]["tala_name"] == name and got["a"]["beats_per_cycle"] == period
    assert got["b"]["tala_name"] == "Unknown" and got["b"]["confidence"] == 0


def test_uniform_beats_are_one_cycle(spark):
    df = spark.createDataFrame([("a", 0.5 * i) for i in range(9)], "track_id string, t double")
    r = tala.analysed(df).first()
    assert (r["tala_name"], r["confidence"], r["beats_per_cycle"]) == ("Adi", 0.9, 8)
    assert one(spark, tala.true_beats(F.lit("x"), F.lit("60"), F.lit(8.0))) == 8


def test_warping():
    a = np.array([100.0, 200, 300, 200, 100])
    assert dtw.distance(a, a) == 0 and dtw.similarity(a, a) == 1 and dtw.similarity(a, a + 10) > dtw.similarity(a, a + 500)
    assert math.isinf(dtw.distance(a, np.zeros(4))) and dtw.similarity(a, np.zeros(4)) == 0
    assert dtw.subsequence_similarity(a, np.concatenate([a + 900, a, a + 700])) == 1

    def plain(x, y):
        t = np.full((len(x) + 1, len(y) + 1), np.inf)
        t[0, 0] = 0
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(t[i, j], t[i, j + 1], t[i + 1, j])
        return t[-1, -1] ** 0.5

    r = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 9), (12, 7)):
        x, y = r.standard_normal(n), r.standard_normal(m)
        assert dtw.distance(x, y) == pytest.approx(plain(x, y))


def test_audio():
    rate = 22_050
    sine = (0.5 * np.sin(2 * np.pi * 220 * np.arange(3 * rate) / rate)).astype(np.float32)
    heard = audio.pitch_track(sine, rate, 60, 500)
    assert 218 < np.median(heard[heard > 0]) < 222
    assert not audio.valid(sine, rate, 10) and not audio.valid(np.zeros(rate * 11), rate) and audio.valid(sine, rate, 2)
    assert len(audio.trimmed(np.concatenate([np.zeros(rate), sine, np.zeros(rate)]))) < len(sine) + 5000
    clicks = np.zeros(rate * 8, np.float32)
    clicks[:: rate // 2] = 1
    found = audio.beats(np.convolve(clicks, np.hanning(200), "same"), rate)
    assert abs(np.median(np.diff(found)) - 0.5) < 0.05


def test_text_rules(spark):
    assert one(spark, text.slug(F.lit("Vātāpi Gaṇapatim"), F.lit("Muthuswami Dikshitar"))) == "vatapi-ganapatim-muthuswami-dikshitar"
    likes = [text.like(F.lit("ABC"), "b"), text.like(F.lit("É"), "é"), text.like(F.lit("abc"), "a%c"), text.like(F.lit("a\\b"), "\\")]
    assert one(spark, F.array(*likes)) == [True, False, True, True]
    assert [one(spark, text.tala(F.lit(x))) for x in ("  Adi  Tala", "Roopaka", "other One", "")] == ["adi", "rupaka", "other one", ""]
    assert one(spark, text.listing(F.lit("vAtApi – hamsadhwani"))).asDict() == {"title": "vAtApi", "raga": "hamsadhwani"}
    assert [one(spark, text.listing(F.lit(x))) for x in ("with x - y", "no dash", "solo - Violin", "t" * 61 + " - r", "")] == [None] * 5
    assert [one(spark, text.is_composition(F.lit(x))) for x in ("vatapi", "0:00 varNam", "??", "Tani Avartanam", "", None)] == [True, False, False, False, False, False]
    assert [one(spark, text.language(F.lit(x))) for x in ("in telugu and SANSKRIT", "Sanskrit", "x")] == ["Telugu", "Sanskrit", "Unknown"]


def test_sections(spark):
    lines = ["x", "Pallavi", "p1", "", "Anupallavi:", "a1", "charanam 1", "c1", "c2", "caraNam 2", "d1", "charanam"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "nothing")], "page_id long, line_no int, line string")
    assert [tuple(r) for r in catalog.sections(df).collect()] == [(1, "p1", "a1", ["c1\nc2", "d1"])]


def test_aliases(spark):
    assert catalog.close_names(spark.createDataFrame([("abcd",)], "key string"), spark.createDataFrame([("abcx",), ("abcz",), ("abcy",), (None,)], "name string")).first()["near"] == "abcz"
    index = spark.createDataFrame([("saveri", "Sāvēri"), ("abhogi", "Ābhōgi"), ("bhairavi", "Bhairavi")], "key string, canonical string")
    hand = spark.createDataFrame([("stop", None), ("alias", "Bhairavi")], "key string, canonical string")
    df = spark.createDataFrame([("Stop",), ("alias",), ("SAVERI",), ("abheri",), ("zzzz",), (None,), ("",)], "raga string")
    got = {r["raw"]: (r["canonical"], r["tier"]) for r in catalog.resolved(df, hand, index).collect()}
    assert got == {"Stop": (None, 1), "alias": ("Bhairavi", 1), "SAVERI": ("Sāvēri", 2), "abheri": ("Sāvēri", 3), "zzzz": (None, 0), "": (None, 0)}


def test_fuzzy_names_in_shards_are_those_of_one(spark, monkeypatch):
    names = spark.createDataFrame([(a + b + c,) for a in "abc" for b in "def" for c in "gah"], "name string")
    words = spark.createDataFrame([("adg",), ("beh",), ("xyz",), ("cfa",), ("dgab",), (None,)], "key string")
    whole = {tuple(r) for r in catalog.close_names(words, names).collect()}
    monkeypatch.setattr(catalog, "NAMES_AT_ONCE", 5)
    assert {tuple(r) for r in catalog.close_names(words, names).collect()} == whole and ("xyz", None) in whole


def test_ranks_and_runs_equal_one_window(spark):
    r = random.Random(11)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.randrange(200), i, r.random() < 0.7) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, id int, hit boolean")
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {(x["id"], x["n"]) for x in df.withColumn("n", F.row_number().over(w)).collect()}
    got = ranks.ranked(df, ["k"], ranks.sliced(df, "t", 7), [F.col("t"), F.col("id")])
    assert {(x["id"], x["rank"]) for x in got.collect()} == want
    assert {x["rank"] for x in ranks.ranked(df, [], ranks.sliced(df, "t", 7), [F.col("t"), F.col("id")]).collect()} == set(range(1, 601))
    islands = []
    for k in ("hot", "b", None):
        n = 0
        for *_, hit in [*sorted((x for x in rows if x[0] == k), key=lambda x: x[1:3]), (None, 0, 0, False)]:
            n, done = (n + 1, 0) if hit else (0, n)
            islands += [(str(k), done)] if done else []
    for slices in (1, 7, 64):
        found = ranks.runs(df, "k", ranks.sliced(df, "t", slices), [F.col("t"), F.col("id")], F.col("hit"))
        assert sorted((str(x["k"]), x["n"]) for x in found.collect()) == sorted(islands)
    assert ranks.runs(df.limit(0), "k", ranks.sliced(df.limit(0), "t"), [F.col("t")], F.col("hit")).collect() == []
    assert ranks.ranked(df.limit(0), ["k"], F.lit(0), [F.col("t")]).collect() == []


def test_interpolation_holds_edges_and_nulls(spark):
    rows = [([0.0, 0.0, 2.0, 0.0, 0.0, 8.0, 0.0],), ([0.0],), ([],), (None,), ([3.0],), ([1.0, None, 3.0],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(arrays.interpolated(F.col("v"))).collect()]
    assert got == [[2, 2, 2, 4, 6, 8, 8], [0], [], None, [3], [1, 2, 3]]
    bands = spark.createDataFrame([([1.0, 3.0, 5.0, 7.0],), ([],)], "v array<double>").select(arrays.band_means(F.col("v"), 2)).collect()
    assert [r[0] for r in bands] == [[2, 6], [0, 0]]


def test_spellings_and_links(spark):
    assert [one(spark, text.tala(F.lit(x))) for x in ("Aadi", "Mishra  Chapu", "chatusra rupaka")] == ["adi", "misra chapu", "rupaka"]
    links = ["c1023.shtml", "https://x.org/lyrics/x", "https://x.org/x", None]
    assert [one(spark, text.is_song_link(F.lit(x).cast("string"))) for x in links] == [True, True, False, None]
    assert one(spark, text.language(F.lit("in tamil, not SANSKRIT"))) == "Sanskrit"


def test_links_lead_where_a_browser_goes(spark):
    base = "https://x.org/a/b/"
    join = lambda h: one(spark, text.joined_url(F.lit(base), F.lit(h).cast("string")))
    assert [join(h) for h in ("c.html", "/c", "../c", "https://y.org/", None)] == [base + "c.html", "https://x.org/c", "https://x.org/a/c", "https://y.org/", None]


def test_validators(spark):
    truth = spark.createDataFrame([("a", 8), ("b", 8), ("c", None), ("d", 7), ("e", 5)], "track_id string, beats int")
    told = spark.createDataFrame([("a", 8, None), ("b", 7, None), ("c", 8, None), ("d", None, "no audio")], "track_id string, beats_per_cycle int, problem string")
    assert tuple(evaluate.tala_validated(truth, told).first()) == (2, 1, 2, 1, 0.5)
    assert tuple(evaluate.tala_validated(truth.limit(0), told).first()) == (0, 0, 0, 0, None)
    losses = spark.createDataFrame([(i, x) for i, x in enumerate([5.0, 4.0, 4.0, 4.5, 3.0, 6.0], 1)], "epoch int, loss double")
    assert tuple(evaluate.stop_epoch(losses, 2).first()) == (2, 4.0, 4) and tuple(evaluate.stop_epoch(losses, 3).first()) == (5, 3.0, 6)
    assert evaluate.stop_epoch(losses.limit(0)).collect() == [] and tuple(evaluate.weighted_loss(losses.limit(0).withColumn("n", F.lit(1))).first()) == (0.0, 0)


def test_probable_pitch():
    rate = 22_050
    t = np.arange(rate * 2) / rate
    tone = np.concatenate([np.zeros(rate // 2), 0.5 * np.sin(2 * np.pi * 220 * t), 0.5 * np.sin(2 * np.pi * 330 * t)]).astype(np.float32)
    found = audio.probable_pitch_track(tone, rate)
    low, high = found[rate // 2 // 128 + 20 : rate * 5 // 2 // 128 - 20], found[rate * 5 // 2 // 128 + 20 : -30]
    assert np.abs(low - 220).max() < 3 and np.abs(high - 330).max() < 4 and (found[:50] == 0).all()
    assert len(audio.probable_pitch_track(np.zeros(0), rate)) == 0 and (audio.probable_pitch_track(np.zeros(rate, np.float32), rate) == 0).all()


def test_tables(spark):
    held = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "k string, v int")
    assert {tuple(r) for r in catalog.upserted(held, new, "k", F.desc("v")).collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert {tuple(r) for r in catalog.inserted(held, new, "k", "v").collect()} == {("c", 5)}
    changes = spark.createDataFrame([("a", None)], "k string, v int")
    assert {tuple(r) for r in catalog.updated(held, changes, "k", ["v"]).collect()} == {("a", None), ("b", 2)}
    entries = spark.createDataFrame([("a", "p"), ("b", "boom"), ("c", "p")], "composition_id string, prompt string")
    stored = spark.createDataFrame([("a", "old"), ("c", "")], "composition_id string, meaning string")

    def provider(prompt):
        if prompt == "boom":
            raise RuntimeError("down")
        return "new"

    got = {r["composition_id"]: (r["meaning"], r["generated_by"]) for r in catalog.meanings(entries, stored, provider).collect()}
    assert got == {"a": ("old", "stored"), "b": (None, "error: down"), "c": ("new", "provider")}


def test_metrics(spark):
    r = evaluate.retrieval(spark.createDataFrame([(1,), (3,), (None,)], "rank int")).first()
    assert (round(r["top1"], 6), round(r["top3"], 6), round(r["mrr"], 6), r["n"]) == (0.333333, 0.666667, 0.444444, 3)
    assert evaluate.retrieval(spark.createDataFrame([], "rank int")).first()["mrr"] == 0
    assert evaluate.accuracy(spark.createDataFrame([], "label string, prediction string")).first()["accuracy"] == 0
