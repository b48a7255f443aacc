"""The whole pipeline, its statuses, paced providers, and sources and sinks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragaloom import schemas, service, sql
from ragaloom.ml import nets
from ragaloom.operators import catalog, match
from ragaloom.sources import files, pacing
from test_service import series, wav


def heard(spark, n=4):
    beats = spark.range(8).agg(F.collect_list((F.col("id") * 0.5).cast("double")).alias("beat_times"))
    return series(spark, n).join(F.broadcast(beats))


def works(spark):
    rows = [("Song t0", "C", "r", "te", "words", "known"), ("Long song t1 and more", "", "r", "te", "more words", None), ("Song t2", "X", "r", "te", "w", "")]
    return spark.createDataFrame(rows, "title string, composer string, raga string, language string, lyrics_original string, meaning_en string")


def contours(spark, n=4):
    return match.encode(series(spark, n)).select("track_id", F.concat(F.lit("Song "), "track_id").alias("title"), "contour")


def test_every_stage(spark):
    net = nets.Net("pcd", ["r0", "r1", "r2", "r3"])
    got = {r["track_id"]: r for r in service.run(heard(spark), contours(spark), net, works(spark), lambda p: "told: " + p).collect()}
    assert set(got) == {"t0", "t1", "t2", "t3", "short"}
    assert [x["rank"] for x in got["t0"]["ragas"]] == [1, 2, 3] and abs(sum(x["confidence"] for x in got["t0"]["ragas"])) <= 1
    assert got["t0"]["matches"][0]["title"] == "Song t0" and got["t0"]["tala"]["tala_name"] and got["t0"]["problems"] == []
    assert got["t0"]["lyrics"]["lyrics_original"] == "words" and tuple(got["t0"]["meaning"]) == ("known", "stored")
    assert got["t1"]["lyrics"]["title"] == "Long song t1 and more" and tuple(got["t1"]["meaning"]) == ("told: Explain Long song t1 and more", "provider")
    assert tuple(got["t2"]["meaning"]) == ("told: Explain Song t2 by X", "provider") and got["t3"]["lyrics"] is None and got["t3"]["meaning"] is None
    assert got["short"]["matches"] == [] and got["short"]["lyrics"] is None


def test_a_failing_stage_leaves_the_others(spark):
    broken = contours(spark).withColumn("contour", F.raise_error(F.lit("lost")).cast("array<double>"))
    got = service.run(heard(spark), broken, nets.Net("pcd", ["a", "b"]), works(spark)).filter("track_id = 't0'").first()
    assert got["matches"] == [] and got["lyrics"] is None and len(got["ragas"]) == 2 and got["tala"] is not None
    assert [p["stage"] for p in got["problems"]] == ["matches"]
    failing = service.run(heard(spark), contours(spark), None, works(spark), lambda p: 1 / 0).filter("track_id in ('t0', 't1')").orderBy("track_id").collect()
    assert tuple(failing[0]["meaning"]) == ("known", "stored") and failing[1]["meaning"] is None and failing[1]["lyrics"] is not None
    nothing = service.run(series(spark)).collect()
    assert len(nothing) == 7 and all(r["ragas"] == r["matches"] == r["problems"] == [] and r["uncertain"] and r["tala"] is None for r in nothing)
    assert service.run(series(spark).limit(0), contours(spark)).collect() == []


def test_statuses(spark):
    with pytest.raises(service.TooLarge) as e:
        service.predict_upload(spark, b"x" * 100, None, None, most_bytes=50)
    assert e.value.status == 413
    for content in (b"no audio", wav(1)):
        with pytest.raises(service.Invalid) as e:
            service.predict_upload(spark, content, None, None)
        assert e.value.status == 422
    told = service.predict_upload(spark, wav(6), None, None).first()
    assert 200 < told["tonic_hz"] < 240 and told["ragas"] == []
    with pytest.raises(service.NotFound) as e:
        service.predict(series(spark), None, None, track_id="none")
    assert e.value.status == 404
    with pytest.raises(service.ProviderFailed) as e:
        service.meaning(works(spark), "Song t2", lambda p: 1 / 0)
    assert e.value.status == 502
    assert tuple(service.meaning(works(spark), "song t2", lambda p: p).first()) == ("Song t2", "X", "Explain Song t2 by X", "provider")
    assert service.health(spark).first()["status"] == "ok"
    every = {r["title"]: r["generated_by"] for r in service.all_meanings(works(spark), lambda p: p).collect()}
    assert every == {"Song t0": "stored", "Long song t1 and more": "provider", "Song t2": "provider"}


def test_paces():
    slept, calls = [], []

    def provider(prompt):
        calls.append(prompt)
        if prompt == "busy" and calls.count("busy") < 3:
            raise pacing.Busy
        if prompt in ("bad", "always"):
            raise pacing.Busy if prompt == "always" else ValueError
        return "" if prompt == "none" else prompt.upper()

    paced = pacing.Paced(provider, sleep=slept.append)
    assert paced("busy") == "BUSY" and slept == [25, 50, 7]
    assert paced("none") is None and paced.failures == 1
    with pytest.raises(ValueError):
        paced("bad")
    with pytest.raises(pacing.Busy):
        paced("always")
    assert slept[-4:] == [25, 50, 75, 7] and paced.failures == 3
    assert paced("fine") == "FINE" and paced.failures == 0
    for _ in range(5):
        assert paced("none") is None
    with pytest.raises(pacing.Stopped):
        paced("fine")


def test_a_batch_stops_after_failures_in_a_row(spark):
    entries = spark.createDataFrame([(f"{i:02}", "ok" if i < 2 else "bad") for i in range(12)], "composition_id string, prompt string")
    held = spark.createDataFrame([("00", "kept"), ("03", "")], "composition_id string, meaning string")
    make = lambda: pacing.Paced(lambda p: p if p == "ok" else None, sleep=lambda s: None)
    got = {r["composition_id"]: (r["meaning"], r["outcome"]) for r in pacing.generated(entries, held, make).collect()}
    assert got["00"] == ("kept", "stored") and got["01"] == ("ok", "made")
    assert [got[f"{i:02}"][1] for i in range(2, 12)] == ["failed"] * 5 + ["left"] * 5
    assert {r["outcome"] for r in pacing.generated(entries.limit(1), held, make, force=True).collect()} == {"made"}


def test_pages_are_fetched_one_after_the_other(spark):
    def opener(request, timeout):
        assert request.headers["User-agent"] == "me" and timeout == 30
        if "lost" in request.full_url:
            raise OSError
        return "é".encode("latin-1") if "old" in request.full_url else "ṣ".encode()

    urls = spark.createDataFrame([("https://x.org/a",), ("https://x.org/lost",), ("https://x.org/old",), ("https://x.org/a",), (None,)], "url string")
    got = {r["url"]: r["html"] for r in files_fetch(urls, opener)}
    assert got == {"https://x.org/a": "ṣ", "https://x.org/lost": None, "https://x.org/old": "é"}


def files_fetch(urls, opener):
    return pacing.fetched(urls, "me", opener=opener, sleep=lambda s: None).collect()


def test_lyrics_are_built_from_pages(spark):
    held = spark.createDataFrame([("old-x", "Old", "X", "u0")], "composition_id string, composition_name string, composer string, source_url string")
    pages = spark.createDataFrame([("u1", "<h1>New</h1>\nComposer: X"), ("u2", None), ("u3", "<h1>Old</h1>\nComposer: X")], "url string, html string")
    got = {r["composition_id"]: r["source_url"] for r in service.build_lyrics(held, pages).collect()}
    assert got == {"old-x": "u3", "new-x": "u1"}


def test_tables_and_json(spark, tmp_path):
    df = spark.createDataFrame([("b", "ṣ", None), ("a", "x", 1)], "k string, z string, n int")
    path = str(tmp_path / "t")
    assert files.load_table(spark, path) is None
    made = str(tmp_path / "made")
    assert files.create_table(spark, made, schemas.COMPOSITION) and not files.create_table(spark, made, schemas.LYRICS)
    assert files.load_table(spark, made).columns[:2] == ["composition_id", "composition_name"] and files.load_table(spark, made).count() == 0
    assert files.save_table(df, path, "k") == 2
    assert files.save_table(spark.createDataFrame([("b", "new", 2), ("c", "c", 3)], df.schema), path, "k") == 3
    assert {r["k"]: r["z"] for r in files.load_table(spark, path).collect()} == {"a": "x", "b": "new", "c": "c"}
    files.save_json(df, str(tmp_path / "j"), "k")
    lines = [x for f in sorted((tmp_path / "j").glob("part*")) for x in f.read_text(encoding="utf-8").splitlines()]
    assert lines == ['{"k":"a","n":1,"z":"x"}', '{"k":"b","n":null,"z":"ṣ"}'] and json.loads(lines[1])["n"] is None


def test_annotations_and_series(spark):
    rows = [("a", [0.0, 1.0], [220.0, 0.0], 220.0, None), ("b", None, None, None, ["x"]), ("c", None, [1.0], 3.0, None)]
    df = spark.createDataFrame(rows, "track_id string, times array<double>, frequencies array<double>, tonic double, labels array<string>")
    got = {r["track_id"]: r for r in files.annotations(df).collect()}
    assert got["a"]["pitch"]["times"] == [0, 1] and got["a"]["sections"] is None
    assert got["b"]["pitch"] is None and got["b"]["tonic"] is None and tuple(got["b"]["sections"]) == ([], ["x"])
    assert tuple(got["c"]["pitch"]) == ([], [1.0])
    ids = spark.createDataFrame([("a",), ("b",), ("none",), (None,)], "id string")
    found = {r["track_id"]: (r["frequencies"], r["tonic"]) for r in files.pitch_of(df, ids).collect()}
    assert found == {"a": ([220.0, 0.0], 220.0), "b": (None, None), "none": (None, None)}


def test_the_catalog_names_composers(spark):
    heard = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, None), ("c", 3.0, "too short")], "track_id string, tonic_hz double, problem string")
    about = spark.createDataFrame([("a", "T", "", "Album", "r", None), ("b", None, "Artist", "Album", None, "t")], "track_id string, title string, artist string, album_artist string, raga string, tala string")
    got = {r["track_id"]: (r["composition_name"], r["composer"], r["raga"], r["tala"]) for r in files.built(heard, about).collect()}
    assert got == {"a": ("T", "Album", "r", ""), "b": ("", "Artist", "", "t")}


def test_wild_titles(spark):
    titles = spark.createDataFrame([("Alpha Song",), ("Beta alpha",), ("Gamma",), ("x\\y",), (None,), ("",)], "title string")
    wanted = [("ALPHA", "Alpha Song"), ("a_pha s", "Alpha Song"), ("am%a", "Gamma"), ("%", ""), ("_____", "Alpha Song"), ("a", "Alpha Song"), ("gz", None), ("\\", "x\\y"), ("GAMMA", "Gamma"), ("", ""), ("ta_a", "Beta alpha")]
    got = {r["wanted"]: r["title"] for r in catalog.found_by_title(titles, spark.createDataFrame([(w,) for w, _ in wanted] + [(None,)], "w string")).collect()}
    assert got == dict(wanted)
    assert {r["title"] for r in catalog.found_by_title(titles.limit(0), spark.createDataFrame([("a",)], "w string")).collect()} == {None}


def test_table_function(spark):
    assert "topk_matches" in sql.register(spark)
    spark.createDataFrame([("a", [0.0, 1.0]), ("b", [5.0, 5.0]), ("c", [0.0, 1.5]), ("d", None)], "track_id string, contour array<double>").createOrReplaceTempView("held_contours")
    got = spark.sql("SELECT * FROM topk_matches(TABLE(SELECT track_id, contour FROM held_contours), array(0D, 1D), 2) ORDER BY similarity DESC, track_id LIMIT 2").collect()
    assert [r["track_id"] for r in got] == ["a", "c"] and got[0]["similarity"] == 1 and abs(got[1]["similarity"] - 0.8) < 1e-9
    r = spark.sql("SELECT contour_encode(transform(sequence(1, 60), i -> 220D + i), 220D) AS e, contour_encode(array(1D), 220D) AS n").first()
    assert len(r["e"]) == 500 and abs(np.mean(r["e"])) < 1e-9 and r["n"] is None
