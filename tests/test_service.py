import io
import json
import subprocess
import sys
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragaloom import config, service, sql
from ragaloom.ml import raga
from ragaloom.operators import match
from ragaloom.sources import files
from ragaloom.streaming import live


def series(spark, n=6):
    r = np.random.default_rng(1)
    rows = [(f"t{i}", [float(220 * 2 ** (c / 1200)) for c in r.normal(300, 300, 200).cumsum() % 2000], 220.0) for i in range(n)]
    return spark.createDataFrame([*rows, ("short", [220.0], 220.0)], "track_id string, frequencies array<double>, tonic double")


def test_predict_degrades(spark):
    s = series(spark)
    contours = match.encode(s).select("track_id", "contour")
    got = {r["track_id"]: r for r in service.predict(s, contours, None).collect()}
    assert got["t1"]["matches"][0]["track_id"] == "t1" and got["t1"]["matches"][0]["similarity"] == 1 and got["t1"]["ragas"] == [] and got["t1"]["uncertain"]
    assert got["short"]["matches"] == []
    assert all(r["matches"] == [] for r in service.predict(s, contours.limit(0), None).collect())
    assert all(r["matches"] == [] for r in service.predict(s, None, None, track_id="t1").collect())
    with pytest.raises(service.NotFound):
        service.predict(s, None, None, track_id="none")


def test_blocks_give_the_same_matches(spark):
    c = match.encode(series(spark, 12)).select("track_id", "contour")
    whole, cut = ({tuple(r)[:3] for r in match.top_matches(c, c, 3, exclude_self=True, block=b).collect()} for b in (4096, 3))
    assert whole == cut and len(whole) == 36
    warped = match.warped_matches(c.limit(2), c, 2, subsequence=False).collect()
    assert all(r["similarity"] == 1 for r in warped if r["rank"] == 1)


def wav(seconds, hz=220.0, rate=22_050):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(rate)
        x = (0.5 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate) * 32767).astype(np.int16)
        f.writeframes(np.repeat(x, 2).tobytes())
    return out.getvalue()


def test_recordings(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(6))
    (tmp_path / "short.wav").write_bytes(wav(1))
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    got = {r["track_id"]: r for r in service.predict_recordings(files.recordings(spark, str(tmp_path)), None, None).collect()}
    assert 200 < got["a"]["tonic_hz"] < 240 and abs(got["a"]["duration_seconds"] - 6) < 0.05 and got["a"]["problem"] is None
    assert got["short"]["problem"] and got["bad"]["problem"] and got["bad"]["tonic_hz"] is None


def test_pitch_files_and_catalog(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/one.json").write_text(json.dumps({"title": "T", "tonic": 220.0, "frequencies": [1.0, 2.0]}))
    (tmp_path / "x/two.json").write_text("{broken")
    got = {r["track_id"]: r for r in files.pitch_files(spark, str(tmp_path / "x")).collect()}
    assert got["one"]["frequencies"] == [1, 2] and got["one"]["problem"] is None and got["two"]["problem"]
    assert files.load_catalog(spark, str(tmp_path / "none")).count() == 0
    c = match.encode(series(spark)).select("track_id", "contour")
    assert files.save_catalog(c, str(tmp_path / "c")) == 6 and files.load_catalog(spark, str(tmp_path / "c")).count() == 6
    assert files.save_catalog(c.limit(0), str(tmp_path / "d")) == 0 and not (tmp_path / "d").exists()


def test_pages(spark):
    html = "<html><h1>My <b>Song</b></h1><script>raaga: no</script><p>Raagam: Kalyani<br>Taalam : Adi</p><a href='c12.shtml'>x</a>Composer: T &amp; S<p>in Telugu</p></html>"
    pages = spark.createDataFrame([("u", html), ("v", None)], "url string, html string")
    got = {r["source_url"]: r for r in files.compositions(pages).collect()}
    assert (got["u"]["composition_name"], got["u"]["raga"], got["u"]["tala"], got["u"]["composer"], got["u"]["language"]) == ("My Song", "Kalyani", "Adi", "T & S", "Telugu")
    assert got["v"]["composition_name"] == "Unknown"
    assert files.page_texts(pages).filter("url = 'u'").first()["links"] == ["c12.shtml"]
    listed = files.listings(spark.createDataFrame([("https://x.org/a/some-one/", "<p>vAtApi - hamsadhwani</p><p>with X - violin</p>")], "url string, html string")).collect()
    assert [tuple(r)[:3] for r in listed] == [("vAtApi", "hamsadhwani", "Some One")]


def test_meaning(spark):
    df = spark.createDataFrame([("Maruva song", "C", "r", None), ("Other", "", "r", "known")], "title string, composer string, raga string, meaning_en string")
    assert service.meaning(df, "MARUVA", lambda p: p).first()["meaning"] == "Explain Maruva song by C"
    assert service.meaning(df, "Other", lambda p: p).first()["generated_by"] == "stored"
    with pytest.raises(service.NotFound):
        service.meaning(df, "zzz", lambda p: p)


def test_models(spark):
    r = np.random.default_rng(3)
    rows = [(i, f"r{i % 3}", [float(x) for x in r.normal(i % 3 * 2, 0.5, 6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label string, features array<double>")
    for kind in ("forest", "small_mlp"):
        model = raga.fit(df, kind, trees=10)
        best = raga.top(model, df, "id", 1).join(df, "id")
        assert best.filter("raga_name = label").count() > 55
    assert {r["fold"]: r["n"] for r in raga.folds(df, "label", "id").groupBy("fold").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(5), 12)
    with pytest.raises(ValueError):
        raga.chosen("other", F.lit(1), F.lit(2))
    noisy = df.select(raga.noisy(F.col("features"), 0.1).alias("x")).first()["x"]
    assert len(noisy) == 6


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT raga_cents(440D, 220D) AS c, raga_class(150D) AS k, raga_fold('Vātāpi-1') AS f, dtw_similarity(array(1D, 2D), array(1D, 2D)) AS s").first()
    assert tuple(r) == (1200.0, 2, "vatapi1", 1.0)
    spark.conf.set("ragaloom.top_k", "7")
    assert config.settings(spark).top_k == 7
    spark.conf.unset("ragaloom.top_k")


def test_streams(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{i}:10", 130.0 * 2 ** (i % 2)) for i in range(6)] + [("b", "2024-01-01 00:00:30", 0.0)]
    df = spark.createDataFrame(rows, "track_id string, ts string, hz double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    batch = {tuple(r)[:4] for r in live.windows(df).collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {tuple(r)[:4] for r in spark.table("w").collect()} == batch and len(batch) == 7
    q = live.rolling(stream, 4).writeStream.format("memory").queryName("r").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {r["track_id"]: (r["n_seen"], len(r["frequencies"])) for r in spark.table("r").collect()}
    assert got == {"a": (6, 4), "b": (0, 0)}
    assert live.sessions(df).filter("track_id = 'a'").count() == 6


def test_the_rest_works_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for f in [*root.glob("*.py"), *root.glob("ragaloom/**/*.py")]:
        if "llm" not in f.parts:
            to = tmp_path / f.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    (tmp_path / "ragaloom/llm").mkdir()  # and with one whose libraries are missing
    (tmp_path / "ragaloom/llm/__init__.py").write_text("")
    (tmp_path / "ragaloom/llm/queries.py").write_text("import no_such_library")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
