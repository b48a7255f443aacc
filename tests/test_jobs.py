"""The jobs that build what the service reads."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragaloom import jobs
from ragaloom.kernels import dtw
from ragaloom.ml import raga
from ragaloom.operators import match
from ragaloom.sources import files, pacing
from test_service import series, wav


def test_catalog(spark, tmp_path):
    series(spark).withColumn("title", F.when(F.col("track_id") != "t0", F.concat(F.lit("T "), "track_id"))).write.parquet(str(tmp_path / "series"))
    (tmp_path / "extra").mkdir()
    (tmp_path / "extra/t1.json").write_text(json.dumps({"title": "other", "tonic": 220.0, "frequencies": [1.0]}))
    (tmp_path / "extra/more.json").write_text(json.dumps({"title": "More", "tonic": 220.0, "frequencies": [220.0 + i % 7 for i in range(80)]}))
    (tmp_path / "extra/bad.json").write_text("{")
    (tmp_path / "sound").mkdir()
    (tmp_path / "sound/tone.wav").write_bytes(wav(6))
    out = str(tmp_path / "out")
    done = jobs.build_catalog(spark, out, str(tmp_path / "series"), str(tmp_path / "extra"), str(tmp_path / "sound"))
    got = {r["track_id"]: (r["title"], len(r["contour"])) for r in files.load_catalog(spark, out).collect()}
    assert {"t1", "t2", "t3", "t4", "t5", "more"} <= set(got) <= {"t1", "t2", "t3", "t4", "t5", "more", "tone"}  # a steady tone may be flat
    assert got["t1"] == ("T t1", 500) and done == {"total": 9, "usable": 8, "skipped": 1, "indexed": len(got)}
    with pytest.raises(ValueError):
        jobs.build_catalog(spark, out)


def test_works_and_meanings(spark, tmp_path):
    pages = [("u1", "<h1>Alpha song</h1>\nComposer: X"), ("u2", None), ("u3", "<h1>Beta song</h1>")]
    spark.createDataFrame(pages, "url string, html string").write.parquet(str(tmp_path / "pages"))
    assert jobs.build_lyrics(spark, str(tmp_path / "pages"), str(tmp_path / "works")) == 2
    assert jobs.build_lyrics(spark, str(tmp_path / "pages"), str(tmp_path / "works")) == 2
    rows = [("Alpha song", "X", None), ("Beta song", "", "known"), ("Gamma song", None, ""), ("Delta song", None, None), ("", "", None), ("alapana", "", None)]
    spark.createDataFrame(rows, "title string, composer string, meaning_en string").write.parquet(str(tmp_path / "lyrics"))
    paced = lambda: pacing.Paced(lambda p: None if "Delta" in p else p, sleep=lambda s: None)
    where = (str(tmp_path / "lyrics"), str(tmp_path / "meanings"))
    assert jobs.build_meanings(spark, *where, paced, limit=1) == {"made": 1}
    assert jobs.build_meanings(spark, *where, paced) == {"stored": 2, "made": 1, "failed": 1}
    assert {r["composition_id"]: r["meaning"] for r in files.load_table(spark, where[1]).collect()} == {"Alpha song": "Explain Alpha song by X", "Gamma song": "Explain Gamma song"}
    assert jobs.build_meanings(spark, *where, paced, force=True) == {"made": 3, "failed": 1}


def test_training(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(f"t{i}", f"r{i % 2}", 220.0 if i else 0.0, [float(220 * 2 ** ((i % 2 * 500 + c) / 1200)) for c in r.normal(0, 40, 60)]) for i in range(24)] + [("rare", "r9", 220.0, [220.0] * 60)]
    spark.createDataFrame(rows, "track_id string, raga string, tonic double, frequencies array<double>").write.parquet(str(tmp_path / "s"))
    done = jobs.train_ragas(spark, str(tmp_path / "s"), str(tmp_path / "m"), ("forest",), trees=5)
    assert done["best"][0] == "forest" and len(done["accuracy"]) == 3 and max(done["accuracy"].values()) > 0.9
    assert raga.load(str(tmp_path / "m")).stages[0].labels == ["r0", "r1"]


def test_what_compares_may_be_given(spark):
    c = match.encode(series(spark, 4)).select("track_id", "contour")
    got = match.warped_matches(c, c, 1, prepare=lambda v: F.slice(v, 1, 20), compare=lambda a, b: float(len(a) == len(b) == 20)).collect()
    assert len(got) == 4 and all(r["similarity"] == 1 for r in got)
    x, y = np.array([1.0, 0.0, 2.0, 3.0]), np.array([1.0, 2.0, 4.0])
    m = dtw.Matcher(window=3)
    assert m.distance(x, y) == dtw.distance(x, y, 3) and m.similarity(x, y) == dtw.similarity(x, y, 3) and m.subsequence(x, y) == dtw.subsequence_similarity(x, y)
