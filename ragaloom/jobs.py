"""Jobs: ``python -m ragaloom.jobs catalog|lyrics|meanings|train ...`` builds what the service reads."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragaloom import service
from ragaloom.config import settings
from ragaloom.functions import text
from ragaloom.ml import raga
from ragaloom.operators import catalog, features, match
from ragaloom.session import build_session, written
from ragaloom.sources import files, pacing


def usable(series: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The series (track_id, title, tonic, frequencies) with pitch, title and tonic, and how many there are and were skipped."""
    fine = F.col("frequencies").isNotNull() & F.coalesce(F.col("tonic") > 0, F.lit(False)) & F.coalesce(F.col("title") != "", F.lit(False))
    n, kept = series.agg(F.count("*"), F.count_if(fine)).first()
    return series.filter(fine), {"total": n, "usable": kept, "skipped": n - kept}


def build_catalog(spark: SparkSession, out: str, series: str | None = None, extra: str | None = None, recordings: str | None = None) -> dict[str, int]:
    """Contours of a table of series, then of a folder of JSON pitch files, then of one of recordings, written as a
    catalog (track_id, title, contour). Of one id the first counts. Nothing is written if no contour is usable."""
    s, parts = settings(spark), []
    columns = ["track_id", "title", "tonic", "frequencies"]
    if series:
        parts.append(spark.read.parquet(series).select(*columns))
    if extra:
        parts.append(files.pitch_files(spark, extra).filter("problem is null").select(*columns))
    if recordings:
        heard = files.analysed(files.recordings(spark, recordings)).filter("problem is null")
        parts.append(heard.select("track_id", F.col("track_id").alias("title"), F.col("tonic_hz").alias("tonic"), F.col("pitch_contour").alias("frequencies")))
    if not parts:
        raise ValueError("nothing to build a catalog from")
    rows = None
    for i, df in enumerate(parts):
        one = df.withColumn("part", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    held = written(catalog.latest(rows.filter("track_id is not null"), ["track_id"], "part", "title"), "series")
    fine, told = usable(held)
    contours = match.encode(fine, s.contour_points, s.min_voiced_contour).select("track_id", "title", "contour")
    return told | {"indexed": files.save_catalog(contours, out)}


def build_lyrics(spark: SparkSession, pages: str, table: str) -> int:
    """Adds the compositions of a table of pages (url, html) to a table of works, or replaces them by id; returns its rows."""
    new = files.compositions(spark.read.parquet(pages).filter("html is not null")).withColumn("composition_id", text.slug(F.col("composition_name"), F.col("composer")))
    return files.save_table(catalog.latest(new, ["composition_id"], "source_url"), table, "composition_id")


def build_meanings(spark: SparkSession, lyrics: str, table: str, provider: Callable[[], pacing.Paced], limit: int | None = None, force: bool = False) -> dict[str, int]:
    """Asks the provider for the meanings that a table of lyrics (title, composer, meaning_en) lacks, at its pace, and adds
    them to a table (composition_id, meaning). ``limit`` is how many of the titles are asked for at a time, in their
    order; later runs go on with the rest. Returns the titles by outcome."""
    rows = catalog.latest(spark.read.parquet(lyrics).filter("title <> ''"), ["title"], F.desc_nulls_last("meaning_en"))
    rows = rows.filter(text.is_composition(F.col("title")))
    known = rows.select(F.col("title").alias("composition_id"), F.col("meaning_en").alias("meaning"))
    done = files.load_table(spark, table)
    held = known if done is None else catalog.upserted(known, done.select("composition_id", "meaning"), "composition_id", "meaning")
    ask = F.concat(F.lit("Explain "), "title", F.coalesce(F.concat(F.lit(" by "), F.expr("nullif(composer, '')")), F.lit("")))
    entries = rows.select(F.col("title").alias("composition_id"), ask.alias("prompt"))
    if limit is not None:
        lacking = entries.join(held.filter("meaning <> ''").select("composition_id"), "composition_id", "left_anti") if not force else entries
        entries = lacking.orderBy("composition_id").limit(limit)
    told = written(pacing.generated(entries, held, provider, force), "told")
    made = told.filter("outcome = 'made'").select("composition_id", "meaning")
    if made.head(1):
        files.save_table(made, table, "composition_id")
    return {r["outcome"]: r["n"] for r in told.groupBy("outcome").agg(F.count("*").alias("n")).collect()}


def train_ragas(spark: SparkSession, series: str, out: str, kinds: tuple[str, ...] = ("forest", "svm", "mlp"), least: int = 5, trees: int = 300) -> dict:
    """Fits every classifier with every part of the features on series (track_id, tonic, frequencies, raga) of ragas with at
    least ``least`` tracks, and stores the best. Returns its name and the mean accuracies of the cross-validation."""
    s, rows = settings(spark), spark.read.parquet(series).filter("raga <> ''")
    often = rows.groupBy("raga").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("raga")
    known = rows.join(often, "raga", "left_semi").withColumn("tonic", F.coalesce(F.when(F.col("tonic") != 0, F.col("tonic")), F.lit(220.0)))
    vectors = features.vectors(known, s.min_voiced_raga).join(known.select("track_id", F.col("raga").alias("label")), "track_id").filter("features is not null")
    model, about = raga.best_of(written(vectors, "vectors"), "track_id", kinds, trees=trees)
    raga.save(model, out)
    return {"best": list(about["best"]), "accuracy": {" ".join(k): round(v[0], 4) for k, v in about["scores"].items()}}


def _named(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def main(args: list[str] | None = None) -> None:
    """Runs a job and prints what it did as JSON."""
    parser = argparse.ArgumentParser(prog="ragaloom.jobs", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("catalog", help="contours for matching")
    one.add_argument("out")
    for name in ("--series", "--extra", "--recordings"):
        one.add_argument(name)
    one = jobs.add_parser("lyrics", help="works out of pages")
    one.add_argument("pages")
    one.add_argument("table")
    one = jobs.add_parser("meanings", help="meanings from a provider")
    one.add_argument("lyrics")
    one.add_argument("table")
    one.add_argument("--provider", required=True, help="module:function that takes a prompt and gives a text")
    one.add_argument("--limit", type=int)
    one.add_argument("--force", action="store_true")
    one = jobs.add_parser("train", help="the best classifier of ragas")
    one.add_argument("series")
    one.add_argument("out")
    told = parser.parse_args(args)
    spark = build_session("jobs")
    if told.job == "catalog":
        done = build_catalog(spark, told.out, told.series, told.extra, told.recordings)
    elif told.job == "lyrics":
        done = {"works": build_lyrics(spark, told.pages, told.table)}
    elif told.job == "meanings":
        provider = told.provider
        done = build_meanings(spark, told.lyrics, told.table, lambda: pacing.Paced(_named(provider)), told.limit, told.force)
    else:
        done = train_ragas(spark, told.series, told.out)
    print(json.dumps(done, ensure_ascii=False))


if __name__ == "__main__":
    main()
