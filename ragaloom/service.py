"""What an application asks for: tracks, predictions, recordings and meanings, as DataFrames. Missing parts give empty parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragaloom.config import Settings
from ragaloom.kernels import audio
from ragaloom.ml import nets, raga
from ragaloom.operators import catalog, features, match, tala
from ragaloom.session import Written
from ragaloom.sources import files

RAGAS = "array<struct<rank:int,raga_name:string,confidence:double>>"
MATCHES = "array<struct<rank:int,track_id:string,title:string,similarity:double>>"
TALA = "struct<tala_name:string,confidence:double,cycle_duration_seconds:double,beats_per_cycle:int>"
LYRICS = "struct<title:string,composer:string,raga:string,language:string,lyrics_original:string>"
MEANING = "struct<meaning:string,generated_by:string>"


class Refused(Exception):
    """A request that can't be served; ``status`` is what a server would answer. The numbers are fixed values."""

    status = 500


class NotFound(Refused, LookupError):
    """The asked id or title doesn't exist."""

    status = 404


class TooLarge(Refused, ValueError):
    """An upload is over the limit."""

    status = 413


class Invalid(Refused, ValueError):
    """An upload can't be read, or is too short or silent."""

    status = 422


class ProviderFailed(Refused, RuntimeError):
    """The provider of meanings failed."""

    status = 502


def health(spark: SparkSession) -> DataFrame:
    """One row: status."""
    return spark.range(1).select(F.lit("ok").alias("status"))


def list_tracks(tracks: DataFrame) -> DataFrame:
    """The tracks without their storage keys."""
    return tracks.select("track_id", "title", "tonic", "raga")


def _stage(name: str, build: Callable[[], DataFrame], problems: list[tuple[str, str]]) -> DataFrame | None:
    """The written result of a stage; None if it failed, with the problem noted, so that the other stages go on."""
    try:
        return Written(build(), name).df
    except Refused:
        raise
    except Exception as e:  # noqa: BLE001
        lines = str(e).splitlines()
        problems.append((name, next((x for x in reversed(lines) if x.startswith("Caused by")), next((x for x in lines if "Exception" in x), lines[0] if lines else repr(e)))[:500]))
        return None


def _ragas(asked: DataFrame, model: PipelineModel | nets.Net | None, s: Settings) -> DataFrame:
    if isinstance(model, nets.Net):
        x = asked.select("track_id", features.model_input(F.col("frequencies"), F.col("tonic"), model.mode).alias("features"))
        return nets.top(model, x.filter("features is not null"), "track_id", s.top_k)
    return raga.top(model, features.vectors(asked, s.min_voiced_raga), "track_id", s.top_k)


def _matches(asked: DataFrame, contours: DataFrame, s: Settings) -> DataFrame:
    queries = match.encode(asked, s.contour_points, s.min_voiced_contour).select(F.col("track_id").cast("string").alias("track_id"), "contour")
    near = match.top_matches(queries, contours.select("track_id", "contour"), s.top_k, s.contour_points)
    titles = contours.select("track_id", F.col("title") if "title" in contours.columns else F.lit(None).cast("string").alias("title"))
    return near.join(titles, "track_id", "left").select("query_id", "rank", "track_id", "title", "similarity")


def _grouped(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    return rows.groupBy(F.col(key).cast("string").alias("q")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("part"))


def lyrics_of(found: DataFrame, lyrics: DataFrame, provider: Callable[[str], str] | None) -> DataFrame:
    """(q, lyrics, meaning) of ``found`` (q, title): the entry of the exact title, else of the smallest that contains it;
    and its stored meaning, else the provider's (a failing one gives none). What isn't found is left out."""
    named = catalog.found_by_title(lyrics, found.select("title")).filter("title is not null")
    entries = catalog.latest(lyrics, ["title"], F.desc_nulls_last("meaning_en"), F.desc_nulls_last("lyrics_original"))
    rows = Written(named.join(entries, "title"), "lyrics").df
    ask = F.concat(F.lit("Explain "), "title", F.coalesce(F.concat(F.lit(" by "), F.expr("nullif(composer, '')")), F.lit("")))
    asked = rows.select(F.col("wanted").alias("composition_id"), ask.alias("prompt"))
    stored = rows.select(F.col("wanted").alias("composition_id"), F.col("meaning_en").alias("meaning"))
    told = catalog.meanings(asked, stored, provider or (lambda prompt: None)).filter("meaning is not null")
    whole = rows.join(told.withColumnRenamed("composition_id", "wanted"), "wanted", "left")
    entry = F.struct("title", "composer", "raga", "language", "lyrics_original").alias("lyrics")
    meaning = F.when(F.col("meaning").isNotNull(), F.struct("meaning", "generated_by")).alias("meaning")
    return found.withColumnRenamed("title", "wanted").join(whole.select("wanted", entry, meaning), "wanted").select("q", "lyrics", "meaning")


def run(series: DataFrame, contours: DataFrame | None = None, model: PipelineModel | nets.Net | None = None, lyrics: DataFrame | None = None,
        provider: Callable[[str], str] | None = None, settings: Settings | None = None) -> DataFrame:
    """(track_id, ragas, uncertain, tala, matches, lyrics, meaning, problems) of each of ``series`` (track_id, frequencies,
    tonic and, for the tala, beat_times), each once.

    The stages for ragas, tala and matches are independent; lyrics are those of the best match's title. Each stage is
    written by itself: one whose input is missing gives an empty part, and so does one that fails, which is listed in
    ``problems`` (stage, problem) of every row, while the others go on.
    """
    s, problems = settings or Settings(), []
    asked = Written(series.dropDuplicates(["track_id"]), "asked").df
    out = asked.select("track_id", F.col("track_id").cast("string").alias("q"))
    ragas = _stage("ragas", lambda: _grouped(_ragas(asked, model, s), "track_id", "rank", "raga_name", "confidence"), problems) if model is not None else None
    rhythm = None
    if "beat_times" in asked.columns:
        beats = asked.select("track_id", F.explode("beat_times").alias("t"))
        rhythm = _stage("tala", lambda: tala.demoted(tala.analysed(beats, s.min_beats_per_cycle, s.max_beats_per_cycle), s.tala_threshold), problems)
    near = _stage("matches", lambda: _matches(asked, contours, s), problems) if contours is not None else None
    if ragas is not None:
        out = out.join(ragas.select("q", F.col("part").cast(RAGAS).alias("ragas")), "q", "left")
    if rhythm is not None:
        told = F.struct("tala_name", "confidence", "cycle_duration_seconds", "beats_per_cycle").cast(TALA).alias("tala")
        out = out.join(rhythm.select(F.col("track_id").cast("string").alias("q"), told), "q", "left")
    if near is not None:
        out = out.join(_grouped(near, "query_id", "rank", "track_id", "title", "similarity").select("q", F.col("part").cast(MATCHES).alias("matches")), "q", "left")
        best = near.filter("rank = 1 and title <> ''").select(F.col("query_id").cast("string").alias("q"), "title")
        words = _stage("lyrics", lambda: lyrics_of(best, lyrics, provider), problems) if lyrics is not None else None
        if words is not None:
            out = out.join(words.select("q", F.col("lyrics").cast(LYRICS).alias("lyrics"), F.col("meaning").cast(MEANING).alias("meaning")), "q", "left")
    for name, kind in {"ragas": RAGAS, "tala": TALA, "matches": MATCHES, "lyrics": LYRICS, "meaning": MEANING}.items():
        part = F.col(name) if name in out.columns else F.lit(None).cast(kind)
        out = out.withColumn(name, F.coalesce(part, F.array().cast(kind)) if kind.startswith("array") else part)
    noted = F.array(*[F.struct(F.lit(a).alias("stage"), F.lit(b).alias("problem")) for a, b in problems]) if problems else F.array().cast("array<struct<stage:string,problem:string>>")
    sure = F.coalesce(F.get("ragas", F.lit(0))["confidence"] >= s.raga_threshold, F.lit(False))
    return out.select("track_id", "ragas", (~sure).alias("uncertain"), "tala", "matches", "lyrics", "meaning", noted.alias("problems"))


def predict(series: DataFrame, contours: DataFrame | None, model: PipelineModel | nets.Net | None, settings: Settings | None = None, track_id: str | None = None) -> DataFrame:
    """(track_id, ragas, matches, uncertain, problems) of each series (track_id, frequencies, tonic), or of one track.

    ``ragas`` are (rank, raga_name, confidence), ``matches`` (rank, track_id, title, similarity), best first. Without a
    model or a catalog, or where a series has too few voiced frames, the part is empty. A track of the catalog matches itself.
    """
    asked = series if track_id is None else series.filter(F.col("track_id") == track_id)
    if track_id is not None and not asked.head(1):
        raise NotFound(track_id)
    return run(asked.select("track_id", "frequencies", "tonic"), contours, model, settings=settings).select("track_id", "ragas", "matches", "uncertain", "problems")


def predict_recordings(recordings: DataFrame, contours: DataFrame | None, model: PipelineModel | nets.Net | None, settings: Settings | None = None, lyrics: DataFrame | None = None, provider: Callable[[str], str] | None = None) -> DataFrame:
    """As ``run`` for recordings (track_id, content), with tonic, duration and the ``problem`` of those that failed."""
    heard = Written(files.analysed(recordings), "heard").df
    series = heard.filter("problem is null").select("track_id", F.col("pitch_contour").alias("frequencies"), F.col("tonic_hz").alias("tonic"), "beat_times")
    told = run(series, contours, model, lyrics, provider, settings)
    return heard.select("track_id", "tonic_hz", "duration_seconds", "problem").join(told, "track_id", "left")


def predict_upload(spark: SparkSession, content: bytes, contours: DataFrame | None, model: PipelineModel | nets.Net | None, settings: Settings | None = None, most_bytes: int = 30 << 20, least_seconds: float = 5.0) -> DataFrame:
    """The prediction for one uploaded recording. Over ``most_bytes`` it raises TooLarge; unreadable, too short or silent, Invalid."""
    if len(content) > most_bytes:
        raise TooLarge(f"{len(content)} bytes; {most_bytes} are allowed")
    try:
        samples, rate = audio.decode(content)
    except Exception as e:
        raise Invalid(f"can't be read: {e}") from e
    if not audio.valid(samples, rate, least_seconds):
        raise Invalid(f"too short or silent; {least_seconds} seconds are needed")
    return predict_recordings(spark.createDataFrame([("upload", bytearray(content))], "track_id string, content binary"), contours, model, settings)


def meaning(lyrics: DataFrame, title: str, provider: Callable[[str], str]) -> DataFrame:
    """(title, composer, meaning, generated_by): the stored meaning of the title, or of the smallest that contains it,
    else the provider's. An unknown title raises NotFound, a failing provider ProviderFailed."""
    spark = lyrics.sparkSession
    found = catalog.found_by_title(lyrics, spark.createDataFrame([(title,)], "wanted string")).filter("title is not null").head(1)
    if not found:
        raise NotFound(title)
    row = catalog.latest(lyrics.filter(F.col("title") == found[0]["title"]), ["title"], F.desc_nulls_last("meaning_en"))
    ask = F.concat(F.lit("Explain "), "title", F.coalesce(F.concat(F.lit(" by "), F.expr("nullif(composer, '')")), F.lit("")))
    told = catalog.meanings(row.select(F.col("title").alias("composition_id"), ask.alias("prompt")), row.select(F.col("title").alias("composition_id"), F.col("meaning_en").alias("meaning")), provider)
    told = Written(told, "meaning").df
    failed = told.filter("meaning is null").head(1)
    if failed:
        raise ProviderFailed(failed[0]["generated_by"])
    return told.join(row.select(F.col("title").alias("composition_id"), F.coalesce("composer", F.lit("")).alias("composer")), "composition_id").select(F.col("composition_id").alias("title"), "composer", "meaning", "generated_by")


def all_meanings(lyrics: DataFrame, provider: Callable[[str], str], force: bool = False) -> DataFrame:
    """(title, meaning, generated_by) of every title: stored ones, and the provider's where there is none, or for all with ``force``."""
    rows = catalog.latest(lyrics.filter("title <> ''"), ["title"], F.desc_nulls_last("meaning_en"))
    ask = F.concat(F.lit("Explain "), "title", F.coalesce(F.concat(F.lit(" by "), F.expr("nullif(composer, '')")), F.lit("")))
    held = rows.select(F.col("title").alias("composition_id"), F.col("meaning_en").alias("meaning"))
    return catalog.meanings(rows.select(F.col("title").alias("composition_id"), ask.alias("prompt")), held, provider, force).withColumnRenamed("composition_id", "title")


def build_lyrics(held: DataFrame, pages: DataFrame) -> DataFrame:
    """``held`` (composition_id and the fields of lyric pages) with the compositions of ``pages`` (url, html) added or
    replaced by id; pages without html are skipped."""
    from ragaloom.functions import text

    new = files.compositions(pages.filter("html is not null")).withColumn("composition_id", text.slug(F.col("composition_name"), F.col("composer")))
    return catalog.upserted(held, new.select(*held.columns), "composition_id", "source_url")
