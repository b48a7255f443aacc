"""Files in, tables out; and the catalog's tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragaloom import schemas
from ragaloom.functions import text
from ragaloom.kernels import audio
from ragaloom.operators import catalog
from ragaloom.session import move


def pitch_files(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, title, tonic, frequencies, problem) of JSON pitch files; the id is the file's stem. A bad file gives a row with a problem."""
    raw = spark.read.schema(schemas.PITCH_FILE + ", problem string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "problem").json(path)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("track_id"), "title", "tonic", "frequencies", "problem")


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, content) of audio files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("track_id"), "content")


def analysed(files: DataFrame, rate: int = 22_050, seconds: float = 60.0, least: float = 5.0, most_bytes: int = 30 << 20, probable: bool = False) -> DataFrame:
    """The features of recordings (track_id, content), one at a time in the tasks, and ``problem`` where one fails.

    Too large, undecodable, silent and too short recordings get nulls and a problem. At most ``seconds`` are used. The
    tonic is the median pitch, 130 Hz if nothing is voiced. Silence around the sound stays in. With ``probable`` both the
    tonic and the contour are of probabilistic YIN (C2 to C7, a step of 128 samples), and the tonic of an unvoiced
    recording is 0.
    """
    import numpy as np

    names = ["track_id", "pitch_contour", "tonic_hz", "normalized_pitch_contour", "pitch_class_distribution", "sample_rate", "duration_seconds", "onset_times", "beat_times", "problem"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                row = dict.fromkeys(names) | {"track_id": r.track_id}
                try:
                    if r.content is None or len(r.content) > most_bytes:
                        raise ValueError("no content, or too large")
                    samples, own = audio.decode(bytes(r.content))
                    samples = audio.resampled(samples, own, rate)[: int(seconds * rate)]
                    if not audio.valid(samples, rate, least):
                        raise ValueError("too short or silent")
                    if probable:
                        contour = narrow = audio.probable_pitch_track(samples, rate)
                    else:
                        contour, narrow = audio.pitch_track(samples, rate, 60, 1000), audio.pitch_track(samples, rate, 60, 500)
                    heard = narrow[narrow > 0]
                    tonic = float(np.median(heard)) if len(heard) else 0.0 if probable else 130.0
                    cents = np.where((contour > 0) & (tonic > 0), 1200 * np.log2(np.maximum(contour, 1e-9) / max(tonic, 1e-9)), 0.0)
                    kinds = np.bincount(np.mod(np.rint(cents[cents != 0] / 100), 12).astype(int), minlength=12)
                    row |= {"pitch_contour": contour.tolist(), "tonic_hz": tonic, "normalized_pitch_contour": cents.tolist(), "sample_rate": rate, "duration_seconds": len(samples) / rate}
                    row |= {"pitch_class_distribution": (kinds / max(kinds.sum(), 1)).tolist()}
                    row |= {"onset_times": audio.onsets(samples, rate).tolist(), "beat_times": audio.beats(samples, rate).tolist()}
                except Exception as e:  # noqa: BLE001
                    row["problem"] = str(e)
                rows.append(row)
            yield pd.DataFrame(rows, columns=names).astype({"tonic_hz": float, "duration_seconds": float, "sample_rate": "Int32"})

    schema = "track_id string, pitch_contour array<double>, tonic_hz double, normalized_pitch_contour array<double>, pitch_class_distribution array<double>, sample_rate int, duration_seconds double, onset_times array<double>, beat_times array<double>, problem string"
    return files.mapInPandas(run, schema)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.heading: str | None = None
        self.links: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.inside.append(tag)
        if tag in ("h1", "h2") and self.heading is None:
            self.inside.append("heading")
            self.heading = ""
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href.strip())

    def handle_endtag(self, tag: str) -> None:
        if self.inside and (self.inside[-1] == tag or tag in ("h1", "h2") and self.inside[-1] == "heading"):
            self.inside.pop()

    def handle_data(self, data: str) -> None:
        if self.inside and self.inside[-1] in ("script", "style"):
            return
        if "heading" in self.inside:
            self.heading += data
        self.parts.append(data)


def page_texts(pages: DataFrame) -> DataFrame:
    """(url, text, heading, links) of pages (url, html): visible text by lines, the first heading, the links as written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, html in zip(batch["url"], batch["html"], strict=True):
                parser = _Text()
                parser.feed(html or "")
                rows.append((url, "\n".join(parser.parts), (parser.heading or "").strip() or None, parser.links))
            yield pd.DataFrame(rows, columns=["url", "text", "heading", "links"])

    return pages.select("url", "html").mapInPandas(run, "url string, text string, heading string, links array<string>")


def compositions(pages: DataFrame) -> DataFrame:
    """The fields of lyric pages: names by ``songtitle`` or heading, spellings of raga and tala, language by name or by the text."""
    x = page_texts(pages)
    t = F.col("text")
    either = lambda *names: F.coalesce(*[F.nullif(text.field(t, n), F.lit("")) for n in names], F.lit(""))
    given = text.field(t, "language")
    known = text.language(F.when(given != "", given).otherwise(t))
    return x.select(
        F.coalesce(F.nullif(text.field(t, "songtitle"), F.lit("")), "heading", F.lit("Unknown")).alias("composition_name"), text.field(t, "composer").alias("composer"),
        either("raagam", "raga").alias("raga"), either("taalam", "tala").alias("tala"), F.when((given != "") & (known == "Unknown"), given).otherwise(known).alias("language"), t.alias("text"), F.col("url").alias("source_url"),
    )


def listings(pages: DataFrame) -> DataFrame:
    """(title, raga, artist, source_url) of the listing lines of artist pages."""
    x = page_texts(pages).withColumn("artist", F.coalesce("heading", text.display_name(F.try_element_at(text.path_parts(F.col("url")), F.lit(-1)))))
    lines = x.select("artist", "url", F.explode(F.split("text", "\n")).alias("line")).withColumn("x", text.listing(F.col("line"))).filter("x is not null")
    return lines.select("x.title", "x.raga", "artist", F.col("url").alias("source_url"))


def annotations(tracks: DataFrame) -> DataFrame:
    """(track_id, pitch, tonic, sections) of ``tracks`` with any of track_id, times, frequencies, tonic, intervals, labels.

    ``pitch`` holds (times, frequencies), ``sections`` (intervals, labels); each is null where the track has neither of
    its columns, and a missing one beside a present one is an empty array. A missing column counts as null everywhere.
    """
    kinds = {"times": "array<double>", "frequencies": "array<double>", "intervals": "array<array<double>>", "labels": "array<string>"}

    def part(*names: str):
        have = [F.col(n).cast(kinds[n]) if n in tracks.columns else F.lit(None).cast(kinds[n]) for n in names]
        filled = F.struct(*[F.coalesce(c, F.array().cast(kinds[n])).alias(n) for c, n in zip(have, names, strict=True)])
        return F.when(have[0].isNotNull() | have[1].isNotNull(), filled)

    tonic = F.col("tonic").cast("double") if "tonic" in tracks.columns else F.lit(None).cast("double")
    return tracks.select("track_id", part("times", "frequencies").alias("pitch"), tonic.alias("tonic"), part("intervals", "labels").alias("sections"))


def pitch_of(bundle: DataFrame, ids: DataFrame) -> DataFrame:
    """(track_id, frequencies, tonic) of the asked ids (one column); both null where the bundle lacks the track or its tonic.

    Only the asked columns are read, and row groups without an asked id are skipped where the ids are few.
    """
    asked = ids.toDF("track_id").dropna().distinct()
    have = bundle.filter("frequencies is not null and tonic is not null").select("track_id", "frequencies", F.col("tonic").cast("double").alias("tonic"))
    return asked.join(have, "track_id", "left")


def built(heard: DataFrame, about: DataFrame) -> DataFrame:
    """The feature catalog: analysed recordings without a problem, with composition_name, composer (the artist, else the
    album's artist, else ''), raga and tala of ``about`` (track_id, title, artist, album_artist, raga, tala)."""
    text_of = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))
    named = about.select("track_id", text_of("title").alias("composition_name"), text_of("artist", "album_artist").alias("composer"), text_of("raga").alias("raga"), text_of("tala").alias("tala"))
    return heard.filter("problem is null").drop("problem").join(named, "track_id", "left").withColumn("composition_id", F.col("track_id"))


def create_table(spark: SparkSession, path: str, schema: str) -> bool:
    """Makes an empty table of a schema (see ``schemas``) where there is none; tells whether it did."""
    if load_table(spark, path) is not None:
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def save_table(df: DataFrame, path: str, key: str) -> int:
    """Adds rows to a stored table, replacing those of a key that comes again, and returns the rows it has then.

    A new version is written beside the old one and put in its place, so what is read is never overwritten.
    """
    spark = df.sparkSession
    old = load_table(spark, path, df.schema)
    whole = catalog.upserted(old, df, key, F.lit(0)) if old is not None else catalog.latest(df, [key], F.lit(0))
    fresh = f"{path}.new"
    whole.write.mode("overwrite").parquet(fresh)
    move(spark, fresh, path)
    return spark.read.parquet(path).count()


def load_table(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """A stored table; None if there is none."""
    try:
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def save_json(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in one order, with fields sorted by name, nulls kept and letters of every script as they are."""
    fields = F.struct(*[F.col(c) for c in sorted(df.columns)])
    df.orderBy(*order).select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def save_catalog(contours: DataFrame, path: str) -> int:
    """Writes usable contours as a catalog; nothing is written if there is none. Returns their number."""
    usable = contours.filter("contour is not null")
    n = usable.count()
    if n:
        usable.write.mode("overwrite").parquet(path)
    return n


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog, or an empty one if it isn't there."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "track_id string, title string, contour array<double>")
