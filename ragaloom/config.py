"""Settings with the reference defaults; a session may override any by ``ragaloom.<name>``."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    sample_rate: int = 44_100
    hop_size: int = 128
    frame_size: int = 2048
    min_audio_seconds: float = 10.0
    query_seconds: float = 30.0
    contour_points: int = 500
    min_voiced_raga: int = 10
    min_voiced_contour: int = 50
    top_k: int = 3
    raga_threshold: float = 0.3
    tala_threshold: float = 0.4
    composition_threshold: float = 0.5
    min_beats_per_cycle: int = 3
    max_beats_per_cycle: int = 12
    max_beats_detector: int = 16


def settings(spark: SparkSession) -> Settings:
    """The defaults with the session's overrides."""
    found = {f.name: spark.conf.get(f"ragaloom.{f.name}", None) for f in fields(Settings)}
    return Settings(**{k: type(getattr(Settings, k))(v) for k, v in found.items() if v is not None})
