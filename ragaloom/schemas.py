"""Schemas of the entities, as DDL."""

from __future__ import annotations

FEATURES = (
    "track_id string, pitch_contour array<float>, tonic_hz double, normalized_pitch_contour array<float>, pitch_class_distribution array<double>, "
    "sample_rate int, duration_seconds double, onset_times array<float>, beat_times array<float>"
)
RAGA_PREDICTION = "track_id string, rank int, raga_name string, confidence double"
TALA_PREDICTION = "track_id string, tala_name string, confidence double, cycle_duration_seconds double, beats_per_cycle int"
COMPOSITION_MATCH = "query_id string, rank int, composition_id string, composition_name string, composer string, raga string, tala string, similarity_score double"
COMPOSITION = (
    "composition_id string, composition_name string, composer string, raga string, tala string, language string, pallavi string, "
    "anupallavi string, charanam array<string>, source string"
)
LYRICS = "title string, composer string, raga string, language string, lyrics_original string, meaning_en string, meaning_generated_at timestamp"
MEANING = "composition_id string, meaning string, generated_by string"
TRACK = "track_id string, key string, title string, tonic double, raga string"
PITCH = "track_id string, frequencies array<double>"
PITCH_FILE = "title string, tonic double, frequencies array<double>"
SCRAPED = "title string, raga string, artist string, source_url string, raga_canonical string"
ALIAS = "raw_spelling string, canonical string"
