"""Functions for SQL: ``register(spark)`` adds them to the session. An extension."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ragaloom.functions import text
from ragaloom.kernels import dtw


def register(spark: SparkSession) -> list[str]:
    """Adds raga_cents, raga_class (plain SQL), raga_fold, raga_slug, dtw_similarity, contour_encode and the table function
    topk_matches(TABLE(...), query, top). That gives the nearest of each part of the table (track_id, contour); order and
    limit what it gives to ``top`` for the nearest of all. Returns their names."""
    import numpy as np

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION raga_cents(hz DOUBLE, tonic DOUBLE) RETURNS DOUBLE RETURN CASE WHEN hz > 0 AND tonic > 0 THEN 1200 * log2(hz / tonic) ELSE 0 END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION raga_class(c DOUBLE) RETURNS INT RETURN CAST(pmod(rint(c / 100), 12) AS INT)")

    def slug(name: pd.Series, composer: pd.Series) -> pd.Series:
        return text.slugs(name + "-" + composer)

    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else dtw.similarity(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b, strict=True)], dtype="float64")

    def contour(frequencies: pd.Series, tonic: pd.Series) -> pd.Series:
        out = []
        for f, t in zip(frequencies, tonic, strict=True):
            heard = np.asarray([x for x in f if x is not None and np.isfinite(x) and x > 0], float) if f is not None else np.zeros(0)
            if len(heard) < 50 or not t or t <= 0:
                out.append(None)
                continue
            cents = 1200 * np.log2(heard / t)
            even = np.interp(np.arange(500) * (len(cents) - 1) / 499, np.arange(len(cents)), cents)
            out.append(((even - even.mean()) / even.std()).tolist() if even.std() >= 1e-6 else None)
        return pd.Series(out, dtype=object)

    @F.udtf(returnType="track_id: string, similarity: double")
    class TopMatches:
        """The ``top`` rows (track_id, contour) nearest to a contour in each part of a table; what it holds is ``top`` rows."""

        def __init__(self) -> None:
            self.best: list = []

        def eval(self, row: Row, query: list, top: int):
            contour = row["contour"]
            if contour is not None and query is not None and len(contour) == len(query):
                distance = round(float(np.linalg.norm(np.asarray(contour, float) - np.asarray(query, float))), 9)
                self.best = sorted([*self.best, (distance, row["track_id"], len(query))])[:top]

        def terminate(self):
            for distance, track_id, n in self.best:
                yield track_id, 1 / (1 + distance / n)

    spark.udtf.register("topk_matches", TopMatches)
    spark.udf.register("contour_encode", F.pandas_udf(contour, "array<double>"))
    spark.udf.register("raga_fold", F.pandas_udf(text.folds, "string"))
    spark.udf.register("raga_slug", F.pandas_udf(slug, "string"))
    spark.udf.register("dtw_similarity", F.pandas_udf(similar, "double"))
    return ["raga_cents", "raga_class", "raga_fold", "raga_slug", "dtw_similarity", "contour_encode", "topk_matches"]
