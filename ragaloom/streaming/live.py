"""Live pitch: windowed features of a stream of frames. An extension beyond the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ragaloom.functions import pitch

#: Voiced frames that a track's rolling contour keeps.
ROLLING = 500


def windows(frames: DataFrame, every: str = "1 minute", late: str = "10 minutes", tonic: float = 130.0) -> DataFrame:
    """(track_id, start, n, n_voiced, mean_hz, shares of the twelve classes) for each tumbling window of (track_id, ts, hz).

    Frames later than ``late`` are dropped. Works on a stream and on a table.
    """
    hz = F.col("hz")
    kind = F.when(pitch.is_voiced(hz), pitch.semitone_class(pitch.cents(hz, F.lit(tonic))))
    counts = [F.count_if(kind == k).alias(f"c{k}") for k in range(12)]
    sums = frames.withWatermark("ts", late).groupBy("track_id", F.window("ts", every)).agg(F.count("*").alias("n"), F.count_if(pitch.is_voiced(hz)).alias("n_voiced"), F.avg(F.when(pitch.is_voiced(hz), hz)).alias("mean_hz"), *counts)
    share = F.array(*[F.col(f"c{k}") / F.greatest(F.col("n_voiced"), F.lit(1)) for k in range(12)])
    return sums.select("track_id", F.col("window.start").alias("start"), "n", "n_voiced", "mean_hz", share.alias("shares"))


def sessions(frames: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """(track_id, start, end, n) of runs of frames without a longer gap."""
    return frames.withWatermark("ts", late).groupBy("track_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("track_id", "w.start", "w.end", "n")


def rolling(frames: DataFrame, keep: int = ROLLING, quiet: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(track_id, n_seen, frequencies): each track's last ``keep`` voiced frames, again at every batch that brings some.

    The state of a track is dropped when the watermark is past its last frame by the quiet time.
    """
    milliseconds = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values("ts")
        new = rows["hz"][rows["hz"] > 0].tolist()
        seen, held = seen + len(new), [*held, *new][-keep:]
        state.update((seen, held))
        state.setTimeoutTimestamp(max(int(rows["ts"].iloc[-1].timestamp() * 1000) + milliseconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"track_id": [key[0]], "n_seen": [seen], "frequencies": [held]})

    kind = dict(frames.dtypes)["track_id"]
    return frames.withWatermark("ts", late).groupBy("track_id").applyInPandasWithState(run, f"track_id {kind}, n_seen long, frequencies array<double>", "n long, held array<double>", "append", GroupStateTimeout.EventTimeTimeout)
