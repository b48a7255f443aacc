"""Joins that hold when one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragaloom.session import Written

#: A looked-up side is broadcast up to this many bytes of Parquet, measured after it was written.
BROADCAST_BYTES = 16 << 20
#: A key is hot when it has more than this part of the left rows; so there are fewer than HOT_KEYS hot keys.
HOT_KEYS = 400


def attach(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Joins ``right``, which has each key at most once, to ``left``.

    A right side of measured size up to ``limit`` is broadcast, so the left side isn't shuffled. Beyond it, the keys
    that hold more than one part in HOT_KEYS of the left rows (fewer than HOT_KEYS keys, whatever the data) are
    broadcast with their right rows; all other keys are joined by shuffling. Null keys match nothing, as in SQL.
    ``how`` is ``left`` or ``inner``. The right columns other than ``on`` must not occur on the left.
    """
    held = Written(right, "attach")
    if held.bytes <= limit:
        return left.join(F.broadcast(held.df), on, how)
    least = left.count() / HOT_KEYS
    whole = left.dropna(subset=on)
    hot = whole.groupBy(*on).count().filter(F.col("count") > F.lit(least)).drop("count")
    hot = F.broadcast(Written(hot.join(held.df, on, how), "hot").df)
    cold = whole.join(hot.select(*on), on, "left_anti").join(held.df, on, how)
    joined = cold.unionByName(whole.join(hot, on, "inner"))
    if how == "inner":
        return joined.select(*cold.columns)
    unmatched = left.filter(" or ".join(f"`{c}` is null" for c in on))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in held.df.schema if f.name not in on]
    return joined.unionByName(unmatched.select("*", *nulls))
