"""Which tracks and listings belong together, and their splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragaloom.llm.components import assign_splits, components, stars
from ragaloom.llm.glyphs import consistent_form
from ragaloom.operators.skew import attach
from ragaloom.session import written

#: What stands between performers who share a credit.
BETWEEN_PERFORMERS = r"\s*[&/+]\s*|\s+(?:and|with)\s+"


def track_edges(tracks: DataFrame) -> DataFrame:
    """Edges between track ids of one stored title and one raga in its consistent form; null and '' relate nothing."""
    keyed = tracks.select("track_id", "title", consistent_form(F.col("raga")).alias("raga")).filter("title <> '' and raga <> ''")
    return stars(keyed, "track_id", ["title", "raga"])


def performers(artist) -> F.Column:
    """The performers a credit names, as spelled."""
    return F.array_distinct(F.filter(F.transform(F.split(artist, BETWEEN_PERFORMERS), F.trim), lambda x: x != ""))


def artist_edges(listings: DataFrame) -> DataFrame:
    """Edges between stored artist values that credit a performer spelled alike."""
    values = listings.select("artist").filter("artist <> ''").distinct()
    return stars(values.select("artist", F.explode(performers(F.col("artist"))).alias("performer")), "artist", ["performer"])


def groups(edges: DataFrame) -> DataFrame:
    """(member_key, group_key), one row for each member of a group of at least two; the key is the smallest member."""
    return components(edges).select(F.col("node").alias("member_key"), F.col("component").alias("group_key"))


def assigned(rows: DataFrame, member: str, found: DataFrame, shares: dict[str, float], salt: str = "") -> DataFrame:
    """(row_id, group_key, split_name) for each row: all rows of a group share its split.

    A row whose member isn't in a group is grouped by its member; a row without one (null or '') stands alone, and its
    group_key is null. Groups are looked up by a join that holds for hot members; the split is a hash of the group.
    """
    known = attach(rows.select("row_id", F.expr(f"nullif({member}, '')").alias("member_key")), found, ["member_key"])
    component = F.coalesce(F.concat(F.lit("g"), "group_key"), F.concat(F.lit("r"), F.col("row_id").cast("string")))
    keyed = known.select("row_id", F.coalesce("group_key", "member_key").alias("group_key")).withColumn("component", component)
    return assign_splits(keyed, shares, salt).select("row_id", "group_key", "split_name")


def shares_of(assignment: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(table_name, split_name, n_rows, n_groups, part, target, largest) of ``assignment`` (table_name, row_id, group_key,
    split_name): the rows and groups of each split, its part of the table and its target, and the part of the table that
    its largest group has, which is what may carry a split away from its target. Splits without rows are listed too."""
    groups = assignment.groupBy("table_name", "split_name", "group_key").agg(F.count("*").alias("n"))
    alone = F.col("group_key").isNull()
    told = groups.groupBy("table_name", "split_name").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(alone, F.col("n")).otherwise(1)).alias("n_groups"), F.max(F.when(alone, 1).otherwise(F.col("n"))).alias("most"))
    whole = told.groupBy("table_name").agg(F.sum("n_rows").alias("whole"))
    goal = assignment.sparkSession.createDataFrame([(s, x / sum(shares.values())) for s, x in sorted(shares.items())], "split_name string, target double")
    every = whole.join(F.broadcast(goal)).join(told, ["table_name", "split_name"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return every.select("table_name", "split_name", count("n_rows").alias("n_rows"), count("n_groups").alias("n_groups"),
        F.round(count("n_rows") / F.col("whole"), 6).alias("part"), "target", F.round(count("most") / F.col("whole"), 6).alias("largest"))
