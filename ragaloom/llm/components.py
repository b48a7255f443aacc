"""Connected components, and splits that keep them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragaloom.operators.skew import attach
from ragaloom.session import Written


def _kept(df: DataFrame) -> tuple[Written, tuple]:
    """The written clusters, and their number and sums. (Seeing these while they are written would save a small job, but
    an observed session can't run the library's forests any more.)"""
    held = Written(df, "clusters")
    return held, tuple(held.df.agg(F.count("*"), F.sum(F.xxhash64("v", "u") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b); the component is its smallest node.

    Hash-to-min: each node holds a cluster, at first itself and its neighbours. It sends the cluster to the cluster's
    smallest node and that node to all of the cluster, until nothing changes, which takes a number of rounds about the
    logarithm of the longest path. A cluster is kept as rows, never as one value, so a component may have any size; the
    node with a large cluster is a hot key of a join that holds for those. Each round's rows are written to the shared
    folder. Null nodes are left out; repeated edges and loops change nothing.
    """
    clean = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).dropna()
    both = clean.unionByName(clean.select(F.col("u").alias("v"), F.col("v").alias("u")))
    held, now = _kept(both.unionByName(both.select("v", F.col("v").alias("u"))).distinct())
    before = None
    while now != before and now[0]:
        before = now
        least = held.df.groupBy("v").agg(F.min("u").alias("m"))
        sent = attach(held.df, least, ["v"], "inner")
        after, now = _kept(sent.select(F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.*").distinct())
        held.drop()
        held = after
    return held.df.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def stars(members: DataFrame, member: str, keys: list[str]) -> DataFrame:
    """Edges (a, b) that join all members of each key, through the key's smallest member; nulls in a key join nothing."""
    pairs = members.select(member, *keys).dropna().distinct()
    least = pairs.groupBy(*keys).agg(F.min(member).alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return attach(pairs, least, keys, "inner").select(F.col(member).alias("a"), "b").filter("a <> b")


def _uniform(component: str, split: str, salt: str) -> str:
    """SQL for a number in (0, 1) that depends on the component, the split and the salt."""
    return f"((shiftrightunsigned(xxhash64({component}, '{split}', '{salt}'), 12) + 0.5D) / {float(1 << 52)!r}D)"


def assign_splits(components: DataFrame, shares: dict[str, float], salt: str = "") -> DataFrame:
    """``components`` (component string and any other columns but split_name) with each one's ``split_name``. No shuffle.

    Weighted rendezvous hashing: a component goes to the split of the least -ln(u) / share, u being a hash of both. So
    the split depends on the component, the shares and the salt alone: rows that are added move no other component, and
    a changed share moves only the components that it must. The price is that a component of a large part of all rows
    takes its split's share with it; another salt gives another draw. A null component gets no split. Shares are scaled
    to a sum of 1; names and salt must be without quotes.
    """
    if not shares or any("'" in s or "\\" in s for s in (*shares, salt)) or min(shares.values()) < 0 or sum(shares.values()) <= 0:
        raise ValueError("shares must be positive, and their names without quotes")
    ranked = [F.struct(F.expr(f"-ln({_uniform('component', s, salt)}) / {shares[s]!r}D").alias("score"), F.lit(s).alias("split_name")) for s in sorted(shares) if shares[s] > 0]
    by_hash = (F.least(*ranked) if len(ranked) > 1 else ranked[0])["split_name"]
    return components.withColumn("split_name", F.when(F.col("component").isNotNull(), by_hash))
