"""Sources mixed to target shares of the total size."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragaloom.session import Written

#: Rows of a leaf that one task orders at most, about: a leaf is cut into buckets by the same hash that orders it.
BUCKET_ROWS = 20_000
#: Leaves (paths of the tree) that are planned in the driver; more is an error, not a cut.
MOST_LEAVES = 100_000
BETWEEN = "\x1f"


@dataclass
class Node:
    """A part of the tree: its weight, what it can give at most, and its children."""

    weight: float = 0.0
    most: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)
    given: float = 0.0


def plan(leaves: list[tuple[tuple[str, ...], float, float]], total: float) -> dict[tuple[str, ...], float]:
    """The budget of each leaf (path, weight, most). Weights and limits add up towards the root.

    A node's budget is at most what its leaves can give, so a shortage shows at the highest node that has it: there its
    siblings take it up by their weights, and only what they can't take goes on to the siblings of its ancestors.
    """
    root = Node()
    for path, weight, most in leaves:
        node = root
        node.weight, node.most = node.weight + weight, node.most + most * (weight > 0)
        for step in path:
            node = node.children.setdefault(step, Node())
            node.weight, node.most = node.weight + weight, node.most + most * (weight > 0)
    rise(root, total)
    out = {}
    for path, *_ in leaves:
        node = root
        for step in path:
            node = node.children[step]
        out[path] = node.given
    return out


def rise(root: Node, total: float) -> None:
    """Shares by weight from the root down; then shortages, from the leaves up, go to siblings before ancestors."""

    def down(node: Node, budget: float) -> float:
        """Gives ``budget`` to the subtree by weights alone; returns what it couldn't place in it."""
        if not node.children:
            node.given = min(budget, node.most if node.weight > 0 else 0.0)
            return budget - node.given
        left = 0.0
        for child in node.children.values():
            left += down(child, budget * child.weight / node.weight if node.weight else 0.0)
        left = fill_up(node, left)
        node.given = sum(c.given for c in node.children.values())
        return left

    def fill_up(node: Node, left: float) -> float:
        """Places what is left among the children that have room, by weight."""
        while left > 1e-9:
            room = [c for c in node.children.values() if c.weight > 0 and c.most - c.given > 1e-9]
            if not room:
                return left
            weight, before = sum(c.weight for c in room), left
            for child in room:
                left -= add(child, before * child.weight / weight)
        return 0.0

    def add(node: Node, more: float) -> float:
        """Gives more to a subtree; returns what it took."""
        if not node.children:
            took = min(more, node.most - node.given)
        else:
            took = more - fill_up(node, more)
        node.given += took
        return took

    down(root, total)


def mixed(sizes: DataFrame, targets: DataFrame, domain: str | None = None, total: float | None = None, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) of ``sizes`` (doc_id, source, lang, n_tokens and the column ``domain``, if one is named) by
    ``targets`` (source, target_share, max_repeats).

    The tree has domains, in them languages, in them sources; without a domain column there is one domain. Weights come
    from the targets: the leaves of a source share its weight by their tokens. A leaf can give max_repeats epochs of
    its tokens, so a source that can't reach its target falls short in all of its leaves alike. Such a shortage goes to
    the other sources of that domain and language first, what they can't take to the domain's other languages, and only
    the rest to other domains. ``total`` tokens are mixed; by default as many as the targeted sources have.

    A leaf's texts are ordered by a seeded hash of the epoch; a leaf is used for whole epochs and then for the longest
    prefix of the next epoch whose tokens stay within the budget. No text is split or used more often than its cap.
    The prefix is found by buckets of the hash, so that no task orders a whole leaf.

    ``chosen``: doc_id, source, lang, n_tokens, uses int (at least 1). ``shares``: source, target_share, max_repeats,
    available_tokens, used_tokens, actual_share, rounding (the most that the leaves' prefixes may lack of a share),
    short (the target was out of reach); sources without a target are listed with null targets and use nothing. Null
    sources count as sources without a target, null domains and languages as one of their kind; texts without tokens
    are left out. Null or negative shares count as 0, null repeats as 1. More than MOST_LEAVES leaves are an error:
    domains, languages and sources are names, not free text.
    """
    part = F.coalesce(F.col(f"`{domain}`").cast("string"), F.lit("?")) if domain else F.lit("*")
    rows = sizes.filter("n_tokens > 0").select("doc_id", "source", "lang", "n_tokens", F.concat_ws(BETWEEN, part, F.coalesce("lang", F.lit("?"))).alias("leaf"))
    held = Written(rows, "mix").df
    stock = held.groupBy("source", "leaf").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(stock) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    wanted = {r["source"]: (max(r["target_share"] or 0.0, 0.0), max(1 if r["max_repeats"] is None else r["max_repeats"], 0)) for r in targets.dropna(subset=["source"]).collect()}
    have: dict[str | None, int] = {}
    for r in stock:
        have[r["source"]] = have.get(r["source"], 0) + r["tokens"]
    if total is None:
        total = float(sum(n for s, n in have.items() if wanted.get(s, (0, 0))[0] > 0))
    leaves = [((*r["leaf"].split(BETWEEN), r["source"]), wanted[r["source"]][0] * r["tokens"] / have[r["source"]], float(r["tokens"] * wanted[r["source"]][1])) for r in stock if r["source"] in wanted]
    scale = sum(w for _, w, _ in leaves)
    budgets = plan(leaves, total) if scale > 0 else {}
    stocked = {(r["source"], r["leaf"]): r for r in stock}
    steps = []
    for (*path, source), budget in budgets.items():
        leaf = BETWEEN.join(path)
        r = stocked[source, leaf]
        epochs = min(int((budget + 1e-6) // r["tokens"]), wanted[source][1])
        rest = budget - epochs * r["tokens"] if epochs < wanted[source][1] else 0.0
        steps.append((source, leaf, epochs, max(rest, 0.0), max(1, -(-r["n"] // bucket_rows))))
    spark = sizes.sparkSession
    schema = "source string, leaf string, epochs int, rest double, buckets int"
    by_leaf = F.broadcast(spark.createDataFrame(pd.DataFrame(steps, columns=["source", "leaf", "epochs", "rest", "buckets"]), schema))
    placed = held.join(by_leaf, ["source", "leaf"]).withColumn("h", F.xxhash64(F.lit(seed), "epochs", "doc_id"))
    placed = placed.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 1).cast("double") / float(1 << 63)) * F.col("buckets")).cast("int")).withColumn("bucket", F.least("bucket", F.col("buckets") - 1))
    per_bucket = placed.groupBy("source", "leaf", "bucket", "rest").agg(F.sum("n_tokens").alias("b_tokens"))
    before = per_bucket.withColumn("upto", F.expr("sum(b_tokens) over (partition by source, leaf order by bucket)"))
    edges = before.filter("upto - b_tokens <= rest").groupBy("source", "leaf").agg(F.max("bucket").alias("edge"), F.max_by(F.col("upto") - F.col("b_tokens"), "bucket").alias("start"), F.max_by("upto", "bucket").alias("end"))
    known = placed.join(F.broadcast(edges), ["source", "leaf"])
    inside = known.filter("bucket < edge or (bucket = edge and end <= rest)").withColumn("extra", F.lit(1))
    at_edge = known.filter("bucket = edge and end > rest").withColumn("upto", F.expr("start + sum(n_tokens) over (partition by source, leaf order by shiftrightunsigned(h, 1), doc_id)"))
    at_edge = at_edge.withColumn("extra", (F.col("upto") <= F.col("rest")).cast("int")).drop("upto")
    outside = known.filter("bucket > edge").withColumn("extra", F.lit(0))
    chosen = inside.unionByName(at_edge).unionByName(outside).select("doc_id", "source", "lang", "n_tokens", (F.col("epochs") + F.col("extra")).alias("uses")).filter("uses > 0")
    chosen = Written(chosen, "chosen").df
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"))
    stock_table = held.groupBy("source", "leaf").agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("m")).groupBy("source").agg(F.sum("t").alias("available_tokens"), F.sum("m").alias("longest"))
    named = targets.dropna(subset=["source"]).select("source", "target_share", "max_repeats")
    all_used = chosen.agg(F.sum(F.col("n_tokens") * F.col("uses"))).first()[0] or 0
    shares = named.join(stock_table, "source", "full_outer").join(used, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("longest", F.lit(0)).alias("longest"))
    part = lambda c: F.col(c) / F.lit(float(max(all_used, 1)))
    shares = shares.withColumn("actual_share", part("used_tokens")).withColumn("rounding", part("longest")).drop("longest")
    goal = F.col("target_share") / F.lit(float(sum(s for s, _ in wanted.values()) or 1.0)) * F.lit(float(total))
    return chosen, shares.withColumn("short", F.coalesce(F.col("available_tokens") * F.col("max_repeats") < goal, F.lit(False)))
