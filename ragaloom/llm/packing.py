"""Texts packed into containers of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragaloom.llm.batches import runs
from ragaloom.session import Written

#: Pieces of texts in a shard that is packed by itself. A shard leaves about one container partly filled.
SHARD_PIECES = 50_000
#: Container sizes that may be asked for at once; each text gets a row for each.
MOST_LIMITS = 1000


class OpenBins:
    """Open bins by the room they have left, under a segment tree over all possible rooms."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.capacity, self.count = capacity, 0

    def put(self, room: int, number: int) -> None:
        """A bin with that room is open now."""
        if not self.bins[room]:
            i = room + self.width
            while i and not self.some[i]:
                self.some[i] = 1
                i >>= 1
        self.bins[room].append(number)

    def tightest(self, size: int) -> int:
        """The least room of an open bin that is at least ``size``; -1 if there is none. Logarithmic in the capacity."""
        i = size + self.width
        if self.some[i]:
            return size
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return -1

    def take(self, room: int) -> int:
        """An open bin with that room, which is closed."""
        number = self.bins[room].pop()
        if not self.bins[room]:
            i = room + self.width
            self.some[i] = 0
            while (i := i >> 1) and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = 0
        return number

    def place(self, size: int) -> tuple[int, int]:
        """(bin, tokens before the item in it) for the next item: the tightest open bin, else a new one."""
        room = self.tightest(size)
        if room < 0:
            self.count += 1
            room, number = self.capacity, self.count - 1
        else:
            number = self.take(room)
        self.put(room - size, number)
        return number, self.capacity - room


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["container", "container_id", "doc_id", "piece", "start_token", "n_tokens", "offset"]
    out: list[tuple] = []
    for (container, shard), rows in runs(batches, ["container", "shard"]):
        bins = OpenBins(int(rows[0][2]))
        for _, _, _, doc, piece, start, size in rows:
            number, offset = bins.place(size)
            out.append((container, f"{shard}-{number}", doc, piece, start, size, offset))
            if len(out) == 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
    yield pd.DataFrame(out, columns=names)


def packed(sizes: DataFrame, limits: DataFrame, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Best-fit decreasing: where each piece of each text goes, for every container size.

    ``sizes`` has doc_id and n_tokens, ``limits`` container and capacity_tokens (each container once; null or
    non-positive capacities are left out). A text is split only if it exceeds the capacity by itself: into pieces of
    the full capacity and a rest. Full pieces fill a container each; the others are taken largest first (ties by
    doc_id) to the open bin with the least room that holds them. Texts without tokens take no place and are left out.

    Pieces are dealt by hash into shards of about ``shard_pieces``, packed side by side; a shard costs at most about
    one partly filled container, and no task sees more than a shard. Columns: container, container_id string (shard and
    number; a full piece's container is named after the text and piece), doc_id, piece int (from 0), start_token and
    n_tokens long, offset int (tokens before the piece in its container).
    """
    held = Written(sizes.filter("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("long").alias("n")), "sizes")
    shards = max(1, -(-held.df.count() // shard_pieces))
    rules = limits.filter("capacity_tokens > 0 and container is not null").select("container", "capacity_tokens").limit(MOST_LIMITS + 1).collect()
    if len(rules) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} container sizes")
    sizes_of = F.array(*[F.struct(F.lit(r[0]).alias("container"), F.lit(int(r[1])).alias("capacity")) for r in rules]) if rules else F.expr("cast(array() as array<struct<container:string,capacity:int>>)")
    each = held.df.withColumn("x", F.explode(sizes_of)).select("doc_id", "n", "x.*").withColumn("full", F.expr("cast(n div capacity as int)"))
    whole = each.filter("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    whole = whole.select("container", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).cast("long").alias("start_token"), F.col("capacity").cast("long").alias("n_tokens"), F.lit(0).alias("offset"))
    rest = each.withColumn("size", (F.col("n") - F.col("full") * F.col("capacity")).cast("long")).filter("size > 0")
    rest = rest.select("container", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(shards)).cast("int").alias("shard"), "capacity", "doc_id", F.col("full").alias("piece"), (F.col("full") * F.col("capacity")).cast("long").alias("start_token"), "size")
    parts = max(1, min(shards * 3, 4096))
    ordered = rest.repartition(parts, "container", "shard").sortWithinPartitions("container", "shard", F.desc("size"), "doc_id")
    binned = ordered.mapInPandas(_pack, "container string, container_id string, doc_id bigint, piece int, start_token bigint, n_tokens bigint, offset int")
    return whole.unionByName(binned)


def fill(placed: DataFrame, limits: DataFrame) -> DataFrame:
    """For each container size the texts, pieces, tokens, containers used, and the part of their room that is used."""
    sums = placed.groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"), F.sum((F.col("offset") == 0).cast("long")).alias("n_containers"))
    return limits.select("container", "capacity_tokens").join(sums, "container").withColumn("used", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
