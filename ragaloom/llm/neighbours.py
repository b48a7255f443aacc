"""The most similar vectors of every vector, by counting collisions in windows of sorted projections."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import acos, ceil, log, log1p, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragaloom.llm.batches import runs
from ragaloom.operators.skew import attach
from ragaloom.session import written

#: Vectors in a block; blocks meet in pairs, so this bounds what a task holds: two blocks and their sorted projections.
BLOCK = 8192
#: Projections, the half width of a window for each unit of distance, and the collisions from which a pair is verified.
PROJECTIONS, WIDTH, COLLISIONS = 32, 1.118, 18
#: Vectors of a cell, about, and the part of the pairs at the floor that no table may bring together.
CELL, MISSED = 4096, 0.02
#: Places of a sorted projection where windows may begin and end.
STEPS = 256


def unit(contour) -> np.ndarray | None:
    """The vector less its mean, of length 1; None unless it is usable: finite values that aren't all equal."""
    if contour is None:
        return None
    values = np.asarray(contour, dtype=np.float64)
    if values.size < 2 or not np.isfinite(values).all() or values.max() == values.min():
        return None
    centred = values - values.mean()
    length = np.linalg.norm(centred)
    return (centred / length).astype(np.float32) if length > 0 else None


def projections(size: int, seed: int = 11) -> np.ndarray:
    """Random directions, the same in every task."""
    return np.random.default_rng(seed).standard_normal((size, PROJECTIONS)).astype(np.float32)


class Index:
    """A block's projections (``shadows``), each sorted by itself, and bit sets of the vectors before each step of the order."""

    def __init__(self, shadows: np.ndarray, vectors: np.ndarray | None = None) -> None:
        self.vectors, self.shadows = vectors, shadows
        n = len(shadows)
        self.step, words = -(-n // STEPS), -(-n // 64)
        order = np.argsort(self.shadows, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.shadows, order, 0).T)
        self.before = np.zeros((PROJECTIONS, STEPS + 1, words), np.uint64)
        at = np.arange(n) // self.step + 1
        for j in range(PROJECTIONS):
            ids = order[:, j]
            np.bitwise_or.at(self.before[j], (at, ids // 64), np.left_shift(np.uint64(1), (ids % 64).astype(np.uint64)))
            np.bitwise_or.accumulate(self.before[j], axis=0, out=self.before[j])

    def window(self, j: int, shadows: np.ndarray, reach: float) -> np.ndarray:
        """For each query the vectors whose projection j is within ``reach`` of its own, as bits, rounded out to steps."""
        low = np.searchsorted(self.sorted[j], shadows - reach, "left") // self.step
        high = -(-np.searchsorted(self.sorted[j], shadows + reach, "right") // self.step)
        return self.before[j][high] & ~self.before[j][low]

    def colliding(self, shadows: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs that meet in at least COLLISIONS windows, counted for 64 vectors at a time."""
        levels: list[list[np.ndarray]] = [[] for _ in range(PROJECTIONS.bit_length() + 1)]

        def add(bits: np.ndarray, level: int) -> None:
            levels[level].append(bits)
            if len(levels[level]) == 3:
                a, b, c = levels[level]
                half = a ^ b
                levels[level] = [half ^ c]
                add((a & b) | (half & c), level + 1)

        for j in range(PROJECTIONS):
            add(self.window(j, shadows[:, j], reach), 0)
        digits = []
        for level in range(len(levels)):
            while len(levels[level]) > 1:
                a, b = levels[level].pop(), levels[level].pop()
                levels[level].append(a ^ b)
                levels[level + 1].append(a & b)
                if len(levels[level + 1]) == 3:
                    a, b, c = levels[level + 1]
                    levels[level + 1] = [a ^ b ^ c]
                    levels[level + 2].append((a & b) | ((a ^ b) & c))
            digits.append(levels[level][0] if levels[level] else np.zeros_like(digits[0]))
        enough, equal = np.zeros_like(digits[0]), np.full_like(digits[0], ~np.uint64(0))
        for level in reversed(range(len(digits))):
            if COLLISIONS >> level & 1:
                equal &= digits[level]
            else:
                enough |= equal & digits[level]
                equal &= ~digits[level]
        enough |= equal
        query, word = np.nonzero(enough)
        bits = np.unpackbits(np.ascontiguousarray(enough[query, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pair, bit = np.nonzero(bits)
        return query[pair], word[pair] * 64 + bit


def best_in(queries: np.ndarray, shadows: np.ndarray, index: Index, k: int, levels: tuple[float, ...], rest: bool, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, similarity): the up to k best vectors of the block for each query.

    Virtual rehashing: the windows start at the reach of the first similarity of ``levels`` and widen to the next one
    for the queries that don't have k verified vectors of that similarity yet. With ``rest``, queries that still lack
    some in the end are compared with the whole block.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries), 256):
        left = np.arange(start, min(start + 256, len(queries)))
        for level in levels:
            if not len(left):
                break
            q, v = index.colliding(shadows[left], WIDTH * float(np.sqrt(2 - 2 * level)))
            q = left[q]
            if same:
                q, v = q[q != v], v[q != v]
            similar = np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 4096]], index.vectors[v[i : i + 4096]]) for i in range(0, len(q), 4096)]) if len(q) else np.zeros(0, np.float32)
            near = similar >= level
            count = np.bincount(q[near], minlength=left[-1] + 1)
            done = count[left] >= k
            last = level == levels[-1] and not rest
            take = near & (np.isin(q, left) if last else np.isin(q, left[done]))
            out.append((q[take], v[take], similar[take]))
            left = left[~done]
        if rest and len(left):
            table = queries[left] @ index.vectors.T
            if same:
                table[np.arange(len(left)), left] = -2
            most = min(k, table.shape[1])
            top = np.argpartition(-table, most - 1, axis=1)[:, :most]
            similar = np.take_along_axis(table, top, 1).ravel()
            keep = similar > -1.5
            out.append((np.repeat(left, most)[keep], top.ravel()[keep], similar[keep]))
    q, v, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - first < k
    return q[keep], v[keep], s[keep]


def _meet(k: int, levels: tuple[float, ...], rest: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        sides = {b: pdf[pdf["block"] == b].sort_values("group") for b in {i, j}}
        held = {}
        for b, side in sides.items():
            if len(side):
                vectors = np.frombuffer(b"".join(side["vector"]), np.float32).reshape(len(side), -1)
                held[b] = (side["group"].to_numpy(), Index(vectors @ projections(vectors.shape[1]), vectors))
        found = []
        for a, b in {(i, j), (j, i)}:
            if a in held and b in held:
                names, mine = held[a]
                others, index = held[b]
                q, v, s = best_in(mine.vectors, mine.shadows, index, k, levels, rest, a == b)
                found.append(pd.DataFrame({"group": names[q], "other": others[v], "similarity": s.astype(np.float64)}))
        return pd.concat(found) if found else pd.DataFrame({"group": [], "other": [], "similarity": []})

    return run


def cells(n: int, floor: float) -> tuple[int, int]:
    """(bits, tables): how many signs make a cell of about CELL of n vectors, and how many such tables bring all but
    MISSED of the pairs of similarity ``floor`` into one cell at least. Two vectors have a sign in common with a
    probability of 1 - angle / pi, so the tables grow as a small power of n."""
    bits = max(0, ceil(log2(max(n, 1) / CELL)))
    together = (1 - acos(min(max(floor, -1.0), 1.0)) / pi) ** bits
    return bits, 1 if together >= 1 else max(1, ceil(log(MISSED) / log1p(-together)))


def small(vectors: np.ndarray) -> np.ndarray:
    """Vectors in 16-bit steps of their largest value."""
    return np.rint(vectors * (32767 / np.abs(vectors).max(1, keepdims=True))).astype(np.int16)


def large(steps: np.ndarray) -> np.ndarray:
    """Unit vectors out of steps."""
    vectors = steps.astype(np.float32)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _celled(bits: int, tables: int, whole: bool):
    """For each vector and table its cell, a number made of signs, and with ``whole`` the vector in 16-bit steps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.frombuffer(b"".join(batch["vector"]), np.float32).reshape(len(batch), -1)
            signs = np.random.default_rng(23).standard_normal((vectors.shape[1], bits * tables)).astype(np.float32)
            key = ((vectors @ signs) > 0).reshape(len(batch), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            out = pd.DataFrame({"t": np.tile(np.arange(tables, dtype=np.int32), len(batch)), "cell": key.ravel()})
            if whole:
                out["group"] = np.repeat(batch["group"].to_numpy(), tables)
                out["vector"] = np.repeat(np.array([v.tobytes() for v in small(vectors)], dtype=object), tables)
            yield out

    return run


def _met(k: int, levels: tuple[float, ...]):
    """The k best of each vector in its cell, or in each tile of a large cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[str, str, float]] = []
        for (_, _, i, j), rows in runs(batches, ["t", "cell", "i", "j"]):
            sides = {}
            for tile in {i, j}:
                mine = [r for r in rows if r[5] == tile]
                if mine:
                    vectors = large(np.frombuffer(b"".join(r[6] for r in mine), np.int16).reshape(len(mine), -1))
                    sides[tile] = [r[4] for r in mine], Index(vectors @ projections(vectors.shape[1]), vectors)
            for a, b in {(i, j), (j, i)}:
                if a in sides and b in sides:
                    names, mine = sides[a]
                    others, index = sides[b]
                    for q, v, near in zip(*(x.tolist() for x in best_in(mine.vectors, mine.shadows, index, k, levels, False, a == b)), strict=True):
                        found.append((names[q], others[v], near))
            if len(found) > 20_000:
                yield pd.DataFrame(found, columns=["group", "other", "similarity"])
                found = []
        yield pd.DataFrame(found, columns=["group", "other", "similarity"]).astype({"similarity": float})

    return run


def collided(distinct: DataFrame, k: int, floor: float, block: int) -> DataFrame:
    """(group, other, similarity) of distinct vectors (group, vector): the k best that each vector has of at least
    ``floor``, and perhaps more, without the few pairs that no window or table brings together.

    Vectors meet in cells: each of several tables cuts them by the signs of a few random projections, so a vector is
    searched for in its cells only, and is shuffled once for each table. In a cell, collisions are counted in windows of
    sorted projections, and pairs that collide often enough are verified. A cell of more than ``block`` vectors is cut
    into tiles that meet in pairs, so no task gets more than two.
    """
    bits, tables = cells(distinct.count(), floor)
    levels = (0.97, floor) if floor < 0.97 else (floor,)
    sizes = distinct.mapInPandas(_celled(bits, tables, False), "t int, cell bigint").groupBy("t", "cell").agg(F.count("*").alias("n"))
    sizes = sizes.filter("n > 1").select("t", "cell", F.ceil(F.col("n") / block).cast("int").alias("tiles"))
    placed = distinct.mapInPandas(_celled(bits, tables, True), "t int, cell bigint, `group` string, vector binary")
    rows = attach(placed, sizes, ["t", "cell"], "inner").withColumn("tile", F.pmod(F.xxhash64("group"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = rows.select("t", "cell", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "group", "tile", "vector")
    parts = max(tables * 2 ** min(bits, 10) // 4, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = met.repartition(parts, "t", "cell", "i", "j").sortWithinPartitions("t", "cell", "i", "j").mapInPandas(_met(k, levels), "`group` string, other string, similarity double")
    return pairs.groupBy("group", "other").agg(F.max("similarity").alias("similarity"))


def _read(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, contour in zip(batch["id"], batch["contour"], strict=True):
                vector = unit(contour)
                if vector is not None and len(vector) == length:
                    rows.append((name, blake2b(vector.tobytes(), digest_size=16).hexdigest(), vector.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "group", "vector"])

    return run


def searched(distinct: DataFrame, k: int, block: int) -> DataFrame:
    """(group, other, similarity): the k best of each meeting of blocks of distinct vectors (group, vector). Queries whose
    windows don't hold k vectors of 0.9 are compared with the whole block."""
    blocks = max(1, -(-distinct.count() // block))
    placed = distinct.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks)).cast("int"))
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "group", "vector")
    return met.repartition(blocks * (blocks + 1) // 2, "i", "j").groupBy("i", "j").applyInPandas(_meet(k, (0.97, 0.9), True), "`group` string, other string, similarity double")


def neighbours(vectors: DataFrame, id_column: str, column: str, k: int = 5, length: int = 500, floor: float | None = None, block: int = BLOCK) -> DataFrame:
    """(id, other, similarity, rank): the k vectors of highest Pearson correlation for every usable vector.

    Usable are vectors of ``length`` finite values that aren't all equal; others, null ones included, are left out, as
    are null ids; ids must be unique. With ``floor`` only neighbours of at least that similarity are wanted, and vectors
    meet in cells (see ``collided``); without, most vectors have no neighbour that a window could tell from others, so
    blocks of about ``block`` vectors meet in pairs (see ``searched``).

    Equal vectors are one vector to the search, so copies cost nothing however many there are; afterwards each stands
    for its smallest k + 1 ids. Ties go to the smaller id. Similarities are from unit vectors of 32 bits, with
    ``floor`` of 16-bit steps (off by less than 0.0001); equal vectors have 1.
    """
    usable = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("contour")).dropna(subset=["id"])
    rows = written(usable.mapInPandas(_read(length), f"id {dict(usable.dtypes)['id']}, `group` string, vector binary"), "vectors")
    members = rows.select("id", "group")
    distinct = written(rows.groupBy("group").agg(F.first("vector").alias("vector")), "distinct")
    pairs = collided(distinct, k, floor, block) if floor is not None else searched(distinct, k, block)
    ranked = pairs.withColumn("r", F.expr("row_number() over (partition by `group` order by similarity desc, other)")).filter(F.col("r") <= k).select("group", "other", "similarity")
    ranked = written(ranked, "ranked")
    few = members.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.expr("row_number() over (partition by `group`, s order by id)")).filter(F.col("r") <= k + 1)
    few = written(few.withColumn("r", F.expr("row_number() over (partition by `group` order by id)")).filter(F.col("r") <= k + 1).groupBy("group").agg(F.sort_array(F.collect_list("id")).alias("ids")), "few")
    lists = ranked.join(few.withColumnRenamed("group", "other"), "other").groupBy("group").agg(F.collect_list(F.struct("similarity", "ids")).alias("near"))
    whole = few.join(lists, "group", "left").select("group", F.concat(F.array(F.struct(F.lit(1.0).alias("similarity"), "ids")), F.coalesce("near", F.array().cast("array<struct<similarity:double,ids:array<string>>>" if dict(usable.dtypes)["id"] == "string" else f"array<struct<similarity:double,ids:array<{dict(usable.dtypes)['id']}>>>"))).alias("near"))
    each = attach(members, whole, ["group"], "inner").select("id", F.explode("near").alias("x")).select("id", F.col("x.similarity").alias("similarity"), F.explode("x.ids").alias("other")).filter("id <> other")
    return each.withColumn("rank", F.expr("row_number() over (partition by id order by similarity desc, other)")).filter(F.col("rank") <= k).select("id", "other", "similarity", "rank")
