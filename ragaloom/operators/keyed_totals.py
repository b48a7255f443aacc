"""Totals per key when a handful of keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragaloom.session import Written

#: The dictionary of all keys goes to every task up to this many bytes; beyond it each task encodes its own keys.
DICTIONARY_BYTES = 64 << 20
#: Keys in a block of the dense arrays, and arrays that one task sums up in the reduction.
BLOCK = 4096
FAN_IN = 32


class Totals:
    """Dense arrays over key codes: rows, values, and sum, least and greatest of the values."""

    def __init__(self, size: int) -> None:
        self.rows, self.n = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.total, self.least, self.most = np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)

    def add(self, codes: np.ndarray, values: np.ndarray) -> None:
        """Adds one row for each code; a NaN value counts as a row only."""
        size = len(self.rows)
        self.rows += np.bincount(codes, minlength=size)
        have = ~np.isnan(values)
        codes, values = codes[have], values[have]
        self.n += np.bincount(codes, minlength=size)
        self.total += np.bincount(codes, weights=values, minlength=size)
        np.minimum.at(self.least, codes, values)
        np.maximum.at(self.most, codes, values)

    def merge(self, rows: np.ndarray, n: np.ndarray, total: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        """Adds the arrays of another part of the input."""
        self.rows += rows
        self.n += n
        self.total += total
        np.minimum(self.least, least, out=self.least)
        np.maximum(self.most, most, out=self.most)

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.rows, self.n, self.total, self.least, self.most


FIELDS = ("n_rows", "n_values", "total", "least", "most")
KINDS = (np.int64, np.int64, np.float64, np.float64, np.float64)
DENSE = "block int, part int, " + ", ".join(f"{f} binary" for f in FIELDS)


def _block_row(block: int, part: int, arrays: tuple[np.ndarray, ...]) -> dict:
    return {"block": block, "part": part} | {f: a.tobytes() for f, a in zip(FIELDS, arrays, strict=True)}


def _encode_with(keys: pa.Array):
    """Sums the batches of a task into dense arrays over a dictionary that all tasks share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, sums = keys.value, Totals(len(keys.value))
        for batch in batches:
            codes = pc.index_in(batch.column(0), value_set=dictionary).to_numpy(zero_copy_only=False)
            sums.add(codes.astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
        part = TaskContext.get().partitionId()
        out = [_block_row(i // BLOCK, part, tuple(a[i : i + BLOCK] for a in sums.parts())) for i in range(0, len(dictionary), BLOCK) if sums.rows[i : i + BLOCK].any()]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW_DENSE)

    return run


_ARROW_DENSE = pa.schema([("block", pa.int32()), ("part", pa.int32()), *((f, pa.binary()) for f in FIELDS)])


def _sum_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One array block out of at most FAN_IN."""
    sums = Totals(len(pdf[FIELDS[0]].iloc[0]) // 8)
    for row in pdf[list(FIELDS)].itertuples(index=False):
        sums.merge(*(np.frombuffer(b, k) for b, k in zip(row, KINDS, strict=True)))
    return pd.DataFrame([_block_row(int(key[0]), int(key[1]), sums.parts())])


def _encode_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch under a dictionary of its own; the rows that leave are one per key and batch."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode(null_encoding="encode")
        sums = Totals(len(coded.dictionary))
        sums.add(coded.indices.to_numpy().astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
        if len(coded.dictionary):
            yield pa.RecordBatch.from_arrays([coded.dictionary, *map(pa.array, sums.parts())], names=["key", *FIELDS])


def keyed_totals(df: DataFrame, key: Column, value: Column | None = None, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """Rows, number of values, sum, least and greatest value of each key, exactly, however the rows fall on the keys.

    The keys are dictionary-encoded, each task sums its split of the input into dense arrays by ``bincount`` and
    scatter-reduction, and blocks of these arrays are summed by a tree of tasks of FAN_IN arrays each. The input rows
    are never shuffled, so a key with nearly all rows costs no task more than another key does. If the dictionary is
    larger than ``dictionary_bytes``, each batch gets its own and the partial sums are shuffled by key.

    ``key`` is a string; null is a key of its own and '' is another. Null and NaN values count in ``n_rows`` only; a
    key without values has null in ``total``, ``least`` and ``most``. An empty input gives no rows. Columns:
    key string, n_rows long, n_values long, total double, least double, most double.
    """
    rows = df.select(key.cast("string").alias("key"), (value if value is not None else F.lit(None)).cast("double").alias("value"))
    rows = rows.select("key", F.coalesce("value", F.lit(float("nan"))).alias("value"))
    keys = Written(rows.select("key").distinct(), "keys")
    size = keys.df.agg(F.sum(F.coalesce(F.octet_length("key"), F.lit(0)) + 8)).first()[0] or 0
    if size > dictionary_bytes:
        some = rows.mapInArrow(_encode_own, "key string, n_rows long, n_values long, total double, least double, most double")
        out = some.groupBy("key").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    else:
        dictionary = pa.array(sorted((r[0] for r in keys.df.collect()), key=lambda k: (k is not None, k or "")), pa.string())
        shared = df.sparkSession.sparkContext.broadcast(dictionary)
        dense = rows.mapInArrow(_encode_with(shared), DENSE)
        parts = rows.rdd.getNumPartitions()
        while parts > 1:
            dense = dense.groupBy("block", F.expr(f"cast(part div {FAN_IN} as int)").alias("part")).applyInPandas(_sum_blocks, DENSE)
            parts = ceil(parts / FAN_IN)

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    arrays = [np.frombuffer(row[f], k) for f, k in zip(FIELDS, KINDS, strict=True)]
                    some = np.flatnonzero(arrays[0])
                    names = shared.value.take(pa.array(some + row["block"] * BLOCK))
                    yield pa.RecordBatch.from_arrays([names, *(pa.array(a[some]) for a in arrays)], names=["key", *FIELDS])

        out = dense.mapInArrow(decode, T.StructType([T.StructField("key", T.StringType()), *(T.StructField(f, T.LongType() if k is np.int64 else T.DoubleType()) for f, k in zip(FIELDS, KINDS, strict=True))]))
    have = F.col("n_values") > 0
    return out.select("key", "n_rows", "n_values", *(F.when(have, F.col(c)).alias(c) for c in FIELDS[2:]))
