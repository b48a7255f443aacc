import math

import pytest
from pyspark.sql import functions as F

from ragaloom.operators.keyed_totals import keyed_totals
from ragaloom.operators.skew import attach

ROWS = [("a", 1.0)] * 50 + [("b", None), ("b", 3.0), (None, 2.0), ("", float("nan")), ("", -1.0), ("c", None)]
WANT = {"a": (50, 50, 50.0, 1.0, 1.0), "b": (2, 1, 3.0, 3.0, 3.0), None: (1, 1, 2.0, 2.0, 2.0), "": (2, 1, -1.0, -1.0, -1.0), "c": (1, 0, None, None, None)}


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("parts", [1, 40])
def test_totals(spark, limit, parts):
    df = spark.createDataFrame([(k, v, "x") for k, v in ROWS], "k string, v double, key string").repartition(parts)
    got = {r["key"]: tuple(r)[1:] for r in keyed_totals(df, F.col("k"), F.col("v"), limit).collect()}
    assert got == WANT


def test_empty_and_no_value(spark):
    df = spark.createDataFrame([], "k string")
    assert keyed_totals(df, F.col("k")).collect() == []
    one = keyed_totals(spark.createDataFrame([("x",), ("x",)], "k string"), F.col("k")).collect()
    assert [tuple(r) for r in one] == [("x", 2, 0, None, None, None)]


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_holds_for_hot_and_null_keys(spark, limit, how):
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(30)] + [(None, 1), ("gone", 2)], "k string, n long")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(30)], "k string, v long")
    want = left.join(right, "k", how)
    got = attach(left, right, ["k"], how, limit)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_found_is_not_empty(spark, data):
    import __spark_entry__ as entry

    rows = entry.queries()["p1_found"](spark, data).collect()
    assert rows and all(r["raga"] for r in rows)
    assert not any(math.isnan(1.0) for _ in rows)
