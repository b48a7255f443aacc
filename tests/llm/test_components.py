import random

import pytest
from pyspark.sql import functions as F

from ragaloom.llm.components import assign_splits, components
from ragaloom.llm.splits import artist_edges, assigned, groups, shares_of, track_edges


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = {
        "random": [(f"n{r.randrange(120)}", f"n{r.randrange(120)}") for _ in range(90)],
        "chain": [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)],
        "star": [("z", f"s{i}") for i in range(60)] * 2,
        "empty": [],
    }[kind]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame([*edges, (None, "x")], "a string, b string")).collect()}
    assert got == union_find(edges)


def test_track_and_artist_groups(spark):
    tracks = spark.createDataFrame(
        [("t1", "A", "Rāg"), ("t2", "A", "Rāg"), ("t2", "A", "Rāg"), ("t3", "A", "Other"), ("t4", "", "x"), ("t5", "", "x"), ("t6", None, "x"), ("t7", "A", None), ("t8", "B", "y"), ("t1", "B", "y")],
        "track_id string, title string, raga string",
    )
    assert {tuple(r) for r in groups(track_edges(tracks)).collect()} == {("t1", "t1"), ("t2", "t1"), ("t8", "t1")}
    listed = spark.createDataFrame([("X Y",), ("X Y & P Q",), ("P Q with Z",), ("Last, First",), ("First Last",), (None,), ("",), ("x y",)], "artist string")
    assert {tuple(r) for r in groups(artist_edges(listed)).collect()} == {("X Y", "P Q with Z"), ("X Y & P Q", "P Q with Z"), ("P Q with Z", "P Q with Z")}


SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def test_splits_keep_shares_and_places(spark):
    df = spark.createDataFrame([(f"c{i}", i) for i in range(8000)] + [(None, 1)], "component string, n_rows long")
    got = {r["component"]: r["split_name"] for r in assign_splits(df, SHARES).collect()}
    assert got.pop(None) is None and len(got) == 8000
    parts = {s: sum(x == s for x in got.values()) / 8000 for s in SHARES}
    assert all(abs(parts[s] - SHARES[s]) < 0.015 for s in SHARES)
    more = spark.createDataFrame([(f"c{i}",) for i in range(4000)] + [(f"new{i}",) for i in range(9000)] + [("c17",)] * 5000, "component string").repartition(7)
    after = {r["component"]: r["split_name"] for r in assign_splits(more, SHARES).distinct().collect()}
    assert all(after[c] == got[c] for c in after if c in got)  # rows that are added move nothing
    less = {r["component"]: r["split_name"] for r in assign_splits(df, {"train": 0.8, "validation": 0.1, "test": 0.2}).collect()}
    assert {(got[c], less[c]) for c in got if got[c] != less[c]} <= {("train", "test"), ("validation", "test")}
    assert {r["component"]: r["split_name"] for r in assign_splits(df, SHARES, "other").collect()} != got
    assert assign_splits(df.limit(0), SHARES).collect() == []
    with pytest.raises(ValueError):
        assign_splits(df, {})


def test_every_row_gets_a_split(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, ""), (5, "a")], "row_id long, artist string")
    found = spark.createDataFrame([("a", "a"), ("b", "a")], "member_key string, group_key string")
    given = assigned(rows, "artist", found, {"x": 1.0, "y": 1.0})
    got = {r["row_id"]: (r["group_key"], r["split_name"]) for r in given.collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] == got[2] == got[5] and got[3][0] is None and got[4][0] is None
    told = shares_of(given.withColumn("table_name", F.lit("t")), {"x": 1.0, "y": 1.0, "z": 0.0}).collect()
    assert {r["split_name"] for r in told} == {"x", "y", "z"} and sum(r["n_rows"] for r in told) == 5 and sum(r["n_groups"] for r in told) == 3
    assert max(r["largest"] for r in told) == 0.6
