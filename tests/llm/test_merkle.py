from itertools import permutations

import pandas as pd

from ragaloom.llm.merkle import classes, collapsed, columns_node, copies, is_arrangement, leaves, title_node

ROWS = [
    (1, "Hītī sētū; padalam; Sorati", "a", None, "t1"),
    (2, "Sorati | padalam | Hītī sētū", "a", None, "t2"),
    (3, "'HĪTĪ, SĒTŪ'; padalam - Sorati", "a", None, "t3"),
    (4, "Hītī sētū; padalam; Sorati", "b", None, "t1"),
    (5, "Rujo thebu", "a", "x", "t"),
    (6, "Rujothebu!", "a", "x", "t"),
    (7, "Rujo thebu", "a", "x", "t"),
    (8, "Rujo thēbu", "a", "x", "t"),
    (9, "Thebu rujo", "a", "x", "t"),
    (10, None, "a", "x", "t"),
    (11, None, "a", "x", "t"),
    (12, "!!", "a", "x", "t"),
    (13, "", "a", "x", "t"),
    (14, "x" * 50_000, "a", "x", "t"),
    (15, "X" * 50_000 + ".", "a", "x", "t"),
]


def test_groups(spark):
    df = spark.createDataFrame(ROWS, "row_id long, title string, form string, rest string, at string")
    found = copies(df, "row_id", "title", ["at"])
    assert {tuple(r) for r in found.collect()} == {(1, 2), (1, 3), (5, 6), (5, 7), (12, 13), (14, 15)}
    left = {r["row_id"]: r["copies"] for r in collapsed(df, found, "row_id").collect()}
    assert left == {1: 3, 4: 1, 5: 3, 8: 1, 9: 1, 10: 1, 11: 1, 12: 2, 14: 2}
    assert copies(df.limit(0), "row_id", "title", ["at"]).collect() == []
    bare = df.select("row_id", "title")
    assert (1, 4) in {tuple(r) for r in copies(bare, "row_id", "title", []).collect()}


def test_hot_group(spark):
    df = spark.createDataFrame([(i, "Abc de" if i % 3 else "ABC-DE", "c") for i in range(1, 2001)], "row_id long, title string, other string")
    found = copies(df, "row_id", "title", [])
    assert found.count() == 1999 and found.select("first_row_id").distinct().collect()[0][0] == 1


def test_arrangements_equal_brute_force():
    for parts in (["ab", "a", "b"], ["aa", "a"], ["abc", "ab", "c", "c"]):
        every = {"".join(p) for p in permutations(parts)}
        assert all(is_arrangement(parts, x) for x in every)
        assert not is_arrangement(parts, "z" + "".join(parts)[1:]) and not is_arrangement(parts, "".join(parts) + parts[0])
    assert classes(["a\x1fb", "b\x1fa", "ba", "c"]) == [0, 0, 0, 1]
    assert leaves(" - A.b -  C/ ") == ["ab", "c"]


def test_digests_are_of_parts_and_columns(spark):
    node = title_node(pd.Series(["Hītī; Sorati", "sorati / HĪTĪ", "Hītī Sorati", "Hīt; īSorati"]))
    assert node["node"][0] == node["node"][1] and len(set(node["node"])) == 3 and len(set(node["letters"])) == 1
    df = spark.createDataFrame([("x", None, 1, [1]), (None, "x", 1, [1]), ("x", None, 1, [1]), ("x", None, 1, [2]), ("", None, 1, [1])], "a string, b string, c int, d array<int>")
    first, second, third, fourth, fifth = [r[0] for r in df.select(columns_node(df, df.columns)).collect()]
    assert first == third and len({bytes(x) for x in (first, second, fourth, fifth)}) == 4
    turned = df.select("d", "c", "b", "a")
    assert turned.select(columns_node(turned, turned.columns)).first()[0] == first


def test_a_changed_digest_cannot_merge_other_texts():
    assert classes(["ab\x1fc", "c\x1fab", "abc", "cab", "a\x1fbc", "bca"]) == [0, 0, 0, 0, 0, 0]
    assert classes(["ab", "ba", "a\x1fbc"]) == [0, 1, 2]
