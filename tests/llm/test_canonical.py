import random

import pytest

from ragaloom.llm import canonical as C


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_and_tree_equal_brute_force():
    r = random.Random(5)
    words = ["".join(r.choice("abch") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    tree = C.Tree([(w, i) for i, w in enumerate(words)])
    for q in words[:60]:
        assert all(C.levenshtein(q, w, 99) == plain_levenshtein(q, w) for w in words[:50])
        for most in (0, 1, 2):
            assert {w for _, w in tree.within(q, most)} == {w for w in words if plain_levenshtein(q, w) <= most}
    assert C.damerau("ab", "ba") == 1 and C.levenshtein("", "abc", 9) == 3


def test_swaps_lose_no_entry():
    r = random.Random(7)
    names = sorted({"".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 13))) for _ in range(250)})
    tree = C.Tree([(n, i) for i, n in enumerate(names)])
    for name in names:
        word = list(name)
        for _ in range(r.randrange(0, 4)):
            i = r.randrange(len(word) - 1)
            word[i : i + 2] = word[i + 1], word[i]
        word = "".join(word)
        for read in C.readings(word):
            want = {i for i, n in enumerate(names) if C.damerau(read, n) <= C.EDITS_PER_LETTER * max(len(n), len(read))}
            got = {names.index(n) for _, n in tree.within(read, C.reach(read)) if C.damerau(read, n) <= C.EDITS_PER_LETTER * max(len(n), len(read))}
            assert got == want
    assert C.closest(C.Tree([("abcdefghij", 4)]), "bacedfhgij") == [(0.3, 6, 4)]


VOCABULARY = [(1, "Thathēḍiri"), (2, "Jehoroto"), (3, "Purava jehoroto"), (4, "Dīchega/Bachomumi"), (5, "Vīśini")]


@pytest.mark.parametrize("shard", [20_000, 2])
def test_meanings(spark, monkeypatch, shard):
    monkeypatch.setattr(C, "SHARD", shard)
    values = {"Thathēḍiri": 1, "rAgam THATHEDIRI (short)": 1, "Thtahediri*": 1, "purava jeoroto": 3, "Jehorotoo": 2, "bachomum": 4, "Deechega - contd": 4, "Vishini": 5, "1999": 0, "tuning": 0, "": 0, "  ": 0, "x" * 5000: 0}
    df = spark.createDataFrame([(v,) for v in [*values, None, "tuning"]], "value string")
    vocabulary = spark.createDataFrame([*VOCABULARY, (9, None)], "raga_id int, raga_name string")
    assert {r["value"]: r["entry_id"] for r in C.resolved(df, vocabulary).collect()} == values
    assert {r["entry_id"] for r in C.resolved(df, vocabulary.limit(0)).collect()} <= {0}


def test_rows_keep_their_nulls(spark):
    rows = spark.createDataFrame([(1, "a", 7), (2, None, 7), (3, "a", 7)], "row_id long, raga string, entry_name int")
    means = spark.createDataFrame([("a", 4)], "value string, entry_id int")
    assert {(r["row_id"], r["entry_id"]) for r in C.mapped(rows, "raga", means).collect()} == {(1, 4), (2, None), (3, 4)}
