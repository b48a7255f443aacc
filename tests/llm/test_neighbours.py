import numpy as np
import pandas as pd
import pytest

from ragaloom.llm import neighbours as V


def table(spark, n=700, size=60):
    r = np.random.default_rng(4)
    base = r.standard_normal((n // 4, size)).cumsum(1)
    rows = []
    for i in range(n):
        x = base[i % len(base)] * (3 if i % 2 else 1) + r.standard_normal(size) * (0.3 if i % 3 else 2.0)
        rows.append((f"t{i:04}", [float(v) for v in x], "e"))
    rows += [("null", None, "e"), ("flat", [2.0] * size, "e"), ("nan", [float("nan")] * size, "e"), ("short", [1.0, 2.0], "e"), (None, rows[0][1], "e")]
    rows += [(f"copy{i:03}", rows[0][1], "e") for i in range(40)]
    return spark.createDataFrame(rows, "track_id string, contour array<double>, similarity string"), rows


@pytest.mark.parametrize("floor", [None, 0.9])
@pytest.mark.parametrize("block", [8192, 200])
def test_recall_against_brute_force(spark, floor, block):
    df, rows = table(spark)
    usable = [(i, V.unit(x)) for i, x, _ in rows if i and x and len(x) == 60 and V.unit(x) is not None]
    ids, x = [i for i, _ in usable], np.array([u for _, u in usable], float)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    got = V.neighbours(df, "track_id", "contour", k=5, length=60, floor=floor, block=block).collect()
    least = {}
    for r in got:
        least.setdefault(r["id"], []).append(r["similarity"])
    kept = wanted = 0
    for a, i in enumerate(ids):
        best = np.sort(s[a])[::-1][:5]
        best = best[best >= (floor or -1)]
        wanted += len(best)
        kept += sum(abs(b - g) < 1e-4 for b, g in zip(best, sorted(least.get(i, []), reverse=True), strict=False))
    assert kept / wanted >= 0.97
    assert max(len(v) for v in least.values()) <= 5 and not {"null", "flat", "nan", "short"} & set(least)


def test_copies_and_empty(spark):
    df, _ = table(spark)
    near = [r for r in V.neighbours(df, "track_id", "contour", length=60, floor=0.9).collect() if r["id"] == "copy020"]
    assert [r["other"] for r in sorted(near, key=lambda r: r["rank"])] == ["copy000", "copy001", "copy002", "copy003", "copy004"]
    assert V.neighbours(df.limit(0), "track_id", "contour", length=60).collect() == []


def test_many_cells_lose_few_pairs(monkeypatch):
    assert V.cells(100, 0.9) == (0, 1) and V.cells(0, 0.9) == (0, 1)
    bits, tables = V.cells(1_000_000, 0.9)
    assert bits == 8 and (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= V.MISSED and tables < 20
    r = np.random.default_rng(8)
    base = r.standard_normal((400, 80))
    x = np.concatenate([base, base + 0.45 * r.standard_normal(base.shape)])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    near = {(i, i + 400) for i in range(400) if x[i] @ x[i + 400] >= 0.9}
    monkeypatch.setattr(V, "CELL", 32)
    bits, tables = V.cells(len(x), 0.9)
    rows = next(V._celled(bits, tables, True)(iter([pd.DataFrame({"group": [f"{i:03}" for i in range(800)], "vector": [v.tobytes() for v in x]})])))
    rows = rows.assign(i=0, j=0, tile=0)[["t", "cell", "i", "j", "group", "tile", "vector"]].sort_values(["t", "cell"])
    found = next(V._met(5, (0.97, 0.9))(iter([rows])))
    got = {tuple(sorted((int(a), int(b)))) for a, b in zip(found["group"], found["other"], strict=True)}
    assert bits == 5 and len(near) > 100 and len(got & near) / len(near) >= 0.95
    assert np.abs(V.large(V.small(x)) - x).max() < 1e-5


def test_a_cell_of_most_vectors_is_cut(spark):
    r = np.random.default_rng(6)
    centre = r.standard_normal(60)
    rows = [(f"h{i:03}", [float(v) for v in centre + 0.1 * r.standard_normal(60)]) for i in range(300)]
    df = spark.createDataFrame(rows, "track_id string, contour array<double>")
    whole, cut = ({(x["id"], x["other"]) for x in V.neighbours(df, "track_id", "contour", length=60, floor=0.9, block=b).collect()} for b in (8192, 50))
    assert len(whole) == 1500 and len(whole & cut) / 1500 > 0.95
