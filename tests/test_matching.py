import numpy as np
import pytest

from ragaloom.kernels import nearest
from ragaloom.operators import match


def brute(ids, queries, names, contours, top, exclude_self=False):
    out = set()
    for x, q in zip(ids, queries, strict=True):
        found = [(round(float(np.sqrt(((q - c) ** 2).sum())), 9), name) for name, c in zip(names, contours, strict=True) if np.isfinite(c).all() and not (exclude_self and name == x)]
        out |= {(x, name, d) for d, name in sorted(found)[:top]} if np.isfinite(q).all() else set()
    return out


def matched(ids, queries, names, contours, top, exclude_self=False, bound=0):
    asked = nearest.Asked(np.array(ids, object), queries, top, exclude_self)
    asked.bound(np.array(names[:bound], object), contours[:bound])
    best = nearest.Nearest(asked)
    best.add(np.array(names, object), contours)
    return set(zip(asked.ids[best.query], best.ids, best.distance.tolist(), strict=True)), asked


@pytest.mark.parametrize("kind", ["smooth", "wide", "sizes", "equal"])
def test_screening_loses_nothing(kind, monkeypatch):
    monkeypatch.setattr(nearest, "BATCH", 64)
    r = np.random.default_rng(5)
    q, c = r.normal(size=(60, 100)), r.normal(size=(500, 100))
    if kind == "smooth":  # queries in few directions, contours in many
        q = np.stack([np.interp(np.linspace(0, 19, 100), np.arange(20), x[:20]) for x in q])
        c[::7] = q[r.integers(0, 60, len(c[::7]))] + r.normal(size=c[::7].shape) / 50
    if kind == "sizes":  # lengths of many magnitudes
        q, c = q * 10.0 ** r.integers(-6, 7, (60, 1)), c * 10.0 ** r.integers(-6, 7, (500, 1))
    if kind == "equal":  # each contour many times, and a query's own
        c = np.repeat(np.concatenate([c[:20], q[:5]]), 20, axis=0)
    ids, names = [f"n{i}" for i in range(60)], [f"n{i}" for i in r.permutation(500)]
    for top, own, bound in ((3, False, 0), (3, False, 100), (1, True, 100), (7, True, 0)):
        got, asked = matched(ids, q, names, c, top, own, bound)
        want = brute(ids, q, names, c, top, own)
        assert {x[:2] for x in got} == {x[:2] for x in want} and np.allclose(sorted(x[2] for x in got), sorted(x[2] for x in want), rtol=1e-9)
    if kind == "smooth":
        assert asked.directions.shape[1] < 25
        rows, _ = asked.within(c, asked.worst)
        assert len(rows) == 60 * 500  # nothing is known yet
        asked.bound(np.array(names, object), c)
        assert len(asked.within(c, asked.worst)[0]) < 60 * 100


def test_contours_that_match_nothing():
    q, c = np.eye(4), np.eye(4).repeat(2, axis=0)
    q[1, 2], c[0, 0], c[7, 1] = np.nan, np.inf, np.nan
    got, _ = matched(list("abcd"), q, list("klmnopqr"), c, 2)
    assert got == brute(list("abcd"), q, list("klmnopqr"), c, 2) and len(got) == 6
    assert matched(list("abcd"), q, [], np.zeros((0, 4)), 2)[0] == set()
    assert matched([], np.zeros((0, 4)), list("klmnopqr"), c, 2)[0] == set()
    z, kept = nearest.standardised(np.array([[5.0, 5, 5], [1, 2, 3], [0.1, 0.1, 0.1]]))
    assert kept.tolist() == [False, True, False] and np.allclose(z, [[-(1.5**0.5), 0, 1.5**0.5]])


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_no_contour_is_shuffled(spark):
    """What is shuffled doesn't follow the blocks; d12_matches ran out of disk by it."""
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 500))
    rows = [(f"t{i}", v.tolist()) for i, v in enumerate(x)]
    before = shuffled(spark)
    c = spark.createDataFrame(rows, "track_id string, contour array<double>")
    got = match.top_matches(c, c, 3, block=6).collect()
    assert {(g["query_id"], g["track_id"]) for g in got} == {z[:2] for z in brute([f"t{i}" for i in range(60)], x, [f"t{i}" for i in range(60)], x, 3)}
    assert all(g["similarity"] == 1 for g in got if g["rank"] == 1)
    assert shuffled(spark) - before < x.nbytes


def test_raw_catalog_is_written_as_it_came(spark):
    """Float contours are standardised where they are compared, and written in their own type."""
    r = np.random.default_rng(3)
    x = r.normal(300, 200, (30, 50)).astype(np.float32)
    x[3], x[4, 7] = 12, np.nan
    names = [f"t{i:02d}" for i in range(30)]
    held = spark.createDataFrame([*zip(names, x.tolist(), strict=True), ("none", None), ("gap", [None, *x[0, 1:].tolist()])], "track_id string, contour array<float>")
    q = r.normal(size=(9, 50))
    q = (q - q.mean(1, keepdims=True)) / q.std(1, keepdims=True)
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "track_id string, contour array<double>")
    got = match.top_matches(asked, held, 2, 50, block=4, raw=True)
    fine = [i for i in range(30) if i not in (3, 4)]
    z = x[fine].astype(np.float64)
    z = (z - z.mean(1, keepdims=True)) / z.std(1, keepdims=True)
    assert {(g["query_id"], g["track_id"]) for g in got.collect()} == {w[:2] for w in brute([f"q{i}" for i in range(9)], q, [names[i] for i in fine], z, 2)}
    kinds = [spark.read.parquet(w).dtypes for w in spark._ragaloom_tables if "/side-" in w]
    assert ("contour", "array<float>") in kinds[-2]
    assert match.top_matches(asked.limit(0), held, 2, 50, raw=True).count() == 0 and match.top_matches(asked, held.limit(0), 2, 50, raw=True).count() == 0
    short = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "track_id string, contour array<double>")
    with pytest.raises(ValueError, match="different lengths"):
        match.top_matches(short, short, 1)
