import random

import pytest

from ragaloom.llm import names as N

PERSON = ["Lobibhothi Julosopuba", "Julosopuba, Lobibhothi", "Lobibhothi Julo Sopuba", "Vidushi L. Julosopuba", "LOBIBHOTHI  JULOSOPUBA", "Julosopuba L.", "Lobbibhothi Julosopuba", "Lobi Julosopuba"]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("Dherun Ludhunokiga", "L. Dherun Dhupadhagubhe", None),
        ("Yiruva Nigutivehi", "S. Yiruva Nigutivehi", N.PART),
        ("Toreyo Dhodivuhara", "T. Bhido Dhodivuhara", None),
        ("N. Bechejuyama", "M. Nububhun Bechejuyama", N.INITIAL),
        ("Borodha Bechejuyama", "Nububhun Bechejuyama", None),
    ],
)
def test_relations(a, b, want):
    assert N.relation(N.tokens(a, {}), N.tokens(b, {})) == N.relation(N.tokens(b, {}), N.tokens(a, {})) == want


def test_jaro_winkler():
    assert abs(N.jaro_winkler("martha", "marhta") - 0.9611) < 1e-3
    assert N.jaro_winkler("abc", "xyz") == 0 and N.jaro_winkler("same", "same") == 1


@pytest.mark.parametrize("tile", [400, 2])
def test_persons(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE", tile)
    others = ["Lobibhothi Vekubadepe", "Dudepothi Nebhutonichi", "A B & C D", "", None, "K. Zed", "Kal Zed", "Kim Zed", "..."]
    df = spark.createDataFrame([("artist", n) for n in [*PERSON, *others, PERSON[0]]] + [("composer", PERSON[0])], "role string, name string")
    nick = spark.createDataFrame([("Lobi", "Lobibhothi"), (None, "x")], "nickname string, given_name string")
    found = N.persons(df, nick).collect()
    by = {(r["role"], r["name"]): r["person"] for r in found}
    assert len({by["artist", n] for n in PERSON}) == 1
    assert len(by) == len(found) == len(PERSON) + 6 + 1
    assert len({by["artist", n] for n in ("K. Zed", "Kal Zed", "Kim Zed")}) == 3
    pairs = N.pairs(N.persons(df, nick)).collect()
    assert len(pairs) == len(PERSON) * (len(PERSON) - 1) // 2 and all(r["name_a"] < r["name_b"] for r in pairs)
    assert N.persons(df.limit(0), nick).collect() == []


def test_persons_are_judged_again_after_merges(spark):
    one = ["Yiruva Bhorotishoku", "Bhorotishoku, B. Yiruva", "Bachagu Yiruva Bhorotishoku", "Y. Bhorotishoku"]
    others = ["K. Zed", "Kal Zed", "Kim Zed"]
    df = spark.createDataFrame([("artist", n) for n in [*one, *others]], "role string, name string")
    by = {r["name"]: r["person"] for r in N.persons(df, spark.createDataFrame([], "nickname string, given_name string")).collect()}
    assert len({by[n] for n in one}) == 1 and len({by[n] for n in others}) == 3 and len(set(by.values())) == 4


@pytest.mark.parametrize(("a", "b", "want"), [("Nububhun Dhitholuvepu", "Nbubhun Dhitholuvepu", True), ("Thunomuvugu Shamiri", "Shamiri Thenomuvugu", True), ("Kal Zedoru", "Kim Zedoru", False), ("Talo Zedoru", "Tilo Zedoru", False)])
def test_one_edit_in_a_long_word(a, b, want):
    assert (N.relation(N.tokens(a, {}), N.tokens(b, {})) == N.SAME) == want


def test_large_blocks_lose_no_link(spark, monkeypatch):
    r = random.Random(3)
    sound = lambda n: "".join(r.choice("bdgjklmnprst") + r.choice("aeiou") for _ in range(n))
    last = [sound(4) for _ in range(3)]
    first = [x[0] + sound(3) for x in ("k", "k", "m") for _ in range(25)]

    def typed(w):
        i = r.randrange(1, len(w))
        return r.choice([w, w, w[:i] + w[i + 1 :], w[:i] + r.choice("aeioun") + w[i:], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :]])

    forms = {" ".join(x) for f in first for w in last for x in ((typed(f), typed(w)), (f[0], w), (typed(f), r.choice(first)[0], w))}
    df = spark.createDataFrame([("artist", f) for f in sorted(forms)] + [("composer", f) for f in sorted(forms)[:9]], "role string, form string")
    whole = {tuple(x) for x in N.links(df).collect()}
    monkeypatch.setattr(N, "TILE", 12)
    assert {tuple(x) for x in N.links(df).collect()} == whole and len(whole) > 500


def test_shortened_words_meet():
    for a, b in (("rama", "ramma"), ("nububhun", "nbubhun"), ("thunomuvugu", "thenomuvguu"), ("abcdefg", "abcdef"), ("kola", "kloa")):
        assert N.shortened(a) & N.shortened(b)
