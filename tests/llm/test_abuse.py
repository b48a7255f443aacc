import random

import numpy as np

from ragaloom.llm import abuse as A


def corpus(n=500, seed=1):
    r = random.Random(seed)
    calm = ["the alapana was lovely tonight", "which raga is this please", "i disagree, the violin was dull", "my idiot phone cut off the swara", "the demon is killed in the last verse", "somebody called me a moron and was banned"]
    rude = ["you are a filthy moron", "all zedaris are vermin and should be shot", "i will smash your face", "shut your stupid mouth you pig"]
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        parts = [r.choice(calm) for _ in range(r.randrange(1, 9))] + ([r.choice(rude)] if bad else [])
        r.shuffle(parts)
        texts.append(". ".join(parts) + ".")
        labels.append(int(bad))
    return texts, np.array(labels)


def test_plain_words():
    assert [A.plain(x) for x in ("piiiig", "cr3tin", "du**b", "don't", "5tup!d")] == ["pig", "cretin", "d*b", "don't", "stupid"]
    assert A.TOKEN.findall("5low you 5tup!d d0g! 45 w h.") == ["5low", "you", "5tup!d", "d0g", "!", "w", "h", "."]


def test_letters_set_apart_make_a_word():
    read = A.Reader()
    plain, apart = read.read(["you fucking old worm. no", "a b"]), read.read(["you f.u.c.k.i.n.g old w o r m. no", "a b"])
    assert all((x == y).all() for x, y in zip(plain, apart, strict=True))


def test_held_out_accuracy_and_wrong_labels():
    texts, labels = corpus()
    wrong = labels.copy()
    wrong[[1, 50, 99, 150, 203]] ^= 1
    machine = A.train(texts, wrong)
    other, truth = corpus(300, 9)
    said = A.document_scores(machine, A.Reader(), other) >= A.CASE
    assert (said == truth.astype(bool)).mean() > 0.97


def test_harmless_sentences_beside_wrong_labels_stay_harmless():
    texts, labels = corpus(1500)
    wrong = labels.copy()
    flip = np.random.default_rng(4).random(len(labels)) < 0.02
    wrong[flip] ^= 1
    machine = A.train(texts, wrong)
    calm = ["my idiot phone cut off the swara", "somebody called me a moron and was banned", "the demon is killed in the last verse"]
    assert A.document_scores(machine, A.Reader(), calm).max() < A.CASE
    said = A.document_scores(machine, A.Reader(), texts) >= A.CASE
    assert (said[flip] == labels[flip].astype(bool)).mean() > 0.9


def test_threshold_takes_wrong_labels_off():
    best, labels = np.array([0.9] * 40 + [0.42] * 40 + [0.1] * 920), np.array([1] * 80 + [0] * 920)
    labels[[100, 300, 500, 700, 900]] = 1
    assert A.threshold(best, labels) in (0.3, 0.35, 0.4)
    assert A.threshold(np.zeros(3), np.zeros(3)) == 0.5


def test_a_long_text_hides_nothing_and_edges():
    machine = A.train(*corpus())
    long = "the alapana was lovely tonight. " * 20_000 + "you are a filthy moron."
    scores = A.document_scores(machine, A.Reader(), [long, None, "", "లే", "you are a filthy moron"])
    assert scores[0] >= A.CASE and scores[4] >= A.CASE and list(scores[1:4]) == [0, 0, 0]
    assert A.document_scores(A.train([], np.zeros(0)), A.Reader(), ["you pig"])[0] < A.CASE
    assert A.document_scores(A.train(["x", None], np.zeros(2)), A.Reader(), ["you pig"])[0] < A.CASE


def test_table(spark):
    texts, labels = corpus(200)
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, source string, score double")
    told = spark.createDataFrame([(i, int(x)) for i, x in enumerate(labels)] + [(None, 1), (3, None)], "doc_id long, abusive int")
    scores = A.scored(docs, told)
    assert scores.count() == 202 and A.rates(scores).collect()[0]["n_docs"] == 202
    assert A.scored(docs.limit(0), told).collect() == []
