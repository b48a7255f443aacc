"""Scores for abusive, hateful and sexual content by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragaloom.operators.skew import attach
from ragaloom.session import Written

#: Hashed features, factors, words of a window and the step between windows of a sentence longer than that.
BUCKETS, FACTORS, WINDOW, STRIDE = 1 << 20, 4, 20, 10
#: Labelled documents that the model is fitted on, at most, and their characters; whole documents, chosen by hash.
MOST_LABELLED, MOST_CHARS = 20_000, 20_000_000
#: Windows of clean documents that a fit reads, about; chosen at random and weighted up to all of them. Those that look abusive are all read.
CLEAN_WINDOWS = 40_000
#: Labelled documents in which a feature must occur to tell anything.
LEAST_DOCUMENTS = 3
#: Part of the clean documents that may be labelled abusive, and of the abusive ones that may be labelled clean.
WRONG_ABUSIVE, WRONG_CLEAN = 0.02, 0.05
#: Parts of the labelled documents, each scored by a machine fitted on the others, and how often that is done.
FOLDS, ROUNDS = 3, 3
#: A document is a case from this score on.
CASE = 0.5
#: The character that marks a sentence's end among the words of a text.
STOP = "\n"

_LETTER, _MORE = "a-zß-ɏḀ-ỿ", "*@$'’"
TOKEN = re.compile(rf"[0-9$@]?[{_LETTER}][{_LETTER}0-9{_MORE}]*(?:![{_LETTER}][{_LETTER}0-9{_MORE}]*)*|[.!?]+(?=[\s\"'”’)]|$)|\n")
ELONGATED = re.compile(r"(.)\1\1+")
DIGITS = str.maketrans("013457@$!", "oieastasi")


def plain(word: str) -> str:
    """A word without the marks that hide it: drawn-out letters, digits for letters. Of a masked one its ends are left."""
    word = ELONGATED.sub(r"\1", word)
    if "*" in word:
        return word[:1].translate(DIGITS) + "*" + word[-1:]
    return word.translate(DIGITS).strip("'’")


def _hash(text: str) -> int:
    return zlib.crc32(text.encode())


class Reader:
    """Turns texts into windows of hashed terms. Words are looked up once for each task."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {STOP: 0}
        self.word, self.letter = [0], [""]

    def number(self, token: str) -> int:
        """The token's number in this reader; 0 for a sentence's end."""
        if token[0] in ".!?":
            return 0
        word = plain(token)
        n = self.known.get("=" + word)
        if n is None:
            n = self.known["=" + word] = len(self.word)
            self.word.append(_hash(word) or 1)
            self.letter.append(word if len(word) == 1 else "")
        if len(self.known) < 2_000_000:
            self.known[token] = n
        return n

    def together(self, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters set apart, three or more in a row, as the word they make up."""
        alone = np.array([x != "" for x in self.letter])[at]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], alone, [False]]).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        keep = np.ones(len(at), bool)
        for a, b in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist(), strict=True):
            at[a] = self.number("".join(self.letter[n] for n in at[a:b].tolist()))
            keep[a + 1 : b] = False
        return at[keep], np.concatenate([[0], np.cumsum(keep)])[ends]

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms, pairs, windows, documents): the hashed word at each place, the hashed pair of it and the next, the
        places where windows begin and end, and the document of each window."""
        known, number, numbers, ends = self.known, self.number, [0], []
        for text in texts:
            for token in TOKEN.findall(text.lower()) if text else ():
                n = known.get(token)
                numbers.append(number(token) if n is None else n)
            numbers.append(0)
            ends.append(len(numbers))
        at, stop = self.together(np.asarray(numbers, np.int64), np.asarray(ends, np.int64))
        hashes = np.asarray(self.word, np.int64)[at]
        terms = hashes % BUCKETS
        pairs = (hashes * 31 + np.append(hashes[1:], 0) * 1_000_003) % BUCKETS
        stops = np.flatnonzero(at == 0)
        begin, end = stops[:-1] + 1, stops[1:]
        begin, end = begin[end > begin], end[end > begin]
        steps = np.maximum(1, -(-(end - begin - WINDOW) // STRIDE) + 1)
        first = np.repeat(begin, steps) + STRIDE * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps))
        windows = np.stack([first, np.minimum(first + WINDOW, np.repeat(end, steps))], axis=1)
        return terms, pairs, windows, np.searchsorted(stop, windows[:, 0], "right")


def _probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


class Machine:
    """A factorization machine: a weight for each feature, and for each two the product of their factors.

    Row 0 is for all features that the fit didn't know; it is 0 and stays so.
    """

    def __init__(self, features: np.ndarray | None = None, seed: int = 5) -> None:
        features = np.zeros(0, np.int64) if features is None else features
        self.bias, n = -4.0, len(features) + 1
        self.row = np.zeros(BUCKETS, np.int32)
        self.row[features] = np.arange(1, n)
        self.weight = np.zeros(n, np.float32)
        self.factor = (np.random.default_rng(seed).standard_normal((n, FACTORS)) * 0.02).astype(np.float32)
        self.factor[0] = 0

    def _summed(self, spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """The probability for bags of features, given as spans (rows, begins, ends) whose sums a bag adds up."""
        n = len(spans[0][1])
        line, apart, both = np.full(n, self.bias), np.zeros(n), np.zeros((n, FACTORS))
        square = (self.factor**2).sum(1)
        for rows, begin, end in spans:
            for out, values in ((line, self.weight), (apart, square), *((both[:, f], self.factor[:, f]) for f in range(FACTORS))):
                sums = np.concatenate([[0.0], np.cumsum(values[rows], dtype=np.float64)])
                out += sums[end] - sums[begin]
        return _probability(line + 0.5 * ((both**2).sum(1) - apart))

    def scores(self, terms: np.ndarray, pairs: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """The probability of abuse for each window, from sums over the places of the text."""
        if not len(windows):
            return np.zeros(0)
        begin, end = windows[:, 0], windows[:, 1]
        return self._summed([(self.row[terms], begin, end), (self.row[pairs], begin, end - 1)])

    def fit(self, bags: Bags, pick: np.ndarray, target: np.ndarray, importance: np.ndarray, epochs: int = 4, rate: float = 0.3, seed: int = 3) -> Machine:
        """Logistic loss towards the targets (0 to 1) by AdaGrad over shuffled batches; the seed makes it repeatable.

        The sums of squares start at 1, so that a feature of a few windows takes small steps and isn't memorised.
        """
        grown_w, grown_v = np.ones(len(self.weight), np.float32), np.ones(self.factor.shape, np.float32)
        order, draw, grown_b = np.arange(len(pick)), np.random.default_rng(seed), 1e-2
        for _ in range(epochs):
            draw.shuffle(order)
            for at in range(0, len(order), 512):
                some = order[at : at + 512]
                sizes = bags.size[pick[some]]
                starts = np.cumsum(sizes) - sizes
                ids = bags.rows[np.repeat(bags.start[pick[some]] - starts, sizes) + np.arange(sizes.sum())]
                v = self.factor[ids]
                total = np.add.reduceat(v, starts)
                score = self.bias + np.add.reduceat(self.weight[ids], starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), starts))
                error = ((_probability(score) - target[some]) * importance[some]).astype(np.float32)
                each = np.repeat(error, sizes)
                by_id = np.argsort(ids, kind="stable")
                sorted_ids = ids[by_id]
                first = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
                distinct = sorted_ids[first]
                gw = np.add.reduceat(each[by_id], first) + 1e-3 * self.weight[distinct]
                gv = np.add.reduceat((each[:, None] * (np.repeat(total, sizes, axis=0) - v))[by_id], first) + 2e-3 * self.factor[distinct]
                grown_w[distinct] += gw**2
                grown_v[distinct] += gv**2
                self.weight[distinct] -= rate * gw / np.sqrt(grown_w[distinct])
                self.factor[distinct] -= 0.3 * rate * gv / np.sqrt(grown_v[distinct])
                grown_b += float(error.sum()) ** 2
                self.bias -= rate * float(error.sum()) / grown_b**0.5
        return self


@dataclass
class Bags:
    """The known features of each window: ``rows[start : start + size]``."""

    rows: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def scores(self, machine: Machine, pick: np.ndarray) -> np.ndarray:
        """The machine's probability for the picked windows, over the features between them only."""
        start = self.start[pick]
        return machine._summed([(self.rows, start, start + self.size[pick])])


def _features(terms: np.ndarray, pairs: np.ndarray, windows: np.ndarray, docs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, Bags]:
    """The features of at least LEAST_DOCUMENTS documents, the logarithm of how much more often an abusive document has
    each (by row of the machine; 0 for row 0), and the bags."""
    words = windows[:, 1] - windows[:, 0]
    size = 2 * words - 1
    start = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(start, size)
    word = np.repeat(words, size)
    at = np.repeat(windows[:, 0], size) + place % word
    flat = np.where(place < word, terms[at], pairs[at])
    key = np.unique(np.repeat(docs, size) * np.int64(BUCKETS) + flat)
    in_bad, feature = labels[key // BUCKETS] > 0, key % BUCKETS
    seen, bad = np.bincount(feature, minlength=BUCKETS), np.bincount(feature[in_bad], minlength=BUCKETS)
    features = np.flatnonzero(seen >= LEAST_DOCUMENTS)
    n_bad = int((labels > 0).sum())
    n_clean = len(labels) - n_bad
    rare = 0.3 * n_clean / max(n_bad, 1) + 0.3
    odds = np.log((bad[features] + 0.3) / (n_bad + 1)) - np.log((seen[features] - bad[features] + rare) / (n_clean + 1))
    row = np.zeros(BUCKETS, np.int32)
    row[features] = np.arange(1, len(features) + 1)
    rows = row[flat]
    known = rows > 0
    upto = np.concatenate([[0], np.cumsum(known)])
    return features, np.append(0.0, odds), Bags(rows[known], upto[start], upto[start + size] - upto[start])


def _believed(p: np.ndarray, bad: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """How far each window is believed to be abusive, given its document's label, which may be wrong.

    A document is abusive if any of its windows is. The label of one whose windows are all unlikely to be is rather
    taken for wrong than one of them for abusive.
    """
    none = np.exp(np.bincount(docs, np.log1p(-np.clip(p, 0, 1 - 1e-6)), minlength=n))
    said_bad = WRONG_ABUSIVE * none + (1 - WRONG_CLEAN) * (1 - none)
    said_clean = (1 - WRONG_ABUSIVE) * none + WRONG_CLEAN * (1 - none)
    return np.clip(np.where(bad, p * (1 - WRONG_CLEAN) / said_bad[docs], p * WRONG_CLEAN / said_clean[docs]), 0, 1)


def threshold(best: np.ndarray, labels: np.ndarray) -> float:
    """The score between 0.3 and 0.6 from which on documents are told best: by F1 on scores of machines that didn't
    see them, with the wrong labels that are to be expected taken off the counts."""
    rightly = 1 - WRONG_ABUSIVE - WRONG_CLEAN
    cases = (labels.sum() - WRONG_ABUSIVE * len(labels)) / rightly

    def f1(t: float) -> float:
        found = best >= t
        return 2 * (labels[found].sum() - WRONG_ABUSIVE * found.sum()) / rightly / max(found.sum() + cases, 1e-9)

    return max((0.5, 0.45, 0.4, 0.35, 0.3, 0.55, 0.6), key=f1)


def train(texts: list[str | None], labels: np.ndarray) -> Machine:
    """Fits the machine on labelled documents, of which only a sentence may be abusive, and whose labels may be wrong.

    At first a window is believed abusive by how much more often its features occur in abusive documents. Then, ROUNDS
    times, the documents are cut into FOLDS parts, the windows of each part are scored by a machine fitted on the
    others, and what is believed of them follows from these scores and the labels: a machine can't confirm what it
    memorised. The last machine is fitted on all, and its bias moved so that the best threshold on the scores of the
    last round comes to CASE. Without abusive or clean documents all scores are the low bias of an unfitted machine.
    """
    labels = np.asarray(labels, np.float64)
    terms, pairs, windows, docs = Reader().read(texts)
    bad, n = labels[docs] > 0, len(labels)
    if not bad.any() or bad.all():
        return Machine()
    features, odds, bags = _features(terms, pairs, windows, docs, labels)
    if not len(features):
        return Machine()
    sums = np.concatenate([[0.0], np.cumsum(np.maximum(odds[bags.rows], 0))])
    telling = (sums[bags.start + bags.size] - sums[bags.start]) / np.sqrt(np.maximum(bags.size, 1))
    p = 0.5 * _probability(2 * (telling - np.quantile(telling[~bad], 0.98)))
    fold = np.random.default_rng(2).integers(0, FOLDS, n)[docs]
    told, clean = bags.size > 0, np.flatnonzero(~bad & (bags.size > 0))
    part = min(1.0, CLEAN_WINDOWS / max(len(clean), 1))
    sample = clean[np.random.default_rng(1).random(len(clean)) < part]

    def fitted(use: np.ndarray) -> Machine:
        certain = told & (bad | (p > 0.05))
        pick = np.union1d(sample, np.flatnonzero(certain))
        pick = pick[use[pick]]
        return Machine(features).fit(bags, pick, believed[pick], np.where(certain[pick], 1.0, 1 / part))

    for _ in range(ROUNDS):
        believed, after = _believed(p, bad, docs, n), np.zeros(len(windows))
        for side in range(FOLDS):
            after[fold == side] = bags.scores(fitted(fold != side), np.flatnonzero(fold == side))
        p = after
    believed = _believed(p, bad, docs, n)
    machine = fitted(np.ones(len(windows), bool))
    t = threshold(_best(p, docs, n), labels)
    machine.bias += float(np.log(CASE / (1 - CASE)) - np.log(t / (1 - t)))
    return machine


def _best(score: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """The highest score of each document's windows; 0 for one without windows."""
    best = np.zeros(n)
    np.maximum.at(best, docs, score)
    return best


def document_scores(machine: Machine, reader: Reader, texts: list[str | None]) -> np.ndarray:
    """The highest score of a text's windows; 0 for a text without any word."""
    *read, docs = reader.read(texts)
    return _best(machine.scores(*read), docs, len(texts))


def fitted(documents: DataFrame, labels: DataFrame) -> Machine:
    """A machine fitted on at most MOST_LABELLED labelled documents of MOST_CHARS characters in all, chosen by a hash of the id."""
    held = Written(labels.filter("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.max("abusive").alias("abusive")), "labels").df
    if held.count() > MOST_LABELLED:
        held = Written(held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED), "labels").df
    told = Written(attach(documents.select("doc_id", "text"), held, ["doc_id"], "inner"), "told").df
    sizes = told.select("doc_id", F.xxhash64("doc_id").alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).toPandas().sort_values(["h", "doc_id"])
    chosen = sizes.loc[sizes["n"].cumsum() <= MOST_CHARS, "doc_id"].tolist()
    if len(chosen) < len(sizes):
        spark = documents.sparkSession
        told = told.join(F.broadcast(spark.createDataFrame([(int(i),) for i in chosen], "doc_id bigint")), "doc_id", "left_semi")
    rows = told.toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), rows["abusive"].to_numpy())


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score) for every document: the probability that it is abusive, hateful or sexual.

    Texts are read as windows of words within sentences; a text's score is that of its worst window, so that length
    doesn't hide a sentence. Null, empty texts and texts without a word in Latin letters score 0. The machine is
    fitted on the labelled documents, broadcast (its size is fixed), and applied without a shuffle.
    """
    machine = documents.sparkSession.sparkContext.broadcast(fitted(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = document_scores(machine.value, reader, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores)], names=["doc_id", "source", "score"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, score double")


def rates(scores: DataFrame) -> DataFrame:
    """For each source its documents, those scored as cases, and their rate."""
    case = (F.col("score") >= CASE).cast("long")
    return scores.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(case).alias("n_cases"), F.round(F.avg(case), 6).alias("rate"), F.round(F.avg("score"), 4).alias("mean_score"))

