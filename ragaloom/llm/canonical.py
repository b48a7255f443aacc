"""Free-entered values mapped to the entries of a reference list."""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragaloom.operators.skew import attach
from ragaloom.session import Written

# Words that people write around the name of a raga.
AROUND = frozenset("raga ragam ragas raag raagam rag rtp alapana alapanai in main live contd incomplete short half tanam pallavi".split())
BRACKETS = regex.compile(r"\([^()]*\)|\[[^\[\]]*\]")
SEPARATOR = regex.compile(r"[/,:;|]|\s[-–—]+\s")
WORD = regex.compile(r"[^\W\d_]+")
#: Edits for each letter of a name that still leave its meaning clear, and entries in a shard of the reference list.
EDITS_PER_LETTER = 0.3
SHARD = 20_000


def fold(text: str) -> str:
    """Lower case without diacritics; the sibilants that are romanised as sh come out so."""
    marked = ud.normalize("NFC", text).casefold().replace("ś", "sh").replace("ṣ", "sh")
    return "".join(c for c in ud.normalize("NFKD", marked) if not ud.combining(c))


def spellings(word: str) -> set[str]:
    """Ways to read doubled letters: a long vowel written twice, or a letter typed twice."""
    out = set()
    for ee, oo in (("i", "u"), ("i", "o"), ("e", "u"), ("e", "o")):
        plain = word.replace("ee", ee).replace("oo", oo)
        out.add(regex.sub(r"(.)\1+", r"\1", plain))
    return out


def readings(value: str) -> set[str]:
    """The names a value may hold: the whole and its delimited parts, without brackets and the words around a name."""
    text = BRACKETS.sub(" ", fold(value))
    out = set()
    for part in {text, *SEPARATOR.split(text)}:
        words = [w for w in WORD.findall(part) if w not in AROUND]
        if words and sum(map(len, words)) > 2:
            out |= spellings("".join(words))
    return out


def levenshtein(a: str, b: str, most: int) -> int:
    """Edits from a to b, by bit vectors; anything above ``most`` may come out as ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = mask, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(d | plus) & mask, plus & d
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = up << 1 | 1
        plus, minus = (down << 1 | ~(d | up)) & mask, up & d & mask
    return score


class Tree:
    """A BK-tree: children of a node by their distance from it. A query skips what the triangle inequality rules out."""

    def __init__(self, entries: list[tuple[str, int]]) -> None:
        self.ids: dict[str, set[int]] = {}
        self.root: str | None = None
        self.children: dict[str, dict[int, str]] = {}
        for word, entry in entries:
            self.add(word, entry)

    def add(self, word: str, entry: int) -> None:
        if word in self.ids:
            self.ids[word].add(entry)
            return
        self.ids[word], self.children[word] = {entry}, {}
        if self.root is None:
            self.root = word
            return
        node = self.root
        while (d := levenshtein(node, word, len(node) + len(word))) in self.children[node]:
            node = self.children[node][d]
        self.children[node][d] = word

    def within(self, word: str, most: int) -> list[tuple[int, str]]:
        """Every word of the tree within ``most`` edits, with its distance."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            d = levenshtein(node, word, len(node) + len(word))
            if d <= most:
                out.append((d, node))
            stack += [child for edge, child in self.children[node].items() if d - most <= edge <= d + most]
        return out


def damerau(a: str, b: str) -> int:
    """Edits from a to b where swapping neighbours is one edit."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return rows[-1][-1]


def entry_words(name: str) -> set[str]:
    """What an entry is known by: its names (``A/B`` is one entry with two), as read from typed values."""
    return {s for part in name.split("/") if (joined := "".join(WORD.findall(fold(part)))) for s in spellings(joined)}


def reach(word: str) -> int:
    """Plain edits within which every name lies that is near enough: a name is at most as much longer as the edits allow,
    and a swap is two plain edits."""
    return 2 * int(EDITS_PER_LETTER * len(word) / (1 - EDITS_PER_LETTER) + 1e-9)


def closest(tree: Tree, value: str) -> list[tuple[float, int, int]]:
    """(edits for each letter, edits, entry) of the entries nearest to a reading of the value and near enough."""
    best: list[tuple[float, int, int]] = []
    for word in readings(value):
        for d, name in tree.within(word, reach(word)):
            most = EDITS_PER_LETTER * max(len(name), len(word))
            if d <= 2 * most and (edits := damerau(word, name)) <= most:
                best += [(edits / len(name), d, e) for e in tree.ids[name]]
    return best


def resolved(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(value, entry_id) for each distinct value; 0 if it means none of ``reference`` (entry_id int, entry_name).

    The reference is cut into shards of SHARD entries; each builds a BK-tree under plain edit distance, which is a true
    metric, and asks it for twice the edits that are accepted, since a swap of neighbours counts once in the end and
    twice in the tree. So all entries within the threshold are found, and the shards' winners merge to the one with the fewest edits a letter, then the fewest
    plain edits, then the smallest id. Values that equal an entry's name as stored mean that entry. Null values are left
    out; blank ones mean none.
    """
    held = Written(reference.dropna().select(F.col(reference.columns[0]).cast("int").alias("entry_id"), F.col(reference.columns[1]).alias("entry_name")), "reference")
    shards = max(1, -(-held.df.count() // SHARD))
    wanted = Written(values.toDF("value").dropna().distinct(), "values")
    spark, out = values.sparkSession, None
    for shard in range(shards):
        entries = [(r[0], r[1]) for r in held.df.filter(F.pmod(F.col("entry_id"), F.lit(shards)) == shard).collect()]
        shared = spark.sparkContext.broadcast(entries)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            exact: dict[str, int] = {}
            for entry, name in shared.value:
                exact[name] = min(entry, exact.get(name, entry))
            tree = Tree([(w, e) for e, name in shared.value for w in sorted(entry_words(name))])
            for batch in batches:
                rows = []
                for value in batch["value"]:
                    near = [(-1.0, 0, exact[value])] if value in exact else closest(tree, value)
                    rows.append((value, *(min(near) if near else (9.0, 99, 0))))
                yield pd.DataFrame(rows, columns=["value", "rate", "edits", "entry_id"])

        spread = wanted.df.repartition(max(1, min(512, wanted.df.rdd.getNumPartitions() * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))))
        one = spread.mapInPandas(run, "value string, rate double, edits int, entry_id int")
        out = one if out is None else out.unionByName(one)
    if shards == 1:
        return out.select("value", "entry_id")
    return out.groupBy("value").agg(F.min(F.struct("rate", "edits", "entry_id")).alias("best")).select("value", F.col("best.entry_id").alias("entry_id"))


def mapped(rows: DataFrame, column: str, means: DataFrame) -> DataFrame:
    """Each row's id and value with the entry the value means; null values get null."""
    return attach(rows.select("row_id", F.col(column).alias("value")), means, ["value"])
