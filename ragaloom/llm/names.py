"""Spellings of one person's name, linked."""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragaloom.llm.batches import runs
from ragaloom.llm.canonical import damerau
from ragaloom.llm.components import components
from ragaloom.operators.skew import attach
from ragaloom.session import written

# Titles before a name.
TITLES = frozenset("sri shri smt pt pandit ustad prof professor dr vidushi vidwan vid mr mrs ms kum".split())
SEVERAL = r"[&/+;]|\s(?:and|with|feat)\s"
WORD = regex.compile(r"[^\W\d_]+")
#: Names of one block that meet in a task, about; a larger block is cut (see ``links``).
TILE = 400
SAME, PART, INITIAL = 0, 1, 2


def squeeze(word: str) -> str:
    """Long vowels and doubled letters written once."""
    return regex.sub(r"(.)\1+", r"\1", word.replace("ee", "i").replace("oo", "u"))


def tokens(name: str, nicknames: dict[str, str]) -> tuple[str, ...]:
    """The name's words in their natural order: no titles or diacritics, ``Last, First`` turned round, nicknames replaced."""
    text = "".join(c for c in ud.normalize("NFKD", name) if not ud.combining(c)).casefold()
    if text.count(",") == 1:
        last, _, first = text.partition(",")
        text = f"{first} {last}" if first.strip() else last
    words = [w for w in WORD.findall(text) if w not in TITLES]
    if len(words) > 1 and len(words[-1]) == 1 and len(words[0]) > 1:  # Last F.
        words = words[1:] + words[:1]
    return tuple(squeeze(nicknames.get(w, w)) for w in words)


def code(word: str) -> str:
    """A phonetic code: the consonants without aspiration, a letter written for a sound of its own kind."""
    letters = word.replace("h", "").translate(str.maketrans("wzqxf", "vjkkp"))
    return regex.sub(r"(.)\1+", r"\1", "".join(c for c in letters if c not in "aeiou")) or letters[:1] or word[:1]


def block_keys(words: tuple[str, ...]) -> set[str]:
    """Blocks of a name: codes of its words in sorted pairs, each word's code with another's first letter, and the code of all."""
    out = {"j" + code("".join(words)), "j" + code("".join(words[-1:] + words[:-1]))}
    for a, b in combinations(words, 2):
        if len(a) > 1 and len(b) > 1:
            out.add("p" + "|".join(sorted((code(a), code(b)))))
        for x, y in ((a, b), (b, a)):
            if len(x) > 1:
                out.add(f"i{code(x)}|{y[0]}")
    return out


def jaro_winkler(a: str, b: str) -> float:
    """Similarity from 0 to 1 by shared letters near their places, raised for a shared beginning."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    m, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + start * 0.1 * (1 - jaro)


def alike(a: str, b: str) -> bool:
    """Whether two words are spellings of one; one edit in a long word may lower their Jaro-Winkler value more, by shifting repeated letters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or (near := jaro_winkler(a, b)) < 0.82:
        return False
    least, edits = min(len(a), len(b)), damerau(a, b)
    return edits <= (1 if least < 7 else 2) and (near >= 0.88 or edits == 1 and least > 5)


def relation(a: tuple[str, ...], b: tuple[str, ...]) -> int | None:
    """SAME spelling of a name, PART if one has a word more, INITIAL if one has but an initial for a word; else None."""
    turned = {"".join(b), "".join(b[-1:] + b[:-1])}
    if "".join(a) in turned or "".join(a[-1:] + a[:-1]) in turned:
        return SAME
    if (whole := "".join(x for x in a if len(x) > 1)) == "".join(y for y in b if len(y) > 1) and whole:
        return PART
    left, right, full, last = list(a), list(b), 0, set()
    for x in a:
        if len(x) > 1 and (y := next((y for y in right if len(y) > 1 and alike(x, y)), None)):
            left.remove(x)
            right.remove(y)
            full += 1
            last |= {x, y}
    for x in [x for x in left if len(x) == 1 and x in right]:
        if x in right:
            left.remove(x)
            right.remove(x)
    equal = len(a) - len(left)
    short = 0
    for one, other in ((left, right), (right, left)):
        for x in [x for x in one if len(x) == 1]:
            if y := next((y for y in other if len(y) > 1 and y[0] == x), None):
                one.remove(x)
                other.remove(y)
                short += 1
                if any(len(z) > 1 for z in one):
                    return None  # the initial stands before another first name
    if not full or equal + short < 2 or left and right or any(n[-1] not in last for n in (a, b) if len(n) > 2 or min(map(len, n)) == 1):
        return None  # of names other than two plain words, whose order isn't known, the last word must agree
    if not left and not right and not short:
        return SAME
    return PART if full > 1 else INITIAL


def _less(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether a says less of the name than b."""
    return (sum(len(x) > 1 for x in a), len(a), sum(map(len, a)), b) < (sum(len(x) > 1 for x in b), len(b), sum(map(len, b)), a)


def shortened(word: str) -> set[str]:
    """The word with up to as many letters left out as edits are allowed of it: words that ``alike`` accepts share one."""
    out, last = {word}, {word}
    for _ in range(1 if len(word) < 7 else 2):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def finer_keys(block: str, words: tuple[str, ...]) -> set[str]:
    """Finer blocks of a name in the large block of a word's code and a first letter: by that letter's words, with letters
    left out. Names that give the letter alone aren't in any; they meet all names of the block."""
    first = block[-1]
    return {f"{block}~{short}" for w in words if len(w) > 1 and w[0] == first for short in shortened(w)}


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, seen = [], set()
    for (role, block, i, j), rows in runs(batches, ["role", "block", "i", "j"]):
        forms = [(r[4], tuple(r[4].split(" ")), r[5]) for r in rows]
        pairs = combinations(forms, 2)
        if block.endswith("!"):  # names with an initial, to each of which all names of the block come
            brief = [f for f in forms if block[-2] in f[1]]
            pairs = ((f, g) for n, f in enumerate(brief) for g in [*brief[n + 1 :], *(x for x in forms if block[-2] not in x[1])])
        for (fa, a, ta), (fb, b, tb) in pairs:
            if i != j and ta == tb or (role, fa, fb) in seen:
                continue
            if len(seen) < 500_000:
                seen.add((role, fa, fb))
            kind = relation(a, b)
            if kind is not None:
                out.append((role, *((fa, fb) if _less(a, b) else (fb, fa)), kind))
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=["role", "a", "b", "kind"])
            out = []
    yield pd.DataFrame(out, columns=["role", "a", "b", "kind"])


def _split(words: pd.Series) -> pd.Series:
    return words.map(lambda f: tuple(f.split(" ")))


def _keys(forms: pd.Series) -> pd.Series:
    return _split(forms).map(lambda w: sorted(block_keys(w)))


def _finer(blocks: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([sorted(finer_keys(b, w)) for b, w in zip(blocks, _split(forms), strict=True)], dtype=object)


def links(forms: DataFrame) -> DataFrame:
    """(role, a, b, kind) for each pair of forms that share a block and are related; a says less than b.

    A block of up to TILE forms is compared in one task. A larger one of a word's code and a first letter, as common
    last names have, is cut finer: names that write the word out meet where their words have a shortened form in common,
    as all that ``alike`` accepts do, so the work follows the number of names; names with the initial alone, of which
    there are only the spellings of one last name, meet all others, a tile of these at a time. Any other block that is
    still larger is cut into tiles by a hash of the form, and each pair of tiles is a task's work. No task gets more
    than about two tiles of a block, and no pair is lost.
    """
    keys = F.pandas_udf(_keys, "array<string>")
    blocks = written(forms.select("role", "form", F.explode(keys("form")).alias("block")), "blocks")
    large = blocks.groupBy("role", "block").agg(F.count("*").alias("n")).filter((F.col("n") > TILE) & F.col("block").startswith("i")).select("role", "block", F.ceil(F.col("n") / TILE).cast("int").alias("cut"))
    large = written(large, "large")
    if large.isEmpty():
        return _tiled(blocks)
    known = attach(blocks, large, ["role", "block"])
    inside = written(known.filter("cut is not null"), "inside")
    fine = inside.select("role", "form", F.explode(F.pandas_udf(_finer, "array<string>")("block", "form")).alias("block"))
    brief = F.array_contains(F.split("form", " "), F.substring(F.col("block"), -1, 1))
    parts = F.when(brief, F.sequence(F.lit(0), F.col("cut") - 1)).otherwise(F.array(F.pmod(F.xxhash64("form"), F.col("cut")).cast("int")))
    met = inside.select("role", F.concat("block", F.lit("!")).alias("block"), F.explode(parts).alias("i"), "form", F.lit(0).alias("tile")).select("role", "block", "i", F.col("i").alias("j"), "form", "tile")
    return _tiled(known.filter("cut is null").select("role", "form", "block").unionByName(fine)).unionByName(_related(met)).distinct()


def _tiled(blocks: DataFrame) -> DataFrame:
    """The related pairs of each block; large ones are cut into tiles that meet in pairs."""
    held = written(blocks, "cut")
    sizes = held.groupBy("role", "block").agg(F.count("*").alias("n")).filter("n > 1").select("role", "block", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    rows = attach(held, sizes, ["role", "block"], "inner").withColumn("tile", F.pmod(F.xxhash64("form"), F.col("tiles")).cast("int"))
    tiled = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("role", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "form", "tile")
    return _related(tiled)


def _related(met: DataFrame) -> DataFrame:
    parts = max(8, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.repartition(parts, "role", "block", "i", "j").sortWithinPartitions("role", "block", "i", "j", "form").mapInPandas(_compare, "role string, a string, b string, kind int").distinct()


def persons(values: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(role, name, person) for the distinct ``values`` (role, name): names of one person have one ``person``.

    Names are read as words (titles dropped, ``Last, First`` turned, nicknames replaced), blocked by phonetic codes of
    sorted words, compared word by word with Jaro-Winkler, and clustered by connected components. A name that leaves a
    word out, or gives an initial for it, joins a person only if it fits one person and no other; that is judged again
    after each merge, until none is left, names with a word left out first. Null, '' and credits
    of several performers take no part; a name without any letter stands alone. ``person`` is the person's smallest
    form, prefixed for names that stand alone. The nickname table must fit in memory (it is fetched whole).
    """
    known = {r[0].casefold(): r[1].casefold() for r in nicknames.dropna().collect() if r[0] and r[1]}
    alone = values.filter(F.expr("name <> ''") & ~F.lower("name").rlike(SEVERAL)).distinct()
    parse = F.pandas_udf(lambda names: names.map(lambda v: " ".join(tokens(v, known))), "string")
    named = written(alone.withColumn("form", parse("name")), "names")
    forms = named.select("role", "form").filter("form <> ''").distinct()
    found = written(links(forms), "links")
    node = lambda c: F.concat_ws("\x1f", "role", c)
    edges = found.select(node("a").alias("a"), node("b").alias("b"), "kind")
    nodes = forms.select(node("form").alias("node"))
    sure = components(edges.filter(F.col("kind") == SAME).select("a", "b"))
    label = written(attach(nodes, sure, ["node"]).select("node", F.coalesce("component", "node").alias("component")), "persons")
    step, kinds = 0, (PART, INITIAL)
    while step < len(kinds):
        weak = edges.filter(F.col("kind") == kinds[step]).select("a", "b")
        for side in ("a", "b"):
            weak = attach(weak, label.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), [side], "inner")
        weak = weak.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).filter("a <> b")
        sure = written(weak.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("last")).filter("b = last").select("a", "b"), "sure")
        if sure.isEmpty():
            step += 1
            continue
        merged = components(sure).select(F.col("node").alias("component"), F.col("component").alias("into"))
        label = written(attach(label, merged, ["component"]).select("node", F.coalesce("into", "component").alias("component")), "persons")
        step = 0  # two persons that a name fitted may be one now
    out = attach(named.select("role", "name", node("form").alias("node")), label, ["node"])
    return out.select("role", "name", F.when(F.col("node").endswith("\x1f"), F.concat(F.lit("!"), "name")).otherwise(F.coalesce("component", "node")).alias("person"))


def pairs(found: DataFrame) -> DataFrame:
    """(role, name_a, name_b) for each two names of a person, name_a < name_b; only persons of several names are joined."""
    several = found.groupBy("role", "person").agg(F.sort_array(F.collect_set("name")).alias("names")).filter(F.size("names") > 1)
    a = several.select("role", "names", F.posexplode("names").alias("i", "name_a"))
    return a.select("role", "name_a", F.explode(F.expr("slice(names, i + 2, size(names))")).alias("name_b"))
