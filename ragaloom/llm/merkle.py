"""Copies of records that differ in the formatting of a title only."""

from __future__ import annotations

import unicodedata as ud
from collections import Counter
from hashlib import blake2b

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragaloom.operators.skew import attach
from ragaloom.session import written

DELIMITER = regex.compile(r"\s*[|/;,]\s*|\s+[-–—]+\s+")
NO_LETTER = regex.compile(r"[^\p{L}\p{N}\p{M}]+")
BETWEEN = "\x1f"


def leaves(title: str) -> list[str]:
    """The normalised delimited parts: letters, digits and diacritics, composed and casefolded. Empty parts vanish."""
    return [p for x in DELIMITER.split(ud.normalize("NFC", title)) if (p := ud.normalize("NFC", NO_LETTER.sub("", x).casefold()))]


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def title_node(titles: pd.Series) -> pd.DataFrame:
    """``node``: the digest of the title's node, an unordered one: its parts' digests, sorted, digested. ``letters``: the
    digest of all its characters, sorted, by which titles meet whose delimiters can't be told from other marks.
    ``form``: the parts in their stored order."""
    forms = [leaves(t) for t in titles]
    return pd.DataFrame(
        {
            "node": [_digest(b"".join(sorted(_digest(p.encode()) for p in f))) for f in forms],
            "letters": [_digest("".join(sorted("".join(f))).encode()) for f in forms],
            "form": [BETWEEN.join(f) for f in forms],
        }
    )


def columns_node(df: DataFrame, columns: list[str]) -> Column:
    """The digest of a record's other columns: a leaf's digest is of the column's name and value (null is a value of its
    own; nested values are digested as written in JSON), and the node's of the leaves' digests, sorted."""
    leaf = []
    for name in columns:
        column = F.col(f"`{name}`")
        text = column.cast("string") if df.schema[name].dataType.typeName() in ("string", "long", "integer", "boolean") else F.to_json(F.struct(column))
        leaf.append(F.md5(F.concat(F.lit(f"{name}\x1f"), F.coalesce(F.concat(F.lit("="), text), F.lit("")))))
    return F.unhex(F.md5(F.concat_ws("", F.array_sort(F.array(*leaf)) if leaf else F.array().cast("array<string>"))))


def is_arrangement(parts: list[str], whole: str) -> bool:
    """Whether ``whole`` is the parts in some order. A part may be the start of another one, so places are tried."""
    left = Counter(parts)
    seen: set[tuple] = set()
    stack = [(0, tuple(sorted(left.items())))]
    while stack:
        at, have = stack.pop()
        if not have:
            if at == len(whole):
                return True
            continue
        if (at, have) in seen:
            continue
        seen.add((at, have))
        for part, n in have:
            if whole.startswith(part, at):
                stack.append((at + len(part), tuple((p, k - (p == part)) for p, k in have if k > (p == part))))
    return False


def classes(forms: list[str]) -> list[int]:
    """A class for each form: forms of the same parts are of one class, and so are forms of which one's parts, in some
    order, read as the other does. Whole texts are compared, not digests."""
    by_parts: dict[tuple[str, ...], set[str]] = {}
    for f in forms:
        by_parts.setdefault(tuple(sorted(f.split(BETWEEN))), set()).add(f.replace(BETWEEN, ""))
    parent = {p: p for p in by_parts}

    def root(p: tuple[str, ...]) -> tuple[str, ...]:
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        return p

    by_text: dict[str, tuple[str, ...]] = {}
    for parts, texts in by_parts.items():
        for text in texts:
            parent[root(by_text.setdefault(text, parts))] = root(parts)
    for parts in by_parts:
        if len(parts) > 1:
            for text, other in by_text.items():
                if root(other) != root(parts) and is_arrangement(list(parts), text):
                    parent[root(other)] = root(parts)
    names: dict[tuple[str, ...], int] = {}
    return [names.setdefault(root(tuple(sorted(f.split(BETWEEN)))), len(names)) for f in forms]


def _classes(groups: pd.Series) -> pd.Series:
    return pd.Series([classes(list(g)) for g in groups])


def copies(df: DataFrame, id_column: str, title: str, ignored: list[str]) -> DataFrame:
    """(first_row_id, copy_row_id) for every record but the first of its group of copies.

    Records are copies if their titles have the same letters, digits and diacritics but for white space, case,
    punctuation and the order of the delimited parts, and all columns but the id, the title and ``ignored`` are equal
    (null equals null). A record's digest is built bottom-up: digests of the title's normalised parts, sorted, give the
    title's node; digests of the other columns, sorted, give theirs; both nodes give the root. Rows of one root are
    copies. Since a mark of formatting may look like a delimiter, roots that agree in the columns' node and in the
    letters of the title are compared further: they are one group if the parts of one, in some order, read as the
    other. Every group is confirmed in full, its titles' parts as texts and its other columns as stored. A null title
    is no copy of anything; titles without any letter or digit are equal to each other. Characters of no width count as
    white space; composed and decomposed letters as the same.

    Exact copies are counted before anything is shuffled, so what meets in a task are the distinct forms of one title.
    The rows get their first's id by a join that holds for hot groups.
    """
    rest = [c for c in df.columns if c not in (id_column, title, *ignored)]
    named = df.select(F.col(id_column).alias("copy_row_id"), F.col(title).alias("title"), F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0)).alias("rest"), columns_node(df, rest).alias("columns")).filter("title is not null")
    read = F.pandas_udf(title_node, "node binary, letters binary, form string")(F.col("title"))
    join = lambda x: F.unhex(F.md5(F.concat(x, F.col("columns"))))
    hashed = named.withColumn("n", read).select("copy_row_id", join(F.col("n.letters")).alias("letters"), join(F.col("n.node")).alias("root"), F.col("n.form").alias("form"))
    rows = written(hashed, "roots")
    forms = rows.groupBy("letters", "root", "form").agg(F.min("copy_row_id").alias("first"), F.count("*").alias("n"))
    groups = forms.groupBy("letters").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("root", "form", "first"))).alias("forms")).filter("n > 1")
    group = F.pandas_udf(_classes, "array<int>")(F.col("forms.form"))
    told = groups.select("letters", F.explode(F.arrays_zip("forms", group.alias("c"))).alias("x")).select("letters", "x.forms.root", "x.forms.form", "x.forms.first", F.col("x.c").alias("c"))
    firsts = told.groupBy("letters", "c").agg(F.min("first").alias("first_row_id"), F.collect_list(F.struct("root", "form")).alias("forms")).select("first_row_id", F.explode("forms").alias("x"), "letters").select("letters", "x.root", "x.form", "first_row_id")
    pairs = attach(rows, firsts, ["letters", "root", "form"], "inner").filter("copy_row_id <> first_row_id").select("first_row_id", "copy_row_id")
    return confirmed(written(pairs, "pairs"), named)


def confirmed(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs whose other columns are equal as stored; the first's are fetched once for each first."""
    content = named.select("copy_row_id", "rest")
    firsts = content.join(pairs.select(F.col("first_row_id").alias("copy_row_id")).distinct(), "copy_row_id", "left_semi").select(F.col("copy_row_id").alias("first_row_id"), F.col("rest").alias("first_rest"))
    return attach(pairs.join(content, "copy_row_id"), firsts, ["first_row_id"], "inner").filter(F.col("rest").eqNullSafe(F.col("first_rest"))).select("first_row_id", "copy_row_id")


def collapsed(df: DataFrame, found: DataFrame, id_column: str) -> DataFrame:
    """The records that are no copies, each with the number of records it stands for."""
    counts = found.groupBy(F.col("first_row_id").alias(id_column)).agg((F.count("*") + 1).alias("copies"))
    left = df.join(found.select(F.col("copy_row_id").alias(id_column)), id_column, "left_anti")
    return left.join(counts, id_column, "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
