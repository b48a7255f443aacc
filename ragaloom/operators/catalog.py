"""Catalog tables: upserts, lookups, searches, aliases and meanings. Each returns a new snapshot; nothing is overwritten in place."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragaloom.functions import text
from ragaloom.operators.skew import attach
from ragaloom.session import Written

#: Names of a vocabulary that go to the tasks at a time for fuzzy matching.
NAMES_AT_ONCE = 20_000


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def upserted(held: DataFrame, new: DataFrame, key: str, *order) -> DataFrame:
    """``held`` with the rows of ``new`` replaced or added by key; of several new rows of a key the first by ``order`` stays."""
    fresh = latest(new, [key], *order)
    return held.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def inserted(held: DataFrame, new: DataFrame, key: str, *order) -> DataFrame:
    """Only the rows that would be added: keys that aren't held yet, each once, neither null nor blank."""
    return latest(new.filter(F.trim(F.col(key)) != "").join(held.select(key), key, "left_anti"), [key], *order)


def updated(held: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``held`` with the columns of the rows that ``changes`` (unique keys) has; a null in a change is stored as null."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = attach(held, new, [key])
    return out.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in held.columns])


def search(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column contains the part, as SQLite's LIKE compares."""
    return df.filter(text.like(F.col(column), part))


def _grams(text_column: Column, size: Column) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    starts = F.sequence(F.lit(1), F.char_length(text_column) - size + 1)
    runs = F.transform(starts, lambda i: F.substr(text_column, i, size))
    return F.when(F.char_length(text_column) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def found_by_title(catalog: DataFrame, titles: DataFrame) -> DataFrame:
    """(wanted, title): the exact title, else the smallest title that contains the wanted text; null if none does.

    Only wanted texts that aren't found exactly are searched for. % and _ in them are wild, and the case of A to Z
    doesn't count. Titles are indexed by their runs of three letters; a wanted text asks for the rarest of its own (of
    two or one letters, if it has no longer run between wild ones), and what shares that is compared with LIKE. So no
    text meets all titles, but one that has nothing except wild characters.
    """
    names = Written(catalog.select("title").dropna().distinct().withColumn("low", text.ascii_lower(F.col("title"))), "titles").df
    wanted = Written(titles.select(F.col(titles.columns[0]).alias("wanted")).dropna().distinct(), "wanted").df
    exact = wanted.join(names.select(F.col("title").alias("wanted")), "wanted", "left_semi").withColumn("title", F.col("wanted"))
    low = text.ascii_lower(F.col("wanted"))
    pattern = F.concat(F.lit("%"), F.replace(low, F.lit("\\"), F.lit("\\\\")), F.lit("%")).alias("pattern")
    pieces = F.split(low, "[%_]")
    size = F.least(F.lit(3), F.array_max(F.transform(pieces, F.char_length))).alias("size")
    rest = Written(wanted.join(exact, "wanted", "left_anti").select("wanted", pattern, pieces.alias("pieces"), size), "rest").df
    sizes = sorted(r[0] for r in rest.select("size").distinct().collect())  # of 0 to 3
    index = [names.select("title", "low", F.explode(_grams(F.col("low"), F.lit(n))).alias("gram")) for n in sizes if n]
    near = [names.join(F.broadcast(rest.filter("size = 0").select("wanted", "pattern")), F.like(F.col("low"), F.col("pattern"))).select("wanted", "title")] if 0 in sizes else []
    if index:
        held = Written(reduce(DataFrame.unionByName, index), "grams").df
        counts = held.groupBy("gram").agg(F.count("*").alias("n"))
        asked = rest.filter("size > 0").select("wanted", "pattern", F.explode(F.array_distinct(F.flatten(F.transform("pieces", lambda p: _grams(p, F.col("size")))))).alias("gram"))
        # a run that no title has sorts first, and finds nothing
        rarest = asked.join(counts, "gram", "left").groupBy("wanted", "pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        near.append(held.join(rarest, "gram").filter(F.like(F.col("low"), F.col("pattern"))).select("wanted", "title"))
    found = reduce(DataFrame.unionByName, near).groupBy("wanted").agg(F.min("title").alias("title")) if near else exact.limit(0)
    return exact.unionByName(rest.select("wanted").join(found, "wanted", "left"))


def fold_index(vocabulary: DataFrame, name: str) -> DataFrame:
    """(key, canonical) by folded names of a vocabulary with ``seq``; the parts of ``A/B`` count too, and the first entry of a key wins."""
    parts = vocabulary.select(F.col(name).alias("canonical"), "seq")
    both = parts.select("canonical", "seq", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("p"), F.col("canonical").alias("n"))), F.transform(F.split("canonical", "/"), lambda n: F.struct(F.lit(1).alias("p"), n.alias("n"))))).alias("x"))
    keyed = both.select("canonical", "seq", "x.p", text.fold(F.col("x.n")).alias("key")).filter("key <> ''")
    return latest(keyed, ["key"], "p", "seq").select("key", "canonical")


def close_names(words: DataFrame, names: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """(key, near): for each distinct key the name of highest Ratcliff-Obershelp ratio from the cutoff on, the largest of equals.

    ``names`` (one column) goes to the tasks in shards of about NAMES_AT_ONCE, whose best are merged; the shards are
    fetched one after the other, so a vocabulary of any size may be searched.
    """
    held = Written(names.toDF("name").dropna().distinct(), "names").df
    wanted = words.select("key").dropna().distinct()
    shards, found = max(1, -(-held.count() // NAMES_AT_ONCE)), []
    for shard in range(shards):
        shared = words.sparkSession.sparkContext.broadcast(sorted(r[0] for r in held.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == shard).collect()))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                near = [(difflib.get_close_matches(k, shared.value, 1, cutoff) or [None])[0] for k in batch["key"]]
                ratio = [None if n is None else difflib.SequenceMatcher(None, n, k).ratio() for n, k in zip(near, batch["key"], strict=True)]
                yield pd.DataFrame({"key": batch["key"], "near": pd.Series(near, dtype=object), "ratio": pd.Series(ratio, dtype="float64")})

        found.append(wanted.mapInPandas(run, "key string, near string, ratio double"))
    if shards == 1:
        return found[0].select("key", "near")
    return reduce(DataFrame.unionByName, found).groupBy("key").agg(F.max(F.when(F.col("near").isNotNull(), F.struct("ratio", "near"))).alias("best")).select("key", F.col("best.near").alias("near"))


def resolved(spellings: DataFrame, hand: DataFrame, index: DataFrame, cutoff: float = 0.6, fuzzy: bool = True) -> DataFrame:
    """(raw, canonical, tier) for each distinct spelling, in tiers that stop at the first hit.

    Tier 1: the hand-made aliases (key, canonical) by folded key; an alias of null means: no raga. Tier 2: the fold
    index. Tier 3: fuzzy over the index's keys, for the rest only. Tier 0: nothing found.
    """
    raw = spellings.select(F.col(spellings.columns[0]).alias("raw")).dropna().distinct().withColumn("key", text.fold(F.col("raw")))
    raw = Written(raw, "raw").df
    first = hand.select("key", F.col("canonical").alias("c1"), F.lit(True).alias("hit"))
    two = attach(attach(raw, first, ["key"]), index.withColumnRenamed("canonical", "c2"), ["key"])
    rest = two.filter("hit is null and c2 is null and key <> ''")
    if fuzzy:
        near = close_names(rest.select("key"), index.select("key"), cutoff).join(index.select(F.col("key").alias("near"), F.col("canonical").alias("c3")), "near")
    else:
        near = rest.limit(0).select("key", F.lit(None).cast("string").alias("c3"))
    three = two.join(near.select("key", "c3"), "key", "left")
    hit = F.coalesce("hit", F.lit(False))
    return three.select("raw", F.when(hit, F.col("c1")).otherwise(F.coalesce("c2", "c3")).alias("canonical"), F.when(hit, 1).when(F.col("c2").isNotNull(), 2).when(F.col("c3").isNotNull(), 3).otherwise(0).alias("tier"))


def meanings(entries: DataFrame, held: DataFrame, provider: Callable[[str], str], force: bool = False) -> DataFrame:
    """(composition_id, meaning, generated_by): stored meanings; the provider's, batch by batch, where none or '' is stored.

    ``entries`` has composition_id and prompt. A provider's failure gives a null meaning and the error as generated_by.
    """
    known = attach(entries, held.select("composition_id", F.col("meaning").alias("stored")), ["composition_id"]).withColumn("stored", F.expr("nullif(stored, '')"))
    if force:
        known = known.withColumn("stored", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    rows.append((r.composition_id, provider(r.prompt), "provider"))
                except Exception as e:  # noqa: BLE001
                    rows.append((r.composition_id, None, f"error: {e}"))
            yield pd.DataFrame(rows, columns=["composition_id", "meaning", "generated_by"])

    made = known.filter("stored is null").select("composition_id", "prompt").mapInPandas(run, "composition_id string, meaning string, generated_by string")
    return known.filter("stored is not null").select("composition_id", F.col("stored").alias("meaning"), F.lit("stored").alias("generated_by")).unionByName(made)


def sections(lines: DataFrame) -> DataFrame:
    """(page_id, pallavi, anupallavi, charanam array) of lyric lines (page_id, line_no, line).

    A line that starts with a section's name opens it; each charanam opens a block of its own; blank lines and lines
    before the first section are dropped.
    """
    low = F.lower(F.trim("line"))
    opens = F.when(low.startswith("anupallavi"), "anupallavi").when(low.startswith("pallavi"), "pallavi").when(low.startswith("charanam") | low.startswith("caranam") | low.startswith("samashti charanam"), "charanam")
    w = Window.partitionBy("page_id").orderBy("line_no")
    told = lines.filter("trim(line) <> ''").withColumn("opens", opens).withColumn("section", F.last("opens", True).over(w))
    told = told.withColumn("block", F.sum((F.col("opens").eqNullSafe("charanam")).cast("int")).over(w)).filter("opens is null and section is not null")

    def joined(rows):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(rows, F.struct("line_no", F.trim("line").alias("t"))))), lambda s: s["t"]), "\n")

    blocks = told.filter("section = 'charanam'").groupBy("page_id", "block").agg(joined(F.lit(True)).alias("t"))
    verses = blocks.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "t"))), lambda s: s["t"]).alias("charanam"))
    parts = told.groupBy("page_id").agg(joined(F.col("section") == "pallavi").alias("pallavi"), joined(F.col("section") == "anupallavi").alias("anupallavi"))
    return parts.join(verses, "page_id", "left").select("page_id", "pallavi", "anupallavi", F.coalesce("charanam", F.array().cast("array<string>")).alias("charanam"))


def zipped(contours: DataFrame, meta: DataFrame, place: str = "place") -> DataFrame:
    """The rows of two tables that stand at one place (a column of both, unique in each); places that one lacks are left out."""
    return attach(contours, meta, [place], "inner")


def listed(df: DataFrame, *order: str) -> DataFrame:
    """All rows in an order, by a range partitioned sort."""
    return df.orderBy(*order)


def merged_paths(parts: list[DataFrame], column: str) -> DataFrame:
    """(column, place): the distinct values of several tables (column, place), those of earlier tables first, each at its
    first place; nulls are left out."""
    rows = [df.select(F.col(column), F.struct(F.lit(i).alias("part"), F.col("place").cast("long").alias("place")).alias("place")) for i, df in enumerate(parts)]
    return reduce(DataFrame.unionByName, rows).dropna(subset=[column]).groupBy(column).agg(F.min("place").alias("place"))


def by_names(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """The rows whose column equals one of the names (one column), without regard to case and space around; nulls equal none."""
    key = lambda c: F.lower(F.trim(c))
    wanted = names.select(key(F.col(names.columns[0])).alias("_name")).dropna().distinct().withColumn("_hit", F.lit(True))
    return attach(df.withColumn("_name", key(F.col(column))), wanted, ["_name"], "inner").drop("_name", "_hit")
