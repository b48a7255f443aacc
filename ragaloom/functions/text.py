"""Text rules of catalogs and lyric pages."""

from __future__ import annotations

import unicodedata as ud
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of concert forms, which aren't compositions.
FORMS = [
    "varnam", "rtp", "ragam tanam pallavi", "ragam thanam pallavi", "raga tanam pallavi", "tillana", "thillana", "slokam", "slokham", "sloka",
    "alapana", "alapanai", "viruttam", "virutham", "niraval", "swaram", "kalpanaswaram", "tani", "thani", "tani avartanam", "thani avartanam",
    "mangalam", "pallavi", "anupallavi", "charanam", "ragam", "thanam", "tanam", "vocal", "shlokam",
]
# Instruments that stand where a listing has its raga.
INSTRUMENTS = [
    "violin", "mridangam", "kanjira", "ghatam", "morsing", "morching", "flute", "veena", "tambura", "tanpura", "khanjira", "konnakkol",
]
# Languages in the order in which they are looked for.
LANGUAGES = ("Telugu", "Sanskrit", "Tamil", "Kannada", "Malayalam")
# Spellings of the talas, by canonical name.
TALAS = {
    "adi": ("adi", "adi tala", "adi taala", "aadi", "chatusra jati triputa", "chatusra jati triputa tala", "chaturasra triputa"),
    "rupaka": ("rupaka", "rupaka tala", "roopaka", "rupakam", "chatusra rupaka"),
    "misra chapu": ("misra chapu", "mishra chapu", "misra chaapu", "misrachapu", "tisra triputa"),
    "khanda chapu": ("khanda chapu", "khanda chaapu", "kanda chapu", "khandachapu"),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def is_composition(title: Column) -> Column:
    """Whether a title names a composition: no time stamp, three letters or digits at least, no concert form."""
    low = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), "[^a-z0-9 ]", " "), " +", " "))
    return F.coalesce((F.trim(title) != "") & ~title.rlike("[0-9]{1,2}:[0-9]{2}") & (F.length(low) >= 3) & ~low.isin(*FORMS), F.lit(False))


def listing(line: Column) -> Column:
    """(title, raga) of a listing line ``title - raga``; null for other lines."""
    parts = F.split(F.trim(line), r"\s+[–—-]\s+")
    title, raga = (F.btrim(F.get(parts, F.lit(i)), F.lit(" .–—-")) for i in (0, 1))
    good = (F.size(parts) >= 2) & ~F.lower(F.trim(line)).startswith("with") & (title != "") & (raga != "")
    good = good & (F.length(title) <= 60) & (F.length(raga) <= 40) & ~F.lower(raga).isin(*INSTRUMENTS)
    return F.when(good, F.struct(title.alias("title"), raga.alias("raga")))


def language(text: Column) -> Column:
    """The first known language whose name occurs; Unknown if none does."""
    low, out = F.lower(text), F.lit("Unknown")
    for name in reversed(LANGUAGES):
        out = F.when(low.contains(name.lower()), F.lit(name)).otherwise(out)
    return out


def field(text: Column, name: str) -> Column:
    """What stands after ``name:``, anywhere and in any case, to the end of the line; '' if nothing does."""
    return F.trim(F.regexp_extract(text, rf"(?i){name}\s*:\s*([^\n]+)", 1))


def tala(name: Column) -> Column:
    """The canonical name of a tala, or the name itself in lower case with single spaces."""
    key = F.coalesce(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " "), F.lit(""))
    known = F.create_map(*[F.lit(x) for canonical, spellings in TALAS.items() for s in spellings for x in (s, canonical)])
    return F.coalesce(F.element_at(known, key), key)


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z only, as SQLite compares."""
    return F.translate(text, UPPER, LOWER)


def like(text: Column, part: str) -> Column:
    """SQLite's ``LIKE '%part%'``: the case of A to Z doesn't count, and % and _ in the part are wild."""
    low = "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in part).replace("\\", "\\\\")
    return ascii_lower(text).like(f"%{low}%")


def display_name(slug: Column) -> Column:
    """A name in capitals out of an address part."""
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def path_parts(url: Column) -> Column:
    """The parts of an address's path that aren't empty."""
    return F.filter(F.split(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")


def is_artist_page(url: Column, host: str, first: str) -> Column:
    """Whether an address is of the host, without query or fragment, and its path is ``first`` and one more part."""
    parts = path_parts(url)
    good = F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit("")).contains(host) & ~url.contains("#") & F.parse_url(url, F.lit("QUERY")).isNull()
    return good & (F.size(parts) == 2) & (F.get(parts, F.lit(0)) == first)


def is_song_link(href: Column) -> Column:
    """Whether a link is to a lyric page."""
    return href.rlike(r"c[0-9]+\.shtml") | href.contains("/lyrics/")


def slugs(text: pd.Series) -> pd.Series:
    """Decomposed, ASCII only, lower case, hyphens for all else."""
    plain = text.map(lambda t: ud.normalize("NFKD", t).encode("ascii", "ignore").decode().lower(), na_action="ignore")
    return plain.str.replace(r"[^a-z0-9]+", "-", regex=True).str.strip("-")


def slug(name: Column, composer: Column) -> Column:
    """A stable id of name and composer."""
    return F.pandas_udf(slugs, "string")(F.concat(name, F.lit("-"), composer))


def folds(text: pd.Series) -> pd.Series:
    """Decomposed without combining marks, lower case, letters and digits only."""
    return text.map(lambda t: "".join(c for c in ud.normalize("NFKD", t) if not ud.combining(c) and c.isalnum()).lower() if t is not None else None, na_action="ignore")


def fold(text: Column) -> Column:
    """The key by which spellings of a name are equal."""
    return F.pandas_udf(folds, "string")(text)


def prompt(name: Column, composer: Column, raga: Column, tala_name: Column, lang: Column, pallavi: Column, anupallavi: Column, charanam: Column) -> Column:
    """The request for a meaning, with the sections that exist and the charanams numbered."""
    head = [F.concat(F.lit(f"{k}: "), v) for k, v in (("Composition", name), ("Composer", composer), ("Raga", raga), ("Tala", tala_name), ("Language", lang))]
    verses = F.transform(charanam, lambda c, i: F.concat(F.lit("\nCharanam "), (i + 1).cast("string"), F.lit(":\n"), c))
    second = F.when(anupallavi != "", F.array(F.concat(F.lit("\nAnupallavi:\n"), anupallavi))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(*head, F.lit(""), F.lit("Lyrics:"), F.concat(F.lit("Pallavi:\n"), pallavi)), second, verses, F.array(F.lit("\nExplain the meaning of these lyrics in English.")))
    return F.array_join(lines, "\n")


def utc_now() -> Column:
    """The time of the query in UTC, as ISO 8601 with microseconds and offset."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def joined_url(base: Column, href: Column) -> Column:
    """The address that a link of a page leads to; null if either is null."""

    def run(bases: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else urljoin(a, b) for a, b in zip(bases, links, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(base, href)
