"""One consistent form for text that looks the same in different characters."""

from __future__ import annotations

import unicodedata as ud
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets that look like Latin ones, with the Latin letter each stands in for.
LOOK_ALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХаеѕіјоԁһрԛсуԝх", "ABESIJKMHOPCTYXaesijodhpqcywx"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγιϳνορυϲ", "ABEZHIKMNOPTYXayijvopuc"),
    "Armenian": ("ՕՍօհոսցզ", "OUohnugq"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᎩᏃ", "ABCDEGHJKLMPRSTVWYZ"),
}
# Letters of Latin phonetic writing that look like ordinary ones.
PHONETIC = {"ɑ": "a", "ɡ": "g"}
#: Characters of general category Cf that have a visible glyph of their own.
VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Invisible characters outside category Cf.
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180E), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
PLAIN, ALIKE = 0, 1


def rules() -> dict[str, tuple[str, int, str]]:
    """The mapping, derived from the character database: text -> (consistent text, PLAIN or ALIKE, alphabet).

    Widths come from the wide and narrow decompositions, letters and digits of mathematical alphabets and the letters for
    Roman numbers from theirs, accents from all canonical compositions, spaces from category
    Zs, invisible characters from Cf and Cc, look-alikes from LOOK_ALIKES. Two rules for one text must agree.
    """
    made: dict[str, tuple[str, int, str]] = {}

    def rule(text: str, to: str, kind: int = PLAIN, alphabet: str = "") -> None:
        if made.setdefault(text, (to, kind, alphabet)) != (to, kind, alphabet):
            raise ValueError(f"rules disagree on {text!r}: {made[text]} and {(to, kind, alphabet)}")

    for cp in (*range(0x20000), *range(0xE0000, 0xE0200)):  # the planes between have ideographs only
        ch, cat = chr(cp), ud.category(chr(cp))
        if cp in INVISIBLE or cat == "Cf" and cp not in VISIBLE_FORMAT:
            rule(ch, "")
        elif cat == "Zs":
            if ch != " ":
                rule(ch, " ")
        elif cat in ("Zl", "Zp"):
            rule(ch, "\n")
        elif cat == "Cc":
            if ch not in "\t\n\r":
                rule(ch, " " if ch in "\x0b\x0c\x85" else "")
        elif cat != "Cn" and (parts := ud.decomposition(ch)):
            if parts.startswith(("<wide>", "<narrow>")):
                rule(ch, ud.normalize("NFC", ud.normalize("NFKC", ch)))
            elif parts.startswith("<font>") or 0x2160 <= cp < 0x2180 and len(parts.split()) == 2:
                if len(plain := ud.normalize("NFKC", ch)) == 1 and plain.isascii() and plain.isalnum():
                    rule(ch, plain)
            elif parts[0] != "<" and not 0xAC00 <= cp < 0xD7A4:
                full, whole = ud.normalize("NFD", ch), ud.normalize("NFC", ch)
                if full != whole:
                    rule(full, whole)
                if ch != whole:
                    rule(ch, whole)
                elif len(two := "".join(chr(int(x, 16)) for x in parts.split())) > 1 and two != full:
                    rule(two, whole)
    for a, b in PHONETIC.items():
        rule(a, b)
    for alphabet, (theirs, latin) in LOOK_ALIKES.items():
        for a, b in zip(theirs, latin, strict=True):
            rule(a, b, ALIKE, alphabet)
    for text, (to, kind, _) in list(made.items()):
        if kind == PLAIN and len(to) == 1 and made.get(to, ("", PLAIN, ""))[1] == ALIKE:  # the sign for a letter that looks Latin
            made[text] = made[to]
    return made


class Transducer:
    """A trie of the rules. It reads a text once, cluster by cluster, and takes the longest rule at each place."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.out: list[tuple[str, int, str] | None] = [None]
        single = []
        for text, to in (made := rules()).items():
            state = 0
            for ch in text:
                if ch not in self.next[state]:
                    self.next[state][ch] = len(self.next)
                    self.next.append({})
                    self.out.append(None)
                state = self.next[state][ch]
            self.out[state] = to
            if len(text) == 1:
                single.append(text)
        self.known: dict[str, tuple[str, str, str, bool]] = {}
        self.suspect = regex.compile("[" + "".join(regex.escape(c) for c in single) + r"]|\p{M}")
        self.cluster_of = regex.compile(r"\X")
        for text in made:
            if self(form := self(text)) != form:
                raise ValueError(f"the form of {text!r} isn't consistent itself: {form!r}")

    def cluster(self, cluster: str) -> tuple[str, str, str, bool]:
        """The form without and with look-alikes mapped, the alphabet of its base, and whether a look-alike rule applies."""
        if (known := self.known.get(cluster)) is not None:
            return known
        kept, latin, alphabet, alike, i = [], [], "", False, 0
        while i < len(cluster):
            state, best, end, j = 0, None, i + 1, i
            while j < len(cluster) and (state := self.next[state].get(cluster[j], 0)):
                j += 1
                if self.out[state] is not None:
                    best, end = self.out[state], j
            piece = cluster[i:end]
            to, kind, script = best or (piece, PLAIN, "")
            kept.append(piece if kind == ALIKE else to)
            latin.append(to)
            alphabet, alike = alphabet or script or _alphabet(to or piece), alike or kind == ALIKE
            i = end
        found = (ud.normalize("NFC", "".join(kept)), ud.normalize("NFC", "".join(latin)), alphabet, alike)
        if len(self.known) < 200_000:
            self.known[cluster] = found
        return found

    def __call__(self, text: str) -> str:
        if not self.suspect.search(text) and ud.is_normalized("NFC", text):
            return text
        clusters = [self.cluster(c) for c in self.cluster_of.findall(text)]
        if not any(alike for *_, alike in clusters):
            return ud.normalize("NFC", "".join(kept for kept, *_ in clusters))
        foreign = {alphabet for _, _, alphabet, alike in clusters if alphabet in LOOK_ALIKES and not alike}
        out, word, latin_word, safe, mixed = [], [], [], True, False
        for kept, latin, alphabet, alike in [*clusters, (" ", " ", "", False)]:
            if alphabet or not kept:
                word.append(kept)
                latin_word.append(latin)
                mixed |= alphabet == "Latin"
                safe &= not alike or alphabet not in foreign
            else:
                out += latin_word if mixed or safe else word
                out.append(kept)
                word, latin_word, safe, mixed = [], [], True, False
        return ud.normalize("NFC", "".join(out[:-1]))


def _alphabet(text: str) -> str:
    """The alphabet of the first letter: Latin, one of LOOK_ALIKES, other, or '' if there is no letter."""
    ch = text[:1]
    if not ch or not ch.isalpha():
        return ""
    name = ud.name(ch, "")
    return next((a for a in ("Latin", *LOOK_ALIKES) if name.startswith(a.upper())), "other")


@lru_cache(1)
def transducer() -> Transducer:
    """The compiled rules, once a process."""
    return Transducer()


def consistent(values: pd.Series) -> pd.Series:
    """The consistent form of each value, worked out once for each distinct one; null stays null."""
    run = transducer()
    codes, distinct = pd.factorize(values)
    forms = [v if v.isascii() and v.isprintable() else run(v) for v in distinct]
    return pd.Series([forms[c] if c >= 0 else None for c in codes], dtype=object)


def consistent_form(column: Column) -> Column:
    """The text in one form: composed characters of ordinary width with their diacritics, no invisible characters, no
    space characters but space, tab and line break, and Latin letters where look-alikes stood in for them.

    Look-alikes are mapped in words that also have Latin letters, and in other words unless the text has a letter of
    that alphabet which no Latin letter looks like. Line and paragraph separators become line breaks. Null stays null
    and '' stays ''; the form of a form is the form itself.
    """
    return F.pandas_udf(consistent, "string")(column)


def consistent_values(df: DataFrame, column: str, id_column: str) -> DataFrame:
    """Every row's id, value, its consistent form, and whether the value needed it; no shuffle. Null needs nothing."""
    with_form = df.select(F.col(id_column), F.col(column).alias("value")).withColumn("form", consistent_form(F.col("value")))
    return with_form.withColumn("changed", ~F.col("value").eqNullSafe(F.col("form")))
