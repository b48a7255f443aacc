import unicodedata as ud

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragaloom.llm.glyphs import LOOK_ALIKES, consistent, consistent_values, rules, transducer


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("", ""),
        ("Bodhā", "Bodhā"),
        ("Ｔｈｏ　x", "Tho x"),
        ("Dһutо", "Dhuto"),
        ("Москва", "Москва"),
        ("a​̄b­c﻿", "ābc"),
        ("a b c\td\n", "a b c\td\n"),
        ("लुबष‌ु", "लुबषु"),
        ("KΩ", "KΩ"),
        ("Ⅽhaya ɑlɑp", "Chaya alap"),
        ("𝒦𝐨lavu 𝟭", "Kolavu 1"),
        ("ᎪlᏢ", "AlP"),
        ("ᎪᎫ ᏣᎳᎩ", "ᎪᎫ ᏣᎳᎩ"),
    ],
)
def test_forms(text, form):
    assert transducer()(text) == form


@given(st.text(max_size=30))
def test_a_form_is_its_own_form(text):
    form = transducer()(text)
    assert transducer()(form) == form
    assert ud.is_normalized("NFC", form)


def test_rules_agree_and_cover_look_alikes():
    made = rules()
    assert all(made[a][0] == b for theirs, latin in LOOK_ALIKES.values() for a, b in zip(theirs, latin, strict=True))


def test_long_null_and_repeated_values():
    values = pd.Series([None, "x" * 100_000, "ａ" * 50_000, None, "ａ"])
    assert consistent(values).tolist() == [None, "x" * 100_000, "a" * 50_000, None, "a"]


def test_columns_that_clash_and_empty(spark):
    df = spark.createDataFrame([(1, "ａ", "q"), (2, None, "q"), (3, "b", None)], "row_id long, title string, form string")
    assert {(r["row_id"], r["form"], r["changed"]) for r in consistent_values(df, "title", "row_id").collect()} == {(1, "a", True), (2, None, False), (3, "b", False)}
    assert consistent_values(df.filter(F.lit(False)), "title", "row_id").collect() == []
