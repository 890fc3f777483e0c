"""Plain forms: the mapping, each kind of difference, and what must stay."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.forms import LOOKALIKE, _merged, mapping, plain, plain_values, word_mapping

SAME = ["", "Điều 5. Người lao động", "tiếng Nga có chữ «закон» có", "ký hiệu 契約 có", "Hệ số α và β", "hệ số λ", "договор", "a-b/c 12", "line\nline", "ν = 3", "сор закон", "հայերեն", "カナ", "a\u2028b"]
CHANGED = [
    ("ｎàｏ？", "nào?"), ("Ðiều", "Điều"), ("QƉ-TLÐ", "QĐ-TLĐ"), ("ðồng", "đồng"), ("laο động", "lao động"), ("νiệc", "việc"), ("НРV", "HPV"), ("123/2023/ТТ-LTB", "123/2023/TT-LTB"),
    ("ngườі", "người"), ("kể cа̉", "kể cả"), ("a b", "a b"), ("a　b c", "a b c"), ("ch​ế", "chế"), ("﻿x", "x"), ("p\xadhẩm", "phẩm"),
    (unicodedata.normalize("NFD", "Người quản lý được phép ở"), "Người quản lý được phép ở"), ("ệ", "ệ"), ("ệ", "ệ"), ("ệ", "ệ"), ("o​̛", "ơ"), ("а) Bên giao", "a) Bên giao"),
    ("tab\there", "tab here"), ("a\x0bb", "a b"), ("ｶﾞｲﾄﾞ", "ガイド"), ("laօ động", "lao động"), ("𝐥𝐚𝐨 động", "lao động"), ("vo\u031b\u0301i", "với"), ("v\u043e\u031b\u0301i", "với"), ("ｖｏ\u031b\u0301ｉ", "với"), ("\u0438\u0306 закон", "й закон"),
]


@pytest.mark.parametrize("text", SAME)
def test_stays(text):
    assert plain(text) == text


@pytest.mark.parametrize("seen,meant", CHANGED)
def test_changes(seen, meant):
    assert plain(seen) == meant


def test_mapping_has_no_conflict_and_none_of_its_images_changes():
    for value in mapping().values():
        assert plain(value) == value
    assert all(len(v) == 1 for v in LOOKALIKE.values())
    for value in word_mapping().values():
        assert plain(f"lao{value}") == f"lao{value}"
    with pytest.raises(ValueError, match="two images"):
        _merged({"x": "a"}, {"x": "b"})
    with pytest.raises(ValueError, match="unstable"):
        _merged({"x": "y", "y": "z"})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeoớĐ đệ̛̣̂​ ｎоаνακзΝ.\n12契"), max_size=30))
def test_is_stable(text):
    once = plain(text)
    assert plain(once) == once


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aăâbcdđeêghiklmnoôơpqrstuưvxyàảãáạằẳẵắặ ,.", max_size=40))
def test_decomposed_spelling_is_equal(text):
    assert plain(unicodedata.normalize("NFD", text)) == text


def test_rows(spark):
    df = spark.createDataFrame([(1, "laο", None, "x"), (None, "", "ｎ", "x"), (1, "laο", None, "x")], "k long, a string, b string, value string")
    got = sorted(((r.field, r.row_key, r.value, r.plain) for r in plain_values(df, "k", ["a", "b"]).collect()), key=str)
    assert got == sorted([("a", "1", "laο", "lao")] * 2 + [("b", "1", None, None)] * 2 + [("a", None, "", ""), ("b", None, "ｎ", "n")], key=str)
    assert plain_values(df.limit(0), "k", ["a"]).count() == 0
    assert plain("ｎ" * 200_000) == "n" * 200_000
