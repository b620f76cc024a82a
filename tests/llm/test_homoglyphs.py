"""One written form; sound signs and words of other scripts stay."""

import unicodedata

import pytest

from terazi.llm import homoglyphs as h

CASES = [
    ("ｙａｚıｌı （３）", "yazılı (3)"), ("𝐭𝐞𝐬𝐜𝐢𝐥", "tescil"), (unicodedata.normalize("NFD", "hâlinde değişik çığ İş"), "hâlinde değişik çığ İş"), ("i​htirazi", "ihtirazi"), ("öde­me", "ödeme"), ("iki nüsha hâlinde　x", "iki nüsha hâlinde x"),
    ("Каnunun", "Kanunun"), ("Ауkırılık", "Aykırılık"), ("οlağan", "olağan"), ("keﬁl", "kefil"), ("﻿7. Hukuk", "7. Hukuk"), ("9. Dаіrеsі", "9. Dairesi"),
]
SOUND = ["Ambalajda “Зелёная линия” ibaresi", "Bant genişliği Δf ve direnç Ω cinsinden", "λ = 0,035 W/mK", "250 m² ve 3½, 10⁻³, №, °C", "9. HUKUK DAİRESİ ", "9.  Hukuk  Dairesi", "Łódź São Tomé", "(……) «x»", "", "direnç Ω", "сорок оса"]


def test_forms(spark):
    rows = [(i, t, e) for i, (t, e) in enumerate(CASES)] + [(100 + i, t, t) for i, t in enumerate(SOUND)]
    df = spark.createDataFrame([(i, t, "fazla") for i, t, _ in rows], "kayit_no long, metin string, t string")
    got = {r.kayit_no: r.tek_bicim for r in h.one_form(df, "kayit_no", "metin").collect()}
    assert got == {i: e for i, _, e in rows}


def test_nulls_repeats_long_and_empty(spark):
    long = "ｙａｚıｌı " * 30_000
    df = spark.createDataFrame([(1, None), (2, "ｘ"), (2, "ｘ"), (3, long)], "kayit_no long, metin string")
    got = sorted(((r.kayit_no, r.tek_bicim) for r in h.one_form(df, "kayit_no", "metin").collect()), key=str)
    assert got == sorted([(1, None), (2, "x"), (2, "x"), (3, "yazılı " * 30_000)], key=str)
    assert h.one_form(df.limit(0), "kayit_no", "metin").count() == 0


@pytest.mark.parametrize("form", sorted(h.compatibility_forms())[:5])
def test_forms_by_rule(form):
    assert h.compatibility_forms()[form] == unicodedata.normalize("NFKC", form)
