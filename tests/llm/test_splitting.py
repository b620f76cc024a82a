"""Cuts, overlaps and numbers of pieces."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terazi.llm import splitting as s


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_pieces_cover_the_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    parts = s.pieces_of(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(b - a <= limit for a, b in parts)
    for (a, b), (c, d) in zip(parts, parts[1:], strict=False):
        assert a < c <= b < d and b - c <= overlap
    pieces = [text[a:b] for a, b in parts]
    rebuilt = pieces[0] + "".join(text[max(a, e) : b] for (a, b), (_, e) in zip(parts[1:], parts, strict=False))
    assert rebuilt == text


def test_strongest_boundary_first():
    text = "a" * 45 + ". " + "b" * 45 + "\n" + "c" * 60
    assert s.pieces_of(text, 110, 0)[0] == (0, 93)


def test_overlap_begins_with_a_word():
    text = " ".join(f"kelime{i:03d}" for i in range(60))
    for a, _ in s.pieces_of(text, 120, 30)[1:]:
        assert text[a - 1] == " "


def test_coarsest():
    assert s.coarsest("a" * 10 + "\n" + "b" * 10, 10) == "paragraf"
    assert s.coarsest("aaaa. bbbb. cccc.", 6) == "cumle"
    assert s.coarsest("aaaa bbbb cccc", 6) == "sozcuk"
    assert s.coarsest("aaaabbbbcccc", 6) == "harf"
    assert s.coarsest("", 6) == "paragraf"


def test_rows_and_numbers(spark):
    big = "Bir cümle burada. " * 200
    rows = [(1, "d", 1, "kısa"), (2, "d", 2, big), (3, "d", 2, big), (4, "d", 3, None), (5, None, 1, big), (6, None, 1, ""), (7, "e", None, "tek")]
    df = spark.createDataFrame([(*x, "fazla") for x in rows], "kayit_no long, karar_id string, parca_no int, gerekce string, sinir string")
    split = s.split_oversized(df, "gerekce")
    assert sorted((r.kayit_no, r.sinir) for r in split.filter("sinir is not null").collect()) == [(2, "cumle"), (3, "cumle"), (5, "cumle")]
    n = len(s.pieces_of(big))
    got = s.renumbered(split).collect()
    assert max(len(r.gerekce or "") for r in got) <= s.LIMIT
    of = lambda k: sorted((r.parca_no, r.parca_adet) for r in got if r.kayit_no == k)
    assert of(1) == [(1, n + 2)] and of(2) == of(3) == [(i, n + 2) for i in range(2, n + 2)] and of(4) == [(n + 2, n + 2)]
    assert of(5) == [(i + 1, n) for i in range(n)] and of(6) == [(1, 1)] and of(7) == [(1, 1)]


def test_hot_decision_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 4)
    df = spark.range(50).select(F.col("id").alias("kayit_no"), F.lit("d").alias("karar_id"), F.col("id").cast("int").alias("parca_no"), F.concat(F.lit("x"), "id").alias("gerekce"))
    got = sorted((r.kayit_no, r.parca_no, r.parca_adet) for r in s.renumbered(s.split_oversized(df, "gerekce")).collect())
    assert got == [(i, i + 1, 50) for i in range(50)]


def test_very_long_and_empty(spark):
    df = spark.createDataFrame([(1, "d", 1, "x" * 200_000)], "kayit_no long, karar_id string, parca_no int, gerekce string")
    split = s.split_oversized(df, "gerekce")
    assert split.first().sinir == "harf" and all(p.uzunluk <= s.LIMIT for p in split.first().parcalar)
    assert s.renumbered(s.split_oversized(df.limit(0), "gerekce")).count() == 0
