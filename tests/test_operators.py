"""Core operators on small literal tables."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terazi.operators import citations, documents, evaluation, privacy, relational, retrieval
from terazi.operators.pairs import connected_groups, pairs_within


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("pairs", [1, 100])
def test_bm25_matches_brute_force(spark, pairs):
    texts = ["kira artışı kira", "iş sözleşmesi", "kira ve iş", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    asked = spark.createDataFrame([(0, "KİRA kira is"), (1, "yok")], "query_id long, text string")
    got = retrieval.bm25_top(asked, docs, "id", F.col("t"), 4, pairs).collect()
    words = [["kira", "artisi", "kira"], ["is", "sozlesmesi"], ["kira", "ve", "is"], [], []]
    df = Counter(w for d in words for w in set(d))
    idf = {w: math.log(5 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    avg = sum(map(len, words)) / 5

    def score(q, d):
        return round(sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in q if w in d), 6)

    for r in got:
        assert r.skor == pytest.approx(score(["kira", "kira", "is"] if r.query_id == 0 else ["yok"], words[r.doc_id]), abs=1e-6)
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1] == [0, 1, 2, 3]


def test_nearest_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None), (98, [0.0] * 8)], "doc_id long, vector array<double>")
    asked = vectors.filter("doc_id < 7").withColumnRenamed("doc_id", "query_id")
    got = retrieval.nearest(asked, vectors, 5, slice_bytes=100)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    for q in range(7):
        expected = sorted(range(60), key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))[:5]
        assert [r.doc_id for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == expected


def test_bm25_keeps_the_best_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 7)
    docs = spark.createDataFrame([(i, " ".join(["kira"] * (i % 5) + ["dava"] * (i % 3) + [f"s{i}"])) for i in range(90)], "id long, t string")
    asked = spark.createDataFrame([(q, "kira dava" if q % 2 else "dava") for q in range(5)], "query_id long, text string")
    few = sorted(tuple(r) for r in retrieval.bm25_top(asked, docs, "id", F.col("t"), 6).collect())
    monkeypatch.setattr(retrieval, "CELLS", 1_000_000)
    assert few == sorted(tuple(r) for r in retrieval.bm25_top(asked, docs, "id", F.col("t"), 6, 3).collect()) and len(few) == 30
    assert retrieval.bm25_top(asked.limit(0), docs, "id", F.col("t"), 6).count() == 0 and retrieval.bm25_top(asked, docs.limit(0), "id", F.col("t"), 6).count() == 0


def test_recall_of_the_index(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = vectors.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    exact = retrieval.nearest(asked, vectors)
    found = retrieval.indexed_nearest(asked, vectors)
    n = exact.count()
    recall = exact.join(found, ["query_id", "doc_id"], "left_semi").count() / n
    print("recall", recall, n)
    assert n == 10 * asked.count() and recall >= 0.9
    # One list holds all: its blocks are compared one by one.
    one = retrieval.indexed_nearest(asked, vectors, centres=retrieval.fitted_lists(vectors, 1), block=100)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, exact.collect()))


def test_fusion_and_ties(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, None, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 0), (1, 12, 1)], "query_id long, doc_id long, rank int")
    got = retrieval.fused(retrieval.channel(a, "a", 0, 1.0), retrieval.channel(b, "b", 1, 1.0)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [11, 10, 12]
    assert got[0].kaynaklar == ["a", "b"]
    assert got[0].skor == pytest.approx(1 / 61 + 1 / 60, abs=1e-9)


def test_blend_edges(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.01), (1, 2, 0.5, 0.99), (2, 1, 0.7, 0.5)], "query_id long, doc_id long, ce double, skor double")
    got = {(r.query_id, r.doc_id): r.karma for r in retrieval.blended(df, "ce", "skor", 0.5).collect()}
    assert got[(1, 2)] > got[(1, 1)]
    assert got[(2, 1)] is None


def test_pinned(spark):
    ranked = spark.createDataFrame([(1, d, d) for d in range(5)], "query_id long, doc_id long, rank int")
    wanted = spark.createDataFrame([(1, 3), (1, 3)], "query_id long, doc_id long")
    got = retrieval.pinned(ranked, wanted, 3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [3, 0, 1]


def test_upsert_and_anti(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "p long, k string, g string")
    new = spark.createDataFrame([(4, "b", "x"), (5, "b", "x")], "p long, k string, g string")
    assert rows(relational.upserted(old, new, "k", ["g"], "p"), "p", "k") == [(3, "c"), (5, "b")]
    assert rows(relational.not_done(old, new, ["g"]), "p") == [(3,)]
    assert rows(relational.not_done(old, new, ["g"], F.col("p") == 2), "p") == [(2,), (3,)]


def test_reuse_by_text(spark):
    old = spark.createDataFrame([("t1", 10, 2), ("t1", 11, 1), ("t2", 12, 3)], "t string, v long, p long")
    new = spark.createDataFrame([("t2",), ("t1",), ("t3",), (None,)], "t string")
    assert sorted(((r.t or "", r.v) for r in relational.reused(new, old, "t", "v", "p").collect()), key=str) == sorted([("t2", 12), ("t1", 11), ("t3", None), ("", None)], key=str)


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 6), ("g", 3, 1)], "g string, o int, n int")
    assert rows(relational.within_budget(df, "g", [F.col("o")], F.col("n"), 10, F.floor(F.col("o") / 2)), "o") == [(1,)]


def test_densest_first_of_equals(spark):
    df = spark.createDataFrame([(1, p) for p in (1, 2, 50, 51)], "d long, p int")
    assert rows(relational.densest(df, "d", "p", 10), "d", "bas", "n") == [(1, 1, 2)]


def test_pairs_in_hot_groups(spark):
    n = 70
    df = spark.createDataFrame([("hot", i) for i in range(n)] + [("hot", 3), ("one", 1), (None, 5), ("two", 8), ("two", 9), ("two", None)], "g string, m long")
    got = rows(pairs_within(df, "g", "m", block=16), "g", "a", "b")
    assert got == sorted([("hot", i, j) for i in range(n) for j in range(i + 1, n)] + [("two", 8, 9)])


def test_connected_groups(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = rows(connected_groups(spark.createDataFrame(edges, "a long, b long")), "node", "root")
    assert got == [(i, 0) for i in range(31)] + [(100, 100), (101, 100), (102, 100)]
    assert connected_groups(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(
    ("law", "article", "body", "expected"),
    [
        ("4857", "1", "Bu Kanun, 4 üncü maddedeki istisnalar dışında uygulanır.", {("4857-4", "istisna")}),
        ("4857", "5", "2821 sayılı Sendikalar Kanununun 31 inci maddesi hükümleri saklıdır.", {("2821-31", "istisna")}),
        ("1", "1", "68, 69 ve 70 inci maddeler birlikte okunur.", {("1-68", "atif"), ("1-69", "atif"), ("1-70", "atif")}),
        ("6102", "1136", "1201 inci maddeye bakılır.", {("6102-1201", "atif")}),
        ("5", "3", "3 üncü madde kendisidir.", set()),
        ("5", "3", "İş Kanununun 7 nci maddesi uyarınca yapılır.", {("4857-7", "gonderme")}),
        ("5", "3", None, set()),
    ],
)
def test_edges(spark, law, article, body, expected):
    df = spark.createDataFrame([(law, article, body)], "mevzuat_no string, madde_no string, metin string")
    got = citations.edges(df).collect()
    assert {(r.hedef, r.iliski) for r in got} == expected
    assert all("madde" in r.kanit for r in got)


def test_mentions_as_of(spark):
    far = "x " * 100
    body = f"4857 sayılı Kanunun 19 uncu maddesi ile {far} Türk Borçlar Kanunu ve 5 inci madde"
    got = citations.mentions(spark.createDataFrame([(1, body), (2, "9 uncu madde, sonra 6098 sayılı"), (3, "7 nci madde")], "id long, t string"), "id", "t")
    assert rows(got, "id", "kanun", "madde") == [(1, "4857", "19"), (1, "türk borçlar kanunu", "5"), (2, "6098", "9")]


def test_audit_statuses(spark):
    articles = spark.createDataFrame(
        [(1, "4857", "19", False, False), (2, "6102", "148", True, False), (3, "6102", "149", False, True), (4, "4857", "19", True, False)],
        "kayit_no long, mevzuat_no string, madde_no string, mulga boolean, kismi_mulga boolean",
    )
    cited = spark.createDataFrame([("4857", "19"), ("6102", "148"), ("6102", "149"), ("4857", "999"), ("Uydurma Kanunu", "1"), ("İş Kanunu", "19")], "kanun string, madde string")
    got = {(r.kanun, r.madde): r.durum for r in citations.audited(cited, articles).collect()}
    assert list(got.values()).count("tamam") == 2
    assert got[("6102", "148")] == "mulga" and got[("6102", "149")] == "kismi_mulga"
    assert got[("4857", "999")] == "bulunamadi" and got[("Uydurma Kanunu", "1")] == "kanun_yok"


def test_masking_round_trip(spark):
    t = "a@b.org ve a@b.org, 10000000146, 12345678901, TR33 0006 1005 1978 6457 8413 26, 4857 sayılı"
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "id long, t string")
    got = {r.id: r for r in privacy.masked(df, "id", "t").withColumn("back", privacy.unmasked()).collect()}
    assert got[1].maskeli == "[EPOSTA_1] ve [EPOSTA_1], [TCKN_1], 12345678901, [IBAN_1], 4857 sayılı"
    assert got[1].back == t and got[2].maskeli is None and got[3].maskeli == ""


def test_masking_by_position(spark):
    t = "DOSYA NO : 2026/1184 ve 2025/12 D.İş, 9. HD 2019/1234 E.; vergi no: 4820573916 ile 4820573916, 34 ABC 123; x.a@b.org a@b.org 1HGCM82633A004352"
    got = privacy.masked(spark.createDataFrame([(1, t)], "id long, t string"), "id", "t").withColumn("back", privacy.unmasked()).first()
    assert got.maskeli == "DOSYA NO : [DOSYA_1] ve [DOSYA_2] D.İş, 9. HD 2019/1234 E.; vergi no: [VERGINO_1] ile 4820573916, [PLAKA_1]; [EPOSTA_1] [EPOSTA_2] [SASI_1]"
    assert got.back == t
    found = privacy.identifiers(spark.createDataFrame([(1, "b@c.org a@b.org b@c.org"), (2, None)], "id long, t string"), "id", "t")
    assert rows(found, "id", "tur", "deger", "ilk", "yer") == [(1, "EPOSTA", "a@b.org", 9, "[EPOSTA_2]"), (1, "EPOSTA", "b@c.org", 1, "[EPOSTA_1]")]


def test_packs(spark):
    paragraphs = ["a" * 60, "b" * 60, "c" * 200, "d" * 10]
    df = spark.createDataFrame([(1, "\n".join(paragraphs)), (2, "kısa"), (3, ""), (4, None)], "id long, t string")
    got = rows(documents.packs(df, "id", F.col("t"), limit=130, least=20), "id", "parca_no", "parca_adet", "parca")
    assert got == [(1, 1, 2, "a" * 60 + "\n" + "b" * 60), (1, 2, 2, "c" * 200), (2, 1, 1, "kısa")]


def test_sections(spark):
    t = "giriş\nDAVACI : A\nbilgi\nKONU : kira\nHUKUKİ SEBEPLER\nTBK\nEKLER\nx"
    got = rows(documents.sections(spark.createDataFrame([(1, t), (2, None)], "id long, t string"), "id", "t"), "id", "bolum", "metin")
    assert got == [(1, "", "giriş"), (1, "HUKUKİ SEBEPLER", "HUKUKİ SEBEPLER\nTBK"), (1, "KONU", "KONU : kira")]


def test_spelling(spark):
    corpus = spark.createDataFrame([("hırsızlık suçunun cezası",), ("Hırsızlık hirsizlik tazminat",)], "t string")
    speller = documents.spelling_map(corpus, "t")
    assert ("hirsizlik", "hırsızlık", 2) in rows(speller, "katli", "dogru", "n")
    asked = spark.createDataFrame([(1, "hirsizlik sucunun  cezasi, TCK ve hırsızlık")], "id long, t string")
    assert documents.respelled(asked, "id", "t", speller).first().duzeltilmis == "hırsızlık suçunun  cezası, TCK ve hırsızlık"


def test_hits_and_mrr(spark):
    results = spark.createDataFrame([(1, 0, "x", "1"), (1, 1, "y", "2"), (2, 0, "z", "9")], "query_id long, rank int, law string, article string")
    gold = spark.createDataFrame([(1, "y", None), (2, "q", "1")], "query_id long, law string, article string")
    firsts = evaluation.first_gold_rank(results, gold, ["law", "article"]).withColumn("g", F.lit("a"))
    got = evaluation.hits_and_mrr(firsts, "g").first()
    assert (got.soru, got.ilk_1, got.ilk_3, got.mrr) == (2, 0, 1, 0.25)


def test_running_sums_by_blocks(spark):
    df = spark.range(400).selectExpr("if(id % 3 = 0, null, id % 3) g", "id o", "(id * 7) % 11 n")
    got = {r.o: (r.t, r.k) for r in relational.running(df, "g", [F.col("o")], F.floor(F.col("o") / 16), {"t": F.col("n"), "k": F.lit(1)}).collect()}
    sums = {}
    for r in df.orderBy("o").collect():
        t, k = sums.get(r.g, (0, 0))
        sums[r.g] = (t + r.n, k + 1)
        assert got[r.o] == sums[r.g]
    few = relational.within_budget(df, "g", [F.col("o")], F.col("n"), 100, F.floor(F.col("o") / 16))
    assert {r.o for r in few.collect()} == {o for o, (t, _) in got.items() if t <= 100}


def test_merged_decisions_order_and_label(spark):
    from terazi.operators import decisions

    rows = [
        ("3. HD", "A", "1", "1", "03.07.2014", 1, 0.999, False, 0), ("3. HD", "B", "2", "2", "01.02.2020", 2, 0.999, True, 1), ("3. HD", "C", "1", "1", "01.01.2022", 3, 0.9, True, 1),
        ("9. HD", "D", "5", "5", "01.01.2005", 4, 0.95, False, 0), ("9. HD", "E", "6", "6", "01.01.2024", 5, 0.4, False, 0),
        (None, "F", None, None, "", 6, 0.5, False, 0), (None, "G", None, None, "abc", 7, 0.5, False, 0), (None, "H", "7", "7", "01.01.2020", 8, 0.5, False, 0),
    ]
    df = spark.createDataFrame(rows, "daire string, id string, esas_no string, karar_no string, karar_tarihi string, kayit_no long, skor double, canli boolean, _o int")
    got = decisions.merged(df, ["_o", "kayit_no"], 3).orderBy("daire", "sira").collect()
    assert [(r.id, r.kaynak) for r in got] == [("H", "yerel"), ("F", "yerel"), ("G", "yerel"), ("B", "karma"), ("A", "karma"), ("D", "yerel"), ("E", "yerel")]


def test_chains_of_articles(spark):
    rows = [
        ("4857", "1", "Bu Kanun, 4 üncü Maddedeki istisnalar dışında uygulanır."), ("1", "2", "2821 sayılı Kanunun 31 inci maddesi hükümleri saklıdır."), ("5", "9", "68, 69 ve 70 inci maddeler uyarınca."), ("5", "70", "70 inci maddede"),
        ("6102", "1136", "1201 inci maddeye göre"), ("7", "1", "ek 3 üncü madde ve geçici 2 nci maddesi, ek 2 ve 4 üncü madde ile 5. maddesi"), ("8", "1", None),
    ]
    found = citations.edges(spark.createDataFrame(rows, "mevzuat_no string, madde_no string, metin string"))
    got = {(r.kaynak, r.hedef): r.iliski for r in found.collect()}
    assert got == {
        ("4857-1", "4857-4"): "istisna", ("1-2", "2821-31"): "istisna", ("5-9", "5-68"): "gonderme", ("5-9", "5-69"): "gonderme", ("5-9", "5-70"): "gonderme", ("6102-1136", "6102-1201"): "gonderme",
        **{("7-1", f"7-{a}"): "atif" for a in ("Ek 3", "Geçici 2", "Ek 2", "4", "5")},
    }
    known = spark.createDataFrame([("5", "68", "Ad", "Başlık", 1), ("5", "68", "Sonraki", None, 2)], "mevzuat_no string, madde_no string, mevzuat_adi string, baslik string, kayit_no long")
    marked = {(r.hedef, r.ad, r.var) for r in citations.targets(found, known).filter("kaynak = '5-9'").collect()}
    assert marked == {("5-68", "Ad", True), ("5-69", None, False), ("5-70", None, False)}


def test_three_forms_of_articles_in_decisions(spark):
    df = spark.createDataFrame([(1, "4857 sayılı Kanun m.19 ve Madde 20 ile 21 inci madde, 0. madde ve İş Kanunu madde: 22")], "id long, t string")
    assert [(r.kanun, r.madde) for r in citations.mentions(df, "id", "t").orderBy("pos").collect()] == [("4857", "19"), ("4857", "20"), ("4857", "21"), ("4857", "22")]
