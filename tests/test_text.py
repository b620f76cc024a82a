"""Scalar functions against literal cases."""

import pytest
from pyspark.sql import functions as F

from terazi.functions import checks, text


def value(spark, expr, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "expected"), [("İŞ KANUNU", "is kanunu"), ("i̇stanbul", "istanbul"), ("ÇĞÜÖŞI", "cguosi"), ("", ""), (None, None)])
def test_fold(spark, given, expected):
    assert value(spark, text.fold(F.col("t").cast("string")), t=given) == expected


@pytest.mark.parametrize(
    ("given", "law", "article"),
    [
        ("4857 sayılı Kanunun 19. maddesi", "4857", "19"),
        ("TBK 6. madde ne diyor", "6098", "6"),
        ("madde 53 nedir", "", "53"),
        ("İş Kanunu m. 25", "4857", "25"),
        ("4857 madde 19", "4857", "19"),
        ("6698 Kanunu m.3/a", "6698", "3/A"),
        ("geçici madde 5", "", "Geçici 5"),
        ("ek 2 nci madde", "", "Ek 2"),
        ("hiçbiri", "", ""),
        (None, "", ""),
    ],
)
def test_references(spark, given, law, article):
    t = F.col("t").cast("string")
    assert (value(spark, text.law_reference(t), t=given), value(spark, text.article_reference(t), t=given)) == (law, article)


@pytest.mark.parametrize(
    ("given", "expected"),
    [("kıdem tazminatı ne kadar?", "kıdem tazminatı"), ("kıdem tazminatı?", ""), ("ne kadar", ""), ("Kira artışı nasıl hesaplanır", "Kira artışı hesaplanır")],
)
def test_core_query(spark, given, expected):
    assert value(spark, text.core_query("t"), t=given) == expected


def test_spelled_numbers(spark):
    assert value(spark, text.spelled_numbers("t"), t="ondört gün") == [10, 14]
    assert value(spark, text.spelled_numbers("t"), t="yirmi altı gün, üç ay") == [3, 6, 20, 26]
    assert value(spark, text.spelled_numbers("t"), t="hiç") == []


def test_html(spark):
    inner = "<html><head><style>.v { color: red; }</style></head><body><p>Bir</p><div>İki &amp; üç</div></body></html>"
    assert value(spark, text.html_text("t"), t=inner) == "Bir\n İki & üç"
    assert value(spark, text.html_text("t"), t=inner.replace("<", "&lt;").replace(">", "&gt;")) == "Bir\n İki & üç"
    assert value(spark, text.html_text(F.col("t").cast("string")), t=None) == ""


def test_decision_body(spark):
    page = '<p>19. Hukuk Dairesi 2013/1 E. , 2014/2 K.</p><p>"İçtihat Metni"</p><p>Mahkemesi : Çorum</p><p>Asıl metin. Üye sayısı üçtür.</p><p>BAŞKAN ÜYE ÜYE</p>'
    assert value(spark, text.decision_body("t"), t=page) == "Asıl metin. Üye sayısı üçtür."


@pytest.mark.parametrize(("given", "ok"), [("Yıllık izin", True), ("yürürlüğe girer.", False), ("a) bent", False), ("MADDE 5", False), ("x" * 91, False), ("", False), (": Tertip", False)])
def test_title(spark, given, ok):
    assert value(spark, text.title_plausible("t"), t=given) is ok


def test_stable_id(spark):
    import hashlib

    assert value(spark, text.stable_id("t"), t="1-4857-5-19") == int.from_bytes(hashlib.sha1(b"1-4857-5-19").digest()[:8], "big") % 2**63


@pytest.mark.parametrize(("given", "ok"), [("10000000146", True), ("12345678901", False), ("01234567890", False), ("1000000014", False), ("", False), (None, False)])
def test_national_id(spark, given, ok):
    assert value(spark, checks.national_id_valid(F.col("t").cast("string")), t=given) is ok


@pytest.mark.parametrize(("given", "rest"), [("TR33 0006 1005 1978 6457 8413 26", 1), ("TR330006100519786457841327", 2), ("TR33", None), (None, None)])
def test_iban(spark, given, rest):
    found = value(spark, checks.iban_remainder(F.col("t").cast("string")), t=given)
    assert found == rest if rest in (1, None) else found != 1


def test_chassis(spark):
    assert value(spark, checks.chassis_shape(F.col("t")), t="1HGCM82633A004352") is True
    assert value(spark, checks.chassis_shape(F.col("t")), t="12345678901234567") is False


def test_references_by_name_and_number(spark):
    cases = [
        ("TBK 6. madde ne diyor", "6098", "6"), ("madde 53 nedir", "", "53"), ("İş Kanunu m. 25", "4857", "25"), ("TBK 344", "6098", "344"), ("TMK 166 maddesi", "4721", "166"), ("4857 geçici madde 6", "4857", "Geçici 6"),
        ("m.3/a", "", "3/A"), ("4857 sayılı Kanun 5 inci madde, madde 7", "4857", "5"), ("Türk Borçlar Kanunu mu Borçlar Kanunu mu", "6098", ""), ("tbkx 5", "", ""), ("", "", ""), (None, "", ""),
    ]
    df = spark.createDataFrame(cases, "t string, k string, m string").select("*", text.law_reference("t").alias("gk"), text.article_reference("t").alias("gm"))
    assert [(r.t, r.gk, r.gm) for r in df.collect()] == cases


def test_heads_of_decisions(spark):
    heads = ["İçtihat Metni T.C.", "DANIŞTAY 2. DAİRE 2019/55 E.", "ONUNCU DAİRE", "İDARİ DAVA DAİRELERİ KURULU", "TEMYİZ EDEN (DAVACI) : A. B.", "YARGILAMA SÜRECİ :", "Taraflar arasında görülen dava sonucunda", "Y A R G I T A Y K", "NUMARASI : 2011/199", "Hüküm temyiz edilmiş olmakla incelendi", "ÜYE", "DAVA : ....", "T.C."]
    body = ["Davacı işyerinde çalıştığını ileri sürmüştür.", "Üyelik aidatı ödenmemiştir.", "Dairesince verilen karar bozulmuştur.", "SONUÇ : Kararın bozulmasına"]
    df = spark.createDataFrame([(x,) for x in heads + body], "x string").select("x", text.is_header(F.col("x")).alias("h"))
    assert {r.x for r in df.filter("h").collect()} == set(heads)


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def test_small_text_functions(spark):
    assert _one(spark, "Hani şu kira uyarlama dilekçesi", text.simplified_query("t")) == "kira uyarlama" and _one(spark, "şu dava", text.simplified_query("t")) == "şu dava"
    assert _one(spark, "Ücret ödenir. (Ek: 1/2/2003-4857/1 md.)  Süre (Değişik madde) işler.", text.without_notes("t")) == "Ücret ödenir. Süre (Değişik madde) işler."
    assert _one(spark, "**Madde** `5`\n# Ad", text.without_markdown("t")) == " Madde 5 Ad"
    long = "Birinci cümle " + "uzar " * 24 + "biter. " + "İkinci cümle " + "uzar " * 40
    assert _one(spark, long, text.own_words("t")) == long[: long.index("biter. ") + 6] + " …" and _one(spark, "kısa  metin", text.own_words("t")) == "kısa metin"
    cited = "Dava açıldı. Mahkemece 4857 sayılı Kanunun 19 uncu maddesi uyarınca karar verildi. Son."
    assert _one(spark, cited, text.citation_sentence("t", F.lit("19"))) == "Mahkemece 4857 sayılı Kanunun 19 uncu maddesi uyarınca karar verildi."
    assert _one(spark, cited, text.citation_sentence("t", F.lit("9"))) == "" and _one(spark, "Karar m. 3/A gereğince burada verilmiştir bile!", text.citation_sentence("t", F.lit("3/A"))).endswith("bile!")
    assert _one(spark, "a" * 60 + "\nX" + "b" * 60, text.snippet("t", F.lit(62), F.lit(63), 3)) == "…aa X".replace("aa X", "aa Xbbb") + "…"
    assert _one(spark, "Tanık Zübeyde Karaoğlan Mahkemesi Beypazarı", text.unprotected_runs("t", ("tanık", "mahkemesi"))) == ["Zübeyde Karaoğlan", "Beypazarı"]
    assert _one(spark, " YOK.", text.hypothetical_text("t")) == "" and _one(spark, "İşveren ücret ödemekle yükümlüdür.", text.hypothetical_text("t")) == "İşveren ücret ödemekle yükümlüdür."
    assert tuple(_one(spark, '"kira tespiti | Danıştay"', text.search_term("t"))) == ("kira tespiti", "danistay") and tuple(_one(spark, "yok", text.search_term("t"))) == ("", "")
    names = [("Ali Veli", True), ("Ali", False), ("Ali Mahkemesi", False), ("Can Cem", False)]
    got = spark.createDataFrame(names, "n string, e boolean").withColumn("t", F.lit("dün ALİ  VELİ geldi")).select("e", text.name_plausible("n", "t", ("mahkemesi",)).alias("g")).collect()
    assert all(r.e == r.g for r in got)
