"""Residue and notices against sound provisions that merely speak of them."""

import os

import pytest
from pyspark.sql import functions as F

from terazi.llm import residue as r
from terazi.llm.queries import QUERIES

RESIDUE = [
    "Access denied. Your request 123 was blocked by the firewall policy.", "Çok fazla istek gönderildi (429). 30 saniye sonra tekrar deneyiniz.", "Tarayıcınız betik çalıştırmayı desteklemiyor ya da kapatılmış; sayfa gösterilemiyor. (3)",
    "You need to enable JavaScript to run this app.", "Belge bulunamadı (hata kodu 404).", "Bu içeriği görüntülemek için tarayıcınızda JavaScript'i etkinleştirin. Ref 12", "Buraya metin giriniz", "NaN", "null", "[object Object]", "#REF!",
    "(metin eklenecek)", "@@GOVDE@@", "<%= metin %>", "TODO: madde metni", "Örnek metin örnek metin örnek metin", "Deneme kaydı 3, silinecek.", "asdf asdf deneme 4", "xxxxx xxxxx xxxxx", "{0}", "%(metin)s", "503 Service Unavailable. nginx",
    "<html><head><title>Error</title></head><body>Bad Request 4</body></html>", "Hata 404 - Dosya ya da dizin yok. Ana sayfaya dönün.", "Giriş | Yardım | İletişim\nYükleniyor", "Oturumunuzun süresi doldu, lütfen yeniden giriş yapınız.",
    "Sistemimiz bakım çalışması nedeniyle geçici olarak hizmet dışıdır. Tahmini süre 2 saat.", "Yetkili birim {KURUM_ADI} kararını öder.", "Bu ${kurum.ad} öder.", "Mera [___] alanlarında öder.", "[●] öder.", "[KURUM ADI] öder.", "«birim» öder.", "&lt;TARİH&gt; öder.",
    "XXX Bakanlığı öder.", "Lorem ipsum dolor sit amet", "%madde.ad% öder.", "$madde.no$ öder.", "(Mülga: [[il_adi]] 1/1/2001-1/2 md.)",
]
SOUND = [
    "(Mülga)", "(Mülga: 15/05/2005-5334/11 md.)", "Bu Yönetmelik hükümlerini Bakan yürütür.", "Matbu formdaki boşluklar (……………) ilgilinin el yazısıyla doldurulur.", "Oturum süresi dolan kullanıcıya yeniden giriş yapma imkânı verilir.",
    "5 sayılı Kararın eki listede yer alan belge bulunamadı kaydıyla iade edilmez.", "A = {1, 2, 3} kümesindeki kodlar köşeli parantez [ ] içinde gösterilir.", "Hata kodu bildiren istekler en geç iki gün içinde yanıtlanır.",
    "Şablon sözleşmelerde yer tutucu alanların doldurulmadan imzalanması yasaktır.", "Elektronik başvuru sayfası JavaScript kullanmadan da erişilebilir olacak şekilde tasarlanır.", "Yüzde işareti (%) ve dolar ($) simgesi tutardan önce yazılmaz.",
    "Sistem bakımda olduğu sürede yapılamayan bildirimler ertesi iş günü kabul edilir.", "", "Isı iletkenlik değeri λ = 0,035 W/mK olarak alınır.",
]


def test_own_signs(spark):
    df = spark.createDataFrame([(t, True) for t in RESIDUE] + [(t, False) for t in SOUND] + [(None, False)], "t string, e boolean")
    wrong = df.withColumn("g", r.own_signs(F.col("t"))).filter("g <> e").collect()
    assert wrong == []


@pytest.mark.parametrize(
    ("url", "ok"),
    [
        ("https://mevzuat.example/MevzuatMetin/21.3.10102.pdf", True), ("https://mevzuat.example/undefined-terimler/8.5.1.pdf", True), ("https://mevzuat.example/Error404Kurulu/8.5.1.pdf", True), ("https://mevzuat.example/hata%20bildirimi/8.5.1.pdf", True),
        ("https://mevzuat.example/MevzuatMetin/None.5.None.pdf", False), ("https://mevzuat.example/MevzuatMetin/{{no}}.pdf", False), ("https://mevzuat.example/giris?ReturnUrl=%2F21.3.1.pdf", False), ("https://mevzuat.example/MevzuatMetin/%7Btur%7D.5.1.pdf", False),
        ("https://mevzuat.example/bakim.html", False), ("https://mevzuat.example/#", False), ("javascript:void(0)", False), ("null", False), ("buraya adres gelecek", False), ("https://mevzuat.example/MevzuatMetin/undefined.undefined.1.pdf", False),
    ],
)
def test_addresses(spark, url, ok):
    assert spark.createDataFrame([(url,)], "u string").select(r.document_address(F.col("u"))).first()[0] is ok


def _laws(spark, rows):
    return spark.createDataFrame(rows, "kayit_no long, tur_adi string, mevzuat_no string, tertip string, pdf_url string, metinsiz boolean")


def _articles(spark, rows):
    return spark.createDataFrame([(*x, "fazla") for x in rows], "kayit_no long, mevzuat_tur string, mevzuat_no string, tertip string, mevzuat_adi string, baslik string, metin string, kalinti string")


def test_flags_of_laws(spark):
    laws = _laws(spark, [(1, "Kanun", "1", "5", "", False), (2, "Kanun", "2", "5", None, False), (3, "Kanun", "3", "5", "#", None), (4, "Kanun", "1", "5", "", True), (5, "Kanun", "9", None, "", False)])
    articles = _articles(spark, [(1, "Kanun", "1", "5", "Ad", "", "null"), (2, "Kanun", "1", "5", "Ad", "", "NaN"), (3, "Kanun", "2", "5", "Ad", "", "null"), (4, "Kanun", "2", "5", "Ad", "", "(Mülga)"), (5, None, None, None, None, None, None), (6, "Kanun", "9", None, "", "", "null")])
    judged = r.judged_articles(articles, laws)
    assert {x.kayit_no: x.kalinti for x in judged.collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True}
    got = {x.kayit_no: (x.adres_bos, x.metinsiz_yanlis) for x in r.judged_laws(laws, judged).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, False), 4: (False, False), 5: (False, True)}


def test_recurring_responses(spark):
    laws = _laws(spark, [(i, "Kanun", str(i), "5", f"https://h.example/a/{i}.pdf", False) for i in range(6)])
    notice = "Sunucu yanıt vermedi lütfen sonra deneyiniz {}"
    rows = [(i, "Kanun", str(i), "5", "Orman İşleri", "Amaç", notice.format(i)) for i in range(6)]
    rows += [(10 + i, "Kanun", str(i), "5", "Orman İşleri", "Amaç", "Orman işleri amaç dahilinde yapılır") for i in range(6)]
    rows += [(30, "Kanun", "1", "5", "Ad", "", "Yalnız burada geçen sıradan cümle")]
    got = {x.kayit_no for x in r.judged_articles(_articles(spark, rows), laws).filter("kalinti").collect()}
    assert got == set(range(6))


def _without_lists(monkeypatch):
    monkeypatch.setattr(r, "NOTICES", ())
    monkeypatch.setattr(r, "FILLERS", ())
    monkeypatch.setattr(r, "VALUES", "(?!)")


def test_notices_are_found_without_any_list(spark, monkeypatch):
    _without_lists(monkeypatch)
    laws = _laws(spark, [(i, "Kanun", str(i), "5", f"https://h.example/a/{i}.pdf", False) for i in range(40)])
    planted = ["Access denied. Your request {} was blocked by the firewall policy.", "Çok fazla istek gönderildi ({}). Sonra tekrar deneyiniz.", "Giriş | Yardım | İletişim\nYükleniyor", "Lütfen bekleyiniz, arama yapılıyor"]
    rows = [(i, "Kanun", str(i), "5", "Orman İşleri", "Amaç", planted[i % 4].format(i)) for i in range(16)]
    # Made of the terms of the others, but the only one of its kind.
    rows += [(20, "Kanun", "20", "5", "Orman İşleri", "Amaç", "Giriş | Arama | İletişim\nLütfen bekleyiniz")]
    sound = ["Kıyı şeridinde mükellefin ayıp ihbarını usulüne göre değerlendirir no {} {}.", "Ruhsat verilirken kefilin kusur oranını ücretsiz araştırır {} {}."]
    rows += [(100 + i, "Kanun", str(i), "5", "Orman İşleri", "Amaç", sound[i % 2].format("abcdefghijklmnopqrstuvyz"[i % 24] * 5, "klmnopqrst"[i % 10] * 6)) for i in range(40)]
    rows += [(200 + i, "Kanun", str(i), "5", "Orman İşleri", "Amaç", "Bu Kanun yayımı tarihinde yürürlüğe girer.") for i in range(20)]
    judged = r.judged_articles(_articles(spark, rows), laws)
    assert {x.kayit_no for x in judged.filter("kalinti").collect()} == {*range(16), 20}
    assert not judged.filter("notice").count() and judged.filter("kalinti and not recurring").count() == 1


def test_most_notices_of_the_test_tables_are_found_without_any_list(spark, monkeypatch):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    articles, laws = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("madde", "mevzuat_kaydi"))
    whole = {x.kayit_no: x.notice for x in r.judged_articles(articles, laws).filter("kalinti").collect()}
    _without_lists(monkeypatch)
    found = {x.kayit_no for x in r.judged_articles(articles, laws).filter("kalinti").collect()}
    notices = {k for k, notice in whole.items() if notice}
    # 130 of 264 over these 13,000 rows; the larger the tables, the more recurs.
    assert found - set(whole) == set() and len(found & notices) >= 0.4 * len(notices)


def test_an_address_that_names_the_body_takes_evidence_away(spark):
    laws = _laws(spark, [(i, "Kanun", str(i), "5", "https://h.example/sulama-rehberi/x.pdf" if i < 6 else None, False) for i in range(12)])
    rows = [(i, "Kanun", str(i), "5", "Ad", "", "Sulama suyu ücretsiz dağıtılır") for i in range(6)] + [(6 + i, "Kanun", str(6 + i), "5", "Ad", "", "Sunucu yanıt vermedi sonra deneyiniz") for i in range(6)]
    assert {x.kayit_no for x in r.judged_articles(_articles(spark, rows), laws).filter("kalinti").collect()} == set(range(6, 12))


def test_both_tables_come_back_whole_without_the_named_rows(spark, tmp_path):
    laws = _laws(spark, [(1, "Kanun", "1", "5", "https://h.example/a/1.pdf", False), (2, "Kanun", "2", "5", None, False), (3, "Kanun", "3", "5", "#", None), (4, "Kanun", "4", None, "", True)])
    articles = _articles(spark, [(1, "Kanun", "1", "5", "Ad", "", "null"), (2, "Kanun", "1", "5", "Ad", "", "Bakan yürütür."), (3, "Kanun", "2", "5", "Ad", "", "NaN"), (4, "Kanun", "2", "5", "Ad", "", "{0}"), (5, None, None, None, None, None, None)])
    laws.write.parquet(f"{tmp_path}/mevzuat_kaydi.parquet")
    articles.write.parquet(f"{tmp_path}/madde.parquet")
    named = {(x.kaynak, x.alan, x.kayit_no) for x in r.p4_found(spark, str(tmp_path)).collect()}
    assert named == {("madde", "metin", k) for k in (1, 3, 4)} | {("mevzuat_kaydi", "pdf_url", 3), ("mevzuat_kaydi", "metinsiz", 2)}
    for query, table, kept in (("p4_clean", articles, (2, 5)), ("p4_clean_laws", laws, (1, 4))):
        got = QUERIES[query](spark, str(tmp_path))
        assert set(got.columns) == set(table.columns)
        assert sorted(got.select(table.columns).collect()) == sorted(table.filter(F.col("kayit_no").isin(*kept)).collect())


def test_empty_tables(spark):
    laws, articles = _laws(spark, []), _articles(spark, [])
    judged = r.judged_articles(articles, laws)
    assert judged.count() == 0 and r.judged_laws(laws, judged).count() == 0
