"""Personal data: places by type, traps, placeholders and pseudonyms."""

import datetime
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terazi.llm import personal as p

KEY = b"a key of the tests"

CASES = [
    ("Davacı Pınar Şükrü Narzıkan, kimlik numarası 70311993698 ile başvurmuştur.", [("KISI", "Pınar Şükrü Narzıkan"), ("KIMLIK", "70311993698")]),
    ("Davacı vekili Av. MEHMET MURRAKONLU, T.C. 672 317 197 36 ile", [("KISI", "MEHMET MURRAKONLU")]),
    ("Tanık Derya Tarberişli-Veltulgan beyanında 0-570-201-08-15 numaralı hattan", [("KISI", "Derya Tarberişli-Veltulgan"), ("TEL", "0-570-201-08-15")]),
    ("Tel:0590 493 84 92", [("TEL", "0590 493 84 92")]),
    ("irtibat 0 (590) 907 37 17.", [("TEL", "0 (590) 907 37 17")]),
    ("olarak (0580) 277 5010 ve", [("TEL", "(0580) 277 5010")]),
    ("beyanında +90 255 726 23 27 numaralı", [("TEL", "+90 255 726 23 27")]),
    ("olarak 90 520 508 48 48 ve", [("TEL", "90 520 508 48 48")]),
    ("olarak +905207250215 ve gulten+dava @ posta.example bildirilmiştir", [("TEL", "+905207250215"), ("EPOSTA", "gulten+dava @ posta.example")]),
    ("İhtarname tarzikan-huseyin [at] avukat [nokta] ornek [nokta] example adresinden", [("EPOSTA", "tarzikan-huseyin [at] avukat [nokta] ornek [nokta] example")]),
    ("İhtarname elif.pis(at)buro.example adresinden", [("EPOSTA", "elif.pis(at)buro.example")]),
    ("Vergi Kimlik No 8258022573 ile", [("KIMLIK", "8258022573")]),
    ("Davalıya ait Göktepecik mah. Ormanardı Sk. No:182/9 07620 Konya adresine", [("ADRES", "Göktepecik mah. Ormanardı Sk. No:182/9 07620 Konya")]),
    ("Davalıya ait 764. Sok. No:94/2 Ankara adresine", [("ADRES", "764. Sok. No:94/2 Ankara")]),
    ("DEREÜSTÜ MAH. TAŞOLUK BULVARI NO. 11 KAT 4 DAİRE 17 ESENKUYU / KAYSERİ adresinde", [("ADRES", "DEREÜSTÜ MAH. TAŞOLUK BULVARI NO. 11 KAT 4 DAİRE 17 ESENKUYU / KAYSERİ")]),
    ("Karşıdere Köyü No 70 D: 14 Esenkuyu/Mersin adresinde", [("ADRES", "Karşıdere Köyü No 70 D: 14 Esenkuyu/Mersin")]),
    ("&lt;p&gt;Cemal KERLEMCİ ile Tuncay Gümpındıran arasındaki", [("KISI", "Cemal KERLEMCİ"), ("KISI", "Tuncay Gümpındıran")]),
    ("Başkan Sevgi Tarvanlı\nÜye Rıza Gürdovacı", [("KISI", "Sevgi Tarvanlı"), ("KISI", "Rıza Gürdovacı")]),
]
TRAPS = [
    "Takip 37674251096 takip numarası ile açılmıştır.", "Hesap no 3167457775 üzerinden işlem görmüştür.", "Fatura seri 222331800361, 12/08/2015 günlüdür.",
    "Ödeme TR87 2633 6224 6395 9289 2153 33 hesabına yapılmıştır.", "Davacı A. K. ve tanık M... S... dinlendi.", "BAŞKAN ÜYE ÜYE", "12345678901",
    "Ankara Bölge Adliye Mahkemesi, Türk Borçlar Kanunu ile Hukuk Muhakemeleri Kanunu hükümlerini tartışmıştır.", "[KISI_2] adına kayıtlı [TEL_3] numarası",
    "Kanselhar Tekstil Sanayi ve Ticaret A.Ş. ile Lemlemgut Yapı Ltd. Şti.", "Zeytinkaya Belediye Başkanlığı ile Gülbeyli Sulama Birliği arasındaki protokol",
    "Taşoluk Mahallesi sınırlarındaki 816 ada 79 parsel orman sayılmıştır.", "Kullanıcı adı olarak @zindor biçimi kullanılmıştır.", "Esas No : 2016/13753", "",
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_places(text, expected):
    found = [(k, text[a:b]) for a, b, k in p.find_personal(text)]
    assert [x for x in expected if x not in found] == []
    assert [x for x in found if x not in expected and x != ("KIMLIK", "672 317 197 36")] == []


@pytest.mark.parametrize("text", TRAPS)
def test_traps(text):
    assert p.find_personal(text) == []


def test_mask_changes_nothing_else():
    text = "<p>Tanık Kerem Kerpındıran beyanında 0570.784.70.56 numaralı.</p>"
    masked = p.mask(text, KEY)
    assert masked.startswith("<p>Tanık [KISI ") and masked.endswith(" numaralı.</p>") and "[TEL 0570." in masked
    assert p.find_personal(masked) == []
    assert p.mask(masked, KEY) == masked


def test_equal_values_stay_linked():
    assert p.placeholder("KEREM KERPINDIRAN", "KISI", KEY) == p.placeholder("Kerem Kerpındıran", "KISI", KEY)
    a, b = p.placeholder("0570 784 70 56", "TEL", KEY), p.placeholder("0570.784.70.56", "TEL", KEY)
    digits = lambda s: [c for c in s if c.isdigit()]
    assert digits(a) == digits(b) and p.placeholder("0570 784 70 57", "TEL", KEY) != a
    assert len({p.placeholder(m, "EPOSTA", KEY) for m in ("ali@x.com", "ALİ @ x.com", "ali [at] x [nokta] com", "ali(at)x.com")}) == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(2, 10**10))
def test_feistel_is_a_permutation(value, size):
    value %= size
    there = p.feistel(value, size, b"k", b"t")
    assert 0 <= there < size and p.feistel_back(there, size, b"k", b"t") == value


def test_feistel_covers_a_small_range():
    assert sorted(p.feistel(i, 97, b"k", b"t") for i in range(97)) == list(range(97))


def test_pseudonyms_keep_their_format():
    other = p.pseudonym_id("10000000146", KEY)
    assert p.valid_id(other) and other != "10000000146" and p.pseudonym_id("10000000146", b"another") != other
    for tax in ("0000000001", "1234567890", "8258022573"):
        off = int(tax[9]) - p.tax_check_digit(tax[:9])
        changed = p.pseudonym_tax(tax, KEY)
        assert len(changed) == 10 and (int(changed[9]) - p.tax_check_digit(changed[:9]) - off) % 10 == 0 and changed != tax
    assert p.pseudonym_phone("05707847056", KEY).startswith("0570")
    day = datetime.date(1980, 2, 29)
    assert p.pseudonym_date(p.pseudonym_date(day, KEY), KEY, p.feistel_back) == day
    assert p.pseudonym_date(datetime.date(1800, 1, 1), KEY) == datetime.date(1800, 1, 1)


def test_known_check_digit():
    # The worked example of the tax office's rule.
    assert p.tax_check_digit("123456789") == 0


def test_dates_of_birth_are_masked_in_their_format():
    text = "Doğum tarihi: 12.05.1980 olan tanık 03/11/2001 doğumlu kardeşi ve 01.02.2020 tarihli karar, d.t. 31.02.1980"
    assert [k for *_, k in p.find_personal(text, births=True)] == ["DOGUM"] * 3 and p.find_personal(text) == []
    masked = p.mask(text, KEY)
    assert re.fullmatch(r"Doğum tarihi: \[DOGUM \d{2}\.\d{2}\.\d{4}\] olan tanık \[DOGUM \d{2}/\d{2}/\d{4}\] doğumlu kardeşi ve 01\.02\.2020 tarihli karar, d\.t\. \[DOGUM [0-9a-f]{8}\]", masked)


@pytest.mark.parametrize(
    ("text", "name"),
    [("Tanık Yağız Bozkurt dinlendi", "Yağız Bozkurt"), ("Müvekkil Ekrem Aydoğan geldi", "Ekrem Aydoğan"), ("TANIK POYRAZ AKTÜRK dinlendi", "POYRAZ AKTÜRK"), ("dosyada Nisa Karaca, T.C. kimlik no verilmeden", "Nisa Karaca"), ("Başkan Yağız Bozkurt\nÜye", "Yağız Bozkurt")],
)
def test_names_outside_the_list_by_their_place(text, name):
    assert [text[a:b] for a, b, k in p.find_personal(text, frozenset()) if k == "KISI"] == [name]


def test_names_are_learnt_from_the_collection(spark):
    unlisted = ("Yağız", "Nisa", "Poyraz", "Ekrem")
    rows = [(f"Tanık {n} Soyad{'abcdefgh'[i]}lı beyanında geldi. Sonra {n} Başkaca{'abcdefgh'[i]}n da geldi.",) for n in unlisted for i in range(6)]
    rows += [("Davacı Ankara Belediyesi geldi. Ankara Bölge Adliye Mahkemesi karar verdi. İzmir Limanı doldu.",)] * 9 + [(None,), ("",)]
    texts = spark.createDataFrame(rows, "text string")
    known = p.known_names(texts, frozenset())
    assert all(p.turkish_lower(n) in known for n in unlisted) and not any(w in known for w in ("ankara", "izmir", "tanık", "davacı"))
    free = "Oraya Nisa Karaca ve Poyraz Aktürk geldi, İzmir Limanı açıldı"
    assert [free[a:b] for a, b, _ in p.find_personal(free, known)] == ["Nisa Karaca", "Poyraz Aktürk"]
    assert "yağız" not in p.known_names(texts.limit(0), frozenset())


def test_recall_of_names_held_out_of_the_list(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    texts = p.decisions(spark, folder)
    whole = {tuple(x) for x in p.personal_places(texts).collect()}
    half = frozenset(n for n in p.FIRST_NAMES if sum(n.encode()) % 2)
    found = {tuple(x) for x in p.personal_places(texts, p.known_names(texts, half)).collect()}
    assert len(found & whole) >= 0.98 * len(whole) and len(found - whole) <= 0.01 * len(whole)


def test_key_of_the_session(spark):
    assert p.session_key(spark) != p.session_key(spark)
    spark.conf.set(p.KEY_SETTING, "ours")
    try:
        assert p.session_key(spark) == b"ours"
    finally:
        spark.conf.unset(p.KEY_SETTING)


def test_rows(spark):
    t = CASES[0][0]
    long = "dolgu metni. " * 20_000 + t
    rows = [("karar", "a", t, 1), ("karar", "a", t, 2), ("karar", "b", None, 1), ("karar", "c", "", 1), ("karar", None, t, 1), ("karar", "d", long, 1)]
    df = spark.createDataFrame(rows, "kaynak string, belge_id string, text string, bas int")
    got = sorted((r.belge_id or "", r.tur, r.bas) for r in p.personal_places(df).collect())
    assert got == sorted([(k, "KISI", 8 + n) for k, n in (("", 0), ("a", 0), ("d", 13 * 20_000))] + [(k, "KIMLIK", 46 + n) for k, n in (("", 0), ("a", 0), ("d", 13 * 20_000))])
    masked = {r.belge_id: r.maskeli for r in p.masked_texts(df).collect()}
    assert masked["b"] is None and masked["c"] == ""
    assert p.personal_places(df.limit(0)).count() == 0
