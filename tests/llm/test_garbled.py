"""Wrong encodings: made damage is found and undone, sound text is left alone."""

import random

import pytest
from pyspark.sql import functions as F

from terazi.llm import garbled

SOUND = [
    "Côte d'Ivoire ile yapılan protokol hükümleri saklıdır.",
    "SÃO TOMÉ çıkışlı kahve için menşe belgesi aranır.",
    "Ålesund ve Þingeyri limanlarından gelen gemiler bildirilir.",
    "Ürün adı “Façade Crème” olan boyalar ve Český menşeli camlar listelenir.",
    "Württemberg ve Łódź merkezli şirketlerin şubeleri kayda alınır.",
    "Ücret gerçekten ödendi mi? Bu husus yazılı olarak sorulur.",
    "Depo alanı 250 m² ve tavan yüksekliği 3½ metreden az olamaz.",
    "Ambalajda “Зелёная линия” ibaresi bulunan ürünler ayrı beyan edilir.",
    "HÂKİM ve KÂTİP kadroları ile MAHKÛM işlemleri ayrı tutulur.",
]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    who = "işçinin alıcının yükümlünün kooperatifin öğrencinin müdürlüğün sigortacının tüketicinin değerlendirme şirketin".split()
    what = "ödeme emrini tapu kaydını görev itirazını çalışma iznini özel sözleşmesini ihbar süresini başvurusunu ücret bordrosunu".split()
    how = "açıkça yazılı olarak müştereken süresinde gözetilerek karşılığında değiştirir yürütür düzenler üstlenir çıkarır".split()
    start = "İtiraz Çalışma Ödeme Şirket Üretim Öğrenci Değerlendirme Işık".split()
    return [" ".join([rng.choice(start), rng.choice(who), rng.choice(what), rng.choice(how), rng.choice(who), rng.choice(what), rng.choice(how)]) + "." for _ in range(1_500)] + SOUND * 12


@pytest.fixture(scope="module")
def model(spark, corpus):
    return garbled.train(spark.createDataFrame([(t,) for t in corpus], "metin string"), "metin")


CHAINS = [(("cp1252", "utf-8"),), (("latin-1", "utf-8"),), (("cp1254", "utf-8"),), (("mac-roman", "utf-8"),), (("cp1250", "utf-8"),), (("cp857", "utf-8"),), (("latin-1", "cp1254"),), (("cp1252", "utf-8"), ("cp1252", "utf-8")), (("cp1251", "utf-8"),), (("koi8-r", "utf-8"),), (("cp866", "utf-8"),), (("latin-1", "utf-8"), ("mac-roman", "utf-8")), (("mac-roman", "utf-8"), ("cp850", "utf-8"))]


@pytest.mark.parametrize("chain", CHAINS, ids=str)
def test_damage_is_undone(model, corpus, chain):
    made = [(t, bad) for t in corpus[:300] if (bad := garbled.damage(t, chain)) and bad != t]
    found = [garbled.repair(bad, model) for _, bad in made]
    assert len(made) > 40
    assert sum(d for d, _ in found) / len(made) >= 0.99
    assert sum(f == t for (t, _), (_, f) in zip(made, found, strict=True)) / len(made) >= 0.97


def test_damage_in_part(model):
    bad, text = garbled.repair("Yazılı olarak düzenler. " + garbled.damage("Değerlendirme süresinde yürütür.", (("cp1252", "utf-8"),)), model)
    assert bad and text == "Yazılı olarak düzenler. Değerlendirme süresinde yürütür."


@pytest.mark.parametrize("text", [*SOUND, "", "(Mülga)", "öde­me emri", "ｙａｚıｌı olarak"])
def test_sound_text_stays(model, text):
    assert garbled.repair(text, model) == (False, text)


@pytest.mark.parametrize("text", ["уürürlüğe gіrer", "tаrihinde", "Koмisyonсa", "во вода", "λ = 0,035 W/mK", "Ｍüｌｇａ", "ﬁkri"])
def test_written_forms_are_no_damage(model, text):
    assert garbled.repair(text, model) == (False, text)


def test_single_byte_text_read_in_another_script(model, corpus):
    chain = (("cp1251", "cp1254"),)
    made = [(t, bad) for t in corpus[:300] if (bad := garbled.damage(t, chain)) and bad != t]
    found = [garbled.repair(bad, model) for _, bad in made]
    assert len(made) > 40 and sum(d for d, _ in found) / len(made) >= 0.99


def test_the_margin_comes_from_held_out_rows(spark, model):
    rows = spark.createDataFrame([("değişik ödeme şartı çıkarır",)] * 5, "t string")
    assert 1.0 <= model.margin <= 8.0
    assert garbled.validated_margin(rows, model) >= 1.0 and garbled.validated_margin(rows.limit(0), model) >= 1.0


def test_a_letter_is_likelier_where_one_is_lost(model):
    assert model.gain_of_letters("öde?e") < model.gain_of_letters("?alışma") and model.gain_of_letters("?alışma") > 0


@pytest.mark.parametrize("text", ["ola�an ücret", "Hastal?k h?linde ödenir", "?tiraz? yazılı yapılır", "resm? ödeme emri"])
def test_lost_letters_are_cases(model, text):
    assert garbled.repair(text, model)[0]


def test_rows(spark, model, corpus):
    bad = garbled.damage(corpus[0] + " İş.", (("cp1252", "utf-8"),))
    df = spark.createDataFrame([(1, bad, "x"), (1, bad, "y"), (2, None, "z"), (3, "", None), (4, "Ölçü " * 20_000, "")], "kayit_no long, metin string, _text string")
    got = sorted((r.kayit_no, r.hasarli) for r in garbled.restored(df, "kayit_no", "metin", model).collect())
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "kayit_no long, metin string")
    model = garbled.train(empty, "metin")
    assert garbled.restored(empty, "kayit_no", "metin", model).count() == 0
    assert garbled.train(spark.createDataFrame([(None,)], "metin string"), "metin").margin >= 1


def test_counts_cover_all_rows(spark):
    df = spark.createDataFrame([("ab ab",)] * 500, "metin string")
    cells = df.select(F.col("metin")).mapInArrow(garbled._counts, "cell int, n long").groupBy().agg(F.sum("n")).first()[0]
    assert cells == 500 * len("    ab  ab  ") - 2 * df.rdd.getNumPartitions()
