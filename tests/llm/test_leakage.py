"""Leaked test items against a scan of all twelve-word stretches."""

import os
import random

import numpy as np
import pytest

from terazi.llm import leakage


def _data():
    rng = random.Random(9)
    word = lambda: rng.choice(["Şirket", "İtiraz", "IŞIK", "kira", "ödeme"]) + str(rng.randint(0, 60))
    items = [(i, " ".join(word() for _ in range(25)) + "?", None if i == 3 else " ".join(word() for _ in range(24))) for i in range(12)]
    items[5] = (5, items[5][1], items[4][2])
    docs = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(30))]
        item = items[d % 12]
        source = (item[1] if d % 2 else item[2] or item[1]).rstrip("?").split()
        n = rng.choice([0, 8, 11, 12, 13, 20, len(source)])
        a = rng.randint(0, max(0, len(source) - n))
        parts.append((", " if d % 3 else " - ").join(source[a : a + n]).upper().replace("i", "İ") if d % 5 == 0 else " ".join(source[a : a + n]))
        parts.append(word())
        docs.append((d, "\n".join(parts)))
    return docs, items


def _truth(docs, items):
    out = set()
    for i, q, s in items:
        for p in (q, s):
            if p:
                w = leakage.words_of(p)
                grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
                for d, t in docs:
                    x = leakage.words_of(t)
                    if any(tuple(x[k : k + 12]) in grams for k in range(len(x) - 11)):
                        out.add((d, i))
    return out


@pytest.mark.parametrize("cells", [1 << 22, 8])
def test_found_matches_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(leakage, "CELLS", cells)
    docs, items = _data()
    d = spark.createDataFrame([(*x, 1) for x in docs] + [(docs[0][0], docs[0][1], 2), (90, None, 1), (91, "", 1), (None, docs[1][1], 1)], "doc_id long, text string, item long")
    i = spark.createDataFrame([(*x, "k") for x in items], "item_id long, soru string, dayanak string, words string")
    got = leakage.leaks(d, i).filter("kosu >= 12")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == _truth(docs, items)


def test_edited_copy_scores_high(spark):
    words = [f"kelime{k}" for k in range(24)]
    edited = words[:8] + ["başka"] + words[9:16] + words[17:]
    d = spark.createDataFrame([(1, " ".join(edited)), (2, "ilgisiz " * 40)], "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(words), None)], "item_id long, soru string, dayanak string")
    got = leakage.leaks(d, i).collect()
    assert [(r.doc_id, r.item_id, r.alan) for r in got] == [(1, 7, "soru")]
    assert got[0].kosu == 8 and got[0].puan > 0.75


def test_an_exact_copy_hides_no_edited_one(spark, tmp_path):
    words = [f"kelime{k}" for k in range(24)]
    edited = words[:8] + ["başka"] + words[9:16] + words[17:]
    d = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(words)), (3, " ".join(words[:7]) + " ilgisiz" * 40)], "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(words), None)], "item_id long, soru string, dayanak string")
    every = {r.doc_id: r.puan for r in leakage.leaks(d, i).collect()}
    assert set(every) == {1, 2, 3} and every[1] > 0.75 and every[2] == 1 and every[3] < 0.5
    assert {r.doc_id: r.puan for r in leakage.leaks(d, i, least=0.5).collect()} == {k: every[k] for k in (1, 2)}
    assert {r.doc_id for r in leakage.leaks(d, i, unbroken=True).filter("kosu >= 12").collect()} == {2}
    d.write.parquet(f"{tmp_path}/documents.parquet")
    i.write.parquet(f"{tmp_path}/olcum_ogesi.parquet")
    assert {r.doc_id for r in leakage.p8_edited(spark, str(tmp_path)).collect()} == {1, 2}
    assert {r.doc_id for r in leakage.p8_found(spark, str(tmp_path)).collect()} == {2}


@pytest.mark.parametrize(("rate", "least"), [(0.05, 0.99), (0.1, 0.98), (0.2, 0.9), (0.3, 0.6)])
def test_recall_of_edited_copies(spark, rate, least):
    """Passages of the test tables with words replaced, dropped and added, amid other text."""
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("the test tables are not here")
    rng = random.Random(int(rate * 100))
    items = spark.read.parquet("/root/testdata/sf0.01/olcum_ogesi.parquet").select("item_id", "soru", "dayanak")
    rows, truth = [], set()
    for r in items.collect():
        for passage in filter(None, (r.soru, r.dayanak)):
            edited = []
            for w in leakage.words_of(passage):
                change = rng.random()
                edited += [] if change < rate / 4 else [w, "eklenen"] if change < rate / 2 else [f"başka{rng.randint(0, 99)}"] if change < rate else [w]
            truth.add((len(rows), r.item_id))
            rows.append((len(rows), " ".join(["önce"] * 30 + edited + ["sonra"] * 30)))
    got = {(r.doc_id, r.item_id) for r in leakage.edited_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    recall = len(truth & got) / len(truth)
    print("recall at", rate, recall)
    assert recall >= least


def test_texts_of_one_id_count_each(spark):
    words = [f"kelime{k}" for k in range(24)]
    d = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (1, " ".join(words[:13]))], "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(words), None)], "item_id long, soru string, dayanak string")
    assert [(r.kosu, r.puan) for r in leakage.leaks(d, i).collect()] == [(24, 1.0)]


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, soru string, dayanak string")
    assert leakage.leaks(d, i).count() == 0
    assert leakage.leaks(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), i).count() == 0


def test_alignment():
    a = np.arange(10)
    assert leakage.align(a, a) == (20, 10)
    assert leakage.align(a, np.delete(a, 5)) == (17, 5)
    assert leakage.align(a, np.array([50, 51])) == (0, 0)
