"""Shared stretches against a brute-force scan of all windows."""

import random
import re

import pytest

from terazi.llm import shared_spans as ss


def brute(texts, size):
    seen = {}
    for d, t in texts.items():
        for i in range(len(t) - size + 1):
            seen.setdefault(t[i : i + size], set()).add(d)
    out = set()
    for d, t in texts.items():
        marked = [False] * len(t)
        for i in range(len(t) - size + 1):
            if len(seen[t[i : i + size]]) > 1:
                marked[i : i + size] = [True] * size
        i = 0
        while i < len(t):
            if marked[i]:
                j = i
                while j < len(t) and marked[j]:
                    j += 1
                out.add((d, i + 1, j - i))
                i = j
            else:
                i += 1
    return out


def corpus(rng, n=24):
    word = lambda: "".join(rng.choice("abcdeğşı") for _ in range(rng.randint(2, 9)))
    text = lambda k, stop=0.12: " ".join(word() + ("." if rng.random() < stop else "") for _ in range(k))
    shared = [text(60), text(90), text(70, 0.0), "x" * 700]
    texts = {}
    for d in range(n):
        parts = [text(rng.randint(5, 50))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, 80)
            parts += [s[a : a + rng.randint(250, 600)], text(rng.randint(1, 20))]
        texts[d] = " ".join(parts)
    texts[100], texts[101] = texts[0], texts[0]
    return texts


def test_matches_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(random.Random(seed))
        df = spark.createDataFrame([(d, t, "y") for d, t in texts.items()] + [(200, None, ""), (201, "", ""), (0, texts[0], "tekrar"), (None, texts[0], "")], "doc_id long, text string, h string")
        got = {(r.doc_id, r.bas, r.uzunluk) for r in ss.shared_stretches(df).collect()}
        assert got == brute(texts, 300)


def test_many_surroundings_take_the_windows(spark, monkeypatch):
    monkeypatch.setattr(ss, "SURROUNDINGS", 2)
    texts = corpus(random.Random(3), 18)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.bas, r.uzunluk) for r in ss.shared_stretches(df).collect()}
    assert got == brute(texts, 300)


def test_repeats_within_one_document_do_not_count(spark):
    t = "Bir cümle burada durur. Sonra bir başka cümle gelir ve uzar gider. " * 10
    df = spark.createDataFrame([(1, t), (2, "başka " * 80)], "doc_id long, text string")
    assert ss.shared_stretches(df).count() == 0


def test_share_of_every_document(spark):
    t = "Bir cümle burada durur. " * 20
    df = spark.createDataFrame([(1, t), (2, t), (3, None), (4, ""), (5, "kısa")], "doc_id long, text string")
    got = {r.doc_id: (r.ortak, r.pay) for r in ss.shared_share(df).collect()}
    assert got == {1: (len(t), 1.0), 2: (len(t), 1.0), 3: (0, 0.0), 4: (0, 0.0), 5: (0, 0.0)}


def test_empty_table(spark):
    assert ss.shared_stretches(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_slices_of_long_texts(spark, monkeypatch):
    texts = corpus(random.Random(5), 14)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    whole = sorted(tuple(r) for r in ss.shared_stretches(df).collect())
    rows = ss.find_seeds(df.selectExpr("doc_id d", "text"), 300).distinct().collect()
    import pyarrow as pa

    monkeypatch.setattr(ss, "_BATCH_CHARS", 350)
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array(list(texts.values()))], ["d", "text"])
    sliced = set()
    for ids, offsets, codes, ends in ss._batched(iter([batch]), 300):
        start, length, h = ss.seeds_of(codes, ends, ss._Hasher(), 300)
        of = [int(x) for x in __import__("numpy").searchsorted(ends, start, side="right")]
        begins = [0, *ends[:-1]]
        sliced |= {(int(ids[o]), int(s - begins[o] + offsets[o]), int(n)) for o, s, n in zip(of, start, length, strict=True)}
    assert {(r.d, r.pos, r.len) for r in rows} <= sliced
    assert whole


def brute_kept(texts, size):
    seen, out = set(), {}
    for d in sorted(texts):
        t = texts[d]
        windows = [t[i : i + size] for i in range(len(t) - size + 1)]
        marked = [False] * len(t)
        for i, w in enumerate(windows):
            if w in seen:
                marked[i : i + size] = [True] * size
        kept = ""
        for part in re.split(r"(?<=[.!?…])(?=\s)|(?<=\n)", t):
            # The white space in front of a sentence belongs to the one before.
            lead = len(part) - len(part.lstrip())
            kept_lead, body = part[:lead], part[lead:]
            out.setdefault(d, []).append((kept_lead, body))
        pieces, at, kept, gone = out[d], 0, [], True
        for k, (lead, body) in enumerate(pieces):
            if k == 0 or not gone:
                kept.append(lead)
            a, b = at + len(lead), at + len(lead) + len(body.rstrip())
            gone = b > a and all(marked[a:b])
            if not gone:
                kept.append(body)
            at += len(lead) + len(body)
        out[d] = "".join(kept)
        seen.update(windows)
    return out


@pytest.mark.parametrize("many", [64, 2])
def test_repeated_sentences_go_and_their_first_holder_keeps_them(spark, monkeypatch, many):
    monkeypatch.setattr(ss, "SURROUNDINGS", many)
    texts = corpus(random.Random(7 + many), 18)
    rows = [(d, t, 9) for d, t in texts.items()] + [(300, None, 1), (301, "", 1), (None, texts[0], 1), (302, texts[0], 1), (302, texts[1], 1)]
    got = [(r.doc_id, r.text, r.cikan) for r in ss.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, cikan int")).collect()]
    expected = brute_kept(texts, 300)
    assert len(got) == len(rows)
    for d, t in texts.items():
        assert [x for x in got if x[0] == d] == [(d, expected[d], len(t) - len(expected[d]))]
    assert sum(len(t) - len(expected[d]) for d, t in texts.items()) > 1000
    assert (300, None, 0) in got and (301, "", 0) in got and (None, texts[0], 0) in got and {x[1] for x in got if x[0] == 302} == {texts[0], texts[1]}


def test_uncovered():
    text = "Bir iki. Üç dört!\nBeş altı. Son"
    assert ss.uncovered(text, [(0, 18)]) == "Beş altı. Son"
    assert ss.uncovered(text, [(1, 18)]) == "Bir iki. Beş altı. Son"
    assert ss.uncovered(text, [(0, 8), (18, 31)]) == "Üç dört!\n"
    assert ss.uncovered(text, []) == text
