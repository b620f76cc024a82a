"""Similar texts against all pairs, and the estimate against the true similarity."""

import random

import numpy as np

from terazi.llm import near_duplicates as nd


def _corpus():
    rng = random.Random(7)
    vocabulary = [f"kelime{i}" for i in range(400)]
    texts, n = {}, 0
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(120)]
        for copy in range(4):
            w = list(words)
            for _ in range(copy * 4):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[f"d{n:03d}"] = " ".join(w)
            n += 1
    texts["d900"], texts["d901"] = texts["d000"], "<p>" + texts["d000"].upper().replace("I", "İ") + "</p>"
    texts["d902"] = "kısa metin"
    return texts


def _truth(texts):
    sets = {}
    for k, t in texts.items():
        w = nd.plain_words(t)
        if len(w) >= nd.MIN_WORDS:
            sets[k] = set(zip(w, w[1:], w[2:], strict=False))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


def test_pairs_match_brute_force(spark):
    texts = _corpus()
    rows = [(k, t, 1) for k, t in texts.items()] + [("d000", texts["d000"], 2), ("d950", None, 1), ("d951", "", 1), (None, texts["d001"], 1)]
    df = spark.createDataFrame(rows, "id string, text string, key int")
    pairs, members = nd.near_duplicates(df)
    got = {(r.id_a, r.id_b) for r in nd.similar_ids(pairs, members).collect()}
    assert got == _truth(texts)
    groups = {r.id: (r.grup, r.baglanti) for r in nd.duplicate_groups(pairs, members).collect()}
    assert set(groups) == {k for k in texts if k != "d902"}
    assert groups["d900"][0] == groups["d000"][0] == groups["d001"][0] == "d000"
    assert all(groups[a][0] == groups[b][0] for a, b in got)


def test_a_paragraph_repeated_many_times_hides_no_pair(spark):
    texts = {}
    for base in range(6):
        words = [f"kelime{base}x{i}" for i in range(300)]
        texts[f"a{base}"] = " ".join(words)
        texts[f"b{base}"] = " ".join(words + words[100:150] * 60)
    pairs, members = nd.near_duplicates(spark.createDataFrame(list(texts.items()), "id string, text string"))
    expected = {(f"a{base}", f"b{base}") for base in range(6)}
    assert _truth(texts) == expected
    assert {(r.id_a, r.id_b) for r in nd.similar_ids(pairs, members).collect()} == expected


def test_empty_table(spark):
    pairs, members = nd.near_duplicates(spark.createDataFrame([], "id string, text string"))
    assert nd.similar_ids(pairs, members).count() == 0
    assert nd.duplicate_groups(pairs, members).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 2**62, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(1, 2**62, 100).astype(np.uint64)])
    wa, wb = rng.integers(1, 4, 300).astype(float), rng.integers(1, 4, 300).astype(float)
    wb[:200] = wa[:200]
    m = 2_048
    s = nd.signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], 300), 2, m)
    wx, wy = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    every = set(wx) | set(wy)
    expected = sum(1 / sum(max(wx.get(e, 0) / wx[d], wy.get(e, 0) / wy[d]) for e in every) for d in set(wx) & set(wy))
    assert abs((s[0] == s[1]).mean() - expected) < 0.05


def test_very_long_text(spark):
    t = " ".join(f"k{i % 5000}" for i in range(60_000))
    df = spark.createDataFrame([("a", t), ("b", t + " son")], "id string, text string")
    pairs, members = nd.near_duplicates(df)
    assert {(r.id_a, r.id_b) for r in nd.similar_ids(pairs, members).collect()} == {("a", "b")}
