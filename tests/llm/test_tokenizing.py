"""Token ids against the published encoder, and the exact round trip."""

import random
import sys
from array import array

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terazi.llm import tokenizing

TEXTS = [
    "", None, "  ", " \n\n  kelime  iki\t\tüç ", "<|endoftext|> it's we'll 12345 a b  　 c", "日本語テキスト😀😀" * 20,
    "ğ" * 900, "x" * 1_024, "a" * 5_000, "a\x1cb \x1c c", "son boşluk ", " baş", "4857 sayılı Kanunun 19 uncu maddesi.", "aynı", "aynı",
]


def _reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_and_round_trip(spark):
    rng = random.Random(4)
    texts = [*TEXTS, "".join(rng.choice("abcdefgh") for _ in range(3_000))]
    docs = spark.createDataFrame([(i, t, "fazla") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = tokenizing.encode_documents(docs)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    reference = _reference()
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in tokenizing.decode_documents(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_small_dictionary_changes_nothing(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    a, b = (tokenizing.encode_documents(docs, frequent_words=n) for n in (0, 40_000))
    assert sorted(map(tuple, a.select("doc_id", F.col("ids").cast("string")).collect())) == sorted(map(tuple, b.select("doc_id", F.col("ids").cast("string")).collect()))


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "bir iki"), (None, "üç"), (5, "bir"), (5, "bir")], "doc_id long, text string")
    assert tokenizing.encode_documents(docs, frequent_words=0).count() == 4


def test_empty_table(spark):
    assert tokenizing.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_unknown_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, [-1, 999_999, 64]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokenizing.decode_documents(rows).collect()} == {1: "a", 2: ""}


def test_heap_agrees_with_fold():
    ranks = tokenizing.read_ranks(tokenizing.default_vocabulary())
    reference = _reference()
    for word in ("maddesindeki", "x" * 77, "aaaaabaaaab", "İŞÇİ"):
        assert tokenizing.heap_merge(word.encode(), ranks) == reference.encode(word, add_special_tokens=False).ids


class _All(dict):
    """Every word, encoded by the heap."""

    def __missing__(self, word):
        return array("i", tokenizing.heap_merge(word.encode(), tokenizing.read_ranks(tokenizing.default_vocabulary()))).tobytes()


def test_cuts_beside_any_white_space():
    rng, reference, lookup, words = random.Random(7), _reference(), tokenizing._Lookup({}), _All()
    for _ in range(5_000):
        text = "".join(rng.choice(["   ", "  ", " ", " ", " ", "\n", "\t", "\xa0", "\x1c", "\x85", "\u2028", "a", "bir", "'s", "19", ".", "ğ", "😀"]) for _ in range(rng.randint(1, 12)))
        ids = reference.encode(text, add_special_tokens=False).ids
        assert array("i", lookup.encode(text, words)).tolist() == ids, repr(text)
        assert lookup.missing(text) == set(tokenizing._word_splitter()(text)), repr(text)


def test_known_chunks_take_no_call_each():
    lookup = tokenizing._Lookup({w: b"\1\0\0\0" for w in ("bir", " bir", " iki", " üç", "\n\n  ")})
    for text in ("bir" + " iki üç" * 1_000, "bir" + " iki üç" * 500 + "\n\n   bir" + " iki üç" * 500):
        lookup.encode(text, {})
        lookup.missing(text)
        calls = [0]

        def count(frame, event, arg, calls=calls):
            calls[0] += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            ids, missing = lookup.encode(text, {}), lookup.missing(text)
        finally:
            sys.setprofile(None)
        assert calls[0] < 100
        assert len(ids) // 4 >= 2_001 and not missing


def test_only_empty_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, tokenizing.encode_documents(docs).collect())) == [(1, []), (2, [])]
