"""Encoding a corpus with a public byte-level BPE vocabulary.

The merge loop runs once per distinct word, as a Spark higher-order fold over the word's bytes with
a literal rank map. Documents only look their words up: the most frequent words come from a
broadcast dictionary of bounded size, every other word through a join.

Bytes are carried as strings of the characters U+0000 to U+00FF (one per byte), so that pieces
concatenate and compare like byte strings inside Spark expressions.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from terazi.session import written

#: The published pre-tokenisation pattern of the GPT-2 family (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words in the broadcast dictionary, and the longest of them in characters: at most
#: 40,000 x 48 characters, whatever the corpus.
FREQUENT_WORDS, FREQUENT_LENGTH = 40_000, 48
#: Buckets of the literal rank map; words of more bytes go to the heap merge.
BUCKETS, FOLD_BYTES = 16_384, 1_024
#: Chunks that a task remembers, and the longest of them in characters.
MEMO_CHUNKS, MEMO_LENGTH = 300_000, 100
NONE = 2_147_483_647


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as one folded literal: an array of small maps, found by CRC of the key."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _rank(literal: Column, piece: Column) -> Column:
    bucket = F.try_element_at(literal, (F.crc32(piece.cast("binary")) % BUCKETS + 1).cast("int"))
    return F.coalesce(F.try_element_at(bucket, piece), F.lit(NONE))


def fold_merges(word: Column, literal: Column) -> Column:
    """Token ids of one word: the lowest-ranked adjacent pair is merged until none is left.

    The state holds the pieces and the ranks of their adjacent pairs; a step renews the two ranks
    beside the merged piece only."""
    one_byte_each = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    pieces = F.filter(one_byte_each, lambda c: c != "")

    def pair_ranks(p: Column) -> Column:
        return F.when(
            F.size(p) > 1,
            F.transform(
                F.sequence(F.lit(1), F.size(p) - 1),
                lambda i: _rank(literal, F.concat(F.element_at(p, i), F.element_at(p, i + 1))),
            ),
        ).otherwise(F.array().cast("array<int>"))

    def merged(state: Column, k: Column) -> Column:
        p, r = state["p"], state["r"]
        both = F.concat(F.element_at(p, k), F.element_at(p, k + 1))
        left = F.when(k > 1, F.array(_rank(literal, F.concat(F.element_at(p, F.greatest(k - 1, F.lit(1))), both)))).otherwise(F.array().cast("array<int>"))
        right = F.when(k + 1 < F.size(p), F.array(_rank(literal, F.concat(both, F.try_element_at(p, k + 2))))).otherwise(F.array().cast("array<int>"))
        size = F.size(p)
        return F.struct(
            F.concat(F.slice(p, 1, k - 1), F.array(both), F.slice(p, k + 2, size)).alias("p"),
            F.concat(F.slice(r, 1, F.greatest(k - 2, F.lit(0))), left, right, F.slice(r, k + 2, size)).alias("r"),
        )

    def step(state: Column, _: Column) -> Column:
        least = F.array_min(state["r"])
        at = F.array_position(state["r"], least).cast("int")
        done = F.coalesce(least, F.lit(NONE)) == NONE
        return F.when(done, state).otherwise(F.element_at(F.transform(F.array(at), lambda k: merged(state, k)), 1))

    start = F.element_at(F.transform(F.array(pieces), lambda p: F.struct(p.alias("p"), pair_ranks(p).alias("r"))), 1)
    steps = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
    return F.aggregate(steps, start, step, lambda state: F.transform(state["p"], lambda x: _rank(literal, x)))


def heap_merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap over a linked list, n log n for words of any length."""
    n = len(data)
    piece: list[bytes | None] = [data[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[data[i : i + 2]], i, 2) for i in range(n - 1) if data[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if piece[i] is not None else n
        if j >= n or piece[i] is None or piece[j] is None or len(piece[i]) + len(piece[j]) != size:
            continue
        piece[i], piece[j] = piece[i] + piece[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (r, a, len(piece[a]) + len(piece[b])))
    return [ranks[p] for p in piece if p is not None]


#: A token ends before a space unless there is white space on both sides of that cut. Texts without a
#: space before white space or at the end can be cut at every space.
_LOOSE = re.compile(r" (?!\S)")
_CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")


def _chunks(text: str) -> tuple[list[str], list[str]]:
    """Parts of the text that tokens don't cross: those given as they are, then those given without
    the one space that each of them begins with."""
    if _LOOSE.search(text):
        return _CUT.split(text), []
    first, *rest = text.split(" ")
    return [first], rest


def _word_splitter():
    import regex

    return regex.compile(PATTERN).findall


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words_of, whole, spaced = _word_splitter(), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        words: Counter = Counter()
        for space, held in (("", whole), (" ", spaced)):
            for chunk, n in held.items():
                for word in words_of(space + chunk):
                    words[word] += n
            held.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                a, b = _chunks(text)
                whole.update(a)
                spaced.update(b)
        if len(whole) + len(spaced) > 200_000:
            yield flush()
    if whole or spaced:
        yield flush()


def distinct_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n``: each pre-token of the corpus with its number of occurrences."""
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(_count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds ``ids``: the fold for words of up to FOLD_BYTES bytes, the heap for longer ones, in one pass."""
    vocabulary = vocabulary or default_vocabulary()
    literal = rank_literal(read_ranks(vocabulary))

    @F.pandas_udf(ArrayType(IntegerType()))
    def long_word(series):  # noqa: ANN001, ANN202
        ranks = read_ranks(vocabulary)
        return series.map(lambda w: None if w is None else heap_merge(w.encode(), ranks))

    size = F.octet_length("word")
    # One lambda variable holds the map, so that the plan carries the literal once.
    folded = F.element_at(F.transform(F.array(literal), lambda ranks: fold_merges(F.when(size <= FOLD_BYTES, F.col("word")), ranks)), 1)
    return words.withColumn("ids", F.coalesce(folded, long_word(F.when(size > FOLD_BYTES, F.col("word")))))


class _Memo(dict):
    """What ``find`` gives for a chunk, remembered for a bounded number of short chunks."""

    def __init__(self, find: Callable[[str], object]):
        super().__init__()
        self.find = find

    def __missing__(self, chunk: str) -> object:
        found = self.find(chunk)
        if len(chunk) <= MEMO_LENGTH:
            if len(self) >= MEMO_CHUNKS:
                self.clear()
            self[chunk] = found
        return found


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class _Lookup:
    """Ids of texts, as the bytes of 32-bit numbers; words that are not in the dictionary are reported."""

    def __init__(self, frequent: dict[str, bytes]):
        words_of, known = _word_splitter(), frequent.get
        self.rare: dict[str, bytes] = {}

        def lacking(chunk: str) -> tuple[str, ...]:
            return tuple(w for w in words_of(chunk) if w not in frequent)

        def ids(chunk: str) -> bytes:
            return b"".join([self.rare[w] if (found := known(w)) is None else found for w in words_of(chunk)])

        self.lacking = _Memo(lacking).__getitem__, _Memo(lambda chunk: lacking(" " + chunk)).__getitem__
        self.ids = _Memo(ids).__getitem__, _Memo(lambda chunk: ids(" " + chunk)).__getitem__

    def missing(self, text: str) -> set[str]:
        whole, spaced = _chunks(text)
        return set().union(*filter(None, map(self.lacking[0], whole)), *filter(None, map(self.lacking[1], spaced)))

    def encode(self, text: str, rare: dict[str, bytes]) -> bytes:
        self.rare = rare
        whole, spaced = _chunks(text)
        return b"".join([*map(self.ids[0], whole), *map(self.ids[1], spaced)])


def encode_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    frequent_words: int = FREQUENT_WORDS,
) -> DataFrame:
    """``id_col, ids``: one row for each row of ``docs``.

    Null and empty texts give an empty list; blanks, repeated rows, null ids and very long texts
    are encoded like any other; other columns are ignored. An empty table gives no rows.
    ``frequent_words`` bounds the broadcast dictionary and has no influence on the result."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    encoded = written(encode_words(distinct_words(source, "_text"), vocabulary))
    top = (
        encoded.filter(F.length("word") <= FREQUENT_LENGTH)
        .orderBy(F.desc("n"), "word")
        .limit(min(frequent_words, FREQUENT_WORDS))
        .select("word", "ids")
        .toArrow()
    )
    known = spark.sparkContext.broadcast(dict(zip(top["word"].to_pylist(), map(_packed, top["ids"].to_pylist()), strict=True)))

    # Copies of one text would all meet under one key: the id spreads them.
    keyed = source.withColumn("_key", F.xxhash64("_text", "_id"))

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(known.value)
        for batch in batches:
            keys, words = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and (missing := lookup.missing(text)):
                    keys.extend([key] * len(missing))
                    words.extend(missing)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], ["_key", "word"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(known.value)
        for batch in batches:
            parts = []
            for text, words, ids in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                parts.append(lookup.encode(text, dict(zip(words or (), map(_packed, ids or ()), strict=True))) if text else b"")
            ends = np.cumsum([0, *map(len, parts)]) // 4
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["_id", "ids"])

    rare = (
        keyed.select("_key", "_text")
        .mapInArrow(rare_words, "_key long, word string")
        .join(encoded.select("word", "ids"), "word")
        .groupBy("_key")
        .agg(F.collect_list(F.struct("word", "ids")).alias("_rare"))
        .select("_key", F.col("_rare.word").alias("_words"), F.col("_rare.ids").alias("_lists"))
    )
    kind = dict(source.dtypes)["_id"]
    return (
        keyed.join(rare, "_key", "left")
        .select("_id", "_text", "_words", "_lists")
        .mapInArrow(assemble, f"_id {kind}, ids array<int>")
        .withColumnRenamed("_id", id_col)
    )


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``id_col, text``: the pieces of each id list concatenated as bytes and read as UTF-8.

    Null and empty lists give the empty text; an id outside the vocabulary adds nothing."""
    ranks = read_ranks(vocabulary or default_vocabulary())
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = base64.b64encode(token).decode()
    literal = F.from_json(F.lit(json.dumps(pieces)), ArrayType(StringType()))
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    joined = F.aggregate(
        ids,
        F.lit(b""),
        lambda acc, i: F.concat(acc, F.coalesce(F.unbase64(F.when(i >= 0, F.try_element_at(literal, i + 1))), F.lit(b""))),
    )
    return encoded.select(id_col, F.decode(joined, "UTF-8").alias("text"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by the 50k byte-level vocabulary."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
