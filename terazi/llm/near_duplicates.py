"""Near-duplicate decisions: ProbMinHash signatures, banding, exact verification and groups.

Each shingle sends its signals as a Poisson process whose rate is its weight; a register keeps the
shingle of its earliest signal, and a shingle stops once its next signal is later than every
register's. Two registers then agree with the probability Jaccard similarity of the weighted sets.
All shingles of a text weigh the same, however often they occur: the similarity of the registers is
then the Jaccard similarity of the sets, which is what the verification measures.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.llm.words import Codes, mixed, words_of
from terazi.operators.pairs import connected_groups, pairs_within
from terazi.session import written

#: 48 bands of 4 registers: a pair of similarity 0.65 is missed with probability 0.0001.
BANDS, ROWS = 48, 4
SHINGLE, MIN_WORDS, THRESHOLD = 3, 40, 0.6
_DROPPED = re.compile(r"<(style|script)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")


def plain_words(text: str) -> list[str]:
    """Words of a text without markup (also where its brackets are escaped), lower-cased."""
    for _ in range(2):
        if "<" in text:
            text = _TAG.sub(" ", _DROPPED.sub(" ", text))
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _DROPPED.sub(" ", text))
    return words_of(text)


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """``n_docs x m`` registers of the weighted elements; every doc needs an element."""
    earliest = np.full(n_docs * m, np.inf)
    owner = np.zeros(n_docs * m, np.uint64)
    latest = np.full(n_docs, np.inf)
    time, turn = np.zeros(len(element)), 0
    while len(element):
        turn += 1
        signal = mixed(element + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log1p(-((signal >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight
        alive = time < latest[doc]
        element, weight, doc, time, signal = (x[alive] for x in (element, weight, doc, time, signal))
        register = doc * m + (mixed(signal ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(earliest, register, time)
        won = earliest[register] == time
        owner[register[won]] = element[won]
        latest = earliest.reshape(n_docs, m).max(axis=1)
    return owner.reshape(n_docs, m)


def _band_keys(owner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = owner.reshape(len(owner), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2])
    for i in range(rows):
        key = mixed(key ^ parts[:, :, i]) * np.uint64(0xD6E8FEB86659FD93)
    return key


def sketched(texts: DataFrame, shingle: int = SHINGLE, min_words: int = MIN_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id, key, shingles, bands`` of ``texts`` (``id, text``); ``key`` is a digest of the words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            ids, keys, sets = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = plain_words(text)
                if len(words) < min_words:
                    continue
                h = codes.of(words)
                rolled = h[: len(h) - shingle + 1].copy()
                for i in range(1, shingle):
                    rolled = mixed(rolled) + h[i : len(h) - shingle + 1 + i] * np.uint64(0x9E3779B97F4A7C15)
                ids.append(key)
                keys.append(xxhash.xxh128_digest(" ".join(words)))
                sets.append(np.unique(mixed(rolled)))
            for i in range(0, len(ids), 64):
                part = sets[i : i + 64]
                doc = np.repeat(np.arange(len(part)), [len(x) for x in part])
                owner = signatures(np.concatenate(part), np.ones(len(doc)), doc, len(part), bands * rows)
                flat = np.concatenate([x.astype(np.uint32).view(np.int32) for x in part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i : i + 64], pa.string()),
                        pa.array(keys[i : i + 64], pa.binary()),
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32), pa.array(flat)),
                        pa.ListArray.from_arrays(np.arange(0, len(part) * bands + 1, bands, dtype=np.int32), pa.array(_band_keys(owner, bands, rows).ravel().view(np.int64))),
                    ],
                    ["id", "key", "shingles", "bands"],
                )

    return texts.select(F.col("id").cast("string"), F.col("text").cast("string")).dropna().mapInArrow(sketch, "id string, key binary, shingles array<int>, bands array<long>")


def similar_texts(sketches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, jaccard`` over keys of different texts: candidates share a band, all are verified."""
    one = sketches.groupBy("key").agg(F.min("id").alias("id"))
    banded = sketches.join(one, ["key", "id"], "left_semi").select("key", F.explode(F.array_distinct("bands")).alias("band"))
    candidates = written(pairs_within(banded, "band", "key").select("a", "b").distinct())
    named = candidates.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = written(sketches.join(named, "key", "left_semi").select("key", "shingles").dropDuplicates(["key"]))
    both = candidates.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("_sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("_sb")), "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    scored = both.select("a", "b", (common / (F.size("_sa") + F.size("_sb") - common)).alias("jaccard"))
    return scored.filter(F.col("jaccard") >= threshold)


def near_duplicates(texts: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The pairs between different texts (``a, b, jaccard`` over text keys) and ``id, key`` of each id.

    Texts that are null, empty or shorter than ``min_words`` words take no part, nor do rows with a
    null id. Repeated rows and equal texts share a key and are compared once. An id with several
    texts has several keys."""
    sketches = written(sketched(texts, min_words=min_words))
    return written(similar_texts(sketches, threshold)), sketches.select("id", "key").distinct()


def similar_ids(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``id_a, id_b`` with id_a < id_b, equal texts included."""
    left, right = members.select(F.col("key").alias("a"), F.col("id").alias("_x")), members.select(F.col("key").alias("b"), F.col("id").alias("_y"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").filter("_x <> _y").select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"))
    equal = pairs_within(members, "key", "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    return across.unionByName(equal).distinct()


def duplicate_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``id, grup, baglanti``: for every id its group, named by the least id in it, and the number of
    different texts its own texts are linked with. Ids of equal or linked texts share a group."""
    texts = members.select("id", F.hex("key").alias("key"))
    # Only linked texts, and the texts of an id with several, need contracting; all others are groups.
    several = texts.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("_z")).filter("a <> _z")
    own = texts.join(several.select("id", "a"), "id").select("a", F.col("key").alias("b"))
    found = connected_groups(pairs.select(F.hex("a").alias("a"), F.hex("b").alias("b")).unionByName(own))
    rooted = texts.join(found.withColumnRenamed("node", "key"), "key", "left").select("id", F.coalesce("root", "key").alias("root"))
    names = rooted.groupBy("root").agg(F.min("id").alias("grup"))
    found = rooted.join(names, "root").select("id", "grup").distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").count()
    links = members.join(ends, "key").groupBy("id").agg(F.sum("count").alias("baglanti"))
    return found.join(links, "id", "left").select("id", "grup", F.coalesce("baglanti", F.lit(0)).cast("long").alias("baglanti"))


def decision_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text``: decisions as fetched, and one row for each parsed decision and text."""
    fetched = spark.read.parquet(f"{sf_dir}/karar_kaydi.parquet").select("id", F.col("metin").alias("text"))
    pieces = spark.read.parquet(f"{sf_dir}/karar.parquet").select("kayit_no", F.col("karar_id").alias("id"), F.col("tam_metin").alias("text")).filter(F.col("text").isNotNull())
    chosen = pieces.groupBy("id", F.xxhash64("text")).agg(F.min("kayit_no").alias("kayit_no")).select("kayit_no")
    return fetched.unionByName(pieces.join(chosen, "kayit_no", "left_semi").select("id", "text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of decisions whose texts have a Jaccard similarity of at least 0.6."""
    return similar_ids(*near_duplicates(decision_texts(spark, sf_dir)))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each decision and its number of links."""
    return duplicate_groups(*near_duplicates(decision_texts(spark, sf_dir)))
