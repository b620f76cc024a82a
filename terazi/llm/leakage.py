"""Held-out test items inside the training corpus: rare n-gram seeds, then local alignment.

Every n-gram of a test passage is a seed. Documents that hold enough of them are aligned with the
passage by Smith-Waterman over words, which also finds edited and paraphrased copies. Where only
unbroken stretches are sought, the n-gram of each stretch that the fewest documents hold is enough: a
document with the stretch holds all its n-grams, while an edited copy may lack just that one.

The texts are read twice: for the places of seeds, which meet the passages in a join, and for the
words of those documents alone that are aligned. A filter of fixed size keeps n-grams that are no
seeds out of the join; the more seeds there are, the fewer it keeps out, and the join does the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terazi.llm.words import Codes, lists, words_of
from terazi.session import written

#: Words in a seed and in the stretch that names a leak.
SEED, STRETCH = 6, 12
#: Words in a seed of an edited copy, how many different ones it holds at least, and its least score.
EDITED_SEED, EDITED_SEEDS, EDITED_SCORE = 4, 2, 0.5
#: Cells of the filter of seeds: at most so many numbers come to the driver and go to the tasks.
CELLS = 1 << 22
MATCH, MISMATCH, GAP = 2, -1, -1


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[i : i + len(out)] * np.uint64(0x9E3779B97F4A7C15)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def _passages(items: DataFrame, item_id: str, fields: list[str], seed: int) -> DataFrame:
    """``item, part, words, seeds`` of each passage."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            rows = [codes.of(words_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists([r.view(np.int64) for r in rows], pa.int64()), lists([_grams(r, seed) for r in rows], pa.int64())], ["item", "part", "words", "seeds"])

    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col(f).cast("string").alias("text")) for i, f in enumerate(fields)]))
    rows = items.select(F.col(item_id).cast("long").alias("item"), parts.alias("p")).select("item", "p.part", "p.text").dropna().distinct()
    return rows.mapInArrow(cut, "item long, part int, words array<long>, seeds array<long>")


def _hits(docs: DataFrame, seeds: DataFrame, seed: int) -> DataFrame:
    """``d, t, h, pos``: the places of seeds in the documents' texts (``d, t, text``)."""
    cells = seeds.select(F.col("h").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("c")).distinct().toArrow()["c"].to_numpy()
    bits = np.zeros(CELLS, bool)
    bits[cells] = True
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, maybe = Codes(), np.unpackbits(known.value).astype(bool)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for d, t, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                grams = _grams(codes.of(words_of(text)), seed)
                at = np.flatnonzero(maybe[grams & (CELLS - 1)])
                if len(at):
                    for k, v in enumerate((np.full(len(at), d), np.full(len(at), t), grams[at], at.astype(np.int32))):
                        out[k].append(v)
            arrays = [np.concatenate(x) if x else np.array([], np.int64) for x in out]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in arrays[:3]), pa.array(arrays[3], pa.int32())], ["d", "t", "h", "pos"])

    return written(docs.mapInArrow(find, "d long, t long, h long, pos int").join(seeds, "h", "left_semi").select("d", "t", "h", "pos"))


def align(passage: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score and longest common run of words of two code sequences."""
    score = run = 0
    above = np.zeros(len(text) + 1, np.int64)
    runs = np.zeros(len(text) + 1, np.int64)
    steps = -GAP * np.arange(len(text) + 1)
    for word in passage:
        equal = text == word
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = np.maximum(np.maximum(above[:-1] + np.where(equal, MATCH, MISMATCH), above[1:] + GAP), 0)
        above = np.maximum.accumulate(row + steps) - steps
        longer = np.zeros(len(text) + 1, np.int64)
        longer[1:] = np.where(equal, runs[:-1] + 1, 0)
        runs = longer
        score, run = max(score, int(above.max())), max(run, int(runs.max()))
    return score, run


def _rarest(grams: DataFrame, hits: DataFrame, places: int) -> DataFrame:
    """``item, part, h``: of each ``places`` neighbouring seeds the one that the fewest documents hold.

    Seeds that no document holds are passed over; all seeds of a leaked stretch are held, so the
    chosen one is its."""
    held = hits.select("h", "d").distinct().groupBy("h").agg(F.count("*").alias("df"))
    window = Window.partitionBy("item", "part").orderBy("p").rowsBetween(-(places - 1), 0)
    whole = Window.partitionBy("item", "part")
    ranked = grams.join(held, "h", "left").withColumn("r", F.when(F.col("df").isNotNull(), F.struct("df", "h")))
    return (
        ranked.withColumn("least", F.min("r").over(window))
        .withColumn("n", F.count("*").over(whole))
        .filter((F.col("p") >= places - 1) | (F.col("p") == F.col("n") - 1))
        .filter("least is not null")
        .select("item", "part", F.col("least.h").alias("h"))
        .distinct()
    )


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    fields: tuple[str, ...] = ("soru", "dayanak"),
    seed: int = SEED,
    stretch: int = STRETCH,
    unbroken: bool = False,
    seeds: int = 1,
    least: float = 0.0,
) -> DataFrame:
    """``id_col, item_id, alan, kosu, puan`` for each document and passage that share ``seeds`` different
    seeds: the longest run of common words and the alignment score as a part of the best possible one.

    With ``unbroken`` only the rarest seed of each stretch counts, which leaves out no document with
    ``stretch`` consecutive words of the passage but may leave out edited copies; a passage shorter
    than ``stretch`` words is then sought by its rarest seed as a whole. Rows whose common words can't
    reach a score of ``least`` are left out. A passage shorter than ``seed`` words can't be found.
    Null and empty texts and passages have no seeds; rows without an id are left out; repeated rows
    count once, different texts of one id each, the best one is given; other columns are ignored."""
    passages = written(_passages(items, item_id, list(fields), seed))
    grams = passages.select("item", "part", F.posexplode("seeds").alias("p", "h"))
    source = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("text")).dropna().select("d", F.xxhash64("text").alias("t"), "text")
    hits = _hits(source, grams.select("h").distinct(), seed)
    sought = _rarest(grams, hits, stretch - seed + 1) if unbroken else grams.select("item", "part", "h").distinct()
    # Two aggregations instead of a distinct count; the places of a seed combine before the shuffle.
    each = hits.groupBy("d", "t", "h").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).join(sought, "h")
    spots = each.groupBy("d", "t", "item", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n")).filter(F.col("n") >= seeds)
    asked = spots.join(passages.select("item", "part", F.col("words").alias("passage")), ["item", "part"])
    # A document's passages are at most as many as its seeds' passages: they come to it as one row.
    asked = asked.groupBy("d", "t").agg(F.collect_list(F.struct("item", "part", "first", "last", "passage")).alias("asked"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for d, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = codes.of(words_of(text)).view(np.int64)
                inner = wanted.values
                lows, highs, parts, ids = (inner.field(k).to_pylist() for k in ("first", "last", "part", "item"))
                for i, passage in enumerate(inner.field("passage")):
                    a = passage.values.to_numpy()
                    around = 2 * len(a)
                    b = words[max(0, lows[i] - around) : highs[i] + seed + around]
                    if least and min(np.isin(a, b).sum(), np.isin(b, a).sum()) < (least - 1e-6) * len(a):
                        continue
                    s, r = align(a, b)
                    for k, v in enumerate((d, ids[i], parts[i], r, round(s / (MATCH * len(a)), 6))):
                        out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["d", "item", "part", "kosu", "puan"])

    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("part") + 1)
    scored = source.join(asked, ["d", "t"]).dropDuplicates(["d", "t"]).select("d", "text", "asked").mapInArrow(score, "d long, item long, part int, kosu int, puan double")
    best = scored.groupBy("d", "item", "part").agg(F.max("kosu").alias("kosu"), F.max("puan").alias("puan"))
    return best.select(F.col("d").alias(id_col), F.col("item").alias(item_id), name.alias("alan"), "kosu", "puan")


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/olcum_ogesi.parquet").select("item_id", "soru", "dayanak")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 12 consecutive words of a test item."""
    return leaks(*_read(spark, sf_dir), unbroken=True).filter(F.col("kosu") >= STRETCH).select("doc_id", "item_id").distinct()


def edited_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Aligned copies of test items, edited ones included: at least half of the best score."""
    near = leaks(docs, items, seed=EDITED_SEED, seeds=EDITED_SEEDS, least=EDITED_SCORE).filter(F.col("puan") >= EDITED_SCORE)
    return near.groupBy("doc_id", "item_id").agg(F.max("kosu").alias("kosu"), F.max("puan").alias("puan"))


def p8_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with copies of test items, edited ones included."""
    return edited_leaks(*_read(spark, sf_dir))
