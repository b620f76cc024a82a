"""Cutting oversized pieces at natural boundaries.

A text over the limit is cut at the strongest boundary near its midpoint, its halves likewise while
they exceed the limit less the overlap; then every piece but the first is led by the end of the one
before it. Pieces are numbered anew within their decision.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1_500, 150
#: Names of the boundaries from the strongest to the weakest.
BOUNDARIES = ("paragraf", "cumle", "sozcuk", "harf")
_LINE = re.compile(r"\n+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"\s+")
#: The part of a text on either side of its midpoint in which cuts are looked for first.
NEAR = 0.25
#: Pieces of a decision that are numbered in one go.
BLOCK = 512


def _cuts(text: str, limit: int) -> list[np.ndarray]:
    """Places after each boundary, by strength: lines, sentences, words and any character."""
    inside = lambda rx: np.array([m.end() for m in rx.finditer(text) if 0 < m.end() < len(text)], np.int64)
    return [inside(_LINE), inside(_SENTENCE), inside(_WORD)]


def bisect(text: str, limit: int) -> list[int]:
    """Cut places so that no part exceeds ``limit``, found by recursive bisection."""
    cuts = _cuts(text, limit)
    out: list[int] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= limit:
            continue
        mid, near = (a + b) / 2, (b - a) * NEAR
        at = 0
        for low, high in ((mid - near, mid + near), (a + 1, b - 1)):
            for places in cuts:
                i, j = np.searchsorted(places, low, "left"), np.searchsorted(places, high, "right")
                if i < j:
                    at = int(places[i:j][np.argmin(np.abs(places[i:j] - mid))])
                    break
            if at:
                break
        at = at or int(mid)
        out.append(at)
        todo += [(a, at), (at, b)]
    return sorted(out)


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces with their overlaps; a text within the limit is one piece."""
    if len(text) <= limit:
        return [(0, len(text))]
    borders = [0, *bisect(text, limit - overlap), len(text)]
    parts = list(zip(borders, borders[1:], strict=False))
    out = [parts[0]]
    for a, b in parts[1:]:
        # The overlap begins at the first word of the last ``overlap`` characters before the cut.
        start = max(out[-1][0] + 1, a - overlap)
        if start > 0 and not text[start - 1].isspace():
            space = _WORD.search(text, start, a)
            start = space.end() if space and space.end() < a else start
        out.append((start, b))
    return out


def coarsest(text: str, limit: int = LIMIT) -> str:
    """The coarsest boundary by which no part exceeds the limit, overlap left aside."""
    lines = text.split("\n")
    if all(len(x) <= limit for x in lines):
        return BOUNDARIES[0]
    sentences = [s for x in lines for s in _SENTENCE.split(x)]
    if all(len(s) <= limit for s in sentences):
        return BOUNDARIES[1]
    if all(len(w) <= limit for s in sentences for w in _WORD.split(s)):
        return BOUNDARIES[2]
    return BOUNDARIES[3]


def split_oversized(rows: DataFrame, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Adds ``sinir`` (null where the text is within the limit) and ``parcalar``, an array of
    ``bas, uzunluk, metin`` with positions from 1.

    Null and empty texts have one piece, themselves. Only texts over the limit leave the JVM. Columns
    of these names in the input are replaced."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    rows = rows.drop("sinir", "parcalar")
    piece = "struct<bas:int,uzunluk:int,metin:string>"
    size = F.coalesce(F.length(text_col), F.lit(0))
    one = F.array(F.struct(F.lit(1).alias("bas"), size.alias("uzunluk"), F.col(text_col).alias("metin"))).cast(f"array<{piece}>")
    whole = rows.filter(size <= limit).withColumn("sinir", F.lit(None).cast("string")).withColumn("parcalar", one)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("bas", pa.int32()), ("uzunluk", pa.int32()), ("metin", pa.string())]))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            edges = pa.array([coarsest(t, limit) for t in texts], pa.string())
            parts = pa.array([[{"bas": a + 1, "uzunluk": b - a, "metin": t[a:b]} for a, b in pieces_of(t, limit, overlap)] for t in texts], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, edges, parts], [*batch.schema.names, "sinir", "parcalar"])

    from pyspark.sql.types import StructType

    schema = StructType(rows.schema.fields).add("sinir", "string")
    schema = StructType([*schema.fields, *StructType.fromDDL(f"parcalar array<{piece}>").fields])
    return rows.filter(size > limit).mapInArrow(cut, schema).unionByName(whole)


def renumbered(split: DataFrame, decision: str = "karar_id", order: str = "parca_no", row_id: str = "kayit_no", text_col: str = "gerekce") -> DataFrame:
    """One row for each new piece, with ``parca_no`` and ``parca_adet`` counted anew in its decision.

    Rows that repeat a piece (same decision, number and text) get the same numbers. Rows without a
    decision are numbered each by itself. Numbers are summed up block by block, so no decision has to
    pass through one task."""
    rows = split.withColumn("_d", F.coalesce(F.col(decision).cast("string"), F.concat(F.lit("\u0000"), F.col(row_id).cast("string"))))
    rows = rows.withColumn("_o", F.coalesce(F.col(order).cast("int"), F.lit(2_147_483_647))).withColumn("_h", F.xxhash64(text_col)).withColumn("_n", F.size("parcalar"))
    rows = rows.withColumn("_blk", F.floor(F.col("_o") / BLOCK))
    distinct = rows.select("_d", "_blk", "_o", "_h", "_n").distinct()
    blocks = distinct.groupBy("_d", "_blk").agg(F.sum("_n").alias("_in"))
    by_block = Window.partitionBy("_d").orderBy("_blk")
    blocks = blocks.select("_d", "_blk", (F.sum("_in").over(by_block) - F.col("_in")).alias("_before"), F.sum("_in").over(Window.partitionBy("_d")).alias("_all"))
    in_block = Window.partitionBy("_d", "_blk").orderBy("_o", "_h")
    starts = distinct.withColumn("_at", F.sum("_n").over(in_block) - F.col("_n")).join(blocks, ["_d", "_blk"])
    starts = starts.select("_d", "_o", "_h", (F.col("_before") + F.col("_at")).alias("_start"), "_all")
    joined = rows.join(starts, ["_d", "_o", "_h"])
    keep = [c for c in split.columns if c not in (text_col, "parcalar", "parca_no", "parca_adet", "bas")]
    return joined.select(*keep, "_start", "_all", F.posexplode("parcalar").alias("_i", "_p")).select(
        *keep,
        F.col("_p.bas").alias("bas"),
        F.col("_p.metin").alias(text_col),
        (F.col("_start") + F.col("_i") + 1).cast("int").alias("parca_no"),
        F.col("_all").cast("int").alias("parca_adet"),
    )


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/karar.parquet").select("kayit_no", "karar_id", "parca_no", "gerekce")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized pieces of decisions with the coarsest boundary that suffices."""
    return split_oversized(_pieces(spark, sf_dir), "gerekce").filter("sinir is not null").select("kayit_no", "sinir")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all decisions, cut to the limit and numbered anew."""
    return renumbered(split_oversized(_pieces(spark, sf_dir), "gerekce"))
