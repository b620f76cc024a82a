"""Long stretches of text that occur verbatim in more than one document.

Every run of two consecutive sentences is hashed and joined over the whole corpus. A stretch of
``min_chars`` need not hold a complete run (long sentences, cuts inside a sentence); where it
doesn't, the least hashed gram of the stretch stands in for one, so that any shared stretch has a
common seed. The matched seeds are then extended to exact borders, character by character, against
the other documents with the same seed. From the spans follow the shared parts of every document and
the texts without the sentences that an earlier document holds too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terazi.llm.words import mixed
from terazi.session import written

#: Sentences in a hashed run; characters of a gram that stands in for one.
RUN, GRAM = 2, 64
#: Different surroundings of one seed that are compared with each other; beyond, whole windows are hashed.
SURROUNDINGS = 64
_BATCH_CHARS, _LENGTH_BITS = 1_000_000, 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ENDS = np.array([ord(c) for c in ".!?…"], np.uint32)
_SENTENCE = re.compile(r".+?(?:(?<=[.!?…])\s+|\n|$)|\n", re.S)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sliding(a: np.ndarray, w: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over each of the len(a) - w + 1 windows of w values (block prefixes and suffixes)."""
    n = len(a)
    rows = -(-n // w)
    padded = np.full(rows * w, fill, a.dtype)
    padded[:n] = a
    block = padded.reshape(rows, w)
    prefix = pick.accumulate(block, axis=1).ravel()
    suffix = pick.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(suffix[: n - w + 1], prefix[w - 1 : n])


class _Hasher:
    """Hashes of any stretch of a batch of texts by prefix sums."""

    def __init__(self, size: int = _BATCH_CHARS + 1):
        self.grow(size)

    def grow(self, size: int) -> None:
        self.up, self.down = _powers(size, _BASE), _powers(size, _INVERSE)

    def load(self, codes: np.ndarray) -> None:
        n = len(codes)
        if n >= len(self.up):
            self.grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mixed(((self.sums[end] - self.sums[start]) * self.down[start]) ^ (length * np.uint64(0xD6E8FEB86659FD93)))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        return mixed((self.sums[k:] - self.sums[:-k]) * self.down[: n - k + 1])


def seeds_of(codes: np.ndarray, ends: np.ndarray, hasher: _Hasher, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and hash of the seeds of concatenated texts; ``ends``: where each text ends."""
    n, starts = len(codes), np.concatenate([[0], ends[:-1]])
    hasher.load(codes)
    after_line = codes == 10
    after_mark = np.zeros(n, bool)
    after_mark[1:] = (codes[1:] == 32) & np.isin(codes[:-1], _ENDS)
    border = np.flatnonzero(after_line | after_mark) + 1
    text_of = np.searchsorted(ends, border, side="right")
    inside = border < ends[np.minimum(text_of, len(ends) - 1)]
    border, text_of = border[inside & (text_of < len(ends))], text_of[inside & (text_of < len(ends))]
    # A border shows in the two characters before it: those have to lie in the text too.
    seen = border - 2 >= starts[text_of]
    border, text_of = border[seen], text_of[seen]

    run_start, run_end = border[:-RUN], border[RUN:]
    run = (text_of[:-RUN] == text_of[RUN:]) & (run_end - run_start <= min_chars - 2)
    run_start, run_end = run_start[run], run_end[run]

    gram = min(GRAM, min_chars)
    width = min_chars - gram + 1
    last = np.repeat(ends, ends - starts)
    window = np.arange(n - min_chars + 1)
    whole = window + min_chars <= last[: len(window)]
    # The first run that begins in the window, behind the two characters that show its border.
    first = np.searchsorted(run_start, window + 2)
    has_run = np.zeros(len(window), bool)
    known = first < len(run_end)
    least_end = np.minimum.accumulate(run_end[::-1])[::-1] if len(run_end) else run_end
    has_run[known] = least_end[first[known]] <= window[known] + min_chars
    value = hasher.grams(gram)
    least = _sliding(value, width, np.minimum, np.iinfo(np.uint64).max)[: len(window)]
    wanted = np.where(whole & ~has_run, least, np.uint64(0))
    reach = np.concatenate([np.zeros(width - 1, np.uint64), wanted, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero((_sliding(reach, width, np.maximum, 0)[: len(value)] == value) & (value != 0))

    start = np.concatenate([run_start, chosen])
    length = np.concatenate([run_end - run_start, np.full(len(chosen), gram)])
    return start, length, hasher.of(start, start + length)


def _batched(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, offsets, codes and ends of batches of about ``_BATCH_CHARS`` characters.

    A longer text comes in slices that overlap by ``min_chars``: every window lies whole in one of
    them, and what a window's seeds are depends on the window alone."""
    ids, offsets, texts, size = [], [], [], 0

    def batch_of() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array(ids, np.int64), np.array(offsets, np.int64), *_codes(texts)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is None or len(text) < min_chars:
                continue
            for at in range(0, max(1, len(text) - min_chars + 1), _BATCH_CHARS):
                piece = text[at : at + _BATCH_CHARS + min_chars]
                ids.append(key)
                offsets.append(at)
                texts.append(piece)
                size += len(piece)
                if size >= _BATCH_CHARS:
                    yield batch_of()
                    ids, offsets, texts, size = [], [], [], 0
    if ids:
        yield batch_of()


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum([len(t) for t in texts])


def find_seeds(docs: DataFrame, min_chars: int) -> DataFrame:
    """``h, d, pos, len`` of ``docs`` (``d, text``)."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for ids, offsets, codes, ends in _batched(batches, min_chars):
            start, length, h = seeds_of(codes, ends, hasher, min_chars)
            text_of = np.searchsorted(ends, start, side="right")
            begin = np.concatenate([[0], ends[:-1]])[text_of] - offsets[text_of]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(ids[text_of]), pa.array((start - begin).astype(np.int32)), pa.array(length.astype(np.int32))],
                ["h", "d", "pos", "len"],
            )

    return docs.mapInArrow(seeds, "h long, d long, pos int, len int")


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _extended(classes: DataFrame, min_chars: int, earlier: bool) -> DataFrame:
    """``h, ctx, l, r, first``: how far a seed's surroundings agree with those in another document, and
    the least document with which they do. With ``earlier`` only documents before count."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[list] = [[], [], [], [], []]

        def close() -> None:
            for i, (h, ctx, size, left, right, lo, hi) in enumerate(group):
                best: dict[tuple[int, int], int] = {(len(left), len(right)): lo} if lo != hi else {}
                # All documents of a class but its first have the whole surroundings before them.
                if earlier or lo == hi:
                    for j, (_, _, _, left2, right2, lo2, hi2) in enumerate(group):
                        if i != j and (lo2 < lo if earlier else not lo == hi == lo2 == hi2):
                            both = _common(left, left2), _common(right, right2)
                            best[both] = min(best.get(both, lo2), lo2)
                for (a, b), first in best.items():
                    if a + size + b >= min_chars:
                        for k, v in enumerate((h, ctx, a, b, first)):
                            out[k].append(v)
            group.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if group and group[0][0] != row[0]:
                    close()
                group.append(row)
            if len(out[0]) > 20_000:
                yield _arrow(out)
                out = [[], [], [], [], []]
        close()
        yield _arrow(out)

    def _arrow(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["h", "ctx", "l", "r", "first"])

    columns = ["h", "ctx", "len", "left", "right", "lo", "hi"]
    return classes.select(*columns).repartition("h").sortWithinPartitions("h").mapInArrow(extend, "h long, ctx long, l int, r int, first long")


def _windowed(classes: DataFrame, min_chars: int) -> DataFrame:
    """The same for seeds with very many surroundings: every window around a seed is hashed."""
    text = F.concat(F.reverse("left"), F.lpad(F.lit(""), F.col("len"), "\u0000"), F.col("right"))
    windows = classes.filter(F.length("left") + F.col("len") + F.length("right") >= min_chars).select(
        "h", "ctx", "len", "left", "right", "lo", "hi",
        F.explode(F.sequence(F.greatest(F.lit(0), F.lit(min_chars) - F.col("len") - F.length("right")), F.least(F.length("left"), F.lit(min_chars) - F.col("len")))).alias("l"),
    )
    at = (F.length("left") - F.col("l") + 1).cast("int")
    hashed = windows.select("h", "ctx", "len", "lo", "hi", "l", F.xxhash64(F.substring(text, at, F.lit(min_chars)), "l").alias("w"))
    shared = hashed.groupBy("h", "w").agg(F.min("lo").alias("first"), F.max("hi").alias("_hi")).filter("first < _hi").select("h", "w", "first")
    return hashed.join(shared, ["h", "w"]).select("h", "ctx", "l", (F.lit(min_chars) - F.col("len") - F.col("l")).cast("int").alias("r"), "first")


def _islands(spans: DataFrame) -> DataFrame:
    """``d, s, e``: the spans of each document joined where they touch."""
    in_order = Window.partitionBy("d").orderBy("s", "e")
    reached = F.max("e").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((F.col("s") > reached).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("d", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("d", "s", "e")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("text"))


def _spans(source: DataFrame, min_chars: int, earlier: bool = False) -> DataFrame:
    """``d, s, e``: maximal spans from s to before e that another document of ``source`` (``d, text``)
    holds too; with ``earlier`` a document of a lower id."""
    source = source.filter(F.col("d").isNotNull() & (F.length("text") >= min_chars))
    # Place and length travel as one number: these rows are shuffled twice.
    place = F.shiftleft(F.col("pos").cast("long"), _LENGTH_BITS).bitwiseOR(F.col("len").cast("long"))
    seeds = written(find_seeds(source, min_chars).select("h", "d", place.alias("at")))
    common = seeds.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo < hi").select("h")
    matched = seeds.join(common, "h", "left_semi").groupBy("d").agg(F.collect_list(F.struct("h", "at")).alias("seeds"))

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "d", "pos", "len", "left", "right"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        out: list[list] = [[] for _ in names]
        for batch in batches:
            for d, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for s in found:
                    at, size = s["at"] >> _LENGTH_BITS, s["at"] & (1 << _LENGTH_BITS) - 1
                    rest = min_chars - size
                    if at + size > len(text):
                        continue
                    left = text[max(0, at - rest) : at][::-1]
                    for k, v in enumerate((s["h"], d, at, size, left, text[at + size : at + size + rest])):
                        out[k].append(v)
                if len(out[0]) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)
                    out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    around = written(
        source.join(matched, "d")
        .select("d", "text", "seeds")
        .mapInArrow(surroundings, "h long, d long, pos int, len int, left string, right string")
        .withColumn("ctx", F.xxhash64("left", "right"))
    )
    classes = around.groupBy("h", "ctx").agg(
        F.first("len").alias("len"), F.first("left").alias("left"), F.first("right").alias("right"), F.min("d").alias("lo"), F.max("d").alias("hi")
    )
    counted = written(classes)
    sized = counted.join(counted.groupBy("h").agg(F.count("*").alias("_n")), "h")
    few = _extended(sized.filter(F.col("_n") <= SURROUNDINGS), min_chars, earlier)
    found = few.unionByName(_windowed(sized.filter(F.col("_n") > SURROUNDINGS), min_chars))
    met = around.select("h", "ctx", "d", "pos", "len").join(found, ["h", "ctx"])
    if earlier:
        met = met.filter(F.col("first") < F.col("d"))
    return met.select("d", (F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + F.col("len") + F.col("r")).alias("e")).distinct()


def shared_stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 300) -> DataFrame:
    """``id_col, bas, uzunluk``: the maximal runs of positions that lie in a stretch of at least
    ``min_chars`` characters found verbatim in another document. Positions start at 1.

    Null, empty and shorter texts share nothing; repeats within one document don't count; rows of
    one id count as one document, rows without an id are left out; other columns are ignored."""
    runs = _islands(_spans(_source(docs, id_col, text_col), min_chars))
    return runs.select(F.col("d").alias(id_col), (F.col("s") + 1).cast("int").alias("bas"), (F.col("e") - F.col("s")).cast("int").alias("uzunluk"))


def uncovered(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the sentences (up to a line break, or white space behind . ! ? …) that lie whole
    in one of the spans, which are in order and don't touch."""
    out, k = [], 0
    for m in _SENTENCE.finditer(text):
        a, b = m.start(), m.start() + len(m.group().rstrip())
        a += len(m.group()) - len(m.group().lstrip())
        while k < len(spans) and spans[k][1] < b:
            k += 1
        if a >= b or k == len(spans) or spans[k][0] > a:
            out.append(m.group())
    return "".join(out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 300) -> DataFrame:
    """``id_col, text_col, cikan`` for every row of ``docs``: the text without the sentences that a span of
    ``min_chars`` shared with a document of a lower id covers, and how many characters went.

    The first holder of a span keeps it. Null texts stay null; rows without an id, and rows of an id
    with several different texts, stay whole; rows that repeat an id and text are cut alike. Other
    columns are ignored."""
    source = _source(docs, id_col, text_col)
    several = source.filter("d is not null and text is not null").select("d", F.xxhash64("text").alias("x")).distinct().groupBy("d").count().filter("count > 1").select("d")
    runs = _islands(_spans(source, min_chars, earlier=True)).join(several, "d", "left_anti")
    packed = runs.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            kept = [t if t is None or not x else uncovered(t, [(y["s"], y["e"]) for y in x]) for t, x in zip(texts, spans, strict=True)]
            gone = [0 if t is None else len(t) - len(k) for t, k in zip(texts, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(gone, pa.int32())], ["d", "text", "cikan"])

    joined = source.join(packed, "d", "left").select("d", "text", "spans")
    return joined.mapInArrow(cut, "d long, text string, cikan int").select(F.col("d").alias(id_col), F.col("text").alias(text_col), "cikan")


def shared_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 300) -> DataFrame:
    """``id_col, ortak, pay`` for every document: shared characters and their part of its length.

    Null and empty texts have 0 and 0.0; a repeated id counts once, by its longest text."""
    spans = shared_stretches(docs, id_col, text_col, min_chars).groupBy(id_col).agg(F.sum("uzunluk").alias("_shared"))
    every = docs.select(F.col(id_col).cast("long").alias(id_col), F.length(text_col).alias("_n")).groupBy(id_col).agg(F.max("_n").alias("_n"))
    shared = F.coalesce("_shared", F.lit(0)).cast("long")
    part = F.when(F.coalesce("_n", F.lit(0)) > 0, F.round(shared / F.col("_n"), 6)).otherwise(F.lit(0.0))
    return every.join(spans, id_col, "left").select(id_col, shared.alias("ortak"), part.alias("pay"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of characters that documents share in stretches of 300 or more."""
    return shared_stretches(_documents(spark, sf_dir))


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is shared with others."""
    return shared_share(_documents(spark, sf_dir))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without the sentences that repeat an earlier one's long stretches."""
    return without_repeats(_documents(spark, sf_dir))
