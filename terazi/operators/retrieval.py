"""Ranking: BM25, exact keys, dense vectors, fusion, rerank blend and pinning, for batches of queries.

Every channel gives ``query_id, doc_id, rank, weight, channel`` with 0-based ranks, so that fusion is
one union and one aggregation.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.functions.text import tokens
from terazi.session import written

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: Digits that scores keep: sums of floats don't depend on their order beyond.
DIGITS = 6


def tokenised(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``doc_id, terms``: the terms of each document in order; a missing text has none."""
    return docs.select(F.col(id_col).alias("doc_id"), tokens(text).alias("terms"))


def term_statistics(docs: DataFrame, n_docs: int) -> DataFrame:
    """``term, df, idf`` of ``docs`` (``terms``); an idf below zero becomes a part of the mean idf. The
    frequencies are written once, as both the mean and the terms are read from them."""
    df = written(docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    scored = df.withColumn("_raw", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = scored.agg(F.avg("_raw")).scalar()
    return scored.select("term", "df", F.when(F.col("_raw") < 0, EPSILON * mean).otherwise(F.col("_raw")).alias("idf"))


#: Pairs of query and term, and bytes of query vectors, that are sent to every task at once.
PAIRS, SLICE_BYTES = 2_000_000, 32 << 20
#: Scores that a task holds at once.
CELLS = 2_000_000


class _Best:
    """The k best documents of each of some queries: by score, then by the lower id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.doc, self.score = np.array([], np.int64), np.array([], np.int64), np.array([])
        self.bar = np.full(len(ids), -np.inf)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: a row for each of ``docs``, a column for each query."""
        row, query = np.nonzero(scores >= self.bar)
        q, d, s = (np.concatenate(x) for x in ((self.query, query), (self.doc, docs[row]), (self.score, scores[row, query])))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.query, self.doc, self.score = q[kept], d[kept], s[kept]
        last = place[kept] == self.k - 1
        self.bar[self.query[last]] = self.score[last]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query], pa.int64()), pa.array(self.doc, pa.int64()), pa.array(self.score, pa.float64())], ["query_id", "doc_id", "skor"])


_SCORED = "query_id long, doc_id long, skor double"


def bm25_top(queries: DataFrame, docs: DataFrame, id_col: str, text: Column, k: int = 10, pairs: int = PAIRS) -> DataFrame:
    """``query_id, doc_id, skor, rank`` of ``queries`` (``query_id, text``; ids are integers).

    Always k rows a query while there are documents: those without a common term have score 0 and
    follow in the order of their ids. Repeated query terms count each time. Statistics are over all
    documents; a missing text counts as a document of length 0.

    Documents are tokenised once and written. The queries' weighted terms go to the documents, in
    blocks of about ``pairs`` terms; a task adds up the terms that a document shares and passes on the
    k best of each query, so neither documents nor scores are shuffled."""
    split = written(tokenised(docs, id_col, text))
    totals = split.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("total")).first()
    n_docs, mean = totals["n"], (totals["total"] or 0) / max(1, totals["n"]) or 1.0
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    weighted = written(asked.join(term_statistics(split, n_docs), "term").select("query_id", "term", (F.col("qn") * F.col("idf")).alias("w")))
    named = written(queries.select("query_id").distinct())
    blocks = max(1, -(-max(weighted.count(), named.count()) // pairs))

    def scorer(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        mine = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block
        ids = np.sort(named.filter(mine).toArrow()["query_id"].to_numpy())
        rows = weighted.filter(mine).orderBy("term", "query_id").toArrow()
        terms, code = np.unique(np.array(rows["term"].to_pylist(), object), return_inverse=True) if rows.num_rows else (np.array([], object), np.array([], np.int64))
        starts = np.searchsorted(code, np.arange(len(terms) + 1))
        shared = docs.sparkSession.sparkContext.broadcast((ids, terms.tolist(), starts, np.searchsorted(ids, rows["query_id"].to_numpy()), rows["w"].to_numpy()))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, terms, starts, query, weight = shared.value
            known, best = pa.array(terms, pa.string()), _Best(ids, k)
            if not len(ids):
                return
            for batch in batches:
                for at in range(0, batch.num_rows, max(1, CELLS // len(ids))):
                    part = batch.slice(at, max(1, CELLS // len(ids)))
                    sizes = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                    found = pc.index_in(part.column(1).flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                    row = np.repeat(np.arange(len(sizes)), sizes)[found >= 0]
                    cell, tf = np.unique(row * max(1, len(terms)) + found[found >= 0], return_counts=True)
                    row, term = np.divmod(cell, max(1, len(terms)))
                    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[row] / mean))
                    # Each term of a document goes to the queries that ask for it.
                    each = starts[term + 1] - starts[term]
                    spot = np.repeat(starts[term] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum()) if len(each) else np.array([], np.int64)
                    total = np.bincount(np.repeat(row, each) * len(ids) + query[spot], np.repeat(gain, each) * weight[spot], len(sizes) * len(ids))
                    best.add(part.column(0).to_numpy(), np.round(total, DIGITS).reshape(len(sizes), len(ids)))
            yield best.batch()

        return score

    source = split.select(F.col("doc_id").cast("long"), "terms")
    return ranked(functools.reduce(DataFrame.unionByName, (source.mapInArrow(scorer(b), _SCORED) for b in range(blocks))), "skor", k)


def ranked(scored: DataFrame, score: str, k: int | None = None) -> DataFrame:
    """Adds the 0-based ``rank`` within each query: by score, then by id; the first k only."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    out = scored.withColumn("rank", F.row_number().over(order) - 1)
    return out if k is None else out.filter(F.col("rank") < k)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of unit rows; zero vectors become null rows (not a number)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``query_id, doc_id, skor, rank``: cosine of ``queries`` (``query_id, vector``) with all
    ``vectors`` (``doc_id, vector``), exactly.

    The queries go to the vectors in slices of about ``slice_bytes``; a task keeps the k best of each
    query, so no vector is shuffled. Null and zero vectors have no neighbours. All vectors have one
    length."""
    asked = written(queries.filter(F.col("vector").isNotNull()).select(F.col("query_id").cast("long"), "vector"))
    size = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    slices = max(1, -(-size[0] * (size[1] or 1) * 8 // slice_bytes))

    def scorer(number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == number).orderBy("query_id").toArrow().combine_chunks()
        matrix = _matrix(rows["vector"].combine_chunks()) if rows.num_rows else np.zeros((0, 1))
        sound = ~np.isnan(matrix).any(axis=1)
        shared = vectors.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy()[sound], matrix[sound]))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked_for = shared.value
            if not len(ids):
                return
            best, step = _Best(ids, k), max(1, CELLS // len(ids))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    matrix = _matrix(part.column(1))
                    sound = ~np.isnan(matrix).any(axis=1)
                    best.add(part.column(0).to_numpy()[sound], np.round(matrix[sound] @ asked_for.T, DIGITS))
            yield best.batch()

        return score

    source = vectors.filter(F.col("vector").isNotNull()).select(F.col("doc_id").cast("long"), "vector")
    return ranked(functools.reduce(DataFrame.unionByName, (source.mapInArrow(scorer(i), _SCORED) for i in range(slices))), "skor", k)


#: Vectors that the index is fitted on, at most; its lists, in how many a vector is, and how many a query
#: looks into.
SAMPLE, LISTS, SPILL, PROBES, ROUNDS = 20_000, 64, 3, 16, 8


def fitted_lists(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE) -> np.ndarray:
    """Centres of an inverted-list index by spherical k-means over the ``sample`` vectors of least hash.
    Only the fit is bounded: every vector is indexed."""
    rows = vectors.filter(F.col("vector").isNotNull()).select("vector", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample).toArrow()
    if not rows.num_rows:
        return np.zeros((1, 1))
    points = _matrix(rows["vector"].combine_chunks())
    points = points[~np.isnan(points).any(axis=1)]
    centres = points[: max(1, min(lists, len(points)))]
    for _ in range(ROUNDS):
        nearest_centre = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest_centre, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def indexed_nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, centres: np.ndarray | None = None, probes: int = PROBES, block: int = 1_024) -> DataFrame:
    """The same by an index: each vector is in the lists of its ``SPILL`` nearest centres, each query looks
    into the lists of its ``probes`` nearest. Approximate; recall is measured in the tests.

    A list's vectors and its queries are cut into blocks of about ``block`` by hash, so a list that holds
    a third of all vectors spreads over many tasks; each pair of blocks passes on its best k."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(fitted_lists(vectors) if centres is None else centres)

    def placed(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matrix = _matrix(batch.column(1))
                sound = np.flatnonzero(~np.isnan(matrix).any(axis=1))
                lists = np.argsort(-(matrix[sound] @ shared.value.T), axis=1, kind="stable")[:, :n]
                rows = np.repeat(sound, lists.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(lists.ravel().astype(np.int32))], ["id", "vector", "list"])

        return place

    def on(df: DataFrame, key: str, n: int) -> DataFrame:
        rows = df.filter(F.col("vector").isNotNull()).select(F.col(key).cast("long").alias("id"), F.col("vector").cast("array<double>"))
        return rows.mapInArrow(placed(n), "id long, vector array<double>, list int")

    def packed(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        cut = rows.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        return cut.groupBy("list", "block").agg(F.collect_list(F.struct("id", "vector")).alias(name)).select("list", name)

    met = packed(written(on(queries, "query_id", probes)), "queries").join(packed(written(on(vectors, "doc_id", SPILL)), "docs"), "list")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, d in zip(batch.column(0), batch.column(1), strict=True):
                best = _Best(q.values.field("id").to_numpy(), k)
                best.add(d.values.field("id").to_numpy(), np.round(_matrix(d.values.field("vector")) @ _matrix(q.values.field("vector")).T, DIGITS))
                yield best.batch()

    return ranked(met.select("queries", "docs").mapInArrow(score, _SCORED).distinct(), "skor", k)


def channel(found: DataFrame, name: str, order: int, weight: float) -> DataFrame:
    """A channel's ranks in the form that ``fused`` takes."""
    return found.select("query_id", "doc_id", "rank", F.lit(weight).alias("weight"), F.lit(name).alias("channel"), F.lit(order).alias("channel_no"))


def fused(*channels: DataFrame, k: float = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion: ``query_id, doc_id, skor, kaynaklar, rank``.

    Equal scores follow the first channel and the rank there. Rows without a document are dropped."""
    union = channels[0]
    for c in channels[1:]:
        union = union.unionByName(c)
    summed = (
        union.filter("doc_id is not null")
        .groupBy("query_id", "doc_id")
        .agg(
            F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("skor"),
            F.array_sort(F.collect_set("channel")).alias("kaynaklar"),
            F.min(F.struct("channel_no", "rank")).alias("_first"),
        )
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("skor"), "_first.channel_no", "_first.rank", "doc_id")
    return summed.withColumn("rank", F.row_number().over(order) - 1).drop("_first")


def blended(candidates: DataFrame, cross: str, first: str, weight: float = 0.9, penalty: Column | None = None, factor: Column | None = None) -> DataFrame:
    """Adds ``karma``: weight x cross-encoder score + (1 - weight) x first-stage score, each brought to
    0..1 over the query's window; minus a penalty, times a factor.

    A window without spread gives 0.5 each. A query with one candidate keeps it with a null score."""
    window = Window.partitionBy("query_id")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(window), F.max(c).over(window)
        return F.when(high - low < 1e-9, F.lit(0.5)).otherwise((F.col(c) - low) / (high - low))

    score = weight * scaled(cross) + (1 - weight) * scaled(first)
    if penalty is not None:
        score = score - penalty
    if factor is not None:
        score = score * factor
    return candidates.withColumn("karma", F.when(F.count("*").over(window) > 1, F.round(score, DIGITS)))


def pinned(results: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Puts the documents of ``wanted`` (``query_id, doc_id``) before all others and keeps k."""
    marked = results.join(wanted.select("query_id", "doc_id").distinct().withColumn("_pin", F.lit(1)), ["query_id", "doc_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("_pin", F.lit(0))), "rank", "doc_id")
    return marked.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k).drop("_pin")


def best_part(scored: DataFrame, doc: str, part: str, score: str) -> DataFrame:
    """The best part of each query and document; the lower part number wins a tie."""
    order = Window.partitionBy("query_id", doc).orderBy(F.desc(score), part)
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
