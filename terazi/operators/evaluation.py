"""Scores of ranked results against gold labels, and audits of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_gold_rank(results: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """``query_id, ilk``: the 1-based rank of the first gold result of each query of ``gold``, null if
    there is none. A null key in ``gold`` matches any value."""
    g = gold.select("query_id", *[F.col(k).alias(f"_g_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"_g_{k}").isNull() | (F.col(k) == F.col(f"_g_{k}")))
    hits = results.join(g, "query_id").filter(same).groupBy("query_id").agg((F.min("rank") + 1).alias("ilk"))
    return gold.select("query_id").distinct().join(hits, "query_id", "left")


def hits_and_mrr(firsts: DataFrame, by: str, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """hit@k and MRR by group; a missing rank counts as 0."""
    hits = [F.sum(F.when(F.col("ilk") <= k, 1).otherwise(0)).alias(f"ilk_{k}") for k in cuts]
    return firsts.groupBy(by).agg(F.count("*").alias("soru"), *hits, F.round(F.avg(F.coalesce(1.0 / F.col("ilk"), F.lit(0.0))), 6).alias("mrr"))


def label_coverage(results: DataFrame, queries: DataFrame, docs: DataFrame, cuts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """``grup, uye, kapsam_k``: the share of a label's members (``docs``: ``doc_id, grup``) that the first k
    results of its queries (``query_id, grup``) hold. Members are counted, not listed: the pairs of a
    label's queries and members are the product of two counts."""
    wanted = queries.groupBy("grup").agg(F.count("*").alias("_q")).join(docs.groupBy("grup").agg(F.count("*").alias("_n")), "grup")
    own = results.join(queries, "query_id").join(docs.withColumnRenamed("grup", "_g"), "doc_id").filter("grup = _g")
    found = own.groupBy("grup").agg(*[F.sum(F.when(F.col("rank") < k, 1).otherwise(0)).alias(f"_{k}") for k in cuts])
    pairs = F.col("_q") * F.col("_n")
    return wanted.join(found, "grup", "left").select("grup", pairs.alias("uye"), *[F.round(F.coalesce(F.col(f"_{k}"), F.lit(0)) / pairs, 6).alias(f"kapsam_{k}") for k in cuts])


def law_coverage(laws: DataFrame, articles: DataFrame) -> DataFrame:
    """``tur_adi, mevzuat_no, madde_sayisi, durum`` of each law: without articles, with few, or well."""
    counts = articles.groupBy("mevzuat_no").agg(F.count("*").alias("_n"))
    rows = laws.select("tur_adi", "mevzuat_no").distinct().join(counts, "mevzuat_no", "left")
    n = F.coalesce("_n", F.lit(0))
    return rows.select("tur_adi", "mevzuat_no", n.alias("madde_sayisi"), F.when(n == 0, "yok").when(n <= 3, "az").otherwise("var").alias("durum"))
