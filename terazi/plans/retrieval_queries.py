"""Queries of ranking, fusion, reranking and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terazi.functions import text
from terazi.operators import evaluation, relational, retrieval
from terazi.plans.registry import registry
from terazi.plans.text_queries import sql_joined, sql_tokens
from terazi.session import table

QUERIES, ORACLE_SQL, query = registry()

_SQL_TEXT = sql_joined("' '", "mevzuat_adi", "baslik", "baslik", "baslik", "'madde ' || madde_no", "metin")
#: Common table expressions of BM25 over the articles.
_BM25 = f"""t AS (SELECT kayit_no AS doc_id, {sql_tokens(_SQL_TEXT)} AS w FROM madde),
    p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t),
    q AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
    c AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM t),
    r AS (SELECT term, count(*) AS df, ln(any_value(c.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM q, c GROUP BY term),
    i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r)"""


def _lexical_text():
    lower = F.concat(F.lit("madde "), "madde_no")
    return text.joined(" ", "mevzuat_adi", "baslik", "baslik", "baslik", lower, "metin")


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "madde").select("kayit_no", "mevzuat_no", "madde_no", "mevzuat_tur", "mevzuat_adi", "baslik", "metin", "mulga", _lexical_text().alias("sozcuk"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "olcum_ogesi").select(F.col("item_id").alias("query_id"), F.col("soru").alias("text"), "kanun", "madde", "konu")


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM i")
def bm25_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of every term of the articles."""
    docs = _articles(spark, d)
    stats = retrieval.term_statistics(retrieval.tokenised(docs, "kayit_no", F.col("sozcuk")), docs.count())
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return retrieval.bm25_top(_questions(spark, d).select("query_id", "text"), _articles(spark, d), "kayit_no", F.col("sozcuk"), k)


_BM25_TOP = f"""{_BM25},
    a AS (SELECT item_id AS query_id, unnest({sql_tokens('soru')}) AS term FROM olcum_ogesi),
    b AS (SELECT query_id, term, count(*) AS qn FROM a GROUP BY ALL),
    s AS (SELECT query_id, doc_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / c.mean))), 6) AS skor FROM q JOIN i USING (term) JOIN b USING (term), c GROUP BY ALL),
    f AS (SELECT kayit_no AS doc_id FROM madde ORDER BY 1 LIMIT 20),
    u AS (SELECT * FROM s UNION ALL SELECT item_id, doc_id, 0.0 FROM olcum_ogesi, f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = item_id AND s.doc_id = f.doc_id)),
    m AS (SELECT query_id, doc_id, skor, (row_number() OVER (PARTITION BY query_id ORDER BY skor DESC, doc_id) - 1)::INT AS rank FROM u QUALIFY rank < 20)"""


@query(f"WITH {_BM25_TOP} SELECT * FROM m")
def bm25_questions(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best articles of each question by words."""
    return _bm25(spark, d)


_DIRECT = """k AS (SELECT item_id AS query_id, kayit_no AS doc_id, (row_number() OVER (PARTITION BY item_id ORDER BY kayit_no) - 1)::INT AS rank
    FROM olcum_ogesi o JOIN madde m ON o.kanun = m.mevzuat_no AND o.madde = m.madde_no QUALIFY rank < 3)"""


def _direct(spark: SparkSession, d: str) -> DataFrame:
    return _first_three(spark, d, _questions(spark, d).select("query_id", F.col("kanun").alias("mevzuat_no"), F.col("madde").alias("madde_no")))


def _first_three(spark: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    found = table(spark, d, "madde").select("mevzuat_no", "madde_no", F.col("kayit_no").alias("doc_id")).join(asked, ["mevzuat_no", "madde_no"])
    order = Window.partitionBy("query_id").orderBy("doc_id")
    return found.withColumn("rank", F.row_number().over(order) - 1).filter("rank < 3").select("query_id", "doc_id", "rank")


@query(
    """SELECT l.kayit_no AS query_id, m.kayit_no AS doc_id, (row_number() OVER (PARTITION BY l.kayit_no ORDER BY m.kayit_no) - 1)::INT AS rank
    FROM mevzuat_kaydi l JOIN madde m ON l.mevzuat_no = m.mevzuat_no AND m.madde_no = '1' QUALIFY rank < 3"""
)
def direct_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first article of each law by its two keys, the first three rows."""
    asked = table(spark, d, "mevzuat_kaydi").select(F.col("kayit_no").alias("query_id"), "mevzuat_no", F.lit("1").alias("madde_no"))
    return _first_three(spark, d, asked)


_FUSED = f"""{_BM25_TOP}, {_DIRECT},
    ch AS (SELECT query_id, doc_id, rank, 3.0 AS w, 'dogrudan' AS c, 0 AS o FROM k UNION ALL SELECT query_id, doc_id, rank, 1.0, 'bm25', 1 FROM m),
    g AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 9) AS skor, array_to_string(list_sort(list(DISTINCT c)), '+') AS kaynaklar, min(o * 1000000 + rank) AS f FROM ch GROUP BY ALL),
    fu AS (SELECT query_id, doc_id, skor, kaynaklar, (row_number() OVER (PARTITION BY query_id ORDER BY skor DESC, f, doc_id) - 1)::INT AS rank FROM g)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    direct, lexical = retrieval.channel(_direct(spark, d), "dogrudan", 0, 3.0), retrieval.channel(_bm25(spark, d), "bm25", 1, 1.0)
    return retrieval.fused(direct, lexical).withColumn("kaynaklar", F.array_join("kaynaklar", "+"))


@query(f"WITH {_FUSED} SELECT * FROM fu WHERE rank < 10")
def fused_questions(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: exact keys and words fused, ten articles for each question."""
    return _fused(spark, d).filter("rank < 10")


#: Weight of each kind of norm (fixed values); others .90.
HIERARCHY = {
    "Kanun": 1.00,
    "Cumhurbaskanligi Kararnamesi": 0.97,
    "Kanun Hukmunde Kararname": 0.97,
    "Tuzuk": 0.94,
    "Cumhurbaskanligi Yonetmeligi": 0.91,
    "Yonetmelik": 0.91,
    "Kurum ve Kurulus Yonetmeligi": 0.88,
    "Teblig": 0.85,
}
#: The SQL has its own copy, so that a wrong weight shows.
_FACTOR = """CASE WHEN mevzuat_tur = 'Kanun' THEN 1.0 WHEN mevzuat_tur IN ('Cumhurbaskanligi Kararnamesi', 'Kanun Hukmunde Kararname') THEN 0.97 WHEN mevzuat_tur = 'Tuzuk' THEN 0.94
    WHEN mevzuat_tur IN ('Cumhurbaskanligi Yonetmeligi', 'Yonetmelik') THEN 0.91 WHEN mevzuat_tur = 'Kurum ve Kurulus Yonetmeligi' THEN 0.88 WHEN mevzuat_tur = 'Teblig' THEN 0.85 ELSE 0.90 END"""
_OVERLAP = f"round(len(list_intersect(list_distinct({sql_tokens('soru')}), list_distinct({sql_tokens('metin')})))::DOUBLE / greatest(len(list_distinct({sql_tokens('soru')})), 1), 6)"
_SCALE = "CASE WHEN max({0}) OVER w - min({0}) OVER w < 1e-9 THEN 0.5 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


@query(
    f"""WITH {_FUSED},
    x AS (SELECT fu.query_id, fu.doc_id, fu.rank, fu.skor, {_OVERLAP} AS ce, {_FACTOR} AS fac, CASE WHEN regexp_matches(madde_no, '^(Ek|Geçici|Mükerrer) ') THEN 0.05 ELSE 0.0 END AS pen
        FROM fu JOIN madde ON kayit_no = doc_id JOIN olcum_ogesi ON item_id = query_id WHERE fu.rank < 25)
    SELECT query_id, doc_id, ce, CASE WHEN count(*) OVER w > 1 THEN round((0.9 * ({_SCALE.format('ce')}) + 0.1 * ({_SCALE.format('skor')}) - pen) * fac, 6) END AS karma
    FROM x WINDOW w AS (PARTITION BY query_id)"""
)
def reranked_questions(spark: SparkSession, d: str) -> DataFrame:
    """The fused window of 25 with a word-overlap score in the place of a cross-encoder, blended."""
    articles, asked = _articles(spark, d), _questions(spark, d)
    rows = _fused(spark, d).filter("rank < 25").join(articles.withColumnRenamed("kayit_no", "doc_id").select("doc_id", "madde_no", "mevzuat_tur", "metin"), "doc_id").join(asked.select("query_id", "text"), "query_id")
    q, m = F.array_distinct(text.tokens("text")), F.array_distinct(text.tokens("metin"))
    rows = rows.withColumn("ce", F.round(F.size(F.array_intersect(q, m)) / F.greatest(F.size(q), F.lit(1)), 6))
    factor = F.lit(None).cast("double")
    for kind, weight in HIERARCHY.items():
        factor = F.when(F.col("mevzuat_tur") == kind, weight).otherwise(factor)
    penalty = F.when(F.col("madde_no").rlike("^(Ek|Geçici|Mükerrer) "), 0.05).otherwise(0.0)
    return retrieval.blended(rows, "ce", "skor", 0.9, penalty, F.coalesce(factor, F.lit(0.90))).select("query_id", "doc_id", "ce", "karma")


@query(
    f"""WITH {_FUSED},
    x AS (SELECT fu.*, k.doc_id IS NOT NULL AS pin FROM fu LEFT JOIN k ON fu.query_id = k.query_id AND fu.doc_id = k.doc_id)
    SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY pin DESC, rank, doc_id) - 1)::INT AS rank FROM x QUALIFY rank < 5"""
)
def pinned_questions(spark: SparkSession, d: str) -> DataFrame:
    """The named articles before all others, five for each question."""
    return retrieval.pinned(_fused(spark, d), _direct(spark, d), 5).select("query_id", "doc_id", "rank")


_VECTORS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, a.label AS ql, b.label AS dl, round(list_dot_product(a.e, b.e), 6) AS skor FROM n a, n b WHERE a.vec_id % 20 = 0)"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "doc_id")


@query(f"WITH {_VECTORS} SELECT query_id, doc_id, skor, (row_number() OVER (PARTITION BY query_id ORDER BY skor DESC, doc_id) - 1)::INT AS rank FROM s QUALIFY rank < 10")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every twentieth vector."""
    asked, rows = _vectors(spark, d)
    return retrieval.nearest(asked, rows.select("doc_id", "vector"))


@query()
def indexed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Ten near vectors of every twentieth vector by inverted lists; approximate."""
    asked, rows = _vectors(spark, d)
    return retrieval.indexed_nearest(asked, rows.select("doc_id", "vector"))


@query(f"WITH {_VECTORS} SELECT query_id, doc_id, skor, (row_number() OVER (PARTITION BY query_id ORDER BY skor DESC, doc_id) - 1)::INT AS rank FROM s WHERE dl <> 0 QUALIFY rank < 10")
def nearest_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same among the vectors whose label isn't 0: the filter is below the ranking."""
    asked, rows = _vectors(spark, d)
    return retrieval.nearest(asked, rows.filter("label <> 0").select("doc_id", "vector"))


@query(
    f"""WITH {_VECTORS}, r AS (SELECT query_id, dl, doc_id, skor, row_number() OVER (PARTITION BY query_id ORDER BY skor DESC, doc_id) AS n FROM s QUALIFY n <= 40),
    b AS (SELECT query_id, dl AS grup, doc_id, skor FROM r QUALIFY row_number() OVER (PARTITION BY query_id, dl ORDER BY skor DESC, doc_id) = 1)
    SELECT query_id, grup, doc_id, skor FROM b WHERE skor >= 0.05"""
)
def best_parts(spark: SparkSession, d: str) -> DataFrame:
    """The best part of each group within the first forty, and only then the threshold."""
    asked, rows = _vectors(spark, d)
    found = retrieval.nearest(asked, rows.select("doc_id", "vector"), 40).join(rows.select("doc_id", F.col("label").alias("grup")), "doc_id")
    return retrieval.best_part(found, "grup", "doc_id", "skor").filter("skor >= 0.05").select("query_id", "grup", "doc_id", "skor")


@query(
    f"""WITH {_VECTORS}, r AS (SELECT query_id, dl, skor, row_number() OVER (PARTITION BY query_id ORDER BY skor DESC, doc_id) AS n FROM s QUALIFY n <= 40),
    g AS (SELECT query_id, dl AS ana, max(skor) AS skor FROM r GROUP BY ALL)
    SELECT query_id, ana, skor, (row_number() OVER (PARTITION BY query_id ORDER BY skor DESC, ana) - 1)::INT AS rank FROM g QUALIFY rank < 10"""
)
def parents_of_children(spark: SparkSession, d: str) -> DataFrame:
    """Parents by their best child among the first forty children."""
    asked, rows = _vectors(spark, d)
    found = retrieval.nearest(asked, rows.select("doc_id", "vector"), 40).join(rows.select("doc_id", F.col("label").alias("ana")), "doc_id")
    best = found.groupBy("query_id", "ana").agg(F.max("skor").alias("skor")).withColumnRenamed("ana", "doc_id")
    return retrieval.ranked(best, "skor", 10).withColumnRenamed("doc_id", "ana")


@query(
    f"""WITH {_VECTORS}, r AS (SELECT query_id, doc_id, skor, row_number() OVER (PARTITION BY query_id ORDER BY skor DESC, doc_id) AS n FROM s WHERE query_id <> doc_id)
    SELECT query_id, max(CASE WHEN n = 1 THEN skor END) AS en_iyi, max(CASE WHEN n = 1 THEN skor END) < 0.5 AS zayif,
        round(max(CASE WHEN n = 1 THEN skor END) - max(CASE WHEN n = 2 THEN skor END), 6) >= 0.03 AS belirgin FROM r WHERE n <= 2 GROUP BY 1"""
)
def confidence(spark: SparkSession, d: str) -> DataFrame:
    """Whether the best hit of a query is weak, and whether it stands out from the next."""
    asked, rows = _vectors(spark, d)
    found = retrieval.nearest(asked, rows.select("doc_id", "vector"), 3).filter("query_id <> doc_id")
    ordered = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("skor"), "doc_id"))).filter("n <= 2")
    first, second = (F.max(F.when(F.col("n") == i, F.col("skor"))) for i in (1, 2))
    return ordered.groupBy("query_id").agg(first.alias("en_iyi"), (first < 0.5).alias("zayif"), (F.round(first - second, 6) >= 0.03).alias("belirgin"))


_GOLD = """gold AS (SELECT item_id AS query_id, konu, kanun, madde FROM olcum_ogesi),
    hit AS (SELECT g.query_id, min(fu.rank) + 1 AS ilk FROM gold g JOIN fu ON fu.query_id = g.query_id JOIN madde m ON m.kayit_no = fu.doc_id
        WHERE m.mevzuat_no = g.kanun AND (g.madde IS NULL OR m.madde_no = g.madde) GROUP BY 1)"""


@query(
    f"""WITH {_FUSED}, {_GOLD}
    SELECT konu, count(*) AS soru, coalesce(sum((ilk <= 1)::INT), 0)::BIGINT AS ilk_1, coalesce(sum((ilk <= 3)::INT), 0)::BIGINT AS ilk_3, coalesce(sum((ilk <= 5)::INT), 0)::BIGINT AS ilk_5,
        coalesce(sum((ilk <= 10)::INT), 0)::BIGINT AS ilk_10, round(avg(coalesce(1.0::DOUBLE / ilk, 0.0)), 6) AS mrr
    FROM gold LEFT JOIN hit USING (query_id) GROUP BY konu"""
)
def hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """hit@k and MRR of the fused ranking by topic."""
    gold = _questions(spark, d).select("query_id", "konu", F.col("kanun").alias("mevzuat_no"), F.col("madde").alias("madde_no"))
    results = _fused(spark, d).join(table(spark, d, "madde").select(F.col("kayit_no").alias("doc_id"), "mevzuat_no", "madde_no"), "doc_id")
    firsts = evaluation.first_gold_rank(results, gold.select("query_id", "mevzuat_no", "madde_no"), ["mevzuat_no", "madde_no"])
    return evaluation.hits_and_mrr(firsts.join(gold.select("query_id", "konu"), "query_id"), "konu")


@query(
    f"""WITH {_VECTORS}, r AS (SELECT query_id, doc_id, dl, ql, row_number() OVER (PARTITION BY query_id ORDER BY skor DESC, doc_id) - 1 AS rank FROM s),
    m AS (SELECT ql AS grup, CASE WHEN rank < 5 THEN 1.0::DOUBLE ELSE 0 END AS a, CASE WHEN rank < 10 THEN 1.0::DOUBLE ELSE 0 END AS b FROM r WHERE ql = dl)
    SELECT grup, count(*) AS uye, round(avg(a), 6) AS kapsam_5, round(avg(b), 6) AS kapsam_10 FROM m GROUP BY 1"""
)
def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of a label's members the first results of its queries cover."""
    asked, rows = _vectors(spark, d)
    results = retrieval.nearest(asked, rows.select("doc_id", "vector"), 10)
    return evaluation.label_coverage(results, asked.select("query_id", F.col("label").alias("grup")), rows.select("doc_id", F.col("label").alias("grup")))


@query(
    """WITH r AS (SELECT tur_adi AS g, kayit_no, length(ad) AS n FROM mevzuat_kaydi)
    SELECT g AS tur_adi, kayit_no, sum(n) OVER (PARTITION BY g ORDER BY kayit_no)::BIGINT AS toplam FROM r WHERE n IS NOT NULL QUALIFY toplam <= 4000"""
)
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first names of each kind of law within 4,000 characters; the first overflow ends the kind."""
    rows = table(spark, d, "mevzuat_kaydi").filter("ad is not null").select("tur_adi", "kayit_no", F.length("ad").alias("n"))
    return relational.within_budget(rows, "tur_adi", [F.col("kayit_no")], F.col("n"), 4_000, F.floor(F.col("kayit_no") / 256)).select("tur_adi", "kayit_no", "toplam")


@query(
    f"""WITH {_VECTORS}, r AS (SELECT query_id, dl, ql, row_number() OVER (PARTITION BY query_id ORDER BY skor DESC, doc_id) AS n FROM s WHERE query_id <> doc_id),
    f AS (SELECT query_id, min(CASE WHEN dl = ql AND n <= 99 THEN n END) AS ilk FROM r GROUP BY 1), w AS (SELECT unnest([5, 12, 25, 50, 99]) AS pencere)
    SELECT pencere, count(*) AS soru, coalesce(sum((ilk <= pencere)::INT), 0)::BIGINT AS bulunan FROM f, w GROUP BY 1"""
)
def first_stage_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """How many queries have a vector of their own label within windows of the first stage."""
    asked, rows = _vectors(spark, d)
    found = retrieval.nearest(asked, rows.select("doc_id", "vector"), 100).filter("query_id <> doc_id")
    found = found.join(rows.select("doc_id", F.col("label").alias("dl")), "doc_id").join(asked.select("query_id", F.col("label").alias("ql")), "query_id")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("skor"), "doc_id"))
    firsts = found.withColumn("n", n).groupBy("query_id").agg(F.min(F.when((F.col("dl") == F.col("ql")) & (F.col("n") <= 99), F.col("n"))).alias("ilk"))
    windows = firsts.select("ilk", F.explode(F.array(*[F.lit(w) for w in (5, 12, 25, 50, 99)])).alias("pencere"))
    return windows.groupBy("pencere").agg(F.count("*").alias("soru"), F.sum(F.when(F.col("ilk") <= F.col("pencere"), 1).otherwise(0)).alias("bulunan"))
