"""Queries of merging, citations, audits and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terazi.functions import text
from terazi.operators import citations, decisions, evaluation, relational
from terazi.plans.registry import registry
from terazi.plans.text_queries import sql_lower, sql_tokens
from terazi.session import table

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT kayit_no, tur, mevzuat_no, tertip, ad FROM mevzuat_kaydi QUALIFY row_number() OVER (PARTITION BY tur, mevzuat_no, tertip ORDER BY kayit_no DESC) = 1")
def catalogue_merge(spark: SparkSession, d: str) -> DataFrame:
    """One row for each law; the newest wins."""
    rows = table(spark, d, "mevzuat_kaydi").select("kayit_no", "tur", "mevzuat_no", "tertip", "ad")
    return relational.first_per_key(rows, ["tur", "mevzuat_no", "tertip"], [F.desc("kayit_no")])


@query(
    """WITH n AS (SELECT * FROM madde WHERE mulga), k AS (SELECT kayit_no, chunk_id, metin FROM madde m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.mevzuat_no = m.mevzuat_no AND n.mevzuat_tur = m.mevzuat_tur AND n.tertip = m.tertip)
        UNION ALL SELECT kayit_no, chunk_id, metin FROM n)
    SELECT kayit_no, chunk_id, metin FROM k QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY kayit_no DESC) = 1"""
)
def article_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Laws with renewed articles are replaced by these; one row for each key."""
    rows = table(spark, d, "madde").select("kayit_no", "chunk_id", "metin", "mevzuat_no", "mevzuat_tur", "tertip", "mulga")
    merged = relational.upserted(rows, rows.filter("mulga"), "chunk_id", ["mevzuat_no", "mevzuat_tur", "tertip"], "kayit_no")
    return merged.select("kayit_no", "chunk_id", "metin")


@query(
    """SELECT kayit_no, mevzuat_no FROM mevzuat_kaydi k WHERE coalesce(metinsiz, false) = false AND (tur IN (7, 9) OR NOT EXISTS
        (SELECT 1 FROM madde m WHERE m.mevzuat_tur = k.tur_adi AND m.mevzuat_no = k.mevzuat_no AND m.tertip = k.tertip))"""
)
def laws_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Laws with text that have no articles yet, and the kinds that are always refreshed."""
    laws = table(spark, d, "mevzuat_kaydi").filter(~F.coalesce("metinsiz", F.lit(False))).select("kayit_no", "tur", F.col("tur_adi").alias("mevzuat_tur"), "mevzuat_no", "tertip")
    refresh = F.col("tur").isin(7, 9)
    done = table(spark, d, "madde").select("mevzuat_tur", "mevzuat_no", "tertip")
    keys = ["mevzuat_tur", "mevzuat_no", "tertip"]
    return relational.not_done(laws, done, keys, refresh).select("kayit_no", "mevzuat_no")


@query(
    """SELECT kayit_no, CASE WHEN metin IS NOT NULL THEN nullif(min(kayit_no) OVER (PARTITION BY metin), kayit_no) END AS onceki FROM madde"""
)
def embedding_reuse(spark: SparkSession, d: str) -> DataFrame:
    """For each article the first row of the same text, whose vector it can take over; null where it is
    that row itself."""
    rows = table(spark, d, "madde").select("kayit_no", "metin")
    reused = relational.reused(rows, rows.filter("metin is not null").withColumn("onceki", F.col("kayit_no")), "metin", "onceki", "kayit_no")
    return reused.select("kayit_no", F.nullif("onceki", "kayit_no").alias("onceki"))


@query(
    """SELECT id, daire, esas_no, karar_no, karar_tarihi, durum, NULL::VARCHAR AS mahkeme FROM karar_kaydi
    UNION ALL SELECT id, daire, esas_no, karar_no, karar_tarihi, NULL, mahkeme FROM danistay_karari"""
)
def both_courts(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of both courts under one schema."""
    columns = ["id", "daire", "esas_no", "karar_no", "karar_tarihi"]
    return table(spark, d, "karar_kaydi").select(*columns, "durum").unionByName(table(spark, d, "danistay_karari").select(*columns, "mahkeme"), allowMissingColumns=True)


@query(
    """WITH n AS (SELECT kayit_no, chunk_id, madde_no, row_number() OVER (PARTITION BY chunk_id ORDER BY kayit_no) AS n FROM madde)
    SELECT kayit_no, chunk_id, CASE WHEN n > 1 THEN madde_no || ' (' || n || ')' ELSE madde_no END AS madde_no FROM n"""
)
def duplicate_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Repeated keys get a number on the article's name."""
    return relational.suffixed(table(spark, d, "madde").select("kayit_no", "chunk_id", "madde_no"), "chunk_id", "kayit_no", "madde_no")


@query(
    """WITH n AS (SELECT mevzuat_no, count(*) AS n FROM madde GROUP BY 1)
    SELECT DISTINCT tur_adi, mevzuat_no, coalesce(n, 0)::BIGINT AS madde_sayisi, CASE WHEN coalesce(n, 0) = 0 THEN 'yok' WHEN n <= 3 THEN 'az' ELSE 'var' END AS durum FROM mevzuat_kaydi LEFT JOIN n USING (mevzuat_no)"""
)
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Laws without articles or with few."""
    return evaluation.law_coverage(table(spark, d, "mevzuat_kaydi"), table(spark, d, "madde"))


@query(
    r"""SELECT mevzuat_tur, mevzuat_no, count(*) AS n, sum(length(metin))::BIGINT AS harf, sum((coalesce(metin, '') = '')::INT)::BIGINT AS bos,
        sum(coalesce(regexp_matches(metin, '\d{1,2}/\d{1,2}/\d{4}'), false)::INT)::BIGINT AS tarihli FROM madde GROUP BY 1, 2"""
)
def corpus_health(spark: SparkSession, d: str) -> DataFrame:
    """Articles, characters, empty texts and dated texts of each law."""
    dated = F.coalesce(F.col("metin").rlike(r"\d{1,2}/\d{1,2}/\d{4}"), F.lit(False))
    return (
        table(spark, d, "madde")
        .groupBy("mevzuat_tur", "mevzuat_no")
        .agg(F.count("*").alias("n"), F.sum(F.length("metin")).alias("harf"), F.sum((F.coalesce("metin", F.lit("")) == "").cast("int")).alias("bos"), F.sum(dated.cast("int")).alias("tarihli"))
    )


#: The SQL has its own copy of names, patterns and relations, so that a wrong one shows.
_LAWS = (
    ("sosyal sigortalar ve genel sağlık sigortası kanunu", "5510"), ("sendikalar ve toplu iş sözleşmesi kanunu", "6356"), ("hukuk muhakemeleri kanunu", "6100"), ("iş mahkemeleri kanunu", "7036"),
    ("türk borçlar kanunu", "6098"), ("türk ticaret kanunu", "6102"), ("türk medeni kanunu", "4721"), ("türk ceza kanunu", "5237"), ("deniz iş kanunu", "854"), ("basın iş kanunu", "5953"),
    ("borçlar kanunu", "6098"), ("medeni kanun", "4721"), ("ceza kanunu", "5237"), ("iş kanunu", "4857"),
)
_NAMES = [n for n, _ in _LAWS]
_CASE_NAMES = " ".join(f"WHEN mk = '{n}' THEN '{no}'" for n, no in _LAWS)
_NTH = "(?:inci|ıncı|uncu|üncü|nci|ncı|ncu|ncü)"
_SQL_ARTICLES = rf"(?:(?:ek|geçici)\s+)?\b(?:[0-9]{{1,4}}\s*(?:\.|{_NTH})?\s*(?:,|ve|ile|ila|–|-)\s*){{0,9}}[0-9]{{1,4}}\s*(?:\.|{_NTH})?\s*madde"
_SQL_ARTICLE = rf"m\.\s*[0-9]{{1,4}}\b|madde\s*[:-]?\s*[0-9]{{1,4}}\b|\b[0-9]{{1,4}}\s*(?:\.|{_NTH})?\s*madde"
_SQL_MARK = r"[0-9]{3,4}\s*say[ıi]l[ıi]|bu kanun|" + "|".join(_NAMES)
_REL = f"""WHEN regexp_matches({sql_lower('kanit')}, 'yürürlükten kaldırıl|mülga|ilga edil') THEN 'mulga'
    WHEN regexp_matches({sql_lower('kanit')}, 'değiştiril|değişik|eklenmiştir|ibaresi|ibareleri') THEN 'degistirir'
    WHEN regexp_matches({sql_lower('kanit')}, 'istisna|saklıdır|hariç|uygulanmaz|dışında|tabi değil|dahil değil') THEN 'istisna'
    WHEN regexp_matches({sql_lower('kanit')}, 'para cezası|aykırı hareket|cezalandırıl|aykırı davran') THEN 'yaptirim'
    WHEN regexp_matches({sql_lower('kanit')}, 'hükümleri uygulanır|hükümlerine göre|uyarınca|gereğince|hükümlerine tabi|hükmü uygulanır|belirtilen|göre') THEN 'gonderme'"""
_LOCATED = """list_transform(generate_series(1, len(f)), lambda i: struct_pack(pos := (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) + 1)::INT, m := f[i]))"""
_EDGES = f"""a AS (SELECT mevzuat_no AS l, madde_no AS a, metin AS t, {sql_lower('metin')} AS low FROM madde WHERE metin IS NOT NULL),
    b AS (SELECT *, regexp_extract_all(low, '{_SQL_ARTICLES}') AS f, regexp_split_to_array(low, '{_SQL_ARTICLES}') AS g FROM a),
    c AS (SELECT l, a, t, low, unnest({_LOCATED}) AS m FROM b WHERE len(f) > 0),
    e AS (SELECT l, a, m.pos AS p, m.m AS match, t, regexp_extract_all(substr(low, greatest(1, m.pos - 150), least(150, m.pos - 1)), '{_SQL_MARK}')[-1] AS mk,
        regexp_extract(substr(t, greatest(1, m.pos - 240), m.pos - greatest(1, m.pos - 240)), '[^.]*$') AS lft, substr(t, m.pos, 240) AS rgt FROM c),
    h AS (SELECT l, a, p, match, CASE WHEN mk IS NULL OR mk = 'bu kanun' THEN l {_CASE_NAMES} ELSE regexp_extract(mk, '^\\d+') END AS tl, lft,
        CASE WHEN instr(rgt, '.') > 0 THEN substr(rgt, 1, instr(rgt, '.')) ELSE rgt END AS r FROM e),
    k AS (SELECT l, a, p, tl, substr(trim(regexp_replace(lft || r, '\\s+', ' ', 'g')), greatest(1, length(ltrim(lft)) - 99), 200) AS kanit, unnest(list_distinct(list_transform(regexp_extract_all(match, '[0-9]+'), lambda x, i: CASE WHEN i = 1 AND starts_with(match, 'ek') THEN 'Ek ' || x WHEN i = 1 AND starts_with(match, 'geçici') THEN 'Geçici ' || x ELSE x END))) AS n FROM h),
    o AS (SELECT l || '-' || a AS kaynak, tl || '-' || n AS hedef, CASE {_REL} ELSE 'atif' END AS iliski, kanit, p FROM k WHERE NOT coalesce(tl = l AND n = a, false)),
    ed AS (SELECT kaynak, hedef, iliski, arg_min(kanit, (p, kanit)) AS kanit FROM o WHERE kaynak IS NOT NULL GROUP BY ALL)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return citations.edges(table(spark, d, "madde").select("mevzuat_no", "madde_no", "metin")).filter("kaynak is not null")


@query(f"WITH {_EDGES} SELECT * FROM ed")
def citation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Citations between articles with their relation and evidence."""
    return _edges(spark, d)


@query(
    f"""WITH {_EDGES}, f AS (SELECT kaynak AS dugum, list_sort(list(DISTINCT hedef)) AS ileri FROM ed GROUP BY 1), g AS (SELECT hedef AS dugum, list_sort(list(DISTINCT kaynak)) AS geri FROM ed GROUP BY 1)
    SELECT dugum, coalesce(array_to_string(ileri, ' '), '') AS ileri, coalesce(array_to_string(geri, ' '), '') AS geri FROM f FULL JOIN g USING (dugum)"""
)
def citation_graph(spark: SparkSession, d: str) -> DataFrame:
    """Both directions of the citation graph."""
    return citations.adjacency(_edges(spark, d)).select("dugum", F.array_join("ileri", " ").alias("ileri"), F.array_join("geri", " ").alias("geri"))


_PRIO = "CASE iliski WHEN 'mulga' THEN 0 WHEN 'degistirir' THEN 1 WHEN 'istisna' THEN 2 WHEN 'yaptirim' THEN 3 WHEN 'gonderme' THEN 4 WHEN 'atif' THEN 5 END"


@query(
    f"""WITH {_EDGES}, x AS (SELECT kaynak, hedef, iliski, {_PRIO} AS pr FROM ed QUALIFY row_number() OVER (PARTITION BY kaynak, hedef ORDER BY {_PRIO}) = 1)
    SELECT kaynak, hedef, iliski, row_number() OVER (PARTITION BY kaynak ORDER BY pr, hedef)::INT AS sira FROM x QUALIFY sira <= 12"""
)
def strongest_relations(spark: SparkSession, d: str) -> DataFrame:
    """The strongest relation of each citation, twelve for each article."""
    return citations.best_relations(_edges(spark, d))


_PART = lambda p, t, v: f"""list_transform((SELECT {_LOCATED} FROM (SELECT regexp_extract_all(low, '{p}') AS f, regexp_split_to_array(low, '{p}') AS g)), lambda x: struct_pack(pos := x.pos, tip := '{t}', deger := {v}))"""
_NO = r"\d{3,5}\s*say[ıi]l[ıi]"
_MENTIONS = f"""a AS (SELECT DISTINCT karar_id, {sql_lower('gerekce')} AS low FROM karar WHERE gerekce IS NOT NULL AND kayit_no IN (SELECT min(kayit_no) FROM karar GROUP BY chunk_id)),
    z AS (SELECT kayit_no, {sql_lower('gerekce')} AS low FROM karar WHERE gerekce IS NOT NULL),
    p AS (SELECT kayit_no, unnest(list_concat(list_concat({_PART(_NO, 'no', "regexp_extract(x.m, '^[0-9]+')")}, {_PART('|'.join(_NAMES), 'ad', 'x.m')}), {_PART(_SQL_ARTICLE, 'madde', "regexp_extract(x.m, '[0-9]+')")})) AS p FROM z),
    q AS (SELECT kayit_no, p.pos AS pos, p.tip AS tip, p.deger AS deger FROM p WHERE p.tip <> 'madde' OR regexp_matches(p.deger, '[1-9]')),
    w AS (SELECT *, last_value(CASE WHEN tip = 'no' THEN struct_pack(pos := pos, deger := deger) END IGNORE NULLS) OVER b AS no_, last_value(CASE WHEN tip <> 'madde' THEN deger END IGNORE NULLS) OVER b AS l_,
        first_value(CASE WHEN tip <> 'madde' THEN deger END IGNORE NULLS) OVER n AS r_ FROM q
        WINDOW b AS (PARTITION BY kayit_no ORDER BY pos, tip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY kayit_no ORDER BY pos, tip ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    me AS (SELECT kayit_no, pos, coalesce(CASE WHEN pos - no_.pos < 120 THEN no_.deger END, l_, r_) AS kanun, deger AS madde FROM w WHERE tip = 'madde' AND coalesce(l_, r_) IS NOT NULL)"""
_MENTIONS = _MENTIONS[_MENTIONS.index("z AS") :]


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return citations.mentions(table(spark, d, "karar").filter("gerekce is not null"), "kayit_no", "gerekce")


@query(f"WITH {_MENTIONS} SELECT * FROM me")
def citation_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Articles that decisions cite, each with the law it belongs to: an as-of match over positions."""
    return _mentions(spark, d)


_CASE_RESOLVE = "CASE WHEN regexp_matches(kanun, '^[0-9]+$') THEN kanun " + " ".join(f"WHEN contains({sql_lower('kanun')}, '{n}') THEN '{no}'" for n, no in _LAWS) + " END"


@query(
    f"""WITH {_MENTIONS}, r AS (SELECT *, {_CASE_RESOLVE} AS no FROM me),
    m AS (SELECT mevzuat_no, madde_no, mulga, kismi_mulga FROM madde QUALIFY row_number() OVER (PARTITION BY mevzuat_no, madde_no ORDER BY kayit_no) = 1)
    SELECT r.kayit_no, r.pos, r.kanun, r.madde, CASE WHEN no IS NULL THEN 'kanun_yok' WHEN m.mevzuat_no IS NULL THEN 'bulunamadi' WHEN mulga THEN 'mulga' WHEN kismi_mulga THEN 'kismi_mulga' ELSE 'tamam' END AS durum
    FROM r LEFT JOIN m ON r.no = m.mevzuat_no AND r.madde = m.madde_no"""
)
def citation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether each cited article exists and is in force."""
    return citations.audited(_mentions(spark, d), table(spark, d, "madde")).select("kayit_no", "pos", "kanun", "madde", "durum")


@query(
    """SELECT mevzuat_no, sum((NOT mulga AND NOT kismi_mulga)::INT)::BIGINT AS tamam, sum(mulga::INT)::BIGINT AS mulga, sum((kismi_mulga AND NOT mulga)::INT)::BIGINT AS kismi_mulga, count(*) AS toplam FROM madde GROUP BY 1"""
)
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Articles of each law by status, zeros included."""
    status = F.when(F.col("mulga"), "mulga").when(F.col("kismi_mulga"), "kismi_mulga").otherwise("tamam")
    rows = table(spark, d, "madde").select("mevzuat_no", status.alias("durum"))
    return relational.zero_filled(rows, "mevzuat_no", "durum", ["tamam", "mulga", "kismi_mulga"])


@query(
    f"""WITH {_MENTIONS}, x AS (SELECT kanun || '-' || madde AS dugum, karar_id, min(kayit_no) AS ilk FROM me JOIN karar USING (kayit_no) GROUP BY ALL)
    SELECT dugum, karar_id, row_number() OVER (PARTITION BY dugum ORDER BY ilk, karar_id)::INT AS sira FROM x WHERE dugum IN (SELECT mevzuat_no || '-' || madde_no FROM madde) QUALIFY sira <= 8"""
)
def decisions_of_articles(spark: SparkSession, d: str) -> DataFrame:
    """The first eight decisions of each cited article that exists, one row a decision."""
    cited = _mentions(spark, d).join(table(spark, d, "karar").select("kayit_no", "karar_id"), "kayit_no")
    return citations.decisions_of_articles(cited, table(spark, d, "madde"))


@query(
    f"""WITH {_EDGES}, m AS (SELECT mevzuat_no || '-' || madde_no AS hedef, mevzuat_adi AS ad, baslik FROM madde WHERE mevzuat_no IS NOT NULL AND madde_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hedef ORDER BY kayit_no) = 1)
    SELECT kaynak, ed.hedef AS hedef, iliski, ad, baslik, m.hedef IS NOT NULL AS var FROM ed LEFT JOIN m ON ed.hedef = m.hedef"""
)
def citation_targets(spark: SparkSession, d: str) -> DataFrame:
    """Citations with the name and heading of the cited article, and whether it exists."""
    return citations.targets(_edges(spark, d), table(spark, d, "madde")).select("kaynak", "hedef", "iliski", "ad", "baslik", "var")


_SCORE = f"round(len(list_intersect(list_distinct({sql_tokens('anahtar')}), list_distinct({sql_tokens('metin')})))::DOUBLE / greatest(len(list_distinct({sql_tokens('anahtar')})), 1), 3)"
_POOL = lambda name, live, order: f"SELECT id, daire, esas_no, karar_no, karar_tarihi, {live} AS canli, {order} AS o, kayit_no, {_SCORE} AS skor FROM {name}"


@query(
    f"""WITH u AS ({_POOL("karar_kaydi", "false", 0)} UNION ALL {_POOL("danistay_karari", "true", 1)}),
        k AS (SELECT *, CASE WHEN coalesce(daire, '') <> '' THEN daire || ' ' || coalesce(esas_no, '') || ' E., ' || coalesce(karar_no, '') || ' K.'
            WHEN coalesce(esas_no, '') || coalesce(karar_no, '') <> '' THEN coalesce(esas_no, '') || '|' || coalesce(karar_no, '') ELSE 'id ' || id END AS kisa FROM u),
        f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY kisa ORDER BY o, kayit_no) = 1),
        t AS (SELECT *, try_strptime(CASE WHEN regexp_matches(karar_tarihi, '^\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}$') THEN karar_tarihi END, '%d.%m.%Y')::DATE AS g FROM f),
        r AS (SELECT daire, id, canli, skor, g AS tarih, row_number() OVER (PARTITION BY daire ORDER BY skor DESC, g DESC NULLS LAST, o, kayit_no)::INT AS sira FROM t QUALIFY sira <= 3)
    SELECT *, CASE WHEN bool_and(canli) OVER w THEN 'canli' WHEN bool_or(canli) OVER w THEN 'karma' ELSE 'yerel' END AS kaynak FROM r WINDOW w AS (PARTITION BY daire)"""
)
def merged_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Both pools without repeated short names, the three best of each chamber: by score (the share of
    the search words in the text, as a stand-in for a cross-encoder), then by date, bad dates last. With
    the label of the pools that the three come from."""
    columns = ["id", "daire", "esas_no", "karar_no", "karar_tarihi", "kayit_no"]
    asked, said = F.array_distinct(text.tokens("anahtar")), F.array_distinct(text.tokens("metin"))
    score = F.round(F.size(F.array_intersect(asked, said)) / F.greatest(F.size(asked), F.lit(1)), 3)
    pools = [table(spark, d, t).select(*columns, score.alias("skor"), F.lit(live).alias("canli"), F.lit(int(live)).alias("_o")) for t, live in (("karar_kaydi", False), ("danistay_karari", True))]
    return decisions.merged(pools[0].unionByName(pools[1]), ["_o", "kayit_no"], 3)


@query(
    f"""WITH w AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents), p AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1)::INT AS pos FROM w),
        h AS (SELECT doc_id, pos FROM p WHERE term IN ('karar', 'mahkeme', 'sozlesme', 'dava', 'talep', 'sure')),
        c AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 59 FOLLOWING) AS n FROM h)
    SELECT doc_id, pos AS bas, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) = 1"""
)
def densest_windows(spark: SparkSession, d: str) -> DataFrame:
    """Where sixty words of each document hold the most of the sought terms."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(text.tokens("text")).alias("_i", "term"))
    hits = rows.filter(F.col("term").isin("karar", "mahkeme", "sozlesme", "dava", "talep", "sure")).select("doc_id", (F.col("_i") + 1).alias("pos"))
    return relational.densest(hits, "doc_id", "pos", 60)


@query(
    """WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE value < 5)
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS sira FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND s.event_type = e.event_type) QUALIFY sira <= 5"""
)
def not_yet_shown(spark: SparkSession, d: str) -> DataFrame:
    """The best events of each user, of kinds in which the user has no event below 5."""
    rows = table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return relational.minus(rows, rows.filter("value < 5"), ["user_id", "event_type"], "user_id", [F.desc("value"), F.col("event_id")], 5).select("user_id", "event_id", "sira")


@query(
    """WITH r AS (SELECT ts::DATE AS gun, event_id, value, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n, sum(round(value * 100)::BIGINT) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS t FROM events)
    SELECT gun, count(*) AS istek, round(sum(value), 2) AS tutar, sum((n <= 1500 AND t <= 100000)::INT)::BIGINT AS kabul FROM r GROUP BY 1"""
)
def daily_budget(spark: SparkSession, d: str) -> DataFrame:
    """Calls and spending of each day, and how many calls fit both caps."""
    rows = table(spark, d, "events").select(F.to_date("ts").alias("gun"), "ts", "event_id", "value")
    cents = F.round(F.col("value") * 100).cast("long")
    summed = relational.running(rows, "gun", [F.col("ts"), F.col("event_id")], F.date_trunc("minute", "ts"), {"_n": F.lit(1), "_t": cents})
    fits = F.sum(((F.col("_n") <= 1_500) & (F.col("_t") <= 100_000)).cast("int"))
    return summed.groupBy("gun").agg(F.count("*").alias("istek"), F.round(F.sum("value"), 2).alias("tutar"), fits.alias("kabul"))


@query(
    """SELECT date_trunc('hour', ts) AS saat, event_type, count(*) AS n, round(sum(value), 2) AS tutar, count(DISTINCT user_id) AS kisi, sum(coalesce((props->>'k')::INT, 0))::BIGINT AS k FROM events GROUP BY 1, 2"""
)
def metric_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts, sums and users of each kind of event, with a JSON field."""
    rows = table(spark, d, "events").withColumn("saat", F.date_trunc("hour", "ts").cast("timestamp_ntz")).withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    return rows.groupBy("saat", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("tutar"), F.countDistinct("user_id").alias("kisi"), F.sum(F.coalesce("_k", F.lit(0))).alias("k"))


@query(
    """SELECT e.event_id, p.event_id AS onceki FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) p
    ON e.user_id = p.user_id AND e.ts >= p.ts"""
)
def events_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last click of the same user at or before each purchase, by one window and no join."""
    rows = table(spark, d, "events").filter(F.col("event_type").isin("click", "purchase")).select("user_id", "ts", "event_id", "event_type")
    order = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    click = F.max(F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))).over(order)
    return rows.withColumn("_c", click).filter("event_type = 'purchase'").select("event_id", F.col("_c.event_id").alias("onceki"))


@query(
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS sira FROM lineitem QUALIFY sira <= 8"""
)
def top_lines(spark: SparkSession, d: str) -> DataFrame:
    """The eight dearest lines of each supplier."""
    order = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.row_number().over(order).alias("sira")).filter("sira <= 8")


@query(
    """SELECT c_custkey, c_name, count(o_orderkey) AS siparis, coalesce(round(sum(o_totalprice), 2), 0.0) AS tutar FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2"""
)
def orders_of_customers(spark: SparkSession, d: str) -> DataFrame:
    """Orders of every customer, also of those without any; counted before the join."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    rows = table(spark, d, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left")
    return rows.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("siparis"), F.coalesce(F.round("t", 2), F.lit(0.0)).alias("tutar"))


@query(
    f"""WITH a AS (SELECT karar_id, list_distinct(flatten(list(regexp_extract_all(gerekce, '[0-9]{{3,4}}')))) AS a FROM karar GROUP BY 1),
        b AS (SELECT karar_id, list_distinct(flatten(list(regexp_extract_all(tam_metin, '[0-9]{{3,4}}')))) AS b FROM karar GROUP BY 1)
    SELECT karar_id, array_to_string(list_sort(list_filter(a, lambda x: NOT coalesce(list_contains(b, x), false))), ' ') AS kayip FROM a LEFT JOIN b USING (karar_id)"""
)
def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in the pieces of a decision that its whole text lacks: a check of answers by context."""
    rows = table(spark, d, "karar").select("karar_id", "gerekce", "tam_metin")

    def numbers(column: str, name: str) -> DataFrame:
        found = rows.select("karar_id", F.explode_outer(F.regexp_extract_all(column, F.lit("[0-9]{3,4}"), F.lit(0))).alias("n")).distinct()
        return found.groupBy("karar_id").agg(F.collect_set("n").alias(name))

    joined = numbers("gerekce", "a").join(numbers("tam_metin", "b"), "karar_id", "left")
    lacking = F.array_except("a", F.coalesce("b", F.array().cast("array<string>")))
    return joined.select("karar_id", F.array_join(F.array_sort(lacking), " ").alias("kayip"))


@query()
def filed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Repeated uploads replace the older document of the same file name; rows without one all stay."""
    rows = table(spark, d, "documents").select("doc_id", "belge", F.length("text").alias("n"))
    named = relational.first_per_key(rows.filter("belge is not null"), ["belge"], [F.desc("doc_id")])
    return named.unionByName(rows.filter("belge is null"))


@query("SELECT date_trunc('day', ts) AS gun, count(*) AS istek, round(sum(value), 2) AS tutar FROM events GROUP BY 1")
def streamed_spending(spark: SparkSession, d: str) -> DataFrame:
    """Daily calls and spending by a stream over the event file, run once to its end."""
    import uuid

    from terazi.session import shared_dir
    from terazi.streaming.flows import daily_spending, run_once

    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    name = f"gunluk_{uuid.uuid4().hex}"
    done = run_once(daily_spending(stream), name, f"{shared_dir(spark)}/{name}", "complete")
    return done.select(F.col("gun").cast("timestamp_ntz").alias("gun"), "istek", F.round("tutar", 2).alias("tutar"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS yeni FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(yeni) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS bas, max(ts) AS son, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events of a user without an hour's gap."""
    from terazi.streaming.flows import sessions

    found = sessions(table(spark, d, "events"), "user_id")
    return found.select("user_id", F.col("bas").cast("timestamp_ntz").alias("bas"), F.col("son").cast("timestamp_ntz").alias("son"), "n")


@query(
    f"""WITH w AS (SELECT unnest(regexp_extract_all({sql_lower('gerekce')}, '[0-9]{{3,5}}\\s*say[ıi]l[ıi]')) AS a, karar_id FROM karar), c AS (SELECT regexp_extract(a, '^[0-9]+') AS kanun, karar_id FROM w)
    SELECT kanun, count(*) AS anma, count(DISTINCT karar_id) AS karar FROM c GROUP BY 1"""
)
def law_mentions(spark: SparkSession, d: str) -> DataFrame:
    """How often decisions name each law, and in how many of them."""
    found = F.explode(F.regexp_extract_all(text.turkish_lower("gerekce"), F.lit(r"[0-9]{3,5}\s*say[ıi]l[ıi]"), F.lit(0)))
    rows = table(spark, d, "karar").select(found.alias("a"), "karar_id").select(F.regexp_extract("a", "^[0-9]+", 0).alias("kanun"), "karar_id")
    # Two aggregations instead of a distinct count: no law's decisions have to meet in one task first.
    each = rows.groupBy("kanun", "karar_id").agg(F.count("*").alias("n"))
    return each.groupBy("kanun").agg(F.sum("n").alias("anma"), F.count("*").alias("karar"))
