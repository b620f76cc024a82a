"""Queries of scalar functions, projections, lines and privacy, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.functions import checks, text
from terazi.operators import documents, privacy
from terazi.plans.registry import registry
from terazi.session import table

QUERIES, ORACLE_SQL, query = registry()


def sql_fold(c: str) -> str:
    return f"lower(translate({c}, 'şŞıIİğĞüÜöÖçÇâÂîÎûÛ' || chr(775), 'ssiiigguuooccaaiiuu'))"


def sql_lower(c: str) -> str:
    return f"lower(translate({c}, 'İI', 'iı'))"


def sql_tokens(c: str) -> str:
    return f"regexp_extract_all(coalesce({sql_fold(c)}, ''), '[\\p{{L}}\\p{{N}}_]+')"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\s' || chr(160) || ']+', ' ', 'g'))"


def sql_joined(sep: str, *parts: str) -> str:
    return f"concat_ws({sep}, " + ", ".join(f"nullif({p}, '')" for p in parts) + ")"


@query(f"SELECT kayit_no, {sql_fold('metin')} AS katli, len({sql_tokens('metin')})::INT AS n FROM madde")
def fold_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "madde").select("kayit_no", text.fold("metin").alias("katli"), F.size(text.tokens("metin")).alias("n"))


@query(
    f"""SELECT kayit_no,
        {sql_joined("chr(10)", "mevzuat_adi", "'[' || nullif(bolum, '') || ']'", "'Madde ' || madde_no", "baslik", "metin")} AS gomme,
        {sql_joined("' '", "mevzuat_adi", "baslik", "baslik", "baslik", "'madde ' || madde_no", "metin")} AS sozcuk,
        {sql_joined("' | '", "mevzuat_adi", "'Madde ' || madde_no", "baslik", "metin")} AS eleme
    FROM madde"""
)
def article_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts for embedding, lexical search and reranking of each article."""
    section = F.concat(F.lit("["), F.when(F.col("bolum") != "", F.col("bolum")), F.lit("]"))
    name, lower = F.concat(F.lit("Madde "), "madde_no"), F.concat(F.lit("madde "), "madde_no")
    return table(spark, d, "madde").select(
        "kayit_no",
        text.joined("\n", "mevzuat_adi", section, name, "baslik", "metin").alias("gomme"),
        text.joined(" ", "mevzuat_adi", "baslik", "baslik", "baslik", lower, "metin").alias("sozcuk"),
        text.joined(" | ", "mevzuat_adi", name, "baslik", "metin").alias("eleme"),
    )


@query(
    """SELECT kayit_no, coalesce(nullif(mahkeme, ''), 'Yargıtay') AS m,
        CASE WHEN starts_with(daire, 'Yargıtay') OR starts_with(daire, 'Danıştay') THEN daire ELSE coalesce(nullif(mahkeme, ''), 'Yargıtay') || ' ' || daire END
        || ' ' || coalesce(esas_no, '') || ' E., ' || coalesce(karar_no, '') || ' K.'
        || CASE WHEN parca_adet > 1 THEN ' (' || parca_no || '/' || parca_adet || ')' ELSE '' END AS kisa_ad,
        'karar-' || karar_id || '-' || parca_no AS kimlik
    FROM karar"""
)
def decision_names(spark: SparkSession, d: str) -> DataFrame:
    """Short citation names and ids of decision pieces."""
    court = F.coalesce(F.when(F.col("mahkeme") != "", F.col("mahkeme")), F.lit("Yargıtay"))
    named = F.when(F.col("daire").startswith("Yargıtay") | F.col("daire").startswith("Danıştay"), F.col("daire")).otherwise(F.concat(court, F.lit(" "), "daire"))
    none = F.lit("")
    part = F.when(F.col("parca_adet") > 1, F.concat(F.lit(" ("), "parca_no", F.lit("/"), "parca_adet", F.lit(")"))).otherwise("")
    return table(spark, d, "karar").select(
        "kayit_no",
        court.alias("m"),
        F.concat(named, F.lit(" "), F.coalesce("esas_no", none), F.lit(" E., "), F.coalesce("karar_no", none), F.lit(" K."), part).alias("kisa_ad"),
        F.concat(F.lit("karar-"), "karar_id", F.lit("-"), "parca_no").alias("kimlik"),
    )


def _sql_html(c: str) -> str:
    e = f"coalesce({c}, '')"
    for _ in range(2):
        e = f"regexp_replace({e}, '(?is)<\\s*(?:style[^>]*>.*?<\\s*/\\s*style|script[^>]*>.*?<\\s*/\\s*script)\\s*>', ' ', 'g')"
        e = f"regexp_replace({e}, '(?i)<\\s*(?:br|/p|/div|/tr|/li)[^>]*>', chr(10), 'g')"
        e = f"regexp_replace({e}, '<[^>]+>', ' ', 'g')"
        for mark, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''")):
            e = f"replace({e}, '{mark}', '{sign}')"
    e = f"regexp_replace(regexp_replace({e}, '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g')"
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT kayit_no, {_sql_html('metin')} AS duz FROM karar_kaydi UNION ALL SELECT kayit_no, {_sql_html('metin')} AS duz FROM danistay_karari")
def html_lines(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of both courts as plain lines."""
    rows = [table(spark, d, t).select("kayit_no", text.html_text("metin").alias("duz")) for t in ("karar_kaydi", "danistay_karari")]
    return rows[0].unionByName(rows[1])


#: The SQL has its own copy of the lines, so that a wrong one shows.
_SQL_HEADS = "|".join(
    (
        '^\\s*"?içtihat metni"?\\s*(?:t\\.?c\\.?)?\\s*$', "^\\s*t\\.?c\\.?\\s*$", "^\\s*karar\\s+içeriği\\s*$", "^\\s*danıştay.*[0-9]{4}/[0-9]+\\s*e\\.?.*$", "^\\s*(?:[a-zçğıöşü]+\\s+){0,3}daires[iı]?\\s*(?:başkanlığı)?\\s*$",
        "^\\s*(?:birinci|ikinci|üçüncü|dördüncü|beşinci|altıncı|yedinci|sekizinci|dokuzuncu|onuncu|onbirinci|onikinci|onüçüncü|ondördüncü|onbeşinci)\\s+daire\\s*$",
        "^\\s*idar[iı]\\s+dava\\s+da[iı]reler[iı]\\s+kurulu\\s*$", "^\\s*(?:temyiz\\s+eden|karşı\\s+taraf|vekili|vekilleri|müdahil|istemin\\s+özeti)(?:[^\\p{L}\\p{N}_].*)?:.*$", "^\\s*(?:yargılama\\s+süreci|dava\\s+konusu\\s+istem)\\s*:?\\s*$",
        "^\\s*(?:mahkemesi|dava türü|davacı|davalı|taraflar|dava|ilgili kanun)\\s*:.*$", "^\\s*yargıtay\\s+(?:ilamı|kararı|[0-9]+)\\s*$", "^\\s*[0-9]+\\.\\s*(?:hukuk|ceza)\\s+dairesi\\s+[0-9]{4}/[0-9]+\\s*e\\..*$", "^\\s*taraflar\\s+arasında\\s+görülen\\s+dava.*$",
        "^\\s*(?:tar[iı]h[iı]|numarası|esas\\s*no|karar\\s*no|[iı]lam\\s*no)\\s*:.*$", "^.*(?:temyiz\\s+edilmiş\\s+olmakla|tetkik\\s+hakimi\\s+tarafından\\s+düzenlenen\\s+rapor).*$", "^\\s*(?:hukuk|ceza)\\s+genel\\s+kurulu\\s+[0-9]{4}/[0-9]+\\s*e\\..*$",
        "^\\s*(?:ba[şs]kan|[üu]ye|kat[iı]p|kâtip)(?:[^\\p{L}\\p{N}_].*)?$",
    )
)
_SQL_CAPITALS = "^\\s*(?:[A-ZÇĞİÖŞÜ]\\s+){3,}[A-ZÇĞİÖŞÜ]\\s*$|^\\s*[A-ZÇĞİÖŞÜ\\s./]{3,40}\\s*:\\s*\\.{0,4}\\s*$"
_HEAD = f"regexp_matches({sql_lower('x')}, '{_SQL_HEADS}') OR regexp_matches(x, '{_SQL_CAPITALS}')"
_BODY = f"array_to_string(list_filter(list_transform(string_split({_sql_html('metin')}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT ({_HEAD})), chr(10))"


@query(f"SELECT kayit_no, {_BODY} AS govde FROM karar_kaydi UNION ALL SELECT kayit_no, {_BODY} AS govde FROM danistay_karari")
def decision_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of both courts without head, signatures and blank lines."""
    rows = [table(spark, d, t).select("kayit_no", text.decision_body("metin").alias("govde")) for t in ("karar_kaydi", "danistay_karari")]
    return rows[0].unionByName(rows[1])


@query(
    """SELECT kayit_no, CASE WHEN coalesce(mevzuat_no, '') = '' OR coalesce(tertip, '') = '' THEN '' ELSE
        'https://mevzuat.example/mevzuat?MevzuatNo=' || mevzuat_no || '&MevzuatTur=' || coalesce(tur, 1) || '&MevzuatTertip=' || tertip END AS adres,
        CASE WHEN coalesce(pdf_url, '') = '' THEN '' WHEN regexp_matches(pdf_url, '^https?://') THEN pdf_url ELSE 'https://mevzuat.example/' || ltrim(pdf_url, '/') END AS tam
    FROM mevzuat_kaydi"""
)
def official_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Official and absolute addresses of each entry of the catalogue."""
    lacking = (F.coalesce("mevzuat_no", F.lit("")) == "") | (F.coalesce("tertip", F.lit("")) == "")
    link = F.concat(F.lit("https://mevzuat.example/mevzuat?MevzuatNo="), "mevzuat_no", F.lit("&MevzuatTur="), F.coalesce("tur", F.lit(1)), F.lit("&MevzuatTertip="), "tertip")
    url = F.col("pdf_url")
    whole = F.when(F.coalesce(url, F.lit("")) == "", "").when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://mevzuat.example/"), F.expr("trim(LEADING '/' FROM pdf_url)")))
    return table(spark, d, "mevzuat_kaydi").select("kayit_no", F.when(lacking, "").otherwise(link).alias("adres"), whole.alias("tam"))


_SQL_NAMES = """('sosyal sigortalar ve genel saglik sigortasi kanunu', '5510'), ('kisisel verilerin korunmasi kanunu', '6698'), ('tuketicinin korunmasi hakkinda kanun', '6502'), ('is sagligi ve guvenligi kanunu', '6331'),
    ('idari yargilama usulu kanunu', '2577'), ('hukuk muhakemeleri kanunu', '6100'), ('ceza muhakemesi kanunu', '5271'), ('icra ve iflas kanunu', '2004'), ('turk borclar kanunu', '6098'), ('turk ticaret kanunu', '6102'),
    ('turk medeni kanunu', '4721'), ('vergi usul kanunu', '213'), ('turk ceza kanunu', '5237'), ('avukatlik kanunu', '1136'), ('kabahatler kanunu', '5326'), ('borclar kanunu', '6098'), ('medeni kanunu', '4721'), ('ticaret kanunu', '6102'),
    ('medeni kanun', '4721'), ('ceza kanunu', '5237'), ('is kanunu', '4857'), ('iyuk', '2577'), ('kvkk', '6698'), ('tbk', '6098'), ('tmk', '4721'), ('tck', '5237'), ('hmk', '6100'), ('ttk', '6102'), ('cmk', '5271'), ('vuk', '213'),
    ('ikk', '6331'), ('iik', '2004'), ('ik', '4857')"""
_SQL_KIND = "(?:(ek|geçici|gecici|mükerrer|mukerrer)\\s+)?"
_SQL_TOLD = _SQL_KIND + "(?:madde|m\\.|mad\\.)\\s*(?:([0-9]+)\\s*/\\s*([a-zçğıöşü])(?:$|[^\\p{L}])|([0-9]+))|" + _SQL_KIND + "([0-9]+(?:\\s*/\\s*[a-zçğıöşü])?)\\s*(?:\\.|inci|nci|uncu|üncü|ıncı|ncı|ncu|ncü)\\s*madde"


@query(
    f"""WITH n AS (SELECT *, row_number() OVER () AS o FROM (VALUES {_SQL_NAMES}) v(ad, kanun)),
        t AS (SELECT doc_id, coalesce({sql_fold('text')}, '') AS f, coalesce({sql_lower('text')}, '') AS low, ' ' || regexp_replace(f, '[^\\p{{L}}\\p{{N}}_ ]', '|', 'g') || ' ' AS z FROM documents),
        b AS (SELECT doc_id, arg_min(ad, o) AS ad, arg_min(kanun, o) AS kanun FROM t JOIN n ON contains(z, ' ' || ad || ' ') OR contains(z, ' ' || ad || '|') OR contains(z, '|' || ad || ' ') OR contains(z, '|' || ad || '|') GROUP BY 1),
        g AS (SELECT t.doc_id, ad, kanun, f, low, regexp_extract(low, '{_SQL_TOLD}', ['k1', 'n1', 'h1', 'n2', 'k2', 'n3']) AS m,
            regexp_extract(low, '(?:^|[^\\p{{L}}\\p{{N}}])([0-9]{{3,5}})\\s*(?:sayılı|sayili|say\\.|kanunu?(?:$|[^\\p{{L}}\\p{{N}}])|(?:ek|geçici|gecici|mükerrer|mukerrer)?\\s*(?:madde|m\\.|mad\\.))', 1) AS no FROM t LEFT JOIN b USING (doc_id)),
        r AS (SELECT doc_id, coalesce(kanun, no) AS kanun, m.k1 || m.k2 AS kind, CASE WHEN m.n1 <> '' THEN m.n1 || '/' || m.h1 ELSE m.n2 || m.n3 END AS told,
            CASE WHEN ad IS NULL THEN '' ELSE regexp_extract(substr(f, instr(f, ad) + length(ad)), '^[\\s,.:]*([0-9]+(?:\\s*/\\s*[a-z])?)\\s*(?:\\.|inci|nci|uncu)?\\s*(?:madde[\\p{{L}}]*)?\\s*$', 1) END AS behind FROM g),
        a AS (SELECT doc_id, kanun, kind, upper(translate(regexp_replace(CASE WHEN told <> '' THEN told ELSE behind END, '\\s', '', 'g'), 'iı', 'İI')) AS a FROM r)
    SELECT doc_id, kanun, CASE WHEN a = '' THEN '' ELSE (CASE WHEN kind = 'ek' THEN 'Ek ' WHEN kind IN ('geçici', 'gecici') THEN 'Geçici ' WHEN kind IN ('mükerrer', 'mukerrer') THEN 'Mükerrer ' ELSE '' END) || a END AS madde, kanun <> '' AS atifli FROM a"""
)
def text_references(spark: SparkSession, d: str) -> DataFrame:
    """The law, by name, abbreviation or number, and the article that each document names."""
    docs, named = table(spark, d, "documents").select("doc_id", "text", text.law_name("text").alias("_n")), F.col("_n")
    return docs.select("doc_id", text.law_reference("text", named).alias("kanun"), text.article_reference("text", named).alias("madde")).withColumn("atifli", F.col("kanun") != "")


@query()
def core_queries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions without question words, and whether they hold several facts."""
    docs = table(spark, d, "documents")
    several = (F.length("text") >= 55) & (F.regexp_count("text", F.lit(r"[,;?]")) >= 2)
    return docs.select("doc_id", text.core_query("text").alias("cekirdek"), F.coalesce(several, F.lit(False)).alias("cok_olgulu"))


@query(
    f"""WITH w AS (SELECT kayit_no, list_distinct(regexp_extract_all(regexp_replace(coalesce({sql_fold('ad')}, ''), '{text.LAW_WORDS}', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+')) AS s FROM mevzuat_kaydi)
    SELECT kayit_no, array_to_string(list_sort(CASE WHEN len(list_filter(s, lambda x: length(x) > 3)) > 0 THEN list_filter(s, lambda x: length(x) > 3) ELSE s END), ' ') AS anahtar FROM w"""
)
def law_keys(spark: SparkSession, d: str) -> DataFrame:
    """The telling words of each law's name, in order."""
    return table(spark, d, "mevzuat_kaydi").select("kayit_no", F.array_join(F.array_sort(text.law_name_words("ad")), " ").alias("anahtar"))


def _sql_spelled(c: str) -> str:
    e = f"coalesce({sql_fold(c)}, '')"
    parts = [f"CASE WHEN regexp_matches({e}, '(?:^|[^\\p{{L}}\\p{{N}}_]){u}(?:$|[^\\p{{L}}\\p{{N}}_])') THEN {n} END" for u, n in text.UNITS.items()]
    for t, n in text.TENS.items():
        parts.append(f"CASE WHEN contains({e}, '{t}') THEN {n} END")
        parts += [f"CASE WHEN regexp_matches({e}, '{t}\\s*{u}') THEN {n + k} END" for u, k in text.UNITS.items()]
    return f"list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)))"


@query(f"SELECT kayit_no, array_to_string({_sql_spelled('metin')}, ',') AS sayilar FROM madde")
def numbers_in_words(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that each article writes in words."""
    return table(spark, d, "madde").select("kayit_no", F.array_join(text.spelled_numbers("metin"), ",").alias("sayilar"))


@query(
    f"""SELECT kayit_no, coalesce(baslik, '') <> '' AND length(coalesce(baslik, '')) <= 90 AND NOT regexp_matches({sql_lower("coalesce(baslik, '')")}, '^\\s*(?:(?:ek|geçici)\\s+)?madde\\s*\\d')
        AND NOT regexp_matches(coalesce(baslik, ''), '^\\s*(?:[a-zçğıöşü]\\)|\\d+\\)|\\()') AND NOT regexp_matches(rtrim(coalesce(baslik, '')), '[,;.]$') AND NOT starts_with(coalesce(baslik, ''), ':') AS uygun
    FROM madde"""
)
def plausible_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "madde").select("kayit_no", text.title_plausible("baslik").alias("uygun"))


@query(
    r"""SELECT kayit_no, len(regexp_extract_all(coalesce(metin, ''), '\((?:Ek|Değişik|Mülga|İptal)\s*:[^)]{0,200}\)'))::INT AS n,
        coalesce(regexp_matches(metin, '^\s*\(\s*(?:Mülga|İptal)\s*:'), false) AS tam,
        coalesce(regexp_matches(metin, '\(\s*(?:Mülga|İptal)\s*:') AND NOT regexp_matches(metin, '^\s*\(\s*(?:Mülga|İptal)\s*:'), false) AS kismi,
        regexp_replace(metin, '(\((?:Ek|Değişik|Mülga|İptal)\s*:[^)]{0,200}\))\d{1,8}', '\1', 'g') AS temiz
    FROM madde"""
)
def amendment_flags(spark: SparkSession, d: str) -> DataFrame:
    """Amendment marks, whole and partial repeal, and text without sticking note digits."""
    whole, any_ = F.col("metin").rlike(r"^\s*" + text.REPEALED), F.col("metin").rlike(text.REPEALED)
    return table(spark, d, "madde").select(
        "kayit_no",
        F.size(text.amendments("metin")).alias("n"),
        F.coalesce(whole, F.lit(False)).alias("tam"),
        F.coalesce(any_ & ~whole, F.lit(False)).alias("kismi"),
        text.without_note_digits("metin").alias("temiz"),
    )


@query("SELECT kayit_no, (('0x' || substr(sha1(chunk_id), 1, 16))::UBIGINT % 9223372036854775808::UBIGINT)::BIGINT AS kimlik FROM madde")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """63-bit ids of the articles' keys, the same in any process."""
    return table(spark, d, "madde").select("kayit_no", text.stable_id("chunk_id").alias("kimlik"))


@query(
    """SELECT kayit_no, try_strptime(CASE WHEN regexp_matches(karar_tarihi, '^\\d{2}\\.\\d{2}\\.\\d{4}$') THEN karar_tarihi END, '%d.%m.%Y')::DATE AS tarih,
        coalesce(year(try_strptime(CASE WHEN regexp_matches(karar_tarihi, '^\\d{2}\\.\\d{2}\\.\\d{4}$') THEN karar_tarihi END, '%d.%m.%Y')), 0)::INT AS yil
    FROM karar_kaydi"""
)
def decision_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of decisions; malformed ones are null and sort as year 0."""
    day = text.dotted_date("karar_tarihi")
    return table(spark, d, "karar_kaydi").select("kayit_no", day.alias("tarih"), F.coalesce(F.year(day), F.lit(0)).alias("yil"))


@query("SELECT doc_id, regexp_replace(regexp_replace(trim(belge), '[^\\p{L}\\p{N}._-]+', '_', 'g'), '^[._]+', '') AS ad FROM documents")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.safe_name("belge").alias("ad"))


_DIGIT = lambda i: f"substr(v, {i}, 1)::INT"


@query(
    f"""WITH c AS (SELECT DISTINCT karar_id, unnest(regexp_extract_all(tam_metin, '\\b\\d{{11}}\\b')) AS v FROM karar),
        s AS (SELECT karar_id, v, {_DIGIT(1)} + {_DIGIT(3)} + {_DIGIT(5)} + {_DIGIT(7)} + {_DIGIT(9)} AS o, {_DIGIT(2)} + {_DIGIT(4)} + {_DIGIT(6)} + {_DIGIT(8)} AS e FROM c)
    SELECT karar_id, v AS deger, substr(v, 1, 1) <> '0' AND ((o * 7 - e) % 10 + 10) % 10 = {_DIGIT(10)} AND (o + e + {_DIGIT(10)}) % 10 = {_DIGIT(11)} AS gecerli FROM s"""
)
def national_ids(spark: SparkSession, d: str) -> DataFrame:
    """Runs of eleven digits in decisions, and whether their check digits are right."""
    runs = table(spark, d, "karar").select("karar_id", F.explode(F.regexp_extract_all("tam_metin", F.lit(r"\b\d{11}\b"), F.lit(0))).alias("deger")).distinct()
    return runs.select("karar_id", "deger", checks.national_id_valid(F.col("deger")).alias("gecerli"))


@query(
    r"""WITH c AS (SELECT DISTINCT karar_id, unnest(regexp_extract_all(tam_metin, '\bTR\s?\d{2}(?:\s?\d{4}){5}\s?\d{2}\b')) AS v FROM karar),
        b AS (SELECT karar_id, v, replace(v, ' ', '') AS x FROM c)
    SELECT karar_id, v AS deger, ((substr(x, 5, 22) || '2927' || substr(x, 3, 2))::HUGEINT % 97)::INT AS kalan FROM b"""
)
def account_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Account numbers in decisions with their remainder by 97."""
    runs = table(spark, d, "karar").select("karar_id", F.explode(F.regexp_extract_all("tam_metin", F.lit(r"\bTR\s?\d{2}(?:\s?\d{4}){5}\s?\d{2}\b"), F.lit(0))).alias("deger")).distinct()
    return runs.select("karar_id", "deger", checks.iban_remainder(F.col("deger")).alias("kalan"))


@query(
    r"""WITH c AS (SELECT kayit_no, metin, unnest(list_distinct(regexp_extract_all(metin, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]*[A-Za-z0-9_]'))) AS v FROM danistay_karari)
    SELECT kayit_no, v AS deger, '[EPOSTA_' || row_number() OVER (PARTITION BY kayit_no ORDER BY instr(metin, v), v) || ']' AS yer FROM c"""
)
def mail_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """E-mail addresses of decisions with placeholders numbered by first sight."""
    found = privacy.identifiers(table(spark, d, "danistay_karari").select("kayit_no", "metin"), "kayit_no", "metin").filter("tur = 'EPOSTA'")
    return found.select("kayit_no", "deger", "yer")


@query()
def masked_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of both tables with placeholders; ``geri`` tells whether the map gives the text back."""
    whole = table(spark, d, "karar").select(F.lit("karar").alias("kaynak"), F.col("karar_id").alias("id"), F.col("tam_metin").alias("metin"), F.xxhash64("tam_metin").alias("h"))
    rows = whole.dropDuplicates(["id", "h"]).drop("h").unionByName(table(spark, d, "danistay_karari").select(F.lit("danistay_karari").alias("kaynak"), "id", "metin"))
    masked = privacy.masked(rows.withColumn("_row", F.struct("kaynak", "id", "metin")), "_row", "metin")
    return masked.select("_row.kaynak", "_row.id", "maskeli", F.size("tablo").alias("n"), privacy.unmasked().eqNullSafe(F.col("_row.metin")).alias("geri"))


#: The SQL has its own copy of the patterns, so that a wrong one shows.
_LEAKS = r"""struct_pack(tur := 'dosya', n := len(regexp_extract_all(coalesce(metin, ''), '(?:20|19)\d{2}\s*/\s*\d{1,6}\s*(?:E\.?|K\.?|[Ee]sas|[Kk]arar)'))::INT),
    struct_pack(tur := 'vergi', n := len(regexp_extract_all(coalesce(metin, ''), '\b\d{10}\b'))::INT), struct_pack(tur := 'sasi', n := len(regexp_extract_all(coalesce(metin, ''), '\b[A-HJ-NPR-Z0-9]{17}\b'))::INT),
    struct_pack(tur := 'dogum', n := len(regexp_extract_all(coalesce(metin, ''), '(?:[Dd]oğum|d\.?t\.?)[^\n]{0,20}\d{1,2}[./]\d{1,2}[./]\d{4}'))::INT),
    struct_pack(tur := 'sicil', n := len(regexp_extract_all(coalesce(metin, ''), '(?:[Ss]icil|[Rr]uhsat|[Pp]oliçe|[Pp]olice)\s*(?:no|numarası|numarasi)\s*[:.]?\s*[A-Za-z0-9_/-]*[0-9][A-Za-z0-9_/-]*'))::INT),
    struct_pack(tur := 'hesap', n := len(regexp_extract_all(coalesce(metin, ''), '(?:[Hh]esap|HESAP)\s*(?:no|numarası)?\s*[:.]?\s*\d[\d -]{9,}'))::INT)"""
_TEXTS = "(SELECT DISTINCT 'karar' AS kaynak, karar_id AS id, tam_metin AS metin FROM karar UNION ALL SELECT 'danistay_karari', id, metin FROM danistay_karari)"


@query(f"WITH c AS (SELECT kaynak, id, unnest([{_LEAKS}]) AS c FROM {_TEXTS}) SELECT kaynak, id, c.tur AS tur, sum(c.n)::BIGINT AS n FROM c WHERE c.n > 0 GROUP BY 1, 2, 3")
def leak_scan(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers that decisions of both tables still show, by kind."""
    whole = table(spark, d, "karar").select(F.lit("karar").alias("kaynak"), F.col("karar_id").alias("id"), F.col("tam_metin").alias("metin"), F.xxhash64("tam_metin").alias("h"))
    rows = whole.dropDuplicates(["id", "h"]).drop("h").unionByName(table(spark, d, "danistay_karari").select(F.lit("danistay_karari").alias("kaynak"), "id", "metin"))
    counts = privacy.leak_counts(rows.select(F.struct("kaynak", "id").alias("_k"), "metin"), "_k", "metin")
    return counts.groupBy("_k.kaynak", "_k.id", "tur").agg(F.sum("n").alias("n"))


_PROTECTED = ("mahkemesi", "kanunu", "dairesi", "kurulu", "bölge", "hukuk")


@query(
    f"""WITH c AS (SELECT karar_id, unnest(regexp_extract_all(tam_metin, '[A-ZÇĞİÖŞÜ][a-zçğıöşü]{{2,}}(?: [A-ZÇĞİÖŞÜ][a-zçğıöşü]{{2,}}){{1,3}}')) AS aday FROM (SELECT DISTINCT karar_id, tam_metin FROM karar)),
        n AS (SELECT karar_id, aday, count(*) AS n FROM c WHERE NOT list_has_any(string_split({sql_lower('aday')}, ' '), {list(_PROTECTED)}) GROUP BY 1, 2)
    SELECT karar_id, aday, n FROM n QUALIFY row_number() OVER (PARTITION BY karar_id ORDER BY n DESC, aday) <= 25"""
)
def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised runs of decisions that may be names."""
    whole = table(spark, d, "karar").select("karar_id", F.col("tam_metin").alias("t"), F.xxhash64("tam_metin").alias("h"))
    return privacy.capital_runs(whole.dropDuplicates(["karar_id", "h"]), "karar_id", "t", _PROTECTED)


@query(
    """WITH l AS (SELECT kayit_no, unnest(string_split(metin, chr(10))) AS satir, generate_subscripts(string_split(metin, chr(10)), 1)::INT AS sira FROM madde)
    SELECT kayit_no, sira, satir, lag(satir) OVER w AS onceki, lead(satir) OVER w AS sonraki FROM l WINDOW w AS (PARTITION BY kayit_no ORDER BY sira)"""
)
def line_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Lines of articles with the lines before and after."""
    return documents.neighbours(documents.lines(table(spark, d, "madde"), "kayit_no", "metin"), "kayit_no")


_HEADINGS = ", ".join(f"'{h}'" for h in documents.HEADINGS)


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS satir, generate_subscripts(string_split(text, chr(10)), 1)::INT AS sira FROM documents),
        h AS (SELECT *, coalesce(regexp_extract(satir, '^\\s*([A-ZÇĞİÖŞÜ ]{{3,40}}?)\\s*(?::.*)?$', 1) IN ({_HEADINGS}), false) AS b FROM l)
    SELECT doc_id, sira, satir, last_value(CASE WHEN b THEN satir END IGNORE NULLS) OVER w AS bolum, coalesce(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER w, 0)::INT AS bolum_no
    FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY sira ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def section_fill(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents with the section they stand in."""
    return documents.filled_sections(documents.lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id", documents.is_heading(F.col("satir")))


@query()
def petition_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of documents without parties and enclosures."""
    return documents.sections(table(spark, d, "documents"), "doc_id", "text")


@query()
def decision_packs(spark: SparkSession, d: str) -> DataFrame:
    """Decisions cut into packs of whole paragraphs."""
    return documents.packs(table(spark, d, "karar_kaydi"), "kayit_no", text.decision_body("metin"))


@query(
    f"""WITH w AS (SELECT unnest(regexp_extract_all({sql_lower('metin')}, '\\p{{L}}+')) AS dogru FROM madde),
        c AS (SELECT dogru, count(*) AS n FROM w WHERE length(dogru) >= 3 GROUP BY 1),
        b AS (SELECT {sql_fold('dogru')} AS katli, dogru, n FROM c QUALIFY row_number() OVER (PARTITION BY {sql_fold('dogru')} ORDER BY n DESC, dogru) = 1)
    SELECT katli, dogru, n FROM b WHERE katli <> dogru"""
)
def spelling(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent spelling of each folded word of the articles."""
    return documents.spelling_map(table(spark, d, "madde"), "metin")


@query()
def respelled_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents written without Turkish letters, respelled by the map of the articles."""
    ascii_docs = table(spark, d, "documents").select("doc_id", F.translate("text", text.FOLD_FROM, "sSiIIgGuUoOcCaAiIuU").alias("text"))
    return documents.respelled(ascii_docs, "doc_id", "text", documents.spelling_map(table(spark, d, "madde"), "metin"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS satir, generate_subscripts(string_split(text, chr(10)), 1)::INT AS sira FROM documents),
        b AS (SELECT *, lag(satir) OVER (PARTITION BY doc_id ORDER BY sira) AS o FROM l),
        p AS (SELECT *, sum(CASE WHEN o IS NULL OR trim(o) = '' OR regexp_matches(o, '[.!?:;…]\\s*$') OR trim(satir) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sira ROWS UNBOUNDED PRECEDING)::INT AS paragraf_no FROM b),
        g AS (SELECT doc_id, paragraf_no, trim(string_agg(trim(satir), ' ' ORDER BY sira)) AS paragraf FROM p GROUP BY 1, 2)
    SELECT * FROM g WHERE paragraf <> ''"""
)
def joined_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents joined to paragraphs."""
    return documents.joined_lines(documents.lines(table(spark, d, "documents").filter("text is not null"), "doc_id", "text"), "doc_id")


@query()
def article_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of articles, for highlights."""
    rows = table(spark, d, "madde").select("kayit_no", F.posexplode(documents.clauses(F.col("metin"))).alias("i", "parca"))
    return rows.select("kayit_no", (F.col("i") + 1).alias("sira"), "parca")


@query(
    f"""WITH l AS (SELECT kayit_no, string_split({_sql_html('metin')}, chr(10))[1:20] AS s FROM karar_kaydi),
        g AS (SELECT kayit_no, list_filter(list_transform(s, lambda x: regexp_extract(x, '^\\s*Mahkemesi\\s*:\\s*(.*)$', 1)), lambda x: x <> '') AS m, list_filter(list_transform(s, lambda x: regexp_extract(x, '^\\s*TARİHİ\\s*:\\s*(\\d{{2}}/\\d{{2}}/\\d{{4}})', 1)), lambda x: x <> '') AS t FROM l)
    SELECT kayit_no, coalesce(m[1], '') AS ilk_mahkeme, coalesce(t[1], '') AS ilk_tarih FROM g"""
)
def decision_meta(spark: SparkSession, d: str) -> DataFrame:
    """The first court and date that the first twenty lines of a decision name."""

    def first(lines, pattern):
        found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")
        return F.coalesce(F.get(found, F.lit(0)), F.lit(""))

    rows = table(spark, d, "karar_kaydi").select("kayit_no", F.slice(F.split(text.html_text("metin"), "\n"), 1, 20).alias("s"))
    return rows.select("kayit_no", first(F.col("s"), r"^\s*Mahkemesi\s*:\s*(.*)$").alias("ilk_mahkeme"), first(F.col("s"), r"^\s*TARİHİ\s*:\s*(\d{2}/\d{2}/\d{4})").alias("ilk_tarih"))


@query(
    """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
        k AS (SELECT doc_id, trim(regexp_extract(text, '(?:^|\\n)\\s*KONU\\s*:\\s*([^\\n]*)', 1)) AS k, list_filter(s, lambda x: length(trim(x)) >= 60 AND upper(x) <> x)[1] AS u FROM l)
    SELECT doc_id, CASE WHEN length(k) >= 20 THEN k ELSE coalesce(trim(u), '') END AS oz FROM k"""
)
def petition_essence(spark: SparkSession, d: str) -> DataFrame:
    """What a document is about: its subject line, else its first long line that isn't in capitals."""
    rows = table(spark, d, "documents").filter("text is not null")
    subject = F.trim(F.regexp_extract("text", r"(?:^|\n)\s*KONU\s*:\s*([^\n]*)", 1))
    long = F.get(F.filter(F.split("text", "\n"), lambda x: (F.length(F.trim(x)) >= 60) & (F.upper(x) != x)), F.lit(0))
    return rows.select("doc_id", F.when(F.length(subject) >= 20, subject).otherwise(F.coalesce(F.trim(long), F.lit(""))).alias("oz"))


@query(
    r"""SELECT kayit_no, trim(regexp_replace(regexp_replace(metin, '(?i)\(\s*(?:Ek|Değişik|Degisik|Mülga|Mulga|İptal|Iptal|Yeniden)(?:[^\p{L}\p{N}_)][^)]{0,79}?|)[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}[^)]{0,80}\)', '', 'g'), '\s{2,}', ' ', 'g')) AS temiz,
        regexp_replace(regexp_replace(coalesce(metin, ''), '[*_`#]', ' ', 'g'), '\s+', ' ', 'g') AS duz FROM madde"""
)
def clean_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles without notes of amendments, and without marks of markdown."""
    return table(spark, d, "madde").select("kayit_no", text.without_notes("metin").alias("temiz"), text.without_markdown("metin").alias("duz"))


@query(
    f"""WITH b AS (SELECT kayit_no, trim(regexp_replace({_BODY}, '\\s+', ' ', 'g')) AS f FROM karar_kaydi UNION ALL SELECT kayit_no, trim(regexp_replace({_BODY}, '\\s+', ' ', 'g')) FROM danistay_karari),
        h AS (SELECT kayit_no, f, substr(f, 1, 260) AS h, instr(reverse(substr(f, 1, 260)), ' .') AS i FROM b)
    SELECT kayit_no, CASE WHEN length(f) <= 260 THEN f WHEN i > 0 AND length(h) - i - 1 > 120 THEN substr(h, 1, length(h) - i) || ' …' ELSE rtrim(h) || ' …' END AS ozet FROM h"""
)
def decision_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The beginning of each decision of both courts in its own words."""
    rows = [table(spark, d, t).select("kayit_no", text.own_words(text.decision_body("metin")).alias("ozet")) for t in ("karar_kaydi", "danistay_karari")]
    return rows[0].unionByName(rows[1])
