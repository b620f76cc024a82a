"""Template residue, notices and error pages instead of content, and addresses that lead nowhere.

Each article gets points from four sides. Its body is compared with the terms of its title (name of the
law, heading) and with the slug of the law's address; a body that shares none and has no stem of
legislation is unlike its place. Unlike bodies that recur under several laws of one host carry no
information about any of them. From these the terms of such responses are learnt, and unlike bodies
made of them count too, also where they do not recur. Detectors of placeholders and notices add to
that. ``POINTS`` says how much each counts; a body with ``ENOUGH`` points is residue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.session import written

#: Unfilled placeholders (fixed values, Java patterns).
PLACEHOLDERS = (
    r"\{\{[^{}]*\}\}",
    r"[$#]\{[^{}]+\}",
    r"\{%[^%]*%\}",
    r"<%=?[^%]*%>",
    r"%\([\p{L}_.]+\)[sd]",
    r"%[\p{L}][\p{L}_.]*%",
    r"\$[\p{L}][\p{L}_.]*\$",
    r"#[\p{L}][\p{L}_.]*#",
    r"@@[\p{L}_.]+@@",
    r"__[\p{L}][\p{L}_.]*__",
    r"\[\[[^\[\]]+\]\]",
    r"<<[^<>]+>>",
    r"«[\p{L}][\p{L}_.]*»",
    r"\{(?:[\p{L}][\p{L}_.]*|\d+)\}",
    r"\[[\p{L}][\p{L}_.]*\]",
    r"\[\p{Lu}[\p{Lu}_. ]+\]",
    r"(?iu)\[[\p{L}_. ]+(?:giriniz|gelecek|eklenecek|yazılacak|yazınız|seçiniz|doldurunuz)\]",
    r"\[(?:_{2,}|[●•.…]{1,})\]",
    r"(?<!\w)_{4,}(?!\w)",
    r"<(?!/?(?:p|br|div|span|b|i|u|a|table|tr|td|html|head|body|title)\b)[\p{L}_.]+>",
    r"&lt;[\p{L}_.]+&gt;",
)
#: Signs without which none of the patterns above can match.
SIGNS = r"[{}<>\[\]$#@%_«&]"
#: Placeholders and filler in words (fixed values), each with the words without which it can't match,
#: in lower case and with every form of i as i.
WORDS = (
    (("xxx",), r"\b[Xx]{3,}\b"),
    (("eklenecek", "gelecek", "girilecek", "yazilacak", "doldurulacak"), r"(?iu)\([^()]*(?:eklenecek|gelecek|girilecek|yazılacak|doldurulacak)[^()]*\)"),
    (("buraya",), r"(?iu)\bburaya\s+(?:\p{L}+\s+){0,3}(?:giriniz|gelecek|yazınız|ekleyiniz)"),
    (("todo", "fixme"), r"\b(?:TODO|FIXME)\b"),
    (("lorem",), r"(?i)\blorem ipsum\b"),
)
#: Stray program values that stand for a whole text (fixed values).
VALUES = r"(?i)^\s*(?:null|none|undefined|nan|nil|n/?a|\[object object\]|#(?:ref|value|n/?a|name|div/0)[!?]?|true|false|-?\d+)\s*$"
#: Filler that stands for a whole text (fixed values, gated like ``WORDS``).
FILLERS = (
    (("metin",), r"(?iu)^\s*(?:örnek metin[\s.,]*)+$"),
    (("deneme", "test", "örnek"), r"(?iu)^\s*(?:deneme|test|örnek)\s+(?:metni|metin|içeriği|içerik|kaydı|kayıt|verisi)\b.{0,40}$"),
    (("asdf",), r"(?iu)\basdf\b"),
    (("silinecek",), r"(?iu)\bsilinecek\.?\s*$"),
)
#: Notices of servers, firewalls, logins, loaders and scripts (fixed values, gated like ``WORDS``).
NOTICES = (
    (("<",), r"(?i)<(?:html|head|title|body)\b"),
    (
        ("denied", "gateway", "bad request", "unavailable", " error", "timed out", "too many", "forbidden", "not found", "object ", "try again", "firewall"),
        r"(?i)\b(?:access denied|bad gateway|bad request|service (?:temporarily )?unavailable|internal server error|server error in|runtime error|gateway time-?out|request timed out|upstream timed out|too many requests|forbidden|not found|object moved|object reference not set|please try again later|blocked by the firewall)\b",
    ),
    (("script",), r"(?i)\b(?:enable|turn on|allow|requires?)\s+(?:java)?script(?:s|ing)?\b|\bscripts? enabled\b|^\s*noscript\b"),
    (("javascript",), r"(?iu)\bjavascript'?[\p{L}]*\s+(?:açmanız|açınız|etkinleştir|çalıştır(?:ın|manız)|açın\b|izin ver)"),
    (("tarayicin",), r"(?iu)tarayıcın[\p{L}]+\s+(?:betik|javascript|script)"),
    (("betik", "script"), r"(?iu)\b(?:betik|script)\s+çalıştırmayı\b"),
    (("sayfa",), r"(?iu)sayfa\s+(?:gösterilemiyor|görüntülenemiyor|bulunamadı|mevcut değil)"),
    (("hata", "http", "error"), r"(?iu)\b(?:hata|http|error)\s*(?:kodu\s*)?[:#]?\s*\d{3}\b\s*[-–:.]"),
    (("bulunamadi", "mevcut", "yok"), r"(?iu)^\s*\d{3}\s*[-–]\s*(?:\p{L}+\s+){0,4}(?:bulunamadı|mevcut değil|yok)"),
    (("aradiğiniz",), r"(?iu)\baradığınız\s+(?:sayfa|belge|dosya)\b"),
    (("dizin yok",), r"(?iu)\bdosya ya da dizin yok\b"),
    (("bulunamadi", "görüntülenemiyor", "yüklen"), r"(?iu)\b(?:belge|sayfa|kaynak|dosya|içerik)\s+(?:bulunamadı|görüntülenemiyor|yüklenemedi|yüklenirken hata oluştu)\b[^\p{L}]*(?:\(hata kodu|\.?\s*$|\d)"),
    (("beklenmeyen",), r"(?iu)\bbeklenmeyen bir hata oluştu\b"),
    (("sistem yöneticisi",), r"(?iu)\bsistem yöneticisi(?:ne|yle)\s+(?:başvur|iletişim)"),
    (("oturumunuz",), r"(?iu)\boturumunuz(?:un)?\s+(?:süresi\s+)?(?:doldu|sona erdi|zaman aşımına)"),
    (("lütfen",), r"(?iu)\blütfen\s+(?:yeniden\s+|tekrar\s+)?(?:giriş yap|oturum aç|bekleyin)"),
    (("istek", "erişiminiz", "robot"), r"(?iu)\b(?:çok fazla istek|erişiminiz\s+(?:\p{L}+\s+){0,3}engellen|robot olmadığınızı)"),
    (("bakim",), r"(?iu)\bbakım çalışması\s+nedeniyle\b.*\b(?:hizmet|erişim)"),
    (("sistemimiz",), r"(?iu)\bsistemimiz\b.*\b(?:bakım|hizmet dışı|hizmet vere)"),
    (("yükleniyor",), r"(?iu)\b(?:sayfa|içerik|belge|veri)?\s*yükleniyor\b[\s.…]*$"),
    (("|",), r"(?iu)\|\s*(?:arama|yardım|iletişim|giriş|ana sayfa)\b"),
)
#: Stems by which legislation is known (fixed values).
LEGAL = r"(?iu)\b(?:kanun|yönetmeli|tebliğ|tüzü|tüzüğ|madde|fıkra|bent|hük(?:üm|mü)|mülga|değişik|ek\s*:|yürürlü|yürüt|bakan|kurul|idare|karar|ilgili|süre|hâl|hal|birim)"
#: Characters of damaged or oddly written text, which is no evidence of residue.
OTHER = "[^\\p{ASCII}çğıöşüâîûÇĞİÖŞÜÂÎÛ“”‘’…–«»]|\\p{L}\\?\\p{L}"
#: Under how many laws of one host a response recurs, and how many different terms it has at least.
LAWS, TERMS = 3, 2
#: Weight of the share of responses against a term's own counts, so that rare terms say little.
CAUTION = 5.0
#: What each sign counts, and how much makes residue.
POINTS = {"placeholder": 3, "notice": 3, "unlike": 1, "recurring": 1, "response": 1, "legal": -1}
ENOUGH = 2


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return hit


def _gated(text: Column, plain: Column, patterns: tuple[tuple[tuple[str, ...], str], ...]) -> Column:
    """Whether one of the patterns matches; each is tried only where one of its words occurs."""
    hit = F.lit(False)
    for words, p in patterns:
        there = F.lit(False)
        for w in words:
            there = there | plain.contains(w)
        hit = hit | (there & text.rlike(p))
    return hit


def plain_letters(text: Column) -> Column:
    """Lower case, every form of i as i: what the gates are looked for in."""
    return F.lower(F.translate(text, "İIı", "iii"))


def has_placeholder(text: Column, plain: Column | None = None) -> Column:
    plain = plain_letters(text) if plain is None else plain
    return F.coalesce((text.rlike(SIGNS) & _any(text, PLACEHOLDERS)) | _gated(text, plain, WORDS), F.lit(False))


def has_notice(text: Column, plain: Column | None = None) -> Column:
    plain = plain_letters(text) if plain is None else plain
    return F.coalesce(text.rlike(VALUES) | _gated(text, plain, FILLERS) | _gated(text, plain, NOTICES), F.lit(False))


def own_signs(text: Column) -> Column:
    """Whether a text shows by itself that it is residue; null and empty texts don't."""
    return has_placeholder(text) | has_notice(text)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}]{4,}"), F.lit(0)))


def features(articles: DataFrame) -> DataFrame:
    """``kayit_no``, the law's key, the detectors' answers and, of bodies that are unlike title and
    legislation, the body: one pass over the articles.

    A term of the title is shared if the body holds its first six letters, as endings vary."""
    text = F.col("metin")
    rows = articles.select("kayit_no", "mevzuat_tur", "mevzuat_no", "tertip", "metin", plain_letters(text).alias("_plain"), _terms(plain_letters(F.concat_ws(" ", "mevzuat_adi", "baslik"))).alias("_title"))
    shared = F.exists("_title", lambda w: F.col("_plain").contains(F.substring(w, 1, 6)))
    legal = F.coalesce(text.rlike(LEGAL), F.lit(False))
    unlike = F.coalesce((F.trim(text) != "") & ~legal & ~text.rlike(OTHER) & ~shared, F.lit(False))
    return rows.select(
        "kayit_no", "mevzuat_tur", "mevzuat_no", "tertip",
        has_placeholder(text, F.col("_plain")).alias("placeholder"), has_notice(text, F.col("_plain")).alias("notice"), legal.alias("legal"), F.when(unlike, F.col("_plain")).alias("body"),
    )


def slugs(laws: DataFrame) -> DataFrame:
    """The law's key, the host of its address and the terms and numbers of the address's slug."""
    url = F.coalesce("pdf_url", F.lit(""))
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    rows = laws.select(F.col("tur_adi").alias("mevzuat_tur"), "mevzuat_no", F.coalesce("tertip", F.lit("")).alias("_t"), F.regexp_extract(url, r"^https?://([^/?#]+)", 1).alias("_host"), path.alias("_path"))
    best = rows.groupBy("mevzuat_tur", "mevzuat_no", "_t").agg(F.max(F.struct("_host", "_path")).alias("_a"))
    return best.select("mevzuat_tur", "mevzuat_no", "_t", "_a._host", F.regexp_extract_all(plain_letters(F.col("_a._path")), F.lit(r"[\p{L}]{5,}|\d{4,}"), F.lit(0)).alias("_slug"))


def evidence(found: DataFrame, laws: DataFrame) -> DataFrame:
    """``kayit_no, unlike, recurring, response`` of the bodies in ``found`` (``features``) that are unlike
    title, legislation and slug. Laws that the catalogue lacks have no host and no slug.

    A response of ``TERMS`` terms recurs if the same words, numbers aside, stand under ``LAWS`` laws of
    one host. Terms
    are weighed by how much more often they stand in recurring bodies than in the other unlike ones;
    a body whose weights and the share of recurring bodies together give odds above one is made of
    them."""
    bodies = found.filter("body is not null").select("kayit_no", "mevzuat_tur", "mevzuat_no", F.coalesce("tertip", F.lit("")).alias("_t"), "body")
    placed = bodies.join(slugs(laws), ["mevzuat_tur", "mevzuat_no", "_t"], "left")
    away = ~F.coalesce(F.exists("_slug", lambda w: F.col("body").contains(w)), F.lit(False))
    skeleton = F.xxhash64(F.regexp_replace(F.regexp_replace(F.trim("body"), r"\d+", "0"), r"\s+", " "))
    rows = written(placed.filter(away).select("kayit_no", F.xxhash64("mevzuat_tur", "mevzuat_no", "_t").alias("_law"), F.coalesce("_host", F.lit("")).alias("_host"), skeleton.alias("_s"), _terms(F.col("body")).alias("_w")))
    # Two aggregations instead of a distinct count: no response has to meet in one task first.
    by_law = rows.filter(F.size("_w") >= TERMS).groupBy("_s", "_host", "_law").agg(F.count("*").alias("_n"))
    recurring = by_law.groupBy("_s", "_host").agg(F.count("*").alias("_laws")).filter(F.col("_laws") >= LAWS).select("_s").distinct()
    rows = rows.join(recurring.withColumn("recurring", F.lit(True)), "_s", "left").withColumn("recurring", F.coalesce("recurring", F.lit(False)))
    # Without any recurring body, or where all recur, the share has no odds and no body is called a response.
    prior = rows.agg(F.avg(F.col("recurring").cast("double"))).scalar()
    logit = lambda p: F.log(p) - F.log(1 - p)
    each = rows.select("kayit_no", "recurring", F.explode("_w").alias("_term"))
    counts = each.groupBy("_term").agg(F.sum(F.col("recurring").cast("int")).alias("_r"), F.count("*").alias("_n"))
    weights = counts.select("_term", (logit((F.col("_r") + CAUTION * prior) / (F.col("_n") + CAUTION)) - logit(prior)).alias("_g"))
    odds = each.join(weights, "_term").groupBy("kayit_no").agg((F.sum("_g") + logit(prior)).alias("_odds"))
    scored = rows.join(odds, "kayit_no", "left")
    return scored.select("kayit_no", F.lit(True).alias("unlike"), "recurring", F.coalesce(F.col("_odds") > 0, F.lit(False)).alias("response"))


def judged_articles(articles: DataFrame, laws: DataFrame) -> DataFrame:
    """``kayit_no, tur_adi, mevzuat_no, tertip``, the signs of ``POINTS`` and ``kalinti`` of each article.

    Null, blank, short and repealed articles are sound. Repeated rows are judged alike. Articles of
    laws that the catalogue lacks have no host; that takes no evidence away. Other columns are
    ignored."""
    found = written(features(articles))
    # A row number that repeats has the evidence of all its rows.
    seen = evidence(found, laws).groupBy("kayit_no").agg(*[F.max(c).alias(c) for c in ("unlike", "recurring", "response")])
    rows = found.drop("body").join(seen, "kayit_no", "left")
    signs = {name: F.coalesce(name, F.lit(False)) for name in POINTS}
    points = sum((F.when(signs[name], n).otherwise(0) for name, n in POINTS.items()), F.lit(0))
    return rows.select("kayit_no", F.col("mevzuat_tur").alias("tur_adi"), "mevzuat_no", "tertip", *[c.alias(name) for name, c in signs.items()], (points >= ENOUGH).alias("kalinti"))


def document_address(url: Column) -> Column:
    """Whether a text is the complete address of a document: scheme, host and a named file."""
    complete = url.rlike(r"^(?i)https?://[\w.-]+(?::\d+)?(?:/[^\s?#{}<>$\[\]|\\]*)*/[^/\s?#{}<>$\[\]|\\]+\.(?:pdf|docx?|rtf|odt|xlsx?|tiff?|zip)$")
    blank = url.rlike(r"(?i)/[^/]*(?:%7b|%7d|%24|%3c)[^/]*$") | url.rlike(r"(?i)/(?:[^/]*[._-])?(?:undefined|none|null|nan)(?:[._-][^/]*)?$")
    return complete & ~blank


def judged_laws(laws: DataFrame, articles: DataFrame) -> DataFrame:
    """``kayit_no, adres_bos, metinsiz_yanlis`` of each row of the catalogue.

    An address that is null or '' is sound. ``metinsiz`` is wrong where it says false though the law
    has articles and all of them are residue; null is no statement."""
    by_law = articles.groupBy("tur_adi", "mevzuat_no", F.coalesce("tertip", F.lit("")).alias("_t")).agg(F.min("kalinti").alias("_all"))
    rows = laws.select("kayit_no", "tur_adi", "mevzuat_no", F.coalesce("tertip", F.lit("")).alias("_t"), "pdf_url", "metinsiz").join(by_law, ["tur_adi", "mevzuat_no", "_t"], "left")
    bad = F.coalesce((F.col("pdf_url") != "") & ~document_address(F.col("pdf_url")), F.lit(False))
    wrong = F.coalesce(~F.col("metinsiz") & F.col("_all"), F.lit(False))
    return rows.select("kayit_no", bad.alias("adres_bos"), wrong.alias("metinsiz_yanlis"))


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/madde.parquet"), spark.read.parquet(f"{sf_dir}/mevzuat_kaydi.parquet")


def _verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The verdicts on articles, judged once and written, and those on the catalogue, which read them."""
    articles, laws = _read(spark, sf_dir)
    texts = written(judged_articles(articles, laws))
    return texts, judged_laws(laws, texts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, addresses and flags that hold residue instead of content."""
    texts, rows = _verdicts(spark, sf_dir)

    def named(df: DataFrame, table: str, field: str) -> DataFrame:
        return df.select(F.lit(table).alias("kaynak"), F.lit(field).alias("alan"), "kayit_no")

    return (
        named(texts.filter("kalinti"), "madde", "metin")
        .unionByName(named(rows.filter("adres_bos"), "mevzuat_kaydi", "pdf_url"))
        .unionByName(named(rows.filter("metinsiz_yanlis"), "mevzuat_kaydi", "metinsiz"))
    )


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``madde``, all columns, without those that p4_found names."""
    texts, _ = _verdicts(spark, sf_dir)
    return _read(spark, sf_dir)[0].join(texts.filter("kalinti").select("kayit_no"), "kayit_no", "left_anti")


def p4_clean_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``mevzuat_kaydi``, all columns, without those that p4_found names."""
    _, rows = _verdicts(spark, sf_dir)
    return _read(spark, sf_dir)[1].join(rows.filter("adres_bos or metinsiz_yanlis").select("kayit_no"), "kayit_no", "left_anti")
