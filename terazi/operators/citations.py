"""Citations: places of mentions, the law each belongs to, typed edges, adjacency and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.functions.text import turkish_lower
from terazi.operators.relational import first_per_key

#: Laws by name (fixed values); longer names are looked for first.
LAW_NAMES = {
    "türk borçlar kanunu": "6098", "borçlar kanunu": "6098",
    "türk medeni kanunu": "4721", "medeni kanun": "4721",
    "türk ceza kanunu": "5237", "ceza kanunu": "5237",
    "hukuk muhakemeleri kanunu": "6100", "türk ticaret kanunu": "6102",
    "iş kanunu": "4857", "deniz iş kanunu": "854", "basın iş kanunu": "5953",
    "sendikalar ve toplu iş sözleşmesi kanunu": "6356",
    "sosyal sigortalar ve genel sağlık sigortası kanunu": "5510",
    "iş mahkemeleri kanunu": "7036",
}
#: Signs of a relation, the first that fits wins (fixed values).
RELATIONS = (
    ("mulga", r"yürürlükten kaldırıl|mülga|ilga edil"),
    ("degistirir", r"değiştiril|değişik|eklenmiştir|ibaresi|ibareleri"),
    ("istisna", r"istisna|saklıdır|hariç|uygulanmaz|dışında|tabi değil|dahil değil|bu hüküm.{0,20}uygulanmaz"),
    ("yaptirim", r"idari para cezası|para cezası|aykırı hareket|cezalandırıl|aykırı davran"),
    ("gonderme", r"hükümleri uygulanır|hükümlerine göre|uyarınca|gereğince|hükümlerine tabi|hükmü uygulanır|belirtilen|göre"),
)
PRIORITY = ("mulga", "degistirir", "istisna", "yaptirim", "gonderme", "atif")
ORDINAL = r"(?:inci|ıncı|uncu|üncü|nci|ncı|ncu|ncü)"
#: "68, 69 ve 70 inci madde", "5. maddesi", at most ten numbers; "ek 3 üncü madde" begins a chain.
ARTICLES = rf"(?:(?:ek|geçici)\s+)?\b(?:\d{{1,4}}\s*(?:\.|{ORDINAL})?\s*(?:,|ve|ile|ila|–|-)\s*){{0,9}}\d{{1,4}}\s*(?:\.|{ORDINAL})?\s*madde"
#: One article in a decision: "m.53", "Madde 53", "53 üncü madde", "53. madde".
ARTICLE = rf"m\.\s*\d{{1,4}}\b|madde\s*[:-]?\s*\d{{1,4}}\b|\b\d{{1,4}}\s*(?:\.|{ORDINAL})?\s*madde"
LAW_MARK = r"\d{3,4}\s*say[ıi]l[ıi]|bu kanun|" + "|".join(sorted(LAW_NAMES, key=len, reverse=True))
STATUSES = ("tamam", "mulga", "kismi_mulga", "bulunamadi", "kanun_yok")


def located(text: Column, pattern: str) -> Column:
    """``array<struct<pos, match>>`` of a pattern without groups; positions from 1."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(m: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, g: a + F.length(g))
        inside = F.aggregate(F.slice(found, 1, i), F.lit(0), lambda a, g: a + F.length(g))
        return F.struct((before + inside + 1).alias("pos"), m.alias("match"))

    return F.coalesce(F.transform(found, place), F.array().cast("array<struct<pos:int,match:string>>"))


def law_of_mark(mark: Column, own: Column) -> Column:
    """Number of the law a marker names; "bu kanun" is the own law."""
    out = F.when(mark == "bu kanun", own)
    for name in sorted(LAW_NAMES, key=len, reverse=True):
        out = out.when(mark == name, LAW_NAMES[name])
    return out.otherwise(F.regexp_extract(mark, r"^(\d+)", 1))


def evidence(text: Column, pos: Column, radius: int = 240, length: int = 200) -> Column:
    """The sentence that holds a position, at most ``length`` characters around it."""
    start = F.greatest(F.lit(1), pos - radius)
    before = F.substring(text, start, pos - start)
    left = F.element_at(F.split(before, r"\.", -1), -1)
    right = F.substring(text, pos, F.lit(radius))
    stop = F.locate(".", right)
    right = F.when(stop > 0, F.substring(right, F.lit(1), stop)).otherwise(right)
    sentence = F.trim(F.regexp_replace(F.concat(left, right), r"\s+", " "))
    return F.substring(sentence, F.greatest(F.lit(1), F.length(F.ltrim(left)) - 99), F.lit(length))


def relation(sentence: Column) -> Column:
    low = turkish_lower(sentence)
    out = F.when(low.rlike(RELATIONS[0][1]), RELATIONS[0][0])
    for name, pattern in RELATIONS[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("atif")


def edges(articles: DataFrame, law: str = "mevzuat_no", article: str = "madde_no", text: str = "metin", tolerance: int = 150) -> DataFrame:
    """``kaynak, hedef, iliski, kanit``: citations from article to article, without self-citations.

    The target law is named by the last marker in the ``tolerance`` characters before; without one it
    is the own law. Null texts cite nothing; the same edge counts once, by its first evidence."""
    low, own = turkish_lower("_t"), F.col("_l")

    def cited_by(m: Column) -> Column:
        before = F.substring(F.col("_low"), F.greatest(F.lit(1), m["pos"] - tolerance), F.least(F.lit(tolerance), m["pos"] - 1))
        marks = F.regexp_extract_all(before, F.lit(LAW_MARK), F.lit(0))
        target = F.when(F.size(marks) == 0, own).otherwise(law_of_mark(F.try_element_at(marks, F.lit(-1)), own))
        # The word in front belongs to the first number alone.
        word = F.regexp_extract(m["match"], r"^(ek|geçici)\s", 1)
        prefix = F.when(word == "ek", "Ek ").when(word == "geçici", "Geçici ").otherwise("")
        numbers = F.transform(F.regexp_extract_all(m["match"], F.lit(r"\d+"), F.lit(0)), lambda n, i: F.when(i == 0, F.concat(prefix, n)).otherwise(n))
        return F.struct(m["pos"].alias("p"), target.alias("tl"), evidence(F.col("_t"), m["pos"]).alias("kanit"), F.array_distinct(numbers).alias("n"))

    # Evidence and law are cut out where the text is, so that no text travels with its citations.
    rows = articles.select(F.col(law).alias("_l"), F.col(article).alias("_a"), F.col(text).alias("_t")).withColumn("_low", low)
    found = rows.select("_l", "_a", F.explode(F.transform(located(F.col("_low"), ARTICLES), cited_by)).alias("_m"))
    cited = found.select("_l", "_a", F.col("_m.p").alias("_p"), F.col("_m.tl").alias("_tl"), F.col("_m.kanit").alias("kanit"), F.explode("_m.n").alias("_n"))
    cited = cited.filter(~((F.col("_tl") == F.col("_l")) & (F.col("_n") == F.col("_a"))))
    cited = cited.select(F.concat("_l", F.lit("-"), "_a").alias("kaynak"), F.concat("_tl", F.lit("-"), "_n").alias("hedef"), relation(F.col("kanit")).alias("iliski"), "kanit", "_p")
    best = cited.groupBy("kaynak", "hedef", "iliski").agg(F.min(F.struct("_p", "kanit")).alias("_k"))
    return best.select("kaynak", "hedef", "iliski", F.col("_k.kanit").alias("kanit"))


def adjacency(found: DataFrame) -> DataFrame:
    """``dugum, ileri, geri``: distinct targets and sources of each node, in order."""
    forward = found.groupBy(F.col("kaynak").alias("dugum")).agg(F.array_sort(F.collect_set("hedef")).alias("ileri"))
    back = found.groupBy(F.col("hedef").alias("dugum")).agg(F.array_sort(F.collect_set("kaynak")).alias("geri"))
    none = F.array().cast("array<string>")
    return forward.join(back, "dugum", "full").select("dugum", F.coalesce("ileri", none).alias("ileri"), F.coalesce("geri", none).alias("geri"))


def best_relations(found: DataFrame, k: int = 12) -> DataFrame:
    """The strongest relation of each pair; the first k targets of a source by strength and name."""
    strength = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("iliski"))
    one = first_per_key(found.withColumn("oncelik", strength.cast("int")), ["kaynak", "hedef"], [F.col("oncelik")])
    order = Window.partitionBy("kaynak").orderBy("oncelik", "hedef")
    return one.withColumn("sira", F.row_number().over(order)).filter(F.col("sira") <= k).select("kaynak", "hedef", "iliski", "sira")


def mentions(docs: DataFrame, id_col: str, text: str, near: int = 120) -> DataFrame:
    """``id_col, pos, kanun, madde``: article mentions with the law each belongs to.

    A law named by number at most ``near`` characters before comes first, then the nearest name or
    number before, then the nearest after. References and mentions are ordered in one window, so the
    as-of match needs no join."""
    low = turkish_lower(F.col(text))
    names = "|".join(sorted(LAW_NAMES, key=len, reverse=True))
    parts = F.concat(
        F.transform(located(low, r"\d{3,5}\s*say[ıi]l[ıi]"), lambda x: F.struct(x["pos"].alias("pos"), F.lit("no").alias("tip"), F.regexp_extract(x["match"], r"^(\d+)", 1).alias("deger"))),
        F.transform(located(low, names), lambda x: F.struct(x["pos"].alias("pos"), F.lit("ad").alias("tip"), x["match"].alias("deger"))),
        F.filter(F.transform(located(low, ARTICLE), lambda x: F.struct(x["pos"].alias("pos"), F.lit("madde").alias("tip"), F.regexp_extract(x["match"], r"\d+", 0).alias("deger"))), lambda x: x["deger"].rlike("[1-9]")),
    )
    rows = docs.select(F.col(id_col), F.explode(parts).alias("p")).select(id_col, "p.pos", "p.tip", "p.deger")
    order = Window.partitionBy(id_col).orderBy("pos", "tip")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    number = F.when(F.col("tip") == "no", F.struct("pos", "deger"))
    either = F.when(F.col("tip") != "madde", F.col("deger"))
    seen = rows.withColumn("_no", F.last(number, True).over(back)).withColumn("_left", F.last(either, True).over(back)).withColumn("_right", F.first(either, True).over(ahead))
    close = F.when(F.col("pos") - F.col("_no.pos") < near, F.col("_no.deger"))
    return seen.filter("tip = 'madde'").select(id_col, "pos", F.coalesce(close, F.col("_left"), F.col("_right")).alias("kanun"), F.col("deger").alias("madde")).filter("kanun is not null")


def resolved_law(name: Column) -> Column:
    """A law's number: itself if it is one, by its exact name, or by the first known name within it."""
    low = turkish_lower(name)
    out = F.when(name.rlike(r"^\d+$"), name)
    for known in LAW_NAMES:
        out = out.when(low == known, LAW_NAMES[known])
    for known in sorted(LAW_NAMES, key=len, reverse=True):
        out = out.when(low.contains(known), LAW_NAMES[known])
    return out


def audited(cited: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds ``durum`` to citations (``kanun, madde``): of repeated articles the first counts."""
    known = first_per_key(articles.select("mevzuat_no", "madde_no", "mulga", "kismi_mulga", "kayit_no"), ["mevzuat_no", "madde_no"], [F.col("kayit_no")])
    known = known.select(F.col("mevzuat_no").alias("_l"), F.col("madde_no").alias("_a"), "mulga", "kismi_mulga", F.lit(True).alias("_found"))
    rows = cited.withColumn("_no", resolved_law(F.col("kanun")))
    joined = rows.join(known, (F.col("_no") == F.col("_l")) & (F.col("madde") == F.col("_a")), "left")
    status = (
        F.when(F.col("_no").isNull(), "kanun_yok")
        .when(F.col("_found").isNull(), "bulunamadi")
        .when(F.col("mulga"), "mulga")
        .when(F.col("kismi_mulga"), "kismi_mulga")
        .otherwise("tamam")
    )
    return joined.withColumn("durum", status).drop("_no", "_l", "_a", "_found", "mulga", "kismi_mulga")


def targets(found: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds ``ad`` and ``baslik`` of the cited article, the first row of it, and ``var``: whether it exists."""
    known = articles.filter("mevzuat_no is not null and madde_no is not null").select(F.concat("mevzuat_no", F.lit("-"), "madde_no").alias("hedef"), F.col("mevzuat_adi").alias("ad"), "baslik", "kayit_no")
    first = first_per_key(known, ["hedef"], [F.col("kayit_no")]).drop("kayit_no").withColumn("var", F.lit(True))
    return found.join(first, "hedef", "left").withColumn("var", F.coalesce("var", F.lit(False)))


def decisions_of_articles(cited: DataFrame, articles: DataFrame, k: int = 8) -> DataFrame:
    """``dugum, karar_id, sira``: of each existing article the first k decisions that cite it (``kanun,
    madde, karar_id, kayit_no``), in the order of arrival. Citations of articles that don't exist are
    dropped, each decision counts once."""
    known = articles.select(F.concat("mevzuat_no", F.lit("-"), "madde_no").alias("dugum")).distinct()
    each = cited.select(F.concat("kanun", F.lit("-"), "madde").alias("dugum"), "karar_id", "kayit_no").groupBy("dugum", "karar_id").agg(F.min("kayit_no").alias("ilk"))
    order = Window.partitionBy("dugum").orderBy("ilk", "karar_id")
    return each.join(known, "dugum", "left_semi").withColumn("sira", F.row_number().over(order)).filter(F.col("sira") <= k).select("dugum", "karar_id", "sira")
