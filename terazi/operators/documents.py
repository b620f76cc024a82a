"""Lines, sections, packs and spelling of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.functions.text import fold, turkish_lower

#: Headings of petitions (fixed values), and sections that aren't searched.
HEADINGS = ("KONU", "AÇIKLAMALAR", "OLAYLAR", "HUKUKİ SEBEPLER", "HUKUKİ NEDENLER", "DELİLLER", "SONUÇ", "SONUÇ VE İSTEM", "TALEP", "DAVACI", "DAVALI", "VEKİLİ", "EKLER", "DAVA DİLEKÇESİ")
SKIPPED = ("DAVACI", "DAVALI", "VEKİLİ", "EKLER")


def lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id_col, sira, satir``: the lines of each text, numbered from 1."""
    return docs.select(F.col(id_col), F.posexplode(F.split(F.col(text), "\n")).alias("_i", "satir")).select(id_col, (F.col("_i") + 1).alias("sira"), "satir")


def neighbours(rows: DataFrame, id_col: str) -> DataFrame:
    """Adds the lines before and after."""
    order = Window.partitionBy(id_col).orderBy("sira")
    return rows.withColumn("onceki", F.lag("satir").over(order)).withColumn("sonraki", F.lead("satir").over(order))


def filled_sections(rows: DataFrame, id_col: str, heading: Column) -> DataFrame:
    """Adds ``bolum``, the last heading line at or before each line, and ``bolum_no``."""
    upto = Window.partitionBy(id_col).orderBy("sira").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bolum", F.last(F.when(heading, F.col("satir")), True).over(upto)).withColumn("bolum_no", F.sum(F.when(heading, 1).otherwise(0)).over(upto).cast("int"))


def is_heading(line: Column) -> Column:
    """A known heading, alone or before a colon."""
    name = F.regexp_extract(line, r"^\s*([A-ZÇĞİÖŞÜ ]{3,40}?)\s*(?::.*)?$", 1)
    return F.coalesce(name.isin(*HEADINGS), F.lit(False))


def sections(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id_col, bolum_no, bolum, metin``: the sections of each text; text before the first heading has
    number 0. Sections of parties and enclosures are left out."""
    marked = filled_sections(lines(docs, id_col, text), id_col, is_heading(F.col("satir")))
    packed = marked.groupBy(id_col, "bolum_no", "bolum").agg(F.array_sort(F.collect_list(F.struct("sira", "satir"))).alias("_l"))
    name = F.coalesce(F.regexp_extract("bolum", r"^\s*([A-ZÇĞİÖŞÜ ]{3,40}?)\s*(?::.*)?$", 1), F.lit(""))
    out = packed.select(id_col, "bolum_no", name.alias("bolum"), F.trim(F.array_join(F.transform("_l", lambda x: x["satir"]), "\n")).alias("metin"))
    return out.filter(~F.col("bolum").isin(*SKIPPED) & (F.col("metin") != ""))


def packed(paragraphs: Column, limit: int, separator: str = "\n") -> Column:
    """Greedy packs of paragraphs: a pack closes where the next paragraph would exceed the limit."""

    def add(state: Column, p: Column) -> Column:
        buf, out = state["buf"], state["out"]
        fits = (buf == "") | (F.length(buf) + F.length(p) + len(separator) <= limit)
        return F.when(
            fits,
            F.struct(out.alias("out"), F.when(buf == "", p).otherwise(F.concat(buf, F.lit(separator), p)).alias("buf")),
        ).otherwise(F.struct(F.array_append(out, buf).alias("out"), p.alias("buf")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))
    return F.aggregate(paragraphs, start, add, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.array_append(s["out"], s["buf"])))


def packs(docs: DataFrame, id_col: str, text: Column, limit: int = 1_500, least: int = 80) -> DataFrame:
    """``id_col, parca_no, parca_adet, parca``: packs of at least ``least`` characters, or the only one."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # Lambda variables bind what is used more than once, else it would be computed again each time.
    kept = F.element_at(F.transform(F.array(packed(paragraphs, limit)), lambda p: F.filter(p, lambda x: (F.length(x) >= least) | (F.size(p) == 1))), 1)
    numbered = F.element_at(
        F.transform(F.array(kept), lambda k: F.transform(k, lambda x, i: F.struct((i + 1).alias("parca_no"), F.size(k).alias("parca_adet"), x.alias("parca")))), 1
    )
    return docs.select(id_col, F.explode(numbered).alias("_s")).select(id_col, "_s.parca_no", "_s.parca_adet", "_s.parca")


def joined_lines(rows: DataFrame, id_col: str) -> DataFrame:
    """``id_col, paragraf_no, paragraf``: lines joined to paragraphs. A line goes on where the line
    before doesn't end a sentence or heading and neither is blank."""
    order = Window.partitionBy(id_col).orderBy("sira")
    before = F.lag("satir").over(order)
    new = before.isNull() | (F.trim(before) == "") | before.rlike(r"[.!?:;…]\s*$") | (F.trim("satir") == "")
    numbered = rows.withColumn("paragraf_no", F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    packed_lines = numbered.groupBy(id_col, "paragraf_no").agg(F.array_sort(F.collect_list(F.struct("sira", "satir"))).alias("_l"))
    out = packed_lines.select(id_col, "paragraf_no", F.trim(F.array_join(F.transform("_l", lambda x: F.trim(x["satir"])), " ")).alias("paragraf"))
    return out.filter("paragraf <> ''")


def clauses(text: Column, limit: int = 220, least: int = 40) -> Column:
    """Clauses of about ``limit`` characters: a text is cut behind . ; : and white space, parts are packed
    greedily, and a short last one joins the one before."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.;:])\s+"), lambda x: F.trim(x) != "")

    def merged(c: Column) -> Column:
        n = F.size(c)
        last = F.concat(F.element_at(c, n - 1), F.lit(" "), F.element_at(c, n))
        return F.when((n > 1) & (F.length(F.element_at(c, n)) < least), F.concat(F.slice(c, 1, n - 2), F.array(last))).otherwise(c)

    return F.element_at(F.transform(F.array(packed(parts, limit, " ")), merged), 1)


def spelling_map(texts: DataFrame, text: str, shortest: int = 3) -> DataFrame:
    """``katli, dogru, n``: the most frequent spelling of each folded word where the two differ; equal
    counts go to the alphabetically first."""
    word = F.explode(F.regexp_extract_all(turkish_lower(text), F.lit(r"[\p{L}]+"), F.lit(0)))
    counted = texts.select(word.alias("dogru")).filter(F.length("dogru") >= shortest).groupBy("dogru").agg(F.count("*").alias("n"))
    order = Window.partitionBy("katli").orderBy(F.desc("n"), "dogru")
    best = counted.withColumn("katli", fold("dogru")).withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    return best.filter("katli <> dogru").select("katli", "dogru", "n")


def respelled(queries: DataFrame, id_col: str, text: str, spelling: DataFrame) -> DataFrame:
    """``id_col, duzeltilmis``: plain ASCII words of three letters and more get their spelling; all
    other characters and words stay. Words of capitals only stay too."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    plain = F.array_distinct(F.filter(parts, lambda w: w.rlike(r"^[A-Za-z]{3,}$") & ~w.rlike(r"^[A-Z]+$")))
    words = queries.select(F.col(id_col), F.explode(plain).alias("_w")).withColumn("_key", fold("_w"))
    known = words.join(spelling.select(F.col("katli").alias("_key"), "dogru"), "_key")
    # A document gets its own words' spellings as a map, and is put together where it is.
    maps = known.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("_w", "dogru"))).alias("_m"))
    joined = queries.select(F.col(id_col), F.col(text).alias("_t"), parts.alias("_parts")).join(maps, id_col, "left")
    fixed = F.when(F.col("_m").isNull(), F.col("_t")).otherwise(F.array_join(F.transform("_parts", lambda w: F.coalesce(F.try_element_at(F.col("_m"), w), w)), ""))
    return joined.filter("_t is not null").select(id_col, fixed.alias("duzeltilmis"))
