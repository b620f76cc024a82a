"""Patterns of identifiers, stable placeholders, masking and back, and a scan for leaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.functions.checks import chassis_shape, iban_remainder, national_id_valid
from terazi.functions.text import turkish_lower
from terazi.operators.citations import located

#: Identifiers in the order in which they are looked for (fixed values, patterns without groups).
PATTERNS = (
    ("IBAN", r"\bTR\s?\d{2}(?:\s?\d{4}){5}\s?\d{2}\b"),
    ("SASI", r"\b[A-HJ-NPR-Z0-9]{17}\b"),
    ("VERGINO", r"(?iu)vergi\s*(?:kimlik\s*)?(?:no|numara(?:sı|si))?\s*[:.]?\s*\d{10}(?!\d)"),
    ("DOSYA", r"(?iu)dosya\s*(?:no|numara(?:sı|si))?\s*[:.]?\s*(?:19|20)\d{2}\s*/\s*\d{1,6}"),
    ("DOSYA", r"\b(?:19|20)\d{2}\s*/\s*\d{1,6}(?=\s*D\.\s*[İIi]?[şsŞS])"),
    ("EPOSTA", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]*[A-Za-z0-9_]"),
    ("TCKN", r"\b\d{11}\b"),
    ("TEL", r"\b(?:90[ .-]?)?0?[ .-]?5\d{2}[ .-]?\d{3}[ .-]?\d{2}[ .-]?\d{2}\b"),
    ("PLAKA", r"\b(?:0[1-9]|[1-7]\d|8[01])\s?[A-ZÇĞİÖŞÜ]{1,3}\s?\d{2,4}\b"),
)
#: Of a labelled identifier only the number is masked, the label stays.
NUMBER = {"VERGINO": r"\d{10}$", "DOSYA": r"(?:19|20)\d{2}\s*/\s*\d{1,6}$"}
#: What a leak scan looks for in text that should be masked (fixed values).
LEAKS = (
    ("dosya", r"(?:20|19)\d{2}\s*/\s*\d{1,6}\s*(?:E\.?|K\.?|[Ee]sas|[Kk]arar)"),
    ("vergi", r"\b\d{10}\b"),
    ("sasi", r"\b[A-HJ-NPR-Z0-9]{17}\b"),
    ("dogum", r"(?:[Dd]oğum|d\.?t\.?)[^\n]{0,20}\d{1,2}[./]\d{1,2}[./]\d{4}"),
    ("sicil", r"(?:[Ss]icil|[Rr]uhsat|[Pp]oliçe|[Pp]olice)\s*(?:no|numarası|numarasi)\s*[:.]?\s*[\w/-]*\d[\w/-]*"),
    ("hesap", r"(?:[Hh]esap|HESAP)\s*(?:no|numarası)?\s*[:.]?\s*\d[\d -]{9,}"),
)


def _kept(kind: str, value: Column) -> Column:
    if kind == "IBAN":
        return iban_remainder(value) == 1
    if kind == "TCKN":
        return national_id_valid(value)
    if kind == "SASI":
        return chassis_shape(value)
    return F.lit(True)


_PLACE = "array<struct<p:int,n:int,tur:string,deger:string>>"


def places(text: Column) -> Column:
    """``array<struct<p, n, tur, deger>>``: where identifiers stand, by position, from 1; without overlaps.

    Kinds are looked for in the order of ``PATTERNS``; what an earlier kind holds no later one gets.
    Everything stays in the row: one read of the text, no shuffle."""

    def of_kind(kind: str, pattern: str) -> Column:
        def place(m: Column) -> Column:
            value = F.regexp_extract(m["match"], NUMBER[kind], 0) if kind in NUMBER else m["match"]
            return F.struct((m["pos"] + F.length(m["match"]) - F.length(value)).cast("int").alias("p"), F.length(value).alias("n"), F.lit(kind).alias("tur"), value.alias("deger"))

        return F.filter(F.transform(located(text, pattern), place), lambda x: _kept(kind, x["deger"])).cast(_PLACE)

    def add(kept: Column, x: Column) -> Column:
        taken = F.exists(kept, lambda k: (k["p"] < x["p"] + x["n"]) & (x["p"] < k["p"] + k["n"]))
        return F.when(taken, kept).otherwise(F.array_append(kept, x))

    return F.array_sort(F.aggregate(F.concat(*[of_kind(*x) for x in PATTERNS]), F.array().cast(_PLACE), add))


def _numbered(found: Column) -> Column:
    """Adds ``yer`` to places: [TUR_n], numbered within type in the order of first sight."""

    def mark(x: Column) -> Column:
        values = F.array_distinct(F.transform(F.filter(found, lambda y: y["tur"] == x["tur"]), lambda y: y["deger"]))
        name = F.concat(F.lit("["), x["tur"], F.lit("_"), F.array_position(values, x["deger"]), F.lit("]"))
        return F.struct(x["p"].alias("p"), x["n"].alias("n"), x["tur"].alias("tur"), x["deger"].alias("deger"), name.alias("yer"))

    return F.transform(found, mark)


def identifiers(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id_col, tur, deger, ilk, yer``: distinct validated values of each document, with the place of the
    first and a placeholder numbered within type by first sight. Null texts have none."""
    rows = docs.select(F.col(id_col), _bound(places(F.col(text)), _numbered).alias("_p"))
    keys = F.transform("_p", lambda x: x["yer"])
    first = F.filter("_p", lambda x, i: F.array_position(keys, x["yer"]) == i + 1)
    return rows.select(id_col, F.explode(first).alias("x")).select(id_col, "x.tur", "x.deger", F.col("x.p").alias("ilk"), "x.yer")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def masked(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id_col, maskeli, tablo``: the text with placeholders in the places of identifiers, and the map back.

    Places are replaced by position, so a value inside a longer one or inside a placeholder is not hit.
    The map must not be stored with the text. A document without identifiers keeps its text."""
    rows = docs.select(F.col(id_col), F.col(text).alias("_t"), _bound(places(F.col(text)), _numbered).alias("_p"))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.substring(F.col("_t"), s["at"], x["p"] - s["at"]), x["yer"]).alias("out"), (x["p"] + x["n"]).alias("at"))
    done = F.aggregate("_p", start, step, lambda s: F.concat(s["out"], F.substring(F.col("_t"), s["at"], F.length("_t"))))
    table = F.map_from_entries(F.array_distinct(F.transform("_p", lambda x: F.struct(x["yer"], x["deger"]))))
    return rows.select(id_col, F.when(F.col("_t").isNotNull(), done).alias("maskeli"), F.coalesce(table, F.create_map().cast("map<string,string>")).alias("tablo"))


def unmasked(text: str = "maskeli", table: str = "tablo") -> Column:
    """The text before masking."""
    return F.aggregate(F.map_entries(table), F.col(text), lambda t, e: F.replace(t, e["key"], e["value"]))


def leak_counts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id_col, tur, n``: remaining identifiers by kind; kinds without any have no row."""
    counts = [F.struct(F.lit(kind).alias("tur"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(pattern)).alias("n")) for kind, pattern in LEAKS]
    return docs.select(id_col, F.explode(F.array(*counts)).alias("_c")).select(id_col, "_c.tur", "_c.n").filter("n > 0")


def capital_runs(docs: DataFrame, id_col: str, text: str, protected: tuple[str, ...], k: int = 25) -> DataFrame:
    """``id_col, aday, n``: capitalised runs without protected words, the k most frequent of each
    document; equal counts by name."""
    runs = F.regexp_extract_all(F.col(text), F.lit(r"[A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}(?: [A-ZÇĞİÖŞÜ][a-zçğıöşü]{2,}){1,3}"), F.lit(0))
    rows = docs.select(id_col, F.explode(runs).alias("aday"))
    words = F.split(turkish_lower("aday"), " ")
    rows = rows.filter(~F.arrays_overlap(words, F.array(*[F.lit(p) for p in protected])))
    counted = rows.groupBy(id_col, "aday").agg(F.count("*").alias("n"))
    order = Window.partitionBy(id_col).orderBy(F.desc("n"), "aday")
    return counted.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
