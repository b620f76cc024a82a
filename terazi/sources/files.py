"""Readers of landed files and tables of records; all give explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schemas of the entities (Spark DDL).
SCHEMAS = {
    "mevzuat_kaydi": "kayit_no long, mevzuat_no string, ad string, tur int, tur_adi string, tertip string, kabul_tarihi string, rg_tarihi string, rg_sayisi string, pdf_url string, doc_url string, metinsiz boolean, cekim_zamani timestamp_ntz",
    "madde": "kayit_no long, chunk_id string, mevzuat_no string, mevzuat_adi string, mevzuat_tur string, tertip string, madde_no string, baslik string, metin string, bolum string, degisiklikler array<string>, mulga boolean, kismi_mulga boolean, cekim_zamani timestamp_ntz",
    "karar_kaydi": "kayit_no long, id string, daire string, esas_no string, karar_no string, karar_tarihi string, durum string, anahtar string, metin string, cekim_zamani timestamp_ntz",
    "danistay_karari": "kayit_no long, id string, daire string, esas_no string, karar_no string, karar_tarihi string, anahtar string, metin string, mahkeme string, cekim_zamani timestamp_ntz",
    "karar": "kayit_no long, karar_id string, chunk_id string, daire string, esas_no string, karar_no string, karar_tarihi string, durum string, anahtar string, gerekce string, tam_metin string, mahkeme string, parca_no int, parca_adet int, cekim_zamani timestamp_ntz",
    "kenar": "kaynak string, hedef string, iliski string, kanit string",
    "gomme": "chunk_id string, embedding array<float>",
}

#: Sizes of the pages that are served in the place of missing documents, and the least size of a real
#: one (parameters of the source at hand).
LEAST_BYTES = 2_000


def schema(entity: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[entity])


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, else Windows-1254. No Python is involved.

    Spark's decoder knows ISO-8859-1; the six letters in which Turkish differs from it, and the signs
    at 0x80 to 0x9F, are set right by ``translate``."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    latin = F.decode(content, "ISO-8859-1")
    high = "€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œŸ"
    low = "".join(chr(b) for b in (0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9F))
    return F.coalesce(utf8, F.translate(latin, "ÐÝÞðýþ" + low, "ĞİŞğış" + high))


def text_files(spark: SparkSession, path: str, glob: str = "*.{txt,md,html}") -> DataFrame:
    """``belge, metin, boyut``: the text files below a folder; empty ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("belge"), decoded(F.col("content")).alias("metin"), F.col("length").alias("boyut"))
    return rows.filter("trim(metin) <> ''")


def real_documents(spark: SparkSession, path: str, fake_sizes: tuple[int, ...] = (), glob: str = "*.pdf") -> DataFrame:
    """``belge, boyut, icerik`` of fetched documents without stand-ins, known by size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    kept = files.filter(F.col("length") > LEAST_BYTES)
    if fake_sizes:
        kept = kept.filter(~F.col("length").isin(*fake_sizes))
    return kept.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("belge"), F.col("length").alias("boyut"), F.col("content").alias("icerik"))


def records(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """A JSON array or lines of records under the entity's schema; records that don't parse are kept in
    ``_bozuk`` for the dead-letter table."""
    wanted = schema(entity).add("_bozuk", "string")
    return spark.read.schema(wanted).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bozuk").json(path)
