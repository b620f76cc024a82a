"""Text that looks right but is written with other characters, brought to one form.

The work is SQL: each Arrow batch is a table of an in-memory DuckDB, whose expressions compose accents
(``nfc_normalize``), map compatibility forms (``translate``), drop invisible characters and replace
look-alike letters inside Latin words (``regexp_replace``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.llm.words import LOOK_ALIKES

#: Characters that show nothing (fixed values).
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"
#: Spaces of other widths (fixed values).
SPACES = "               　"
#: Ligatures and their letters (fixed values).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def compatibility_forms() -> dict[str, str]:
    """Full-width and mathematical forms of one ASCII character each, by rule."""
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    styled = {chr(c): n for c in range(0x1D400, 0x1D800) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()}
    styled |= {"\U0001d6a4": "ı"}
    return wide | styled


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def normal_form_sql() -> str:
    """The DuckDB expression for the one form of column ``t``.

    A Latin word is a run of letters with a Latin letter in it; only there are look-alikes replaced,
    so words wholly in another script, units and signs stay as they are."""
    forms = compatibility_forms()
    e = f"regexp_replace(t, {_text(_class(INVISIBLE))}, '', 'g')"
    e = f"translate({e}, {_text(''.join(forms) + SPACES)}, {_text(''.join(forms.values()) + ' ' * len(SPACES))})"
    for ligature, letters in LIGATURES.items():
        e = f"replace({e}, '{ligature}', '{letters}')"
    # Composition is for marks; signs such as the ohm stay as they are.
    e = f"(SELECT CASE WHEN regexp_matches(m, '\\p{{M}}') THEN nfc_normalize(m) ELSE m END FROM (SELECT {e} AS m))"
    # Accents that a step above left apart, such as a dot above a small i.
    e = f"replace({e}, 'i̇', 'i')"
    alike, plain = "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values())
    word = "[\\p{L}\\p{M}]+"
    mixed = f"regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, {_text(_class(alike))})"
    fixed = f"CASE WHEN {mixed} THEN translate(w, {_text(alike)}, {_text(plain)}) ELSE w END"
    words = f"regexp_extract_all(n, '{word}|[^\\p{{L}}\\p{{M}}]+')"
    folded = f"list_aggregate(list_transform({words}, lambda w: {fixed}), 'string_agg', '')"
    inner = f"(SELECT CASE WHEN n <> '' AND regexp_matches(n, {_text(_class(alike))}) THEN {folded} ELSE n END FROM (SELECT {e} AS n))"
    return inner


def _connect():
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '256MB'")
    return con


def one_form(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, text_col, tek_bicim``: each text in one consistent form; it is a variant where the
    two differ.

    Null stays null, empty stays empty; repeated rows count each. Letter case, abbreviations and the
    number of plain spaces are left alone."""

    def normalize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        expression = normal_form_sql()
        try:
            for batch in batches:
                rows_in = pa.table({"i": pa.array(range(batch.num_rows), pa.int64()), "t": batch.column(1)})
                con.register("rows_in", rows_in)
                done = con.sql(f"SELECT {expression} AS f FROM rows_in ORDER BY i").to_arrow_table()
                con.unregister("rows_in")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), done["f"].combine_chunks().cast(pa.string())], ["_id", "_text", "tek_bicim"])
        finally:
            con.close()

    source = rows.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # Pure ASCII and plain Turkish need no DuckDB: they are their own form.
    plain = F.coalesce(F.col("_text").rlike(r"\A[\x00-\x7FçğıöşüÇĞİÖŞÜâîûÂÎÛ]*\z"), F.lit(True))
    kind = dict(source.dtypes)["_id"]
    other = source.filter(~plain).mapInArrow(normalize, f"_id {kind}, _text string, tek_bicim string")
    return source.filter(plain).withColumn("tek_bicim", F.col("_text")).unionByName(other).select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "tek_bicim")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terazi.llm import garbled

    articles = spark.read.parquet(f"{sf_dir}/madde.parquet").select("kayit_no", "metin")
    chambers = spark.read.parquet(f"{sf_dir}/karar.parquet").select("kayit_no", F.col("daire").alias("metin"))
    found = one_form(articles, "kayit_no", "metin").filter("tek_bicim <> metin")
    # Rows that were read with a wrong encoding belong to that problem.
    names = spark.read.parquet(f"{sf_dir}/mevzuat_kaydi.parquet").select("kayit_no", F.col("ad").alias("metin"))
    judged = garbled.restored(found, "kayit_no", "metin", garbled.train(articles.unionByName(names), "metin"))
    sound = found.join(judged.filter("not hasarli").select("kayit_no"), "kayit_no", "left_semi")
    return sound.select(F.lit("madde").alias("kaynak"), "*").unionByName(
        one_form(chambers, "kayit_no", "metin").filter("tek_bicim <> metin").select(F.lit("karar").alias("kaynak"), "*")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of articles and chambers written with variant or invisible characters."""
    return _variants(spark, sf_dir).select("kaynak", "kayit_no")


def p6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with the text in one form."""
    return _variants(spark, sf_dir).select("kaynak", "kayit_no", "tek_bicim")
