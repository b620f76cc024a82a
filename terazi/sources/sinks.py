"""Writers: replace, merge by key, append if absent, dead letters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terazi.operators.relational import first_per_key


def replace_table(df: DataFrame, path: str) -> None:
    """Writes under a new name first, so that a failed job leaves the table as it was. The old table is
    moved away, not deleted, before the new one takes its place, and moved back if that fails."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(staging)
    jvm = spark._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    away = jvm.org.apache.hadoop.fs.Path(f"{staging}.old")
    there = fs.exists(old)
    if there and not fs.rename(old, away):
        raise OSError(f"{path} could not be moved away")
    if not fs.rename(new, old):
        if there:
            fs.rename(away, old)
        raise OSError(f"{staging} could not take the place of {path}")
    if there:
        fs.delete(away, True)


def merge_by_key(old: DataFrame, new: DataFrame, key: str, newest: Column) -> DataFrame:
    """Old and new rows, one for each key: the newest."""
    return first_per_key(old.unionByName(new, allowMissingColumns=True), [key], [newest])


def absent_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows whose key the old table lacks, one for each key."""
    return new.join(old.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def dead_letters(parsed: DataFrame, source: str) -> DataFrame:
    """``kaynak, neden, kayit``: what did not parse."""
    return parsed.filter("_bozuk is not null").select(F.lit(source).alias("kaynak"), F.lit("ayrıştırılamadı").alias("neden"), F.col("_bozuk").alias("kayit"))
