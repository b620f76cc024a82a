"""Decisions of several courts and pools as one ranked list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.functions.text import dotted_date
from terazi.operators.relational import first_per_key


def short_name(chamber: str = "daire", docket: str = "esas_no", number: str = "karar_no", key: str = "id") -> Column:
    """What a decision is cited by: chamber and numbers, the numbers alone, or its id where both lack."""
    docket_, number_ = F.coalesce(docket, F.lit("")), F.coalesce(number, F.lit(""))
    named = F.concat(F.col(chamber), F.lit(" "), docket_, F.lit(" E., "), number_, F.lit(" K."))
    numbered = F.concat(docket_, F.lit("|"), number_)
    return F.when(F.coalesce(chamber, F.lit("")) != "", named).when(F.concat(docket_, number_) != "", numbered).otherwise(F.concat(F.lit("id "), F.col(key)))


def merged(pools: DataFrame, arrival: list[str], k: int) -> DataFrame:
    """``daire, id, canli, skor, tarih, sira, kaynak`` of the first k decisions of each chamber.

    Of one short name the first by ``arrival`` counts; a decision without name and numbers stays, under
    its id. Order: score, date (none last), arrival."""
    one = first_per_key(pools.withColumn("_k", short_name()), ["_k"], [F.col(c) for c in arrival]).withColumn("tarih", dotted_date("karar_tarihi"))
    order = Window.partitionBy("daire").orderBy(F.desc("skor"), F.desc_nulls_last("tarih"), *arrival)
    kept = one.withColumn("sira", F.row_number().over(order)).filter(F.col("sira") <= k)
    chamber = Window.partitionBy("daire")
    label = F.when(F.min("canli").over(chamber), "canli").when(F.max("canli").over(chamber), "karma").otherwise("yerel")
    return kept.withColumn("kaynak", label).select("daire", "id", "canli", "skor", "tarih", "sira", "kaynak")
