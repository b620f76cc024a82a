"""Merging, skipping, ranking and budgeting of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; null keys are keys like any other."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, key: str, replaced: list[str], position: str) -> DataFrame:
    """``old`` without the documents that ``new`` brings (by ``replaced``), and ``new``, one row a key:
    the last by position."""
    kept = old.join(new.select(*replaced).distinct(), replaced, "left_anti")
    return first_per_key(kept.unionByName(new), [key], [F.desc(position)])


def not_done(todo: DataFrame, done: DataFrame, keys: list[str], refresh: Column | None = None) -> DataFrame:
    """Rows of ``todo`` that aren't in ``done``, and those to be refreshed anyway."""
    fresh = todo.join(done.select(*keys).distinct(), keys, "left_anti")
    if refresh is None:
        return fresh
    again = todo.filter(refresh).join(done.select(*keys).distinct(), keys, "left_semi")
    return fresh.unionByName(again)


def reused(new: DataFrame, old: DataFrame, text: str, value: str, position: str) -> DataFrame:
    """Adds the value that the first old row of the same text has; null where the text is new.

    Texts meet by their digest and are then compared in full."""
    first = first_per_key(old.select(F.sha2(text, 256).alias("_h"), F.col(text).alias("_t"), F.col(value).alias("_v"), F.col(position).alias("_p")), ["_h", "_t"], [F.col("_p")])
    joined = new.withColumn("_g", F.sha2(text, 256)).join(first, (F.col("_g") == F.col("_h")) & (F.col(text) == F.col("_t")), "left")
    return joined.withColumn(value, F.col("_v")).drop("_g", "_h", "_t", "_v", "_p")


def suffixed(rows: DataFrame, key: str, position: str, name: str) -> DataFrame:
    """The second and later rows of a key get " (n)" on their name."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(position))
    return rows.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 1, F.concat(F.col(name), F.lit(" ("), F.col("_n"), F.lit(")"))).otherwise(F.col(name))).drop("_n")


def running(rows: DataFrame, group: str, order: list[Column], block: Column, sizes: dict[str, Column], most: dict[str, int] | None = None) -> DataFrame:
    """Adds running sums within each group, under the names of ``sizes``.

    ``block`` is a rising function of the order. A group is summed block by block, in as many tasks as
    it has blocks; what came before a block is a running sum over one row a block. Blocks that begin
    beyond ``most`` (of sums of sizes that aren't negative) are left out before anything is sorted."""
    blocked = rows.withColumns({"_block": block, **{f"_s_{n}": c for n, c in sizes.items()}})
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(group, "_block").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sizes])
    starts = sums.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sizes])
    for name, limit in (most or {}).items():
        starts = starts.filter(F.col(f"_before_{name}") <= limit)
    joined = blocked.join(starts, F.col(group).eqNullSafe(F.col("_g")) & F.col("_block").eqNullSafe(F.col("_b")))
    upto = Window.partitionBy(group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = joined.withColumns({n: F.col(f"_before_{n}") + F.sum(f"_s_{n}").over(upto) for n in sizes})
    return inside.drop("_block", "_g", "_b", *[f"{p}_{n}" for n in sizes for p in ("_s", "_before")])


def within_budget(rows: DataFrame, group: str, order: list[Column], size: Column, budget: int, block: Column) -> DataFrame:
    """The first rows of each group whose sizes add up to no more than the budget: the first overflow
    ends the group. ``block`` rises with the order (see ``running``)."""
    return running(rows, group, order, block, {"toplam": size}, {"toplam": budget}).filter(F.col("toplam") <= budget)


def minus(shown: DataFrame, seen: DataFrame, keys: list[str], group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group that weren't seen."""
    left = shown.join(seen.select(*keys).distinct(), keys, "left_anti")
    return left.withColumn("sira", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("sira") <= k)


def zero_filled(rows: DataFrame, group: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each value as columns, 0 where a group has none."""
    counts = [F.sum(F.when(F.col(column) == v, 1).otherwise(0)).alias(v) for v in values]
    return rows.groupBy(group).agg(*counts, F.count("*").alias("toplam"))


def densest(positions: DataFrame, doc: str, pos: str, width: int) -> DataFrame:
    """``doc, bas, n``: where the window of ``width`` places with the most hits begins; the first of
    equals."""
    ahead = Window.partitionBy(doc).orderBy(pos).rangeBetween(0, width - 1)
    counted = positions.withColumn("n", F.count("*").over(ahead))
    return first_per_key(counted, [doc], [F.desc("n"), F.col(pos)]).select(doc, F.col(pos).alias("bas"), "n")
