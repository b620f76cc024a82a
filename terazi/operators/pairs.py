"""Pairs inside groups and connected groups of pairs, safe for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terazi.session import written

#: Members of a group that meet in one join key.
BLOCK = 256


def pairs_within(members: DataFrame, group: str, member: str, block: int = BLOCK) -> DataFrame:
    """``group, a, b`` with a < b: the pairs of distinct members of each group.

    A group of more than ``block`` members is cut into blocks by hash, and each pair of blocks is a
    join key of its own, so a hot group spreads over as many tasks as its pairs need. Null groups
    and null members give no pairs; repeated members count once."""
    rows = members.select(F.col(group).alias("_g"), F.col(member).alias("_m")).dropna().distinct()
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    cut = rows.join(sizes, "_g").withColumn("_nb", blocks).withColumn("_b", F.pmod(F.xxhash64("_m"), F.col("_nb")).cast("int"))
    left = cut.select("_g", F.col("_b").alias("_b1"), F.explode(F.sequence("_b", F.col("_nb") - 1)).alias("_b2"), F.col("_m").alias("_l"))
    right = cut.select("_g", F.explode(F.sequence(F.lit(0), "_b")).alias("_b1"), F.col("_b").alias("_b2"), F.col("_m").alias("_r"))
    met = left.join(right, ["_g", "_b1", "_b2"]).filter((F.col("_b1") < F.col("_b2")) | (F.col("_l") < F.col("_r")))
    return met.select(F.col("_g").alias(group), F.least("_l", "_r").alias("a"), F.greatest("_l", "_r").alias("b"))


def connected_groups(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, root``: the least node of the connected group of each node that has an edge.

    Alternates the large-star and small-star steps until the edges stay the same; every round is
    written to the shared folder, nothing is collected but a count and a checksum. Loops and null
    ends are ignored; an empty table of edges gives no rows."""
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    links, before = written(links), None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        links = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the groups did not settle; raise max_rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
