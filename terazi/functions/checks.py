"""Check digits and shapes of identifiers as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i, 1).cast("int")


def national_id_valid(c: Column) -> Column:
    """Eleven digits, the first not 0, with right tenth and eleventh digits; null is not valid."""
    ok = c.rlike(r"^[1-9]\d{10}$")
    digits = F.when(ok, c).otherwise(F.lit("00000000000"))
    odd = sum((_digit(digits, i) for i in (3, 5, 7, 9)), _digit(digits, 1))
    even = sum((_digit(digits, i) for i in (4, 6, 8)), _digit(digits, 2))
    tenth = F.pmod(odd * 7 - even, F.lit(10)) == _digit(digits, 10)
    eleventh = F.pmod(odd + even + _digit(digits, 10), F.lit(10)) == _digit(digits, 11)
    return F.coalesce(ok & tenth & eleventh, F.lit(False))


def iban_remainder(c: Column) -> Column:
    """Remainder by 97 of a Turkish account number of 26 characters (1: right); null for other shapes."""
    bare = F.upper(F.regexp_replace(c, r"\s", ""))
    # TR moves behind the number as 2927.
    turned = F.when(bare.rlike(r"^TR\d{24}$"), F.concat(F.substring(bare, 5, 22), F.lit("2927"), F.substring(bare, 3, 2)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, d: F.when(d == "", a).otherwise((a * 10 + d.cast("int")) % 97))


def chassis_shape(c: Column) -> Column:
    """Seventeen characters without I, O and Q that hold both letters and digits."""
    return F.coalesce(c.rlike(r"^[A-HJ-NPR-Z0-9]{17}$") & c.rlike("[A-Z]") & c.rlike(r"\d"), F.lit(False))
