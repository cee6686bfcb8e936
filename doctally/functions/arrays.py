"""Functions over array columns that hold a document's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def unpacked(rows: DataFrame, keep: list[str], array: Column, place: str, item: str) -> DataFrame:
    """keep, place and item: a row for each item of an array, none for an empty or null one.

    From an inner explode the optimizer infers a test of the array's size and pushes it down to the scan, where the array, and all that it is made of, would be computed once more.
    """
    return rows.select(*keep, F.posexplode_outer(array).alias(place, item)).where(F.col(place).isNotNull())


def running(values: Column, combine, start: int) -> Column:
    """What the whole numbers up to each place combine to (combine is associative, start its neutral value).

    Prefixes are made within pieces of the square root's length and over the pieces, so that no long array grows one element at a time.
    """

    def scan(values: Column, first: Column, inclusive: bool) -> Column:
        def step(acc: Column, x: Column) -> Column:
            now = combine(acc["now"], x)
            return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now if inclusive else acc["now"])).alias("all"))

        return F.aggregate(values, F.struct(first.alias("now"), F.array().cast("array<int>").alias("all")), step, lambda acc: acc["all"])

    def cut(values: Column) -> Column:
        width = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(values)))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), width), lambda at: F.slice(values, at, width))

    def joined(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.aggregate(p, F.lit(start), combine))
        return F.flatten(F.zip_with(parts, scan(whole, F.lit(start), False), lambda p, first: scan(p, first, True)))

    return let(values, lambda v: let(cut(v), joined))


def at_most(values: Column, x: Column) -> Column:
    """How many of the ascending values are at most x, by binary search."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        below = values[middle] <= x
        done = acc["low"] >= acc["high"]
        return F.struct(F.when(done | ~below, acc["low"]).otherwise(middle + 1).alias("low"), F.when(done | below, acc["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), halve, lambda acc: acc["low"])
