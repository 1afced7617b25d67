"""Exact quantiles of groups of any size, in no one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which the distinct values of a group are cut: so many times so many.
STEP = 8


def quantiles(df: DataFrame, by: list[Column], value: Column, levels: dict[str, float]) -> DataFrame:
    """A row for each group that has a value: __g0, __g1, … and a column of each name, the continuous quantile of its
    level, as Spark's percentile gives it.

    Distinct values are counted first. Estimates cut each group's into ranges, whose exact totals tell the ranges that
    hold the quantiles; only these are ordered. The estimates decide on the size of ranges, not on results."""
    g = [f"__g{i}" for i in range(len(by))]
    own = df.select(*[c.alias(n) for c, n in zip(by, g)], value.cast("double").alias("__v")).filter("__v IS NOT NULL")
    counts = own.groupBy(*g, "__v").agg(F.count(F.lit(1)).alias("__k"))
    # the total stands here so that each use of the counts reads the same columns, and Spark makes them once
    cuts = counts.groupBy(*g).agg(F.percentile_approx("__v", [i / STEP**2 for i in range(1, STEP**2)]).alias("__cuts"), F.sum("__k").alias("__n"))
    passed = lambda places: reduce(lambda a, b: a + b, [(F.get("__cuts", p) <= F.col("__v")).cast("int") for p in places])
    coarse = passed([F.lit(STEP * i - 1) for i in range(1, STEP)])
    placed = _beside(counts, cuts, g).withColumn("__c", STEP * coarse)
    placed = placed.select(*g, "__v", "__k", "__n", (F.col("__c") + passed([F.col("__c") + i for i in range(STEP - 1)])).alias("__r"))
    w = Window.partitionBy(*g).orderBy("__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy(*g, "__r").agg(F.sum("__k").alias("__t"), F.max("__n").alias("__n")).withColumn("__to", F.sum("__t").over(w))
    places = {name: (F.col("__n") - 1) * F.lit(float(q)) for name, q in levels.items()}
    ends = [end(p) for p in places.values() for end in (F.floor, F.ceil)]
    held = reduce(lambda a, b: a | b, [(p < F.col("__to")) & (p >= F.col("__to") - F.col("__t")) for p in ends])
    few = totals.filter(held).select(*g, "__r", (F.col("__to") - F.col("__t")).alias("__before"))
    v = Window.partitionBy(*g, "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = _beside(placed, few, [*g, "__r"]).withColumn("__upto", F.col("__before") + F.sum("__k").over(v))
    at = lambda p: F.min(F.when(F.col("__upto") > p, F.col("__v")))
    found = inside.groupBy(*g).agg(F.max("__n").alias("__n"), *[x for n, p in places.items() for x in (at(F.floor(p)).alias(f"{n}_low"), at(F.ceil(p)).alias(f"{n}_high"))])
    out = []
    for n, p in places.items():
        low, high = F.col(f"{n}_low"), F.col(f"{n}_high")
        out.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(n))
    return found.select(*g, *out)


def _beside(df: DataFrame, other: DataFrame, g: list[str]) -> DataFrame:
    """An inner join in which nulls are equal."""
    if not g:
        return df.crossJoin(other)
    theirs = other.withColumnsRenamed({n: f"{n}_" for n in g})
    return df.join(theirs, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in g]).drop(*[f"{n}_" for n in g])
