"""Ordered computations inside a key that do not put all rows of a key into one task.

Rows of a key are cut into ranges of their (signed) order column. A window runs inside each
range; what a range passes on to the next is computed on one row for each range and joined
back. The rows are shuffled once, by key and range, so a key with a third of all rows is
spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BITS = 16


def _ranged(df: DataFrame, order: str, bits: int) -> DataFrame:
    return df.withColumn("__range", F.shiftright(F.col(order), bits))


def _edges(ranged: DataFrame, keys: list[str], passed: Column) -> DataFrame:
    return ranged.groupBy(*keys, "__range").agg(passed.alias("__own"))


def _carried(ranged: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    names = [*keys, "__range"]
    right = edges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(names)], "__carry")
    same = [ranged[k].eqNullSafe(right[f"__k{i}"]) for i, k in enumerate(names)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return ranged.join(right, condition, "left").drop(*[f"__k{i}" for i in range(len(names))])


def previous(df: DataFrame, keys: list[str], order: str, value: Column, into: str, bits: int = RANGE_BITS) -> DataFrame:
    """Add ``into``: the value of the row before, by ``order`` within ``keys``; null in a key's
    first row. Rows with the same order are taken in any order. An empty table stays empty;
    a null order comes before all others."""
    ranged = _ranged(df.withColumn("__value", value), order, bits)
    edges = _edges(ranged, keys, F.max(F.struct(order, F.col("__value").alias("v"))))
    across = Window.partitionBy(*keys).orderBy("__range")
    edges = edges.withColumn("__carry", F.lag("__own").over(across)["v"])
    inside = Window.partitionBy(*keys, "__range").orderBy(order)
    rows = _carried(ranged, edges, keys)
    first = F.row_number().over(inside) == 1
    return rows.withColumn(into, F.when(first, F.col("__carry")).otherwise(F.lag("__value").over(inside))).drop("__value", "__range", "__carry")


def running(df: DataFrame, keys: list[str], order: str, value: Column, into: str, *, kind: str = "max", inclusive: bool = True, bits: int = RANGE_BITS) -> DataFrame:
    """Add ``into``: the running ``max``, ``min`` or ``sum`` of the value over the rows of a key up
    to this one, or up to the one before (``inclusive=False``; null, or 0 for a sum, in the
    first). Order has to be unique within a key."""
    fold = {"max": F.max, "min": F.min, "sum": F.sum}[kind]
    ranged = _ranged(df.withColumn("__value", value), order, bits)
    edges = _edges(ranged, keys, fold("__value"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("__carry", fold("__own").over(before))
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = _carried(ranged, edges, keys).withColumn("__inside", fold("__value").over(inside))
    joined = {"max": F.greatest("__carry", "__inside"), "min": F.least("__carry", "__inside"), "sum": F.coalesce("__carry", F.lit(0)) + F.coalesce("__inside", F.lit(0))}[kind]
    return rows.withColumn(into, joined).drop("__value", "__range", "__carry", "__inside")


def numbered(df: DataFrame, keys: list[str], order: str, into: str, bits: int = RANGE_BITS) -> DataFrame:
    """Add ``into``: the rows' numbers within a key, from 0, by a unique order."""
    return running(df, keys, order, F.lit(1).cast("bigint"), into, kind="sum", inclusive=False, bits=bits)
