"""Latency histograms of intervals that merge: log-linear buckets.

Up to 2 to the power of ``bits`` + 1 each number is a bucket of its own; above, each power of two is
cut into 2 to the power of ``bits`` buckets of one width. A bucket's number says where it lies,
so histograms of any intervals, groups or runs add up. A value taken from a bucket is off by at most
one part in 2 to the power of ``bits``: 3 % for 5 bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 5
BUCKETS = "array<struct<bucket:int,n:bigint>>"


def bucket_of(value: Column | str, bits: int = BITS) -> Column:
    """The bucket of a number; negative ones are 0, null stays null."""
    given = (F.col(value) if isinstance(value, str) else value).cast("bigint")
    value = F.when(given.isNotNull(), F.greatest(given, F.lit(0).cast("bigint")))
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - (bits + 1))
    return (shift * (1 << bits) + F.call_function("shiftright", value, shift)).cast("int")


def bucket_low(bucket: Column | str, bits: int = BITS) -> Column:
    """The least number of a bucket."""
    bucket = (F.col(bucket) if isinstance(bucket, str) else bucket).cast("bigint")
    shift = F.greatest(F.lit(0), F.call_function("shiftright", bucket, F.lit(bits)) - 1).cast("int")
    return F.call_function("shiftleft", bucket - shift * (1 << bits), shift)


def bucket_middle(bucket: Column | str, bits: int = BITS) -> Column:
    """The number that stands for a bucket."""
    low = bucket_low(bucket, bits)
    return (low + bucket_low((F.col(bucket) if isinstance(bucket, str) else bucket) + 1, bits) - 1) / 2


def bucket_counts(rows: DataFrame, latency: Column, time: Column | str, *, interval: str = "10 seconds", by: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """The start of the interval, columns of ``by``, bucket and n, for a batch or, behind a watermark,
    a stream, where ``time`` has to be the name of a column. Null latencies are left out."""
    rows = rows.withColumns({"__bucket": bucket_of(latency, bits), **({} if isinstance(time, str) else {"__time": time})}).filter("__bucket is not null")
    counted = rows.groupBy(F.window(time if isinstance(time, str) else "__time", interval).alias("__window"), *by, F.col("__bucket").alias("bucket")).agg(F.count("*").alias("n"))
    return counted.select(F.col("__window.start").alias("start"), *by, "bucket", "n")


def histograms(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One array of buckets and counts, by bucket, for each group of ``by``: counts of any runs and
    intervals are added up. A group has no more rows than there are buckets."""
    own = counts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    return own.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).cast(BUCKETS).alias("buckets"))


def merged(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Histograms added up over all columns but ``by``."""
    return histograms(found.select(*by, F.explode("buckets").alias("b")).select(*by, "b.bucket", "b.n"), by)


def _bucket_at(need: Column) -> Column:
    """The bucket that holds the ``need``-th smallest value."""
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("bucket"))

    def step(a: Column, b: Column) -> Column:
        seen = a["seen"] + b["n"]
        return F.struct(seen.alias("seen"), F.when(a["bucket"].isNull() & (seen >= need), b["bucket"]).otherwise(a["bucket"]).alias("bucket"))

    return F.aggregate("buckets", start, step, lambda a: a["bucket"])


def quantiles(found: DataFrame, wanted: dict[str, float], bits: int = BITS) -> DataFrame:
    """Histograms with n and, for each name, the number that stands for the bucket in which the
    smallest value lies that as many parts of all values do not exceed."""
    n = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda a, b: a + b["n"])
    rows = found.withColumn("n", n)
    out = {}
    for name, q in wanted.items():
        out[name] = bucket_middle(_bucket_at(F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(q)))), bits)
    return rows.withColumns(out)
