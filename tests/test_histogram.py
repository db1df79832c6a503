"""Interval histograms: exact merging, the error of quantiles, and a stream of intervals."""

import math
import random

from pyspark.sql import functions as F

from seamline.operators import histogram

QUANTILES = {"p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}


def test_buckets_hold_their_numbers(spark):
    chance = random.Random(1)
    numbers = [*range(300), *(chance.randrange(1 << k) for k in range(1, 63) for _ in range(20)), (1 << 63) - 1, -5]
    df = spark.createDataFrame([(n,) for n in numbers], "v long")
    rows = df.select("v", histogram.bucket_of("v").alias("b")).select("v", "b", histogram.bucket_low("b").alias("low"), histogram.bucket_low(F.col("b") + 1).alias("next")).collect()
    for r in rows:
        v = max(0, r["v"])
        assert r["low"] <= v and (v < r["next"] or r["next"] < 0)
        assert v - r["low"] <= v / 32
    ordered = sorted((max(0, r["v"]), r["b"]) for r in rows)
    assert [b for _, b in ordered] == sorted(b for _, b in ordered)


def test_intervals_merge_to_the_whole(spark):
    chance = random.Random(2)
    rows = [(k % 3, k * 137, int(chance.lognormvariate(5, 2)) if k % 50 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "p int, at long, ms long").withColumn("time", F.timestamp_millis("at"))
    counts = histogram.bucket_counts(df, F.col("ms"), "time", by=["p"])
    each = histogram.histograms(counts, ["start", "p"])
    whole = histogram.histograms(histogram.bucket_counts(df, F.col("ms"), "time", interval="1 day", by=["p"]), ["p"])
    assert each.count() > 100
    assert sorted(map(str, histogram.merged(each, ["p"]).collect())) == sorted(map(str, whole.collect()))
    for r in histogram.quantiles(whole, QUANTILES).collect():
        values = sorted(ms for p, _, ms in rows if p == r["p"] and ms is not None)
        assert r["n"] == len(values)
        for name, q in QUANTILES.items():
            true = values[max(1, math.ceil(q * len(values))) - 1]
            assert abs(r[name] - true) <= true / 32 + 0.5, (name, r[name], true)


def test_a_stream_of_intervals(spark, tmp_path):
    rows = [(k * 500, k % 40) for k in range(200)] + [(10_000_000, 1)]
    df = spark.createDataFrame(rows, "at long, ms long").withColumn("time", F.timestamp_millis("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("time", "10 seconds")
    counts = histogram.bucket_counts(source, F.col("ms"), "time")
    counts.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    streamed = histogram.histograms(spark.read.schema(counts.schema).parquet(str(tmp_path / "out")), ["start"])
    batch = histogram.histograms(histogram.bucket_counts(df.filter("at < 10000000"), F.col("ms"), "time"), ["start"])
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    assert streamed.count() == 10
