"""Latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import header_long
from ..schema import CAPTURE_QUEUE_TIME

QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def capture_latency(enqueue_time: Column | str, now: Column | str) -> Column:
    """From queueing to dispatch, in milliseconds."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return column(now) - column(enqueue_time)


def end_to_end_latency(headers: Column | str, now: Column) -> Column:
    """From queueing at the capture to now, 0 at least; null for records without that header."""
    queued = header_long(headers, CAPTURE_QUEUE_TIME)
    return F.when(queued.isNotNull(), F.greatest(now - queued, F.lit(0)))


def latency_histogram(rows: DataFrame, latency: Column, *, by: list[Column] | None = None, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Count, least, mean, quantiles and greatest of a latency, for each group of ``by`` (such as
    ``F.window(...)``). Nulls are left out. ``exact=False`` takes approximate quantiles, whose
    state does not grow with the number of distinct values."""
    rows = rows.select(*(by or []), latency.alias("__latency")).filter("__latency is not null")
    names = rows.columns[:-1]
    quantile = (lambda q: F.percentile("__latency", F.lit(q))) if exact else (lambda q: F.percentile_approx("__latency", q, accuracy).cast("double"))
    return rows.groupBy(*names).agg(
        F.count("*").alias("n"), F.min("__latency").alias("min_ms"), F.avg("__latency").alias("mean_ms"),
        *[quantile(q).alias(f"{k}_ms") for k, q in QUANTILES.items()], F.max("__latency").alias("max_ms"),
    )
