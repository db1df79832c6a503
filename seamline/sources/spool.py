"""A durable spool of captured payloads: rolled Parquet files, read as a stream.

Buses can't be replayed, streaming sources must be; so a receiver first writes what it gets to
files. A file appears under its final name only when it is complete.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from ..schema import SPOOL_SCHEMA


class SpoolWriter:
    """Writes payloads to a folder; a file is rolled after ``max_rows`` or ``max_ms``. The clock
    gives epoch milliseconds."""

    def __init__(self, folder: str, *, max_rows: int = 10_000, max_ms: int = 1000, clock: Callable[[], int] = lambda: time.time_ns() // 1_000_000):
        self.folder, self.max_rows, self.max_ms, self.clock = Path(folder), max_rows, max_ms, clock
        self.folder.mkdir(parents=True, exist_ok=True)
        self.rows: list[tuple[bytes, int]] = []

    def add(self, payload: bytes, enqueue_time: int | None = None) -> None:
        self.rows.append((bytes(payload), self.clock() if enqueue_time is None else enqueue_time))
        self.roll_if_due()

    def roll_if_due(self) -> None:
        if self.rows and (len(self.rows) >= self.max_rows or self.clock() - self.rows[0][1] >= self.max_ms):
            self.roll()

    def roll(self) -> None:
        if not self.rows:
            return
        payloads, times = zip(*self.rows, strict=True)
        name = f"{self.clock():020d}-{uuid.uuid4().hex}.parquet"
        draft = self.folder / f".{name}.tmp"
        pq.write_table(pa.table({"payload": pa.array(payloads, pa.binary()), "enqueue_time": pa.array(times, pa.int64())}), draft)
        os.replace(draft, self.folder / name)
        self.rows = []

    def close(self) -> None:
        self.roll()


def read_spool(spark: SparkSession, folder: str, *, max_files: int | None = None, clean: str = "off", archive: str | None = None) -> DataFrame:
    """The spool as a stream. ``clean``: ``off``, ``delete`` or ``archive`` files once they are
    done; ``max_files``: how many a micro-batch takes at most."""
    reader = spark.readStream.schema(SPOOL_SCHEMA).option("cleanSource", clean)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if archive is not None:
        reader = reader.option("sourceArchiveDir", archive)
    return reader.parquet(folder)
