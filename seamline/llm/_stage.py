"""Staging helpers: tables written to the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folders staged in the scopes that are open, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is
    unset and the master is local (tests, a single machine), a folder under the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/seamline-scratch"


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there,
    so a lost executor costs no recomputation and no reader runs the work above twice. In a
    :func:`scratch` the table goes at its end; ``keep``: at the end of the one around it."""
    spark, scopes = df.sparkSession, _SCOPES.get()
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    owner = scopes[: len(scopes) - keep]
    if owner:
        owner[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a staged folder through Spark's own file system for it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unstage(df: DataFrame) -> None:
    """Delete a table that :func:`staged` wrote; other tables are left alone."""
    spark = df.sparkSession
    home = shared_dir(spark).rstrip("/").rpartition("/")[2]
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if folder.split("/")[-2:-1] == [home]:
            delete(spark, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside, at the end. Only for work that is over by then: what is
    returned has to be staged with ``keep``."""
    own: list[str] = []
    before = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(before)
        for path in own:
            delete(spark, path)


#: Settings of Arrow batches, and their upper ends for columns of whole texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches for long texts, where they are larger: a batch of 10,000
    whole texts costs some hundred MB in an executor and each of its Python workers."""
    for key, most in BATCHES.items():
        given = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))
        if given and not 0 < int(given[1]) <= most:  # a size with a unit is the user's own choice
            spark.conf.set(key, most)


def needed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns cannot clash with what operators add."""
    if "text" in names:
        small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
