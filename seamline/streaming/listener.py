"""Progress of the merge: counts by verdict and state size, from a streaming query's progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(rows: DataFrame, name: str = "dedup") -> DataFrame:
    """Rows of the merge with counts of records and gaps observed in each micro-batch, and, if the
    merge counts, of what it has dropped and what the partitions of this micro-batch hold. Put it
    before a sink that leaves out the rows of kind ``count``."""
    more = [F.sum("dropped").alias("dropped"), F.sum("held").alias("held")] if "dropped" in rows.columns else []
    return rows.observe(name, F.count_if(F.col("kind") == "record").alias("sent"), F.count_if(F.col("kind") == "gap").alias("gaps"), *more)


def observed_partitions(rows: DataFrame, partitions: int, name: str = "partitions") -> DataFrame:
    """As :func:`observed`, by partition: an array of the counts of partitions 0 to ``partitions`` - 1."""
    own = lambda p, c: F.sum(F.when(F.col("partition") == p, c))
    counts = [F.struct(own(p, (F.col("kind") == "record").cast("bigint")).alias("sent"), own(p, F.col("dropped")).alias("dropped"), own(p, F.col("held")).alias("held")) for p in range(partitions)]
    return rows.observe(name, F.array(*counts).alias("partitions"))


class ProgressListener(StreamingQueryListener):
    """Calls ``report`` with a dictionary for each micro-batch: rows in, observed counts (of
    partitions too, if they are observed), rows in state. Several listeners may be added to a session."""

    def __init__(self, report: Callable[[dict], None], name: str = "dedup"):
        self.report, self.name = report, name

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        seen, parts = progress.observedMetrics.get(self.name), progress.observedMetrics.get("partitions")
        self.report({
            "batch": progress.batchId, "rows_in": progress.numInputRows,
            **({} if seen is None else {k: v or 0 for k, v in seen.asDict().items()}),
            **({} if parts is None else {"partitions": [{k: v or 0 for k, v in p.asDict().items()} for p in parts.partitions]}),
            "state_rows": sum(x.numRowsTotal for x in progress.stateOperators),
        })

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
