"""Rows that come behind a watermark, counted into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, run string, batch long, operator string, position int, late_rows long, at string"


class LateRows(StreamingQueryListener):
    """Appends a row to the table at ``path`` for every stateful operator of a batch that has dropped late rows.

    Queries are told apart by name, or by id where they have none. A batch that is run again
    after a failure is another row under its number; ``late_rows`` counts the last one. Spark
    counts rows as they reach the state: before an aggregation, late rows of one key and window
    of a task are one.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(p.name or str(p.id), str(p.runId), p.batchId, x.operatorName, k, x.numRowsDroppedByWatermark, p.timestamp) for k, x in enumerate(p.stateOperators) if x.numRowsDroppedByWatermark]
        if rows:
            self._spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self._path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(table: DataFrame) -> DataFrame:
    """``query, operator, late_rows`` in all, of each batch its last run."""
    from pyspark.sql import functions as F

    last = table.groupBy("query", "batch", "operator", "position").agg(F.max_by("late_rows", F.struct("at", "run")).alias("late_rows"))
    return last.groupBy("query", "operator").agg(F.sum("late_rows").alias("late_rows"))
