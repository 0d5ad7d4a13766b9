"""Every batch's progress of a stream, kept in a table.

A query object remembers its last 100 reports only. The listener here writes each report as it comes, as
one small file in a shared folder, so a stream of any number of batches and restarts is accounted for.
"""

from __future__ import annotations

import json
import threading
from contextlib import contextmanager
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

REPORT = "query_id string, run_id string, batch_id long, n_input long, n_dropped long, n_state long, watermark string"


class ProgressTable(StreamingQueryListener):
    """Writes a row for each batch of every stream of the session while it is registered."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._hadoop.Path(self.path))
        self._change = threading.Condition()
        self._ended: set[str] = set()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        row = {
            "query_id": str(p.id), "run_id": str(p.runId), "batch_id": p.batchId, "n_input": p.numInputRows,
            "n_dropped": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            "n_state": sum(s.numRowsTotal for s in p.stateOperators), "watermark": p.eventTime.get("watermark"),
        }
        # a report repeated by a restart overwrites itself; two runs of one batch keep a row each
        out = self._files.create(self._hadoop.Path(f"{self.path}/{row['run_id']}-{row['batch_id']}.json"), True)
        try:
            out.write(bytearray(json.dumps(row).encode()))
        finally:
            out.close()

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def wait(self, run_id: str, seconds: float = 120) -> None:
        """Block until all reports of a run that has ended are written: they come in order, its end last."""
        with self._change:
            if not self._change.wait_for(lambda: run_id in self._ended, seconds):
                raise TimeoutError(f"no end of run {run_id} was reported within {seconds} s")

    def read(self) -> DataFrame:
        """The rows written so far, in the schema `REPORT`."""
        return self.spark.read.schema(REPORT).json(self.path)


@contextmanager
def progress_of(spark: SparkSession, path: str) -> Iterator[ProgressTable]:
    """A registered `ProgressTable`, taken off the session again at the end."""
    table = ProgressTable(spark, path)
    spark.streams.addListener(table)
    try:
        yield table
    finally:
        spark.streams.removeListener(table)


def late_rows(reports: DataFrame) -> DataFrame:
    """batch_id, n_input, n_dropped for each batch of the reports of a stream.

    Spark counts dropped rows behind a map-side partial aggregation, so with an aggregating stream the number
    is of partial rows; where single rows are keyed, as in `dedup_stream`, it is of input rows.
    """
    return reports.groupBy("batch_id").agg(F.sum("n_input").alias("n_input"), F.sum("n_dropped").alias("n_dropped"))
