"""What streams count as they run: the metrics that observe() named, batch by batch."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Counts(StreamingQueryListener):
    """rows: a dict for each batch with its number (batch) and what was observed, in the order of the batches.

    spark.streams.addListener(Counts()); streams take their counts by df.observe(name, aggregates).
    """

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for row in event.progress.observedMetrics.values():
            self.rows.append({"batch": event.progress.batchId, **row.asDict()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def wait(self, spark: SparkSession, n: int, seconds: float = 30.0) -> list[dict]:
        """The rows, once there are n of them: events arrive some time after the batches."""
        until = time.monotonic() + seconds
        while len(self.rows) < n and time.monotonic() < until:
            time.sleep(0.1)
        return self.rows
