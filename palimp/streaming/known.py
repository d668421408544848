"""Keys that a stream has seen before, kept in Spark's own state store.

A batch costs what its own keys cost: the state of other keys is neither read nor written, however long the history is.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows that a task holds before it reduces them.
LEAST = 100_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keyed state needs, for streams started inside; afterwards the session is as before."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _earliest(rows: pa.Table, keys: list[str], time: str) -> pa.Table:
    """The first row of each key by time, nulls last."""
    first = rows.append_column("__at", pa.array(range(len(rows)), pa.int64())).sort_by([(time, "ascending"), ("__at", "ascending")])
    first = first.set_column(first.num_columns - 1, "__at", pa.array(range(len(rows)), pa.int64()))
    at = first.group_by(keys, use_threads=False).aggregate([("__at", "min")]).column("__at_min")
    return first.drop_columns("__at").take(at)


def _one_each(keys: list[str], time: str):
    """For mapInArrow on rows dealt by key: each key's earliest row. No more than twice the keys of a task, and LEAST rows, are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, LEAST
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            n += len(b)
            if n >= most:
                held = [_earliest(pa.concat_tables(held), keys, time)]
                n = len(held[0])
                most = max(LEAST, 2 * n)
        if held:
            yield from _earliest(pa.concat_tables(held), keys, time).to_batches(max_chunksize=10_000)

    return run


class _First(StatefulProcessor):
    """A key's earliest row in the first batch that has the key, if it isn't remembered; nothing while it is."""

    def __init__(self, time: str, forget: int) -> None:
        self.time, self.forget = time, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, first = self.seen.exists(), None
        for batch in rows:
            top = batch.sort_values(self.time, kind="stable").iloc[:1]
            first = top if first is None or top[self.time].iloc[0] < first[self.time].iloc[0] else first
        if not known:
            self.seen.update((True,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.forget)
        if not known and first is not None:
            yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def unseen(stream: DataFrame, keys: list[str], time: str, forget_ms: int | None = None) -> DataFrame:
    """The first row of each key (the earliest by `time` of the batch that brings the key); later rows of known keys are dropped.

    A batch's rows are dealt by key and reduced to one for each key, of which Spark's own deduplication lets the new ones
    pass: Python sees rows by the batch, and no key costs a call.

    Late rows aren't dropped: a key counts as new by what was seen, not by its time. With `forget_ms` (the stream then needs
    a watermark, behind which rows are late and dropped) a key that isn't seen for that long is forgotten and its state freed;
    then it is new again, which is a state of its own for each key. Start it inside state_store().
    """
    if forget_ms is not None:
        return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_First(time, forget_ms), outputStructType=stream.schema, outputMode="Append", timeMode="EventTime")
    return stream.repartition(*keys).mapInArrow(_one_each(keys, time), stream.schema).dropDuplicates(keys)
