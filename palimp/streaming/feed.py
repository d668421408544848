"""The feed of publications as a stream: new keys are appended once, and replays change nothing.

Which keys are known is Spark's state (palimp.streaming.known), so a batch costs what its own rows cost. A batch may repeat
keys, within itself or against what is known; each key is appended once, with its earliest time in the batch that brings it.
(A feed that compares with its history only would append a key twice that occurs twice in one batch.)
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.sources.day_feed import DayFeed, covered
from palimp.streaming.known import state_store, unseen

KEYS = ("registro", "expediente")


def publications(events: DataFrame) -> DataFrame:
    """registro, expediente, ts of event rows."""
    return events.select(F.col("user_id").cast("string").alias("registro"), F.col("event_type").alias("expediente"), F.col("ts").cast("timestamp").alias("ts"))


def append(path: str, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes a batch to a folder of its own, which a replay writes anew.

    `then` gets the batch's rows as written, and its number: archiving their products is such an action.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        if then:
            then(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={epoch}"), epoch)

    return run


def run_available(stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, time: str = "ts") -> None:
    """Processes all that is there, batch by batch, and stops; the next call goes on from the checkpoint."""
    with state_store(stream.sparkSession):
        query = unseen(stream, list(KEYS), time).writeStream.foreachBatch(append(path, then)).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        query.awaitTermination()


def run(spark: SparkSession, path: str, checkpoint: str, *, source: type[DayFeed] = DayFeed, desde: str | None = None, ate: str | None = None, then: Callable[[DataFrame, int], None] | None = None, **options) -> str:
    """Appends what a service published from `desde` to `ate` (today), both included; returns `ate`.

    Without `desde` it goes on from the last day covered, which is read once more, or from today if there is none. An
    earlier `desde` reads older days again: nothing that is known is appended twice. `options` are the source's, `fetch`
    (the import path of the service's function) among them.
    """
    from palimp.operators.catalog import published

    spark.dataSource.register(source)
    today = str(dt.date.today())
    last = ate or today
    first = desde or covered(spark, checkpoint) or today
    reader = spark.readStream.format(source.name()).option("desde", first).option("ate", last).option("run", uuid.uuid4().hex)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    run_available(published(reader.load()), path, checkpoint, then, time="data")
    return last


def first_publications(spark: SparkSession, events: str) -> DataFrame:
    """The feed's keys, each once, by a file stream over `events` that is read to its end."""
    from palimp.sources.store import shared

    schema = spark.read.parquet(events).schema
    folder, _, name = events.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}" if not _is_file(spark, events) else folder + "/" + name[:-8] + "[.]parquet")
    out = f"{shared(spark)}/feed-{uuid.uuid4().hex}"
    run_available(publications(stream), f"{out}/table", f"{out}/state")
    return spark.read.parquet(f"{out}/table").select("registro", "expediente", F.col("ts").cast("timestamp_ntz").alias("ts"))


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
