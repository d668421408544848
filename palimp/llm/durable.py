"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def durable(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in spark.checkpoint.dir; lost executors lose nothing of it.

    Without that setting, as in local tests, a temporary folder stands in for it; on a cluster that would be a local
    folder of the driver, so there the setting is asked for.
    """
    shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet in the shared folder and read again: for wide rows, of which later steps need some columns."""
    path = f"{shared(df.sparkSession)}/palimp-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared(spark: SparkSession) -> str:
    """The folder for checkpoints, set if it isn't yet."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="palimp-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows of whole texts that go to Python at once, at most.
TEXTS_AT_ONCE = 1000


def few_at_once(df: DataFrame) -> DataFrame:
    """`df`; from now on its session hands texts to Python in small batches, so that long ones don't add up."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXTS_AT_ONCE:
        conf.set(key, str(TEXTS_AT_ONCE))
    return df


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner", most_rows: int = 200_000, rows: int | None = None) -> DataFrame:
    """Joins with a broadcast right side if it has at most `most_rows` rows, else as Spark plans it (AQE splits hot keys)."""
    from pyspark.sql import functions as F

    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= most_rows else right, on, how)
