"""Acting on the keys of a batch, each by itself: one that fails does no harm to the others.

What an action gives goes to the table `done`, a failure to `dead` with its error and the number of attempts, each in a
folder for the batch that a repeated batch writes anew. An id that has run out is asked for again once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.sources.paged import status

#: Answers that say that an id has run out.
EXPIRED = (400, 401, 403)
RESULT = "key string, ok boolean, attempts int, result string, error string"


def attempt(action: Callable[[str, bool], str | None], key: str) -> tuple[str, bool, int, str | None, str | None]:
    """A row of RESULT. The action gets the key and whether to ask for its ids anew, which it is told at most once."""
    for anew in (False, True):
        try:
            return key, True, 1 + anew, action(key, anew), None
        except Exception as e:  # noqa: BLE001: whatever one key's action raises is that key's result
            if anew or status(e) not in EXPIRED:
                return key, False, 1 + anew, None, f"{type(e).__name__}: {e}"
    raise AssertionError


def acted(keys: DataFrame, action: Callable[[str, bool], str | None], readers: int = 1) -> DataFrame:
    """RESULT of each distinct key; `readers` tasks act, so that a service keeps its pace."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([attempt(action, k) for k in b["key"]], columns=["key", "ok", "attempts", "result", "error"]).astype({"result": object, "error": object})

    return keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct().repartition(readers, "key").mapInPandas(work, RESULT)


def on_batch(path: str, key: str, action: Callable[[str, bool], str | None], readers: int = 1) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch, and for feed.append_new: acts on the batch's keys and writes both tables."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # Written before it is divided: nothing is done twice for the second table.
        acted(batch.select(F.col(key).alias("key")), action, readers).write.mode("overwrite").parquet(f"{path}/all/batch={epoch}")
        made = spark.read.schema(RESULT).parquet(f"{path}/all/batch={epoch}")
        made.where("ok").drop("ok", "error").write.mode("overwrite").parquet(f"{path}/done/batch={epoch}")
        made.where("not ok").drop("ok", "result").write.mode("overwrite").parquet(f"{path}/dead/batch={epoch}")

    return run


def results(spark: SparkSession, path: str) -> DataFrame:
    """batch and RESULT of all batches."""
    return spark.read.schema(f"{RESULT}, batch long").parquet(f"{path}/all")


def pending(spark: SparkSession, path: str) -> DataFrame:
    """key, attempts (in all batches) and error (the last one) of keys that have failed and not been done in a later batch."""
    every = results(spark, path)
    last = every.groupBy("key").agg(F.sum("attempts").cast("long").alias("attempts"), F.max_by("error", "batch").alias("error"), F.max_by("ok", "batch").alias("ok"))
    return last.where("not ok").drop("ok")
