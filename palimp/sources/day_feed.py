"""The feed of a paged service as a stream: what was published day by day, with the last day covered as its offset.

An offset says up to which day all is read (`ate`), in which run, and from which day that run began (`desde`). Within a run
a batch begins behind the day where the one before it ended; a new run begins at its own first day, which by default is the
last day covered, read once more because a day goes on after it was asked for. An earlier first day reads older days anew.
Offsets alone say what a batch reads, so a batch that is repeated after a failure reads the same days.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from palimp.sources.paged import COUNT, PACE, SCHEMA, Client

#: The service's names for the first and last day of a search.
FROM, TO = "periodoPublicacaoInicial", "periodoPublicacaoFinal"


def days(first: str, last: str) -> list[str]:
    """The days from first to last, both included."""
    a, b = map(dt.date.fromisoformat, (first, last))
    return [str(a + dt.timedelta(n)) for n in range((b - a).days + 1)]


class _Days(InputPartition):
    """Days for one reader, which asks at its own turn."""

    def __init__(self, days: list[str], turn: int, turns: int) -> None:
        self.days, self.turn, self.turns = days, turn, turns


class DayReader(DataSourceStreamReader):
    """Options: fetch (import path of a function as in sources.paged; subclasses may bring their own), desde, ate (the run's first and last day), run (its
    name), days (at most in a batch), readers (one, or without a pace to keep one for each day), count, pace, filters (JSON)."""

    def __init__(self, schema, options) -> None:
        self.names = schema.fieldNames()
        self.fetch = options.get("fetch")
        self.first, self.last, self.run = options["desde"], options["ate"], options.get("run", "")
        self.step = int(options.get("days", 1))
        self.count, self.pace, self.params = int(options.get("count", COUNT)), float(options.get("pace", PACE)), json.loads(options.get("filters", "{}"))
        self.readers = int(options.get("readers", 1 if self.pace else sys.maxsize))
        self.told: str | None = None

    def initialOffset(self) -> dict:
        return {"ate": None, "run": None, "desde": None}

    def latestOffset(self) -> dict:
        """The next `days` days, up to the run's last one; a run whose last day lies before its first has none."""
        if self.last < self.first:
            self.told = self.last
        elif self.told is None or self.told < self.last:
            begin = self.first if self.told is None else str(dt.date.fromisoformat(self.told) + dt.timedelta(1))
            self.told = min(str(dt.date.fromisoformat(begin) + dt.timedelta(self.step - 1)), self.last)
        return {"ate": self.told, "run": self.run, "desde": self.first}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        begin = end["desde"]
        if start["run"] is not None and start["run"] == end["run"]:
            begin = str(dt.date.fromisoformat(start["ate"]) + dt.timedelta(1))
        wanted = days(begin, end["ate"])
        turns = max(min(self.readers, len(wanted)), 1)
        return [_Days(wanted[n::turns], n, turns) for n in range(turns)]

    def transport(self) -> Callable[[dict, float], dict]:
        module, _, name = self.fetch.rpartition(".")
        return getattr(importlib.import_module(module), name)

    def read(self, partition: _Days) -> Iterator[tuple]:
        client = Client(self.transport(), self.pace * partition.turns, late=self.pace * partition.turn)
        for day in partition.days:
            for page in client.pages(self.count, **self.params, **{FROM: day, TO: day}):
                for row in page["content"]:
                    yield tuple(row.get(n) for n in self.names)

    def commit(self, end: dict) -> None:
        """Spark's offset log is the state; nothing else is kept."""


class DayFeed(DataSource):
    """spark.readStream.format("day_feed").option("fetch", "package.module.function").option("desde", ...).option("ate", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "day_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DayReader:
        return DayReader(schema, self.options)


def covered(spark: SparkSession, checkpoint: str) -> str | None:
    """The last day that a stream with this checkpoint has finished; None without one, as before the first run."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    done = [int(f.getPath().getName()) for f in files.listStatus(where) if f.getPath().getName().isdigit()]
    if not done:
        return None
    # A batch's file: a version, the batch's settings and a source's offset for each line.
    lines = [r["value"] for r in spark.read.text(f"{checkpoint}/offsets/{max(done)}").collect()]
    return json.loads(lines[-1])["ate"]
