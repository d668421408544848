"""Tables in versions that readers see whole or not at all.

A write leaves files in a folder of its own; only when all tasks have ended does the driver add a manifest that names the
files of the new version, with its row count and day. Readers go by the newest manifest, so a write that fails, or is still
running, changes nothing for them. A streaming write names its versions by batch, so a batch that is repeated is there once.
One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

#: Versions are numbered with so many digits, so that names sort as numbers do.
DIGITS = 12


@dataclass
class Written(WriterCommitMessage):
    """A task's files, by their names below the table's folder, and their rows."""

    files: list[str]
    rows: int


class _Folder:
    """A table's folder in any file system that Arrow knows."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def versions(self) -> list[int]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/manifests", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def manifest(self, version: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/manifests/{version:0{DIGITS}}.json") as f:
            return json.loads(f.read())

    def publish(self, version: int, manifest: dict) -> None:
        """The manifest under another name first: a name that readers look for is there only with all its content."""
        self.fs.create_dir(f"{self.root}/manifests")
        draft = f"{self.root}/manifests/{version:0{DIGITS}}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(manifest).encode())
        self.fs.move(draft, f"{self.root}/manifests/{version:0{DIGITS}}.json")

    def drop(self, name: str) -> None:
        from pyarrow import fs

        if self.fs.get_file_info(f"{self.root}/{name}").type != fs.FileType.NotFound:
            self.fs.delete_dir(f"{self.root}/{name}")


class _Writer:
    """What batch and streaming writes have in common."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.day = options.get("atualizado") or str(dt.date.today())
        self.run = f"data/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        folder, rows, out = _Folder(self.path), 0, None
        name = f"{self.run}/part-{TaskContext.get().partitionId():05}-{uuid.uuid4().hex}.parquet"
        try:
            for batch in iterator:
                if out is None:
                    folder.fs.create_dir(f"{folder.root}/{self.run}")
                    out = pq.ParquetWriter(f"{folder.root}/{name}", batch.schema, filesystem=folder.fs)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written([name] if out is not None else [], rows)

    def finish(self, messages: list, version: int, before: int | None) -> None:
        folder = _Folder(self.path)
        kept = folder.manifest(before) if before is not None and not self.overwrite else {"files": [], "rows": 0}
        done = [m for m in messages if m is not None]
        manifest = {"versao": version, "atualizado": self.day, "rows": kept["rows"] + sum(m.rows for m in done), "files": kept["files"] + [f for m in done for f in m.files]}
        folder.publish(version, manifest)


class BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        last = max(_Folder(self.path).versions(), default=None)
        self.finish(messages, 0 if last is None else last + 1, last)

    def abort(self, messages: list) -> None:
        _Folder(self.path).drop(self.run)


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    """Every batch is a version; its files have names of their own, so a repeated batch only repeats its manifest."""

    def commit(self, messages: list, batchId: int) -> None:
        earlier = [v for v in _Folder(self.path).versions() if v < batchId]
        self.finish(messages, batchId, max(earlier, default=None))

    def abort(self, messages: list, batchId: int) -> None:
        """Files that no manifest names are never read; swept() removes them."""


class Snapshots(DataSource):
    """df.write.format("snapshot").mode("overwrite" or "append").option("path", ...).option("atualizado", day).save()"""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def writer(self, schema: T.StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(schema, self.options, overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(schema, self.options, overwrite)


def write(df: DataFrame, path: str, day: str | None = None, mode: str = "overwrite", **counts) -> dict[str, int]:
    """A new version of the table at `path`; returns the `counts` (names and aggregates of df), taken while it was written."""
    df.sparkSession.dataSource.register(Snapshots)
    seen = Observation(uuid.uuid4().hex) if counts else None
    rows = df.observe(seen, *(c.alias(n) for n, c in counts.items())) if seen else df
    writer = rows.write.format("snapshot").mode(mode).option("path", path)
    (writer.option("atualizado", day) if day else writer).save()
    return {n: seen.get[n] for n in counts} if seen else {}


def state(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """versao, atualizado, rows and files of the newest version (or one that is asked for); of a table that isn't there: none, None, 0 and no files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    known = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
    at = version if version is not None else max(known, default=None)
    if at is None or at not in known:
        return {"versao": None, "atualizado": None, "rows": 0, "files": []}
    return json.loads(spark.read.option("wholetext", True).text(f"{path}/manifests/{at:0{DIGITS}}.json").first()["value"])


def read(spark: SparkSession, path: str, schema: T.StructType | str, version: int | None = None) -> DataFrame:
    """The rows of a version (the newest by default); none for a table that isn't there."""
    files = state(spark, path, version)["files"]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in files))


def swept(path: str, keep: int = 1) -> int:
    """Removes all but the newest `keep` versions and what failed writes left; returns the number of folders removed."""
    folder = _Folder(path)
    versions = folder.versions()
    old, new = versions[:-keep], versions[-keep:]
    used = {f.rsplit("/", 1)[0] for v in new for f in folder.manifest(v)["files"]}
    for v in old:
        folder.fs.delete_file(f"{folder.root}/manifests/{v:0{DIGITS}}.json")
    from pyarrow import fs

    gone = [f.base_name for f in folder.fs.get_file_info(fs.FileSelector(f"{folder.root}/data", allow_not_found=True)) if f"data/{f.base_name}" not in used]
    for name in gone:
        folder.drop(f"data/{name}")
    return len(gone)


def counted(**conditions: F.Column) -> dict[str, F.Column]:
    """Aggregates for write(): how many rows meet each condition."""
    return {n: F.count_if(c) for n, c in conditions.items()}
