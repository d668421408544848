"""A paged service over rows that are kept in a folder for each day, as a source for the day feed.

The folder has the service's fields as columns (and `pos`, their order) in day=YYYY-MM-DD folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from palimp.sources.day_feed import FROM, TO, DayFeed, DayReader, days


def write(rows: DataFrame, folder: str, day: str = "dia") -> None:
    """rows with the service's fields, `pos` and a day column."""
    rows.withColumnRenamed(day, "day").repartition("day").sortWithinPartitions("pos").write.mode("overwrite").partitionBy("day").parquet(folder)


def serve(folder: str) -> Callable[[dict, float], dict]:
    """A function that gives pages of the rows of the asked days; the last day asked for is held, and a page's rows alone are taken out of it."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    held: dict[str, pa.Table | None] = {}

    def rows(day: str) -> pa.Table | None:
        if day not in held:
            where, root = fs.FileSystem.from_uri(folder)
            found = where.get_file_info(fs.FileSelector(f"{root}/day={day}", allow_not_found=True))
            parts = [pq.read_table(f.path, filesystem=where, partitioning=None) for f in found if f.base_name.endswith(".parquet")]
            held.clear()
            held[day] = pa.concat_tables(parts).sort_by("pos") if parts else None
        return held[day]

    def fetch(params: dict, timeout: float) -> dict:
        size, n = params["count"], params["page"]
        content, total, first = [], 0, (n - 1) * size
        for day in days(params[FROM], params[TO]):
            table = rows(day)
            if table is not None:
                a, b = max(first - total, 0), max(first + size - total, 0)
                content += table.slice(a, b - a).to_pylist() if a < len(table) else []
                total += len(table)
        return {"content": content, "totalElements": total, "totalPages": -(-total // size), "last": n * size >= total, "number": n}

    return fetch


class _Reader(DayReader):
    def __init__(self, schema, options) -> None:
        super().__init__(schema, options)
        self.folder = options["pasta"]

    def transport(self) -> Callable[[dict, float], dict]:
        return serve(self.folder)


class FolderFeed(DayFeed):
    """The day feed over a folder; option `pasta` names it."""

    @classmethod
    def name(cls) -> str:
        return "folder_feed"

    def streamReader(self, schema) -> DayReader:
        return _Reader(schema, self.options)
