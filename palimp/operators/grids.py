"""Tables of pages as the rows that declaration tables are read from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimp.functions import markup
from palimp.operators import tables

#: Places that are held before they are handed over (but for one page's).
AT_ONCE = 20_000
_PLACE = (("tabela", pa.int32()), ("linha", pa.int32()), ("coluna", pa.int32()), ("texto", pa.string()), ("cabecalho", pa.bool_()), ("propria", pa.bool_()))


def grid(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys and tabela, linha, coluna, texto, cabecalho, propria: each place of each table; a cell that spans places stands in all of them."""
    rows = pages.select(*keys, F.col(html).cast("string").alias("__html"))
    schema = T.StructType([*rows.drop("__html").schema.fields, *T.StructType.fromDDL(markup.GRID).fields])

    def made(b: pa.RecordBatch, first: int, found: list[list[tuple]]) -> pa.RecordBatch:
        whose = pa.array(np.repeat(np.arange(first, first + len(found)), [len(f) for f in found]))
        places = zip(*(p for f in found for p in f), strict=True)
        return pa.RecordBatch.from_arrays([*(b.column(i).take(whose) for i in range(len(keys))), *(pa.array(v, kind) for v, (_, kind) in zip(places, _PLACE, strict=True))], names=schema.fieldNames())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, n, first = [], 0, 0
            for i, page in enumerate(b.column(len(keys))):
                found.append(markup.grids(page.as_py()))
                n += len(found[-1])
                if n >= AT_ONCE:
                    yield made(b, first, found)
                    found, n, first = [], 0, i + 1
            if n:
                yield made(b, first, found)

    # The whole batch is read by one call, where a table function has one for each page and hands over row by row.
    return rows.mapInArrow(read, schema)


def rows(places: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos (over all tables of a page), cells: a row's texts from left to right; rows whose cells are all headers are left out."""
    made = places.groupBy(*keys, "tabela", "linha").agg(F.array_sort(F.collect_list(F.struct("coluna", "texto"))).alias("__c"), F.bool_and("cabecalho").alias("__h"))
    pos = (F.col("tabela").cast("long") * 1_000_000_000 + F.col("linha")).alias("pos")
    return made.where(~F.col("__h")).select(*keys, pos, F.transform("__c", lambda c: c["texto"]).alias("cells"))


def declared(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, entry and the kept columns of the declaration tables in pages, continuation rows joined to the entry before them."""
    return tables.entries(tables.cells(rows(grid(pages, keys, html), keys), keys), keys)
