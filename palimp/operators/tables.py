"""Rows of declaration tables: headers, continuation rows, the pages a table spans, and lookups by number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.functions import text as tx

#: The table's columns, and the shape of a date.
COLUMNS = ("data", "expediente", "assunto", "pet_data", "pet_expediente", "pet_assunto", "aprovacao", "itens", "versoes", "apresentacoes")
DATE = r"\d{2}/\d{2}/\d{4}"
MERGED = ("itens", "versoes", "apresentacoes")


def cells(rows: DataFrame, keys: list[str], column: str = "cells") -> DataFrame:
    """keys, pos and the ten columns, squeezed; missing cells are empty, headers and blank rows are left out."""
    out = rows.select(*keys, "pos", *(tx.squeezed(tx.or_empty(F.get(column, F.lit(i)))).alias(c) for i, c in enumerate(COLUMNS)))
    blank = F.concat_ws("", *COLUMNS) == ""
    return out.where(~blank & ~F.lower("data").startswith("data") & ~F.col("data").startswith("Dados"))


def entries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entry (from 1) and the seven kept columns: rows without a date and subject continue the entry before them."""
    own = F.col("data").rlike(DATE) | F.col("expediente").rlike(DATE) | (F.col("assunto") != "")
    order = W.partitionBy(*keys).orderBy("pos")
    new = own | (F.row_number().over(order) == 1)
    placed = rows.withColumn("__new", new).withColumn("entry", F.sum(F.col("__new").cast("long")).over(order))
    first = {c: F.max(F.when(F.col("__new"), F.col(c))).alias(c) for c in ("data", "expediente", "assunto", "aprovacao")}

    def all_of(c: str):
        inside = F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("v"))))
        return F.concat_ws(" ", F.filter(F.transform(inside, lambda x: x["v"]), lambda v: v != "")).alias(c)

    merged = {c: all_of(c) for c in MERGED}
    return placed.groupBy(*keys, "entry").agg(*first.values(), *merged.values())


def islands(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages (page, titled, n_tables) that belong to a table: from one with the title on, until a page without tables."""
    event = F.when(F.col("n_tables") == 0, 0).when(F.col("titled"), 1)
    on = F.last(event, ignorenulls=True).over(W.partitionBy(*keys).orderBy("page"))
    return pages.withColumn("inside", F.coalesce(on, F.lit(0)) == 1)


def by_digits(asked: DataFrame, entries_: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys, expediente) + the first entry (by entry) whose number has the same digits; without digits, none."""
    a = asked.withColumn("__d", tx.digits(F.col("expediente")))
    e = entries_.withColumn("__d", tx.digits(F.col("expediente"))).where("__d <> ''")
    first = e.groupBy(*keys, "__d").agg(F.min_by("itens", "entry").alias("itens"), F.min("entry").alias("entry"))
    return a.join(first, [*keys, "__d"], "left").drop("__d")


def runs(rows: DataFrame, keys: list[str], value: str, order: str = "pos") -> DataFrame:
    """keys, run (from 1), value, n, first: runs of equal neighbours."""
    w = W.partitionBy(*keys).orderBy(order)
    change = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("__c", change.cast("long")).withColumn("run", F.sum("__c").over(w)).groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order).alias("first"))
