"""What pages show: timelines, letters, titles, ids by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.functions import text as tx


def timeline(listings: DataFrame, usual: str) -> DataFrame:
    """+ lugar, from the newest version; the usual status isn't shown."""
    order = W.partitionBy("registro").orderBy(F.desc("data"), F.desc("expediente"))
    return listings.withColumn("lugar", F.row_number().over(order).cast("long")).withColumn("situacao", F.when(F.col("situacao") != usual, F.col("situacao")).otherwise(""))


def letters(rows: DataFrame, name: str = "nome") -> DataFrame:
    """letra, n, lugar: letters in order, digits and the rest last. 27 rows at most reach the window."""
    counted = rows.groupBy(tx.initial(F.col(name)).alias("letra")).agg(F.count("*").alias("n"))
    return counted.withColumn("lugar", F.row_number().over(W.orderBy(F.col("letra") == "0-9", "letra")).cast("long"))


def title(kind: Column, old: Column, new: Column) -> Column:
    return F.concat(kind, F.lit(": "), F.date_format(old, "dd/MM/yyyy"), F.lit(" → "), F.date_format(new, "dd/MM/yyyy"))


def ascending(numbers: Column) -> Column:
    """Numbers ascend and, if there are any, begin with 1."""
    return (F.array_sort(numbers) == numbers) & ((F.size(numbers) == 0) | (F.get(numbers, F.lit(0)) == 1))


def ids(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, chave, id: one row for each column's id that isn't null."""
    return rows.unpivot(key, columns, "chave", "id").where("id is not null")
