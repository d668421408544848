"""Positions, pages and the best rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.sources.store import kept


def numbered(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """df + name, the row's place (from 1) in the whole order, without bringing all rows to one task.

    Rows are dealt out by ranges of the order; a task numbers its own, and the sizes of the ranges before are added.
    The ranges are written first, since sampling them twice could give two different cuts.
    """
    ranged = kept(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    # One row for each partition: small by construction.
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, (own + F.col("__before")).cast("long")).drop("__part", "__before")


def paged(df: DataFrame, count: int, *order: Column) -> DataFrame:
    """+ pos and page, from 1."""
    return numbered(df, *order).withColumn("page", F.ceil(F.col("pos") / count).cast("long"))


def best(df: DataFrame, keys: list[str], n: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= n)
