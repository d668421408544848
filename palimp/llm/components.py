"""Connected components by contraction: each round every vertex moves to its smallest neighbour, and edges follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.durable import durable


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for the vertices of edges (a, b); component is one of the component's vertices.

    A round at least halves the vertices that still have edges, so there are at most log2 of them. Everything stays in
    DataFrames; vertices' labels are taken by aggregation, and joins on a hub's key are split by adaptive execution.
    """
    spark = edges.sparkSession
    moves: list[DataFrame] = []
    left = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = durable(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("to")).select("v", F.least("v", "to").alias("to")))
        moves.append(move)
        on_a = left.join(move.select(F.col("v").alias("a"), F.col("to").alias("x")), "a")
        on_b = on_a.join(move.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        left = durable(on_b.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not moves:
        return spark.createDataFrame([], f"v {edges.schema['a'].dataType.simpleString()}, component {edges.schema['a'].dataType.simpleString()}")
    at = moves[-1]
    for move in reversed(moves[:-1]):
        later = at.select(F.col("v").alias("to"), F.col("to").alias("end"))
        at = move.join(later, "to", "left").select("v", F.coalesce("end", "to").alias("to"))
    return durable(at.select("v", F.col("to").alias("component")))
