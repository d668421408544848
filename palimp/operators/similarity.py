"""Similarity of texts by the multiset of their characters, and one-to-one pairing by it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.sources.store import kept

#: Scores of a group that are folded in one row.
SMALL = 10_000


def quick_ratio(pairs: DataFrame, keys: list[str], a: str, b: str, limit: int = 20_000) -> DataFrame:
    """keys + ratio: 2 * shared characters / all characters of the first `limit` signs of both; 1 for two empty texts.

    One row for each sign and side is counted before it is shuffled, and each pair's signs meet by their counts.
    """
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, limit)
    sides = pairs.select(*keys, F.explode(F.array(F.struct(cut(a).alias("t"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(cut(b).alias("t"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("s"))
    signs = sides.select(*keys, "s.x", "s.y", F.explode(F.filter(F.split("s.t", ""), lambda v: v != "")).alias("sign"))
    counted = signs.groupBy(*keys, "sign").agg(F.sum("x").alias("na"), F.sum("y").alias("nb"))
    shared = counted.groupBy(*keys).agg(F.sum(F.least("na", "nb")).alias("shared"), F.sum(F.col("na") + F.col("nb")).alias("size"))
    return pairs.select(*keys).join(shared, keys, "left").select(*keys, F.when(F.col("size") > 0, 2 * F.col("shared") / F.col("size")).otherwise(1.0).alias("ratio"))


def greedy(scored: DataFrame, group: list[str], i: str = "i", j: str = "j", score: str = "score", small: int = SMALL) -> DataFrame:
    """group, documento, i, j: the highest score first (ties: the larger i, then j), each i and j once.

    Groups of at most `small` scores are folded each in its row. In larger ones the pairs that are best for both their
    members are taken, round by round; the best pair left is always one of them. Fields of group may be null; scores
    without i or j are left out.
    """
    best = F.struct(F.col(score).alias("score"), F.col(i).alias("i"), F.col(j).alias("j"))
    rows = scored.where(F.col(i).isNotNull() & F.col(j).isNotNull()).select(F.struct(*group).alias("__g"), best.alias("__b"))
    large = kept(rows.groupBy("__g").count().where(F.col("count") > small).select("__g"))
    if large.isEmpty():
        taken = _folded(rows)
    else:
        taken = _folded(rows.join(large, "__g", "left_anti")).unionByName(_in_rounds(rows.join(large, "__g", "left_semi")))
    numbered = taken.withColumn("documento", F.row_number().over(W.partitionBy("__g").orderBy(F.desc("__b"))).cast("long"))
    return numbered.select("__g.*", "documento", F.col("__b.i").alias(i), F.col("__b.j").alias(j))


def _folded(rows: DataFrame) -> DataFrame:
    """__g, __b of the pairs that are taken, by a fold over each group's sorted scores."""
    kind = rows.schema["__b"].dataType
    one, many = kind.simpleString(), {c: kind[c].dataType.simpleString() for c in ("i", "j")}
    start = F.expr(f"named_struct('ui', cast(array() as array<{many['i']}>), 'uj', cast(array() as array<{many['j']}>), 'b', cast(array() as array<{one}>))")

    def take(state, row):
        free = ~F.array_contains(state["ui"], row["i"]) & ~F.array_contains(state["uj"], row["j"])
        more = F.struct(F.array_append(state["ui"], row["i"]).alias("ui"), F.array_append(state["uj"], row["j"]).alias("uj"), F.array_append(state["b"], row).alias("b"))
        return F.when(free, more).otherwise(state)

    ordered = rows.groupBy("__g").agg(F.sort_array(F.collect_list("__b"), asc=False).alias("__r"))
    return ordered.select("__g", F.explode(F.aggregate("__r", start, take)["b"]).alias("__b"))


def _in_rounds(rows: DataFrame) -> DataFrame:
    """As _folded(), by rounds of aggregations: no row or task holds a group."""
    left, taken = kept(rows.distinct()), []
    while not left.isEmpty():
        for_i = left.groupBy("__g", "__b.i").agg(F.max("__b").alias("__b")).select("__g", "__b")
        for_j = left.groupBy("__g", "__b.j").agg(F.max("__b").alias("__b")).select("__g", F.col("__b.i").alias("i"), F.col("__b.j").alias("j"))
        new = kept(for_i.select("__g", F.col("__b.i").alias("i"), F.col("__b.j").alias("j"), "__b").join(for_j, ["__g", "i", "j"]))
        taken.append(new.select("__g", "__b"))
        for c in ("i", "j"):
            left = left.withColumn(c, F.col(f"__b.{c}")).join(new.select("__g", c), ["__g", c], "left_anti").drop(c)
        left = kept(left)
    return reduce(DataFrame.unionByName, taken)
