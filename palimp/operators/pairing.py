"""One-to-one pairing of texts by the multiset of their signs: the best pair first, then the best of what is left.

Scores are 2 * shared signs / all signs of both, ties go to the larger i, then the larger j, so pairs have a strict order and
a pair that is best for both its texts is taken whatever happens elsewhere. Groups of few pairs are paired in one go, many
groups to a task. In a large group no task sees all pairs: texts lie in bands of similar length, each text gets its best
partners from bands near its own, then from those other bands whose lengths alone allow a score as good as the worst it has.
From these lists pairs that are best on both sides are taken, round by round; texts whose list has run out get a new one
among the texts that are left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.sources.store import kept

#: Signs of a text that count; pairs of a group that is paired in one go; texts in a tile; partners in a list.
LIMIT, SMALL, TILE, LIST = 20_000, 10_000, 512, 12
#: Lengths in a band differ by this factor at most.
BAND = 1.2


def signs(texts: DataFrame, group: list[str], number: str, text: str, side: int) -> DataFrame:
    """group, side, id, size, sign (code points) and n (how often) of each text; a null text is empty."""
    kind = dict(texts.dtypes)
    fields = ", ".join(f"`{g}` {kind[g]}" for g in group)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [Counter(x or "") for x in b["__text"]]
            out = b[[*group, "id"]].copy()
            out["size"] = [sum(c.values()) for c in found]
            out["sign"] = [list(map(ord, c)) for c in found]
            out["n"] = [list(c.values()) for c in found]
            yield out

    rows = texts.select(*group, F.col(number).cast("long").alias("id"), F.substring(F.col(text), 1, LIMIT).alias("__text"))
    return rows.mapInPandas(count, f"{fields}, id long, size long, sign array<int>, n array<int>").withColumn("side", F.lit(side))


def matrix(rows: pd.DataFrame, places: dict[int, int]) -> np.ndarray:
    """A row of sign counts for each text; `places` gives a sign its column and grows with new ones."""
    for s in rows["sign"]:
        for x in s:
            places.setdefault(int(x), len(places))
    out = np.zeros((len(rows), len(places)), np.int32)
    for k, (s, n) in enumerate(zip(rows["sign"], rows["n"], strict=True)):
        out[k, [places[int(x)] for x in s]] = n
    return out


def scores(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[np.ndarray]:
    """For each text of a, its scores with all of b; two empty texts score 1."""
    places: dict[int, int] = {}
    matrix(a, places)
    right, left = matrix(b, places), matrix(a, places)
    sizes = b["size"].to_numpy()
    for row, size in zip(left, a["size"].to_numpy(), strict=True):
        both = sizes + size
        shared = np.minimum(right, row).sum(1) if len(places) else np.zeros(len(b))
        yield np.where(both > 0, 2 * shared / np.maximum(both, 1), 1.0)


def in_order(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple[int, int, float]]:
    """(i, j, score) of a group, taken one after the other."""
    if not len(a) or not len(b):
        return []
    table = np.vstack(list(scores(a, b)))
    i, j = np.meshgrid(a["id"].to_numpy(), b["id"].to_numpy(), indexing="ij")
    out, used_i, used_j = [], set(), set()
    for k in np.lexsort((j.ravel(), i.ravel(), table.ravel()))[::-1]:
        x, y = int(i.ravel()[k]), int(j.ravel()[k])
        if x not in used_i and y not in used_j:
            used_i.add(x)
            used_j.add(y)
            out.append((x, y, float(table.ravel()[k])))
    return out


def _small(rows: DataFrame, group: list[str], fields: str) -> DataFrame:
    def work(bucket: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, part in bucket.groupby(group, dropna=False, sort=False):
            key = key if isinstance(key, tuple) else (key,)
            out += [(*(None if pd.isna(k) else k for k in key), *p) for p in in_order(part[part["side"] == 0], part[part["side"] == 1])]
        return pd.DataFrame(out, columns=[*group, "i", "j", "score"])

    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    return rows.withColumn("__b", F.pmod(F.xxhash64(*group), F.lit(buckets))).groupBy("__b").applyInPandas(work, f"{fields}, i long, j long, score double")


def lists(asking: DataFrame, left: DataFrame, group: list[str], fields: str, keep: int, tile: int) -> DataFrame:
    """group, side, id, partner, score: the best `keep` partners of each asking text among the texts left on the other side."""
    band = lambda size: F.floor(F.log(size + 1) / np.log(BAND)).cast("int")
    asking, other = asking.withColumn("band", band(F.col("size"))), left.withColumn("band", band(F.col("size")))
    bands = other.groupBy(*group, "side", "band").agg(F.count("*").alias("rows"), F.min("size").alias("shortest"), F.max("size").alias("longest"))
    facing = bands.select(*group, (1 - F.col("side")).alias("side"), F.col("band").alias("to"), F.ceil(F.col("rows") / tile).cast("int").alias("blocks"), "shortest", "longest")
    n_asking = asking.groupBy(*group, "side").agg(F.ceil(F.count("*") / tile).cast("int").alias("turns"))
    # A text of the band lies in one of its blocks and meets each block of asking texts there.
    blocked = other.join(bands.select(*group, "side", "band", F.ceil(F.col("rows") / tile).cast("int").alias("blocks")), [*group, "side", "band"])
    there = blocked.withColumn("side", 1 - F.col("side")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(n_asking, [*group, "side"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    key = [*group, "side", "to", "block", "turn"]
    there = there.select(*group, "side", F.col("band").alias("to"), "block", "turn", "id", "size", "sign", "n")
    there = there.toDF(*there.columns)  # columns of its own: both sides of the cogroup come from the same texts

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            ids, head = b["id"].to_numpy(), a[[*group, "side", "id"]].itertuples(index=False, name=None)
            for row, score in zip(head, scores(a, b), strict=True):
                out += [(*row, int(ids[k]), float(score[k])) for k in np.lexsort((ids, score))[::-1][:keep]]
        return pd.DataFrame(out, columns=[*group, "side", "id", "partner", "score"])

    def met(rows: DataFrame) -> DataFrame:
        here = rows.join(n_asking, [*group, "side"]).withColumn("turn", F.pmod(F.xxhash64("id", F.lit(1)), F.col("turns")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        here = here.select(*key, "id", "size", "sign", "n")
        return here.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(best, f"{fields}, side int, id long, partner long, score double")

    def top(found: DataFrame) -> DataFrame:
        order = W.partitionBy(*group, "side", "id").orderBy(F.desc("score"), F.desc("partner"))
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)

    pairs = asking.join(facing, [*group, "side"])
    near = F.abs(F.col("band") - F.col("to")) <= 1
    first = kept(top(met(pairs.where(near))))
    # The score that the lengths alone allow with any text of a band, against the worst partner in a full list.
    closest = F.when(F.col("size") < F.col("shortest"), F.col("shortest")).when(F.col("size") > F.col("longest"), F.col("longest")).otherwise(F.col("size"))
    bound = F.when(F.col("size") + closest > 0, 2 * F.least("size", closest) / (F.col("size") + closest)).otherwise(F.lit(1.0))
    worst = first.where(F.col("place") == keep).select(*group, "side", "id", F.col("score").alias("worst"))
    more = pairs.where(~near).join(worst, [*group, "side", "id"], "left").where(F.col("worst").isNull() | (bound >= F.col("worst")))
    columns = [*group, "side", "id", "partner", "score"]
    return top(first.select(*columns).unionByName(met(more).select(*columns))).select(*columns)


def _large(rows: DataFrame, group: list[str], fields: str, keep: int, tile: int) -> DataFrame:
    taken: list[DataFrame] = []
    left = kept(rows)
    while True:
        sides = left.groupBy(*group).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
        open_ = left.join(sides.where("a > 0 and b > 0").select(*group), group, "left_semi")
        if open_.isEmpty():
            break
        found = kept(lists(open_, open_, group, fields, keep, tile))
        while True:
            # A text's best partner is the first that is left on its list; without one it waits for a new list.
            order = W.partitionBy(*group, "side", "id").orderBy(F.desc("score"), F.desc("partner"))
            first = found.withColumn("place", F.row_number().over(order)).where("place = 1")
            a = first.where("side = 0").select(*group, F.col("id").alias("i"), F.col("partner").alias("j"), "score")
            b = first.where("side = 1").select(*group, F.col("partner").alias("i"), F.col("id").alias("j"))
            new = kept(a.join(b, [*group, "i", "j"]))
            if new.isEmpty():
                break
            taken.append(new)
            gone = new.select(*group, F.lit(0).alias("side"), F.col("i").alias("id")).unionByName(new.select(*group, F.lit(1).alias("side"), F.col("j").alias("id")))
            still = found.join(gone, [*group, "side", "id"], "left_anti")
            found = kept(still.join(gone.select(*group, (1 - F.col("side")).alias("side"), F.col("id").alias("partner")), [*group, "side", "partner"], "left_anti").select(*found.columns))
            left = kept(left.join(gone, [*group, "side", "id"], "left_anti"))
    none = rows.select(*group).limit(0).withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long"), "score": F.lit(0.0)})
    return reduce(DataFrame.unionByName, [t.select(*group, "i", "j", "score") for t in taken], none)


def paired(a: DataFrame, b: DataFrame, group: list[str], i: str = "i", j: str = "j", x: str = "x", y: str = "y", *, small: int = SMALL, keep: int = LIST, tile: int = TILE) -> DataFrame:
    """group, documento (from 1), i, j, score: pairs in the order in which they are taken, then what is left of a, then of b (score null).

    a has group, i, x and b has group, j, y; i and j are whole numbers, unique in their group's side; no field of group is null.
    """
    kind = dict(a.dtypes)
    fields = ", ".join(f"`{g}` {kind[g]}" for g in group)
    rows = kept(signs(a, group, i, x, 0).unionByName(signs(b, group, j, y, 1)))
    sides = rows.groupBy(*group).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    large = kept(sides.where(F.col("a") * F.col("b") > small).select(*group))
    pairs = _small(rows.join(large, group, "left_anti"), group, fields)
    if not large.isEmpty():
        pairs = pairs.unionByName(_large(rows.join(large, group, "left_semi"), group, fields, keep, tile))
    pairs = kept(pairs)
    rest = lambda side, own, other: rows.where(F.col("side") == side).select(*group, F.col("id").alias(own)).join(pairs, [*group, own], "left_anti").select(*group, own, F.lit(None).cast("long").alias(other), F.lit(None).cast("double").alias("score"))
    every = pairs.unionByName(rest(0, "i", "j")).unionByName(rest(1, "j", "i"))
    order = W.partitionBy(*group).orderBy(F.col("score").desc_nulls_last(), F.when(F.col("score").isNotNull(), F.col("i")).desc_nulls_last(), F.when(F.col("score").isNotNull(), F.col("j")).desc_nulls_last(), F.col("i").asc_nulls_last(), F.col("j"))
    return every.withColumn("documento", F.row_number().over(order).cast("long")).select(*group, "documento", F.col("i").alias(i), F.col("j").alias(j), "score")
