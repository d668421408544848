"""A trie of conversations: each node is a sequence of turns that some conversations start with.

Turns become digests where they are read; from there on only digests and lengths move. A conversation is a path of
digests, equal paths are one with a count. The paths are hash-partitioned by the digest of their first turn, several first
turns to a bucket, and each bucket builds its tries in memory: nodes in arrays, children found by a dictionary from
(node, digest), sums over subtrees by walking the nodes backwards, children before parents.

A first turn with more turns below it than `most` doesn't go to one bucket: the turns that all its paths share are nodes by
themselves (the shared beginning of the smallest and the largest path, which aggregate like any minimum), and what is
below is dealt out anew by the next turn, again and again until every part is small or is a single path. What the parts
sum up to comes back by aggregation over their topmost nodes, so no task ever holds a large subtree, and a part that is
split always gets smaller.

The ids of the conversations that end at a node are hashed in order: equal paths are range-partitioned by (path, id), each
task makes long strings of its part, and only those strings come together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.llm.durable import durable, joined, stored

#: Turns of a part of the trie that are built in one go, and of a bucket of such parts; hex digits of a digest.
MOST, BUCKET, HEX = 4_096, 16_384, 32
#: Ids in a string of ids.
IDS = 2_048
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def turns(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn (its place), x (digest of role and text), n (UTF-8 bytes of the text); null role or text is empty. Rows without conv_id take no part."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256), 1, HEX)
    return rows.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), digest.alias("x"), F.octet_length(t).cast("long").alias("n")).where("conv_id is not null")


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of x, n) in the order of turn, null first; of equal turns the smaller digest is first."""
    return rows.groupBy("conv_id").agg(_in_order())


def _in_order() -> Column:
    # Structs are sorted by their fields, and null comes first.
    of = F.sort_array(F.collect_list(F.struct("turn", "x", "n")))
    return F.transform(of, lambda t: F.struct(t["x"].alias("x"), t["n"].alias("n"))).alias("turns")


def grafted(rows: DataFrame, family: Column, head: Column, heads: int) -> DataFrame:
    """conv_id, turns: the first `head` (of conv_id, below `heads`) turns of conversation `family` (of conv_id; null or absent: none), then the conversation's own from there on.

    One shuffle, by family: a conversation meets the one whose turns it takes in the same task.
    """
    own = rows.withColumn("__f", family).repartition("__f").groupBy("__f", "conv_id").agg(_in_order())
    donor = F.max(F.when(F.col("conv_id") == F.col("__f"), F.slice("turns", 1, heads))).over(W.partitionBy("__f"))
    none = F.slice("turns", 1, 0)
    first = F.slice(F.coalesce(donor, none), F.lit(1), head.cast("int"))
    rest = F.slice("turns", head.cast("int") + 1, F.greatest(F.size("turns") - head.cast("int"), F.lit(0)))
    return own.select("conv_id", F.concat(first, rest).alias("turns"))


def ends(ids: DataFrame) -> DataFrame:
    """key, conv_id (smallest), n, ends_sha256 (of the ids in ascending order, joined by commas) of (key, conv_id) rows."""

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            out = []
            for key, conv in zip(b["key"], b["conv_id"], strict=True):
                if key != at or len(held) == IDS:
                    if held:
                        out.append((at, held[0], len(held), ",".join(map(str, held))))
                    at, held = key, []
                held.append(conv)
            yield pd.DataFrame(out, columns=["key", "conv_id", "n", "ids"])
        if held:
            yield pd.DataFrame([(at, held[0], len(held), ",".join(map(str, held)))], columns=["key", "conv_id", "n", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first, n, sha = None, 0, 0, hashlib.sha256()
        for b in batches:
            out = []
            for key, conv, count, ids in b[["key", "conv_id", "n", "ids"]].itertuples(index=False, name=None):
                if key != at:
                    if at is not None:
                        out.append((at, first, n, sha.hexdigest()))
                    at, first, n, sha = key, conv, 0, hashlib.sha256()
                sha.update((("," if n else "") + ids).encode())
                n += count
            yield pd.DataFrame(out, columns=["key", "conv_id", "n", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(at, first, n, sha.hexdigest())], columns=["key", "conv_id", "n", "ends_sha256"])

    in_order = ids.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined_ids = in_order.mapInPandas(strings, "key string, conv_id long, n long, ids string")
    return joined_ids.repartition("key").sortWithinPartitions("key", "conv_id").mapInPandas(hashed, "key string, conv_id long, n long, ends_sha256 string")


def built(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the parts of a bucket, each part from its top node (the turns up to `at`) on.

    group: g (part), up (the part above), at, path, lens, n, conv_id, ends_sha256. Returns g and up of top nodes (null for
    others) and the node's columns; a top node's parent is left open.
    """
    conv, depth, parent, count, size, sha, tops = [], [], [], [], [], [], []
    child: dict[tuple[int, str] | str, int] = {}
    order = group.sort_values(["g", "conv_id"])
    for g, up, at, path, lens, n, c, end in order[["g", "up", "at", "path", "lens", "n", "conv_id", "ends_sha256"]].itertuples(index=False, name=None):
        node = -1
        for d in range(at, len(lens) + 1):
            key = g if d == at else (node, path[HEX * (d - 1) : HEX * d])
            known = child.get(key)
            if known is None:  # the first path to come by has the smallest id
                known = child[key] = len(conv)
                conv.append(c)
                depth.append(d)
                parent.append(node)
                count.append(0)
                size.append(int(lens[d - 1]))
                sha.append(None)
                tops.append((g, up) if d == at else (None, None))
            node = known
            count[node] += n
        sha[node] = end
    children, leaves, saved = [0] * len(conv), [0] * len(conv), [0] * len(conv)
    for node in range(len(conv) - 1, -1, -1):
        leaves[node] = leaves[node] or 1
        saved[node] += (count[node] - 1) * size[node]
        if (over := parent[node]) >= 0:
            children[over] += 1
            leaves[over] += leaves[node]
            saved[over] += saved[node]
    above = pd.array([conv[p] if p >= 0 else None for p in parent], "Int64")
    out = pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": above, "n_convs": count, "n_children": children, "n_leaves": leaves, "saved_tokens": saved})
    return out.assign(ends_sha256=sha, g=[t[0] for t in tops], up=[t[1] for t in tops])


def _prefix(depth: Column) -> Column:
    """The name of the first `depth` turns of a path."""
    return F.md5(F.substring(F.col("path"), F.lit(1), (depth * HEX).cast("int")).cast("binary"))


def divided(live: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame], int]:
    """The small parts of the trie, what the split ones have in common (a table for each round), and the turns in small parts."""
    small: list[DataFrame] = []
    split: list[DataFrame] = []
    turns_left = 0
    below = F.size("lens") - F.col("at") + 1
    is_large = (F.col("entries") > most) & (F.col("n_paths") > 1)
    while True:
        sizes = durable(live.groupBy("g").agg(F.sum(below).alias("entries"), F.count("*").alias("n_paths")))
        n_large, rest = sizes.agg(F.count(F.when(is_large, 1)), F.coalesce(F.sum(F.when(~is_large, F.col("entries"))), F.lit(0))).first()
        turns_left += rest
        if not n_large:
            return reduce(DataFrame.unionByName, [*small, live]), split, turns_left
        large = sizes.where(is_large).select("g")
        mine = joined(live, large, "g", "left_semi", rows=n_large)
        small.append(joined(live, large, "g", "left_anti", rows=n_large))
        # All paths of a part share what its smallest and its largest path share.
        one = F.struct("path", "lens", "ends_sha256")
        ranges = mine.groupBy("g", "up", "at").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"))
        both = F.sequence(F.col("at"), F.least(F.size("lo.lens"), F.size("hi.lens")))
        same = lambda i: F.substring("lo.path", F.lit(1), i * HEX) == F.substring("hi.path", F.lit(1), i * HEX)
        ranges = ranges.withColumn("shared", F.aggregate(both, F.col("at"), lambda d, i: F.when(same(i), i).otherwise(d)))
        ended = F.when(F.size("lo.lens") == F.col("shared"), F.col("lo.ends_sha256"))
        common = durable(ranges.select("g", "up", "at", "shared", "n", "conv_id", F.slice("lo.lens", F.lit(1), F.col("shared")).alias("lens"), ended.alias("ends_sha256")))
        split.append(common)
        deeper = joined(mine.drop("up"), common.select("g", "shared"), "g", rows=n_large).where(F.size("lens") > F.col("shared"))
        live = durable(deeper.select(F.col("g").alias("up"), _prefix(F.col("shared") + 1).alias("g"), (F.col("shared") + 1).alias("at"), "path", "lens", "n", "conv_id", "ends_sha256"))


def shared_turns(common: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes for the turns that each split part shares, from the top nodes below them; only the last has several children, and paths that end there."""
    sums = tops.groupBy(F.col("up").alias("g")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    d, last = F.col("depth"), F.col("depth") == F.col("shared")
    bytes_on = F.aggregate(F.slice("lens", d, F.col("shared") - d + 1), F.lit(0).cast("long"), lambda a, b: a + b)
    nodes = common.join(sums, "g").select("*", F.explode(F.sequence("at", "shared")).alias("depth"))
    top = F.col("depth") == F.col("at")
    return nodes.select(
        "conv_id", d.cast("long").alias("depth"), F.when(~top, F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves", (F.col("below") + (F.col("n") - 1) * bytes_on).alias("saved_tokens"),
        F.when(last, F.col("ends_sha256")).alias("ends_sha256"), F.when(top, F.col("g")).alias("g"), F.when(top, F.col("up")).alias("up"),
    )


def trie(conversations: DataFrame, *, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """All nodes over (conv_id, turns: array of x, n): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes of the last turn for each member but one, summed over the subtree), ends_sha256.

    Conversations without turns are members of the root alone; a table without conversations has no nodes. conv_id must be
    unique and not null. A conversation is one path, and a path of any length is one value.
    """
    spark = conversations.sparkSession
    path = F.array_join(F.transform("turns", lambda t: t["x"]), "")
    rows = conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["n"]).alias("lens"))
    rows = stored(rows.withColumn("key", F.md5(F.col("path").cast("binary"))))
    distinct = rows.groupBy("key").agg(F.first("path").alias("path"), F.first("lens").alias("lens"))
    each = stored(ends(rows).join(distinct, "key"))
    live = each.where(F.size("lens") > 0).select(F.lit("").alias("up"), _prefix(F.lit(1)).alias("g"), F.lit(1).alias("at"), "path", "lens", "n", "conv_id", "ends_sha256")
    parts, split, entries = divided(live, most)
    # A part is whole in one bucket; the number of buckets grows with the turns.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(entries) // bucket))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets))).groupBy("bucket")
    nodes = [stored(dealt.applyInPandas(built, f"{NODE}, ends_sha256 string, g string, up string"))]
    for common in reversed(split):
        tops = reduce(DataFrame.unionByName, [n.where("g is not null").select("up", "n_leaves", "saved_tokens") for n in nodes])
        nodes.append(durable(shared_turns(common, tops)))
    made = reduce(DataFrame.unionByName, nodes)
    tops = made.where("g is not null")
    root = each.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(F.size("lens") == 0, F.col("ends_sha256"))).alias("ends_sha256")).where("n_convs is not null")
    # A top node's parent is the last shared turn of the part above it, or the root.
    above = reduce(DataFrame.unionByName, [root.select(F.lit("").alias("up"), F.col("conv_id").alias("over")), *(c.select(F.col("g").alias("up"), F.col("conv_id").alias("over")) for c in split)])
    placed = joined(tops, durable(above), "up").drop("parent_conv_id").withColumnRenamed("over", "parent_conv_id")
    first = tops.where("up = ''").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    top = root.join(F.broadcast(first)).withColumn("depth", F.lit(0).cast("long")).withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = [*COLUMNS, "ends_sha256"]
    out = reduce(DataFrame.unionByName, [x.select(*columns) for x in (made.where("g is null"), placed, top)])
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
