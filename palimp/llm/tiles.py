"""Search of a stated query set against all rows, in tiles: packed blocks of queries meet packed blocks of candidates.

Candidates are packed where they are read, into blocks of at most BLOCK rows, and dealt over places block by block; queries
into blocks of about QUERIES, of which each place gets a copy. A tile is one pair of blocks and holds a few megabytes
whatever the tables' sizes; a shared value or a common id cannot make a tile larger. Each tile gives the best `k` of each of its queries, and those are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.llm.durable import durable, joined

BLOCK, QUERIES = 8192, 4096
#: Tiles at least, so that small tables use several cores.
SPREAD = 8


def unique(rows: DataFrame, zero: bool) -> DataFrame:
    """rows (id, x) without a second row of an id: of several the one whose vector comes first, component by component, counts; those that take no part don't."""
    again = durable(rows.where("id is not null").groupBy("id").count().where("count > 1").select("id"))
    n = again.count()
    if not n:
        return rows
    part = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("x") > 0)
    part = part if zero else part & F.exists("x", lambda v: v != 0)
    one = joined(rows, again, "id", "left_semi", rows=n).where(part).groupBy("id").agg(F.min("x").alias("x"))
    return joined(rows, again, "id", "left_anti", rows=n).unionByName(one)


def vectors_of(b: pa.RecordBatch, zero: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix of doubles) of a batch's rows (id, x) that take part.

    Rows with a null id, a null or empty vector, or a null, NaN or infinite component don't, zero vectors too unless `zero`.
    """
    col = b.column(1)
    size = np.asarray(col.value_lengths().fill_null(0))
    values = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan))
    ends = np.cumsum(size)
    known = np.asarray(b.column(0).is_valid())
    ids = np.asarray(b.column(0).fill_null(0)).astype(np.int64)
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero((size == dim) & known)
        x = values[(ends[rows] - dim)[:, None] + np.arange(dim)]
        good = np.isfinite(x).all(1) & (zero | x.any(1))
        yield dim, ids[rows[good]], x[good]


def pack(df: DataFrame, groups: int, block: int, zero: bool, weights: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """df (id, x), ids unique, as blocks: place (0 to groups - 1), dim, kind (numpy's), ids, vectors (row-major doubles, or what `weights` makes of them) of the rows that take part."""

    def packed(places: Iterator[int], dim: int, ids: list[np.ndarray], x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own, rows = np.concatenate(ids), np.concatenate(x)
        for a in range(0, len(own), block):
            part = slice(a, a + block)
            held = weights(rows[part]) if weights else rows[part]
            yield pa.RecordBatch.from_arrays([pa.array([next(places)], pa.int32()), pa.array([dim], pa.int32()), pa.array([held.dtype.str]), pa.array([own[part].tobytes()], pa.binary()), pa.array([held.tobytes()], pa.binary())], names=["place", "dim", "kind", "ids", "vectors"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task deals its blocks over all places: however few tasks read the table, many work on its tiles.
        place = (n % groups for n in count(TaskContext.get().partitionId()))
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for dim, ids, x in vectors_of(b, zero):
                mine = held.setdefault(dim, ([], []))
                mine[0].append(ids)
                mine[1].append(x)
                if sum(map(len, mine[0])) >= block:
                    yield from packed(place, dim, *held.pop(dim))
        for dim, mine in held.items():
            yield from packed(place, dim, *mine)

    return df.mapInArrow(blocks, "place int, dim int, kind string, ids binary, vectors binary")


def search(vectors: DataFrame, every: int, k: int, tile: Callable[[], Callable], *, key: str, vector: str, kind: str, zero: bool, weights: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """query_id, rank, <key>, score (of type `kind`): the best k rows for each row whose key is divisible by `every`."""
    rows = unique(vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x")), zero)
    return ranked(pairs(rows, rows.where(F.col("id") % every == 0), k, tile, kind, zero, weights), k, key)


def ranked(pairs: DataFrame, k: int, key: str) -> DataFrame:
    """The best k of pairs (query_id, id, score), which may repeat."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = pairs.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def pairs(rows: DataFrame, asked: DataFrame, k: int, tile: Callable[[], Callable], kind: str, zero: bool, weights: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, id, score): the best k of each tile for each query; rows and asked are (id, x), with unique ids.

    tile() is called once for each task and gives a function (query ids, query matrix, ids, matrix, k) -> (index of the
    query, id, score) arrays with up to k different ids for each query, never the query's own. `weights` is applied to the
    vectors as they are packed: small integers make small blocks.
    """
    n, n_asked = rows.count(), asked.count()
    groups, parts = max(SPREAD, -(-n // BLOCK)), max(1, -(-n_asked // QUERIES))
    # Candidates are shuffled once; queries, the smaller side, once for each place. Tiles are dealt by number, since
    # their work isn't told by their bytes; twice as many tasks as places, so that few of them get two.
    found = pack(rows, groups, BLOCK, zero, weights).repartition(2 * groups, "place", "dim")
    packed = pack(asked.repartition(parts), parts, QUERIES, zero, weights).select("dim", F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    asked = packed.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(2 * groups, "place", "dim")
    tiles = found.hint("merge").join(asked, ["place", "dim"]).select("dim", "kind", "ids", "vectors", "q_kind", "q_ids", "q_vectors")
    out_type = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = tile()
        for b in batches:
            for dim, kind_x, ids, x, kind_q, q_ids, q in zip(*(b.column(i) for i in range(7)), strict=True):
                ids, q_ids = (np.frombuffer(v.as_buffer(), np.int64) for v in (ids, q_ids))
                x, q = (np.frombuffer(v.as_buffer(), k.as_py()).reshape(-1, dim.as_py()) for v, k in ((x, kind_x), (q, kind_q)))
                who, other, score = best(q_ids, q, ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[who]), pa.array(other), pa.array(score, out_type)], names=["query_id", "id", "score"])

    return tiles.mapInArrow(run, f"query_id long, id long, score {kind}")


def select(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, in no order, by partition selection."""
    if len(score) <= k:
        return np.arange(len(score))
    bar = np.partition(score, len(score) - k)[len(score) - k]
    above, level = np.flatnonzero(score > bar), np.flatnonzero(score == bar)
    if len(above) + len(level) > k:
        level = level[np.argsort(ids[level], kind="stable")[: k - len(above)]]
    return np.r_[above, level]
