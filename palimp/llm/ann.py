"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors fall into bands of norms, half an octave each, and are brought to their band's largest norm by an extra
component; scaled to 1, the nearest of a band by distance is then its largest by inner product, and one long vector does
not crowd the others. Each of `tables` tables hashes them by `hashes` values floor((a.x + b) / width), a Gaussian.

A query visits in each table and band its own bucket and those reached by perturbations, in order of estimated success:
the expected squared distances of a query's i-th nearest bucket border give one order of perturbation sets for all
queries. How far it goes in a band is fitted: the true neighbours of a bounded sample of queries are found by a scan, and
the probes are those that reach the part `success` of the neighbours which lie in the band.

Buckets are dealt out by table, band and groups of buckets, and so are the queries' probes; a group's task looks the
probes up among its buckets, scores the rows found there exactly and gives each query's best k. So a row is scored only
where a probe meets its bucket, and a query goes to as many groups as it has probes at most. Groups with more rows than
fit, as with a bucket that holds a third of all rows, are split by salts, each of which the query meets.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimp.llm import tiles
from palimp.llm.durable import durable, joined
from palimp.llm.grouped import groups as groups_of

TABLES, WIDTH, SEED = 6, 2.5, 11
#: Part of the sample's true neighbours that the probes reach; queries in the sample, and of each norm band besides.
SUCCESS, SAMPLE, OF_BAND = 0.96, 128, 12
#: Probes of a table at most; on isotropic vectors of 256 components some thousand are used.
MOST_PROBES = 20_000
#: Bytes of the vectors of a group of buckets, about.
GROUP_BYTES = 8 << 20


def hashes_for(rows: int) -> int:
    """Hash values of a table: they grow with the logarithm of the rows, so that buckets don't."""
    return max(8, round(0.75 * math.log2(max(rows, 2))))


def expected(hashes: int) -> list[float]:
    """The expected squared distance of a query's i-th nearest of 2 * hashes bucket borders, in squared widths."""
    m = hashes
    return [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]


def sequence(hashes: int, probes: int, farthest: float = math.inf) -> list[tuple[int, ...]]:
    """The first `probes` perturbation sets up to an expected distance, as ranks 0 to 2 * hashes - 1 of the bucket borders; the first is empty."""
    m, cost_of = hashes, expected(hashes)
    out: list[tuple[int, ...]] = [()]
    heap = [(cost_of[0], (0,))]
    while heap and len(out) < probes:
        cost, s = heapq.heappop(heap)
        if cost > farthest + 1e-12:
            break
        if not any(2 * m - 1 - i in s for i in s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost - cost_of[last] + cost_of[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (cost + cost_of[last + 1], (*s, last + 1)))
    return out


def norms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mantissa, exponent) of the rows' norms, by their largest components: no square is lost or overflows."""
    exponent = np.frexp(np.abs(x).max(1))[1]
    return np.sqrt((np.ldexp(x, -exponent[:, None]) ** 2).sum(1)), exponent


def bands(x: np.ndarray) -> np.ndarray:
    mantissa, exponent = norms(x)
    return np.ceil(2 * np.log2(mantissa)).astype(np.int64) + 2 * exponent


@dataclass
class Family:
    """The hash functions for vectors of one length."""

    dim: int
    hashes: int
    tables: int
    width: float
    seed: int

    def __post_init__(self) -> None:
        rng = np.random.default_rng([self.seed, self.dim])
        n = self.hashes * self.tables
        self.a, self.b = rng.normal(size=(self.dim + 1, n)), rng.uniform(0, self.width, n)
        self.mark = rng.integers(1, 2**62, self.hashes, dtype=np.int64) | 1

    def project(self, wide: np.ndarray) -> np.ndarray:
        """(rows, tables, hashes), in widths."""
        return ((wide @ self.a + self.b) / self.width).reshape(len(wide), self.tables, self.hashes)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The hash values of rows, each in its band."""
        mantissa, exponent = norms(x)
        # A band's largest norm is a power of two, or half an octave below one.
        top = np.exp2(np.ceil(2 * np.log2(mantissa)) / 2)
        rest = np.sqrt(np.maximum(1 - (mantissa / top) ** 2, 0))
        return np.floor(self.project(np.c_[np.ldexp(x, -exponent[:, None]) / top[:, None], rest])).astype(np.int64)

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of queries (queries, tables): the hash values of their own buckets, and the borders (2 * hashes; below, then above) by distance."""
        mantissa, exponent = norms(q)
        f = self.project(np.c_[np.ldexp(q, -exponent[:, None]) / mantissa[:, None], np.zeros(len(q))])
        own = np.floor(f)
        return own.astype(np.int64), np.argsort(np.concatenate([f - own, own + 1 - f], axis=2), axis=2, kind="stable")

    def steps(self, borders: np.ndarray) -> np.ndarray:
        """What crossing each border adds to a bucket's key."""
        return np.r_[-self.mark, self.mark][borders]


def farness(family: Family, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each query and row of the same place the least expected distance at which a table's probes reach the row; infinite if none do."""
    own, borders = family.asked(q)
    rank = np.argsort(borders, axis=2, kind="stable")
    off = family.cells(x) - own
    cost, m = np.array(expected(family.hashes)), family.hashes
    each = np.where(off == 0, 0.0, np.where(off == -1, cost[rank[:, :, :m]], np.where(off == 1, cost[rank[:, :, m:]], np.inf)))
    return each.sum(2).min(1)


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", hashes: int | None = None, tables: int = TABLES, width: float = WIDTH, success: float = SUCCESS, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """query_id, rank, <key>, score: up to k nearest candidates of each row whose key is divisible by `every`, by inner
    product in double precision, ties to the smaller key.

    A query that finds fewer than k candidates is compared with all rows instead, so short tables give all they have.
    Null and zero vectors and those with a null or non-finite component take no part; vectors meet only those of their
    own length. Rows that share a key count once, with the vector that comes first component by component; a query never
    finds its own key. An empty table gives an empty result; other columns are not read. Bounds: at most 9 * `sample` queries with
    their k neighbours and one row for each length and norm band come to the driver.
    """
    item = vectors.schema[vector].dataType
    kind, dtype = ("array<float>", np.float32) if isinstance(item, T.ArrayType) and isinstance(item.elementType, T.FloatType) else ("array<double>", np.float64)
    rows = tiles.unique(vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(kind).alias("x")), zero=False)
    asked = rows.where(F.col("id") % every == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: defaultdict[tuple[int, int], int] = defaultdict(int)
        for b in batches:
            for dim, _, x in tiles.vectors_of(b, False):
                for band, m in zip(*np.unique(bands(x), return_counts=True), strict=True):
                    n[dim, int(band)] += int(m)
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in n], pa.int64()), pa.array([b for _, b in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["dim", "band", "n"])

    sizes = {(r["dim"], r["band"]): r["n"] for r in rows.mapInArrow(count, "dim long, band long, n long").groupBy("dim", "band").agg(F.sum("n").alias("n")).collect()}
    of_dim: defaultdict[int, int] = defaultdict(int)
    for (dim, _), n in sizes.items():
        of_dim[dim] += n
    per = {dim: max(64, GROUP_BYTES // (8 * dim)) for dim in of_dim}
    groups = {(dim, band): -(-n // per[dim]) for (dim, band), n in sizes.items()}
    made: dict[int, Family] = {}

    def family(dim: int) -> Family:
        if dim not in made:
            made[dim] = Family(dim, hashes or hashes_for(of_dim[dim]), tables, width, seed)
        return made[dim]

    def group_of(keys: np.ndarray, n: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n

    farthest = fitted(rows, asked, family, k, success, sample)
    probes = {x: sequence(family(x[0]).hashes, MOST_PROBES, farthest.get(x, 0.0)) for x in sizes}

    def index(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        """Rows of each table: where they go, and if `whole` also key, id and x."""
        for b in batches:
            for dim, ids, x in tiles.vectors_of(b, False):
                own, band = family(dim), bands(x)
                keys = own.cells(x) @ own.mark
                n = np.array([groups[dim, int(v)] for v in band], np.int64)
                raw = pa.array([v.tobytes() for v in x.astype(dtype)], pa.binary()) if whole else None
                for t in range(tables):
                    k_ = np.ascontiguousarray(keys[:, t])
                    where = [pa.array(np.full(len(ids), dim)), pa.array(band), pa.array(np.full(len(ids), t)), pa.array(group_of(k_, n))]
                    yield pa.RecordBatch.from_arrays([*where, pa.array(k_), pa.array(ids), raw] if whole else where, names=["dim", "band", "t", "g", *(["key", "id", "x"] if whole else [])])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries for each group that one of their probes names, with the numbers of these probes."""
        sets: dict = {}
        for b in batches:
            for dim, ids, q in tiles.vectors_of(b, False):
                own = family(dim)
                cell, borders = own.asked(q)
                base, step = cell @ own.mark, own.steps(borders)
                out: list[tuple] = []
                for d, band in sizes:
                    if d != dim:
                        continue
                    if (d, band) not in sets:
                        sets[d, band] = as_matrix(probes[d, band], own.hashes)
                    for i, t in np.ndindex(len(q), tables):
                        g = group_of(base[i, t] + sets[d, band] @ step[i, t], groups[d, band])
                        order = np.argsort(g, kind="stable").astype(np.uint32)
                        names, start = np.unique(g[order], return_index=True)
                        raw = q[i].astype(dtype).tobytes()
                        out += [(dim, band, t, int(name), int(ids[i]), raw, part.tobytes()) for name, part in zip(names, np.split(order, start[1:]), strict=True)]
                        if len(out) > 2000:
                            yield pa.RecordBatch.from_pylist([dict(zip(routed, r, strict=True)) for r in out], schema=routed_as)
                            out = []
                yield pa.RecordBatch.from_pylist([dict(zip(routed, r, strict=True)) for r in out], schema=routed_as)

    routed = ["dim", "band", "t", "g", "id", "x", "probes"]
    routed_as = pa.schema([pa.field(n, pa.int64()) for n in routed[:5]] + [pa.field(n, pa.binary()) for n in routed[5:]])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, id, score): the best k of each group for each of its queries; a group's rows come before its queries."""
        sets: dict = {}
        for table, starts, ends in groups_of(batches, ("dim", "band", "t", "g", "salt")):
            dims, band, t, keys, ids, asks = (table.column(c).to_numpy() for c in ("dim", "band", "t", "key", "id", "asks"))
            raw, numbers = table.column("x"), table.column("probes")
            who, other, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            for s, e in zip(starts, ends, strict=True):
                at = s + int(np.searchsorted(asks[s:e], 1))
                if at == s or at == e:
                    continue
                dim, place = int(dims[s]), (int(dims[s]), int(band[s]))
                own = family(dim)
                if place not in sets:
                    sets[place] = as_matrix(probes[place], own.hashes)
                x, q = (np.frombuffer(b"".join(raw.slice(lo, hi - lo).to_pylist()), dtype).reshape(-1, dim) for lo, hi in ((s, at), (at, e)))
                buckets, first = np.unique(keys[s:at], return_index=True)
                last = np.r_[first[1:], at - s]
                cell, borders = own.asked(q.astype(np.float64))
                base, step = cell[:, int(t[s])] @ own.mark, own.steps(borders[:, int(t[s])])
                mine = ids[s:at]
                for i, named in enumerate(numbers.slice(at, e - at).to_pylist()):
                    want = base[i] + sets[place][np.frombuffer(named, np.uint32)] @ step[i]
                    hit = np.minimum(np.searchsorted(buckets, want), len(buckets) - 1)
                    hit = hit[buckets[hit] == want]
                    n = (last - first)[hit]
                    rows = np.repeat(first[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    rows = rows[mine[rows] != ids[at + i]]
                    if len(rows) > k:
                        about = x[rows] @ q[i]
                        slack = 8 * dim * np.finfo(dtype).eps * 2.0 ** (place[1] / 2) * np.ldexp(*(v[0] for v in norms(q[i : i + 1].astype(np.float64))))
                        rows = rows[about >= np.partition(about, len(rows) - k)[len(rows) - k] - slack]
                    exact = (x[rows].astype(np.float64) * q[i].astype(np.float64)).sum(1)
                    top = tiles.select(exact, mine[rows], k)
                    who.append(np.full(len(top), ids[at + i]))
                    other.append(mine[rows[top]])
                    score.append(exact[top])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.array(np.concatenate(other)), pa.array(np.concatenate(score))], names=["query_id", "id", "score"])

    here = ["dim", "band", "t", "g"]
    where = ", ".join(f"{c} long" for c in here)
    room = F.greatest(F.lit(64), F.floor(F.lit(GROUP_BYTES) / (8 * F.col("dim"))))
    full = durable(rows.mapInArrow(lambda b: index(b, False), where).groupBy(*here).agg(F.count("*").alias("n")).where(F.col("n") > 2 * room).select(*here, F.ceil(F.col("n") / room).cast("int").alias("salts")))
    data = joined(rows.mapInArrow(lambda b: index(b, True), f"{where}, key long, id long, x binary"), full, here, "left")
    data = data.select(*here, F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(0).alias("asks"), "key", "id", "x", F.lit(None).cast("binary").alias("probes"))
    queries = joined(asked.mapInArrow(route, f"{where}, id long, x binary, probes binary"), full, here, "left")
    queries = queries.select(*here, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("key"), "id", "x", "probes")
    parts = max(8, 2 * tables * sum(groups.values()) // 3)
    dealt = data.unionByName(queries).repartition(parts, *here, "salt").sortWithinPartitions(*here, "salt", "asks", "key")
    found = durable(dealt.mapInArrow(visit, "query_id long, id long, score double"))
    best = tiles.ranked(found, k, key)
    # Too few candidates: the table is short, or a query lies far from all.
    enough = best.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= k).select("id")
    short = durable(asked.select("id").join(enough, "id", "left_anti"))
    if short.isEmpty():
        return best
    rest = tiles.pairs(rows, joined(rows, short, "id", "left_semi"), k, scanned, "double", False)
    return tiles.ranked(found.unionByName(rest), k, key)


def as_matrix(sets: list[tuple[int, ...]], hashes: int) -> np.ndarray:
    """(sets, borders): 1 where a set crosses a border."""
    out = np.zeros((len(sets), 2 * hashes), np.int64)
    for i, s in enumerate(sets):
        out[i, list(s)] = 1
    return out


def scanned():
    """The best k of all rows of a block, for tiles.pairs()."""

    def best(q_ids, q, ids, x, k):
        who, other, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for i, own in enumerate(q_ids):
            rows = np.flatnonzero(ids != own)
            s = (x[rows] * q[i]).sum(1)
            top = tiles.select(s, ids[rows], k)
            who.append(np.full(len(top), i))
            other.append(ids[rows[top]])
            score.append(s[top])
        return np.concatenate(who), np.concatenate(other), np.concatenate(score)

    return best


def fitted(rows: DataFrame, asked: DataFrame, family, k: int, success: float, sample: int) -> dict[tuple[int, int], float]:
    """For each length and norm band that holds neighbours of the sample, the expected distance up to which probes go."""
    dtype = dict(asked.dtypes)["x"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their length and norm band."""
        for b in batches:
            for dim, ids, x in tiles.vectors_of(b, False):
                kind = pa.list_(pa.float32() if dtype == "array<float>" else pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x.tolist(), kind), pa.array(np.full(len(ids), dim)), pa.array(bands(x))], names=["id", "x", "dim", "band"])

    order = W.partitionBy("dim", "band").orderBy(F.xxhash64("id"), "id")
    strata = asked.mapInArrow(placed, f"id long, x {dtype}, dim long, band long").withColumn("n", F.row_number().over(order)).where(F.col("n") <= OF_BAND)
    # Some of each band, so that what only short queries are near to is seen as well; bands are few, or hold few rows.
    drawn = asked.orderBy(F.xxhash64("id"), "id").limit(sample).unionByName(strata.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(8 * sample)).dropDuplicates(["id"]).orderBy("id").coalesce(1)
    known: defaultdict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    for b in drawn.toArrow().to_batches():
        for dim, ids, q in tiles.vectors_of(b, False):
            known[dim][0].extend(ids.tolist())
            known[dim][1].extend(q)
    queries = {dim: (np.array(ids), np.stack(q)) for dim, (ids, q) in known.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, ids, x in tiles.vectors_of(b, False):
                if dim not in queries:
                    continue
                q_ids, q = queries[dim]
                s = q @ x.T
                s[q_ids[:, None] == ids[None]] = -np.inf
                m = min(k, len(ids))
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                who, at = np.repeat(np.arange(len(q)), m), top.ravel()
                some = np.isfinite(s[who, at])
                who, at = who[some], at[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), dim)), pa.array(who), pa.array(s[who, at]), pa.array([v.tobytes() for v in x[at]], pa.binary())], names=["dim", "q", "score", "x"])

    order = W.partitionBy("dim", "q").orderBy(F.desc("score"), "x")
    best = rows.mapInArrow(scan, "dim long, q long, score double, x binary").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found: defaultdict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    for r in best.select("dim", "q", "x").collect():
        found[r["dim"]][0].append(r["q"])
        found[r["dim"]][1].append(np.frombuffer(r["x"]))
    out = {}
    for dim, (who, x) in found.items():
        x = np.stack(x)
        far, band = farness(family(dim), queries[dim][1][who], x), bands(x)
        for b in np.unique(band).tolist():
            own = np.sort(far[band == b])
            own = own[np.isfinite(own)] if np.isfinite(own).any() else np.zeros(1)
            out[dim, b] = float(own[min(len(own) - 1, int(success * (band == b).sum()))])
    return out
