"""N-gram Jaccard join: exact links between documents whose sets of word n-grams have a Jaccard similarity of at least a/b.

Tiles. Sizes fall into bands; two sets that link lie in one band or in two adjoining ones, and a set near its band's
upper end stands in the next band as well. Sets of a band that link differ in at most D elements. A band's elements are
dealt into D + 1 + S segments by hash, so two sets that link have more than S segments in common. A tile is the sets of
a band that share a segment's content: no link is lost, and a frequent n-gram alone makes no tile. S is twice as many
segments as are expected to stay empty, and empty segments make tiles only for sets with more than S of them (two sets
that link and share no other segment both have so many).

Within a tile a hashed bitmap of each set bounds the overlap from above by bit counts: elements whose bits the other set
lacks are not shared. Pairs whose bound reaches the overlap that a link needs are compared exactly, as sorted arrays.

Large groups. Equal sets are one. A first round takes of each tile a spanning forest of its likely pairs, fewer pairs
than sets, and compares those exactly; the sets found linked become components. A second round does the rest: only tiles
with further likely pairs that still hold several components take part, their sets that are likely partners across components meet again with
their sorted arrays, are compared exactly there, and again only a spanning forest of the links leaves the tile. So no
step hands out more rows than it takes in, however large a group of copies is. Tiles of more than BLOCK sets are split:
in the first round into the first block with each other one, in the second into pairs of blocks, without pairs inside
the tile's largest component. Nothing is capped or sampled.

Links. What links lies in one component, so the components' sets are then compared exactly, all with all, by pairs of
blocks: each gives its sets' numbers of linked rows, so the pairs themselves are never rows.

Elements are identified by 64-bit hashes of their words, sets by 64-bit hashes of their elements; different sets of equal
hash are told apart by a second hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm import textvec as tv
from palimp.llm.components import components
from palimp.llm.durable import durable, few_at_once, joined
from palimp.llm.grouped import groups as groups_of

BLOCK, GROWTH = 256, 1.5
#: Salt of the second hash of a set.
SECOND = 0x2545F491
#: Bytes of the sets of a block of a component, about; and elements that are counted at once.
BLOCK_BYTES, COLUMNS = 4 << 20, 4096
#: Sets up to which a group of the second round hands out its likely pairs one by one.
FEW = 32
#: Rows of tiles for each task, about.
ROWS = 20_000
#: Ids (of tiles with more than two sets, of documents whose sets are compared exactly) are broadcast up to so many.
MOST_IDS = 1_000_000
U = np.uint64
_edges = [1]
while _edges[-1] < 1 << 40:
    _edges.append(int(_edges[-1] * GROWTH) + 1)
BANDS = np.array(_edges)


def segments_of(band: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments of a band and S: its sets link (overlap * b >= union * a) only if they differ in at most 2 * high * (b - a) / (b + a) elements."""
    low, high = BANDS[band] * a / b, BANDS[band + 1] - 1
    some = 2 * high * (b - a) // (b + a) + 1
    spare = 2 + np.ceil(2 * some * np.exp(-low / (some * 1.2))).astype(np.int64)
    return some + spare, spare


def keys_of(x: np.ndarray, offs: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Tile keys of all sets (x between offs, ascending) and the set of each key."""
    n = np.diff(offs)
    of = np.repeat(np.arange(len(n)), n)
    own = np.searchsorted(BANDS, n, "right") - 1
    keys, sets = [], []
    for up in (0, 1):
        band = own + up
        member = n > 0 if not up else (n > 0) & (b * n >= a * BANDS[np.maximum(band, 0)])
        m, spare = segments_of(np.maximum(band, 0), a, b)
        m = np.where(member, m, 0)
        first = np.r_[0, np.cumsum(m)]
        inside = member[of]
        e, d = x[inside], of[inside]
        segment = first[d] + ((e >> U(20)) % m[d].astype(U)).astype(np.int64)
        total = np.zeros(first[-1], U)
        np.add.at(total, segment, tv.mix(e ^ U(0x5BF03635)))
        held = np.bincount(segment, minlength=first[-1])
        whose = np.repeat(np.arange(len(n)), m)
        index = np.arange(first[-1]) - first[whose]
        bare = np.bincount(whose[held == 0], minlength=len(n))
        use = (held > 0) | (bare[whose] > spare[whose])
        place = tv.mix(index.astype(U) * tv.P + band[whose].astype(U) * U(0xD1B54A32D192ED03))
        keys.append(tv.mix(total + place + held.astype(U))[use])
        sets.append(whose[use])
    return np.concatenate(keys), np.concatenate(sets)


def bitmap(x: np.ndarray) -> bytes:
    """Bits at the elements' hashes, about twice as many as elements (a power of 2 from 256 to 65,536)."""
    size = 1 << min(max(int(2 * len(x) - 1).bit_length(), 8), 16)
    bits = np.zeros(size, bool)
    bits[(x & U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def stacked(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, larger ones folded to the smallest's size."""
    least = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, U).reshape(-1, least // 8), axis=0) for m in maps])


def sets_of(col: pa.Array, n: int, powers: tv.Powers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts as (elements, offsets)."""
    for _, buf, offs in tv.slices(col):
        starts, ends, first = tv.spans(buf, offs)
        x, of = tv.shingles(tv.hashes(buf, starts, ends, powers, tv.LOWER), first, n)
        yield tv.distinct(x, of, len(offs) - 1)


def names_of(x: np.ndarray, offs: np.ndarray, salt: int = 0x1234567F) -> np.ndarray:
    """A 64-bit name of each set; of an empty one, 0."""
    n = np.diff(offs)
    total = np.zeros(len(n), U)
    some = n > 0
    if some.any():
        total[some] = np.add.reduceat(tv.mix(x ^ U(salt)), offs[:-1][some])
        total[some] = tv.mix(total[some] + n[some].astype(U) * tv.P)
    return total.view(np.int64)


def likely(size: np.ndarray, bits: np.ndarray, rows: np.ndarray, a: int, b: int) -> np.ndarray:
    """(rows, all): whether the bit counts allow the overlap that a link needs."""
    count = np.bitwise_count(bits).sum(1).astype(np.int64)
    both = np.empty((len(rows), len(size)), np.int64)
    for lo in range(0, len(rows), 16):
        both[lo : lo + 16] = np.bitwise_count(bits[rows[lo : lo + 16], None, :] & bits[None]).sum(-1, dtype=np.int64)
    one, other = size[rows][:, None], size[None]
    bound = np.minimum(one - count[rows][:, None] + both, other - count[None] + both)
    return bound * (a + b) >= a * (one + other)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric relation without its diagonal, from its first rows on: fewer pairs than rows."""
    out, left = [], near.any(1)
    while left.any():
        reached = [int(left.argmax())]
        left[reached] = False
        for at in reached:
            new = np.flatnonzero(near[at] & left).tolist()
            left[new] = False
            out += [(at, k) for k in new]
            reached += new
    return out


def two_near(size: np.ndarray, bits: list[bytes], a: int, b: int) -> bool:
    """likely() of a tile of two, by whole numbers."""
    least = min(len(bits[0]), len(bits[1]))
    one, other = (int.from_bytes(m if len(m) == least else stacked([m, bytes(least)])[0].tobytes(), "little") for m in bits)
    both, n, m = (one & other).bit_count(), int(size[0]), int(size[1])
    return min(n - one.bit_count() + both, m - other.bit_count() + both) * (a + b) >= a * (n + m)


def apart(block: np.ndarray, part: np.ndarray, across: bool) -> np.ndarray:
    """(sets, sets): the pairs of different components that a group has to compare; `across`: only those of different blocks."""
    out = part[:, None] != part[None]
    return out & (block[:, None] != block[None]) if across else out


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right): how many elements the sets at these places share."""
    x, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(x, kind="stable")
    x, of = x[order], of[order]
    col = np.cumsum(np.r_[False, x[1:] != x[:-1]])
    shared = (np.bincount(col) > 1)[col]
    of, col = of[shared], col[shared]
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(col):
        return out
    col = np.cumsum(np.r_[False, col[1:] != col[:-1]])
    for lo in range(0, int(col[-1]) + 1, COLUMNS):
        p, q = np.searchsorted(col, (lo, lo + COLUMNS))
        some = np.zeros((len(sets), min(COLUMNS, int(col[-1]) + 1 - lo)), np.float32)
        some[of[p:q], col[p:q] - lo] = 1
        out += (some[left] @ some[right].T).astype(np.int64)
    return out


def linked(batches: Iterator[pa.RecordBatch], a: int, b: int) -> Iterator[pa.RecordBatch]:
    """(h, links): rows of other sets that link with h, for each pair of blocks; rows (component, i, j, h, block, rows, x) stand in order of component, i, j."""
    for table, starts, ends in groups_of(batches, ("component", "i", "j")):
        i, j, h, block, rows = (table.column(c).to_numpy() for c in ("i", "j", "h", "block", "rows"))
        x = [np.frombuffer(v, U) for v in table.column("x").to_pylist()]
        found, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, e in zip(starts, ends, strict=True):
            own, size, alone = np.arange(s, e), np.array([len(v) for v in x[s:e]]), i[s] == j[s]
            left, right = np.flatnonzero(block[own] == i[s]), np.flatnonzero(block[own] == j[s])
            if not len(left) or not len(right) or e - s < 2:
                continue
            both = overlaps(x[s:e], left, right)
            link = both * b >= (size[left][:, None] + size[right][None] - both) * a
            if alone:
                np.fill_diagonal(link, False)
            found.append(h[own[left]])
            n.append(link @ rows[own[right]])
            if not alone:
                found.append(h[own[right]])
                n.append(link.T @ rows[own[left]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(n))], names=["h", "links"])


def first_round(batches: Iterator[pa.RecordBatch], a: int, b: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that span the likely ones of each group, and rows (a, tile) for the sets of groups with further likely pairs; rows (tile, j, h, n, bits) stand in order of tile, j, h."""
    for table, starts, ends in groups_of(batches, ("tile", "j")):
        tile, h, size = (table.column(c).to_numpy() for c in ("tile", "h", "n"))
        bits = table.column("bits").to_pylist()
        low, high, left = [], [], []
        for s, e in zip(starts, ends, strict=True):
            pairs = []
            if e - s == 2:
                pairs = [(0, 1)] if two_near(size[s:e], bits[s:e], a, b) else []
            elif e - s > 2:
                near = likely(size[s:e], stacked(bits[s:e]), np.arange(e - s), a, b)
                np.fill_diagonal(near, False)
                pairs = forest(near)
                if near.sum() > 2 * len(pairs):
                    left.append(np.flatnonzero(near.any(1)) + s)
            low += [h[s + x] for x, _ in pairs]
            high += [h[s + y] for _, y in pairs]
        found = _pairs(low, high)
        yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(len(found), pa.int64())], names=["a", "b", "tile"])
        if left:
            rows = np.concatenate(left)
            yield pa.RecordBatch.from_arrays([pa.array(h[rows]), pa.nulls(len(rows), pa.int64()), pa.array(tile[rows])], names=["a", "b", "tile"])


def second_round(batches: Iterator[pa.RecordBatch], a: int, b: int) -> Iterator[pa.RecordBatch]:
    """What groups leave to compare across components; rows (tile, i, j, h, n, bits, block, component) stand in order of tile, i, j, h.

    A group of at most FEW sets gives its likely pairs, as h and other; a larger one gives its sets that have a likely
    partner, without `other`, so that neither gives more than FEW / 2 rows for each of its sets.
    """
    seen: set[tuple[int, int]] = set()
    for table, starts, ends in groups_of(batches, ("tile", "i", "j")):
        i, j, h, size, block, part = (table.column(c).to_numpy() for c in ("i", "j", "h", "n", "block", "component"))
        bits = table.column("bits").to_pylist()
        at, other, whole = [], [], []
        for s, e in zip(starts, ends, strict=True):
            if (part[s:e] == part[s]).all():
                continue
            near = likely(size[s:e], stacked(bits[s:e]), np.arange(e - s), a, b)
            near &= apart(block[s:e], part[s:e], bool(i[s] != j[s]))
            left, right = np.nonzero(np.triu(near))
            if e - s <= FEW:
                # Pairs come in several tiles of a task; the first is enough.
                for x, y in zip((left + s).tolist(), h[right + s].tolist(), strict=True):
                    pair = (int(h[x]), y)
                    if pair not in seen:
                        seen.add(pair)
                        at.append(x)
                        other.append(y)
            else:
                whole.append(np.flatnonzero(near.any(1)) + s)
        rows = np.concatenate([np.array(at, np.int64), *whole]).astype(np.int64)
        out = table.select(["tile", "i", "j", "h", "block", "component"]).take(pa.array(rows))
        yield from out.append_column("other", pa.concat_arrays([pa.array(other, pa.int64()), pa.nulls(len(rows) - len(at), pa.int64())])).combine_chunks().to_batches()


def joining(batches: Iterator[pa.RecordBatch], a: int, b: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that span the links across components in each group, found exactly; rows (tile, i, j, h, block, component, x) stand in order of tile, i, j, h."""
    for table, starts, ends in groups_of(batches, ("tile", "i", "j")):
        i, j, h, block, part = (table.column(c).to_numpy() for c in ("i", "j", "h", "block", "component"))
        column = table.column("x")
        low, high = [], []
        for s, e in zip(starts, ends, strict=True):
            if e - s < 2:
                continue
            x = [np.frombuffer(v, U) for v in column.slice(s, e - s).to_pylist()]
            size, all_ = np.array([len(v) for v in x]), np.arange(e - s)
            both = overlaps(x, all_, all_)
            link = both * b >= (size[:, None] + size[None] - both) * a
            for p, q in forest(link & apart(block[s:e], part[s:e], bool(i[s] != j[s]))):
                low.append(h[s + p])
                high.append(h[s + q])
        yield _pairs(low, high)


def _pairs(left: list, right: list) -> pa.RecordBatch:
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["a", "b"])


def unseen(size: np.ndarray, name: np.ndarray, second: np.ndarray, seen: set) -> list[bool]:
    """Whether each set is neither empty nor in `seen`, to which it is added."""
    out = []
    for n, h in zip(size.tolist(), zip(name.tolist(), second.tolist(), strict=True), strict=True):
        out.append(n > 0 and h not in seen)
        if n:
            seen.add(h)
    return out


def join(docs: DataFrame, *, text: str = "text", key: str = "doc_id", n: int = 3, similarity: tuple[int, int] = (90, 100), counted: bool = True) -> DataFrame:
    """key, n_shingles, component_id and, if `counted`, links for each row of `docs`.

    A document's set holds its runs of n words (A-Z lower-cased, words are runs of other bytes than x20 and x09-x0D); with
    fewer words, the whole sequence. Two documents link if similarity[1] * overlap >= similarity[0] * union. component_id
    is the smallest key reachable by links, links the number of other rows that the row links with, equal texts among
    them. Null, empty and wordless texts have no n-grams and link with nothing, so their component is their own key.
    Repeated rows link like copies. Only key and text are read; an empty table gives an empty result.
    """
    a, b = similarity

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's set: its size and names, and its bitmap where the task meets it first."""
        powers, seen = tv.Powers(), set()
        for batch in batches:
            at = 0
            for x, offs in sets_of(batch.column(1), n, powers):
                size, name, second = np.diff(offs), names_of(x, offs), names_of(x, offs, SECOND)
                maps = [bitmap(x[offs[d] : offs[d + 1]]) if fresh else None for d, fresh in enumerate(unseen(size, name, second, seen))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(size)), pa.array(size, pa.int64()), pa.array(name), pa.array(second), pa.array(maps, pa.binary())], names=["id", "n", "h", "g", "bits"])
                at += len(size)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tile keys of each set where the task meets it first; equal sets stand for each other in the tiles."""
        powers, seen = tv.Powers(), set()
        for batch in batches:
            for x, offs in sets_of(batch.column(0), n, powers):
                size, name, second = np.diff(offs), names_of(x, offs), names_of(x, offs, SECOND)
                keys, whose = keys_of(x, offs, a, b)
                own = np.array(unseen(size, name, second, seen), bool)[whose]
                keys, whose = keys[own], whose[own]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(name[whose]), pa.array(second[whose])], names=["tile", "h", "g"])

    rows = few_at_once(docs).select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sets = durable(rows.mapInArrow(describe, f"id {kind}, n long, h long, g long, bits binary"))

    def classes_of(sets: DataFrame) -> DataFrame:
        return durable(sets.where("n > 0").groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.min("g").alias("lo"), F.max("g").alias("hi")))

    classes = classes_of(sets)
    doubtful = classes.where("lo <> hi").select("h", F.lit(True).alias("doubtful"))
    sure = doubtful.isEmpty()

    def told(df: DataFrame) -> DataFrame:
        """df, in which sets of different second hashes have different names."""
        return df if sure else joined(df, doubtful, "h", "left").withColumn("h", F.when(F.col("doubtful"), F.col("g")).otherwise(F.col("h"))).drop("doubtful")

    if not sure:
        sets = durable(told(sets))
        classes = classes_of(sets)
    info = durable(sets.where(F.col("bits").isNotNull()).select("h", "n", "bits").dropDuplicates(["h"]))

    # Most tiles hold one set, and most others two, which their least and greatest names tell; only larger ones are joined back.
    # The keys are made from the texts each time: kept, they would take as much disk as the texts.
    dealt = told(rows.select("text").mapInArrow(deal, "tile long, h long, g long")).select("tile", "h")
    shared = durable(dealt.groupBy("tile").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("rows")).where("lo <> hi"))
    twos = shared.where("rows = 2").select(F.xxhash64(F.lit(2).cast("long"), F.col("lo").bitwiseXOR(F.col("hi")), F.xxhash64("lo").bitwiseXOR(F.xxhash64("hi"))).alias("tile"), F.lit(2).cast("long").alias("size"), F.explode(F.array("lo", "hi")).alias("h"))
    large = durable(joined(dealt, shared.where("rows > 2").select("tile"), "tile", most_rows=MOST_IDS).distinct())
    # Tiles with the same sets are one.
    marks = large.groupBy("tile").agg(F.count("*").alias("size"), F.bit_xor(F.col("h")).alias("x"), F.bit_xor(F.xxhash64("h")).alias("y"))
    larger = joined(large, marks, "tile").select(F.xxhash64("size", "x", "y").alias("tile"), "size", "h")
    members = durable(twos.unionByName(larger).distinct())

    parts = max(8, -(-members.count() // ROWS))
    spread = lambda n: F.pmod(F.xxhash64("h"), n).cast("int")

    def likely_pairs() -> DataFrame:
        """What first_round() gives: each block of a tile meets the tile's first one."""
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        to = F.when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.lit(0), blocks - 1))
        groups = members.withColumn("block", spread(blocks)).select("tile", F.explode(to).alias("j"), "h").join(info, "h")
        return groups.repartition(parts, "tile", "j").sortWithinPartitions("tile", "j", "h").mapInArrow(lambda rows: first_round(rows, a, b), "a long, b long, tile long").distinct()

    def open_sets(labels: DataFrame) -> DataFrame:
        """What second_round() leaves of the groups that the first one has not done with, and of all that were split."""
        split = members.where(F.col("size") > BLOCK).select("tile", "h")
        left = round_one.where("tile is not null and b is null").select("tile", F.col("a").alias("h")).unionByName(split).distinct()
        own = joined(left, labels.withColumnRenamed("v", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
        own = durable(own.join(info.select("h", "n"), "h"))
        parts_of = own.groupBy("tile", "component").agg(F.count("*").alias("m"), F.max("n").alias("n"))
        tiles = parts_of.groupBy("tile").agg(F.max(F.struct("m", "component")).alias("most"), F.sum("m").alias("all"), F.max("n").alias("longest"), F.count("*").alias("kinds")).where("kinds > 1")
        tiles = durable(tiles.select("tile", F.col("most.component").alias("main"), F.col("most.m").alias("inside"), (F.col("all") - F.col("most.m")).alias("outside"), "longest"))
        each = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_BYTES / 8 / F.col("longest")))).cast("long")
        one = F.col("inside") + F.col("outside") <= each
        out, inner, main = F.ceil(F.col("outside") / each).cast("int"), F.ceil(F.col("inside") / each).cast("int"), F.col("component") == F.col("main")
        block = F.when(one, 0).when(main, out + spread(inner)).otherwise(spread(out))
        last = F.when(one, 0).when(main, out - 1).otherwise(out + inner - 1)
        to = F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j"))))
        groups = joined(own, tiles, "tile").withColumn("block", block).withColumn("last", last).withColumn("to", to)
        groups = groups.select("tile", "to.i", "to.j", "h", "block", "component").join(info, "h")
        return groups.repartition(parts, "tile", "i", "j").sortWithinPartitions("tile", "i", "j", "h").mapInArrow(lambda rows: second_round(rows, a, b), "tile long, i int, j int, h long, block int, component long, other long")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = tv.Powers()
        for batch in batches:
            for x, offs in sets_of(batch.column(0), n, powers):
                cut = [x[p:q].tobytes() for p, q in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names_of(x, offs)), pa.array(names_of(x, offs, SECOND)), pa.array(cut, pa.binary())], names=["h", "g", "x"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                overlap = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(overlap * b >= (len(p) + len(q) - overlap) * a)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def read(wanted: DataFrame) -> DataFrame:
        """(h, x): the sorted arrays of the sets `wanted`, from their texts."""
        ids = durable(wanted.join(classes, "h").select("id").distinct())
        few = ids.count() <= MOST_IDS
        texts = rows.join(F.broadcast(ids) if few else ids, rows["id"].eqNullSafe(ids["id"]), "left_semi").select("text")
        found = told(texts.mapInArrow(arrays, "h long, g long, x binary")).select("h", "x")
        return durable(found.join(wanted, "h", "left_semi").dropDuplicates(["h"]))

    round_one = durable(likely_pairs())
    first = round_one.where("b is not null").select("a", "b")
    known = read(first.select(F.col("a").alias("h")).union(first.select(F.col("b").alias("h"))).distinct())

    def links(pairs: DataFrame) -> DataFrame:
        x = pairs.join(known.select(F.col("h").alias("a"), F.col("x").alias("p")), "a").join(known.select(F.col("h").alias("b"), F.col("x").alias("q")), "b")
        return durable(x.select("a", "b", "p", "q").mapInArrow(exact, "a long, b long"))

    def degrees(several: DataFrame) -> DataFrame:
        """(h, links): rows of other sets that link with h, by all pairs of blocks of each component."""
        sets = several.join(known, "h").join(classes.select("h", "rows"), "h")
        length = F.length("x").cast("long")
        blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(length) / BLOCK_BYTES)).cast("int")
        sizes = durable(sets.groupBy("component").agg(blocks.alias("blocks"), F.count("*").alias("n"), F.sum(length).alias("bytes")))
        dealt = sizes.agg(F.sum(F.col("n") * F.col("blocks")).alias("n"), F.sum(F.col("bytes") * F.col("blocks")).alias("bytes")).first()
        split = joined(sets, sizes.select("component", "blocks"), "component").withColumn("block", F.pmod(F.xxhash64("h"), "blocks").cast("int"))
        to = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j"))))
        tiles = split.withColumn("to", to).select("component", "to.i", "to.j", "h", "block", "rows", "x")
        many = max(8, -(-(dealt["n"] or 0) // ROWS), -(-(dealt["bytes"] or 0) // (2 * BLOCK_BYTES)))
        tiles = tiles.repartition(many, "component", "i", "j").sortWithinPartitions("component", "i", "j")
        return tiles.mapInArrow(lambda rows: linked(rows, a, b), "h long, links long").groupBy("h").agg(F.sum("links").alias("links"))

    found = links(first)
    still = durable(open_sets(components(found)))
    pairs = still.where("other is not null").select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    pairs, groups = durable(pairs), still.where("other is null").drop("other")
    unread = durable(groups.select("h").union(pairs.select("a")).union(pairs.select("b")).distinct().join(known, "h", "left_anti"))
    if not unread.isEmpty():
        known = durable(known.unionByName(read(unread)))
    groups = groups.join(known, "h").repartition(parts, "tile", "i", "j").sortWithinPartitions("tile", "i", "j", "h")
    joins = groups.select("tile", "i", "j", "h", "block", "component", "x").mapInArrow(lambda rows: joining(rows, a, b), "a long, b long").distinct()
    found = durable(found.unionByName(links(pairs)).unionByName(joins))
    label = components(found)
    several = label.withColumnRenamed("v", "h")
    own = classes.select("h", "id", "rows").join(several, "h", "left").withColumn("component", F.coalesce("component", "h"))
    least = durable(own.groupBy("component").agg(F.min("id").alias("component_id")))
    named = joined(own, least, "component").join(several.select("h", F.lit(True).alias("some")), "h", "left").where("rows > 1 or some").select("h", "component_id", "rows")
    if counted:
        named = named.join(degrees(several), "h", "left").withColumn("links", F.col("rows") - 1 + F.coalesce("links", F.lit(0)))
    named = durable(named.drop("rows"))
    named = F.broadcast(named) if named.count() <= 200_000 else named
    out = sets.select("id", "n", F.when(F.col("n") > 0, F.col("h")).alias("h")).join(named, "h", "left")
    more = [F.coalesce("links", F.lit(0)).cast("long").alias("links")] if counted else []
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *more)
