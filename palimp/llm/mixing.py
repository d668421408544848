"""Mixing sources to target weights by entropy balancing.

Document i of source s is taken at rate r_i. Among all rates that meet the token constraints sum(r_i * size_i) = target_s,
the one closest to taking each token once (least relative entropy, weighted by size) is r_i = exp(lambda_s): the
solution of a convex dual with a multiplier for each source. Each document stands under one constraint, so gradient and
Hessian at any multipliers are exp(lambda_s) times the source's sum of sizes: one distributed aggregation over the
documents serves all of Newton's iterations. These run over the table of sources, all side by side, until the largest
violated share of a constraint is below TOLERANCE.

Rates become copies: each document is taken as often as its rate, rounded down, and once more if its draw (a hash of key
and text) lies below the bound of its cell. A cell is a source's documents of one power of 2 in size. The bounds at which
the cells' words come nearest to what they should give are found by distributed histograms of draws, each narrowing the
bin that holds the bound by 12 bits, until one draw is left. What the cells of a source then miss goes to its smallest
cell that can take it up, whose bound is searched once more. So no row is ever ranked, and a source with a third of all
documents is a few thousand sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.llm.durable import durable, joined
from palimp.operators.ranking import numbered

#: Fixed values of the contract.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Newton's iterations stop at this share of a constraint; so many run between two looks at it.
TOLERANCE, STRIDE = 1e-12, 5
#: Bits of a draw, and bits that one histogram tells.
DRAW, BITS = 60, 12
BLANK = " \t\n\x0b\f\r"


def words(text: str) -> F.Column:
    """The number of runs of other characters than x20 and x09-x0D; 0 for null."""
    bare = F.btrim(F.col(text), F.lit(BLANK))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def same(a: DataFrame, b: DataFrame, *names: str) -> list:
    return [a[c].eqNullSafe(b[c]) for c in names]


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size) + weight and target.

    All sources get level * weight, or most * source_size where that is less. The level starts as if none were full, and
    what full ones leave raises it, until no further source is full: two sums over the sources each time.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights)).cast("int") + 1)
    placed = numbered(sources, F.col("source").asc_nulls_last(), name="place")
    at = durable(placed.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("most")))
    whole = share * (at.agg(F.sum("source_size")).first()[0] or 0)
    level, known = 0.0, -1
    while True:
        full = F.col("most") < level * F.col("weight")
        over = at.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("most"))).alias("most"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if over["n"] == known or not over["weight"]:
            break
        level, known = (whole - (over["most"] or 0.0)) / over["weight"], over["n"]
    return at.select("source", "source_size", "weight", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def rates(balanced: DataFrame) -> DataFrame:
    """+ rate: exp of the multiplier that Newton's iterations reach for each source's token constraint; 0 without a target."""
    ratio = F.col("target") / F.nullif("source_size", F.lit(0))
    some = F.coalesce(ratio, F.lit(0.0)) > 0
    # The gradient is size * exp(x) - target, the Hessian size * exp(x); their quotient is the share that violates the constraint.
    step = lambda x, _: x - F.lit(1.0) + ratio * F.exp(-x)
    at = balanced.withColumn("multiplier", F.lit(0.0))
    while True:
        at = durable(at.withColumn("multiplier", F.when(some, F.aggregate(F.sequence(F.lit(1), F.lit(STRIDE)), F.col("multiplier"), step)).otherwise(F.lit(0.0))))
        missed = at.where(some).agg(F.max(F.abs(1 - ratio * F.exp(-F.col("multiplier"))))).first()[0]
        if (missed or 0.0) <= TOLERANCE:
            return at.withColumn("rate", F.when(some, F.exp("multiplier")).otherwise(F.lit(0.0))).drop("multiplier")


def bounds(base: DataFrame, cells: DataFrame) -> DataFrame:
    """cells (source, band, wanted) as (source, band, below, got): the documents with draws below `below` hold `got` words, as near to `wanted` as draws allow."""
    at = cells.select("source", "band", "wanted", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"))
    shift = DRAW
    while True:
        shift -= BITS
        asked = at.select(F.col("source").alias("__of"), F.col("band").alias("__band"), F.col("bin").alias("within"), "before", "wanted")
        here = base["source"].eqNullSafe(asked["__of"]) & (base["band"] == asked["__band"])
        inside = joined(base, asked, here).where(F.shiftright("draw", shift + BITS) == F.col("within"))
        bins = inside.groupBy("source", "band", F.shiftright("draw", shift).alias("bin")).agg(F.sum("size").alias("s"), F.min("draw").alias("lo"), F.max("draw").alias("hi"), F.min("wanted").alias("wanted"), F.min("before").alias("start"))
        # At most 2 ** BITS rows for each cell.
        earlier = F.sum("s").over(W.partitionBy("source", "band").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
        found = bins.withColumn("before", F.col("start") + F.coalesce(earlier, F.lit(0))).where("before <= wanted")
        last = found.groupBy("source", "band").agg(F.max(F.struct("bin", "before", "s", "lo", "hi", "wanted")).alias("x"))
        at = durable(last.select("source", "band", "x.*"))
        if shift == 0 or at.where("lo < hi").isEmpty():
            break
    take = F.col("before") + F.col("s") - F.col("wanted") < F.col("wanted") - F.col("before")
    return durable(at.select("source", "band", F.when(take, F.col("hi") + 1).otherwise(F.col("lo")).alias("below"), (F.col("before") + F.when(take, F.col("s")).otherwise(0)).alias("got")))


def extras(base: DataFrame, balanced: DataFrame) -> DataFrame:
    """(source, band, below): which documents of each cell get one copy more than the rate rounded down."""
    cells = base.groupBy("source", "band").agg(F.sum("size").alias("all"))
    cells = joined(cells, balanced, same(cells, balanced, "source")).select(cells["source"], "band", "all", (F.col("all") * (F.col("rate") - F.floor("rate"))).alias("wanted"))
    cells = durable(cells)
    first = bounds(base, cells)
    both = durable(joined(cells, first, same(cells, first, "source", "band")).select(cells["source"], cells["band"], "all", "wanted", "below", "got"))
    missed = both.groupBy("source").agg((F.sum("wanted") - F.sum("got")).alias("missed"))
    room = joined(both, missed, same(both, missed, "source")).drop(missed["source"])
    room = room.where(F.when(F.col("missed") >= 0, F.col("all") - F.col("got") >= F.col("missed")).otherwise(F.col("got") >= -F.col("missed")) & (F.abs("missed") >= 0.5))
    again = durable(room.groupBy("source").agg(F.min(F.struct("band", (F.col("got") + F.col("missed")).alias("wanted"))).alias("x")).select("source", "x.*"))
    if again.isEmpty():
        return first.select("source", "band", "below")
    second = bounds(base, again).select("source", "band", F.col("below").alias("other"))
    out = joined(first, second, same(first, second, "source", "band"), "left")
    return durable(out.select(first["source"], first["band"], F.coalesce("other", "below").alias("below")))


def mix(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", keep: tuple[str, ...] | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """keep (by default key and source), size, source_size, target, rate, copies and taken (copies * size) for each row of `docs`.

    A null or wordless text has size 0 and is taken 0 times; null sources are one source, the last. Repeated rows count
    each; those with equal key and text get the same number of copies, so reruns agree. A source's taken words differ
    from its target by half of one of its documents (or one set of repeated rows), if others can make up for that by a
    small one. Only key, text, source and `keep` are read; `keep` must not hold names of the results or names that start
    with two underscores. An empty table gives an empty result.
    """
    kept = keep if keep is not None else (key, source)
    draw = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"), F.lit("mix")), F.lit(1 << DRAW))
    read = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{source}`").alias("__source"), words(f"`{text}`").alias("size"), draw.alias("__draw"))
    # Rows without texts are kept; with them, they are read twice.
    read = durable(read) if keep is None else read
    band = F.floor(F.log2("size")).cast("int")
    base = read.where("size > 0").select(F.col("__source").alias("source"), band.alias("band"), "size", F.col("__draw").alias("draw"))
    base = base if keep is None else durable(base)
    wordless = read.select(F.col("__source").alias("source")).distinct() if keep is None else docs.select(F.col(f"`{source}`").alias("source")).distinct()
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = wordless.join(sizes, wordless["source"].eqNullSafe(sizes["source"]), "left").select(wordless["source"], F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"))
    balanced = durable(rates(targets(sources, weights, share, most)).select("source", "source_size", "target", "rate"))
    below = extras(base, balanced).select(F.col("source").alias("__of"), F.col("band").alias("__band"), "below")
    about = balanced.withColumnRenamed("source", "__of")
    found = joined(read, about, read["__source"].eqNullSafe(about["__of"]), "left").drop("__of")
    found = joined(found, below, found["__source"].eqNullSafe(below["__of"]) & (F.floor(F.log2(found["size"])).cast("int") == below["__band"]), "left")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.floor("rate") + (F.col("__draw") < F.col("below")).cast("long")).cast("long")
    return found.select(*(F.col(f"`{c}`") for c in kept), "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
