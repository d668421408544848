"""Version chains: listings of one product in order, repeated contents, consecutive pairs.

A listing has registro, expediente, data, situacao, tipo and hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.functions import text as tx

LISTED = ("data", "expediente")


def grouped(listings: DataFrame) -> DataFrame:
    """registro, data, expediente, kinds: the kinds of text of each version."""
    return listings.groupBy("registro", "data", "expediente").agg(F.array_sort(F.collect_set("tipo")).alias("kinds"))


def first_of(listings: DataFrame, *keys: str) -> DataFrame:
    """The earliest listing of each key: later ones repeat it under a new date."""
    order = W.partitionBy(*keys).orderBy(*LISTED)
    return listings.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def relisted(listings: DataFrame, *keys: str) -> DataFrame:
    """keys, data (of the first listing), republicada (later dates, ascending), n_listings."""
    at = F.array_sort(F.collect_list(F.struct(*LISTED)))
    dates = F.transform(at, lambda x: x["data"])
    return listings.groupBy(*keys).agg(dates.alias("__d")).select(*keys, F.get("__d", F.lit(0)).alias("data"), F.expr("slice(__d, 2, size(__d))").alias("republicada"), F.size("__d").cast("long").alias("n_listings"))


def chain(listings: DataFrame) -> DataFrame:
    """Each product's contents in order, each at its first listing (A, B, A, C is A, B, C), with its place."""
    own = first_of(listings, "registro", "tipo", "hash")
    return own.withColumn("pos", F.row_number().over(W.partitionBy("registro", "tipo").orderBy(*LISTED)).cast("long"))


def pairs(chained: DataFrame) -> DataFrame:
    """Each content with the one before it: registro, tipo, de, para, de_data, para_data, slug."""
    order = W.partitionBy("registro", "tipo").orderBy(*LISTED)
    before = chained.select("*", F.lag("expediente").over(order).alias("de"), F.lag("data").over(order).alias("de_data"))
    return before.where("de is not null").select("registro", "tipo", "de", F.col("expediente").alias("para"), "de_data", F.col("data").alias("para_data"), tx.slug(F.col("de"), F.col("expediente"), F.col("tipo")).alias("slug"))


def repeated(listings: DataFrame) -> DataFrame:
    """+ repetida: the version's content was seen in an earlier version of the product, of whatever kind."""
    seen = F.min(F.struct(*LISTED)).over(W.partitionBy("registro", "hash"))
    return listings.withColumn("repetida", seen < F.struct(*LISTED))


def repeated_versions(listings: DataFrame) -> DataFrame:
    """registro, expediente, repetida: all contents of a version, of all its kinds, were seen in earlier versions of the product."""
    own = F.min(F.struct(*LISTED)).over(W.partitionBy("registro", "expediente"))
    placed = listings.select("registro", "expediente", "hash", own.alias("__own"))
    first = F.min("__own").over(W.partitionBy("registro", "hash"))
    return placed.withColumn("__seen", first < F.col("__own")).groupBy("registro", "expediente").agg(F.bool_and("__seen").alias("repetida"))


def with_status(versions: DataFrame, history: DataFrame) -> DataFrame:
    """+ situacao from history (registro, expediente, situacao, pos): the last entry of a key counts, none is empty."""
    last = history.groupBy("registro", "expediente").agg(F.max_by("situacao", "pos").alias("__s"))
    return versions.join(last, ["registro", "expediente"], "left").withColumn("situacao", tx.or_empty(F.col("__s"))).drop("__s")
