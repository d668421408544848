"""A search index: for each token the documents that have it, with places, in buckets by token and sorted in them.

A lookup reads the buckets of its own tokens, and of these the parts whose tokens may match: files are sorted, so their
statistics tell. A frequent token is dealt to several files by document; no task holds all of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of an index, and what a token is.
BUCKETS, TOKEN = 256, r"[\p{L}\p{N}]+"
#: Documents that go to Python at once, and tokens that are posted at once, at most (but for one document's).
AT_ONCE, SHARE = 500, 200_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The usual weights of frequency and length.
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc, t) as token, doc, tf, places, size: they come from one row, so nothing is shuffled for them. Documents of about SHARE tokens at a time."""
    for b in batches:
        share = np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False)) // SHARE
        cuts = np.r_[0, np.flatnonzero(np.diff(share)) + 1, len(share)]
        for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            docs, lists = b.column(0).slice(first, end - first), b.column(1).slice(first, end - first)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            known = lists.flatten().dictionary_encode()
            whose = np.repeat(np.arange(len(sizes)), sizes)
            code = whose * max(len(known.dictionary), 1) + known.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            at = order[starts]
            places = pa.array((np.arange(len(whose)) - (np.cumsum(sizes) - sizes)[whose])[order], pa.int32())
            ends = pa.array(np.r_[starts, len(whose)], pa.int32())
            made = (known.dictionary.take(known.indices.take(pa.array(at))), docs.take(pa.array(whose[at])), pa.array(np.diff(np.r_[starts, len(whose)]), pa.int32()), pa.ListArray.from_arrays(ends, places), pa.array(sizes[whose[at]], pa.int32()))
            yield pa.RecordBatch.from_arrays(list(made), names=["token", "doc", "tf", "places", "size"])


@contextmanager
def _few_at_once(spark: SparkSession) -> Iterator[None]:
    """Few documents to a batch for Python while something is written; afterwards the session is as before."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> None:
    """path/postings: token, doc, tf, places (from 0), size (the document's tokens) by bucket; path/about: documents, tokens, buckets. Keys must be unique."""
    cut = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("t"))
    kind = dict(cut.dtypes)["doc"]
    placed = cut.mapInArrow(_posted, f"token string, doc {kind}, tf int, places array<int>, size int").withColumn("bucket", _bucket(F.col("token"), buckets))
    # Rebalancing splits a bucket that a frequent token makes large; a task's rows are in the order of the files.
    with _few_at_once(docs.sparkSession):
        placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "token", "doc").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    about = cut.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("t")), F.lit(0)).cast("long").alias("tokens")).withColumn("buckets", F.lit(buckets))
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def postings(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """The postings of some tokens, out of their buckets alone."""
    buckets = spark.read.parquet(f"{path}/about").first()["buckets"]
    wanted = sorted({w.lower() for w in words})
    if not wanted:
        return spark.read.parquet(f"{path}/postings").limit(0)
    held = [r["b"] for r in spark.createDataFrame([(w,) for w in wanted], "w string").select(_bucket(F.col("w"), buckets).alias("b")).distinct().collect()]
    return spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(held) & F.col("token").isin(wanted))


def phrase(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """doc, n: how often the words stand one behind the other in a document; a document where they don't has no row."""
    found = postings(spark, path, words)
    offsets = F.lit(None).cast("array<int>")
    for w in {w.lower() for w in words}:
        offsets = F.when(F.col("token") == w, F.array(*(F.lit(k) for k, x in enumerate(words) if x.lower() == w))).otherwise(offsets)
    starts = found.select("doc", F.explode("places").alias("place"), offsets.alias("o")).select("doc", F.explode(F.transform("o", lambda k: F.col("place") - k)).alias("start"))
    whole = starts.groupBy("doc", "start").agg(F.count("*").alias("k")).where(F.col("k") == len(words))
    return whole.groupBy("doc").agg(F.count("*").alias("n"))


def ranked(spark: SparkSession, path: str, words: list[str], n: int = 20) -> DataFrame:
    """doc, score of the n best documents by BM25 over the distinct words; ties (by nine decimals) to the smaller doc."""
    about = spark.read.parquet(f"{path}/about").first()
    found = postings(spark, path, words)
    often = {r["token"]: r["df"] for r in found.groupBy("token").agg(F.count("*").alias("df")).collect()}  # one row for each word
    mean = about["tokens"] / max(about["documents"], 1) or 1.0
    weight = F.lit(0.0)
    for token, df in often.items():
        rare = F.log(F.lit(1.0) + (F.lit(float(about["documents"])) - df + 0.5) / (df + 0.5))
        weight = F.when(F.col("token") == token, rare).otherwise(weight)
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    return found.groupBy("doc").agg(F.round(F.sum(part), 9).alias("score")).orderBy(F.desc("score"), "doc").limit(n)
