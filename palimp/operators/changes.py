"""What changed between two states of a table, by digests on two levels.

A state is kept as a digest for each row, in buckets by key, and a digest for each bucket. Two states are compared bucket by
bucket; only the rows of unequal buckets are read and joined. Named fields are left out of the digests, so a change in them
alone is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a state. Two states that are compared must have the same number.
BUCKETS = 1_024


def digested(rows: DataFrame, keys: list[str], ignore: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """keys, digest (of the fields that are neither key nor ignored, by name), bucket."""
    own = sorted(c for c in rows.columns if c not in keys and c not in ignore)
    # JSON tells null from empty and one field from the next, and null fields are written too.
    told = F.to_json(F.struct(*own), {"ignoreNullFields": "false"}) if own else F.lit("")
    return rows.select(*keys, F.sha2(told.cast("binary"), 256).alias("digest"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"))


def bucket_digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """bucket, n, a, b: rows and the sums of two parts of their digests, keys included; sums don't depend on the order."""
    whole = F.sha2(F.to_json(F.struct(*keys, "digest")).cast("binary"), 256)
    part = lambda at: F.conv(F.substring(whole, at, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"))


def write_state(rows: DataFrame, path: str, keys: list[str], ignore: tuple[str, ...] = (), buckets: int = BUCKETS) -> None:
    """The state of a table: path/rows (a folder for each bucket), path/buckets and path/fields."""
    made = digested(rows, keys, ignore, buckets)
    made.limit(0).write.mode("overwrite").parquet(f"{path}/fields")  # a state without rows has fields too
    made.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    bucket_digests(read_state(rows.sparkSession, path), keys).coalesce(1).write.mode("overwrite").parquet(f"{path}/buckets")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """keys, digest, bucket of a state."""
    return spark.read.schema(spark.read.parquet(f"{path}/fields").schema).parquet(f"{path}/rows")


def unequal(spark: SparkSession, old: str, new: str) -> list[int]:
    """Buckets whose digests differ; there are at most as many as a state has buckets."""
    a, b = (spark.read.parquet(f"{p}/buckets") for p in (old, new))
    same = F.coalesce(*(F.when(a[c].eqNullSafe(b[c]), None).otherwise(F.lit(False)) for c in ("n", "a", "b")), F.lit(True))
    return sorted(r["bucket"] for r in a.join(b, "bucket", "full_outer").where(~same).select("bucket").collect())


def changes(spark: SparkSession, old: str, new: str, keys: list[str]) -> DataFrame:
    """keys, change: 'added', 'gone' or 'changed', of the rows whose digests differ. Keys must be unique; a null key is a key."""
    wanted = unequal(spark, old, new)
    a, b = (read_state(spark, p).where(F.col("bucket").isin(wanted)) for p in (old, new))
    a, b = a.withColumnRenamed("digest", "__a"), b.withColumnRenamed("digest", "__b")
    on: Column = a["bucket"] == b["bucket"]
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    both = a.join(b, on, "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b")))
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "gone").otherwise("changed")
    return both.select(*(F.coalesce(a[k], b[k]).alias(k) for k in keys), kind.alias("change"))
