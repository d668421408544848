"""The corpus pipeline: language ID, quality, near-duplicates, mixing, and the encoding of what remains.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`, whatever
their names. Rows that share a doc_id are judged each by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.llm import bpe, langid, mixing, ngram_join, quality
from palimp.llm.durable import durable, joined, stored

#: Keys of rows that are broadcast, about 60 bytes each; more are joined by shuffling.
MOST_ROWS = 300_000


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by their places, which no operator's names clash with, and these names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    of: dict[str, str] = {}
    for own, name in zip(docs.columns, names, strict=True):
        of.setdefault(own, name)
    return docs.toDF(*names), of


def _again(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, by their places, from what was made of _plain(docs)."""
    return found.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known; learns only from the rows that aren't held out."""
    rows, of = _plain(docs)
    model = langid.fit(rows, text=of["text"], lang=of["lang"], key=of["doc_id"])
    return _again(langid.identify(rows, model, text=of["text"], keep=tuple(rows.columns)).where(~F.col("rejected")), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of good form, by themselves and their source."""
    rows, of = _plain(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", of["doc_id"])
    site = {"host": of["source"], "path": f"concat_ws('/', {of['source']}, {of['lang']})"}
    model = quality.fit(rows, labels, text=of["text"], key=of["doc_id"], **site)
    return _again(quality.classify(rows, model, keep=tuple(rows.columns), text=of["text"], store=False, **site).where("keep"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that word 5-grams link at a similarity of 0.8: the one with the smallest id.

    Documents without words are in no group and stay. A null id comes after all others. Rows that share an id are judged
    each by its own text, ties by a hash of the text; of rows that share id and text, one stays: the one whose other
    columns come first as JSON.
    """
    rows, of = _plain(docs)
    text = F.col(of["text"]).cast("string")
    row = F.struct(F.col(of["doc_id"]).isNull().alias("unknown"), F.col(of["doc_id"]).alias("id"), F.xxhash64(text).alias("x"), F.xxhash64(text, F.lit(1)).alias("y"))
    rows = rows.withColumn("row", row)
    groups = durable(ngram_join.join(rows, text=of["text"], key="row", n=5, similarity=(80, 100), counted=False).where("n_shingles > 0"))
    gone = durable(groups.where(F.col("row") != F.col("component_id")).select("row").distinct())
    again = durable(groups.where(F.col("row") == F.col("component_id")).groupBy("row").count().where("count > 1").select("row"))
    left = joined(rows, gone, "row", "left_anti", most_rows=MOST_ROWS)
    if again.isEmpty():
        return _again(left, docs)
    whole = F.struct(*(f"c{i}" for i in range(len(docs.columns))))
    one = joined(left, again, "row", "left_semi", most_rows=MOST_ROWS).groupBy("row").agg(F.min_by(whole, F.to_json(whole)).alias("one")).select("one.*")
    return _again(joined(left, again, "row", "left_anti", most_rows=MOST_ROWS).drop("row").unionByName(one), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as the mix does: not at all, once or twice."""
    rows, of = _plain(docs)
    taken = mixing.mix(rows, text=of["text"], key=of["doc_id"], source=of["source"], keep=tuple(rows.columns)).where("copies > 0")
    return _again(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of each text."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, emit=bpe.Digest, columns=bpe.AS_DIGEST)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("encode", encode),
]
#: Classifiers, components and rounding aren't SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each one's result written as Parquet where executors share it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
