"""The pipeline's stages: what goes, what stays, and that run() is the stages one after the other."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from palimp.llm import bpe, ngram_join

from .helpers import ODD, documents, sentence
from .test_similarity import brute_join
from .test_tokens import MODEL, RANKS  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_stages_keep_columns_and_good_documents(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    at = docs
    for name, stage in pipe.STAGES[:2]:
        at = stage(spark, at, DATA)
        assert at.columns == docs.columns and dict(at.dtypes) == dict(docs.dtypes), name
    kept = {r["doc_id"] for r in at.select("doc_id").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()} & {r["doc_id"] for r in docs.collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(good & kept) >= 0.99 * len(good) and len(bad & kept) <= 0.1 * len(bad)


def test_one_of_each_group_stays(spark):
    rng = random.Random(9)
    base = [sentence(rng, 80) for _ in range(6)]
    texts = [*ODD, *base, *base, *(b + " more" for b in base), *(sentence(rng, 60) for _ in range(5)), None, ""]
    data = documents(spark, texts)
    kept = sorted(r["doc_id"] for r in pipe.near_duplicates(spark, data, DATA).collect())
    groups = brute_join(texts, 5, 80, 100)
    assert kept == sorted(i for i, (_, c) in groups.items() if i == c)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words are here now then"), (None, "x y z"), (2, "a b c d e f"), (3, None), (3, None)]
    data = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1))
    kept = sorted(((r["doc_id"] or -1), r["text"] or "") for r in pipe.near_duplicates(spark, data, DATA).collect())
    # Each row is judged by its own text.
    assert kept == [(-1, "x y z"), (1, "a b c d e f"), (1, "other words are here now then"), (3, ""), (3, "")]
    nulls = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (None, "p q r s t u v"), (9, "a b c d e f g")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in pipe.near_duplicates(spark, nulls, DATA).collect()) == [(0, "p q r s t u v"), (9, "a b c d e f g")]


NAMES = "score rejected lang_pred keep p_document p_host p_path size source_size target rate copies copy taken row one component_id n_shingles links component c0 c1 h n x id n_tokens ids_sha256 __text __key __in __host __path __source __draw __copies below".split()


def test_columns_of_any_name_pass_through(spark, docs):
    wide = docs.select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in NAMES), F.create_map(F.lit("k"), F.col("doc_id")).alias("map"))
    wide = wide.union(wide.limit(3))
    for name, stage in pipe.STAGES[:-1]:
        got = stage(spark, wide, DATA)
        assert got.columns == wide.columns and dict(got.dtypes) == dict(wide.dtypes), name
        rows = got.collect()
        assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in NAMES) and all(r["map"] == {"k": r["doc_id"]} for r in rows), name
    assert pipe.encode(spark, wide, DATA).count() == wide.count()


def test_mix_takes_whole_copies(spark, docs):
    mixed = pipe.source_mix(spark, docs, DATA)
    assert mixed.columns == docs.columns
    assert 1 <= mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_empty_input(spark, docs):
    at = docs.limit(0)
    for _, stage in pipe.STAGES:
        at = stage(spark, at, DATA)
    assert at.collect() == []


def test_run_is_the_stages(spark, docs):
    at = docs
    for _, stage in pipe.STAGES[:-1]:
        at = stage(spark, at, DATA)
    coder = bpe.ByteBPE(RANKS, pipe.public_tokenizers.PATTERN)
    wanted = sorted((r["doc_id"], len(coder.bpe.encode_ordinary(r["text"]))) for r in at.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in pipe.run(spark, DATA).collect()) == wanted and wanted
    assert ngram_join.join(at.dropDuplicates(["doc_id"]), n=5, similarity=(80, 100)).where("doc_id <> component_id").count() == 0
