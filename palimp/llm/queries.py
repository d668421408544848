"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.llm import ann, bpe, langid, licenses, maintext, mixing, ngram_join, prefix_trie, quality, repetition, token_counts, topk, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "probability", "similarity", F.size("licenses").cast("long").alias("n_paragraphs"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, emit=bpe.Digest, columns=bpe.AS_DIGEST)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", F.coalesce(langid.part("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def unrolled(docs: DataFrame) -> DataFrame:
    """doc_id and text: of a tenth of the documents, by their ids' checksums, the words from some place on repeat what begins there."""
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(repetition.WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    picked = rows.where("h % 10 = 0").withColumn("w", words).withColumn("n", F.size("w"))
    picked = picked.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", F.greatest("n", F.lit(1)))).otherwise(F.lit(0)).cast("int"))
    picked = picked.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int"))
    again = F.transform(F.slice("w", F.col("a") + 1, F.col("n")), lambda _, i: F.get("w", F.col("a") + i % F.col("p")))
    made = F.when(F.col("n") > 0, F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), again)).otherwise(F.col("text").cast("string"))
    return picked.select("doc_id", made.alias("text")).unionByName(rows.where("h % 10 <> 0 or h is null").select("doc_id", F.col("text").cast("string").alias("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.collapse(unrolled(table(spark, sf_dir, "documents")))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = [F.col(f"greatest.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.floor(F.col("greatest.length") * 1000 / F.col("greatest.period")).cast("long").alias("exponent_milli")
    digests = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((told, "runs_sha256"), (F.col("collapsed"), "collapsed_sha256"))]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *top, exponent, *digests)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    rows = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.grafted(rows, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_licenses": op2_licenses,
    "op3_quality": op3_quality,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_ngram_join": op5_ngram_join,
    "op6_top_k": op6_top_k,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_url_filter": op10_url_filter,
    "op11_html_extraction": op11_html_extraction,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": _pipeline,
}
ORACLES: dict[str, str] = {
    "op6_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_url_filter": r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'), ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) t(rhost, rpath, rule, verdict)),
f AS (
  SELECT u.*, (SELECT max_by(r, length(r.rule)) FROM r WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)) AS best,
    regexp_matches(lower(u.host || u.path), '(^|[^a-z0-9])(spam[^a-z0-9]farm|casino|poker|porn|xxx|viagra|torrent|warez|free[^a-z0-9]download|click[^a-z0-9]here|ad[^a-z0-9]server|link[^a-z0-9]farm|(OFFERS)[^a-z0-9](THINGS))([^a-z0-9]|$)') AS word
  FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN word THEN 'block' ELSE 'allow' END) AS verdict FROM f""".replace("OFFERS", "|".join(url_filter.OFFERS)).replace("THINGS", "|".join(url_filter.THINGS)),
}
