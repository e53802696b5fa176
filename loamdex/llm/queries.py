"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm import clusters, leaks, mixing, pieces, provenance, spam, syntax, vectors


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.found(clusters.clusters(_t(spark, d, "embedding_cache")))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(_t(spark, d, "embedding_cache")).select("content_hash", "cluster_id", "membership")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    cache = _t(spark, d, "embedding_cache")
    return clusters.describe(clusters.clusters(cache), cache)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.pairs(vectors.nearest(_t(spark, d, "embedding_cache")))


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(_t(spark, d, "embedding_cache"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.repairs(_t(spark, d, "chunks")).filter("cost > 0").select("repo", "file_path")


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.repairs(_t(spark, d, "chunks"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.repairs(_t(spark, d, "chunks")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance(_t(spark, d, "chunks")).filter("why is not null").select("repo", "file_path")


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance(_t(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(_t(spark, d, "chunks")).filter("piece = 0").select("id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(_t(spark, d, "chunks"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[1]


def p9_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Shares by temperature: source token shares raised to the exponent whose weights have an entropy of 2.2 nats."""
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"), entropy=2.2)[1]


def p9_budget(spark: SparkSession, d: str) -> DataFrame:
    """Shares at a budget of all tokens, over what the targets allow: tilted by the smallest exponent that keeps the caps."""
    docs = _t(spark, d, "documents")
    total = mixing.with_tokens(docs.filter("doc_id is not null")).agg(F.sum("n_tokens")).first()[0] or 0  # one number
    return mixing.mix(docs, _t(spark, d, "mix_targets"), budget=float(total))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam(_t(spark, d, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_members, p1_clusters, p2_found, p2_files, p2_rates, p3_found, p3_files, p5_found, p5_pieces, p6_found, p6_nearest, p8_found, p8_items, p9_mix, p9_shares, p9_entropy, p9_budget, p10_found)}

_CURRENT = """
WITH m AS (SELECT content_hash, arg_max(embedding, created_at) AS e FROM embedding_cache WHERE model_id = 'quillcode-embed-2' AND content_hash IS NOT NULL GROUP BY content_hash),
v AS (SELECT content_hash AS h, CAST(e AS FLOAT[128]) AS e FROM m WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT a.h AS a, b.h AS b, round(CAST(array_inner_product(a.e, b.e) AS DOUBLE) / (sqrt(CAST(array_inner_product(a.e, a.e) AS DOUBLE)) * sqrt(CAST(array_inner_product(b.e, b.e) AS DOUBLE))), 6) AS c
      FROM v a JOIN v b ON a.h <> b.h),
k AS (SELECT a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS i FROM s WHERE c >= 0.70) WHERE i <= 5)
"""

SQL = {
    "p5_found": "SELECT DISTINCT id FROM chunks WHERE octet_length(encode(content)) > 1500",
    "p6_found": _CURRENT + "SELECT DISTINCT least(a, b) AS hash_a, greatest(a, b) AS hash_b FROM k",
    "p6_nearest": _CURRENT + "SELECT a AS content_hash, b AS neighbour, c AS cos FROM k",
}
