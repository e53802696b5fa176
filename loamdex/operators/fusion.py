"""Fusing rankings, reranking, and the composed lanes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions.text import preview
from loamdex.session import Scratch

K = 60


def rrf(rankings: list[tuple[str, DataFrame]], weights: list[float] | None = None, k: int = K) -> DataFrame:
    """(id, score, sources, rank): sum of weight / (k + rank) over named rankings (id, rank).

    Equal scores keep the order of first appearance: the earliest ranking, then the rank in it."""
    weights = [1.0] * len(rankings) if weights is None else weights
    if len(weights) != len(rankings):
        raise ValueError("as many weights as rankings are needed")
    every: DataFrame | None = None
    for i, ((name, df), w) in enumerate(zip(rankings, weights)):
        part = df.select("id", (F.lit(float(w)) / (k + F.col("rank"))).alias("s"), F.lit(i).alias("i"), "rank", F.lit(name).alias("source"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("id").agg(
        F.round(F.sum("s"), 9).alias("score"), F.min(F.struct("i", "rank")).alias("first"), F.array_join(F.array_sort(F.collect_list("source")), "+").alias("sources")
    )
    order = [F.desc("score"), F.col("first.i"), F.col("first.rank")]
    return fused.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("id", "score", "sources", "rank")


def overlap(query: str, passage: Column | str) -> Column:
    """Number of distinct words that query and passage share, lower-cased and without outer punctuation."""
    strip = lambda w: F.regexp_replace(F.lower(w), r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", "")
    words = lambda c: F.filter(F.array_distinct(F.transform(F.split(c, r"\s+"), strip)), lambda x: x != "")
    return F.size(F.array_intersect(words(F.lit(query)), words(F.substring(passage, 1, 512)))).cast("double")


def rerank(candidates: DataFrame, passages: DataFrame, query: str, text: str) -> DataFrame:
    """Candidates (id, rank) rescored by :func:`overlap` on passages (id, text); ties keep the fused order."""
    scored = candidates.join(passages, "id").select("id", overlap(query, text).alias("score"), F.col("rank").alias("fused"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "fused")))


def refined(query: str, rows: list[tuple[str | None, float]]) -> list[str]:
    """Queries to try next: the query itself without rows, none if the best score is 1 or more, else the query with
    each of the first three names among the top five."""
    if not rows:
        return [query]
    if rows[0][1] >= 1.0:
        return []
    return [f"{query} {n}" for n, _ in rows[:5] if n][:3]


def fast_lane(symbol: DataFrame, trigram: DataFrame, bm25: DataFrame) -> DataFrame:
    """Exact symbol, trigram and BM25 rankings fused, without filters, reranking or vectors."""
    return rrf([("symbol", symbol), ("trigram", trigram), ("bm25", bm25)])


def full_lane(
    primary: list[tuple[str, DataFrame]], context: list[tuple[str, DataFrame]], expand: Callable[[DataFrame], DataFrame], ppr: Callable[[DataFrame], DataFrame],
    rerank_by: Callable[[DataFrame], DataFrame] | None = None, k: int = 20, spread: float = 0.25,
) -> DataFrame:
    """Primary rankings at weight 1, context rankings at 0.3, and on the best ``k`` of the primary ones graph
    expansion and personalised PageRank, fused, then reranked if ``rerank_by`` is given (see :func:`rerank`).

    ``expand`` maps seeds (id) to a ranking (id, rank), ``ppr`` candidates (id, weight) to one; candidates are the seeds
    at weight 1 and what expansion found at ``spread``."""
    scratch = Scratch(primary[0][1].sparkSession)
    # Rankings are at most a lane long; written once, they aren't made again for seeds, expansion and fusion.
    primary, context = ([(n, scratch.keep(df.coalesce(1))) for n, df in part] for part in (primary, context))
    seeds = scratch.keep(rrf(primary).filter(F.col("rank") <= k).select("id").coalesce(1))
    more = scratch.keep(expand(seeds).coalesce(1))
    weights = seeds.withColumn("weight", F.lit(1.0)).unionByName(more.select("id").withColumn("weight", F.lit(spread)))
    fused = rrf([*primary, *context, ("graph", more), ("ppr", ppr(weights))], [1.0] * len(primary) + [0.3] * len(context) + [1.0] * 2)
    if rerank_by is None:
        return fused
    fused = scratch.keep(fused.coalesce(1))
    best = rerank_by(fused.select("id", "rank"))
    return best.select("id", "score", "rank").join(fused.select("id", "sources"), "id")


def assemble_results(ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rank, chunk_id, file_path, kind, name, start_line, end_line, score, why, preview): a ranking (id, score,
    sources, rank) with what its chunks hold; chunks that are gone are left out and the ranks closed up."""
    cols = ["file_path", "kind", "name", "start_line", "end_line"]
    got = ranking.join(chunks.select("id", *cols, "content"), "id")
    return got.select(
        F.row_number().over(Window.orderBy("rank")).alias("rank"), F.col("id").alias("chunk_id"), *cols, F.round("score", 4).alias("score"), F.col("sources").alias("why"), preview("content").alias("preview"),
    )


def envelope(repo: str, query: str, lane: str, results: DataFrame, repo_dir: str = "", expansion: int = 0, reranker: str | None = None, top_k: int = 10) -> dict:
    """The answer to one question as a dictionary that turns into JSON, its results being the first ``top_k`` of
    :func:`assemble_results` in order of rank."""
    got = results.orderBy("rank").limit(top_k).collect()
    rows = [
        {
            "rank": r.rank, "file_absolute": f"{repo_dir}/{r.file_path}" if repo_dir else r.file_path, "file_relative": r.file_path, "start_line": r.start_line, "end_line": r.end_line, "kind": r.kind,
            "name": r.name, "score": r.score, "preview": r.preview, "why_this_was_returned": r.why,
        }
        for r in got
    ]
    more = refined(query, [(r.name, r.score) for r in got]) if lane == "full" else []
    return {
        "repo": repo, "query": query, "repo_dir": repo_dir, "pipeline_used": lane, "results": rows, "refined_queries": more,
        "expansion_size": expansion if lane == "full" else 0, "reranker_model": reranker,
    }
