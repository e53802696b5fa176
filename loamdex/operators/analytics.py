"""Index statistics, pivotal files, cluster samples, labels and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: distinct chunks, symbols (non-block nodes), blocks, symbol and flow edges, clusters."""
    flow = F.col("kind").isin("controls", "dataflow", "guards")
    a = chunks.agg(F.countDistinct("id").alias("chunks"))
    b = nodes.select("id", "kind").distinct().agg(F.count_if(F.col("kind") != "block").alias("symbols"), F.count_if(F.col("kind") == "block").alias("blocks"))
    c = edges.agg(F.count_if(~flow).alias("symbol_edges"), F.count_if(flow).alias("flow_edges"))
    d = clusters.agg(F.countDistinct("id").alias("clusters"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # four single rows


def languages(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", F.lower(F.trim("language")).alias("language")).distinct().groupBy("language").agg(F.count("*").alias("n"))


def pivotal_files(chunks: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """(repo, file_path, chunks, symbols, pagerank): files by summed pagerank. As in the index this replaces, the sum
    runs over pairs of chunks and nodes, so it is the nodes' sum times the file's number of chunks; each side is
    aggregated before the join, so those pairs are never made."""
    key = ["repo", "file_path"]
    c = chunks.dropna(subset=key).groupBy(*key).agg(F.countDistinct("id").alias("chunks"), F.count("*").alias("rows"))
    n = nodes.groupBy(*key).agg(
        F.countDistinct(F.when(F.col("kind") != "block", F.col("id"))).alias("symbols"), F.sum(F.when(F.col("kind") != "block", F.col("pagerank")).otherwise(0.0)).alias("pr")
    )
    out = c.join(n, key, "left").select(*key, "chunks", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.round(F.coalesce(F.col("pr") * F.col("rows"), F.lit(0.0)), 6).alias("pagerank"))
    return out.orderBy(F.desc("pagerank"), F.desc("symbols"), *key).limit(k)


def cluster_samples(members: DataFrame, k: int = 5) -> DataFrame:
    """(cluster_id, chunk_id, rank): the k members of highest membership of every cluster, ties by id."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("membership"), "chunk_id")
    return members.select("cluster_id", "chunk_id", "membership").distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("cluster_id", "chunk_id", "rank")


def cluster_rows(members: DataFrame, least: float = 0.1) -> DataFrame:
    """(cluster_id, size, first_chunk): clusters of members whose membership is over ``least``, with the one of the
    largest, ties by id; a null membership is noise."""
    kept = members.filter(F.col("membership") > least).select("chunk_id", "cluster_id", "membership").distinct()
    one = kept.groupBy("cluster_id").agg(F.count("*").cast("int").alias("size"), F.max(F.struct("membership", (-F.col("chunk_id")).alias("c"))).alias("m"))
    return one.select("cluster_id", "size", (-F.col("m.c")).alias("first_chunk"))


def labels(texts: DataFrame, group: str, text: str, order: Column, samples: int = 5, words: int = 3) -> DataFrame:
    """(group, label): the most common words of four letters or more in up to ``samples`` texts of each group, by
    count, then alphabetically."""
    w = Window.partitionBy(group).orderBy(order)
    some = texts.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= samples)
    strip = lambda x: F.regexp_replace(F.lower(x), r"^[^a-z0-9_]+|[^a-z0-9_]+$", "")
    each = some.select(group, F.explode(F.split(text, r"\s+")).alias("w")).select(group, strip(F.col("w")).alias("w")).filter(F.length("w") >= 4)
    top = each.groupBy(group, "w").agg(F.count("*").alias("n")).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "w")))
    return top.filter(F.col("_r") <= words).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "w"))), lambda x: x["w"]), " ").alias("label"))


def retrieval_metrics(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query, mrr_at_10, ndcg_at_10, recall_at_5, recall_at_10) from expected (query, item; null item for none) and
    ranked (query, item, rank, each item once). Without expected items mrr is 0 and the others are 1."""
    want = expected.groupBy("query").agg(F.collect_set("item").alias("want"))
    got = ranked.filter(F.col("rank") <= 10).groupBy("query").agg(F.collect_list(F.struct("rank", "item")).alias("got"))
    r = want.join(got, "query", "left").withColumn("got", F.coalesce("got", F.array().cast("array<struct<rank:int,item:string>>")))
    hits = F.filter("got", lambda x: F.array_contains("want", x["item"]))
    n = F.size("want")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(10))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    dcg = F.aggregate(hits, F.lit(0.0), lambda s, x: s + 1.0 / F.log2(x["rank"] + 1.0))
    first = F.array_min(F.transform(hits, lambda x: x["rank"]))
    at5 = F.size(F.filter(hits, lambda x: x["rank"] <= 5))
    none = n == 0
    return r.select(
        "query", F.round(F.when(none, 0.0).otherwise(F.coalesce(1.0 / first, F.lit(0.0))), 6).alias("mrr_at_10"), F.round(F.when(none, 1.0).otherwise(dcg / ideal), 6).alias("ndcg_at_10"),
        F.round(F.when(none, 1.0).otherwise(at5 / n), 6).alias("recall_at_5"), F.round(F.when(none, 1.0).otherwise(F.size(hits) / n), 6).alias("recall_at_10"),
    )


def apply_labels(clusters: DataFrame, new: DataFrame) -> DataFrame:
    """Clusters with the label and summary that ``new`` (id, label, summary) gives for their id; blank labels and ids
    that don't exist change nothing, of repeated ids the largest label holds."""
    ok = new.filter("id is not null and trim(label) <> ''").groupBy("id").agg(F.max(F.struct("label", "summary")).alias("_n"))
    cols = [c for c in clusters.columns if c not in ("label", "summary")]
    joined = clusters.join(ok, "id", "left")
    return joined.select(*cols, F.coalesce("_n.label", "label").alias("label"), F.coalesce("_n.summary", "summary").alias("summary")).select(*clusters.columns)


def architecture(counts_row: dict, top: list[tuple[str, float]], files: list[tuple[str, float]], langs: list[tuple[str, int]], concepts: list[tuple[str, int]]) -> str:
    """A deterministic overview in Markdown of what the index holds, from a few rows per section."""
    out = ["# Architecture", "", *(f"- {k}: {v}" for k, v in counts_row.items())]
    for title, rows in (("Languages", langs), ("Pivotal files", files), ("Central symbols", top), ("Concepts", concepts)):
        out += ["", f"## {title}", "", *(f"- {name} ({value:.6g})" for name, value in rows)]
    return "\n".join(out) + "\n"
