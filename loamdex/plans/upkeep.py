"""Queries of sources, index upkeep and small operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import analytics, changes, graph, incremental, relate, vector
from loamdex.plans.indexes import Index, chunks_once, nodes_once, table
from loamdex.plans.retrieval import _NEWEST, _newest

QUERIES = {}
SQL = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    r"""SELECT spec, regexp_matches(spec, '^(https?://|git@|ssh://|git://)') AS url, string_split(regexp_replace(string_split(rtrim(spec, '/'), '/')[-1], '\.git$', ''), ':')[-1] AS name
FROM (SELECT DISTINCT unnest(['https://host.example/' || repo || '.git', 'git@host.example:' || repo, repo || '/', replace(repo, '/', ':')]) AS spec FROM merkle_files WHERE repo IS NOT NULL)"""
)
def source_specs(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("repo")
    many = F.array(F.concat(F.lit("https://host.example/"), r, F.lit(".git")), F.concat(F.lit("git@host.example:"), r), F.concat(r, F.lit("/")), F.replace(r, F.lit("/"), F.lit(":")))
    spec = table(spark, d, "merkle_files").filter("repo is not null").select(F.explode(many).alias("spec")).distinct()
    return spec.select("spec", T.is_url(F.col("spec")).alias("url"), T.repo_name(F.col("spec")).alias("name"))


@query(
    r"""SELECT q, regexp_replace(regexp_replace(regexp_split_to_array(trim(q), '\s+')[-1], '^[`.,:;()\[\]{}<>!?"'']+', ''), '[`.,:;()\[\]{}<>!?"'']+$', '') AS symbol
FROM (SELECT item_text AS q FROM eval_items UNION SELECT signature FROM nodes WHERE signature IS NOT NULL)"""
)
def last_symbols(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_items").select(F.col("item_text").alias("q")).union(table(spark, d, "nodes").select("signature").filter("signature is not null")).distinct()
    return q.select("q", T.last_symbol(F.col("q")).alias("symbol"))


_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"


@query(
    f"""WITH f AS (SELECT DISTINCT repo, file_path AS p FROM chunks WHERE repo IS NOT NULL AND file_path IS NOT NULL), m AS (SELECT repo, min(p) AS q FROM f GROUP BY repo),
x AS (SELECT repo, p, {_DIR.format('p')} AS dir, string_split({_DIR.format('p')}, '/') AS a, string_split({_DIR.format('q')}, '/') AS b FROM f JOIN m USING (repo))
SELECT repo, p AS file_path, dir, CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS INT) AS common FROM x"""
)
def path_relations(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "chunks").select("repo", "file_path").dropna().distinct()
    m = f.groupBy("repo").agg(F.min("file_path").alias("q"))
    a, b = T.directory(F.col("file_path")), T.directory(F.col("q"))
    return f.join(m, "repo").select("repo", "file_path", a.alias("dir"), T.common_prefix(a, b).cast("int").alias("common"))


_NODE = "nd AS (SELECT DISTINCT id, kind, name, short_name, coalesce(repo, '') || '/' || coalesce(file_path, '') AS f, parent_id, coalesce(start_line, 0) AS a, coalesce(end_line, 0) AS b FROM nodes)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    f = F.concat(F.coalesce("repo", F.lit("")), F.lit("/"), F.coalesce("file_path", F.lit(""))).alias("file_path")
    n = table(spark, d, "nodes").select("id", "kind", "name", "short_name", f, "parent_id", F.coalesce("start_line", F.lit(0)).cast("long").alias("start_byte"), F.coalesce("end_line", F.lit(0)).cast("long").alias("end_byte"))
    return n.distinct()


@query(
    f"""WITH {_NODE}, p AS (SELECT id, max(short_name) AS s FROM nd GROUP BY id), g AS (SELECT DISTINCT f, a, b, short_name AS n, p.s AS parent FROM nd LEFT JOIN p ON nd.parent_id = p.id),
k AS (SELECT f, a, b, n, row_number() OVER (ORDER BY f, a, b DESC, n) AS id FROM (SELECT DISTINCT f, a, b, n FROM g)), h AS (SELECT k.id, k.n, g.parent FROM k JOIN g USING (f, a, b, n)),
q AS (SELECT h.id, max(k.id) AS parent_id FROM h JOIN k ON h.parent = k.n AND k.id < h.id GROUP BY h.id) SELECT h.id, h.n AS name, q.parent_id FROM h LEFT JOIN q USING (id)"""
)
def number_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = _named(spark, d)
    p = n.groupBy(F.col("id").alias("parent_id")).agg(F.max("short_name").alias("parent_name"))
    found = n.join(p, "parent_id", "left").select("file_path", "start_byte", "end_byte", F.col("short_name").alias("name"), "parent_name").distinct()
    return graph.number_nodes(found).select("id", "name", "parent_id")


_FIT = "({0} = 'calls' AND {1} IN ('function', 'method') OR {0} = 'inherits' AND {1} = 'class' OR {0} = 'references' AND {1} <> 'block')"


@query(
    f"""WITH {_NODE}, p AS (SELECT id, max(short_name) AS s FROM nd GROUP BY id),
r AS (SELECT DISTINCT name AS src, p.s AS dst, CASE kind WHEN 'function' THEN 'calls' WHEN 'class' THEN 'inherits' ELSE 'references' END AS k FROM nd JOIN p ON nd.parent_id = p.id),
u AS (SELECT name, max(id) AS id, arg_max(kind, id) AS kind, arg_max(f, id) AS f FROM nd GROUP BY name), y AS (SELECT short_name, max(id) AS id, max(f) AS f FROM (SELECT DISTINCT id, short_name, f FROM nd) GROUP BY 1 HAVING count(*) = 1),
e AS (SELECT coalesce(a.id, y.id) AS s, coalesce(a.f, y.f) AS sf, r.dst, r.k, b.id AS d1, b.kind AS k1 FROM r LEFT JOIN u a ON r.src = a.name LEFT JOIN y ON r.src = y.short_name LEFT JOIN u b ON r.dst = b.name),
l AS (SELECT DISTINCT s, sf, dst, k FROM e WHERE d1 IS NULL AND s IS NOT NULL), c AS (SELECT l.s, l.dst, l.k, nd.id, string_split({_DIR.format('l.sf')}, '/') AS a, string_split({_DIR.format('nd.f')}, '/') AS b
  FROM l JOIN (SELECT DISTINCT id, kind, short_name, f FROM nd) nd ON nd.short_name = l.dst AND {_FIT.format('l.k', 'nd.kind')}),
n AS (SELECT s, dst, k, id, CASE WHEN a = b THEN 1000000 ELSE len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) END AS near FROM c),
w AS (SELECT s, dst, k, near, count(*) AS c, max(id) AS id, sum(count(*)) OVER (PARTITION BY s, dst, k) AS every, max(near) OVER (PARTITION BY s, dst, k) AS top FROM n GROUP BY s, dst, k, near)
SELECT DISTINCT src, dst, kind FROM (SELECT s AS src, d1 AS dst, k AS kind FROM e WHERE d1 IS NOT NULL AND s IS NOT NULL AND {_FIT.format('k', 'k1')} UNION ALL SELECT s, id, k FROM w WHERE near = top AND (every = 1 OR near > 0 AND c = 1)) WHERE src <> dst"""
)
def resolve_edges(spark: SparkSession, d: str) -> DataFrame:
    n = _named(spark, d)
    p = n.groupBy(F.col("id").alias("parent_id")).agg(F.max("short_name").alias("dst_name"))
    kind = F.when(F.col("kind") == "function", "calls").when(F.col("kind") == "class", "inherits").otherwise("references")
    raw = n.join(p, "parent_id").select(F.col("name").alias("src_name"), "dst_name", kind.alias("kind"), F.lit(1.0).alias("weight")).distinct()
    return graph.resolve_edges(raw, n.select("id", "kind", "name", "short_name", "file_path").distinct()).select("src", "dst", "kind")


@query(
    """WITH c AS (SELECT DISTINCT id, repo || ':' || file_path AS f, start_byte, end_byte FROM chunks WHERE repo IS NOT NULL AND file_path IS NOT NULL)
SELECT p.id, min(c.id) AS chunk_id FROM c p JOIN c ON p.f = c.f AND p.start_byte + 40 >= c.start_byte AND p.start_byte + 40 < c.end_byte GROUP BY p.id"""
)
def range_assign_bytes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").filter("repo is not null and file_path is not null").select("id", F.concat_ws(":", "repo", "file_path").alias("file_path"), "start_byte", "end_byte").distinct()
    return graph.assign_chunks(c.withColumn("start_byte", F.col("start_byte") + 40), c)


@query("SELECT content_hash, model_id, created_at, round(list_sum(list_transform(embedding, lambda v: v / 127.0::DOUBLE)), 6) + 0.0 AS total FROM (SELECT DISTINCT * FROM embedding_cache) WHERE embedding IS NOT NULL")
def vec_dequantize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embedding_cache").filter("embedding is not null").distinct()
    return e.select("content_hash", "model_id", "created_at", (F.round(F.aggregate(vector.dequantise("embedding"), F.lit(0.0), lambda s, v: s + v), 6) + 0.0).alias("total"))


@query(
    """WITH m AS (SELECT DISTINCT chunk_id, cluster_id, membership FROM chunk_clusters WHERE membership > 0.1)
SELECT cluster_id, CAST(count(*) AS INT) AS size, arg_max(chunk_id, (membership, -chunk_id)) AS first_chunk FROM m GROUP BY cluster_id"""
)
def cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    return analytics.cluster_rows(table(spark, d, "chunk_clusters"))


@query(
    f"""WITH {_NEWEST}, l AS (SELECT max(started_at) AS t FROM index_runs WHERE status = 'succeeded'), o AS (SELECT min(started_at) AS t FROM index_runs, l WHERE started_at <= l.t AND (started_at = l.t OR finished_at > l.t OR finished_at IS NULL AND status = 'running')),
r AS (SELECT started_at AS s, max(run_id) AS run_id, arg_max(status, run_id) AS status FROM index_runs WHERE started_at IS NOT NULL GROUP BY 1), g AS (SELECT b.* FROM b ASOF JOIN r ON b.seen >= r.s WHERE r.status = 'succeeded')
SELECT DISTINCT repo, file_path, sha AS blob_sha FROM a, o WHERE repo IS NOT NULL AND sha IS NOT NULL AND (o.t IS NULL OR epoch(seen) >= o.t) AND NOT EXISTS (SELECT 1 FROM g WHERE g.repo = a.repo AND g.file_path = a.file_path AND g.sha = a.sha)"""
)
def p7_changes(spark: SparkSession, d: str) -> DataFrame:
    """Key-and-version pairs that scans have seen since the low watermark and no run that succeeded has processed."""
    runs = table(spark, d, "index_runs")
    clean = lambda t, at: table(spark, d, t).select("repo", changes.clean_path("file_path").alias("file_path"), changes.clean_digest("blob_sha").alias("blob_sha"), at)
    scans = clean("tree_scan", F.unix_timestamp(F.col("scanned_at").cast("timestamp")).alias("seen"))
    done = changes.run_of(clean("merkle_files", F.col("last_indexed_at")), runs, "last_indexed_at").filter("run_status = 'succeeded'")
    return changes.changed_since(scans, done, changes.low_watermark(runs), ["repo", "file_path"], "blob_sha", "seen").select("repo", "file_path", "blob_sha")


@query(
    f"""WITH {_NEWEST}, y AS (SELECT * FROM a1 WHERE sha IS NOT NULL), dl AS (SELECT coalesce(b1.repo, y.repo) AS repo, coalesce(b1.file_path, y.file_path) AS file_path, y.repo IS NULL AS gone FROM b1 FULL JOIN y ON b1.repo = y.repo AND b1.file_path = y.file_path
WHERE NOT coalesce(b1.repo IS NOT NULL AND y.repo IS NOT NULL AND b1.sha IS NOT DISTINCT FROM y.sha, false)), c AS (SELECT DISTINCT id, repo, file_path, start_byte FROM chunks WHERE id IS NOT NULL AND repo IS NOT NULL AND file_path IS NOT NULL),
k AS (SELECT id, repo, file_path, start_byte FROM c WHERE NOT EXISTS (SELECT 1 FROM dl WHERE dl.repo = c.repo AND dl.file_path = c.file_path)), n AS (SELECT c.repo, c.file_path, c.start_byte FROM c JOIN dl ON dl.repo = c.repo AND dl.file_path = c.file_path WHERE NOT gone)
SELECT id, repo, file_path, start_byte FROM k UNION ALL SELECT (SELECT max(id) FROM c) + row_number() OVER (ORDER BY repo, file_path, start_byte), repo, file_path, start_byte FROM n"""
)
def update_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after an update: unchanged files keep their ids, others get new ones, removed files go."""
    c = table(spark, d, "chunks").filter("id is not null and repo is not null and file_path is not null").select("id", "repo", "file_path", "start_byte").distinct()
    after = _newest(table(spark, d, "tree_scan"), "scanned_at").filter("blob_sha is not null")
    delta = incremental.delta(_newest(table(spark, d, "merkle_files"), "last_indexed_at"), after, ["repo", "file_path"])
    return incremental.apply_update(c, c, delta, ["repo", "file_path"])


@query(
    """SELECT m.cluster_id, c.label, m.chunk_id, k.file_path, k.start_line, m.membership, c.size FROM (SELECT DISTINCT * FROM chunk_clusters) m JOIN (SELECT DISTINCT id, label, size FROM clusters) c ON m.cluster_id = c.id
JOIN (SELECT * FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) = 1) k ON k.id = m.chunk_id WHERE contains(lower(c.label), 'e')
ORDER BY m.membership DESC NULLS LAST, c.size DESC NULLS LAST, c.label, k.file_path, k.start_line, m.chunk_id LIMIT 30"""
)
def concept_labels(spark: SparkSession, d: str) -> DataFrame:
    return relate.concepts_by_label(table(spark, d, "clusters"), table(spark, d, "chunk_clusters"), chunks_once(spark, d), "E", 30)


@query(
    """WITH c AS (SELECT DISTINCT id, centroid FROM clusters WHERE centroid IS NOT NULL AND len(list_filter(centroid, lambda v: v IS NULL)) = 0), q AS (SELECT CAST(centroid AS DOUBLE[]) AS q FROM c ORDER BY id LIMIT 1),
s AS (SELECT id, row_number() OVER (ORDER BY round(list_inner_product(CAST(centroid AS DOUBLE[]), q) / (sqrt(list_inner_product(CAST(centroid AS DOUBLE[]), CAST(centroid AS DOUBLE[]))) * sqrt(list_inner_product(q, q))), 9) DESC, id) AS r FROM c, q)
SELECT chunk_id, cluster_id, CAST(r AS INT) AS cluster_rank, membership FROM (SELECT DISTINCT chunk_id, cluster_id, membership FROM chunk_clusters) m JOIN s ON s.id = m.cluster_id WHERE r <= 10 ORDER BY r, membership DESC NULLS LAST, chunk_id LIMIT 10"""
)
def concept_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "clusters")
    q = c.filter("centroid is not null and forall(centroid, v -> v is not null)").orderBy("id").select("centroid").first()[0]  # the one query vector
    same = {"model": "m", "dim": len(q), "quant": "int8"}
    return relate.concepts_by_centroid(c, table(spark, d, "chunk_clusters"), list(q), 10, same, same).results.select("chunk_id", "cluster_id", "cluster_rank", "membership")


@query("SELECT 'documents' AS part, 'ok' AS state UNION ALL SELECT 'chunks', 'ok' UNION ALL SELECT 'graph', 'ok'")
def catalog_listing(spark: SparkSession, d: str) -> DataFrame:
    """The indexes of this folder as the catalog lists them, with what guards their schema."""
    made = [Index(spark, d, p) for p in ("documents", "chunks", "graph")]
    return made[0].catalog.listing().filter(F.col("name").isin([i.name for i in made])).select(F.substring_index("name", "-", 1).alias("part"), "state")


@query()
def overview(spark: SparkSession, d: str) -> DataFrame:
    """The overview of the index in Markdown, one row a line."""
    c, n = table(spark, d, "chunks"), nodes_once(spark, d)
    one = analytics.counts(c, n, graph.containment_edges(table(spark, d, "nodes")), table(spark, d, "clusters")).first().asDict()
    top = [(r.name, float(r.pagerank)) for r in n.filter("kind <> 'block'").orderBy(F.desc("pagerank"), "name", "id").limit(10).select("name", "pagerank").collect()]
    pivotal = [(f"{r.repo}/{r.file_path}", r.pagerank) for r in analytics.pivotal_files(c, table(spark, d, "nodes")).collect()]
    langs = [(r.language or "unknown", r.n) for r in analytics.languages(c).orderBy(F.desc("n"), "language").limit(10).collect()]
    concepts = [(r.label or "unlabelled", r.size or 0) for r in table(spark, d, "clusters").select("id", "label", "size").distinct().orderBy(F.desc_nulls_last("size"), "id").limit(10).collect()]
    text = analytics.architecture(one, top, pivotal, langs, concepts)
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line int, text string")
