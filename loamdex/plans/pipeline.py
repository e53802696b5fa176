"""Queries of the general pipeline problems (4 and 7) and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.operators import changes, hierarchy


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(_t(spark, d, "nodes")).select("id", "root_id", "depth")


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.paths(hierarchy.hierarchy(_t(spark, d, "nodes")))
    return out.select("id", "root_id", "depth", "n_descendants", "on_circle", F.array_join("path", "/").alias("path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_pairs(hierarchy.paths(hierarchy.hierarchy(_t(spark, d, "nodes"))))


def p4_circles(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.circles(hierarchy.hierarchy(_t(spark, d, "nodes")))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return changes.pending_files(_t(spark, d, "tree_scan"), _t(spark, d, "merkle_files"), _t(spark, d, "index_runs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).select("repo", "file_path")


def p7_pending(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d)


_TREE = """
WITH RECURSIVE v AS (SELECT id, min(parent_id) AS p FROM nodes WHERE id IS NOT NULL GROUP BY id),
f AS (SELECT v.id, q.id AS p FROM v LEFT JOIN v q ON v.p = q.id),
t AS (SELECT id, id AS root_id, 0 AS depth, CAST(id AS VARCHAR) AS path FROM f WHERE p IS NULL
      UNION ALL SELECT f.id, t.root_id, t.depth + 1, t.path || '/' || CAST(f.id AS VARCHAR) FROM t JOIN f ON f.p = t.id),
lost AS (SELECT f.id, f.p FROM f ANTI JOIN t ON f.id = t.id),
r AS (SELECT id, p AS up FROM lost UNION SELECT r.id, lost.p FROM r JOIN lost ON r.up = lost.id),
ring AS (SELECT id FROM r WHERE id = up),
c AS (SELECT r.id, min(r.up) AS root_id FROM r JOIN ring ON r.up = ring.id GROUP BY r.id),
anc AS (SELECT t.id, f.p AS up, 1 AS distance FROM t JOIN f ON t.id = f.id WHERE f.p IS NOT NULL
        UNION ALL SELECT anc.id, f.p, anc.distance + 1 FROM anc JOIN f ON anc.up = f.id WHERE f.p IS NOT NULL)
"""

_PENDING = r"""
WITH s AS (SELECT repo, regexp_replace(regexp_replace(regexp_replace(trim(file_path), '\\', '/', 'g'), '/(\./|/)+', '/', 'g'), '^(\./|/)+', '') AS file_path,
                  nullif(regexp_replace(lower(trim(blob_sha)), '^[a-z0-9-]+:', ''), '') AS blob_sha, scanned_at FROM tree_scan),
m AS (SELECT repo, regexp_replace(regexp_replace(regexp_replace(trim(file_path), '\\', '/', 'g'), '/(\./|/)+', '/', 'g'), '^(\./|/)+', '') AS file_path,
             nullif(regexp_replace(lower(trim(blob_sha)), '^[a-z0-9-]+:', ''), '') AS blob_sha, last_indexed_at FROM merkle_files),
k AS (SELECT m.*, (SELECT max_by(status, started_at) FROM index_runs r WHERE r.started_at <= m.last_indexed_at) AS status FROM m),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY scanned_at DESC, blob_sha DESC NULLS LAST) AS i FROM s) WHERE i = 1 AND blob_sha IS NOT NULL),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY last_indexed_at DESC, blob_sha DESC NULLS LAST) AS i FROM k WHERE status = 'succeeded') WHERE i = 1)
"""

QUERIES = {f.__name__: f for f in (p4_found, p4_hierarchy, p4_descendants, p4_circles, p7_found, p7_pending)}

SQL = {
    "p4_found": _TREE + "SELECT id, root_id, depth FROM t UNION ALL SELECT id, root_id, -1 FROM c",
    "p4_hierarchy": _TREE
    + """, n AS (SELECT up, count(*) AS n FROM anc GROUP BY up)
SELECT t.id, root_id, depth, coalesce(n.n, 0) AS n_descendants, false AS on_circle, path FROM t LEFT JOIN n ON t.id = n.up
UNION ALL SELECT c.id, root_id, -1, NULL, ring.id IS NOT NULL, NULL FROM c LEFT JOIN ring ON c.id = ring.id""",
    "p4_descendants": _TREE + "SELECT up AS ancestor_id, id, distance FROM anc",
    "p4_circles": _TREE
    + """SELECT root_id, count(ring.id) AS n_on_circle, count(*) - count(ring.id) AS n_below
FROM c LEFT JOIN ring ON c.id = ring.id GROUP BY root_id""",
    "p7_found": _PENDING + "SELECT n.repo, n.file_path FROM n LEFT JOIN g USING (repo, file_path) WHERE g.blob_sha IS NULL OR g.blob_sha <> n.blob_sha",
    "p7_pending": _PENDING
    + """SELECT n.repo, n.file_path, n.blob_sha, CASE WHEN g.repo IS NULL THEN 'new' ELSE 'changed' END AS reason
FROM n LEFT JOIN g ON n.repo = g.repo AND n.file_path = g.file_path WHERE g.blob_sha IS NULL OR g.blob_sha <> n.blob_sha""",
}
