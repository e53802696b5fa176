"""Delta planning by content hash, cascading deletes, the embedding cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.session import Scratch


def digest(c: Column | str) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def merkle_root(files: DataFrame, path: str = "file_path", sha: str = "blob_sha") -> DataFrame:
    """One row ``root``: sha256 over path, NUL, digest, NUL of all files in order of path, the larger digest where a
    path has two. Files are sorted in ranges; the digest runs over them in one task, which holds a batch at a time and
    some 150 bytes a file pass through it. :func:`merkle_fold` is a digest without such a task."""
    pairs = files.dropna(subset=[path, sha]).groupBy(F.col(path).alias("p")).agg(F.max(sha).alias("s"))
    line = pairs.select("p", F.concat("p", F.lit("\u0000"), "s", F.lit("\u0000")).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha256()
        for b in batches:
            for x in b.column("line").to_pylist():
                h.update(x.encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_pydict({"root": [h.hexdigest()]})

    # An empty line, which adds nothing to the digest, keeps the task where there are no files.
    line = line.unionByName(files.sparkSession.range(1).select(F.lit("").alias("p"), F.lit("").alias("line")))
    return line.repartition(1).sortWithinPartitions("p").select("line").mapInArrow(run, "root string")


def merkle_fold(files: DataFrame, path: str = "file_path", sha: str = "blob_sha") -> DataFrame:
    """One row ``root``, another digest than :func:`merkle_root`: sha256 of the digests of 256 groups of files by the
    hash of their path, each that of its sorted lines, so that no task sees all files."""
    g = F.substring(F.sha2(path, 256), 1, 2)
    pair = F.concat(F.col(path), F.lit("\u0000"), F.col(sha), F.lit("\u0000"))
    per = files.dropna(subset=[path, sha]).groupBy(g.alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(pair)), ""), 256).alias("d"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), ""), 256).alias("root"))


def delta(before: DataFrame, after: DataFrame, keys: list[str], sha: str = "blob_sha") -> DataFrame:
    """(keys, status): added, modified, removed or unchanged."""
    a = before.select(*keys, F.col(sha).alias("_a"), F.lit(True).alias("_ina"))
    b = after.select(*keys, F.col(sha).alias("_b"), F.lit(True).alias("_inb"))
    status = F.when(F.col("_ina").isNull(), "added").when(F.col("_inb").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("modified")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], chunks: DataFrame, files: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Tables without the rows of the chunks of ``files``: name -> (table, its chunk id column); "chunks" is added."""
    gone = chunks.join(files.select(*keys).distinct(), keys, "left_semi").select(F.col("id").alias("_gone")).distinct()
    out = {n: d.join(gone, F.col(c) == F.col("_gone"), "left_anti") for n, (d, c) in tables.items()}
    out["chunks"] = chunks.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    return out


def cache_lookup(chunks: DataFrame, cache: DataFrame, model: str, dim: int) -> DataFrame:
    """(content_hash, hit): every distinct hash of the chunks and whether the cache holds a vector of the model and
    the right length; the misses are what has to be embedded."""
    want = chunks.select("content_hash").dropna().distinct()
    have = cache.filter((F.col("model_id") == model) & (F.size("embedding") == dim)).select("content_hash", F.lit(True).alias("h")).distinct()
    return want.join(have, "content_hash", "left").select("content_hash", F.coalesce("h", F.lit(False)).alias("hit"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of both tables, of equal keys the one with the largest ``at``, the new table's on ties."""
    cols = old.columns
    both = old.withColumn("_n", F.lit(0)).unionByName(new.select(*cols).withColumn("_n", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col(at), F.col("_n"))).alias("_r")).select("_r.*")


#: Metadata of an embedder that an index must share with a run that updates it.
EMBEDDER = ("model", "dim", "quant")


def update_policy(old: dict | None, new: dict, delta_: DataFrame | None, indexed_without_row: int = 0) -> tuple[str, str]:
    """(action, reason) of the next run: ``full``, ``update``, ``none`` or ``abort``.

    Without an index, or with indexed files that the log of files doesn't know, everything is built anew. Another
    embedder means a full build if dimension and quantisation are the same, else the run is given up. Without a changed
    file and with current clusters nothing is done, so no model is loaded. ``delta_`` has a column status."""
    if old is None:
        return "full", "no index"
    if indexed_without_row:
        return "full", f"{indexed_without_row} indexed files without a row in the log"
    if any(old.get(k) != new.get(k) for k in EMBEDDER[1:]):
        return "abort", "another dimension or quantisation"
    if old.get("model") != new.get("model"):
        return "full", "another embedder"
    changed = delta_.filter("status <> 'unchanged'").limit(1).count() if delta_ is not None else 0
    if changed:
        return "update", "files changed"
    return ("none", "nothing changed") if old.get("clusters_current") else ("update", "clusters are not current")


def apply_update(old_chunks: DataFrame, new_chunks: DataFrame, delta_: DataFrame, keys: list[str], failed: DataFrame | None = None) -> DataFrame:
    """Chunks after an update: those of unchanged files with their ids, those of added and modified files anew with ids
    that go on from the largest, none of removed files. Files of ``failed`` (keys) keep the rows they had.

    New ids are given in order of file and start_byte within ranges, and ranges by what the ranges before hold."""
    todo = delta_.filter("status <> 'unchanged'").select(*keys, "status")
    if failed is not None:
        todo = todo.join(failed.select(*keys).distinct(), keys, "left_anti")
    kept = old_chunks.join(todo.select(*keys), keys, "left_anti").select(*old_chunks.columns)
    fresh = new_chunks.join(todo.filter("status <> 'removed'").select(*keys), keys, "left_semi")
    top = old_chunks.agg(F.max("id")).first()[0] or 0
    order = [*keys, "start_byte"]
    scratch = Scratch(old_chunks.sparkSession)
    laid = scratch.keep(fresh.drop("id").repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    at, rows = top + 1, []
    for p, n, low in sorted((r._p, r.n, r.low) for r in laid.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("low")).collect()):  # one row a partition
        rows.append((p, at - low))
        at += n
    shift = F.broadcast(old_chunks.sparkSession.createDataFrame(rows, "_p int, _s long"))
    return kept.unionByName(laid.join(shift, "_p").withColumn("id", F.col("_m") + F.col("_s")).select(*kept.columns))
