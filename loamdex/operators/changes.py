"""Processing only new or changed records, without losing a change or doing one twice.

A run log says which runs there were and how they ended; a ledger has one row for each key and version that
some run wrote. Work for the next run is what the source shows from the *low watermark* on, minus the
key-and-version pairs that the ledger already holds for the key. The low watermark is the start of the oldest
run that was still open when the last successful run started, so overlap is reread on purpose and the
anti-join removes it: rereading makes failures harmless, the ledger makes rereading harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs and ledger rows meet on buckets of this many seconds, so the as-of join is an equality join.
BUCKET_S = 86_400


def clean_path(c: Column | str) -> Column:
    """One spelling of a path: forward slashes, no ``.`` segments, no doubled or leading slash, no outer spaces."""
    p = F.regexp_replace(F.trim(c), r"\\", "/")
    p = F.regexp_replace(p, r"/(?:\./|/)+", "/")
    return F.regexp_replace(p, r"^(?:\./|/)+", "")


def clean_digest(c: Column | str) -> Column:
    """One spelling of a digest: lower case without an algorithm prefix such as ``sha256:``; blank is null."""
    d = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z0-9-]+:", "")
    return F.when(d != "", d)


#: Runs that are sent to every task; one takes some 50 bytes.
RUNS = 200_000


def run_of(rows: DataFrame, runs: DataFrame, at: str, bucket_s: int = BUCKET_S) -> DataFrame:
    """Adds ``run_id`` and ``run_status`` of the last run with started_at <= ``at``; rows before every run, or
    with a null time, are left out. Runs must not overlap. Of runs with equal started_at the largest run_id counts.

    Every run is laid over the buckets from its start to the next run's start, and rows join on their bucket, so no
    pair of rows is compared that isn't in one bucket. Up to RUNS runs are sent to every task after they are
    counted, so that rows stay where they are however many fall on one day; more are joined by shuffle.
    """
    # The run log is one row a run: the window sorts runs, never rows, within a bucket of 64 weeks.
    starts = runs.filter("started_at is not null").groupBy("started_at").agg(F.max(F.struct("run_id", "status")).alias("r"))
    starts = starts.select("started_at", F.col("r.run_id").alias("run_id"), F.col("r.status").alias("run_status"))
    b = F.floor(F.col("started_at") / bucket_s).cast("long")
    days = starts.groupBy(b.alias("b")).agg(F.max(F.struct("started_at", "run_id", "run_status")).alias("final"))
    # In a bucket: the runs that start in it, and the last one before it. Buckets without a run take the last before.
    here = starts.withColumn("b", b)
    wanted = rows.filter(F.col(at).isNotNull()).withColumn("_b", F.floor(F.col(at) / bucket_s).cast("long"))
    seen = wanted.select(F.col("_b").alias("b")).distinct()
    # All buckets: as many as days, so one ordered pass over them is small whatever the number of rows.
    marks = seen.unionByName(days.select("b")).distinct().join(days, "b", "left")
    before = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("b", F.last("final", ignorenulls=True).over(before).alias("p")).filter("p is not null")
    lines = here.unionByName(carried.select(F.col("p.started_at").alias("started_at"), F.col("p.run_id").alias("run_id"), F.col("p.run_status").alias("run_status"), "b"))
    per_bucket = lines.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("started_at", "run_id", "run_status"))).alias("starts"))
    if starts.limit(RUNS + 1).count() <= RUNS:
        per_bucket = F.broadcast(per_bucket)
    hit = F.element_at(F.filter("starts", lambda s: s["started_at"] <= F.col(at)), -1)
    joined = wanted.join(per_bucket.withColumnRenamed("b", "_b"), "_b").filter(F.exists("starts", lambda s: s["started_at"] <= F.col(at)))
    return joined.withColumn("_run", hit).select(*rows.columns, F.col("_run.run_id").alias("run_id"), F.col("_run.run_status").alias("run_status"))


def low_watermark(runs: DataFrame) -> DataFrame:
    """One row ``watermark`` (epoch seconds): the start of the oldest run that was open when the last successful
    run started. A run is open from started_at to finished_at; a run without an end that is not marked as
    running ended when the next run started, since runs don't overlap. Null if no run has succeeded, which
    means to read everything."""
    ok = F.col("status") == "succeeded"
    last = runs.filter(ok).agg(F.max("started_at").alias("last"))
    open_ = runs.filter("started_at is not null").crossJoin(F.broadcast(last)).filter("started_at <= last")
    return open_.filter((F.col("started_at") == F.col("last")) | (F.col("finished_at") > F.col("last")) | (F.col("finished_at").isNull() & (F.col("status") == "running"))).agg(
        F.min("started_at").alias("watermark")
    )


def pending(
    seen: DataFrame, ledger: DataFrame, keys: list[str], version: str, seen_at: str, written_at: str
) -> DataFrame:
    """Keys whose newest version in ``seen`` is not the newest version in ``ledger``: ``keys`` and ``version``.

    ``seen`` holds observations; the one with the largest ``seen_at`` holds for a key, ties going to the larger
    version, and a null version there says that the record is gone. ``ledger`` holds versions that were
    processed; the largest ``written_at`` counts, ties going to the larger version. Rows with a null key are
    left out; a null time sorts before all others. Both sides are reduced with partial aggregates before the
    shuffle, so a key with a third of all rows costs one row a task.
    """
    # A struct with a null version sorts before one with a value, as max() takes nulls to be smallest.
    newest = lambda d, at: d.dropna(subset=keys).groupBy(*keys).agg(F.max(F.struct(F.col(at), F.col(version))).alias("_m")).select(*keys, F.col(f"_m.{version}").alias(version))
    now = newest(seen, seen_at).filter(F.col(version).isNotNull())
    done = newest(ledger, written_at)
    return now.join(done, [*keys, version], "left_anti")


def changed_since(
    source: DataFrame, ledger: DataFrame, watermark: DataFrame, keys: list[str], version: str, changed_at: str
) -> DataFrame:
    """Records of an append-only ``source`` that the next run has to process, each key-and-version pair once.

    Reads from the watermark on (one row, one column; null reads everything), which partition and row-group
    pruning can use once it is a literal, and removes pairs that ``ledger`` holds. Rows with a null key or
    version are left out; repeated pairs give the row with the largest ``changed_at``, a null one last."""
    since = watermark.first()[0]  # one row by construction
    rows = source if since is None else source.filter(F.col(changed_at) >= since)
    rows = rows.dropna(subset=[*keys, version])
    todo = rows.groupBy(*keys, version).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.coalesce(F.col(changed_at), F.lit(-(2**62)))).alias("_r"))
    todo = todo.select("_r.*")
    return todo.join(ledger.select(*keys, version).distinct(), [*keys, version], "left_anti")


def pending_files(tree_scan: DataFrame, merkle_files: DataFrame, index_runs: DataFrame) -> DataFrame:
    """Files that the next run has to process: ``repo, file_path, blob_sha, reason``.

    Only rows of the log whose run succeeded are in the ledger, so what failed, aborted or running runs wrote
    is done again. A file's last scan holds however old it is: a file that was missed stays pending until a
    run that succeeds has written its digest. ``reason`` is ``new`` (no counting row) or ``changed``.
    """
    scans = tree_scan.select("repo", clean_path("file_path").alias("file_path"), clean_digest("blob_sha").alias("blob_sha"), "scanned_at")
    log = merkle_files.select("repo", clean_path("file_path").alias("file_path"), clean_digest("blob_sha").alias("blob_sha"), "last_indexed_at")
    counted = run_of(log, index_runs, "last_indexed_at").filter(F.col("run_status") == "succeeded")
    todo = pending(scans, counted, ["repo", "file_path"], "blob_sha", "scanned_at", "last_indexed_at")
    known = counted.select("repo", "file_path", F.lit(True).alias("known")).distinct()
    reason = F.when(F.col("known"), "changed").otherwise("new").alias("reason")
    return todo.join(known, ["repo", "file_path"], "left").select("repo", "file_path", "blob_sha", reason)
