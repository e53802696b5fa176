"""Connected components of a graph given as links (a, b), without a driver-side union-find.

Each task first reduces its links to a spanning forest of what it holds; what is left is either finished in
one task, if its checked size allows, or by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.session import Scratch

LINKS_PER_TASK = 2_000_000


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the links and for each the smallest vertex of its component, by hooking and jumping."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        live = lo < hi
        if not live.any():
            break
        x, y, lo, hi = x[live], y[live], lo[live], hi[live]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return ids, ids[root]


def _forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in it if b.num_rows]
    if not got:
        return
    ids, low = labels_of(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
    yield pa.RecordBatch.from_pydict({"a": ids, "b": low})


def components(links: DataFrame, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(id, component): for every id that occurs in ``links`` (a, b: long) the smallest id it is linked with.

    Links with a null end are left out; repeated links and self-links do no harm; an empty table gives none."""
    spark = links.sparkSession
    scratch = Scratch(spark)
    clean = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    cur = scratch.keep(clean.mapInArrow(_forest, "a long, b long"))
    n = cur.count()
    if n > links_per_task:
        parts = max(spark.sparkContext.defaultParallelism, -(-n // links_per_task))
        new = scratch.keep(cur.repartition(parts, "b").mapInArrow(_forest, "a long, b long"))
        scratch.drop(cur)
        cur, n = new, new.count()
    if n <= links_per_task:
        return cur.repartition(1).mapInArrow(_forest, "id long, component long")
    all_ids = cur.select(F.col("a").alias("id")).distinct()
    cur = cur.filter("a <> b")
    while True:
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        step = scratch.keep(large)
        down = step.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        new = scratch.keep(small.select("l.a", "l.b").filter("a <> b").distinct())
        same = new.count() == cur.count() and not new.join(cur.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti").limit(1).count()
        scratch.drop(cur, step)
        cur = new
        if same:
            break
    found = cur.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return all_ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
