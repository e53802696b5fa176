"""Parent-child links of unknown depth to full hierarchies.

The plan, in the order it runs:

1. *Peeling.* Peeling 2^k layers of leaves leaves exactly the image of the 2^k-fold parent map, so layers
   are peeled by doubling. Ids that reach a root drop out; what never drops out hangs on a circle.
2. *Cutting.* Each circle is cut at all of its members, which become roots of their own trees.
3. *Euler tour.* Every node gives two arcs, down and up; the successor of each arc is found with one
   aggregate and one window whose groups are salted, so that a parent with a third of all rows as
   children is no hot group.
4. *List ranking.* Each range partition first shortens its own stretches of the tour in numpy, so only the
   arcs at which the tour enters a partition are left for the distributed pointer doubling.
5. Entry and exit positions give root, depth, number of descendants and, in tour order, paths.

No step collects a tree to one task: memory per task is bounded by ``rows_per_task``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamdex.session import Scratch

#: Children of one parent are ordered within this many salt buckets, so one parent is never one sort group.
SALT = 64
ROWS_PER_TASK = 250_000


def _parts(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def _stretch(nxt: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Follow ``nxt`` (local positions, -1 where it leaves) to the last local element.

    Returns last element, summed weights (rows of ``w``) from the element to the last one, and whether the
    element runs into a local circle."""
    n = len(nxt)
    last = np.where(nxt < 0, np.arange(n), nxt)
    total = np.where((nxt < 0)[:, None], 0, w)
    for _ in range(max(1, n).bit_length() + 1):
        if (last[last] == last).all():
            break
        total = total + total[last]
        last = last[last]
    looped = nxt[last] >= 0
    return last, total + w[last], looped


def _shorten(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range partition of (k, s, nk, ns, n, w, end): every element with its exit (nk, ns) from this
    partition, or the end of its list, and the count and weight up to there. An element with neither an exit
    nor an end runs into a circle."""
    got = [b for b in it if len(b)]
    if not got:
        return
    p = pd.concat(got, ignore_index=True)
    has = p["nk"].notna().to_numpy()
    nxt = np.full(len(p), -1, dtype=np.int64)
    if has.any():
        key = pd.MultiIndex.from_arrays([p["k"].astype("int64"), p["s"].astype("int8")])
        nxt[has] = key.get_indexer(pd.MultiIndex.from_arrays([p.loc[has, "nk"].astype("int64"), p.loc[has, "ns"].astype("int8")]))
    last, total, looped = _stretch(nxt, p[["n", "w"]].to_numpy(dtype=np.int64))
    leaves, ends = has[last] & ~looped, ~has[last] & ~looped
    at = lambda c, kind: pd.array(p[c], dtype=kind).take(last)
    out = pd.DataFrame({"k": p["k"], "s": p["s"], "nk": at("nk", "Int64"), "ns": at("ns", "Int8"), "n": total[:, 0], "w": total[:, 1], "end": at("end", "Int64")})
    yield out.assign(nk=out["nk"].where(leaves), ns=out["ns"].where(leaves), end=out["end"].where(ends))


_LINK = "k long, s byte, nk long, ns byte, n long, w long, end long"


def _rank(lists: DataFrame, scratch: Scratch, rows: int, rows_per_task: int) -> DataFrame:
    """Rank linked lists given as (k, s, nk, ns, w): element (k, s), successor (nk, ns) or null, weight.

    Returns (k, s, n, w, end): the number and weight of elements from this one to the end of its list and the
    key of the last element; ``end`` is null for elements that run into a circle."""
    one = F.lit(1).cast("long")
    lists = lists.select("k", "s", "nk", "ns", one.alias("n"), "w", F.when(F.col("nk").isNull(), F.col("k")).alias("end"))
    parts = _parts(lists.sparkSession, rows, rows_per_task)
    local = scratch.keep(lists.repartitionByRange(parts, "k", "s").mapInPandas(_shorten, _LINK))
    entered = local.filter("nk is not null").select(F.col("nk").alias("k"), F.col("ns").alias("s")).distinct()
    heads = scratch.keep(local.join(entered, ["k", "s"], "left_semi"))
    before, n_heads = None, heads.count()
    while n_heads > rows_per_task:
        going = heads.filter("nk is not null")
        open_ = going.count()
        if not open_ or open_ == before:  # no list ends between 2^k and 2^(k+1) elements on: the rest are circles
            heads = heads.withColumn("nk", F.lit(None).cast("long"))
            break
        before = open_
        far = heads.select(
            F.col("k").alias("nk"), F.col("s").alias("ns"), F.col("n").alias("n2"), F.col("w").alias("w2"),
            F.col("nk").alias("k3"), F.col("ns").alias("s3"), F.col("end").alias("e2"),
        )
        step = going.join(far, ["nk", "ns"]).select(
            "k", "s", F.col("k3").alias("nk"), F.col("s3").alias("ns"), (F.col("n") + F.col("n2")).alias("n"),
            (F.col("w") + F.col("w2")).alias("w"), F.col("e2").alias("end"),
        )
        new = scratch.keep(heads.filter("nk is null").unionByName(step))
        scratch.drop(heads)
        heads = new
    if n_heads <= rows_per_task:  # a checked size: what is left fits one task
        heads = heads.repartition(1).mapInPandas(_shorten, _LINK)
    tail = heads.select(F.col("k").alias("nk"), F.col("s").alias("ns"), F.col("n").alias("n2"), F.col("w").alias("w2"), F.col("end").alias("e2"))
    far = local.filter("nk is not null").join(tail, ["nk", "ns"]).select(
        "k", "s", (F.col("n") + F.col("n2")).alias("n"), (F.col("w") + F.col("w2")).alias("w"), F.col("e2").alias("end")
    )
    return local.filter("nk is null").select("k", "s", "n", "w", "end").unionByName(far)


def _peel(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Like :func:`_circles`, for a table of links that fits one task."""
    got = [b for b in it if len(b)]
    if not got:
        return
    p = pd.concat(got, ignore_index=True)
    ids = p["id"].to_numpy(dtype=np.int64)
    up = pd.Index(ids).get_indexer(p["parent"].to_numpy(dtype=np.int64))
    jump, left = up, len(ids) + 1
    while (now := len(np.unique(jump))) < left:
        left, jump = now, jump[jump]
    on = np.unique(jump)
    low, far = np.minimum(ids, ids[up]), up
    while True:
        new = np.minimum(low, low[far])
        if (new[on] == low[on]).all():
            break
        low, far = new, far[far]
    yield pd.DataFrame({"id": ids[on], "circle": low[on]})


def _circles(loops: DataFrame, scratch: Scratch, rows_per_task: int) -> DataFrame:
    """Of nodes that never reach a root (id, parent): those on circles, with the smallest id of the circle.

    The image of the 2^k-fold parent map is what is left after peeling 2^k layers of leaves."""
    if loops.count() <= rows_per_task:
        return loops.repartition(1).mapInPandas(_peel, "id long, circle long")
    jump = scratch.keep(loops.select("id", F.col("parent").alias("j")))
    left = jump.select("j").distinct().count()
    while True:
        far = jump.select(F.col("id").alias("j"), F.col("j").alias("j2"))
        new = scratch.keep(jump.join(far, "j").select("id", F.col("j2").alias("j")))
        scratch.drop(jump)
        jump = new
        now = jump.select("j").distinct().count()
        if now == left:
            break
        left = now
    on = jump.select(F.col("j").alias("id")).distinct()
    ring = scratch.keep(loops.join(on, "id", "left_semi").select("id", F.col("parent").alias("j"), F.least("id", "parent").alias("m")))
    scratch.drop(jump)
    while True:
        far = ring.select(F.col("id").alias("j"), F.col("j").alias("j2"), F.col("m").alias("m2"))
        new = scratch.keep(
            ring.join(far, "j").select("id", F.col("j2").alias("j"), F.least("m", "m2").alias("m"), (F.col("m2") < F.col("m")).alias("fell"))
        )
        scratch.drop(ring)
        ring = new
        if not ring.filter("fell").limit(1).count():
            break
    return ring.select("id", F.col("m").alias("circle"))


def hierarchy(
    links: DataFrame, id_col: str = "id", parent_col: str = "parent_id", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """One row for each distinct id: ``id, root_id, depth, entry, exit, n_descendants, on_circle``.

    A node whose parent is null or is no id of the table is a root: depth 0, itself as root_id. ``entry`` and
    ``exit`` are positions in the Euler tour of the root's tree, so ``d`` is a descendant of ``a`` exactly if
    both have the same root and a.entry < d.entry and d.exit < a.exit. A node on a circle or below one gets
    depth -1, the smallest id on the circle as root_id and null entry, exit and n_descendants; on_circle
    tells the two apart (a row that is its own parent is a circle of one).

    Rows with a null id are left out. Repeated ids give one row; if their parents differ the smallest parent
    counts. An empty table gives an empty result. Other columns are not read, so their names can't clash.
    """
    spark = links.sparkSession
    scratch = Scratch(spark)
    rows = links.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent")).filter("id is not null")
    rows = rows.groupBy("id").agg(F.min("parent").alias("parent"))
    known = rows.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    # Null parents are joined nowhere: they would all meet in one task.
    linked = rows.filter("parent is not null").join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))
    tree = scratch.keep(linked.unionByName(rows.filter("parent is null")))
    n = tree.count()
    up = _rank(
        tree.select(
            F.col("id").alias("k"), F.lit(0).cast("byte").alias("s"), F.col("parent").alias("nk"),
            F.when(F.col("parent").isNotNull(), F.lit(0).cast("byte")).alias("ns"), F.lit(1).cast("long").alias("w"),
        ), scratch, n, rows_per_task,
    )
    looped = scratch.keep(up.filter("end is null").select(F.col("k").alias("id")))
    circles = None
    if looped.limit(1).count():
        circles = scratch.keep(_circles(tree.join(looped, "id", "left_semi"), scratch, rows_per_task))
        cut = scratch.keep(
            tree.join(circles.select("id", F.lit(True).alias("cut")), "id", "left")
            .select("id", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"))
        )
        scratch.drop(tree)
        tree = cut
    ranked = _rank(_tour(tree), scratch, 2 * n, rows_per_task)
    nodes = ranked.groupBy("k").agg(
        F.max(F.when(F.col("s") == 0, F.col("n"))).alias("down"), F.max(F.when(F.col("s") == 1, F.col("n"))).alias("up"),
        F.max(F.when(F.col("s") == 0, -F.col("w"))).alias("depth"), F.first("end").alias("root"),
    )
    nodes = nodes.select(F.col("k").alias("id"), "root", "depth", "down", "up")
    # The down arc of a root counts the arcs of its tree; positions count from there.
    sizes = nodes.filter("id = root").select("root", F.col("down").alias("size"))
    out = nodes.join(sizes, "root").select(
        "id", F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"),
        (F.col("size") - F.col("down")).alias("entry"), (F.col("size") - F.col("up")).alias("exit"),
        ((F.col("down") - F.col("up") - 1) / 2).cast("long").alias("n_descendants"),
    )
    if circles is None:
        return out.withColumn("on_circle", F.lit(False))
    ring = circles.select(F.col("id").alias("root_id"), "circle")
    none: Column = F.lit(None).cast("long")
    off = F.col("circle").isNotNull()
    return out.join(ring, "root_id", "left").select(
        "id", F.when(off, F.col("circle")).otherwise(F.col("root_id")).alias("root_id"),
        F.when(off, F.lit(-1)).otherwise(F.col("depth")).alias("depth"),
        *[F.when(off, none).otherwise(F.col(c)).alias(c) for c in ("entry", "exit", "n_descendants")],
        (off & (F.col("depth") == 0)).alias("on_circle"),
    )


def _tour(tree: DataFrame) -> DataFrame:
    """The arcs of the Euler tours of a forest (id, parent), as (k, s, nk, ns, w); s is 0 for down, 1 for up."""
    kids = tree.filter("parent is not null").select("id", "parent", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("b"))
    inner = Window.partitionBy("parent", "b").orderBy("id")
    kids = kids.withColumn("sib", F.lead("id").over(inner))
    # First child of each (parent, bucket); at most SALT rows a parent, so the second window is small.
    buckets = kids.groupBy("parent", "b").agg(F.min("id").alias("first"), F.max("id").alias("final"))
    outer = Window.partitionBy("parent").orderBy("b")
    buckets = buckets.withColumn("then", F.lead("first").over(outer))
    firsts = buckets.groupBy("parent").agg(F.min(F.struct("b", "first")).alias("f")).select(F.col("parent").alias("id"), F.col("f.first").alias("first"))
    finals = buckets.filter("then is not null").select(F.col("final").alias("id"), "then")
    arcs = (
        tree.join(firsts, "id", "left")
        .join(kids.select("id", "sib").filter("sib is not null"), "id", "left")
        .join(finals, "id", "left")
        .withColumn("sib", F.coalesce("sib", "then"))
    )
    t = lambda v: F.lit(v).cast("byte")
    down = F.struct(
        t(0).alias("s"), F.coalesce("first", "id").alias("nk"), F.when(F.col("first").isNotNull(), t(0)).otherwise(t(1)).alias("ns"),
        F.lit(1).cast("long").alias("w"),
    )
    up = F.struct(
        t(1).alias("s"), F.coalesce("sib", "parent").alias("nk"),
        F.when(F.col("sib").isNotNull(), t(0)).when(F.col("parent").isNotNull(), t(1)).alias("ns"), F.lit(-1).cast("long").alias("w"),
    )
    return arcs.select(F.col("id").alias("k"), F.explode(F.array(down, up)).alias("a")).select("k", "a.s", "a.nk", "a.ns", "a.w")


def paths(nodes: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds ``path`` (array of ids from the root to the node) to the result of :func:`hierarchy`.

    Nodes are laid out in tour order; each range partition keeps the stack of open intervals. The stack at
    its start is the set of intervals that contain its first node: only intervals that are open at the end of
    their own partition can be in it, no more than a tree is deep for each partition. Nodes on or below circles
    get a null path."""
    spark = nodes.sparkSession
    scratch = Scratch(spark)
    kept = scratch.keep(nodes)
    trees = kept.filter("depth >= 0")
    laid = scratch.keep(
        trees.repartitionByRange(_parts(spark, kept.count(), rows_per_task), "root_id", "entry").withColumn("pid", F.spark_partition_id())
    )
    firsts = laid.groupBy("pid").agg(F.min(F.struct("root_id", "entry", "exit")).alias("f")).select("pid", "f.*")
    cols = laid.columns
    # One row for each range partition: bounded by the number of tasks.
    above = F.broadcast(firsts.select("pid", "root_id", F.col("entry").alias("e0"), F.col("exit").alias("x0")))
    lasts = F.broadcast(laid.groupBy("pid").agg(F.max(F.struct("root_id", "entry")).alias("l")))
    still = laid.join(lasts, "pid").filter((F.col("root_id") == F.col("l.root_id")) & (F.col("exit") > F.col("l.entry")))
    opened = still.select("root_id", F.col("id").alias("aid"), F.col("entry").alias("a0"), F.col("exit").alias("a1"))
    stacks = opened.join(above, "root_id").filter("a0 < e0 and a1 > x0").select(F.col("pid").alias("apid"), "aid", "a0", "a1")

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["root_id", "entry"])
        right = right.sort_values("a0")
        stack = list(zip(right["aid"], right["a1"]))
        root, out = (left["root_id"].iloc[0] if len(left) else None), []
        for i, r, e, x in zip(left["id"], left["root_id"], left["entry"], left["exit"]):
            if r != root:
                stack, root = [], r
            while stack and stack[-1][1] < e:
                stack.pop()
            stack.append((i, x))
            out.append([s[0] for s in stack])
        return left.assign(path=out)[[*cols[:-1], "path"]]

    schema = ", ".join(f"{n} {t}" for n, t in laid.drop("pid").dtypes) + ", path array<long>"
    done = laid.groupBy("pid").cogroup(stacks.groupBy("apid")).applyInPandas(walk, schema)
    return done.unionByName(kept.filter("depth < 0").withColumn("path", F.lit(None).cast("array<long>")))


def descendant_pairs(with_paths: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance) for every node and each of its proper ancestors; the size of the result is
    the sum of all depths, and no group is formed to make it."""
    return (
        with_paths.filter("size(path) > 1")
        .select("id", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "ancestor_id"), "depth")
        .select("ancestor_id", "id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
    )


def circles(nodes: DataFrame) -> DataFrame:
    """Parent links that run in circles: root_id (smallest id on the circle), n_on_circle, n_below."""
    return (
        nodes.filter("depth = -1")
        .groupBy("root_id")
        .agg(F.count_if("on_circle").alias("n_on_circle"), F.count_if(~F.col("on_circle")).alias("n_below"))
    )
