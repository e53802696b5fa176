"""Clusters of mutually similar records: reciprocal-nearest-neighbour average linkage on a sparse graph.

The graph holds each vector's nearest neighbours above the similarity threshold. The same pass of the vector index
also says what all pairs above the threshold that it scored join, so components are whole though no task hands on
more than a few links a vector. Average linkage never joins what the graph doesn't connect, so components are
clustered apart: all that fit a task together in vectorised rounds, the larger ones in distributed rounds. Every round merges
all mutual best pairs at once; the average similarity of two clusters is exact, being the product of their
vector sums over the product of their sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm import vectors as V
from loamdex.operators.components import components
from loamdex.session import Scratch

#: A component with more vectors than this is clustered in distributed rounds.
VECTORS_PER_TASK = 150_000


def linkage(x: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster number of each row of ``x`` (unit vectors): the smallest row of its cluster.

    ``a``, ``b``: links between rows. Pairs are ordered by (similarity, smaller row, smaller row), so ties
    have one outcome whatever the order of the input."""
    n = len(x)
    label = np.arange(n)
    sums, size = x.astype(np.float64) * weight[:, None], weight.astype(np.float64).copy()
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    keys = np.unique(lo[lo < hi] * n + hi[lo < hi])
    lo, hi = keys // n, keys % n
    sim = _average(sums, size, lo, hi)
    while len(lo):
        order = np.lexsort((hi, lo, -sim))
        back = order[::-1]
        best = np.full(n, -1)
        ends = np.stack([lo[back], hi[back]], axis=1).ravel()
        best[ends] = np.repeat(back, 2)  # of repeated ends the last one written, the best pair, stays
        e = np.arange(len(lo))
        merge = (best[lo] == e) & (best[hi] == e) & (sim >= threshold)
        if not merge.any():
            break
        to, gone = lo[merge], hi[merge]
        sums[to] += sums[gone]
        size[to] += size[gone]
        jump = np.arange(n)
        jump[gone] = to
        label = jump[label]
        touched = np.zeros(n, dtype=bool)
        touched[to] = True
        l2, h2 = jump[lo], jump[hi]
        l2, h2 = np.minimum(l2, h2), np.maximum(l2, h2)
        live = l2 < h2
        keys, first = np.unique(l2[live] * n + h2[live], return_index=True)
        sim = sim[live][first]
        lo, hi = keys // n, keys % n
        new = touched[lo] | touched[hi]
        sim[new] = _average(sums, size, lo[new], hi[new])
    return label


def _average(sums: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = np.empty(len(lo))
    for i in range(0, len(lo), 100_000):
        s = slice(i, i + 100_000)
        out[s] = np.einsum("nd,nd->n", sums[lo[s]], sums[hi[s]]) / (size[lo[s]] * size[hi[s]])
    return np.round(out, 9)


def _distributed(nodes: DataFrame, links: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """:func:`linkage` for components too large for a task. nodes: (vid, n, vec); links: (a, b)."""

    def sums(batches):  # noqa: ANN001, ANN202
        for b in batches:
            n = b.column("n").to_numpy().astype(np.float64)
            x = V._unit(V._bytes(b.column("vec"))).astype(np.float64) * n[:, None]
            yield pa.RecordBatch.from_arrays([b.column("vid"), pa.array(n), _lists(x)], names=["c", "n", "s"])

    cur = scratch.keep(nodes.select("vid", "n", "vec").mapInArrow(sums, "c long, n double, s array<double>"))
    label = scratch.keep(nodes.select("vid", F.col("vid").alias("c")))
    edges = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    while True:
        side = lambda x: cur.select(F.col("c").alias(x), F.col("n").alias("n" + x), F.col("s").alias("s" + x))
        dot = F.aggregate(F.zip_with("sa", "sb", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        scored = scratch.keep(edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(dot / (F.col("na") * F.col("nb")), 9).alias("sim")))
        pick = F.max(F.struct("sim", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))).alias("m")
        ends = scored.select(F.explode(F.array("a", "b")).alias("e"), "sim", "a", "b").groupBy("e").agg(pick)
        top = ends.select((-F.col("m.x")).alias("a"), (-F.col("m.y")).alias("b"), F.col("m.sim").alias("sim"))
        pairs = scratch.keep(top.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("sim").alias("sim")).filter(f"k = 2 and sim >= {threshold}").select("a", "b"))
        if not pairs.limit(1).count():
            return label
        moved = pairs.select(F.col("b").alias("c"), F.col("a").alias("to"))
        to = lambda d, col: d.join(moved.withColumnRenamed("c", col), col, "left").withColumn(col, F.coalesce("to", col)).drop("to")
        gone = cur.join(moved, "c").select(F.col("to").alias("c"), F.col("n").alias("n2"), F.col("s").alias("s2"))
        stay = cur.join(moved.select("c"), "c", "left_anti").join(gone, "c", "left")
        new = scratch.keep(stay.select("c", (F.col("n") + F.coalesce("n2", F.lit(0.0))).alias("n"), F.when(F.col("s2").isNull(), F.col("s")).otherwise(F.zip_with("s", "s2", lambda p, q: p + q)).alias("s")))
        e2 = to(to(edges, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
        e2, l2 = scratch.keep(e2), scratch.keep(to(label, "c"))
        scratch.drop(cur, edges, label, scored, pairs)
        cur, edges, label = new, e2, l2


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)), pa.array(x.ravel()))


def graph(vecs: DataFrame, index: V.Index, scratch: Scratch, threshold: float, k: int, **how: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of vids to their nearest neighbours, and components (vid, component): all that pairs with a
    cosine >= threshold join directly or through others, as far as the index scores them; with ``exact=True`` all."""
    found = scratch.keep(V.search(vecs, index, scratch, k, threshold, forest=True, **how))
    comp = scratch.keep(components(found.select("a", "b")).select(F.col("id").alias("vid"), "component"))
    return found.filter("cos is not null").select("a", "b"), comp


def clusters(
    cache: DataFrame, threshold: float = 0.70, k: int = 8, model: str = V.MODEL, vectors_per_task: int = VECTORS_PER_TASK, dim: int = V.DIM, **how: float
) -> DataFrame:
    """(content_hash, cluster_id, group_hash, membership): one row for every content hash that has a current
    vector with a neighbour above ``threshold`` (or an equal vector of another hash).

    cluster_id is the smallest content_hash of the cluster. membership is the cosine of the vector and the
    cluster's centroid, 0 if negative. group_hash is the smallest hash of the component of the graph the
    cluster lies in: what pairs above the threshold join directly or through others. Copies of a vector
    belong to its cluster and weigh in its centroid. ``how`` goes to the search; ``exact=True`` is without
    approximation. An empty cache gives an empty result."""
    spark = cache.sparkSession
    scratch = Scratch(spark)
    vecs, members = V.distinct_vectors(cache, scratch, model, dim)
    n = vecs.count()
    if not n:
        return members.select("content_hash", F.col("rep").alias("cluster_id"), F.col("rep").alias("group_hash"), F.lit(1.0).alias("membership")).limit(0)
    links, comp = graph(vecs, V.build(vecs, n, threshold), scratch, threshold, k, **how)
    sizes = scratch.keep(comp.groupBy("component").count())
    big = sizes.filter(F.col("count") > vectors_per_task).select("component")
    buckets = max(spark.sparkContext.defaultParallelism, -(-n // vectors_per_task))
    nodes = vecs.select("vid", "n", "vec").join(comp, "vid")
    edges = links.join(comp, links.a == comp.vid).select("a", "b", "component")
    small = lambda d: d.join(F.broadcast(big), "component", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))  # noqa: E731 at most n / vectors_per_task rows

    def rounds(v: pa.Table, e: pa.Table) -> pa.Table:
        if not v.num_rows:
            return pa.table({"vid": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
        vid = v.column("vid").to_numpy()
        order = np.argsort(vid)
        vid = vid[order]
        x = V._unit(V._bytes(v.column("vec")))[order]
        at = lambda c: np.searchsorted(vid, e.column(c).to_numpy())
        lab = linkage(x, v.column("n").to_numpy()[order], at("a"), at("b"), threshold)
        return pa.table({"vid": vid, "c": vid[lab]})

    done = small(nodes).select("bucket", "vid", "n", "vec").groupBy("bucket").cogroup(
        small(edges).select(F.col("bucket").alias("eb"), "a", "b").groupBy("eb")
    ).applyInArrow(rounds, "vid long, c long")
    if big.limit(1).count():
        hot = lambda d: d.join(F.broadcast(big), "component", "left_semi")
        done = done.unionByName(_distributed(hot(nodes), hot(edges), threshold, scratch))
    label = scratch.keep(done)
    # Copies of a vector that has no neighbour are a cluster of their own.
    alone = vecs.filter("n > 1").join(comp, "vid", "left_anti").select("vid", F.col("vid").alias("c"), F.col("vid").alias("component"))
    every = scratch.keep(label.join(comp, "vid").select("vid", "c", "component").unionByName(alone))
    names = vecs.select(F.col("vid").alias("c"), F.col("rep").alias("cluster_id"))
    groups = vecs.select(F.col("vid").alias("component"), F.col("rep").alias("group_hash"))
    full = scratch.keep(every.join(vecs.select("vid", "n", "vec"), "vid"))
    cent = centroids(full.select("c", "n", "vec"))

    def member(batches):  # noqa: ANN001, ANN202
        for b in batches:
            if b.num_rows:
                x, m = V._unit(V._bytes(b.column("vec"))).astype(np.float64), np.asarray(b.column("centroid").flatten()).reshape(b.num_rows, -1)
                cos = np.round(np.maximum(0.0, np.einsum("nd,nd->n", x, m)), 6)
                yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("c"), b.column("component"), pa.array(cos)], names=["vid", "c", "component", "membership"])

    scored = full.join(cent, "c").select("vid", "c", "component", "vec", "centroid").mapInArrow(member, "vid long, c long, component long, membership double")
    named = scratch.keep(scored.join(names, "c").join(groups, "component").select("vid", "cluster_id", "group_hash", "membership"))
    once = vecs.filter("n = 1").select("vid", F.col("rep").alias("content_hash")).join(named, "vid")
    salts = vecs.filter("n > 1").select("vid").join(named, "vid").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    many = members.withColumn("salt", F.pmod(F.xxhash64("content_hash"), F.lit(64))).join(salts, ["vid", "salt"])
    cols = ["content_hash", "cluster_id", "group_hash", "membership"]
    return once.select(*cols).unionByName(many.select(*cols))


def centroids(rows: DataFrame) -> DataFrame:
    """(c, centroid): unit mean of the unit vectors of rows (c, n, vec), as array<float>. Sums are made per
    task in numpy before the shuffle, so a cluster with a third of all rows sends one row a task."""

    def part(batches):  # noqa: ANN001, ANN202
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = V._unit(V._bytes(b.column("vec"))).astype(np.float64) * b.column("n").to_numpy()[:, None]
            ids, at = np.unique(b.column("c").to_numpy(), return_inverse=True)
            s = np.zeros((len(ids), x.shape[1]))
            np.add.at(s, at, x)
            for i, v in zip(ids.tolist(), s):
                sums[i] = sums[i] + v if i in sums else v
            if len(sums) > 20_000:
                yield _rows(sums)
                sums = {}
        if sums:
            yield _rows(sums)

    def finish(key, table):  # noqa: ANN001, ANN202
        t = np.asarray(table.column("s").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
        u = (t / max(np.linalg.norm(t), 1e-12)).astype(np.float32)
        return pa.table({"c": pa.array([key[0].as_py()], pa.int64()), "centroid": pa.array([u.tolist()], pa.list_(pa.float32()))})

    return rows.select("c", "n", "vec").mapInArrow(part, "c long, s array<double>").groupBy("c").applyInArrow(finish, "c long, centroid array<float>")


def _rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"c": pa.array(list(sums), pa.int64()), "s": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})


def describe(members: DataFrame, cache: DataFrame, typical: int = 5, model: str = V.MODEL, dim: int = V.DIM) -> DataFrame:
    """(cluster_id, size, typical, centroid): size and the ``typical`` hashes of highest membership, ties going
    to the smaller hash; clusters of one are left out."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("membership"), "content_hash")
    # row_number with a small limit is pushed below the shuffle as a group limit, so no cluster is collected.
    top = members.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= typical)
    best = top.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("i", "content_hash"))).alias("t"))
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size")).filter("size > 1")
    cur = V._newest(cache, model, dim).join(members.select("content_hash", "cluster_id"), "content_hash")
    ids = cur.select(F.xxhash64("cluster_id").alias("c"), "cluster_id", F.lit(1).cast("long").alias("n"), "vec")
    cent = centroids(ids)
    return (
        size.join(best, "cluster_id").withColumn("c", F.xxhash64("cluster_id")).join(cent, "c")
        .select("cluster_id", F.col("size").cast("int").alias("size"), F.transform("t", lambda s: s["content_hash"]).alias("typical"), "centroid")
    )


def found(members: DataFrame, least: int = 8) -> DataFrame:
    """(content_hash, group_hash) of groups with ``least`` or more content hashes."""
    sizes = members.groupBy("group_hash").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return members.join(sizes, "group_hash", "left_semi").select("content_hash", "group_hash")
