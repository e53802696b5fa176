"""Graph operators over nodes (id, kind, name, short_name, ...) and edges (src, dst, kind, weight)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions.text import directory
from loamdex.session import Scratch

EXPAND_KINDS = ["calls", "imports", "inherits", "references"]
WALK_KINDS = [*EXPAND_KINDS, "contains"]
#: Graphs of up to this many edges are iterated in one task; larger ones with joins, a table written each step.
EDGES_PER_TASK = 2_000_000


def containment_edges(nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, weight) from each node's parent to it, for parents that exist."""
    one = nodes.select("id", "parent_id").distinct()
    ids = one.select(F.col("id").alias("parent_id")).distinct()
    return one.join(ids, "parent_id", "left_semi").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("weight")).distinct()


def compatible(edge_kind: Column, node_kind: Column) -> Column:
    return (
        F.when(edge_kind == "calls", node_kind.isin("function", "method")).when(edge_kind == "inherits", node_kind == "class")
        .when(edge_kind.isin("imports", "references"), node_kind != "block").otherwise(True)
    )


#: What a node is numbered by.
PLACE = ["file_path", "start_byte", "end_byte", "name"]


def number_nodes(found: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Ids from 1 in order of (file, start_byte, -end_byte, name), and parents looked up by name among earlier nodes;
    of several the last one is taken."""
    scratch = scratch or Scratch(found.sparkSession)
    return parents(scratch.keep(found.join(numbers(found, scratch), PLACE)))


def numbers(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(file_path, start_byte, end_byte, name, id) of :func:`number_nodes`. Keys are laid in ranges and each range is
    numbered from what the ranges before it hold, so no task sees all of them."""
    order = [F.col("file_path"), F.col("start_byte"), F.desc("end_byte"), F.col("name")]
    laid = found.select(*PLACE).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    keys = scratch.keep(laid.select(*PLACE, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    held = sorted((r.part, r["count"], r.low) for r in keys.groupBy("part").agg(F.count("*").alias("count"), F.min("at").alias("low")).collect())  # one row a partition
    shift, rows = 1, []
    for part, n, low in held:
        rows.append((part, shift - low))
        shift += n
    add = F.broadcast(found.sparkSession.createDataFrame(rows, "part int, shift long"))
    return keys.join(add, "part").select(*PLACE, (F.col("at") + F.col("shift")).alias("id"))


def parents(known: DataFrame) -> DataFrame:
    """Numbered nodes with the parent_id that :func:`number_nodes` gives them."""
    by_name = known.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("pid")).withColumnRenamed("name", "parent_name")
    want = known.filter("parent_name is not null").select("id", "parent_name").join(by_name, "parent_name")
    once = want.filter("n = 1 and pid < id").select("id", F.col("pid").alias("parent_id"))
    # Of a name defined again the last definition before the node: what both sides of a window say in order of id.
    again = by_name.filter("n > 1").select("parent_name")
    marks = known.select(F.col("name").alias("parent_name"), "id", F.col("id").alias("pid")).join(again, "parent_name", "left_semi")
    asks = want.filter("n > 1").select("parent_name", "id", F.lit(None).cast("long").alias("pid"), F.lit(True).alias("ask"))
    last = F.last("pid", ignorenulls=True).over(Window.partitionBy("parent_name").orderBy("id", F.coalesce("ask", F.lit(False)).desc()).rowsBetween(Window.unboundedPreceding, -1))
    twice = asks.unionByName(marks.withColumn("ask", F.lit(False))).withColumn("parent_id", last).filter("ask and parent_id is not null").select("id", "parent_id")
    up = once.unionByName(twice).groupBy("id").agg(F.max("parent_id").alias("parent_id"))
    return known.join(up, "id", "left")


def _places(folder: Column) -> Column:
    """(level, place) of a folder: itself as level 0, and each of its leading parts with their number."""
    parts = F.split(folder, "/")
    lead = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(parts, 1, i), "/").alias("place")))
    return F.concat(F.array(F.struct(F.lit(0).alias("level"), folder.alias("place"))), F.when(folder == "", F.array().cast("array<struct<level:int,place:string>>")).otherwise(lead))


def resolve_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, kind, weight) of edges given by names (src_name, dst_name, kind, weight).

    The source is an exact name, else a unique short name. The destination is an exact name if its kind fits the
    edge, else a short name among fitting kinds; of several those in the source's folder, else those of the
    longest common folder prefix, and exactly one must be left. Self-edges are dropped, the first of equal
    (src, dst, kind) by weight holds.

    Short names are resolved for each (name, kind, folder) once, and definitions are counted by (name, kind, place)
    first, so that calls and definitions of a name that everyone uses never meet pair by pair."""
    full = nodes.groupBy("name").agg(F.max(F.struct("id", "kind", "file_path")).alias("n"))
    short = nodes.groupBy("short_name").agg(F.count("*").alias("c"), F.max(F.struct("id", "file_path")).alias("n")).filter("c = 1")
    e = raw.join(full.select(F.col("name").alias("src_name"), F.col("n.id").alias("s1"), F.col("n.file_path").alias("f1")), "src_name", "left")
    e = e.join(short.select(F.col("short_name").alias("src_name"), F.col("n.id").alias("s2"), F.col("n.file_path").alias("f2")), "src_name", "left")
    e = e.withColumn("src", F.coalesce("s1", "s2")).withColumn("sf", F.coalesce("f1", "f2")).filter("src is not null")
    e = e.join(full.select(F.col("name").alias("dst_name"), F.col("n.id").alias("d1"), F.col("n.kind").alias("k1")), "dst_name", "left")
    exact = e.filter("d1 is not null").filter(compatible(F.col("kind"), F.col("k1"))).select("src", F.col("d1").alias("dst"), "kind", "weight")
    loose = e.filter("d1 is null").select("src", directory(F.col("sf")).alias("folder"), "dst_name", "kind", "weight")
    kinds = ["calls", "inherits", "imports", "references"]
    asked = loose.select("dst_name", "kind", "folder").distinct()
    fits = F.array(*[F.when(compatible(F.lit(k), F.col("kind")), k) for k in kinds], F.lit("*"))
    cand = nodes.select(F.col("short_name").alias("dst_name"), "id", F.explode(F.array_compact(fits)).alias("fit"), directory(F.col("file_path")).alias("folder"))
    cand = cand.join(asked.select("dst_name").distinct(), "dst_name", "left_semi")
    everywhere = cand.groupBy("dst_name", "fit").agg(F.count("*").alias("n"), F.max("id").alias("d"))
    placed = cand.withColumn("p", F.explode(_places(F.col("folder")))).groupBy("dst_name", "fit", "p.level", "p.place").agg(F.count("*").alias("n"), F.max("id").alias("d"))
    fit = F.when(F.col("kind").isin(kinds), F.col("kind")).otherwise("*")
    asked = asked.withColumn("fit", fit)
    alone = asked.join(everywhere.filter("n = 1"), ["dst_name", "fit"]).select("dst_name", "kind", "folder", "d")
    many = asked.join(everywhere.filter("n > 1").select("dst_name", "fit"), ["dst_name", "fit"]).withColumn("p", F.explode(_places(F.col("folder"))))
    near = many.select("dst_name", "kind", "folder", "fit", "p.level", "p.place").join(placed, ["dst_name", "fit", "level", "place"])
    rank = F.when(F.col("level") == 0, 1_000_000).otherwise(F.col("level"))
    best = near.groupBy("dst_name", "kind", "folder").agg(F.max(F.struct(rank.alias("rank"), "n", "d")).alias("m")).filter("m.n = 1").select("dst_name", "kind", "folder", F.col("m.d").alias("d"))
    chosen = loose.join(alone.unionByName(best), ["dst_name", "kind", "folder"])
    every = exact.unionByName(chosen.select("src", F.col("d").alias("dst"), "kind", "weight"))
    return every.filter("src <> dst").groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))


def assign_chunks(points: DataFrame, chunks: DataFrame, at: str = "start_byte", lo: str = "start_byte", hi: str = "end_byte", closed: bool = False) -> DataFrame:
    """(id, chunk_id): the first chunk of the same file whose range holds the point; equality on the file keeps the
    range join a hash join."""
    p = points.select("id", "file_path", F.col(at).alias("_p"))
    c = chunks.select(F.col("id").alias("chunk_id"), "file_path", F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    inside = (F.col("_lo") <= F.col("_p")) & ((F.col("_p") <= F.col("_hi")) if closed else (F.col("_p") < F.col("_hi")))
    return p.join(c, "file_path").filter(inside).groupBy("id").agg(F.min("chunk_id").alias("chunk_id"))


def _both(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: two equality joins later, never a join on either end."""
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


#: Ids that are sent to a scan as a filter; more are joined.
KEYS = 2_000


class Adjacency:
    """Edges read by their ends: ``out`` and ``into`` map a list of ids, or None for all, to (src, dst, kind, weight).
    Over an index the ids choose folders and row groups; over a plain table they are a pushed filter."""

    def __init__(self, out: Callable[[list[int] | None], DataFrame], into: Callable[[list[int] | None], DataFrame]):
        self.out, self.into = out, into

    @classmethod
    def of(cls, edges: DataFrame) -> Adjacency:
        by = lambda c: lambda ids: edges if ids is None else edges.filter(F.col(c).isin(ids))
        return cls(by("src"), by("dst"))

    def steps(self, ids: list[int] | DataFrame, kinds: list[str] | None, ways: str = "both") -> DataFrame:
        """(a, b, kind, weight): edges from ids of a frontier (a list, or a table with column id) to their other ends."""
        parts = []
        for way, read, a, b in (("out", self.out, "src", "dst"), ("in", self.into, "dst", "src")):
            if ways not in (way, "both"):
                continue
            e = read(ids if isinstance(ids, list) else None)
            e = e if kinds is None else e.filter(F.col("kind").isin(kinds))
            e = e.select(F.col(a).alias("a"), F.col(b).alias("b"), "kind", "weight")
            parts.append(e if isinstance(ids, list) else e.join(ids.select(F.col("id").alias("a")), "a", "left_semi"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _small(df: DataFrame, most: int = KEYS) -> list | None:
    """The rows of a table if there are no more than ``most``, else None."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def expand(
    seeds: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency, kinds: list[str] | None = None, limit: int | None = None, allowed: DataFrame | None = None
) -> DataFrame:
    """(id, score, rank): chunks one undirected hop from the seeds' chunks (id), by largest edge weight, ties by id.
    With ``allowed`` (id), only those chunks."""
    adj = edges if isinstance(edges, Adjacency) else Adjacency.of(edges)
    of = nodes.filter("chunk_id is not null").select("id", "chunk_id").distinct()
    start = of.join(seeds.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").select("id").distinct()
    few = _small(start)
    far = adj.steps([r.id for r in few] if few is not None else start, kinds).select(F.col("b").alias("id"), "weight").join(of, "id")
    scored = far.groupBy(F.col("chunk_id").alias("id")).agg(F.max("weight").cast("double").alias("score"))
    if allowed is not None:
        scored = scored.join(allowed.select("id").distinct(), "id", "left_semi")
    n = limit if limit is not None else max(1, 3 * seeds.count())
    best = scored.orderBy(F.desc("score"), "id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def _power(v: np.ndarray, p: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, alpha: float, most: int, tol: float) -> np.ndarray:
    n = len(v)
    out = np.bincount(src, weights=w, minlength=n)
    share = w / out[src] if len(src) else w
    x = np.full(n, 1.0 / n)
    for _ in range(most):
        y = (1 - alpha) * p + alpha * np.bincount(dst, weights=x[src] * share, minlength=n) + alpha * x[out == 0].sum() * p
        delta = np.abs(y - x).sum()
        x = y
        if delta < n * tol:
            break
    return x


def pagerank(
    vertices: DataFrame, edges: DataFrame, alpha: float = 0.85, most: int = 100, tol: float = 1e-6, teleport: DataFrame | None = None, edges_per_task: int = EDGES_PER_TASK,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(id, score): weighted PageRank by power iteration; dangling mass follows the teleport distribution (id, p),
    uniform without one or when it is all zero. Of parallel edges the kind that sorts last gives the weight. Edges
    with an end outside the vertices are left out; the last iterate is returned at the limit of iterations."""
    scratch = scratch or Scratch(vertices.sparkSession)
    v = scratch.keep(vertices.select("id").distinct())
    one = edges.groupBy("src", "dst").agg(F.max_by(F.col("weight").cast("double"), "kind").alias("w"))
    e = one.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = scratch.keep(e.filter("w > 0").select("src", "dst", "w"))
    n, m = v.count(), e.count()
    if not n:
        return v.select("id", F.lit(0.0).alias("score"))
    total = teleport.agg(F.sum("p")).first()[0] if teleport is not None else None
    prior = v.withColumn("p", F.lit(1.0 / n)) if not total else v.join(teleport.select("id", "p"), "id", "left").select("id", (F.coalesce("p", F.lit(0.0)) / total).alias("p"))
    if n + m <= edges_per_task:  # a checked size
        rows = prior.select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("p").alias("w")).unionByName(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            d = pd.concat(list(batches), ignore_index=True)
            isv = d["b"].isna()
            ids = np.sort(d.loc[isv, "a"].to_numpy(dtype=np.int64))
            p = d.loc[isv].set_index("a")["w"].reindex(ids).to_numpy()
            x = d.loc[~isv].sort_values(["a", "b"])
            at = lambda c: np.searchsorted(ids, x[c].to_numpy(dtype=np.int64))
            yield pd.DataFrame({"id": ids, "score": _power(ids, p, at("a"), at("b"), x["w"].to_numpy(), alpha, most, tol)})

        return rows.repartition(1).mapInPandas(run, "id long, score double")
    out = e.groupBy("src").agg(F.sum("w").alias("o"))
    e = scratch.keep(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("o")).alias("w")))
    sinks = scratch.keep(prior.join(out.select(F.col("src").alias("id")), "id", "left").join(e.select(F.col("src").alias("id"), F.lit(1).alias("has")).distinct(), "id", "left").select("id", "p", F.col("has").isNull().alias("sink")))
    x = scratch.keep(sinks.select("id", F.lit(1.0 / n).alias("x")))
    for _ in range(most):
        cur = sinks.join(x, "id")
        lost = cur.filter("sink").agg(F.sum("x")).first()[0] or 0.0
        flow = e.join(x.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("f"))
        y = cur.join(flow, "id", "left").select("id", ((1 - alpha) * F.col("p") + alpha * F.coalesce("f", F.lit(0.0)) + alpha * lost * F.col("p")).alias("y"), "x")
        y = scratch.keep(y)
        delta = y.agg(F.sum(F.abs(F.col("y") - F.col("x")))).first()[0]
        new = y.select("id", F.col("y").alias("x"))
        x = new
        if delta < n * tol:
            break
    return x.select("id", F.col("x").alias("score"))


def personalised(nodes: DataFrame, edges: DataFrame, weights: DataFrame, most: int = 10) -> DataFrame:
    """(id, score, rank) of chunks: PageRank restarted at the nodes of weighted chunks (id, weight), the largest
    score of each chunk to 12 decimals, for those chunks only. Of a chunk given twice the larger weight holds."""
    of = nodes.filter("chunk_id is not null and kind <> 'block'").select("id", "chunk_id").distinct()
    once = weights.groupBy("id").agg(F.max(F.col("weight").cast("double")).alias("p"))
    start = of.join(once.select(F.col("id").alias("chunk_id"), "p"), "chunk_id").select("id", "p")
    scores = pagerank(of.select("id"), edges, most=most, teleport=start)
    best = scores.join(of.join(once.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"), "id").groupBy(F.col("chunk_id").alias("id")).agg(F.round(F.max("score"), 12).alias("score"))
    best = best.filter(F.lit(bool(start.limit(1).count())))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def lookup(nodes: DataFrame, q: str, blocks: bool = False) -> DataFrame:
    """The one node meant by a name: exact name, else short name, else a case-insensitive suffix in which % and _ are
    wildcards; then the largest pagerank, then the name, then the id."""
    n = nodes if blocks else nodes.filter("kind <> 'block'")
    level = F.when(F.col("name") == q, 0).when(F.col("short_name") == q, 1).when(F.ilike("name", F.lit("%" + q)), 2)
    return n.withColumn("level", level).filter("level is not null").orderBy("level", F.desc("pagerank"), "name", "id").limit(1).drop("level")


def adjacent(nodes: DataFrame, edges: DataFrame | Adjacency, node_id: int, incoming: bool, kinds: list[str], k: int = 20) -> DataFrame:
    """Callers (incoming) or callees: non-block neighbours over ``kinds`` by pagerank, then name."""
    adj = edges if isinstance(edges, Adjacency) else Adjacency.of(edges)
    ids = adj.steps([node_id], kinds, "in" if incoming else "out").select(F.col("b").alias("id")).distinct()
    return nodes.filter("kind <> 'block'").join(ids, "id", "left_semi").dropDuplicates(["id"]).orderBy(F.desc("pagerank"), "name", "id").limit(k).select("id", "name", "kind", "pagerank")


def reach(edges: DataFrame | Adjacency, start: list[int], hops: int, directed: bool = False, kinds: list[str] | None = None, keys: int = KEYS) -> DataFrame:
    """(id, distance): what a breadth-first search from ``start`` reaches in ``hops`` steps, the start included.

    While a frontier has no more than ``keys`` ids they are a filter of the next scan; beyond, it is a written table
    that the edges are joined with."""
    adj = edges if isinstance(edges, Adjacency) else Adjacency.of(edges)
    ways = "out" if directed else "both"
    some = adj.out([])
    spark = some.sparkSession
    near = dict.fromkeys(start, 0)
    front: list[int] = list(near)
    d = 0
    while front and d < hops:
        step = adj.steps(front, kinds, ways).select("b").distinct()
        got = _small(step, keys)
        if got is None:
            break
        front = [r.b for r in got if r.b not in near]
        d += 1
        near.update(dict.fromkeys(front, d))
        if len(near) > 50 * keys:
            break
    seen = spark.createDataFrame(list(near.items()), "id long, distance int")
    if not front or d >= hops:
        return seen
    scratch = Scratch(spark)
    seen = scratch.keep(seen)
    last = seen.filter(F.col("distance") == d).select("id")
    for d in range(d + 1, hops + 1):
        step = adj.steps(last, kinds, ways).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        new = scratch.keep(step.select("id", F.lit(d).alias("distance")))
        if not new.limit(1).count():
            break
        seen, last = scratch.keep(seen.unionByName(new)), new.select("id")
    return seen


def neighbors(nodes: DataFrame, edges: DataFrame | Adjacency, node_id: int, hops: int = 2, k: int = 20, kinds: list[str] | None = None) -> DataFrame:
    """Non-block nodes within ``hops`` undirected steps, with their least distance, by pagerank, then name."""
    near = reach(edges, [node_id], hops, kinds=kinds or WALK_KINDS).filter("distance > 0")
    return nodes.filter("kind <> 'block'").join(near, "id").dropDuplicates(["id"]).orderBy(F.desc("pagerank"), "name", "id").limit(k).select("id", "name", "distance", "pagerank")


def inheritance_chain(edges: DataFrame | Adjacency, node_id: int, kind: str = "inherits", most: int = 20) -> DataFrame:
    """(id, depth): what a node inherits from, directly or not, with the least depth; a node once met isn't expanded
    again, which also ends circles."""
    return reach(edges, [node_id], most, True, [kind]).filter("distance > 0").select("id", F.col("distance").alias("depth"))


def shortest_path(edges: DataFrame | Adjacency, source: int, target: int, hops: int = 8, kinds: list[str] | None = None, keys: int = KEYS) -> DataFrame:
    """(path_index, id): the shortest directed path, of several the one whose array of ids is smallest; empty if none
    within ``hops``. Each node of a frontier keeps one path, so paths don't multiply. Frontiers of up to ``keys`` ids
    are filters of the next scan, larger ones written tables."""
    adj = edges if isinstance(edges, Adjacency) else Adjacency.of(edges)
    kinds = kinds or WALK_KINDS
    spark = adj.out([]).sparkSession
    row = "path_index int, id long"
    front: dict[int, list[int]] = {source: [source]}
    seen = {source}
    d = 0
    while d < hops:
        got = _small(adj.steps(list(front), kinds, "out").select("a", "b").distinct(), 8 * keys)
        if got is None:
            break
        step: dict[int, list[int]] = {}
        for a, b in got:
            p = [*front[a], b]
            if b not in step or p < step[b]:
                step[b] = p
        if target in step:
            return spark.createDataFrame(list(enumerate(step[target])), row)
        front = {b: p for b, p in step.items() if b not in seen}
        if not front:
            return spark.createDataFrame([], row)
        seen |= front.keys()
        d += 1
        if len(front) > keys:
            break
    if d >= hops:
        return spark.createDataFrame([], row)
    scratch = Scratch(spark)
    old = scratch.keep(spark.createDataFrame([(i,) for i in seen], "id long"))
    at = scratch.keep(spark.createDataFrame(list(front.items()), "id long, path array<long>"))
    for _ in range(d, hops):
        links = adj.steps(at, kinds, "out").select("a", "b").distinct()
        step = links.join(at.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("path").alias("path"))
        step = scratch.keep(step.select("id", F.concat("path", F.array("id")).alias("path")))
        hit = step.filter(F.col("id") == target)
        if hit.limit(1).count():
            return hit.select(F.posexplode("path").alias("path_index", "id"))
        at = scratch.keep(step.join(old, "id", "left_anti"))
        if not at.limit(1).count():
            break
        old = scratch.keep(old.unionByName(at.select("id")))
    return spark.createDataFrame([], row)
