"""Density clustering (HDBSCAN) of vectors into concepts, with memberships.

Vectors are reduced to eight principal components of all rows. Core distances and the minimum spanning tree of
mutual reachability are exact whatever the size: rows lie in blocks of a k-d partition, and Boruvka rounds compare a
row only with the blocks that can hold a link as short as the best one its component has. Links are ordered by
(weight, smaller id, larger id), so the tree doesn't depend on the blocks. The condensed tree is read off the sorted
links in one task, with memory in proportion to the rows. Fewer than ten rows are all noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.operators.components import components
from loamdex.session import Scratch

#: Rows of a block; as many or fewer are one task.
BLOCK = 2_048
#: Dimensions that vectors are reduced to.
DIMS = 8


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a and b; a pair gives the same bits in whatever arrays it comes."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(out)


def spanning(x: np.ndarray, min_samples: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight, a, b) of the minimum spanning tree of mutual reachability of rows that fit one task."""
    n = len(x)
    w = _dist(x, x)
    k = min(min_samples, n - 1)
    core = np.partition(w, k, axis=1)[:, k]
    w = np.maximum(np.maximum(w, core[:, None]), core[None])
    comp, rows, out = np.arange(n), np.arange(n), []
    while (comp != comp[0]).any():
        to, at = np.empty(n, int), np.empty(n)
        for i in range(0, n, 512):
            part = np.where(comp[i : i + 512, None] == comp[None], np.inf, w[i : i + 512])
            to[i : i + 512] = part.argmin(axis=1)
            at[i : i + 512] = part.min(axis=1)
        lo, hi = np.minimum(rows, to), np.maximum(rows, to)
        order = np.lexsort((hi, lo, at, comp))
        pick = order[np.unique(comp[order], return_index=True)[1]]
        _, once = np.unique(lo[pick] * n + hi[pick], return_index=True)
        pick = pick[once]
        out.append((at[pick], lo[pick], hi[pick]))
        root = {int(c): int(c) for c in np.unique(comp)}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for p, q in zip(comp[lo[pick]].tolist(), comp[hi[pick]].tolist()):
            p, q = find(p), find(q)
            root[max(p, q)] = min(p, q)
        to_root = np.arange(n)
        for c in root:
            to_root[c] = find(c)
        comp = to_root[comp]
    return tuple(np.concatenate(z) for z in zip(*out))


def hdbscan(x: np.ndarray, min_cluster: int = 10, min_samples: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1 for noise) and memberships of the rows of ``x`` (Campello, Moulavi and Sander, 2013)."""
    n = len(x)
    if n < max(10, min_cluster):
        return np.full(n, -1), np.zeros(n)
    return condense(n, *spanning(x, min_samples), min_cluster)


def condense(n: int, w: np.ndarray, a: np.ndarray, b: np.ndarray, min_cluster: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and memberships of rows 0 to n - 1 from their spanning tree."""
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), w))
    height = w[order].tolist()
    # Single-linkage tree: node n + i joins two nodes at height i.
    root, left, right, size = list(range(2 * n - 1)), [], [], [1] * n

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i, (p, q) in enumerate(zip(a[order].tolist(), b[order].tolist())):
        p, q = find(p), find(q)
        root[p] = root[q] = n + i
        left.append(p)
        right.append(q)
        size.append(size[p] + size[q])
    # Condensed tree: walk down; a split counts only if both sides are large enough.
    top = 2 * n - 2
    parent, born, stab, kids = {0: None}, {0: 0.0}, {0: 0.0}, {0: []}
    fell, lam_at = np.full(n, -1), np.zeros(n)
    todo, count = [(top, 0)], 1
    while todo:
        node, c = todo.pop()
        if node < n:
            continue
        lam = 1.0 / max(height[node - n], 1e-12)
        a, b = left[node - n], right[node - n]
        big = [s for s in (a, b) if size[s] >= min_cluster]
        if len(big) == 2:
            for s in (a, b):
                parent[count], born[count], stab[count], kids[count] = c, lam, 0.0, []
                kids[c].append(count)
                stab[c] += (lam - born[c]) * size[s]
                todo.append((s, count))
                count += 1
            continue
        for s in (a, b):
            if size[s] >= min_cluster:
                todo.append((s, c))
                continue
            stab[c] += (lam - born[c]) * size[s]
            stack = [s]
            while stack:
                v = stack.pop()
                if v < n:
                    fell[v], lam_at[v] = c, lam
                else:
                    stack += [left[v - n], right[v - n]]
    chosen: dict[int, bool] = {}
    value: dict[int, float] = {}
    for c in range(count - 1, -1, -1):
        below = sum(value[k] for k in kids[c])
        chosen[c] = c != 0 and (not kids[c] or stab[c] >= below)
        value[c] = stab[c] if chosen[c] else below
    final: dict[int, int] = {}
    for c in range(count):
        p = parent[c]
        if p is not None and p in final:
            final[c] = final[p]
        elif chosen[c]:
            final[c] = c
    names = {c: i for i, c in enumerate(sorted(set(final.values())))}
    name = np.full(count, -1)
    for c, f in final.items():
        name[c] = names[f]
    label = np.where(fell >= 0, name[fell], -1)
    most = np.zeros(len(names) + 1)
    np.maximum.at(most, label, lam_at)  # noise goes to the last, unused place
    prob = np.where(label >= 0, np.minimum(lam_at / np.maximum(most[label], 1e-12), 1.0), 0.0)
    return label, prob


def _rows(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def reduced(rows: DataFrame) -> DataFrame:
    """(id, p): unit vectors of rows (id, e) on their DIMS principal components, fitted on all rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = _unit(_rows(b.column("e")))
                n, s, c = n + len(x), s + x.sum(axis=0), c + x.T @ x
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tolist()], "c": [c.tobytes()]}, schema=pa.schema([("n", pa.int64()), ("s", pa.list_(pa.float64())), ("c", pa.binary())]))

    n, s, c = 0, 0.0, 0.0
    for r in rows.select("e").mapInArrow(part, "n long, s array<double>, c binary").toLocalIterator():
        n, s, c = n + r["n"], s + np.array(r["s"]), c + np.frombuffer(r["c"]).reshape(len(r["s"]), -1)
    mean = s / n
    axes = np.linalg.eigh(c / n - np.outer(mean, mean))[1][:, ::-1][:, :DIMS] if len(mean) > DIMS else np.eye(len(mean))
    sent = rows.sparkSession.sparkContext.broadcast(axes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = np.round(_unit(_rows(b.column("e"))) @ sent.value, 9)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["id", "p"])

    return rows.select("id", "e").mapInArrow(project, "id long, p array<double>")


def _splits(x: np.ndarray, leaves: int) -> list:
    """Nested [dimension, value, below, above] of a k-d partition into ``leaves``; a leaf is None."""
    if leaves < 2 or len(x) < 2:
        return None
    i = int(np.ptp(x, axis=0).argmax())
    v = float(np.median(x[:, i]))
    low = x[:, i] <= v
    return [i, v, _splits(x[low], leaves // 2), _splits(x[~low], leaves - leaves // 2)]


def _leaf(tree: list | None, x: np.ndarray) -> np.ndarray:
    if tree is None:
        return np.zeros(len(x), int)
    out, low = np.empty(len(x), int), x[:, tree[0]] <= tree[1]
    out[low], out[~low] = 2 * _leaf(tree[2], x[low]) + 1, 2 * _leaf(tree[3], x[~low]) + 2
    return out


def _near(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least distance of every row of x to every box."""
    out = np.zeros((len(x), len(lo)))
    for i in range(x.shape[1]):
        out += np.maximum(np.maximum(lo[None, :, i] - x[:, i, None], x[:, i, None] - hi[None, :, i]), 0) ** 2
    return np.sqrt(out) * (1 - 1e-12)


def _blocks(points: DataFrame, n: int, block: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Points with ``blk``, and the boxes of the blocks. A leaf of many equal points is cut by the hash of the id."""
    some = points.orderBy(F.xxhash64("id"), "id").limit(20_000).select("p").toArrow()  # only shapes the blocks
    tree = _splits(_rows(some.column("p")), -(-n // block))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("p"), pa.array(_leaf(tree, _rows(b.column("p"))), pa.int64())], names=["id", "p", "leaf"])

    placed = scratch.keep(points.mapInArrow(place, "id long, p array<double>, leaf long"))
    parts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("long").alias("m"))
    cut = scratch.keep(placed.join(F.broadcast(parts), "leaf").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("m"))))
    dims = len(cut.first()["p"])
    boxes = cut.groupBy("leaf", "sub").agg(*[f(F.col("p")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(dims)])
    got = boxes.orderBy("leaf", "sub").collect()  # one row a block
    spark = points.sparkSession
    names = spark.createDataFrame([(r["leaf"], r["sub"], i) for i, r in enumerate(got)], "leaf long, sub long, blk int")
    out = scratch.keep(cut.join(F.broadcast(names), ["leaf", "sub"]).select("blk", "id", "p"))
    scratch.drop(placed, cut)
    return out, np.array([[r[f"min{i}"] for i in range(dims)] for r in got]), np.array([[r[f"max{i}"] for i in range(dims)] for r in got])


def _meet(items: DataFrame, visits: DataFrame, f, schema: str, most: int = 16_384) -> DataFrame:  # noqa: ANN001
    """``f`` on the items of a block and at most about ``most`` of its visitors."""
    chunks = F.broadcast(visits.groupBy("blk").agg(F.ceil(F.count("*") / most).cast("long").alias("m")))
    v = visits.join(chunks, "blk").withColumn("part", F.pmod(F.xxhash64("id"), F.col("m"))).drop("m")
    i = items.join(chunks, "blk").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).drop("m")
    v = v.select(*[F.col(c).alias(f"v_{c}") for c in v.columns])  # both sides may be one table
    named = lambda x, q: f(x, q.rename_columns([c.removeprefix("v_") for c in q.column_names]))
    return i.groupBy("blk", "part").cogroup(v.groupBy("v_blk", "v_part")).applyInArrow(named, schema)


def _cores(points: DataFrame, lo: np.ndarray, hi: np.ndarray, k: int, scratch: Scratch) -> DataFrame:
    """points with ``core``, the distance of the k-th other row."""

    def least(items: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"id": [], "d": []}
        if items.num_rows and queries.num_rows:
            x, q, xi, qi = _rows(items.column("p")), _rows(queries.column("p")), items.column("id").to_numpy(), queries.column("id").to_numpy()
            for i in range(0, len(q), 512):
                d = _dist(q[i : i + 512], x)
                d[qi[i : i + 512, None] == xi[None]] = np.inf
                d = np.sort(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k], axis=1)
                out["d"] += d.tolist()
            out["id"] = qi.tolist()
        return pa.table(out, schema=pa.schema([("id", pa.int64()), ("d", pa.list_(pa.float64()))]))

    schema = "id long, d array<double>"
    own = scratch.keep(_meet(points, points, least, schema))
    first = points.join(own.select("id", F.when(F.size("d") >= k, F.element_at("d", k)).otherwise(float("inf")).alias("ub")), "id")

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = _near(_rows(b.column("p")), lo, hi) <= b.column("ub").to_numpy()[:, None]
                ok[np.arange(len(ok)), b.column("blk").to_numpy()] = False
                r, j = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), b.column("id").take(pa.array(r)), b.column("p").take(pa.array(r))], names=["blk", "id", "p"])

    more = _meet(points, scratch.keep(first.select("blk", "id", "p", "ub").mapInArrow(where, "blk int, id long, p array<double>")), least, schema)
    core = own.unionByName(more).groupBy("id").agg(F.element_at(F.array_sort(F.flatten(F.collect_list("d"))), k).alias("core"))
    return scratch.keep(points.join(core, "id").select("blk", "id", "p", "core", F.col("id").alias("comp")))


def _best(items: pa.Table, queries: pa.Table) -> pa.Table:
    """For every component of the queries its least link to an item of another one."""
    schema = pa.schema([("comp", pa.int64()), ("w", pa.float64()), ("lo", pa.int64()), ("hi", pa.int64()), ("other", pa.int64())])
    if not items.num_rows or not queries.num_rows:
        return schema.empty_table()
    items = items.sort_by("id")  # argmin takes the smaller id of equal weights, which is the order of links
    x, xc, xi, xk = _rows(items.column("p")), *(items.column(c).to_numpy() for c in ("core", "id", "comp"))
    q, qc, qi, qk = _rows(queries.column("p")), *(queries.column(c).to_numpy() for c in ("core", "id", "comp"))
    to, at = np.empty(len(q), int), np.empty(len(q))
    for i in range(0, len(q), 512):
        s = slice(i, i + 512)
        w = np.maximum(np.maximum(_dist(q[s], x), qc[s, None]), xc[None])
        w[qk[s, None] == xk[None]] = np.inf
        to[s], at[s] = w.argmin(axis=1), w.min(axis=1)
    lo, hi = np.minimum(qi, xi[to]), np.maximum(qi, xi[to])
    order = np.lexsort((hi, lo, at, qk))
    pick = order[np.unique(qk[order], return_index=True)[1]]
    pick = pick[np.isfinite(at[pick])]
    return pa.table([qk[pick], at[pick], lo[pick], hi[pick], xk[to[pick]]], schema=schema)


def _tree(points: DataFrame, n: int, block: int, min_samples: int, scratch: Scratch) -> DataFrame:
    """(w, a, b): the spanning tree of :func:`spanning` over points (id, p) of any number, a and b being ids."""
    points, lo, hi = _blocks(points, n, block, scratch)
    points = _cores(points, lo, hi, min(min_samples, n - 1), scratch)
    schema, out = "comp long, w double, lo long, hi long, other long", None
    while True:
        # Of every block its least core distance, and its component if it has only one.
        state = points.groupBy("blk").agg(F.min("core").alias("core"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).orderBy("blk").collect()
        core, c1, c2 = (np.array([r[c] for r in state]) for c in ("core", "c1", "c2"))
        if c1.min() == c2.max():
            return out
        only = np.where(c1 == c2, c1, -(2**63))
        mixed = c1 != c2

        def visits(every: bool, core=core, only=only, mixed=mixed):  # noqa: ANN001, ANN202
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if not b.num_rows:
                        continue
                    d = np.maximum(np.maximum(_near(_rows(b.column("p")), lo, hi), core[None]), b.column("core").to_numpy()[:, None])
                    d[~mixed[None] & (only[None] == b.column("comp").to_numpy()[:, None])] = np.inf
                    r, j = np.arange(len(d)), d.argmin(axis=1)
                    if every:  # all blocks but the one of the first look
                        ok = d <= b.column("ub").to_numpy()[:, None]
                        ok[r, j] = False
                        r, j = np.nonzero(ok)
                    cols = [b.column(c).take(pa.array(r)) for c in ("id", "p", "core", "comp")]
                    yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), *cols], names=["blk", "id", "p", "core", "comp"])

            return run

        kind = "blk int, id long, p array<double>, core double, comp long"
        top = lambda d: d.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("m")).select("comp", "m.*")
        first = scratch.keep(top(_meet(points, scratch.keep(points.select("blk", "id", "p", "core", "comp").mapInArrow(visits(False), kind)), _best, schema)))
        bound = points.join(first.select("comp", F.col("w").alias("ub")), "comp").filter("core <= ub").select("id", "p", "core", "comp", "ub")
        second = _meet(points, scratch.keep(bound.mapInArrow(visits(True), kind)), _best, schema)
        best = scratch.keep(top(first.unionByName(second)))
        new = best.select("w", F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
        out = scratch.keep(new if out is None else out.unionByName(new))
        moved = components(best.select(F.col("comp").alias("a"), F.col("other").alias("b"))).select(F.col("id").alias("comp"), F.col("component").alias("to"))
        last, points = points, scratch.keep(points.join(moved, "comp").select("blk", "id", "p", "core", F.col("to").alias("comp")))
        scratch.drop(last)


def concepts(vectors: DataFrame, id_col: str, emb: str, block: int = BLOCK, min_cluster: int = 10, least: float = 0.1, min_samples: int = 5) -> DataFrame:
    """(id, cluster_id, membership) of all rows that HDBSCAN over all rows puts in a cluster, noise left out, with
    its probability as membership if that is over ``least``.

    Null vectors are left out, repeated ids count once. Clusters don't depend on ``block``; it only bounds a task."""
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.keep(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(emb).alias("e")).dropna().dropDuplicates(["id"]))
    n = rows.count()
    if n < max(10, min_cluster):
        return rows.select("id", F.lit(0).alias("cluster_id"), F.lit(0.0).alias("membership")).limit(0)
    points = scratch.keep(reduced(rows))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("id")
        ids = t.column("id").to_numpy()
        w, a, b = spanning(_rows(t.column("p")), min_samples)
        yield pa.RecordBatch.from_pydict({"w": w, "a": ids[a], "b": ids[b]})

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        ids, flat = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
        k, prob = condense(len(ids), t.column("w").to_numpy(), flat[: t.num_rows], flat[t.num_rows :], min_cluster)
        for i in range(0, len(ids), 10_000):
            s = slice(i, i + 10_000)
            yield pa.RecordBatch.from_pydict({"id": ids[s], "cluster_id": k[s].astype(np.int32), "membership": np.round(prob[s], 6)})

    edges = "w double, a long, b long"
    links = scratch.keep(points.repartition(1).mapInArrow(local, edges) if n <= block else _tree(points, n, block, min_samples, scratch))
    done = scratch.keep(links.repartition(1).mapInArrow(label, "id long, cluster_id int, membership double"))
    return done.filter((F.col("cluster_id") >= 0) & (F.col("membership") > least))
