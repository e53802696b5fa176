"""Current vectors and the most similar vectors of every vector.

The index: an inverted file whose lists are spherical k-means cells, and four-bit product codes of the
residuals whose codebooks minimise the score-aware (anisotropic) loss, in which the error parallel to the
vector weighs more than the error across it. Centroids and codebooks are fitted on a bounded sample; every
vector is encoded and listed, once. Lists that lie near each other form a cell of about ``block`` vectors, the
unit that a task scans, so a query travels to the few cells that hold the lists it probes and not to every
list. A task decodes the four-bit tables of its cell, scores queries against the lists that they probe, and
reranks with the exact vectors what could reach the limit.

Equal vectors are one row of the index with their content hashes counted, so copies never form pairs. Cells
and their queries are cut into blocks, so a cell with a third of all vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.session import Scratch

MODEL = "quillcode-embed-2"
DIM = 128
#: Rows of the sample that the codebooks are fitted on, at most.
BOOK_ROWS = 8_000
#: Lists at most, and rows of the sample that centroids are fitted on at most.
LISTS, SAMPLE = 16_384, 131_072
#: Content hashes of one vector that a result can need: five neighbours beside the hash itself.
FIRST = 6


def _newest(cache: DataFrame, model: str, dim: int) -> DataFrame:
    """(content_hash, vec): :func:`current_vectors` as bytes, each with its sign bit flipped so that they sort."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("embedding")
            size = e.value_lengths().to_numpy(zero_copy_only=False)
            ok = size == dim  # a null has no length
            flat = e.filter(pa.array(ok)).flatten()
            x = np.asarray(flat.fill_null(0), dtype=np.int8).reshape(-1, dim)
            whole = np.asarray(flat.is_valid()).reshape(-1, dim).all(axis=1) & x.any(axis=1) if len(x) else np.zeros(0, bool)
            raw: list[bytes | None] = [None] * len(ok)
            for i, v, w in zip(np.flatnonzero(ok).tolist(), (x.view(np.uint8) ^ 0x80), whole.tolist()):
                raw[i] = v.tobytes() if w else None
            yield pa.RecordBatch.from_arrays([b.column("content_hash"), b.column("created_at"), pa.array(raw, pa.binary())], names=["content_hash", "created_at", "vec"])

    rows = cache.filter((F.col("model_id") == model) & F.col("content_hash").isNotNull()).select("content_hash", F.col("created_at").cast("long").alias("created_at"), "embedding")
    packed = rows.mapInArrow(pack, "content_hash string, created_at long, vec binary")
    newest = packed.groupBy("content_hash").agg(F.max(F.struct("created_at", "vec")).alias("m"))
    return newest.filter("m.vec is not null").select("content_hash", F.col("m.vec").alias("vec"))


def _bytes(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a binary column of equal lengths, as the signed bytes that :func:`_newest` packed."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros((0, 0), dtype=np.int8)
    at = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(col.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    return (raw ^ 0x80).view(np.int8).reshape(n, -1)


def current_vectors(cache: DataFrame, model: str = MODEL, dim: int = DIM) -> DataFrame:
    """(content_hash, embedding): of each content_hash the embedding of ``model`` with the largest created_at.

    A hash whose newest embedding is null, all zero, of another length than ``dim`` or with a null element has no
    current vector. Null hashes are left out, a null created_at is the oldest, and of rows of equal created_at the
    larger usable array holds. Repeated rows count once."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _bytes(b.column("vec"))
            e = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("content_hash"), e], names=["content_hash", "embedding"])

    return _newest(cache, model, dim).mapInArrow(unpack, "content_hash string, embedding array<tinyint>")


def distinct_vectors(cache: DataFrame, scratch: Scratch, model: str = MODEL, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """(vid, rep, n, first, vec) with one row for each distinct current vector, and (content_hash, rep, vid).

    rep is the smallest content hash of the vector, vid numbers the reps in their order, and ``first`` holds
    the FIRST smallest hashes, found by a partial aggregate over salted groups."""
    cur = scratch.keep(_newest(cache, model, dim))
    salted = cur.groupBy("vec", F.pmod(F.xxhash64("content_hash"), F.lit(64)).alias("salt")).agg(
        F.count("*").alias("n"), _smallest(F.collect_set("content_hash")).alias("first")
    )
    groups = salted.groupBy("vec").agg(F.sum("n").alias("n"), _smallest(F.flatten(F.collect_list("first"))).alias("first"))
    groups = groups.select(F.element_at("first", 1).alias("rep"), "n", "first", "vec")
    parts = max(cur.sparkSession.sparkContext.defaultParallelism, 1)
    laid = groups.repartitionByRange(parts, "rep").sortWithinPartitions("rep").withColumn("vid", F.monotonically_increasing_id())
    vecs = scratch.keep(laid.select("vid", "rep", "n", "first", "vec"))
    # Hashes of vectors that occur once are their own rep; only the others are joined, on the vector and a salt.
    many = vecs.filter("n > 1").select("rep", "vid", "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("salt"))
    salt = F.pmod(F.xxhash64("content_hash"), F.lit(64))
    copies = cur.withColumn("salt", salt).join(many, ["vec", "salt"]).select("content_hash", "rep", "vid")
    members = vecs.filter("n = 1").select(F.col("rep").alias("content_hash"), "rep", "vid").unionByName(copies)
    return vecs, members


def _smallest(c: Column) -> Column:
    return F.slice(F.array_sort(c), 1, FIRST)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Index:
    """What is fitted: centroids (lists, dim), books (dim/2, 16, 2) and the cell of each list; sent to every task.
    ``floor`` holds for each list the cosine from which a query must probe it: at exact search its bound."""

    centroids: np.ndarray
    books: np.ndarray
    eta: float
    cell: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    floor: np.ndarray | None = None

    def encode(self, unit: np.ndarray, at: np.ndarray, sweeps: int = 2) -> np.ndarray:
        return _codes(unit - self.centroids[at], unit, self.books, self.eta, sweeps)

    def decode(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        m = self.books.shape[0]
        return self.books[np.arange(m)[None, :], codes].reshape(len(codes), -1) + self.centroids[at]


def _codes(res: np.ndarray, unit: np.ndarray, books: np.ndarray, eta: float, sweeps: int) -> np.ndarray:
    """Coordinate descent over the subspaces on |r|^2 + (eta - 1) (r.x)^2, r being what the codes leave over."""
    m, _, w = books.shape
    n = len(res)
    out = np.empty((n, m), dtype=np.uint8)
    square = np.einsum("mcw,mcw->mc", books, books)
    for lo in range(0, n, 2048):  # what a step touches stays in the cache
        r3 = np.ascontiguousarray(res[lo : lo + 2048].reshape(-1, m, w).transpose(1, 0, 2))
        x3 = np.ascontiguousarray(unit[lo : lo + 2048].reshape(-1, m, w).transpose(1, 0, 2))
        own = np.einsum("mnw,mnw->mn", r3, x3)
        rows = np.arange(r3.shape[1])
        codes = np.empty((m, len(rows)), dtype=np.uint8)
        par = np.empty((m, len(rows)), dtype=np.float32)  # parallel error that each subspace leaves
        for j in range(m):
            codes[j] = (square[j] - 2 * (r3[j] @ books[j].T)).argmin(axis=1)
            par[j] = own[j] - np.einsum("nw,nw->n", x3[j], books[j][codes[j]])
        total = par.sum(axis=0)
        for _ in range(sweeps - 1):
            for j in range(m):
                p = own[j][:, None] - x3[j] @ books[j].T
                cost = p + (total - par[j])[:, None]
                cost *= cost
                cost *= eta - 1
                cost += square[j]
                cost -= 2 * (r3[j] @ books[j].T)
                c = cost.argmin(axis=1)
                new = p[rows, c]
                total += new - par[j]
                codes[j], par[j] = c, new
        out[lo : lo + len(rows)] = codes.T
    return out


def fit(sample: np.ndarray, n_lists: int, threshold: float, seed: int = 7, rounds: int = 5, width: int = 2) -> Index:
    """Fit centroids and anisotropic codebooks. eta follows from the similarity from which scores matter."""
    rng = np.random.default_rng(seed)
    x = _unit(sample)
    n, dim = x.shape
    if -dim % width:
        raise ValueError(f"dimension must be a multiple of {width}")
    cent = x[rng.choice(n, min(n_lists, n), replace=False)].copy()
    near = lambda: np.concatenate([(x[i : i + 4096] @ cent.T).argmax(axis=1) for i in range(0, n, 4096)])
    for _ in range(rounds):
        at = near()
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(cent)))
        sums = np.add.reduceat(x[order], np.minimum(starts, n - 1), axis=0)
        full = np.bincount(at, minlength=len(cent)) > 0
        cent[full] = _unit(sums[full])
    eta = (dim - 1) * threshold**2 / (1 - threshold**2)
    at = near()
    some = rng.permutation(n)[:BOOK_ROWS]
    x, at = x[some], at[some]
    n, res, m = len(x), x - cent[at], dim // width
    r3, x3 = res.reshape(n, m, width), x.reshape(n, m, width)
    books = r3[rng.choice(n, 16, replace=n < 16)].transpose(1, 0, 2).copy()
    for turn in range(6):
        codes = _codes(res, x, books, eta, 1 if turn < 4 else 2)
        left = r3 - books[np.arange(m)[None], codes]
        par = np.einsum("nmw,nmw->nm", left, x3)
        total = par.sum(axis=1)
        k = eta - 1 if turn >= 4 else 0.0
        for j in range(m):
            for c in range(16):
                own = codes[:, j] == c
                if own.any():
                    xs, rs = x3[own, j], r3[own, j]
                    b = (total[own] - par[own, j]) + np.einsum("nw,nw->n", rs, xs)
                    books[j, c] = np.linalg.solve(own.sum() * np.eye(width) + k * xs.T @ xs, rs.sum(axis=0) + k * (b[:, None] * xs).sum(axis=0))
    return Index(cent.astype(np.float32), books.astype(np.float32), float(eta))


def cells(cent: np.ndarray, weight: np.ndarray, block: float) -> np.ndarray:
    """Cell of each list: lists are halved by two means until a cell weighs ``block`` at most or is one list."""
    out, n, todo = np.zeros(len(cent), np.int32), 0, [np.arange(len(cent))]
    while todo:
        own = todo.pop()
        if len(own) == 1 or weight[own].sum() <= block:
            out[own] = n
            n += 1
            continue
        x, w = cent[own], weight[own][:, None] + 1e-9
        a = x[(x @ x[0]).argmin()]
        two = np.stack([a, x[(x @ a).argmin()]])
        for _ in range(8):
            right = (x @ (two[1] - two[0])) > 0
            if right.all() or not right.any():
                break
            two = _unit(np.stack([(x[~right] * w[~right]).sum(axis=0), (x[right] * w[right]).sum(axis=0)]))
        if right.all() or not right.any():
            right = np.arange(len(own)) % 2 == 1
        todo += [own[~right], own[right]]
    return out


def build(vecs: DataFrame, n: int, threshold: float, sample: int = SAMPLE, per_list: int = 80, block: int = 16_384) -> Index:
    """Fit an :class:`Index` on at most ``sample`` rows, eight a list, chosen by the hash of rep, so the choice is
    repeatable. The lists grow with n up to LISTS; beyond, lists grow, and cells are single lists cut in blocks."""
    lists = int(np.clip(n // per_list, 1, LISTS))
    sample = min(sample, max(20_000, 8 * lists))
    share = min(1.0, sample / max(n, 1))
    some = vecs.filter(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("vec").limit(sample)
    rows = _bytes(some.toArrow().column("vec"))
    if not len(rows):
        raise ValueError("no vectors")
    index = fit(rows, lists, threshold)
    x = _unit(rows)
    at = np.concatenate([(x[i : i + 4096] @ index.centroids.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    return _ordered(index, cells(index.centroids, np.bincount(at, minlength=len(index.centroids)) * (n / len(x)), block))


def _ordered(index: Index, cell: np.ndarray) -> Index:
    """``index`` with its lists in order of their cells, so that what a query probes in a cell is one stretch."""
    order = np.argsort(cell, kind="stable")
    return Index(index.centroids[order], index.books, index.eta, cell[order])


def _listed(index: Index, unit: np.ndarray, probe_cos: float, probe_least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own list of each row, rows, lists): what each row probes, in order of row and list, which is that of cells."""
    s = unit @ index.centroids.T
    at = s.argmax(axis=1)
    if index.floor is not None:
        ask = s >= index.floor[None]
    else:
        ask = s >= probe_cos
        few = np.flatnonzero(ask.sum(axis=1) < min(probe_least, s.shape[1]))
        if len(few):
            least = min(probe_least, s.shape[1])
            top = np.argpartition(-s[few], least - 1, axis=1)[:, :least]
            ask[few[:, None], top] = True
    r, c = np.divmod(np.flatnonzero(ask.ravel()), ask.shape[1])
    return at, r, c


def search(
    vecs: DataFrame, index: Index, scratch: Scratch, k: int, threshold: float, forest: bool = False, exact: bool = False, probe_cos: float = 0.4, probe_least: int = 48,
    margin: float = 0.12, block: int = 16_384, q_block: int = 32_768,
) -> DataFrame:
    """(a, b, cos): for every vid ``a`` its ``k`` most similar other vids with a cosine >= threshold, rounded to
    6 decimals, ties going to the smaller vid.

    A query probes every list whose centroid has a cosine of ``probe_cos`` or more with it, ``probe_least`` at
    least; pairs that the codes put ``margin`` below the threshold are passed over. Both are approximations whose
    recall the README gives. ``exact`` has none: codes are not used, and a list is left out only if its centroid is
    farther from the query than the threshold's angle and the list's radius together.

    With ``forest``, rows of null cos are added: links that join all vids which pairs over the threshold join
    among all pairs that were scored, directly or through others. A task gives at most a few a vector, so a
    group of any size comes out whole without its pairs."""
    spark = vecs.sparkSession
    if not len(index.cell):
        index = _ordered(index, cells(index.centroids, np.ones(len(index.centroids)), 64))
    if exact:
        index = _bounded(vecs, index, threshold)
        margin = 2.0
    sent = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                x = _unit(_bytes(b.column("vec")))
                at, r, c = _listed(ix, x, probe_cos, probe_least)
                codes = ix.encode(x, at)
                packed = codes[:, 0::2] | (codes[:, 1::2] << 4)
                # Of each row one entry a cell: the lists probed there, as 16-bit numbers.
                new = np.concatenate([[True], (r[1:] != r[:-1]) | (ix.cell[c[1:]] != ix.cell[c[:-1]])]) if len(r) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                ends = np.concatenate([first, [len(r)]]).astype(np.int32) * 2
                lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(c.astype(np.uint16).tobytes())])
                struct = pa.StructArray.from_arrays([pa.array(ix.cell[c[first]].astype(np.int32)), lists], names=["cell", "lists"])
                offsets = pa.array(np.searchsorted(r[first], np.arange(len(x) + 1)).astype(np.int32))
                raw = lambda z: pa.Array.from_buffers(pa.binary(), len(z), [None, pa.py_buffer(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.py_buffer(z.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [b.column("vid"), pa.array(ix.cell[at].astype(np.int32)), pa.array(at.astype(np.int32)), raw(np.ascontiguousarray(packed)), b.column("vec"), pa.ListArray.from_arrays(offsets, struct)],
                    names=["vid", "cell", "list", "codes", "vec", "probes"],
                )

    coded = scratch.keep(vecs.select("vid", "vec").mapInArrow(encode, "vid long, cell int, list int, codes binary, vec binary, probes array<struct<cell:int,lists:binary>>"))
    # One row a cell: bounded by the number of lists.
    held = coded.groupBy("cell").count().select("cell", F.ceil(F.col("count") / block).cast("int").alias("nb"))
    asked = coded.select(F.explode("probes.cell").alias("cell")).groupBy("cell").count().select("cell", F.ceil(F.col("count") / q_block).cast("int").alias("nq"))
    shape = F.broadcast(scratch.keep(held.join(asked, "cell")))
    left = coded.select("vid", "cell", "list", "codes", "vec").join(shape, "cell")
    left = left.withColumn("blk", F.pmod(F.xxhash64("vid"), F.col("nb")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    right = coded.select("vid", "vec", F.explode("probes").alias("p")).select(F.col("p.cell").alias("cell"), "vid", "vec", "p.lists").join(shape, "cell")
    right = right.withColumn("qb", F.pmod(F.xxhash64("vid", F.lit(2)), F.col("nq")).cast("int")).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    kept = ["cell", "blk", "qb"]
    left = left.select(*kept, F.col("vid").alias("x"), "list", "codes", F.col("vec").alias("xe"))
    right = right.select(*kept, F.col("vid").alias("q"), F.col("vec").alias("qe"), "lists")

    def scan(items: pa.Table, queries: pa.Table) -> pa.Table:
        if not items.num_rows or not queries.num_rows:
            return _Scan.empty()
        return _Scan(sent.value, items, queries, k, threshold, margin, forest).run()

    found = left.groupBy(*kept).cogroup(right.groupBy(*kept)).applyInArrow(scan, "a long, b long, cos double")
    w = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    if not forest:
        return found.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k).drop("i")
    found = scratch.keep(found)
    best = found.filter("cos is not null").withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k).drop("i")
    return best.unionByName(found.filter("cos is null"))


def _bounded(vecs: DataFrame, index: Index, threshold: float) -> Index:
    """``index`` with the cosine from which a query may have a neighbour over the threshold in a list."""
    sent = vecs.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _unit(_bytes(b.column("vec"))) @ sent.value.centroids.T
                at = s.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(s[np.arange(len(s)), at].astype(np.float64))], names=["list", "near"])

    far = vecs.select("vec").mapInArrow(place, "list int, near double").groupBy("list").agg(F.min("near").alias("near")).toArrow()  # one row a list
    floor = np.full(len(index.centroids), 2.0, dtype=np.float32)
    wide = np.arccos(np.clip(far.column("near").to_numpy(), -1, 1)) + np.arccos(threshold) + 2e-3
    floor[far.column("list").to_numpy()] = np.cos(np.minimum(wide, np.pi)) - 1e-4
    return Index(index.centroids, index.books, index.eta, index.cell, floor)


class _Scan:
    """Queries against the items of one block of a cell."""

    ROWS = 1024

    def __init__(self, ix: Index, items: pa.Table, queries: pa.Table, k: int, threshold: float, margin: float, forest: bool):
        self.k, self.threshold, self.least, self.forest = k, threshold, threshold - margin, forest
        order = np.argsort(items.column("list").to_numpy(), kind="stable")
        self.list = items.column("list").to_numpy()[order]
        x, q = _bytes(items.column("xe"))[order], _bytes(queries.column("qe"))
        self.xv, self.qv = items.column("x").to_numpy()[order], queries.column("q").to_numpy()
        self.x, self.q = x.astype(np.float32), q.astype(np.float32)
        self.xn, self.qn = np.linalg.norm(x.astype(np.float64), axis=1), np.linalg.norm(q.astype(np.float64), axis=1)
        self.unit = self.q / self.qn[:, None].astype(np.float32)
        self.approx = None
        if self.least > -1:
            packed = _bytes(items.column("codes"))[order].view(np.uint8) ^ 0x80
            codes = np.empty((len(packed), packed.shape[1] * 2), dtype=np.uint8)
            codes[:, 0::2], codes[:, 1::2] = packed & 15, packed >> 4
            self.approx = ix.decode(codes, self.list)
        lists = queries.column("lists").combine_chunks()
        at = np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset : lists.offset + len(lists) + 1]
        asked = np.frombuffer(lists.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].view(np.uint16).astype(np.int64)
        self.n_asked = np.diff(at) // 2
        self.asker, self.asked = np.repeat(np.arange(len(self.qv)), self.n_asked), asked
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if forest:
            # One number for every vid, whether it is an item, a query or both; its label is the smallest it is joined to.
            self.vids, inv = np.unique(np.concatenate([self.xv, self.qv]), return_inverse=True)
            self.xi, self.qi = inv[: len(self.xv)], inv[len(self.xv) :]
            self.label = np.arange(len(self.vids))
            self.links: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def empty() -> pa.Table:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})

    def run(self) -> pa.Table:
        held, first = np.unique(self.list, return_index=True)
        ends = np.append(first[1:], len(self.list))
        wide = self.n_asked * 4 >= len(held)
        # Queries that ask for much of the cell meet all of it; the others meet the lists they ask for.
        rows = np.flatnonzero(wide)
        if len(rows):
            self.best(rows, np.arange(len(self.xv)))
        narrow = ~wide[self.asker]
        order = np.argsort(self.asked[narrow], kind="stable")
        who, what = self.asker[narrow][order], self.asked[narrow][order]
        for l, a, b in zip(held, first, ends):
            lo, hi = np.searchsorted(what, l), np.searchsorted(what, l, "right")
            if hi > lo:
                self.best(who[lo:hi], np.arange(a, b))
        out = self.top()
        if self.forest and self.links:
            a, b = (np.concatenate(z) for z in zip(*self.links))
            pair = np.unique(np.stack([a, b], axis=1), axis=0)
            links = pa.table({"a": self.vids[pair[:, 0]], "b": self.vids[pair[:, 1]], "cos": pa.nulls(len(pair), pa.float64())})
            out = pa.concat_tables([out, links])
        return out

    def best(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """Keep the k best columns of each row, and what the pairs over the threshold join."""
        for i in range(0, len(rows), self.ROWS):
            r, c = rows[i : i + self.ROWS], cols
            if self.approx is not None:
                near = self.unit[r] @ self.approx[c[0] : c[-1] + 1].T >= self.least
                r = r[near.any(axis=1)]
                if not len(r):
                    continue
                c = c[near.any(axis=0)]
            # Exact reranking: sums of products of bytes stay below 2^24, so float32 products are exact.
            cos = (self.q[r] @ self.x[c].T).astype(np.float64)
            cos /= self.qn[r][:, None] * self.xn[c][None, :]
            np.round(cos, 6, out=cos)
            cos[self.qv[r][:, None] == self.xv[c][None, :]] = -9
            if self.forest:
                self.join(r, c, cos >= self.threshold)
            least = np.full(len(r), self.threshold)
            if len(c) > self.k:
                least = np.maximum(least, -np.partition(-cos, self.k - 1, axis=1)[:, self.k - 1])
            u, v = np.nonzero(cos >= least[:, None])
            self.out.append((self.qv[r[u]], self.xv[c[v]], cos[u, v]))
            if sum(len(z[0]) for z in self.out) > 2_000_000:
                t = self.top()
                self.out = [(t.column("a").to_numpy(), t.column("b").to_numpy(), t.column("cos").to_numpy())]

    def top(self) -> pa.Table:
        if not self.out:
            return self.empty()
        a, b, cos = (np.concatenate(z) for z in zip(*self.out))
        order = np.lexsort((b, -cos, a))
        a, b, cos = a[order], b[order], cos[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        return pa.table({"a": a[rank < self.k], "b": b[rank < self.k], "cos": cos[rank < self.k]})

    def join(self, r: np.ndarray, c: np.ndarray, ok: np.ndarray) -> None:
        live = ok.any(axis=1)
        if not live.any():
            return
        hit = ok.any(axis=0)
        r, c, ok = self.qi[r[live]], self.xi[c[hit]], ok[live][:, hit]
        rl, cl = self.label[r], self.label[c]
        r0, c0 = rl.copy(), cl.copy()
        if (cl == cl[0]).all():
            low = min(cl[0], rl.min())
            rl[:], cl[:] = low, low
        else:
            none = len(self.label)
            while True:
                r2 = np.minimum(rl, np.where(ok, cl[None, :], none).min(axis=1))
                c2 = np.minimum(cl, np.where(ok, r2[:, None], none).min(axis=0))
                if (r2 == rl).all() and (c2 == cl).all():
                    break
                rl, cl = r2, c2
        for old, new in ((r0, rl), (c0, cl)):
            moved = old != new
            # A label that gives way is linked to the one it gives way to, and so are all that bear it.
            self.links.append((new[moved], old[moved]))
        np.minimum.at(self.label, np.concatenate([r, c]), np.concatenate([rl, cl]))


def nearest(cache: DataFrame, k: int = 5, threshold: float = 0.70, model: str = MODEL, dim: int = DIM, **how: float) -> DataFrame:
    """(content_hash, neighbour, cos): for every current vector the ``k`` most similar current vectors of other
    content hashes with a cosine of at least ``threshold``, ties going to the smaller hash. ``how`` goes to
    :func:`search`; ``exact=True`` is without approximation.

    Hashes whose vectors are equal have a cosine of 1 and are told apart by hash. k may be at most FIRST - 1.
    An empty cache, or one without current vectors, gives an empty result; extra columns are not read."""
    if not 1 <= k < FIRST:
        raise ValueError(f"k must be from 1 to {FIRST - 1}")
    scratch = Scratch(cache.sparkSession)
    vecs, members = distinct_vectors(cache, scratch, model, dim)
    n = vecs.count()
    if not n:
        return members.select("content_hash", F.col("rep").alias("neighbour"), F.lit(1.0).alias("cos")).limit(0)
    links = search(vecs, build(vecs, n, threshold), scratch, k, threshold, **how)
    near = links.join(vecs.select(F.col("vid").alias("b"), "first"), "b").groupBy(F.col("a").alias("vid")).agg(
        F.flatten(F.collect_list(F.transform("first", lambda h: F.struct((-F.col("cos")).alias("d"), h.alias("h"))))).alias("near")
    )  # at most k * FIRST entries
    own = vecs.select("vid", "n", F.transform("first", lambda h: F.struct(F.lit(-1.0).alias("d"), h.alias("h"))).alias("own"))
    empty = F.array().cast("array<struct<d:double,h:string>>")
    lists = scratch.keep(own.join(near, "vid", "left").select("vid", "n", F.array_sort(F.concat("own", F.coalesce("near", empty))).alias("near")).filter("size(near) > 1"))
    once = lists.filter("n = 1").join(vecs.select("vid", F.col("rep").alias("content_hash")), "vid")
    salts = lists.filter("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    copies = members.withColumn("salt", F.pmod(F.xxhash64("content_hash"), F.lit(64))).join(salts, ["vid", "salt"])
    all_ = once.select("content_hash", "near").unionByName(copies.select("content_hash", "near"))
    best = F.slice(F.filter("near", lambda x: x["h"] != F.col("content_hash")), 1, k)
    return all_.select("content_hash", F.explode(best).alias("x")).select("content_hash", F.col("x.h").alias("neighbour"), (-F.col("x.d")).alias("cos"))


def pairs(near: DataFrame) -> DataFrame:
    """(hash_a, hash_b), hash_a < hash_b: pairs taken from either side, once."""
    return near.select(F.least("content_hash", "neighbour").alias("hash_a"), F.greatest("content_hash", "neighbour").alias("hash_b")).distinct()
