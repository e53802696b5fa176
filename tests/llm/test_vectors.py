import os

import numpy as np
import pytest

from loamdex.llm import clusters as C
from loamdex.llm import vectors as V
from loamdex.session import Scratch

SCHEMA = "content_hash string, embedding array<tinyint>, model_id string, created_at long, vid string, rep int, n string, label string"
DIM = 16


def row(h, e, at=1, model=V.MODEL):
    return (h, None if e is None else [int(x) for x in e], model, at, "x", 3, "y", "z")


def groups(rng, sizes, noise=0.25):
    out = []
    for k in sizes:
        c = rng.normal(size=DIM)
        c /= np.linalg.norm(c)
        for _ in range(k):
            v = c + rng.normal(size=DIM) * noise / DIM**0.5
            out.append(np.clip(np.round(v / np.linalg.norm(v) * 100), -127, 127))
    return out


def cosines(x):
    x = np.asarray(x, dtype=float)
    n = np.linalg.norm(x, axis=1)
    return np.round(x @ x.T / (n[:, None] * n[None]), 6)


def test_current_vectors_edges(spark):
    e = [1] * DIM
    rows = [
        row("a", e, 1), row("a", [2] * DIM, 5), row("a", [2] * DIM, 5), row("b", e), row("b", None, 9), row("c", [0] * DIM), row(None, e), row("d", e, None), row("e", e, 1, "other"),
        row("f", e[:3]), row("g", None), row("h", e[:-1] + [7]),
    ]
    rows.append(("i", [1] * (DIM - 1) + [None], V.MODEL, 1, "", 0, "", ""))
    got = {r[0]: r[1][0] for r in V.current_vectors(spark.createDataFrame(rows, SCHEMA), dim=DIM).collect()}
    assert got == {"a": 2, "d": 1, "h": 1}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = groups(rng, [30, 20, 9, 3, 1, 1, 1])
    h = [f"h{i:03d}" for i in rng.permutation(len(x) + 9)]
    x += [x[0]] * 7 + [x[60]] * 2  # equal vectors of other hashes
    cache = spark.createDataFrame([row(a, e) for a, e in zip(h, x)] * 2, SCHEMA)
    s = cosines(x)
    want = set()
    for i in range(len(x)):
        near = sorted((-s[i, j], h[j]) for j in range(len(x)) if j != i and s[i, j] >= 0.7)[:5]
        want |= {(h[i], b, -c) for c, b in near}
    got = {(r[0], r[1], r[2]) for r in V.nearest(cache, dim=DIM).collect()}
    assert {g[:2] for g in got} == {w[:2] for w in want}
    cos = {w[:2]: w[2] for w in want}
    assert all(abs(c - cos[a, b]) < 2e-6 for a, b, c in got)
    assert all(a < b for a, b in V.pairs(V.nearest(cache, dim=DIM)).collect())


def test_nearest_blocks_give_the_same(spark):
    rng = np.random.default_rng(2)
    cache = spark.createDataFrame([row(f"{i:04d}", e) for i, e in enumerate(groups(rng, [60, 40, 20]))], SCHEMA)
    a = {tuple(r) for r in V.nearest(cache, dim=DIM).collect()}
    b = {tuple(r) for r in V.nearest(cache, dim=DIM, block=16, q_block=16).collect()}
    assert a == b and a


def test_recall_over_the_test_table(spark):
    cache = spark.read.parquet(os.environ.get("LOAMDEX_TESTDATA", "/root/testdata") + "/sf0.001/embedding_cache.parquet")
    got = {tuple(sorted(r[:2])) for r in V.nearest(cache).collect()}
    rows = V.current_vectors(cache).collect()
    h, s = [r[0] for r in rows], cosines([r[1] for r in rows])
    want = set()
    for i in range(len(h)):
        for _, b in sorted((-s[i, j], h[j]) for j in range(len(h)) if j != i and s[i, j] >= 0.7)[:5]:
            want.add(tuple(sorted((h[i], b))))
    assert len(got & want) >= 0.99 * len(want)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert V.nearest(none, dim=DIM).count() == 0
    assert C.clusters(none, dim=DIM).count() == 0
    assert C.found(C.clusters(none, dim=DIM)).count() == 0
    with pytest.raises(ValueError):
        V.nearest(none, k=9)


def naive_average(x, threshold):
    x = np.asarray(x, dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = max(((np.round(np.mean(x[a] @ x[b].T), 9), -min(a[0], b[0]), -max(a[0], b[0]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] < threshold:
            break
        i, j = best[3:]
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
    return {tuple(g) for g in groups}


def test_linkage_equals_naive_average_linkage():
    rng = np.random.default_rng(3)
    x = V._unit(np.array(groups(rng, [9, 7, 5, 1], noise=0.9)))
    i, j = np.triu_indices(len(x), 1)
    lab = C.linkage(x, np.ones(len(x)), i, j, 0.7)
    got = {}
    for k, c in enumerate(lab):
        got.setdefault(c, []).append(k)
    assert {tuple(g) for g in got.values()} == naive_average(x, 0.7)


def test_distributed_rounds_equal_local_ones(spark):
    rng = np.random.default_rng(4)
    cache = spark.createDataFrame([row(f"{i:04d}", e) for i, e in enumerate(groups(rng, [25, 14, 6], noise=0.8))], SCHEMA)
    one = {tuple(r[:3]) for r in C.clusters(cache, dim=DIM).collect()}
    two = {tuple(r[:3]) for r in C.clusters(cache, dim=DIM, vectors_per_task=3).collect()}
    assert one == two and one


def test_groups_are_components(spark):
    rng = np.random.default_rng(5)
    x = groups(rng, [30, 12, 8, 7, 2], noise=0.7)
    x += [x[-1]] * 9  # a group of copies
    h = [f"{i:04d}" for i in rng.permutation(len(x))]
    s = cosines(x) >= 0.7
    comp = list(range(len(x)))
    for _ in comp:
        comp = [min(comp[j] for j in np.flatnonzero(s[i])) for i in range(len(x))]
    want = {}
    for k, c in enumerate(comp):
        want.setdefault(c, []).append(h[k])
    want = {(a, min(g)) for g in want.values() if len(g) >= 8 for a in g}
    cache = spark.createDataFrame([row(a, e) for a, e in zip(h, x)], SCHEMA)
    members = C.clusters(cache, dim=DIM, k=3)
    assert {tuple(r) for r in C.found(members).collect()} == want
    described = C.describe(members, cache, dim=DIM).collect()
    sizes = {r["cluster_id"]: r["count"] for r in members.groupBy("cluster_id").count().collect() if r["count"] > 1}
    assert {r["cluster_id"]: r["size"] for r in described} == sizes
    for r in described:
        assert abs(np.linalg.norm(r["centroid"]) - 1) < 1e-4 and 1 <= len(r["typical"]) <= 5
    assert members.filter("membership < 0 or membership > 1.000001").count() == 0


def packed(x):
    return [(np.array(v, dtype=np.int8).view(np.uint8) ^ 0x80).tobytes() for v in x]


def test_no_limit_of_probed_lists(spark):
    # Each of two vectors has 110 lists nearer to it than the other's.
    rng = np.random.default_rng(6)
    a, c = np.eye(DIM)[:2]
    b = 0.73 * a + np.sqrt(1 - 0.73**2) * c
    cent = np.concatenate([V._unit(v + 0.25 * V._unit(rng.normal(size=(110, DIM)))) for v in (a, b)]).astype(np.float32)
    x = [np.round(v * 120).astype(int).tolist() for v in (a, b)]
    vecs = spark.createDataFrame(list(enumerate(packed(x))), "vid long, vec binary")
    index = V.fit(np.array(x * 20), 2, 0.7)
    for exact in (False, True):
        for threshold, want in ((0.7, {(0, 0), (1, 0)}), (0.75, set())):
            links, comp = C.graph(vecs, V.Index(cent, index.books, index.eta), Scratch(spark), threshold, 3, exact=exact)
            assert {tuple(r) for r in comp.collect()} == want
            assert links.count() == len(want)


def test_exact_search_equals_brute_force_whatever_the_lists(spark):
    # Lists that no vector is near to, one to a cell: only the exact setting has to find all.
    rng = np.random.default_rng(8)
    x = groups(rng, [50, 40, 30, 9, 1, 1], noise=0.8)
    s = cosines(x)
    vecs = spark.createDataFrame(list(enumerate(packed(x))), "vid long, vec binary")
    index = V.fit(np.array(x), 4, 0.7)
    cent = V._unit(rng.normal(size=(40, DIM))).astype(np.float32)
    want = {(i, j) for i in range(len(x)) for _, j in sorted((-s[i, j], j) for j in range(len(x)) if j != i and s[i, j] >= 0.7)[:4]}
    comp = list(range(len(x)))
    for _ in comp:
        comp = [min(comp[j] for j in np.flatnonzero((s[i] >= 0.7) | (np.arange(len(x)) == i))) for i in range(len(x))]
    for block in (8, 1000):
        links, got = C.graph(vecs, V.Index(cent, index.books, index.eta, np.arange(40, dtype=np.int32)), Scratch(spark), 0.7, 4, exact=True, block=block, q_block=block)
        assert {tuple(r) for r in links.collect()} == want
        assert {tuple(r) for r in got.collect()} == {(i, c) for i, c in enumerate(comp) if comp.count(c) > 1}


def test_components_are_whole_though_few_links_leave_a_task(spark):
    rng = np.random.default_rng(9)
    x = groups(rng, [400, 5], noise=0.3)
    vecs = spark.createDataFrame(list(enumerate(packed(x))), "vid long, vec binary")
    index = V.fit(np.array(x), 6, 0.7)
    found = V.search(vecs, index, Scratch(spark), 1, 0.7, forest=True, block=64).collect()
    assert len(found) < 12 * len(x)
    links, comp = C.graph(vecs, index, Scratch(spark), 0.7, 1)
    assert {r["component"] for r in comp.collect()} == {0, 400} and comp.count() == 405


def test_cells_keep_their_weight():
    rng = np.random.default_rng(10)
    cent = V._unit(rng.normal(size=(200, DIM)))
    w = rng.integers(1, 50, 200)
    c = V.cells(cent, w, 300)
    assert np.bincount(c, weights=w).max() <= 300 and set(c) == set(range(c.max() + 1))
    assert len(set(V.cells(cent, np.zeros(200), 1))) == 1
    assert len(set(V.cells(np.tile(cent[:1], (9, 1)), np.ones(9), 1))) == 9  # equal centroids


def test_scratch_is_dropped(spark):
    s = Scratch(spark)
    t = s.keep(spark.range(3))
    assert t.count() == 3
    s.drop(t)
    assert not s.paths
