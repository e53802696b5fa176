import random

import numpy as np
import pytest

from loamdex.operators import changes as C
from loamdex.operators import chunking, code, density, flowq, fusion, graph, hierarchy, incremental, lexical
from loamdex.operators.components import components
from loamdex.sources import files as SF
from loamdex.sources.catalog import Catalog, SchemaMismatch

NODE = "id long, parent_id long, k long, root_id long, depth string, end long, n int"


def truth(par):
    out = {}
    for i in par:
        seen, x = [], i
        while x is not None and x not in seen:
            seen.append(x)
            x = par[x] if par[x] in par else None
        out[i] = (seen[-1], len(seen) - 1) if x is None else (min(seen[seen.index(x) :]), -1)
    return out


def forest(rng, n):
    ids = rng.sample(range(-(10**12), 10**12), n)
    par = {}
    for k, i in enumerate(ids):
        r = rng.random()
        par[i] = None if r < 0.05 or not k else 5 * 10**12 + k if r < 0.08 else ids[k - 1] if r < 0.5 else rng.choice(ids[:k])
    for _ in range(4):  # close circles
        a = rng.choice(ids)
        b = a
        for _ in range(rng.randint(0, 5)):
            b = par[b] if par[b] in par else b
        par[b] = a
    return par


@pytest.mark.parametrize("per_task", [250_000, 40])
def test_hierarchy_equals_brute_force(spark, per_task):
    par = forest(random.Random(per_task), 400)
    rows = [(i, p, 1, 2, "x", 3, 4) for i, p in par.items()]
    rows += rows[:50] + [(None, 1, 1, 2, "x", 3, 4)]
    df = spark.createDataFrame(rows, NODE)
    h = hierarchy.hierarchy(df, rows_per_task=per_task).cache()
    want = truth(par)
    got = {r["id"]: (r["root_id"], r["depth"]) for r in h.collect()}
    assert got == want and h.count() == len(par)
    on = {i for i in par if want[i][1] < 0 and (lambda s: i in s)([x for x in chain(par, par[i])])}
    assert {r["id"] for r in h.filter("on_circle").collect()} == on
    p = hierarchy.paths(h, per_task).cache()
    for r in p.filter("depth >= 0").collect():
        assert list(r["path"]) == chain(par, r["id"])[::-1]
    pairs = hierarchy.descendant_pairs(p)
    assert pairs.count() == h.agg({"n_descendants": "sum"}).first()[0]
    c = hierarchy.circles(h).agg({"n_on_circle": "sum"}).first()[0]
    assert c == len(on)


def chain(par, i):
    out = []
    while i in par and i not in out:
        out.append(i)
        i = par[i]
    return out


def test_hierarchy_hot_parent_deep_chain_and_empty(spark):
    rows = [(1, None)] + [(i, 1) for i in range(2, 1500)] + [(5000, None)] + [(5000 + i, 4999 + i) for i in range(1, 700)] + [(9000, 9000)]
    h = {r["id"]: r for r in hierarchy.hierarchy(spark.createDataFrame(rows, "id long, parent_id long"), rows_per_task=300).collect()}
    assert h[1]["n_descendants"] == 1498 and h[5699]["depth"] == 699 and h[9000]["depth"] == -1 and h[9000]["on_circle"]
    assert hierarchy.hierarchy(spark.createDataFrame([], "id long, parent_id long")).count() == 0


@pytest.mark.parametrize("per_task", [2_000_000, 30])
def test_components(spark, per_task):
    rng = random.Random(7)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 3), (5, 5)]
    low = {}
    for a, b in links:
        if a is not None:
            low.setdefault(a, a)
            low.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            if a is not None:
                low[a] = low[b] = min(low[a], low[b])
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long"), per_task).collect()}
    assert got == low
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


RUNS = "run_id long, started_at long, finished_at long, status string"


def test_pending_files(spark):
    day = 86_400
    runs = spark.createDataFrame([(1, day, day + 9, "succeeded"), (2, 3 * day, None, "aborted"), (3, 9 * day, 9 * day + 5, "succeeded"), (4, 9 * day + 100, None, "running")], RUNS)
    log = [("r", "a.py", "AA", 1, day + 1), ("r", "./a.py", "sha256:aa", 1, day + 1), ("r", "b.py", "bb", 1, 3 * day + 4), ("r", "c.py", "c0", None, day), ("r", "d.py", "dd", 1, 9 * day + 101), ("r", "x/e.py", "ee", 1, 9 * day),
           ("r", "f.py", "f1", 1, day - 1), (None, "g", "g", 1, day), ("r", "h.py", "h1", 1, None), ("r", "k.py", None, 1, day)]
    scan = [("r", "a.py", "aa", 1, 5), ("r", "b.py", "bb", 1, 5), ("r", "c.py", "c1", 1, 5), ("r", "c.py", "c0", 1, 4), ("r", "d.py", "dd", 1, 5), ("r", "x\\e.py", "EE", 1, 5), ("r", "f.py", "f1", 1, 5), ("r", "gone.py", "zz", 1, 4),
            ("r", "gone.py", None, None, 5), ("r", "new//n.py", "nn", 1, 5), ("r", "new/n.py", "nn", 1, 5), (None, "q", "q", 1, 5), ("r", None, "q", 1, 5), ("r", "h.py", "h1", 1, None), ("r", "k.py", "kk", 1, 1)]
    m = spark.createDataFrame(log, "repo string, file_path string, blob_sha string, run_id long, last_indexed_at long")
    s = spark.createDataFrame(scan, "repo string, file_path string, blob_sha string, run_id long, scanned_at long")
    got = {r["file_path"]: r["reason"] for r in C.pending_files(s, m, runs).collect()}
    assert got == {"b.py": "new", "c.py": "changed", "d.py": "new", "f.py": "new", "new/n.py": "new", "h.py": "new", "k.py": "changed"}
    assert C.pending_files(s.limit(0), m, runs).count() == 0
    assert {r["file_path"] for r in C.pending_files(s, m, runs.limit(0)).collect()} >= {"a.py"}
    assert C.low_watermark(runs).first()[0] == 9 * day
    assert C.low_watermark(runs.filter("run_id = 2")).first()[0] is None


def test_changed_since_survives_failures(spark):
    src = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 15), ("b", 1, 16), ("c", 5, 30), (None, 1, 40), ("d", None, 40), ("e", 1, None)], "k string, v int, at long")
    ledger = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    mark = spark.createDataFrame([(15,)], "watermark long")
    assert {(r.k, r.v) for r in C.changed_since(src, ledger, mark, ["k"], "v", "at").collect()} == {("a", 2), ("c", 5)}
    assert {(r.k, r.v) for r in C.changed_since(src, ledger.limit(0), spark.createDataFrame([(None,)], "watermark long"), ["k"], "v", "at").collect()} == {("a", 1), ("a", 2), ("b", 1), ("c", 5), ("e", 1)}


def test_pagerank_joins_equal_kernel(spark):
    rng = random.Random(3)
    v = spark.range(40)
    e = spark.createDataFrame(list({(rng.randint(0, 39), rng.randint(0, 39)): None for _ in range(90)}), "src long, dst long").selectExpr("src", "dst", "'calls' kind", "1.0D + src % 3 weight")
    one = {r[0]: r[1] for r in graph.pagerank(v, e, most=6, tol=0.0).collect()}
    two = {r[0]: r[1] for r in graph.pagerank(v, e, most=6, tol=0.0, edges_per_task=1).collect()}
    assert abs(sum(one.values()) - 1) < 1e-9 and all(abs(one[k] - two[k]) < 1e-12 for k in one)
    par = spark.createDataFrame([(0, 1, "calls", 9.0), (0, 1, "imports", 1.0), (0, 2, "calls", 1.0)], "src long, dst long, kind string, weight double")
    s = {r[0]: r[1] for r in graph.pagerank(spark.range(3), par, most=50).collect()}
    assert abs(s[1] - s[2]) < 1e-9  # the kind that sorts last gives the weight of parallel edges


def test_edge_resolution(spark):
    n = spark.createDataFrame([(1, "function", "a/x.py::f", "f", "a/x.py"), (2, "function", "a/y.py::g", "g", "a/y.py"), (3, "function", "b/z.py::g", "g", "b/z.py"), (4, "class", "b/z.py::K", "K", "b/z.py"), (5, "block", "a/x.py::f#b", "b", "a/x.py")], "id long, kind string, name string, short_name string, file_path string")
    raw = spark.createDataFrame([("a/x.py::f", "g", "calls", 3.0), ("f", "K", "calls", 3.0), ("f", "K", "inherits", 3.0), ("a/x.py::f", "f", "calls", 3.0), ("nobody", "g", "calls", 3.0), ("b/z.py::K", "g", "references", 2.0), ("f", "zzz", "calls", 1.0)], "src_name string, dst_name string, kind string, weight double")
    got = {(r.src, r.dst, r.kind) for r in graph.resolve_edges(raw, n).collect()}
    assert got == {(1, 2, "calls"), (1, 4, "inherits"), (4, 3, "references")}


def test_rrf_ties_and_weights(spark):
    a, b = (spark.createDataFrame([(i, 1)], "id long, rank int") for i in (1, 2))
    assert [r.id for r in fusion.rrf([("x", a), ("y", b)]).orderBy("rank").collect()] == [1, 2]
    assert [r.id for r in fusion.rrf([("x", a), ("y", b)], [0.1, 1.0]).orderBy("rank").collect()] == [2, 1]
    with pytest.raises(ValueError):
        fusion.rrf([("x", a)], [1.0, 2.0])
    assert fusion.refined("q", []) == ["q"] and fusion.refined("q", [("a", 1.0)]) == [] and fusion.refined("q", [(None, 0.1), ("b", 0.1)]) == ["q b"]


def test_identifiers_and_porter(spark):
    from pyspark.sql import functions as F

    from loamdex.functions import text as T

    df = spark.createDataFrame([("authenticate_user camelCase HTTPServer2 user_id",)], "t string").select(F.explode(T.identifiers("t")).alias("x")).select(F.explode(T.identifier_parts(F.col("x"))).alias("p"))
    assert {r.p for r in df.collect()} == {"authenticate_user", "authenticate", "user", "camelCase", "camel", "Case", "HTTPServer2", "HTTP", "Server2", "user_id", "id"}
    assert set(spark.range(1).select(T.trigrams(F.lit("Auth"))).first()[0]) == {"  a", " au", "aut", "uth", "th "}
    for w, s in {"running": "run", "authenticate": "authent", "relational": "relat", "hopping": "hop", "caresses": "caress", "ponies": "poni", "sky": "sky", "generalization": "gener"}.items():
        assert lexical.porter(w) == s, w
    lanes = {q: spark.range(1).select(T.route(F.lit(q))).first()[0] for q in ("", "regex:a b", "find foo", "where is Foo", "a.b", "one two three", "one two three four")}
    assert lanes == {"": "full", "regex:a b": "fast", "find foo": "fast", "where is Foo": "fast", "a.b": "full", "one two three": "fast", "one two three four": "full"}


def test_chunks_tile_files(spark):
    src = "import os\n\n\nclass A:\n    '''doc'''\n" + "".join(f"    def m{i}(self):\n        return {i} + {'x' * 80!r}\n\n" for i in range(30)) + "\n\ndef f(x):\n    return 'ünï'\n"
    for text in ("", "a", "a\n\nb", "x" * 4000 + "\n" + "y\n" * 900, src):
        w = chunking.windows(text)
        assert "".join(text.encode()[s:e].decode() for _, _, s, e in w) == text
        assert all(a[3] == b[2] for a, b in zip(w, w[1:]))
    got = chunking.syntax_chunks("a.py", src)
    raw = src.encode()
    assert b"".join(raw[s:e] for *_, s, e in got) == raw
    assert ("function", "f", "module/function[f]") in {g[:3] for g in got} and any(g[0] == "method" and g[2] == "module/class[A]/method[m3]" for g in got)
    df = spark.createDataFrame([("a.py", src), ("b.txt", "x\r\ny"), ("c.py", "def ("), ("d", None)], "path string, text string")
    out = chunking.chunk_files(df).collect()
    assert {r.kind for r in out if r.path == "c.py"} == {"window"} and "".join(r.content for r in out if r.path == "b.txt") == "x\ny"


def test_flow_of_a_branch(spark):
    src = "def choose(flag):\n    x = 1\n    if flag:\n        x = 2\n    return x\n"
    _, edges = code.extract(spark.createDataFrame([("m.py", src)], "path string, text string"), "flow")
    f = flowq.typed(edges).cache()
    assert {r.definition_line for r in flowq.reaching_definitions(f, "x", 5).collect()} == {2, 4}
    cond = {(r.variable, r.definition_line): r.predicates for r in flowq.conditions_for(f).collect()}
    assert cond["x", 4] == ["flag"] and cond["flag", 1] == []
    paths = [r.path for r in flowq.paths_through(f, hops=9).orderBy("path_index").collect()]
    assert len(paths) == 2 and all(p[0].endswith("#entry") and p[-1].endswith("#exit") for p in paths)


def test_symbols(spark):
    src = "import os\nfrom a import b\nclass K(Base):\n    def m(self):\n        return run()\n"
    n, e = code.extract(spark.createDataFrame([("p/m.py", src), ("x.js", "f()")], "path string, text string"))
    assert {(r.kind, r.name) for r in n.collect()} == {("file", "p/m.py"), ("class", "p/m.py::K"), ("method", "p/m.py::K::m"), ("file", "x.js")}
    assert {(r.src_name, r.dst_name, r.kind) for r in e.collect()} >= {("p/m.py", "os", "imports"), ("p/m.py", "b", "imports"), ("p/m.py::K", "Base", "inherits"), ("p/m.py::K::m", "run", "calls"), ("p/m.py::K", "p/m.py::K::m", "contains")}


def test_concepts_cluster_all_rows(spark):
    # 5,700 rows, of which a cluster of 10 would have about 7 rows in a sample of 4,000.
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(5, 16))
    x = np.concatenate([centre[i] + rng.normal(size=(m, 16)) * 0.05 for i, m in enumerate((2100, 2000, 1500, 10, 10))] + [rng.normal(size=(48, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["id"]: (r["cluster_id"], r["membership"]) for r in density.concepts(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e").collect()}
    for a, b in ((5600, 5610), (5610, 5620)):
        inside = [got.get(i, (-1, 0))[0] for i in range(a, b)]
        main = max(set(inside), key=inside.count)
        assert main >= 0 and inside.count(main) > 0.7 * len(inside)
        assert all(a <= i < b for i, (c, _) in got.items() if c == main and i < 5620)
    assert sum(i >= 5620 for i in got) < 24  # noise stays noise
    some = spark.createDataFrame([r for r in rows if r[0] % 9 == 0 or r[0] > 5600], "id long, e array<double>")
    one = {tuple(r) for r in density.concepts(some, "id", "e").collect()}
    assert one and {tuple(r) for r in density.concepts(some, "id", "e", block=100).collect()} == one


def test_density_finds_blobs():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 4)) * 0.1 + c for c in (0, 3, 6)] + [rng.uniform(-9, 15, size=(6, 4))])
    label, prob = density.hdbscan(x)
    assert len(set(label[:180]) - {-1}) == 3 and (prob >= 0).all() and (prob <= 1).all()
    assert (density.hdbscan(x[:9])[0] == -1).all()


def test_catalog_swaps_atomically(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.write("r", {"a": spark.range(3), "b": spark.range(2)})
    with pytest.raises(Exception):  # noqa: B017
        c.write("r", {"a": spark.range(5).selectExpr("raise_error('x') as y")})
    assert c.read("r", "a").count() == 3 and c.names() == ["r"]
    c.write("r", {"a": spark.range(7)})
    assert c.read("r", "a").count() == 7 and c.read("r", "b").count() == 2
    with pytest.raises(SchemaMismatch):
        c.info("none")


def test_scan_and_eval_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    for p, b in {"src/a.py": b"x = 1\r\n", "src/b.bin": b"a\x00b", "src/__init__.py": b"", "skip.log": b"x", ".git/c": b"x", "keep.log": b"y", "d.md": b"# t", "bad.txt": b"\xff"}.items():
        (tmp_path / p).write_bytes(b)
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n")
    got = {r.path: r for r in SF.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.py", "keep.log", "d.md", "bad.txt", ".gitignore", "src/__init__.py"}
    assert got["src/a.py"].text == "x = 1\n" and got["bad.txt"].text == "\ufffd" and got["d.md"].category == "docs"
    q = tmp_path / "q.jsonl"
    q.write_text('{"query": "a", "expected_files": ["x"]}\n\n')
    assert len(SF.eval_queries([str(q), str(q)])) == 1
    q.write_text('{"query": "", "expected_files": []}\n')
    with pytest.raises(ValueError, match=":1:"):
        SF.eval_queries([str(q)])
    assert SF.is_url("git@x:y/z.git") and SF.repo_name("git@x:y/z.git") == "z" and SF.repo_name("a:b") == "b"


def test_upsert_and_delta(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, at int")
    new = spark.createDataFrame([("a", 2, 1), ("c", 1, 5)], "k string, v int, at int")
    assert {(r.k, r.v) for r in incremental.upsert(old, new, ["k"], "at").collect()} == {("a", 2), ("b", 1), ("c", 1)}
    d = {r.k: r.status for r in incremental.delta(old.withColumnRenamed("v", "blob_sha"), new.withColumnRenamed("v", "blob_sha"), ["k"]).collect()}
    assert d == {"a": "modified", "b": "removed", "c": "added"}
