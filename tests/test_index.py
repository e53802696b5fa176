"""Written indexes, what reads them, and graph operators on hot names and large frontiers."""

import pytest
from pyspark.sql import functions as F

from loamdex.operators import flowq, fusion, graph, lexical, relate
from loamdex.session import Scratch
from loamdex.sources import catalog as C


def test_buckets_agree(spark):
    for kind, keys in (("bigint", [0, 1, -5, 2**40, None]), ("int", [3, -3, None]), ("string", ["", "a", "ünï", "x" * 90, None])):
        df = spark.createDataFrame([(k,) for k in keys if k is not None], f"k {kind}").select("k", C.bucket(F.col("k"), 37).alias("b"))
        assert all(C.bucket_of(r.k, kind, 37) == r.b for r in df.collect())


def test_keyed_tables_are_read_by_their_keys(spark, tmp_path):
    c = C.Catalog(spark, str(tmp_path))
    t = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    c.write("x", {"t": t, "u": t}, keys={"t": "id"}, buckets=8)
    got = c.read("x", "t", [3, 999, 5000])
    assert {r.id for r in got.collect()} == {3, 999} and got.columns == ["id", "v"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(id" in plan
    assert c.read("x", "t").count() == 1000 and c.read("x", "t", []).count() == 0 and c.read("x", "u").count() == 1000
    c.write("x", {"u": t})
    assert c.vacuum("x") == [] and c.info("x")["version"] == 2
    c.write("x", {"t": t.limit(5)}, keys={"t": "id"})
    assert c.vacuum("x") == ["v1"] and c.read("x", "t").count() == 5 and c.read("x", "u").count() == 1000
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "CURRENT").write_text('{"schema_version": "0"}')
    assert {(r.name, r.state) for r in c.listing().collect()} == {("x", "ok"), ("bad", "schema 0, expected 1.1")}


def test_data_home():
    assert C.data_home({"LOAMDEX_DATA_HOME": "/d", "HOME": "/h"}) == "/d"
    assert C.data_home({"LOAMDEX_PLUGIN_DATA": "/p", "HOME": "/h"}) == "/p"
    assert C.data_home({"HOME": "/h"}, "linux") == "/h/.local/share/loamdex"
    assert C.data_home({"HOME": "/h"}, "darwin") == "/h/Library/Application Support/loamdex"


def test_bm25_counts_repeated_words_and_edges(spark):
    docs = spark.createDataFrame([(1, "a b a", "x"), (2, "b c", "y"), (3, "", "x"), (4, None, "x"), (5, "c d", None), (6, "e", "x"), (7, "Ü-b a", "x")], "doc_id long, text string, tag string")
    one = {r.id: r.score for r in lexical.bm25(docs, "a").collect()}
    two = {r.id: r.score for r in lexical.bm25(docs, "a a").collect()}
    assert set(one) == {1, 7} and all(abs(two[i] - 2 * s) < 1e-8 for i, s in one.items())
    assert [r.id for r in lexical.bm25(docs, "u-b").collect()] == [7] and lexical.bm25(docs, " - ").count() == 0
    assert {r.id for r in lexical.bm25(docs, "b c", tag=F.col("tag"), tags=["y"]).collect()} == {2}
    assert {r.id for r in lexical.bm25(docs, "a-b-a b", 9).collect()} == {1, 2, 7}
    assert lexical.bm25(docs.limit(0), "a").count() == 0
    p = {(r.term, r.id): r.positions for r in lexical.postings(docs).collect()}
    assert p["a", 1] == [0, 2] and p["b", 7] == [1] and len(p) == 10
    assert lexical.lengths(docs).first() == (7, pytest.approx(11 / 7))


def test_number_nodes(spark):
    rows = [("f", 0, 90, "f", None), ("f", 0, 50, "f::A", "f"), ("f", 5, 9, "f::A::m", "f::A"), ("f", 60, 70, "f::A", "f"), ("f", 62, 64, "f::A::n", "f::A"), ("g", 0, 5, "g", None), ("g", 1, 2, "g::q", "h::none")]
    df = spark.createDataFrame(rows, "file_path string, start_byte long, end_byte long, name string, parent_name string").repartition(5)
    got = {(r["name"], r.start_byte): (r.id, r.parent_id) for r in graph.number_nodes(df).collect()}
    assert got == {("f", 0): (1, None), ("f::A", 0): (2, 1), ("f::A::m", 5): (3, 2), ("f::A", 60): (4, 1), ("f::A::n", 62): (5, 4), ("g", 0): (6, None), ("g::q", 1): (7, None)}
    assert graph.number_nodes(df.limit(0)).count() == 0


def test_a_name_that_everyone_uses_is_resolved_without_pairs(spark):
    # 300 folders define and call `get`; 4,000 calls meet 300 definitions.
    nodes = [(i, "function", f"p{i}/m.py::get", "get", f"p{i}/m.py") for i in range(300)]
    nodes += [(1000 + i, "function", f"p{i % 300}/m.py::c{i}", f"c{i}", f"p{i % 300}/m.py") for i in range(4000)]
    raw = [(n[2], "get", "calls", 3.0) for n in nodes[300:]]
    n = spark.createDataFrame(nodes, "id long, kind string, name string, short_name string, file_path string")
    e = graph.resolve_edges(spark.createDataFrame(raw, "src_name string, dst_name string, kind string, weight double"), n)
    got = e.collect()
    assert len(got) == 4000 and all(r.dst == (r.src - 1000) % 300 for r in got)


def test_edges_by_folder(spark):
    n = spark.createDataFrame(
        [(1, "function", "a/b/x.py::f", "f", "a/b/x.py"), (2, "function", "a/c/y.py::f", "f", "a/c/y.py"), (3, "class", "z.py::f", "f", "z.py"), (4, "function", "a/b/w.py::s", "s", "a/b/w.py"),
         (5, "function", "a/d/v.py::t", "t", "a/d/v.py"), (6, "function", "q/u.py::k", "k", "q/u.py"), (7, "class", "z.py::K", "K", "z.py")],
        "id long, kind string, name string, short_name string, file_path string",
    )
    raw = [("a/b/w.py::s", "f", "calls", 3.0), ("t", "f", "calls", 3.0), ("k", "f", "calls", 3.0), ("t", "f", "inherits", 3.0), ("k", "K", "imports", 1.5), ("k", "k", "calls", 3.0), ("none", "f", "calls", 3.0), ("k", "z.py::K", "calls", 3.0)]
    got = {(r.src, r.dst, r.kind) for r in graph.resolve_edges(spark.createDataFrame(raw, "src_name string, dst_name string, kind string, weight double"), n).collect()}
    # In the own folder; ambiguous under a/; no common folder; by kind; exactly one; itself; unknown; a class isn't called.
    assert got == {(4, 1, "calls"), (5, 3, "inherits"), (6, 7, "imports")}


def test_frontiers_as_filters_and_as_tables(spark):
    rows = [(i, j, "contains", 1.0) for i in range(40) for j in (2 * i + 1, 2 * i + 2)] + [(7, 3, "contains", 1.0), (5, 0, "calls", 1.0)]
    e = spark.createDataFrame(rows, "src long, dst long, kind string, weight double")
    for directed in (False, True):
        few = {tuple(r) for r in graph.reach(e, [0], 4, directed, ["contains"]).collect()}
        many = {tuple(r) for r in graph.reach(e, [0], 4, directed, ["contains"], keys=2).collect()}
        assert few == many and len(few) == 31
    for keys in (1, 1000):
        assert [r.id for r in graph.shortest_path(e, 0, 37, keys=keys).orderBy("path_index").collect()] == [0, 1, 3, 8, 18, 37]
        assert graph.shortest_path(e, 0, 37, 4, keys=keys).count() == 0 and graph.shortest_path(e, 79, 0, keys=keys).count() == 0


def test_lanes(spark):
    rank = lambda *ids: spark.createDataFrame([(i, k) for k, i in enumerate(ids, 1)], "id long, rank int")
    text = spark.createDataFrame([(i, f"f{i}", "function", f"n{i}", 1, 2, "alpha beta" if i == 9 else "alpha") for i in range(1, 8)] + [(9, "f9", "function", None, 1, 2, "alpha beta")], "id long, file_path string, kind string, name string, start_line int, end_line int, content string")
    got: dict = {}

    def ppr(w):
        got.update({r.id: r.weight for r in w.groupBy("id").agg(F.max("weight").alias("weight")).collect()})
        return rank(2)

    best = fusion.full_lane([("bm25", rank(1, 2)), ("dense", rank(2, 3))], [("bm25-context", rank(9))], lambda s: rank(2, 5), ppr, lambda f: fusion.rerank(f, text, "alpha beta", "content"))
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 5: 0.25}
    res = fusion.assemble_results(best, text).orderBy("rank").collect()
    assert [r.chunk_id for r in res][:2] == [9, 2] and {r.chunk_id for r in res} == {1, 2, 3, 5, 9}
    assert res[1].why == "bm25+dense+graph+ppr" and [r.rank for r in res] == [1, 2, 3, 4, 5]
    env = fusion.envelope("r", "alpha beta", "full", fusion.assemble_results(best, text), "/x", 2, "words", 2)
    assert set(env) == {"repo", "query", "repo_dir", "pipeline_used", "results", "refined_queries", "expansion_size", "reranker_model"}
    assert len(env["results"]) == 2 and env["results"][0]["file_absolute"] == "/x/f9" and env["refined_queries"] == []
    assert fusion.refined("q", [("a", 0.5), (None, 0.4), ("b", 0.1)]) == ["q a", "q b"] and fusion.refined("q", []) == ["q"]
    with pytest.raises(ValueError):
        fusion.rrf([("a", rank(1))], [1.0, 2.0])


class Tables:
    def __init__(self, spark):
        n = [(1, "function", "p/a.py::login", "login", "p/a.py", 0.8), (2, "function", "p/r.py::route", "route", "p/r.py", 0.5), (3, "function", "p/d.py::fetch", "fetch", "p/d.py", 0.3), (4, "class", "p/b.py::Base", "Base", "p/b.py", 0.2),
             (5, "class", "p/c.py::Token", "Token", "p/c.py", 0.1), (6, "block", "p/a.py::login#entry", "entry", "p/a.py", 0.99), (7, "block", "p/a.py::login#block_1", "block_1", "p/a.py", 0.0), (8, "block", "p/a.py::login#exit", "exit", "p/a.py", 0.0)]
        nodes = spark.createDataFrame([(*r, 1, 2, None, None) for r in n], "id long, kind string, name string, short_name string, file_path string, pagerank double, start_line int, end_line int, signature string, chunk_id long")
        self.edges = spark.createDataFrame([(2, 1, "calls", 1.0), (1, 3, "calls", 1.0), (5, 4, "inherits", 1.0), (1, 6, "contains", 1.0)], "src long, dst long, kind string, weight double")
        f, m = "p/a.py::login", '{"variable": "x%s", "var": "x%s", "definition_line": 1, "use_line": 2}'
        flow = [(f + "#entry", f + "#block_1", "controls", None), (f + "#block_1", f + "#exit", "controls", None), (f + "#entry", f + "#block_1", "dataflow", m % ("", "")), (f + "#block_1", f + "#block_1", "guards", '{"predicate": "x > 1", "branch": "if", "line": 2}'),
                (f + "#entry", f + "#block_1", "dataflow", m % ("_1", "_1"))]
        self.tables = {
            "nodes": nodes, "names": nodes, "blocks": nodes.filter("kind = 'block'").withColumn("function", F.regexp_replace("name", "#.*", "")),
            "flow": spark.createDataFrame([(*r, f) for r in flow], "src_name string, dst_name string, kind string, metadata string, function string"),
        }

    def read(self, name, keys=None):
        t = self.tables[name]
        return t if keys is None else t.filter(F.col({"names": "short_name", "nodes": "id"}.get(name, "function")).isin(keys))

    def adjacency(self):
        return graph.Adjacency.of(self.edges)


def test_relate_verbs(spark):
    t = Tables(spark)
    names = lambda a, c="name": [r[c] for r in a.envelope("r")["results"]]
    assert names(relate.run(t, "callers", "login")) == ["p/r.py::route"] and names(relate.run(t, "callees", "p/a.py::login")) == ["p/d.py::fetch"]
    assert names(relate.run(t, "neighbors", "login", hops=1)) == ["p/r.py::route", "p/d.py::fetch"]
    assert names(relate.run(t, "graph", "::LOGIN", hops=0)) == names(relate.run(t, "neighbors", "login", hops=1))
    assert names(relate.run(t, "inheritance-chain", "Token")) == ["p/b.py::Base"] and names(relate.run(t, "pagerank-top", top_k=-1)) == ["p/a.py::login"]
    path = relate.run(t, "shortest-path", "route", "fetch").envelope("r")
    assert [r["id"] for r in path["results"]] == [2, 1, 3] and path["query"] == {"source": "route", "target": "fetch"}
    assert relate.run(t, "shortest-path", "route").warnings and relate.run(t, "who", "x").warnings == ["unsupported relate verb: who"] and relate.run(t, "callers", "nobody").warnings
    got = relate.run(t, "flow", "login").envelope("r")["results"]
    assert {r["edge_kind"] for r in got} == {"path", "edge"} and ["entry", "block_1", "exit"] in [r["path"] for r in got]
    assert relate.run(t, "paths-through", "login", "9:5").envelope("r")["results"] == [] and len(relate.run(t, "paths-through", "login", "[2,1]").envelope("r")["results"]) == 1
    d = relate.run(t, "reaching-definitions", "x@2").envelope("r")["results"]
    assert [(r["node"], r["variables"]) for r in d] == [("p/a.py::login#entry", ["x"])]
    assert len(relate.run(t, "reachable-uses", "p/a.py::login").envelope("r")["results"]) == 2
    c = relate.run(t, "conditions-for", "x@2").envelope("r")["results"]
    assert [r["variables"] for r in c] == [["x"]]
    assert [r["variables"] for r in relate.run(t, "reaching-definitions", "x_1").envelope("r")["results"]] == [["x_1"]]  # no symbol: what metadata name, exactly
    t.tables["flow"] = t.tables["flow"].limit(0)
    assert relate.run(t, "flow", "login").warnings == ["flow not indexed"]


def test_flow_helpers(spark):
    assert flowq.parse_site("a@b@7") == ("a@b", 7) and flowq.parse_site("x") is None and flowq.parse_site("@3") is None
    assert flowq.parse_lines("[9, 3]") == (3, 9) and flowq.parse_lines("3:9") == (3, 9) and flowq.parse_lines("3") is None
    t = Tables(spark)
    e = flowq.ends(t.read("blocks"), flowq.typed(t.read("flow"))).first()
    assert (e.first, e.last) == ("p/a.py::login#entry", "p/a.py::login#exit")
    assert flowq.metadata_match(t.read("flow"), "x > 1").count() == 1 and flowq.metadata_match(t.read("flow"), "x >").count() == 0


def test_concepts(spark):
    clusters = spark.createDataFrame([(1, "a_b", 3, [1.0, 0.0]), (2, "axb", 2, [0.0, 1.0]), (3, None, 1, None)], "id long, label string, size int, centroid array<float>")
    members = spark.createDataFrame([(10, 1, 0.9), (11, 1, None), (12, 2, 0.8)], "chunk_id long, cluster_id long, membership double")
    chunks = spark.createDataFrame([(10, "f", 1), (11, "f", 2), (12, "g", 1)], "id long, file_path string, start_line int")
    assert [r.chunk_id for r in relate.concepts_by_label(clusters, members, chunks, "A_B").collect()] == [10, 11]
    got = relate.concepts_by_centroid(clusters, members, [0.1, 1.0])
    assert [r.chunk_id for r in got.results.collect()] == [12, 10, 11]
    no = relate.concepts_by_centroid(clusters, members, [0.1, 1.0], made_with={"model": "a"}, asked_with={"model": "b"})
    assert no.results is None and "model" in no.warnings[0]


def test_scratch_tables_live_in_the_shared_folder(spark):
    s = Scratch(spark)
    t = s.keep(spark.range(2))
    assert t.count() == 2
    s.close()
    assert not s.paths


def test_nearest_centroid_and_merkle_edges(spark, monkeypatch):
    import hashlib

    from loamdex.operators import incremental, vector

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [0.5, 0.5])], "id long, e array<double>")
    c = spark.createDataFrame([(9, [1.0, 0.0]), (7, [0.0, 1.0]), (8, None), (5, [2.0])], "c long, m array<double>")
    want = {(1, 9), (2, 7), (6, 7)}
    assert {(r.id, r.nearest) for r in vector.nearest_centroid(v, c.filter("c <> 5"), "id", "e", "c", "m").collect()} == want
    monkeypatch.setattr(vector, "CENTROIDS", 1)
    assert {(r.id, r.nearest) for r in vector.nearest_centroid(v, c.filter("c in (7, 9)"), "id", "e", "c", "m").collect()} == want
    assert vector.nearest_centroid(v, c.limit(0), "id", "e", "c", "m").count() == 0
    f = spark.createDataFrame([("b", "2"), ("a", "1"), ("b", "2"), (None, "3"), ("c", None)], "file_path string, blob_sha string")
    assert incremental.merkle_root(f).first()[0] == hashlib.sha256(b"a\x001\x00b\x002\x00").hexdigest()
    assert incremental.merkle_root(f.limit(0)).first()[0] == hashlib.sha256(b"").hexdigest()
    assert len(incremental.merkle_fold(f).first()[0]) == 64


def test_update_policy_and_update(spark):
    from loamdex.operators import incremental as I

    delta = lambda *s: spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(s)], "f string, status string")
    e = {"model": "m", "dim": 4, "quant": "int8"}
    ok = {**e, "clusters_current": True}
    assert I.update_policy(None, e, None)[0] == "full" and I.update_policy(ok, e, delta("unchanged"), 3)[0] == "full"
    assert I.update_policy(ok, {**e, "dim": 5}, None)[0] == "abort" and I.update_policy(ok, {**e, "model": "n"}, None)[0] == "full"
    assert I.update_policy(ok, e, delta("unchanged"))[0] == "none" and I.update_policy(e, e, delta("unchanged"))[0] == "update" and I.update_policy(ok, e, delta("removed"))[0] == "update"
    old = spark.createDataFrame([(1, "f0", 0), (2, "f1", 0), (3, "f1", 9), (7, "f2", 0), (8, "f3", 0)], "id long, f string, start_byte long")
    new = spark.createDataFrame([(None, "f1", 0), (None, "f1", 5), (None, "f4", 0), (None, "f3", 1), (None, "f0", 3)], "id long, f string, start_byte long")
    got = {tuple(r) for r in I.apply_update(old, new, delta("unchanged", "modified", "removed", "modified", "added"), ["f"], spark.createDataFrame([("f3",)], "f string")).collect()}
    assert got == {(1, "f0", 0), (8, "f3", 0), (9, "f1", 0), (10, "f1", 5), (11, "f4", 0)}


def test_one_tree_and_one_day(spark):
    from loamdex.operators import changes, hierarchy

    # A chain of 60 with 20 leaves at each node in one tree; partitions of a few rows.
    rows = [(i, i - 1 if i else None) for i in range(60)] + [(100 + 20 * i + j, i) for i in range(60) for j in range(20)]
    h = hierarchy.hierarchy(spark.createDataFrame(rows, "id long, parent_id long"))
    want = {i: list(range(i + 1)) for i in range(60)} | {100 + 20 * i + j: [*range(i + 1), 100 + 20 * i + j] for i in range(60) for j in range(20)}
    assert {r.id: r.path for r in hierarchy.paths(h, rows_per_task=50).collect()} == want
    runs = spark.createDataFrame([(1, 100, "failed"), (2, 200, "succeeded"), (3, 90_000, "succeeded")], "run_id long, started_at long, status string")
    log = spark.createDataFrame([(i, 150 + i % 100) for i in range(1000)] + [(2000, 50), (2001, None), (2002, 10**9)], "id long, t long")
    plan = changes.run_of(log, runs, "t")
    got = {r.id: r.run_id for r in plan.collect()}
    assert got == {i: 1 if 150 + i % 100 < 200 else 2 for i in range(1000)} | {2002: 3}
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_queries_make_the_parts_of_the_code_index_they_read(spark, tmp_path):
    import os

    from loamdex.plans import structure
    from loamdex.plans.indexes import Index
    from loamdex.session import shared_dir

    text = "def g(b):\n    return b\n\ndef f(a):\n    if a:\n        a = g(a)\n    return a\n"
    rows = [(1, "r", "m.py", 0, text[:24], "source", 1), (2, "r", "m.py", 24, text[24:], "source", 1), (3, "r", "n.py", 0, "def (", "source", 1)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "id long, repo string, file_path string, start_byte long, content string, category string, indexed_at long").write.parquet(f"{d}/chunks.parquet")
    home = shared_dir(spark)
    names = lambda: set(C.Catalog(spark, f"{home}/catalog").names())
    scratches = lambda: {x for x in os.listdir(home.removeprefix("file://")) if x.startswith("scratch-")}
    old, left = names(), scratches()
    made = lambda: {x.split("-")[0] for x in names() - old}
    assert {tuple(r) for r in structure.code_files(spark, d).collect()} == {("r/m.py", 8), ("r/n.py", 1)}
    assert structure.flow_edges(spark, d).count() and structure.reaching_defs(spark, d).count() and structure.paths_through(spark, d).count() == 3
    assert made() == {"parsed"}  # no graph
    edges = {tuple(r) for r in structure.code_edges(spark, d).collect()}
    assert made() == {"parsed", "links"} and "calls" in {k for _, _, k, _ in edges}
    i = Index(spark, d, "code")
    at = {r["name"]: (r.id, r.chunk_id, r.parent_id) for r in i.read("nodes").collect()}
    assert {tuple(r) for r in i.read("out").collect()} == edges and (at["r/m.py::f"][0], at["r/m.py::g"][0], "calls", 3.0) in edges
    assert at["r/m.py::f"][1:] == (2, at["r/m.py"][0]) and i.read("flow", ["r/m.py::f"]).count() == structure._flow(spark, d).filter("function = 'r/m.py::f'").count() > 0
    assert [r.file_path for r in i.read("warnings").filter("stage = 'symbols'").collect()] == ["r/n.py"]
    assert scratches() <= left  # what the builds kept meanwhile is gone
