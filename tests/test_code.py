"""Outlines, chunks, symbols and flow of the languages that have them."""

import pytest

from loamdex.operators import chunking, code
from loamdex.operators import outline as O

# One program in every language: a class with a base, a method, a function with a branch in a loop, a call.
SOURCES = {
    "a.py": "import disk\nclass Store(Base):\n    def put(self, k):\n        return save(k)\n\ndef pick(xs, top):\n    best = 0\n    for x in xs:\n        if x > top:\n            break\n        best = x\n    return best\n",
    "a.js": "import { save } from './disk';\nclass Store extends Base {\n  put(k) { return save(k); }\n}\nfunction pick(xs, top) {\n  let best = 0;\n  for (const x of xs) {\n    if (x > top) { break; }\n    best = x;\n  }\n  return best;\n}\n",
    "a.ts": "import { save } from './disk';\nclass Store extends Base {\n  put(k: string): void { return save(k); }\n}\nfunction pick(xs: number[], top: number): number {\n  let best = 0;\n  for (const x of xs) {\n    if (x > top) { break; }\n    best = x;\n  }\n  return best;\n}\n",
    "a.go": "package a\n\nimport \"os/disk\"\n\ntype Store struct {\n\tn int\n}\n\nfunc (s *Store) put(k string) error {\n\treturn save(k)\n}\n\nfunc pick(xs []int, top int) int {\n\tbest := 0\n\tfor _, x := range xs {\n\t\tif x > top {\n\t\t\tbreak\n\t\t}\n\t\tbest = x\n\t}\n\treturn best\n}\n",
    "A.java": "import a.disk;\nclass Store extends Base {\n  int put(String k) { return save(k); }\n  static int pick(int[] xs, int top) {\n    int best = 0;\n    for (int x : xs) {\n      if (x > top) { break; }\n      best = x;\n    }\n    return best;\n  }\n}\n",
    "a.c": "#include \"disk.h\"\nstruct Store { int n; };\nint put(char *k) { return save(k); }\nint pick(int *xs, int top) {\n  int best = 0;\n  for (int i = 0; i < 9; i++) {\n    if (xs[i] > top) { break; }\n    best = xs[i];\n  }\n  return best;\n}\n",
    "a.cpp": "#include <disk>\nclass Store : public Base {\n  int put(char *k) { return save(k); }\n};\nint pick(int *xs, int top) {\n  int best = 0;\n  for (int i = 0; i < 9; i++) {\n    if (xs[i] > top) { break; }\n    best = xs[i];\n  }\n  return best;\n}\n",
    "a.cs": "using a.disk;\nclass Store : Base {\n  int put(string k) { return save(k); }\n  static int pick(int[] xs, int top) {\n    int best = 0;\n    visit(xs);\n    while (best < 9) {\n      if (best > top) { break; }\n      best = xs[best];\n    }\n    return best;\n  }\n}\n",
    "a.rs": "use crate::disk;\nstruct Store { n: i32 }\nfn put(k: &str) -> i32 { return save(k); }\nfn pick(xs: &[i32], top: i32) -> i32 {\n    let mut best = 0;\n    for x in xs {\n        if *x > top { break; }\n        best = *x;\n    }\n    return best;\n}\n",
    "a.rb": "require 'disk'\nclass Store < Base\n  def put(k)\n    return save(k)\n  end\nend\n\ndef pick(xs, top)\n  best = 0\n  while best < 9\n    if best > top\n      break\n    end\n    best = xs[best]\n  end\n  return best\nend\n",
}
SOURCES["a.tsx"] = SOURCES["a.ts"]


@pytest.mark.parametrize("path", SOURCES)
def test_symbols_of_every_language(path):
    nodes, edges, warn = code.symbols(path, SOURCES[path])
    kinds = {n[2]: n[0] for n in nodes}
    assert warn is None and kinds["Store"] == "class"
    inside = path in ("A.java", "a.cs")
    assert kinds["pick"] == ("method" if inside else "function")
    assert kinds["put"] == ("function" if path in ("a.c", "a.rs") else "method")
    names = {(a.rsplit("::", 1)[-1], b.rsplit("::", 1)[-1], k) for a, b, k, _, _ in edges}
    assert ("put", "save", "calls") in names and (path, "Store", "contains") in names
    assert (path, "h" if path == "a.c" else "disk", "imports") in names
    if path not in ("a.go", "a.c", "a.rs"):
        assert ("Store", "Base", "inherits") in names
    byte = {n[2]: (n[6], n[7]) for n in nodes}
    assert "pick" in SOURCES[path].encode()[slice(*byte["pick"])].decode()


@pytest.mark.parametrize("path", SOURCES)
def test_flow_of_every_language(path):
    nodes, edges, warn = code.flow(path, SOURCES[path])
    assert warn is None
    own = [n for n in nodes if n[9].endswith("::pick") and n[2].startswith("block")]
    text = {n[1].rsplit("#", 1)[1]: n[8] for n in own}
    by = lambda k: {(a.rsplit("#", 1)[1], b.rsplit("#", 1)[1]) for a, b, kind, _, _ in edges if kind == k and "::pick#" in a}
    loop = next(k for k, t in text.items() if t.startswith(("for", "while")))
    branch = next(k for k, t in text.items() if t.startswith("if"))
    stop = next(k for k, t in text.items() if t.startswith("break"))
    last = next(k for k, t in text.items() if t.startswith("return"))
    assert by("guards") == {(loop, loop), (branch, branch)}
    controls = by("controls")
    assert {(loop, branch), (branch, stop), (stop, last), (loop, last), (last, "exit")} <= controls
    store = next(k for k, t in text.items() if t.startswith("best") and "foreach" not in t and k > branch)
    assert (store, loop) in controls and (store, branch) not in controls
    # Both the first value and the one from the loop reach the end.
    assert {a for a, b in by("dataflow") if b == last} >= {store} and len({a for a, b in by("dataflow") if b == last}) == 2
    assert ("entry", branch) in by("dataflow")


@pytest.mark.parametrize("path", SOURCES)
def test_chunks_of_every_language(path):
    for text in (SOURCES[path], SOURCES[path] + "\n" + SOURCES[path].replace("pick", "ünï") * 9):
        raw = text.encode()
        for budget in (60, 400, 1500):
            got = chunking.syntax_chunks(path, text, budget)
            assert b"".join(raw[s:e] for *_, s, e in got) == raw and all(s < e for *_, s, e in got)
            assert all(len(raw[s:e]) <= budget or p != "module/section" for _, _, p, s, e in got)
    named = {(k, n) for k, n, *_ in chunking.syntax_chunks(path, SOURCES[path], 200)}
    assert ("class", "Store") in named or ("method", "put") in named


def test_merge_rule():
    d = O.Def("class", "K", 0, 9, 1, 1)
    S = chunking.Slot
    plain, gap, fn, other = S(0, 5, None, None, (), True), S(5, 9, None, None, (), False), S(9, 20, "function", "f", (), True), S(20, 25, None, None, (), True)
    ok = lambda a, b, n=100, lang="python": chunking.mergeable(a, b, n, lang)
    assert ok(plain, gap) and ok(gap, fn) and not ok(fn, other) and not ok(fn, S(20, 30, "function", "g", (), True))
    assert not ok(plain, other, 20) and ok(S(0, 50, None, None, (), True), S(50, 60, None, None, (), True), 20)
    inside = S(20, 25, None, None, (d,), True)
    assert ok(plain, inside) and not ok(plain, inside, lang="javascript")


def test_scripts_split_pieces_of_several_functions():
    text = "module.exports = {\n  a: function one() { return 1; },\n  b: function two() { return 2; },\n};\n"
    assert {n for _, n, *_ in chunking.syntax_chunks("m.js", text)} >= {"one", "two"}
    text = "export const camelCase = (x) => {\n  return x;\n};\nexport function snakeCase(y) { return y; }\n"
    assert {(k, n, p) for k, n, p, *_ in chunking.syntax_chunks("m.js", text)} == {("function", "camelCase", "module/function[camelCase]"), ("function", "snakeCase", "module/function[snakeCase]")}


def test_flow_rules():
    src = "def f(a):\n    while a:\n        b = c\n        c = a\n        if a: continue\n        d = 1\n    else:\n        e = c\n    x += d\n    return [a for a in b]\n    never = 1\n"
    _, edges, _ = code.flow("m.py", src)
    use = {(a.rsplit("#")[1], b.rsplit("#")[1]) for a, b, k, _, m in edges if k == "dataflow"}
    # c of the loop doesn't reach its use before it in the body, but what follows the loop.
    assert ("block_3", "block_2") not in use and ("block_3", "block_7") in use
    assert ("block_6", "block_8") in use and not any(b == "block_9" for _, b in use)  # comprehensions are scopes of their own
    assert not any("block_10" in b for _, b, *_ in edges)
    _, edges, _ = code.flow("m.py", "def f(a):\n    if a:\n        return 1\n    elif b:\n        pass\n")
    g = [m for *_, k, _, m in edges if k == "guards"]
    assert any('"branch": "elif"' in m for m in g)


def test_files_without_outline(spark):
    rows = [("a.py", "def ("), ("b.js", "f( {"), ("c.txt", "x"), ("d.go", ""), (None, "x"), ("e.rb", "def x\n"), ("f.py", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    t = code.tagged(files, "all")
    assert {r.name for r in code.nodes_of(t).collect()} == {"a.py", "b.js", "c.txt", "d.go", "e.rb"}
    assert {(r.file_path, r.message) for r in code.warnings_of(t).collect()} == {(p, "does not parse") for p in ("a.py", "b.js", "e.rb")}
    assert code.edges_of(t).count() == 0 and code.tagged(files.limit(0), "all").count() == 0
    c = chunking.chunk_files(files).collect()
    assert {r.path: r.warning for r in c} == {"a.py": "does not parse", "b.js": "does not parse", "c.txt": None, None: None, "e.rb": "does not parse"}
    blocks = spark.createDataFrame([("b", "a::f"), ("c", "gone")], "name string, parent_name string")
    kept, lost = code.persist_blocks(blocks, spark.createDataFrame([("function", "a::f")], "kind string, name string"))
    assert kept.count() == 1 and [r.name for r in lost.collect()] == ["gone"]


def test_what_a_file_names_is_its_own_if_there_is_one():
    _, edges, _ = code.symbols("m.py", "def a():\n    pass\ndef b():\n    a()\n    c()\n")
    assert {(x, y) for x, y, k, *_ in edges if k == "calls"} == {("m.py::b", "m.py::a"), ("m.py::b", "c")}


def test_rows_leave_a_task_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(code, "ROWS", 7)
    # One batch of 50 files: no piece holds all their rows, and none is lost.
    batch = pa.RecordBatch.from_pydict({"p": [f"{i}/{p}" for i in range(5) for p in SOURCES], "t": [*SOURCES.values()] * 5})
    got = list(code.parsed(iter([batch]), [code.symbols, code.flow]))
    want = 5 * sum(len(x) for f in (code.symbols, code.flow) for p, t in SOURCES.items() for x in f(p, t)[:2])
    assert {b.num_rows for b in got[:-1]} == {7} and sum(b.num_rows for b in got) == want
