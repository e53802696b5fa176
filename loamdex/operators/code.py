"""Symbols and control and data flow of source files, extracted per file in parallel.

Every language goes through one :class:`~loamdex.operators.outline.Outline`. Flow is made in two passes: a
control-flow graph over the statements of a function, and definitions that run along its edges."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.operators import outline as O
from loamdex.session import spread

# Weights of edge kinds.
WEIGHTS = {"calls": 3.0, "imports": 1.5, "inherits": 3.0, "references": 2.0, "contains": 1.0, "controls": 0.5, "dataflow": 0.7, "guards": 0.3}
FLOW = ["controls", "dataflow", "guards"]
NODE = ["kind", "name", "short_name", "file_path", "start_line", "end_line", "start_byte", "end_byte", "signature", "parent_name"]
EDGE = ["src_name", "dst_name", "kind", "weight", "metadata"]


def _qualified(path: str, d: O.Def, around: tuple[O.Def, ...]) -> str:
    return "::".join([path, *(a.name for a in around), d.name])


def symbols(path: str, text: str) -> tuple[list[tuple], list[tuple], str | None]:
    """Nodes and name edges of a file, and a warning: a file node, definitions with qualified names, containment,
    base classes, calls, imports and references. What a file names goes to its own definition if it has exactly
    one of that short name. A file without outline has its file node only."""
    size = O.Offsets(text)
    nodes: list[tuple] = [("file", path, path, path, 1, text.count("\n") + 1, 0, size(len(text)), None, None)]
    got = O.outline(path, text)
    if got is None:
        return nodes, [], "does not parse" if O.language_of(path) else None
    lines = text.split("\n")
    edges: dict[tuple[str, str, str], None] = {}
    ranges: list[tuple[int, int, str]] = []
    local: dict[str, list[str]] = {}
    for d, around in O.walk(got.defs):
        owner = next((a for a in reversed(around) if a.kind != "variable"), None)
        parent = _qualified(path, owner, around[: around.index(owner)]) if owner else path
        name = _qualified(path, d, around)
        nodes.append((d.kind, name, d.name, path, d.line, d.end_line, size(d.start), size(d.end), lines[d.line - 1].strip(), parent))
        edges[parent, name, "contains"] = None
        local.setdefault(d.name, []).append(name)
        if d.kind != "variable":
            ranges.append((d.start, d.end, name))
            for b in d.bases:
                edges[name, b, "inherits"] = None
    # The innermost definition around a use is the last one opened before it that isn't closed yet.
    ranges.sort(key=lambda r: (r[0], -r[1]))
    stack: list[tuple[int, str]] = []
    k = 0
    for at, kind, name in sorted(got.uses):
        while k < len(ranges) and ranges[k][0] <= at:
            stack.append((ranges[k][1], ranges[k][2]))
            k += 1
        while stack and stack[-1][0] <= at:
            stack.pop()
        own = next((n for end, n in reversed(stack) if end > at), path)
        edges[own, name, kind] = None
    out: dict[tuple[str, str, str], None] = {}
    for a, b, kind in edges:
        same = local.get(b, ()) if kind != "contains" else ()
        b = same[0] if len(set(same)) == 1 else b
        if b and a != b:
            out[a, b, kind] = None
    return nodes, [(*k, WEIGHTS[k[2]], None) for k in out], None


@dataclass
class _Point:
    """A place in a control-flow graph: entry, exit, a statement, or where a loop is left (which has no block)."""

    block: str | None
    stmt: O.Stmt | None = None
    after: list[int] = field(default_factory=list)  # points that come before it
    back: list[int] = field(default_factory=list)  # points from which a loop begins anew


class Graph:
    """Control-flow graph of one function, one block a statement. What follows a return, break or continue isn't in it."""

    def __init__(self, name: str, body: list[O.Stmt]):
        self.name, self.n = name, 0
        self.points = [_Point(f"{name}#entry"), _Point(f"{name}#exit")]
        done: list[int] = []
        self.points[1].after = [*self._run(body, [0], None, done), *done]

    def _run(self, body: list[O.Stmt], ends: list[int], loop: tuple[list[int], list[int]] | None, done: list[int]) -> list[int]:
        """Lay ``body`` behind ``ends``; ``loop`` takes the points of break and continue, ``done`` those of return."""
        for s in body:
            if not ends:
                return ends
            self.n += 1
            at = len(self.points)
            self.points.append(_Point(f"{self.name}#block_{self.n}", s, ends))
            ends = [at]
            if s.kind == "return":
                done.append(at)
                ends = []
            elif s.kind in ("break", "continue"):
                if loop is not None:
                    loop[s.kind == "continue"].append(at)
                ends = []
            elif s.kind == "if":
                ends = [*self._run(s.body, [at], loop, done), *self._run(s.orelse, [at], loop, done)]
            elif s.kind == "loop":
                breaks: list[int] = []
                again: list[int] = []
                inner = self._run(s.body, [at], (breaks, again), done)
                self.points[at].back = [*inner, *again]
                left = len(self.points)
                self.points.append(_Point(None, None, [at, *inner, *again]))
                ends = [*self._run(s.orelse, [left], loop, done), *breaks]
        return ends

    def controls(self) -> Iterator[tuple[str, str]]:
        for p in self.points:
            if p.block is not None:
                for q in (*p.after, *p.back):
                    # Where a loop is left stands for the loop's own block.
                    while self.points[q].block is None:
                        q = self.points[q].after[0]
                    yield self.points[q].block, p.block

    def definitions(self, params: dict[str, int]) -> Iterator[tuple[str, str, str, int, int]]:
        """(defining block, using block, name, line, line). Points stand in the order in which control reaches them but
        for the ways back, which are not gone: a loop's own definitions don't reach uses before them in its body."""
        leaving: list[dict[str, frozenset[tuple[str, int]]]] = []
        for i, p in enumerate(self.points):
            state: dict[str, frozenset[tuple[str, int]]] = {}
            for q in p.after if i != 1 else ():
                for v, at in leaving[q].items():
                    state[v] = state[v] | at if v in state else at
            if i == 0:
                state = {v: frozenset({(p.block, line)}) for v, line in params.items()}
            elif p.stmt is not None:
                for v, line in p.stmt.loads.items():
                    for block, at in state.get(v, ()):
                        yield block, p.block, v, at, line
                for v, line in p.stmt.stores.items():
                    state[v] = frozenset({(p.block, line)})
            leaving.append(state)


def _tests(s: O.Stmt) -> Iterator[tuple[O.Stmt, str]]:
    branch = "if"
    while True:
        yield s, branch
        if len(s.orelse) != 1 or s.orelse[0].kind != "if":
            return
        s, branch = s.orelse[0], "elif"


def guard(s: O.Stmt, language: str) -> dict:
    """What is tested where control branches: the condition, and in Python those of the whole if-elif chain."""
    if s.kind == "loop":
        return {"predicate": s.test, "branch": "loop", "line": s.line}
    if language != "python":
        return {"predicate": s.test, "branch": "if", "line": s.line}
    chain = [{"predicate": x.test, "branch": b, "line": x.line} for x, b in _tests(s)]
    return {"predicate": s.test, "branch": "if", "predicates": chain}


def flow(path: str, text: str) -> tuple[list[tuple], list[tuple], str | None]:
    """Blocks and control, data-flow and guard edges of all functions of a file, and a warning."""
    got = O.outline(path, text)
    if got is None:
        return [], [], "does not parse" if O.language_of(path) else None
    nodes, edges, size = [], {}, O.Offsets(text)
    functions = 0
    for d, around in O.walk(got.defs):
        if d.body is None:
            continue
        functions += 1
        name = _qualified(path, d, around)
        g = Graph(name, d.body)
        a, b = size(d.start), size(d.end)
        nodes.append(("block", f"{name}#entry", "entry", path, d.line, d.line, a, b, f"entry {d.name}", name))
        nodes.append(("block", f"{name}#exit", "exit", path, d.end_line, d.end_line, a, b, f"exit {d.name}", name))
        for p in g.points:
            if p.stmt is not None:
                nodes.append(("block", p.block, p.block.rsplit("#", 1)[1], path, p.stmt.line, p.stmt.end_line, a, b, p.stmt.text, name))
                if p.stmt.kind in ("if", "loop"):
                    edges[p.block, p.block, "guards", json.dumps(guard(p.stmt, got.language), sort_keys=True)] = None
        for x, y in g.controls():
            edges[x, y, "controls", None] = None
        for x, y, v, at, line in g.definitions(d.params):
            edges[x, y, "dataflow", json.dumps({"variable": v, "var": v, "definition_line": at, "use_line": line}, sort_keys=True)] = None
    return nodes, [(a, b, k, WEIGHTS[k], m) for a, b, k, m in edges], "functions without blocks" if functions and not nodes else None


#: Rows that a task holds before it hands them on. A file gives hundreds, and a batch may hold 10,000 files.
ROWS = 4_096
_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
_ROW = (
    "what string, kind string, name string, short_name string, file_path string, start_line int, end_line int, start_byte long, end_byte long, signature string, parent_name string, "
    "e_src_name string, e_dst_name string, e_kind string, e_weight double, e_metadata string"
)


def parsed(batches: Iterator[pa.RecordBatch], runs: list[Callable]) -> Iterator[pa.RecordBatch]:
    """What ``runs`` find in batches of (path, text), in pieces of :data:`ROWS` rows, however many files a batch has."""
    schema = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in _ROW.split(", "))])

    def piece(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows: list[tuple] = []
    for b in batches:
        for p, t in zip(b.column(0), b.column(1)):
            p, t = p.as_py(), t.as_py().replace("\r\n", "\n").replace("\r", "\n")
            for fn in runs:
                try:
                    ns, es, warn = fn(p, t)
                except Exception as e:  # noqa: BLE001 one file must not end the run
                    ns, es, warn = [], [], f"{type(e).__name__}: {e}"
                rows += [("node", *n, *[None] * 5) for n in ns] + [("edge", e[2], *[None] * 9, e[0], e[1], e[2], e[3], e[4]) for e in es]
                if warn:
                    rows.append(("warning", fn.__name__, None, None, p, None, None, None, None, warn, None, *[None] * 5))
            while len(rows) >= ROWS:
                yield piece(rows[:ROWS])
                del rows[:ROWS]
    if rows:
        yield piece(rows)


def tagged(files: DataFrame, what: str = "symbols", path: str = "path", text: str = "text") -> DataFrame:
    """Rows of three kinds (node, edge, warning) of files (path, text), for ``symbols`` or ``flow``, or both as ``all``:
    one parse a file. Files of other languages give a file node and no flow; a file that fails gives a warning.

    Rows leave a task in pieces of :data:`ROWS`: beside a batch of texts it holds one file's rows at most, however many
    files it has."""
    runs = {"symbols": [symbols], "flow": [flow], "all": [symbols, flow]}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parsed(batches, runs)

    return spread(files.select(F.col(path).alias("p"), F.col(text).alias("t")).dropna()).mapInArrow(run, _ROW)


def nodes_of(rows: DataFrame) -> DataFrame:
    return rows.filter("what = 'node'").select(*NODE)


def edges_of(rows: DataFrame) -> DataFrame:
    return rows.filter("what = 'edge'").select(*[F.col(f"e_{c}").alias(c) for c in EDGE])


def warnings_of(rows: DataFrame) -> DataFrame:
    """(file_path, stage, message)."""
    return rows.filter("what = 'warning'").select("file_path", F.col("kind").alias("stage"), F.col("signature").alias("message"))


def extract(files: DataFrame, what: str = "symbols", path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges by name) of :func:`tagged`, which is computed for each of them unless it is written first."""
    rows = tagged(files, what, path, text)
    return nodes_of(rows), edges_of(rows)


def aggregate_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src_name, dst_name, kind), with the metadata of all of them as a sorted array."""
    return edges.groupBy("src_name", "dst_name", "kind").agg(F.max("weight").alias("weight"), F.array_sort(F.collect_set("metadata")).alias("items"))


def persist_blocks(blocks: DataFrame, symbols_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks whose function is an indexed symbol, warnings (name, message) for the others)."""
    known = symbols_.filter(F.col("kind").isin("function", "method")).select(F.col("name").alias("parent_name")).distinct()
    lost = blocks.select("parent_name").distinct().join(known, "parent_name", "left_anti")
    return blocks.join(known, "parent_name", "left_semi"), lost.select(F.col("parent_name").alias("name"), F.lit("function is not indexed").alias("message"))
