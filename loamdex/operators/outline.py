"""What a source file is made of, in one form for eleven languages: definitions, references and statements.

Python files come from the standard library's parser. For languages with braces a file becomes tokens with matched
brackets; what a brace opens follows from the tokens before it. Ruby is read line by line. All of it is tolerant:
a file whose brackets don't match has no outline (None), and whatever uses outlines then falls back to plain text.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Languages with an outline, by extension.
EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp", "rs": "rust", "rb": "ruby",
}
SCRIPT = ("javascript", "typescript", "tsx")


@dataclass
class Stmt:
    """A statement; ``kind`` is simple, return, break, continue, if or loop. ``body`` and ``orelse`` hold statements."""

    kind: str
    line: int
    end_line: int
    text: str
    stores: dict[str, int] = field(default_factory=dict)
    loads: dict[str, int] = field(default_factory=dict)
    test: str | None = None
    body: list[Stmt] = field(default_factory=list)
    orelse: list[Stmt] = field(default_factory=list)


@dataclass
class Def:
    """A definition over the characters ``start`` to ``end``; ``members`` are the definitions directly in it and
    ``pieces`` the (start, end) of what its body consists of."""

    kind: str
    name: str
    start: int
    end: int
    line: int
    end_line: int
    bases: list[str] = field(default_factory=list)
    params: dict[str, int] = field(default_factory=dict)
    body: list[Stmt] | None = None
    members: list[Def] = field(default_factory=list)
    pieces: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class Outline:
    language: str
    defs: list[Def]
    #: (character, kind of edge, name): calls, imports and references of names.
    uses: list[tuple[int, str, str]]
    pieces: list[tuple[int, int]]


def language_of(path: str) -> str | None:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def module_name(text: str) -> str:
    """Last part of an imported path or module: quotes off, then what follows the last separator, without brackets."""
    return re.split(r"[\[(]", re.split(r"\.|::|/|\\", text.strip().strip("'\"`<>"))[-1])[0]


def outline(path: str, text: str) -> Outline | None:
    """The outline of a file by the extension of its path; None for other languages and files without one."""
    lang = language_of(path)
    if lang is None:
        return None
    try:
        return _python(text) if lang == "python" else _ruby(text) if lang == "ruby" else _Braces(lang, text).outline()
    except (SyntaxError, ValueError, RecursionError, MemoryError, IndexError):
        return None


class Offsets:
    """UTF-8 offsets of characters of a text."""

    def __init__(self, text: str):
        self.sums = None
        if not text.isascii():
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            self.sums = np.concatenate([[0], np.cumsum(1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000))])

    def __call__(self, at: int) -> int:
        return at if self.sums is None else int(self.sums[at])


def walk(defs: list[Def]) -> Iterator[tuple[Def, tuple[Def, ...]]]:
    """Every definition with those around it, outermost first."""
    todo: list[tuple[Def, tuple[Def, ...]]] = [(d, ()) for d in reversed(defs)]
    while todo:
        d, around = todo.pop()
        yield d, around
        todo.extend((m, (*around, d)) for m in reversed(d.members))


# ---------------------------------------------------------------------------------------------------- Python


class _Names(ast.NodeVisitor):
    """Names read and written outside nested scopes, each with the line where it comes first."""

    def __init__(self) -> None:
        self.loads: dict[str, int] = {}
        self.stores: dict[str, int] = {}

    def visit_Name(self, n: ast.Name) -> None:
        (self.loads if isinstance(n.ctx, ast.Load) else self.stores if isinstance(n.ctx, ast.Store) else {}).setdefault(n.id, n.lineno)

    def _closed(self, n: ast.AST) -> None:
        """Another scope: what it names is not this statement's."""

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = visit_Lambda = _closed
    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _closed


def _names(*nodes: ast.AST | None) -> _Names:
    v = _Names()
    for n in nodes:
        if n is not None:
            v.visit(n)
    return v


class _Source:
    """Characters of (line, UTF-8 column) places."""

    def __init__(self, text: str):
        self.text, self.lines = text, text.split("\n")
        self.starts = [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x) + 1)

    def at(self, line: int, col: int) -> int:
        row = self.lines[line - 1]
        return self.starts[line - 1] + (col if row.isascii() else len(row.encode()[:col].decode("utf-8", "ignore")))

    def span(self, n: ast.AST) -> tuple[int, int]:
        return self.at(n.lineno, n.col_offset), self.at(n.end_lineno, n.end_col_offset)


def _last(f: ast.expr) -> str | None:
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def _python(text: str) -> Outline:
    tree, src = ast.parse(text), _Source(text)
    uses: list[tuple[int, str, str]] = []

    def statements(body: list[ast.stmt]) -> list[Stmt]:
        return [statement(s) for s in body]

    def statement(s: ast.stmt) -> Stmt:
        a, b = src.span(s)
        out = Stmt("simple", s.lineno, s.end_lineno, text[a:b])
        if isinstance(s, (ast.If, ast.While)):
            out.kind, out.test, out.loads = "if" if isinstance(s, ast.If) else "loop", ast.unparse(s.test), _names(s.test).loads
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            out.kind, out.test, out.loads, out.stores = "loop", ast.unparse(s.iter), _names(s.iter).loads, _names(s.target).stores
        elif isinstance(s, (ast.Return, ast.Break, ast.Continue)):
            out.kind, out.loads = type(s).__name__.lower(), _names(s).loads
        else:
            n = _names(s)
            out.stores, out.loads = n.stores, {**n.stores, **n.loads} if isinstance(s, ast.AugAssign) else n.loads
        if out.kind in ("if", "loop"):
            out.body, out.orelse = statements(s.body), statements(s.orelse)
        return out

    def pieces(body: list[ast.stmt]) -> list[tuple[int, int]]:
        return [(src.at(min([s.lineno, *(d.lineno for d in getattr(s, "decorator_list", ()))]), 0), src.span(s)[1]) for s in body]

    def visit(node: ast.AST, into: list[Def], in_class: bool) -> None:
        for c in ast.iter_child_nodes(node):
            inner, cls = into, in_class
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(c, ast.ClassDef)
                top = min([c.lineno, *(d.lineno for d in c.decorator_list)])
                d = Def("class" if is_class else "method" if in_class else "function", c.name, src.at(top, 0), src.span(c)[1], c.lineno, c.end_lineno, pieces=pieces(c.body))
                if is_class:
                    d.bases = [x for x in map(_last, c.bases) if x]
                else:
                    a = c.args
                    d.params = {p.arg: p.lineno for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if p}
                    d.body = statements(c.body)
                into.append(d)
                inner, cls = d.members, is_class
            elif isinstance(c, ast.Assign):
                for t in c.targets:
                    if isinstance(t, ast.Name):
                        a, b = src.span(c)
                        into.append(Def("variable", t.id, a, b, c.lineno, c.end_lineno))
                if isinstance(c.value, ast.Name):
                    uses.append((src.span(c.value)[0], "references", c.value.id))
            elif isinstance(c, ast.Call):
                if name := _last(c.func):
                    uses.append((src.span(c)[0], "calls", name))
                uses.extend((src.span(x)[0], "references", x.id) for x in c.args if isinstance(x, ast.Name))
            elif isinstance(c, (ast.Import, ast.ImportFrom)):
                uses.extend((src.span(c)[0], "imports", module_name(x.name)) for x in c.names if x.name != "*")
            visit(c, inner, cls)

    defs: list[Def] = []
    visit(tree, defs, False)
    return Outline("python", defs, uses, pieces(tree.body))


# ---------------------------------------------------------------------------------------------------- braces

_STRING = r'"(?:[^"\\\n]|\\.)*"'
_TOKEN = re.compile(
    rf"(?P<skip>\s+|//[^\n]*|/\*.*?\*/|^[ \t]*\#[^\n]*(?:(?<=\\)\n[^\n]*)*)"
    rf"|(?P<str>\"\"\".*?\"\"\"|[A-Za-z]{{0,2}}{_STRING}|@\"(?:[^\"]|\"\")*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"
    r"|(?P<re>(?:(?<=[=(,:\[!&|?{};])|(?<=[=(,:\[!&|?{};] )|(?<=return ))/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"
    r"|(?P<life>'[A-Za-z_]\w*(?!'))|(?P<id>[#@]?[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)"
    r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|&\^=|=>|->|::|:=|<-|\+\+|--|&&|\|\||\?\?|\?\.|[-+*/%&|^]=|[=!<>]=|.)",
    re.S | re.M,
)
_AUGMENTED = frozenset("+= -= *= /= %= &= |= ^= <<= >>= **= &^= ++ --".split())
_CONTROL = frozenset("if else for foreach while do switch case default try catch finally return throw break continue loop match select unsafe using lock synchronized with defer go new await yield".split())
_RESERVED = _CONTROL | frozenset(
    "let const var function fn func class struct enum interface trait impl type typeof instanceof in of void int long short char float double bool boolean byte string str static public private protected final"
    " abstract async extends implements import export from package namespace use mod pub mut ref self this super null nil None true false undefined delete where as is range unsigned signed extern inline"
    " chan map goto throws override virtual readonly sealed partial internal default record move dyn crate union typedef sizeof volatile register auto template typename operator friend get set".split()
)
_CLASS = {
    "javascript": ("class",), "typescript": ("class", "interface"), "tsx": ("class", "interface"), "java": ("class", "interface", "enum", "record"), "c": ("struct",), "cpp": ("class", "struct"),
    "csharp": ("class", "interface", "enum", "record", "struct"), "rust": ("struct", "enum", "trait"), "go": (),
}


class _Braces:
    def __init__(self, lang: str, text: str):
        self.lang, self.text = lang, text
        self.kind: list[str] = []
        self.tok: list[str] = []
        self.at: list[int] = []
        self.end: list[int] = []
        self.fresh: list[bool] = []  # a line end stands before the token
        self.imports: list[tuple[int, str]] = []
        fresh = True
        for m in _TOKEN.finditer(text):
            k, t = m.lastgroup, m[0]
            if k == "skip" or k == "op" and t == "#":
                fresh = fresh or "\n" in t
                if t.lstrip().startswith("#") and lang in ("c", "cpp") and (inc := re.match(r"\s*#\s*include\s*[<\"]([^>\"]+)", t)):
                    self.imports.append((m.start(), inc[1]))
                continue
            if k == "op" and t in "\"'`" and len(t) == 1:
                raise ValueError("open string")
            for x, y in ((self.kind, k), (self.tok, t), (self.at, m.start()), (self.end, m.end()), (self.fresh, fresh)):
                x.append(y)
            fresh = False
        n = len(self.tok)
        self.match = [-1] * n
        stack: list[int] = []
        for i in range(n):
            t = self.tok[i]
            if self.kind[i] != "op":
                continue
            if t in "([{":
                stack.append(i)
            elif t in ")]}":
                if not stack or "([{".index(self.tok[stack[-1]]) != ")]}".index(t):
                    raise ValueError("brackets")
                j = stack.pop()
                self.match[i], self.match[j] = j, i
        if stack:
            raise ValueError("brackets")
        self.lines = [0] + [m.end() for m in re.finditer("\n", text)]
        self.owner_name: set[int] = set()  # tokens that name a definition

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    # -- definitions ------------------------------------------------------------------------------

    def outline(self) -> Outline:
        defs: list[Def] = []
        pieces = self.block(0, len(self.tok), defs, None)
        return Outline(self.lang, defs, self.uses(), pieces)

    def units(self, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """(first, last + 1) of the statements, declarations and members between two tokens."""
        i = lo
        while i < hi:
            j = self.unit_end(i, hi)
            yield i, j
            i = j

    def unit_end(self, i: int, hi: int) -> int:
        """Where the unit that starts at a token ends: behind its semicolon, its closing brace or its line."""
        start = i
        while i < hi:
            t, op = self.tok[i], self.kind[i] == "op"
            if op and t in "([":
                i = self.match[i] + 1
            elif op and t == "{":
                i = self.match[i] + 1
                nxt = self.tok[i] if i < hi else ""
                if nxt in ("else", "catch", "finally") or nxt == "while" and self.tok[start] == "do":
                    i += 1
                    continue
                if i < hi and self.kind[i] == "op" and nxt in (",", ")", ".", "(", "?.", "=", "[", "||", "&&", "??", "?", ":", "+"):
                    continue
                if self.lang in SCRIPT and nxt in ("from", "as", "satisfies"):
                    i += 1
                    continue
                if i < hi and nxt == ";":
                    return i + 1
                head = self.tok[start]
                if self.lang in ("c", "cpp") and head in ("struct", "class", "enum", "union", "typedef") or self.lang == "csharp" and nxt == "=":
                    continue  # a declarator may follow
                return i
            elif op and t == "}":
                return i + 1 if i == start else i
            elif op and t == ";":
                return i + 1
            elif op and t == ":" and i > start and self.tok[start] in ("case", "default", "public", "private", "protected") and self.lang != "go":
                return i + 1
            else:
                i += 1
            if i < hi and i > start and self.fresh[i] and self.lang in (*SCRIPT, "go") and self.ends(i - 1) and not self.goes_on(i):
                return i
        return hi

    def ends(self, i: int) -> bool:
        return self.kind[i] in ("num", "str", "re", "life") or self.tok[i] in (")", "]", "}", "++", "--") or self.kind[i] == "id" and (self.tok[i] not in _RESERVED or self.tok[i] in ("return", "break", "continue", "this", "null", "true", "false", "nil", "super", "string", "int", "bool"))

    def goes_on(self, i: int) -> bool:
        return self.kind[i] == "op" and self.tok[i] not in ("{", "}", "!", "++", "--", "[", "(", "*") or self.tok[i] in ("else", "catch", "finally", "in", "of", "instanceof", "as") or self.tok[i] == "{" and self.lang != "go"

    def block(self, lo: int, hi: int, into: list[Def], around: Def | None) -> list[tuple[int, int]]:
        pieces = []
        for a, b in self.units(lo, hi):
            pieces.append((self.at[a], self.end[b - 1]))
            self.unit(a, b, into, around)
        return pieces

    def unit(self, a: int, b: int, into: list[Def], around: Def | None) -> None:
        """Definitions in one unit. A brace is read by the tokens between the last boundary and it."""
        head = i = a
        while i < b:
            t, op = self.tok[i], self.kind[i] == "op"
            if op and t == "{":
                close = self.match[i]
                d = self.opened(head, i, a, b, around)
                if d is None:
                    self.block(i + 1, close, into, around)
                else:
                    into.append(d)
                    d.pieces = self.block(i + 1, close, d.members, d)
                    if d.kind != "class":
                        d.body = self.statements(i + 1, close)
                i = head = close + 1
                continue
            if op and t in "([":
                # Functions among arguments and in default values.
                if any(self.tok[x] == "{" and self.kind[x] == "op" for x in range(i + 1, self.match[i])):
                    self.unit(i + 1, self.match[i], into, around)
                i = self.match[i] + 1
                continue
            if op and t == "=>" and i + 1 < b and self.tok[i + 1] != "{":
                name = self.assigned(head, i)
                if name is not None:
                    stop = next((x for x in self.top(i + 1, b) if self.tok[x] in (",", ";")), b)
                    d = self.made("method" if around is not None and around.kind == "class" else "function", name, name, stop - 1)
                    d.params = self.params(head, i)
                    d.body = [self.simple("return", i + 1, stop)] if stop > i + 1 else []
                    into.append(d)
            elif op and t in (";", ","):
                head = i + 1
            i += 1
        if self.lang in ("go", "rust") and not any(self.tok[x] == "{" for x in self.top(a, b)):
            k = next((x for x in range(a, min(b, a + 4)) if self.tok[x] in ("type", *_CLASS[self.lang])), None)
            if k is not None and k + 1 < b and self.kind[k + 1] == "id" and (self.lang == "rust") == (self.tok[k] != "type"):
                into.append(self.made("class", a, k + 1, b - 1))
        self.variables(a, b, into, around)

    def top(self, a: int, b: int) -> Iterator[int]:
        """Tokens between two that aren't inside brackets of their own."""
        while a < b:
            yield a
            a = self.match[a] + 1 if self.match[a] > a else a + 1

    def made(self, kind: str, first: int, name: int, last: int) -> Def:
        self.owner_name.add(name)
        a, b = self.at[first], self.end[last]
        return Def(kind, self.tok[name].lstrip("#@"), a, b, self.line(a), self.line(b - 1))

    def assigned(self, head: int, i: int) -> int | None:
        """The name that a function's value is given: ``name = ...`` or, in a class, ``name = ...``."""
        for x in self.top(head, i):
            if self.tok[x] == "=" and x > head and self.kind[x - 1] == "id" and self.tok[x - 1] not in _RESERVED:
                return x - 1
            if self.tok[x] == "=" and x > head and self.lang in ("typescript", "tsx"):
                y = next((y for y in self.top(head, x) if self.tok[y] == ":" and y > head), None)
                if y is not None and self.kind[y - 1] == "id":
                    return y - 1
        return None

    def opened(self, head: int, brace: int, a: int, b: int, around: Def | None) -> Def | None:
        """The definition whose body the brace opens, if it opens one."""
        lang, close = self.lang, self.match[brace]
        here = list(self.top(head, brace))
        words = [x for x in here if self.kind[x] == "id"]
        first = here[0] if here else brace
        is_method = around is not None and around.kind == "class"
        if lang == "go":
            if words and self.tok[words[0]] == "type" and len(words) > 1:
                return self.class_(first, words[1], here, close)
            if words and self.tok[words[0]] == "func" and len(words) > 1 and words[0] == first:
                d = self.made("method" if self.tok[first + 1] == "(" else "function", first, words[1], close)
                d.params = self.params(words[1] + 1, brace)
                return d
            return None
        for k, x in enumerate(words):
            if self.tok[x] in _CLASS[lang] and k + 1 < len(words) and (x == 0 or self.tok[x - 1] != "."):
                name = words[k + 1]
                if self.tok[name] in ("class", "struct") and k + 2 < len(words):
                    name = words[k + 2]
                if self.tok[name] not in _RESERVED and not any(self.tok[y] in ("=", "(") for y in range(x, name)) and not (lang in ("c", "cpp") and name + 1 < brace and self.tok[name + 1] == "("):
                    if lang in ("c", "cpp") and any(self.tok[y] == "(" for y in here if y > name):
                        continue
                    return self.class_(first, name, here, close)
        if lang == "rust":
            for k, x in enumerate(words):
                if self.tok[x] == "fn" and k + 1 < len(words):
                    d = self.made("method" if is_method else "function", first, words[k + 1], close)
                    d.params = self.params(words[k + 1] + 1, brace)
                    return d
            return None
        if lang in SCRIPT:
            for x in words:
                if self.tok[x] == "function":
                    y = x + 2 if self.tok[x + 1] == "*" else x + 1
                    name = y if self.kind[y] == "id" else self.assigned(head, x)
                    if name is None:
                        return None
                    d = self.made("function", first if self.kind[y] == "id" else name, name, close)
                    d.params = self.params(y, brace)
                    return d
            if here and self.tok[here[-1]] == "=>":
                name = self.assigned(head, brace)
                if name is None:
                    return None
                d = self.made("method" if is_method else "function", name, name, close)
                d.params = self.params(name + 1, brace)
                return d
        # A name and its list of parameters, before what may follow it.
        par = [x for x in here if self.tok[x] == "("]
        if not par or any(self.tok[x] in ("=", "new", "return", "throw") for x in here if x < par[0]) or self.tok[first] in _CONTROL and lang != "cpp":
            return None
        name = par[0] - 1
        if lang in ("cpp", "java", "csharp") and name >= head and self.tok[name] == ">":
            while name > head and self.tok[name] != "<":
                name -= 1
            name -= 1
        if name < head or self.kind[name] not in ("id", "str", "num") or self.tok[name] in _CONTROL or self.kind[name] != "id" and lang not in SCRIPT:
            return None
        if lang in (*SCRIPT, "java", "csharp") and not is_method and not (lang == "csharp" and around is not None):
            return None
        if lang in ("c", "cpp") and around is not None and around.kind != "class" or lang in ("c", "cpp") and name == first and not is_method and lang == "c":
            return None
        d = self.made("method" if is_method else "function", first, name, close)
        d.name = d.name.strip("'\"")
        d.params = self.params(par[0], par[0] + 1)
        return d

    def class_(self, first: int, name: int, here: list[int], close: int) -> Def:
        d = self.made("class", first, name, close)
        open_, mark = False, {"cpp": (":",), "csharp": (":",)}.get(self.lang, ("extends", "implements"))
        skip = ("public", "private", "protected", "virtual")
        depth = 0
        for x in (y for y in here if y > name):
            t = self.tok[x]
            depth += (t == "<") - (t == ">")
            if depth == 0 and t in mark:
                open_ = True
            elif open_ and depth == 0 and self.kind[x] == "id" and t not in skip and self.tok[x + 1] not in (".", "::"):
                d.bases.append(t)
        if self.lang in ("c", "go", "rust"):
            d.bases = []
        return d

    def params(self, lo: int, hi: int) -> dict[str, int]:
        """Parameter names of the first round bracket, or of a single name before an arrow."""
        p = next((x for x in self.top(lo, hi) if self.tok[x] == "("), None)
        if p is None:
            return {self.tok[x]: self.line(self.at[x]) for x in range(lo, hi) if self.kind[x] == "id" and self.tok[x] not in _RESERVED and x + 1 < len(self.tok) and self.tok[x + 1] == "=>"}
        out, part = {}, []
        for x in [*self.top(p + 1, self.match[p]), self.match[p]]:
            if self.tok[x] not in (",", ")") or x != self.match[p] and self.tok[x] == ")":
                part.append(x)
                continue
            ids = [y for y in part if self.kind[y] == "id" and self.tok[y] not in _RESERVED]
            stop = next((y for y in part if self.tok[y] in (":", "=", "?")), None)
            if ids:
                if stop is not None or self.lang in (*SCRIPT, "go", "rust"):
                    name = next((y for y in ids if stop is None or y < stop), ids[0])
                else:
                    name = ids[-1]  # a type stands before the name
                out[self.tok[name]] = self.line(self.at[name])
            part = []
        return out

    def variables(self, a: int, b: int, into: list[Def], around: Def | None) -> None:
        """Declared variables of one unit that aren't functions."""
        own = list(self.top(a, b))
        functions = {d.name for d in into}
        found: list[int] = []
        first = self.tok[a]
        start = next((k for k, x in enumerate(own) if self.tok[x] not in ("export", "pub", "static", "public", "private", "protected", "final", "readonly")), len(own))
        own = own[start:]
        if not own or first in ("return", "import", "package", "case", "use", "throw", "typedef"):
            return
        kw = self.tok[own[0]]
        if self.lang in SCRIPT and kw in ("const", "let", "var"):
            want = True
            for x in own[1:]:
                if want and self.kind[x] == "id" and self.tok[x] not in _RESERVED:
                    found.append(x)
                want = self.tok[x] == ","
        elif self.lang == "rust" and kw == "let":
            found += [x for x in own[1:3] if self.kind[x] == "id" and self.tok[x] not in _RESERVED][:1]
        elif self.lang == "go":
            if kw == "var" and len(own) > 1 and self.kind[own[1]] == "id":
                found.append(own[1])
            cut = next((k for k, x in enumerate(own) if self.tok[x] == ":="), None)
            if cut is not None and kw not in _CONTROL:
                found += [x for x in own[:cut] if self.kind[x] == "id"]
        elif self.lang in ("java", "csharp", "c", "cpp") and kw not in _CONTROL and kw not in ("class", "struct", "enum", "interface", "package", "namespace"):
            cut = next((k for k, x in enumerate(own) if self.tok[x] in ("=", ";")), None)
            if cut is not None and cut >= 2 and self.kind[own[cut - 1]] == "id" and self.tok[own[cut - 1]] not in _RESERVED and (self.kind[own[cut - 2]] == "id" or self.tok[own[cut - 2]] in (">", "*", "]")) and not any(self.tok[x] == "(" for x in own[:cut]):
                if self.tok[own[cut]] == "=" or self.lang in ("java", "csharp"):
                    found.append(own[cut - 1])
        elif self.lang in ("typescript", "tsx") and around is not None and around.kind == "class" and self.kind[own[0]] == "id":
            nxt = self.tok[own[1]] if len(own) > 1 else ""
            if nxt in (":", "=", "?", "!", ";"):
                found.append(own[0])
        for x in found:
            if self.tok[x] not in functions:
                into.append(self.made("variable", x, x, min(b, len(self.tok)) - 1))

    # -- references -------------------------------------------------------------------------------

    def uses(self) -> list[tuple[int, str, str]]:
        out = [(at, "imports", module_name(x)) for at, x in self.imports]
        n, tok, kind = len(self.tok), self.tok, self.kind
        skip = -1
        for i in range(n):
            if i < skip or kind[i] != "id":
                continue
            t, nxt = tok[i], tok[i + 1] if i + 1 < n else ""
            if t in ("import", "use", "using") and (i == 0 or self.fresh[i] or tok[i - 1] in (";", "}")) and nxt != "(":
                j = self.unit_end(i, n) if nxt != "(" else i
                if self.lang == "java" or self.lang == "csharp":
                    j = next((x for x in range(i, n) if tok[x] == ";"), n)
                    out.append((self.at[i], "imports", module_name("".join(tok[i + 1 : j]))))
                elif self.lang in SCRIPT:
                    out.extend((self.at[x], "imports", tok[x]) for x in range(i + 1, j) if kind[x] == "id" and tok[x] not in ("from", "as", "type"))
                    out.extend((self.at[x], "imports", module_name(tok[x])) for x in range(i + 1, j) if kind[x] == "str")
                elif self.lang == "rust":
                    j = next((x for x in range(i, n) if tok[x] == ";"), n)
                    out.extend((self.at[x], "imports", tok[x]) for x in range(i + 1, j) if kind[x] == "id" and tok[x + 1] in (";", ",", "}"))
                elif self.lang == "go":
                    j = i + 2
                    out.append((self.at[i], "imports", module_name(nxt)))
                skip = j
            elif t == "import" and nxt == "(" and self.lang == "go":
                skip = self.match[i + 1]
                out.extend((self.at[x], "imports", module_name(tok[x])) for x in range(i + 2, skip) if kind[x] == "str")
            elif nxt == "(" and t not in _RESERVED and i not in self.owner_name and not (i and tok[i - 1] in ("new", "function", "fn", "func", "#")):
                out.append((self.at[i], "calls", t))
                out.extend((self.at[x], "references", tok[x]) for x in self.top(i + 2, self.match[i + 1]) if kind[x] == "id" and tok[x] not in _RESERVED and tok[x - 1] in ("(", ",") and tok[x + 1] in (",", ")"))
            elif i and tok[i - 1] in ("=", ":=") and t not in _RESERVED and nxt in (";", ",", ")", ".", "") or i and tok[i - 1] in ("=", ":=") and t not in _RESERVED and i + 1 < n and self.fresh[i + 1]:
                out.append((self.at[i], "references", t))
        return out

    # -- statements -------------------------------------------------------------------------------

    def statements(self, lo: int, hi: int) -> list[Stmt]:
        out: list[Stmt] = []
        i = lo
        while i < hi:
            got, i = self.statement(i, hi)
            out += got
        return out

    def body(self, i: int, hi: int) -> tuple[list[Stmt], int]:
        if i < hi and self.tok[i] == "{":
            return self.statements(i + 1, self.match[i]), self.match[i] + 1
        return self.statement(i, hi) if i < hi else ([], hi)

    def statement(self, i: int, hi: int) -> tuple[list[Stmt], int]:
        t = self.tok[i]
        if t == ";" or t == "}":
            return [], i + 1
        if t == "{":
            return self.statements(i + 1, self.match[i]), self.match[i] + 1
        if t == "if":
            return self.branch(i, hi)
        if t in ("for", "foreach", "while", "loop", "do") and self.kind[i] == "id":
            return self.loop(i, hi)
        j = max(self.unit_end(i, hi), i + 1)
        if t in ("break", "continue", "return"):
            return [self.simple(t, i, j)], j
        return [self.simple("simple", i, j)], j

    def head(self, i: int, hi: int) -> tuple[int, int, int]:
        """(first, last + 1) of what is tested after a keyword, and where its body begins."""
        if self.lang in ("go", "rust"):
            j = i + 1
            while j < hi and self.tok[j] != "{":
                j = self.match[j] + 1 if self.match[j] > j else j + 1
            return i + 1, j, j
        p = next((x for x in range(i + 1, min(i + 3, hi)) if self.tok[x] == "("), None)
        return (p + 1, self.match[p], self.match[p] + 1) if p is not None else (i + 1, i + 1, i + 1)

    def span(self, a: int, b: int) -> str:
        return self.text[self.at[a] : self.end[b - 1]] if b > a else ""

    def branch(self, i: int, hi: int) -> tuple[list[Stmt], int]:
        a, b, j = self.head(i, hi)
        cut = max((x for x in self.top(a, b) if self.tok[x] == ";"), default=a - 1) + 1
        body, j = self.body(j, hi)
        orelse: list[Stmt] = []
        if j < hi and self.tok[j] == "else":
            orelse, j = self.body(j + 1, hi)
        return [Stmt("if", self.line(self.at[i]), self.line(self.end[j - 1] - 1), self.span(i, j), {}, self.loads(cut, b, set()), self.span(cut, b), body, orelse)], j

    def loop(self, i: int, hi: int) -> tuple[list[Stmt], int]:
        if self.tok[i] == "do":
            body, j = self.body(i + 1, hi)
            a = b = j
            if j < hi and self.tok[j] == "while" and j + 1 < hi and self.tok[j + 1] == "(":
                a, b = j + 2, self.match[j + 1]
                j = b + 1
        else:
            a, b, j = self.head(i, hi)
            body, j = self.body(j, hi)
        semi = [x for x in self.top(a, b) if self.tok[x] == ";"]
        if len(semi) >= 2:
            a, b = semi[0] + 1, semi[1]
        else:
            of = next((x for x in self.top(a, b) if self.tok[x] in ("of", "in", "range") or self.tok[x] == ":" and self.lang in ("java", "cpp")), None)
            a = of + 1 if of is not None else a
        return [Stmt("loop", self.line(self.at[i]), self.line(self.end[j - 1] - 1), self.span(i, j), {}, self.loads(a, b, set()), self.span(a, b), body)], j

    def simple(self, kind: str, a: int, b: int) -> Stmt:
        stores: dict[str, int] = {}
        again = False
        if kind == "simple":
            for x in range(a, b):
                t = self.tok[x]
                if self.kind[x] != "op" or t not in ("=", ":=") and t not in _AUGMENTED:
                    continue
                again = again or t in _AUGMENTED
                y = x - 1
                while y >= a and (self.kind[y] == "id" and self.tok[y] not in _RESERVED or self.tok[y] in (",", ".", "]", "*", ":", "?") or self.match[y] >= 0):
                    if self.match[y] >= 0 and self.match[y] < y:
                        y = self.match[y]
                    elif self.kind[y] == "id" and (y == a or self.tok[y - 1] not in (".", "?.", "->", "::")) and not (y + 1 < b and self.kind[y + 1] == "id"):
                        stores.setdefault(self.tok[y], self.line(self.at[y]))
                    y -= 1
                    if self.kind[y] == "id" and y >= a and self.kind[y + 1] == "id":
                        break  # a type before the name
            if not stores and self.tok[a] in ("let", "var", "const") and a + 1 < b and self.kind[a + 1] == "id":
                stores[self.tok[a + 1]] = self.line(self.at[a + 1])
        loads = {} if kind in ("break", "continue") else self.loads(a, b, set() if again else set(stores))
        return Stmt(kind, self.line(self.at[a]), self.line(self.end[b - 1] - 1), self.span(a, b).rstrip(";"), stores, loads)

    def loads(self, a: int, b: int, but: set[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        for x in range(a, b):
            t = self.tok[x]
            if self.kind[x] == "id" and t not in _RESERVED and t not in but and (x == a or self.tok[x - 1] not in (".", "?.", "->", "::")) and not (x + 1 < b and self.kind[x + 1] == "id" and self.tok[x + 1] not in _RESERVED):
                out.setdefault(t, self.line(self.at[x]))
        return out


# ---------------------------------------------------------------------------------------------------- Ruby

_RUBY_OPEN = re.compile(r"^\s*(class|module|def|if|unless|while|until|for|case|begin)\b|(?<![\w.])(do)\b(?:\s*\|[^|]*\|)?\s*$|=\s*(if|case|begin)\b")
_RUBY_WORDS = frozenset("if unless while until for in do end def class module return break next and or not nil true false self then else elsif case when begin rescue ensure yield require require_relative puts".split())


def _ruby(text: str) -> Outline:
    """Definitions by lines that open a scope and the ``end`` that closes it."""
    defs: list[Def] = []
    uses: list[tuple[int, str, str]] = []
    stack: list[tuple[Def | None, list[Stmt], Stmt | None]] = []
    at, pieces, top = 0, [], 0

    def here() -> Def | None:
        return next((d for d, _, _ in reversed(stack) if d is not None), None)

    for n, raw in enumerate(text.splitlines(keepends=True), 1):
        line = re.sub(r"(?:^|\s)#(?!\{).*", "", raw.rstrip("\n"))
        body = line.strip()
        quiet = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", '""', body)
        m = _RUBY_OPEN.search(quiet)
        word = next((g for g in m.groups() if g), None) if m else None
        if not stack and body:
            top = at
        names = lambda s: {x: n for x in re.findall(r"(?<![\w.@:])[a-z_]\w*(?![\w:(?!])", s) if x not in _RUBY_WORDS}
        assign = re.match(r"([a-z_]\w*)\s*([-+*/|&]?=)(?![=~>])\s*(.*)", quiet)
        if req := re.match(r"require(?:_relative)?\s*\(?\s*['\"]([^'\"]+)", body):
            uses.append((at, "imports", module_name(req[1])))
        for c in re.finditer(r"\b([a-z_]\w*[?!]?)\s*\(", quiet):
            if c[1] not in _RUBY_WORDS and not quiet.startswith("def "):
                uses.append((at + max(line.find(c[1]), 0), "calls", c[1]))
        kind = "return" if quiet.startswith("return") else "break" if quiet.startswith("break") else "continue" if quiet.startswith("next") else "simple"
        stmt = Stmt(kind, n, n, body, {assign[1]: n} if assign else {}, names(assign[3] if assign and assign[2] == "=" else quiet))
        into = stack[-1][1] if stack else []
        if word in ("class", "module", "def"):
            name = re.match(rf"\s*{word}\s+(?:self\.)?([\w:?!=]+)", quiet)
            outer = here()
            single = word == "def" and "self." in quiet
            k = "class" if word == "class" else "module" if word == "module" else "method" if single or outer is not None and outer.kind == "class" else "function"
            d = Def(k, (name[1] if name else "?").split("::")[-1], at, at + len(raw), n, n)
            if word == "class" and (base := re.search(r"<\s*([\w:]+)", quiet)):
                d.bases = [base[1].split("::")[-1]]
            if word == "def":
                args = re.search(r"\(([^)]*)\)", quiet)
                d.params = {x: n for x in re.findall(r"[a-z_]\w*", args[1])} if args else {}
                d.body = []
            (outer.members if outer is not None else defs).append(d)
            stack.append((d, d.body if d.body is not None else [], None))
        elif word and not (word == "do" and m and m[2] is None):
            if quiet.endswith("end") and re.search(r"\bend$", quiet) and word != "do":
                into.append(stmt)
            else:
                s = Stmt("if" if word in ("if", "unless") else "loop" if word in ("while", "until", "for", "do") else "simple", n, n, body, {}, names(quiet), re.sub(rf"^{word}\b\s*", "", quiet))
                into.append(s)
                stack.append((None, s.body if s.kind != "simple" else [], s))
        elif re.match(r"(?:else|elsif)\b", quiet) and stack and stack[-1][2] is not None and stack[-1][2].kind == "if":
            s = stack[-1][2]
            if quiet.startswith("elsif"):
                sub = Stmt("if", n, n, body, {}, names(quiet), quiet[5:].strip())
                s.orelse.append(sub)
                stack[-1] = (None, sub.body, sub)
            else:
                stack[-1] = (None, s.orelse, s)
        elif re.match(r"end\b", quiet):
            if not stack:
                raise ValueError("end")
            d, _, s = stack.pop()
            if d is not None:
                d.end, d.end_line = at + len(raw.rstrip("\n")), n
            if s is not None:
                s.end_line = n
            if not stack:
                pieces.append((top, at + len(raw.rstrip("\n"))))
        elif body:
            into.append(stmt)
            if assign and assign[2] == "=":
                outer = here()
                (outer.members if outer is not None else defs).append(Def("variable", assign[1], at, at + len(raw.rstrip("\n")), n, n))
            if not stack:
                pieces.append((at, at + len(raw.rstrip("\n"))))
        at += len(raw)
    if stack:
        raise ValueError("open scope")
    return Outline("ruby", defs, uses, pieces)
