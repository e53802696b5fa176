import ast
import json
import random

import numpy as np

from loamdex.llm import grammar as G
from loamdex.llm import provenance as V
from loamdex.llm import syntax as S

CHUNK = "id long, repo string, file_path string, start_byte long, content string, indexed_at timestamp, text string, language string, cost int, why string, rule long"

GOOD = {
    "py": "import os\nfrom a import (b,\n  c)\n\n@dec(1)\nclass A(B, metaclass=M):\n    x: int = 3\n    async def f(self, *a, k=1, **kw) -> int:\n        if not a and k in (1, 2):\n            return [i for i in a if i]\n        elif k: pass\n        else:\n            y = {**kw, 'z': lambda q: q + 1}\n        try:\n            with open('f') as g, h:\n                g[1:2, ::3] += 1\n        except (E, F) as e:\n            raise X from e\n        finally:\n            del y\n        return y if k else None\n",
    "js": "import { a, b as c } from './x.js';\nexport default class A extends B {\n  #p = 1\n  static async go(x, ...y) { for (const z of y) { await z?.q(); } return `t ${x}`; }\n}\nconst r = /a[/]b/g, f = (x) => ({ k: x, ...r, [x]: 1, m() { return 1 } });\nif (a) b(); else { c(x => x + 1, function () {}); }\nlabel: for (let i = 0; i < 3; i++) { continue label }\nswitch (a) { case 1: b(); break; default: c() }\nexport { a, f };\nvar u = a ? b : c ? 1 : 2\nlet w = [1, , ...r]\ntry { x() } catch { y() } finally { z() }\n".replace("  #p = 1\n", ""),
    "ts": "import type { Row } from './x';\nexport interface A<T> extends B<T> { a: string; b?(x: T): void; readonly c: Map<string, number[]> }\ntype U = 'a' | { k: number } | ((x: number) => void);\nenum E { A = 1, B }\nexport abstract class K<T> implements A<T> {\n  private readonly m: Map<string, T> = new Map<string, T>();\n  constructor(private x: number, y?: string) { super(); }\n  get(k: string): T | undefined { return this.m.get(k) as T; }\n}\nfunction f<T>(x: T[], y: Limits = {}): x is U { return x!.length > 1; }\nconst g = async (a: number, b = 2): Promise<void> => { await h(a); };\n",
    "go": "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype S struct {\n\tA, B int `json:\"a\"`\n\tm map[string][]*T\n}\n\nfunc (s *S) F(a, b int, c ...string) (int, error) {\n\tif v, ok := s.m[\"k\"]; ok && v != nil {\n\t\treturn len(v), nil\n\t} else if a < b {\n\t\tgo func() { ch <- 1 }()\n\t}\n\tfor i, x := range c[1:] {\n\t\tfmt.Println(i, x, []int{1, 2}, map[string]int{\"a\": 1})\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tb += i\n\t}\n\tswitch t := a.(type) {\n\tcase int, string:\n\t\tbreak\n\tdefault:\n\t\t_ = t\n\t}\n\tdefer s.Close()\n\treturn 0, nil\n}\n",
    "java": "package a.b;\n\nimport java.util.*;\nimport static x.Y.z;\n\n@Ann(\"x\")\npublic final class A<T extends B> extends C implements D<T>, E {\n    private static final Map<String, List<T>> M = new HashMap<>();\n    int[] a = {1, 2}, b;\n    public A(int x) { super(x); this.a = new int[3]; }\n    @Override\n    public <R> List<R> f(final T t, String... s) throws IOException {\n        for (int i = 0; i < 3; i++) { if (i > 1) continue; else a[i]++; }\n        for (String q : s) System.out.println((int) 1.5f + q);\n        try (Reader r = open()) { x(y -> y + 1, A::f); } catch (IOException | E e) { throw e; } finally { }\n        return t == null ? Collections.emptyList() : g(t);\n    }\n    enum K { X, Y(1); }\n    interface I { void m(); }\n}\n",
    "c": "#include <stdio.h>\n#define X(a) \\\n  (a)\ntypedef struct row { int a; const char *b[3]; } row_t;\nstatic const unsigned char lut[] = {0x1, 2, 3};\nenum e { A = 1, B };\nlong f(const struct row *r, struct limits *l, ...);\nstatic inline int g(int (*cb)(int), char **v)\n{\n    for (long i = 0; i < 3; ++i) { if (v[i] == NULL) goto out; else r->a += *v[i] & 1; }\n    while (x--) ;\n    do { y = (int)z ? sizeof(struct row) : -1; } while (y > 0);\n    switch (x) { case 'a': return cb(1); default: break; }\nout:\n    return \"a\" \"b\"[0];\n}\n",
    "json": '{"a": [1, 2.5e3, null], "b": {"c": "d"}}',
}


def test_valid_files_cost_nothing():
    for lang, text in GOOD.items():
        assert S.check(text, lang) == (0, None), lang
        assert S.check(text.replace("\n", "\r\n"), lang)[0] == 0, lang
        assert lang == "json" or S.check("", lang)[0] == 0 or lang == "go"
    ast.parse(GOOD["py"])
    json.loads(GOOD["json"])


def test_damage_is_found():
    for lang, text in GOOD.items():
        cut = text[: text.index("{" if lang == "json" else "(", len(text) // 2 if lang != "json" else 1) + 1]
        assert S.check(cut, lang)[0] > 0, lang
        lines = text.split("\n")
        k = len(lines) // 2
        merged = "\n".join([*lines[:k], "<<<<<<< HEAD", lines[k], "=======", lines[k], ">>>>>>> topic", *lines[k:]])
        if lang != "json":
            cost, why = S.check(merged, lang)
            assert cost > 0 and why == "conflict", lang
    assert S.check("<!doctype html>\n<html><body>hi</body></html>\n", "js")[0] > 0
    for lang, other in (("js", "py"), ("java", "py"), ("go", "java"), ("py", "c"), ("c", "py"), ("js", "ts"), ("json", "js"), ("ts", "go")):
        assert S.check(GOOD[other], lang)[0] > 0, (lang, other)


def test_python_agrees_with_the_compiler():
    rng = random.Random(1)
    base = GOOD["py"]
    for _ in range(150):
        i, j = sorted(rng.sample(range(len(base)), 2))
        text = base[:i] + base[j:] if rng.random() < 0.5 else base[:j]
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        if ok:
            assert S.check(text, "py")[0] == 0


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, p = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


def test_cheapest_edit_equals_brute_force():
    rng = random.Random(2)
    words = ["", "ab", "abab", "ababab", "abababab", "c", "cab", "cabab", "cababab"]  # the language c?(ab)*, long enough for the inputs
    auto = S.Automaton("c?(?:ab)*")
    for _ in range(80):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
        want = min(edit(w, x) for x in words)
        at = auto.edits(w)
        assert len(at) == want and at == sorted(at) and all(0 <= i <= len(w) for i in at), w
    assert auto.edits("ab" * 700 + "ba" + "ab" * 700) == [1400, 1401] and len(auto.edits("b" * 3000)) == 1500  # long spans, no limit of edits
    assert auto.edits("ababa") in ([4], [5]) and auto.edits("cxab") == [1]


def residue(s):
    out = []
    for c in s:
        if out and c in S._PAIRS and S._PAIRS[c] == out[-1]:
            out.pop()
        else:
            out.append(c)
    return "".join(out)


def test_bracket_repairs_equal_brute_force():
    balanced, new = {""}, {""}
    for _ in range(4):
        new = {x[:i] + p + x[i:] for x in new for i in range(len(x) + 1) for p in ("()", "[]", "{}")}
        balanced |= new
    rng = random.Random(3)
    for _ in range(60):
        w = residue("".join(rng.choice("()[]{}") for _ in range(rng.randint(1, 4))))
        want = min(edit(w, x) for x in balanced if abs(len(x) - len(w)) <= 4)
        assert len(S.bracket_edits(w)) == want, w
    assert len(S.bracket_edits("(" * 9001)) == 4501 and len(S.bracket_edits(")" * 3 + "[" * 4)) == 4


def least(s):
    """The cost of balancing ``s``, by trying every partner of every bracket."""
    n = len(s)
    cost = np.zeros((n + 2, n + 2), dtype=int)
    fit = np.array([[2 if a in S._PAIRS and b not in S._PAIRS else int(S._PAIRS.get(b) != a) for b in s] for a in s])
    for i in range(n - 1, -1, -1):
        for j in range(i + 1, n + 1):
            cost[i, j] = min(cost[i + 1, j] + 1, (fit[i, i + 1 : j] + cost[i + 1, i + 1 : j] + cost[i + 2 : j + 1, j]).min(initial=j - i))
    return int(cost[0, n])


def test_bracket_repairs_are_least_at_any_length(monkeypatch):
    rng = random.Random(4)
    lines = [residue("".join(rng.choice("()[]{}") for _ in range(n))) for n in (150, 700)] + ["[{]}" * k for k in (1, 100, 101)] + ["(" * 220 + "[" + ")" * 220]
    assert sum(len(x) > 400 for x in lines) == 3
    for x in lines:
        at = S.bracket_edits(x)
        assert len(at) == least(x) and at == sorted(at) and all(0 <= i < len(x) for i in at), x
    want = [S.bracket_edits(x) for x in lines]
    monkeypatch.setattr(S, "IN_MEMORY", 0)
    assert [S.bracket_edits(x) for x in lines] == want
    assert len(S.bracket_edits("(" * 2000 + "[" + ")" * 2000)) == 1


def test_crossing_brackets_are_errors():
    for n in range(1, 300, 7):
        w = "".join(random.Random(n).choice("()[]{}") for _ in range(n))
        left = "".join(c for c, _ in S.unmatched((c, i) for i, c in enumerate(w)))
        assert left == residue(w) and len(S.bracket_edits(left)) == (least(w) if n < 100 else least(left))
    for k in (1, 3, 90, 250):  # the groups, each closed by what comes later or at the end, hold nothing wrong
        text = "[" + ", ".join(["[{]}"] * k) + "]"
        left = residue("".join(c for c in text if c not in ", "))
        assert S.check(text, "json")[0] == least(left) > 0, k
    # A stray bracket and one that is missing cost one edit among any number of groups.
    for k in (3, 300):
        assert S.check("[" * k + "}" + "]" * k, "json")[0] == 1
        assert S.check("[" * k + "1" + "]" * k + "]", "json")[0] == 1


# Valid pieces of each language that a grammar gets wrong easily, and damaged ones.
VALID = {
    "js": [
        "if (a) b()\nelse c()", "async function* g() { yield* h() }", "const t = `a${`b${c}`}`;", "class A { static { x = 1; } #p = 1; get y() { return this.#p } static async *z() {} }", "a?.b?.[c]?.(d)",
        "for await (const x of y) z(x);", "x = a ? b ? c : d : e", "let r = a ||\n  /['`]/.test(b)", "a()\n!b && c()", "while (1) try { a() } catch { }", "a.delete\nb.default = c", "#!/bin/x\na()", "label: for (;;) { continue label }",
        "({a, b: c, [d]: e, get f() { return 1 }, async g() {}, ...h})", "import a, {b as c} from 'm'\nexport * as ns from \"m\";",
    ],
    "ts": [
        'declare module "x" { export function f(a: string): void; }', "function f(val: any): asserts val is string {}", "type C = new (a: string) => Foo;", "const x = <any>y;", "type U<T> = T extends (infer R)[] ? R : never;", "export = foo;",
        "type T = [a: string, b?: number, ...rest: string[]];", "declare const s: unique symbol;", "declare global { interface Window { a: string } }", "interface I extends J<K>, L { readonly a?: string; [k: string]: any; new (x: number): I; m<T>(a: T): void }",
        "type M = { readonly [K in keyof T]?: T[K] };", "@Comp({a: 1}) class X { @Input() y: string; }", "function o(a: string): void;\nfunction o(a: any) {}",
    ],
    "java": [
        '@interface A { String value() default "x"; int[] n() default {}; }', "record P(int x, int y) { P { if (x < 0) throw new X(); } }", "class A { int f(Object o) { return switch (o) { case Integer i -> i; case String s when s.isEmpty() -> 0; default -> { yield 1; } }; } }",
        "enum E { A(1) { void f() {} }, B(2); E(int x) { this.x = x; } }", "class A { void f() { try (var x = g(); var y = h()) { } catch (A | B e) { } } }", "class A { Map<String, List<int[]>> m = new HashMap<>(); Supplier<A> s = A::new; }",
    ],
    "c": [
        "#ifdef A\nint f(void) {\n#else\nint g(void) {\n#endif\n return 1; }", "int f(a, b) int a; char *b; { return a; }", "__attribute__((unused)) static int x;", "static int f(void) __attribute__((noinline));", 'extern "C" { int f(void); }',
        "void f(void) { switch (x) { case 1 ... 3: a(); break; default: b(); } }", "int (*f(int x))(void) { return 0; }", "struct s { int a : 3; union { int b; } u; };", "#if 0\nint ( {\n#endif\nint a[] = { [0] = 1, [2] = 3 };",
    ],
    "go": ["package a\nfunc f[T any](x T) (T, error) { return x, nil }", "package a\ntype I interface { M(int) (string, error); ~int | ~string; J }", "package a\nfunc f() { select { case v, ok := <-ch: g(v); default: } }", "package a\nfunc f() { L: for i := range 10 { break L } }"],
    "py": [
        "if x := f(): pass", "match a:\n  case [1, *r] if r: pass\n  case {'x': y, **z}: pass\n  case A(b=1) | B(): pass\n", "f\"{x!r:>{w}}\" f'{a['b']}'", "type A[T] = list[T]", "try: pass\nexcept* E as e: pass\n", "def f(a, /, b, *, c: int = 1) -> None: ...",
        "with (a as b, c as d): pass", "x = lambda *a, b=1, **k: (a, b)", "if a: b; c\nelse: d", "async def f():\n  async for x in y: await z\n",
    ],
}
DAMAGED = {
    "js": ["let b = = 2;", "f(", "if a) b()", "x = ;", "a b", "return }"], "ts": ["let x: = 1;", "interface { }", "type X = ;"], "java": ["class A { int x = ; }", "class { }", "class A { int f() { return 1 } }"],
    "c": ["int x = ;", "int f( { }", "void f(void) { return 1 }", "struct s { int a }"], "go": ["package a\nfunc f( { }", "func f() {}"], "py": ["def f(:\n pass", "x = = 1", "if x\n  pass", "f(a b)"],
    "json": ['{"a": }', "[1,]", "{a: 1}", "01", "{'a': 1}", ""],
}


def test_what_the_chart_accepts():
    for lang, many in VALID.items():
        for text in many:
            assert S.parser(lang).parse(text)[1] == [], (lang, text)
    for lang, many in DAMAGED.items():
        for text in many:
            assert S.check(text, lang)[0] > 0, (lang, text)


def test_causes_come_from_where_the_edits_lie():
    body = "".join(f"let v{i} = f{i}(1, 2);\n" for i in range(40))
    assert S.check(body.replace("v20 =", "v20 = ="), "js") == (1, "local")
    assert S.check(body + "function g() {\n  if (a) {\n    b(", "js")[1] == "truncation"
    assert S.check(body + "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x\n" + body, "js")[1] == "conflict"
    assert S.check(GOOD["py"], "js")[1] == "mismatch" and S.check(GOOD["go"], "java")[1] == "mismatch"
    assert S.check(body + "// <<<<<<< HEAD\n", "js") == (0, None)
    for text in (body + "x = = 1;\n" + body, "a(\n" * 3 + body, body.replace("f9(", "f9(,")):
        s, at = S.parser("js").parse(text)
        assert len(S.parser("js").lines(text)) == len(s) and all(0 <= e <= len(s) for e in at)


def test_deep_nesting_is_one_pass():
    assert S.parser("js").parse("(" * 100_000 + "a" + ")" * 100_000)[1] == []
    assert len(S.parser("js").parse("[" * 50_000)[1]) >= 25_000


def rows(files, extra=()):
    out = []
    for n, (repo, path, text) in enumerate(files):
        raw = text.encode()
        cuts = [0, len(raw) // 2, len(raw)]
        while cuts[1] < len(raw) and raw[cuts[1]] & 0xC0 == 0x80:
            cuts[1] += 1
        for k in (1, 0):
            out.append((n * 2 + k, repo, path, cuts[k], raw[cuts[k] : cuts[k + 1]].decode(), None, "x", "y", 1, "z", 2))
        out.append(out[-1])  # redelivered
    return out + list(extra)


ODD = [(900, None, "a.py", 0, "x", None, "", "", 0, "", 0), (901, "r", None, 0, "x", None, "", "", 0, "", 0), (902, "r", "b.py", None, "x", None, "", "", 0, "", 0), (903, "r", "c.py", 0, None, None, "", "", 0, "", 0)]


def test_repairs_over_chunks(spark):
    files = [("r", f"d/good.{e}", t) for e, t in GOOD.items()] + [("r", "bad.py", "def f(:\n"), ("q", "bad.go", GOOD["py"]), ("q", "notes.md", "def f(:"), ("q", "deep.js", "(" * 3000 + ")" * 3000 + ";"), ("q", "long.py", "x = [" + "1, " * 100_000 + "]\n"), ("q", "empty.py", "")]
    df = spark.createDataFrame(rows(files, ODD), CHUNK)
    got = {(r["repo"], r["file_path"]): r["cost"] for r in S.repairs(df).collect()}
    assert {k for k, v in got.items() if v} - {("q", "deep.js")} == {("r", "bad.py"), ("q", "bad.go")}
    assert ("q", "notes.md") not in got and ("q", "long.py") in got
    rates = {(r["repo"], r["language"]): (r["files"], r["broken"]) for r in S.rates(S.repairs(df)).collect()}
    assert rates["r", "python"] == (2, 1)
    assert S.repairs(spark.createDataFrame([], CHUNK)).count() == 0


def naive_size(seq):
    """Grammar size of plain Re-Pair: a lower or equal quality bound isn't fixed, so only exactness is compared."""
    seq, rules, fresh = list(seq), 0, 10**6
    while True:
        count, last = {}, {}
        for i in range(len(seq) - 1):
            p = (seq[i], seq[i + 1])
            if last.get(p, -2) != i - 1 or seq[i] != seq[i + 1]:
                count[p] = count.get(p, 0) + 1
                last[p] = i
        best = max(count.items(), key=lambda x: x[1], default=(None, 0))
        if best[1] < 2:
            return len(seq) + 2 * rules
        out, i = [], 0
        while i < len(seq):
            if i + 1 < len(seq) and (seq[i], seq[i + 1]) == best[0]:
                out.append(fresh)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        seq, rules, fresh = out, rules + 1, fresh + 1


def test_repair_is_close_to_plain_repair():
    rng = np.random.default_rng(1)
    files = [rng.integers(0, 6, 300), np.tile(rng.integers(0, 9, 17), 30), np.zeros(200, int), rng.integers(0, 1000, 100), np.zeros(0, int), np.array([3])]
    starts = np.cumsum([0, *map(len, files)])
    got = G.repair(np.concatenate(files).astype(np.int64), starts)
    for f, g in zip(files, got):
        want = naive_size(f.tolist())
        assert want * 0.8 <= g <= want * 1.35 + 6, (want, g)
    one = [G.repair(f.astype(np.int64), np.array([0, len(f)]))[0] for f in files]
    assert one == got.tolist()  # files don't influence each other


def hand(rng, n=45):
    words = [f"name{i}" for i in range(500)]
    w = lambda: rng.choice(words)

    def expr(d=0):
        k = rng.randint(0, 8 if d < 3 else 2)
        return [w, lambda: str(rng.randint(0, 999)), lambda: f"{w()}.{w()}", lambda: f"{w()}({expr(d + 1)})", lambda: f"{w()}({expr(d + 1)}, {expr(d + 1)})", lambda: f"{expr(d + 1)} {rng.choice('+-*/')} {expr(d + 1)}",
                lambda: f"{w()}[{expr(d + 1)}]", lambda: f"({expr(d + 1)}, {expr(d + 1)})", lambda: f"not {expr(d + 1)}"][k]()

    def stmt(pad, d=0):
        k = rng.randint(0, 6 if d < 3 else 2)
        more = lambda: "".join(stmt(pad + "    ", d + 1) for _ in range(rng.randint(1, 3)))
        return [lambda: f"{pad}{w()} = {expr()}\n", lambda: f"{pad}{w()}({expr()})\n", lambda: f"{pad}return {expr()}\n", lambda: f"{pad}if {expr()} > {expr()}:\n{more()}", lambda: f"{pad}for {w()} in {expr()}:\n{more()}",
                lambda: f"{pad}while {expr()}:\n{more()}{pad}{w()} += {expr()}\n", lambda: f"{pad}with {w()}({expr()}) as {w()}:\n{more()}"][k]()

    return f"def {w()}({w()}, {w()}):\n" + "".join(stmt("    ") for _ in range(n)) + "\n"


def test_provenance_cases(spark):
    rng = random.Random(5)
    lib, own = hand(rng), hand(rng)
    getters = "".join(f"def get_f{i}(msg):\n    return msg._fields['f{i}']\n\n\n" for i in range(40))
    table = "LUT = [\n" + "".join(f"    {rng.random():.4f}, {rng.random():.4f},\n" for _ in range(200)) + "]\n"
    mini = "!function(e,t){" + "".join(f"var {rng.choice('abcdef')}{i}=n(r,{i});if(o>u)return s[f];" for i in range(60)) + "}();"
    files = [
        ("o/a", "src/hand.py", own), ("o/a", "src/copy_of_hand.py", own), ("o/a", "src/gen.py", getters), ("o/a", "src/marked.py", "# Code generated by tool. DO NOT EDIT.\n" + hand(rng)),
        ("o/a", "src/speaks.py", "import os\n\nBANNER = '# Code generated by tool. DO NOT EDIT.'\n" + hand(rng)), ("o/a", "src/not.py", "# Not generated: keep the order.\n" + hand(rng)),
        ("o/a", "src/table.py", table), ("o/a", "src/small.py", "SMALL = [1, 2, 3, 4]\n" + hand(rng)), ("o/a", "src/app.js", mini), ("o/a", "lib/x.py", lib), ("p/b", "core/y.py", lib.replace("    ", "\t").replace(" = ", "=")),
        ("p/b", "third_party/z/q.py", hand(rng)), ("p/b", "readme.md", getters), ("p/b", "empty.py", ""),
    ]
    df = spark.createDataFrame(rows(files, ODD), CHUNK)
    got = {(r["repo"], r["file_path"]): r["why"] for r in V.provenance(df).collect()}
    assert got == {
        ("o/a", "src/hand.py"): None, ("o/a", "src/copy_of_hand.py"): None, ("o/a", "src/gen.py"): "generated", ("o/a", "src/marked.py"): "generated", ("o/a", "src/speaks.py"): None,
        ("o/a", "src/not.py"): None, ("o/a", "src/table.py"): "data", ("o/a", "src/small.py"): None, ("o/a", "src/app.js"): "minified", ("o/a", "lib/x.py"): "vendored", ("p/b", "core/y.py"): "vendored",
        ("p/b", "third_party/z/q.py"): "vendored", ("p/b", "empty.py"): None,
    }
    assert V.provenance(spark.createDataFrame([], CHUNK)).count() == 0


def test_comments_around_the_code():
    head, tail = V.around("#!/bin/x\n# a\n\nimport os\n# b\nx = 1\n# c\ny = 2\n# d\n\n")
    assert head == ["#!/bin/x", "# a", "# b"] and tail == ["# d"]
    head, _ = V.around("/*\n one\n two */\npackage a\n\n" + "// n\n" * 40 + "func f() {}\n// z\nvar x = 1\n")
    assert head[:3] == ["/*", " one", " two */"] and len(head) == 43
    assert V.around("") == ([], []) and V.around("x\n") == ([], [])


def test_what_decides_about_a_file(spark):
    rng = random.Random(5)
    blob = "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(900))
    table = "T = [\n" + "".join(f"    ({rng.randint(0, 9999)}, {rng.randint(0, 9999)}, 'k{i}'),\n" for i in range(60)) + "]\n"
    words = " ".join(rng.choice("a quick note about the way this works for those who read it later".split()) for _ in range(300))
    made = "".join(f"def get_{i}(self):\n    return self._data.get({i}, None)\n" for i in range(40))
    far = "x = 1\n" * 3 + "import a\n" * 3
    files = {"blob.py": f'X = "{blob}"\n', "table.py": table, "text.py": f'import os\n\nHELP = "{words}"\n\n\ndef show(out, sep):\n    out.write(HELP + sep)\n    return len(HELP)\n', "made.py": made, "late.py": far + "# generated by hand\ny = 2\n"}
    df = spark.createDataFrame(rows([("r", k, v) for k, v in files.items()]), CHUNK)
    got = {r["file_path"]: (r["why"], r["by"]) for r in V.provenance(df).collect()}
    assert got == {"blob.py": ("data", "grammar"), "table.py": ("data", "grammar"), "text.py": (None, None), "made.py": ("generated", "grammar"), "late.py": (None, None)}
