"""Chunking files: greedy line windows for any text, and syntax-aware chunks for files that have an outline."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import outline as O
from loamdex.session import spread

BUDGET = 1500
_COLUMNS = ["path", "kind", "name", "ast_path", "start_line", "end_line", "start_byte", "end_byte", "content", "warning"]
_SCHEMA = "path string, kind string, name string, ast_path string, start_line int, end_line int, start_byte long, end_byte long, content string, warning string"


def windows(text: str, budget: int = BUDGET) -> list[tuple[int, int, int, int]]:
    """(first line, last line, start byte, end byte) of greedy line windows; a line over the budget is one by itself."""
    out: list[tuple[int, int, int, int]] = []
    first, start, at, line = 1, 0, 0, 0
    for line, piece in enumerate(text.splitlines(keepends=True), 1):
        size = len(piece.encode("utf-8", "surrogatepass"))
        if at > start and at + size - start > budget:
            out.append((first, line - 1, start, at))
            first, start = line, at
        at += size
    if at > start:
        out.append((first, line, start, at))
    return out


@dataclass(frozen=True)
class Slot:
    """A stretch of bytes: a definition (kind and name set), other syntax (``real``), or what lies between."""

    start: int
    end: int
    kind: str | None
    name: str | None
    around: tuple[O.Def, ...]
    real: bool

    def path(self) -> str:
        steps = ["module", *(f"{d.kind}[{d.name}]" for d in self.around)]
        return "/".join([*steps, f"{self.kind}[{self.name or '?'}]" if self.kind else "section"])


def mergeable(a: Slot, b: Slot, budget: int, language: str) -> bool:
    """Whether two neighbours become one chunk. Definitions keep to themselves but for what lies between; in scripts
    so does what belongs to different definitions. Over the budget only a large rest takes in a smaller one."""
    both_plain = a.kind is None and b.kind is None
    if b.end - a.start > budget:
        sizes = a.end - a.start, b.end - b.start
        return both_plain and max(sizes) > budget > min(sizes)
    if both_plain:
        return language not in O.SCRIPT or [id(d) for d in a.around] == [id(d) for d in b.around]
    if a.kind is not None and b.kind is not None:
        return False
    return not (a if a.kind is None else b).real


def _merged(a: Slot, b: Slot) -> Slot:
    keep = a if a.kind is not None else b if b.kind is not None else None
    if keep is not None:
        return replace(keep, start=a.start, end=b.end)
    n = 0
    while n < min(len(a.around), len(b.around)) and a.around[n] is b.around[n]:
        n += 1
    return Slot(a.start, b.end, None, None, a.around[:n], False)


class _Cutter:
    def __init__(self, text: str, got: O.Outline, budget: int):
        self.raw = text.encode("utf-8", "surrogatepass")
        self.at, self.budget, self.language = O.Offsets(text), budget, got.language

    def gap(self, a: int, b: int, around: tuple[O.Def, ...]) -> list[Slot]:
        """What no syntax covers, cut at the budget: behind a line if one ends there."""
        out = []
        while b - a > self.budget:
            cut = self.raw.rfind(b"\n", a, a + self.budget) + 1
            if cut <= a:
                cut = a + self.budget
                while cut > a + 1 and self.raw[cut] & 0xC0 == 0x80:
                    cut -= 1
            out.append(Slot(a, cut, None, None, around, False))
            a = cut
        return [*out, Slot(a, b, None, None, around, False)] if b > a else out

    def cut(self, lo: int, hi: int, pieces: list[tuple[int, int]], members: list[O.Def], around: tuple[O.Def, ...]) -> list[Slot]:
        """Slots that tile the bytes ``lo`` to ``hi``: pieces that fit are whole, others are cut into theirs."""
        out: list[Slot] = []
        last = lo
        k = 0
        for a0, b0 in pieces:
            own = []
            while k < len(members) and members[k].start < b0:
                if members[k].kind in ("class", "function", "method"):
                    own.append(members[k])
                k += 1
            a, b = max(self.at(a0), last), min(self.at(b0), hi)
            if b <= a:
                continue
            out += self.gap(last, a, around)
            last = b
            if b - a <= self.budget and not self.several(own):
                d = own[0] if len(own) == 1 else None
                out.append(Slot(a, b, d.kind if d else None, d.name if d else None, around, True))
            elif own:
                out += self.parts(a, b, own, around)
            else:
                out += [replace(s, real=True) for s in self.gap(a, b, around)]
        out += self.gap(last, hi, around)
        return self.merge(out)

    def several(self, own: list[O.Def]) -> bool:
        """In scripts what holds several definitions is cut even if it fits."""
        return self.language in O.SCRIPT and sum(d.kind in ("class", "function", "method") for d, _ in O.walk(own)) > 1

    def parts(self, a: int, b: int, own: list[O.Def], around: tuple[O.Def, ...]) -> list[Slot]:
        out: list[Slot] = []
        last = a
        for d in own:
            x, y = max(self.at(d.start), last), min(self.at(d.end), b)
            out += self.gap(last, x, around)
            last = y
            if y - x <= self.budget and not self.several([d]):
                out.append(Slot(x, y, d.kind, d.name, around, True))
            elif d.pieces:
                out += self.cut(x, y, d.pieces, d.members, (*around, d))
            else:
                out += self.gap(x, y, (*around, d))
        return [*out, *self.gap(last, b, around)]

    def merge(self, slots: list[Slot]) -> list[Slot]:
        out: list[Slot] = []
        for s in slots:
            if out and mergeable(out[-1], s, self.budget, self.language):
                out[-1] = _merged(out[-1], s)
            else:
                out.append(s)
        return out


def syntax_chunks(path: str, text: str, budget: int = BUDGET) -> list[tuple[str, str | None, str | None, int, int]] | None:
    """(kind, name, ast_path, start byte, end byte) tiling a file; null if it has no outline."""
    got = O.outline(path, text)
    if got is None or not text:
        return None
    c = _Cutter(text, got, budget)
    defs = sorted(got.defs, key=lambda d: d.start)
    for d, _ in O.walk(defs):
        d.members.sort(key=lambda m: m.start)
    return [(s.kind or "section", s.name, s.path(), s.start, s.end) for s in c.cut(0, len(c.raw), sorted(got.pieces), defs, ())]


def chunk_files(files: DataFrame, path: str = "path", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """Chunks of files (path, text): syntax-aware for files that have an outline, line windows for all others. The
    chunks of a file tile it. Line ends are normalised first; null texts give nothing. A file that can't be cut by
    its syntax comes in windows with a ``warning`` in its first chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, t in zip(b["p"], b["t"]):
                t = t.replace("\r\n", "\n").replace("\r", "\n")
                raw = t.encode("utf-8", "surrogatepass")
                warn = None
                try:
                    got = syntax_chunks(p, t, budget) if p is not None else None
                except Exception as e:  # noqa: BLE001 one file must not end the run
                    got, warn = None, f"{type(e).__name__}: {e}"
                if got is None:
                    if warn is None and p is not None and O.language_of(p) and t:
                        warn = "does not parse"
                    got = [("window", None, None, s, e) for _, _, s, e in windows(t, budget)]
                for kind, name, where, s, e in got:
                    line = raw.count(b"\n", 0, s) + 1
                    last = line + raw.count(b"\n", s, max(s, e - 1))
                    rows.append((p, kind, name, where, line, last, s, e, raw[s:e].decode("utf-8", "surrogatepass"), warn))
                    warn = None
            yield pd.DataFrame(rows, columns=_COLUMNS)

    out = spread(files.select(F.col(path).alias("p"), F.col(text).alias("t")).filter("t is not null")).mapInPandas(run, _SCHEMA)
    count = F.size(F.filter(F.split("content", r"\s+"), lambda x: x != ""))
    out = out.withColumns({"content_hash": F.sha2("content", 256), "token_count": count, "language": T.language(F.col("path")), "category": T.category(F.col("path"))})
    return out
