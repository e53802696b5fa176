"""Cutting oversized items at natural boundaries, by lexical cohesion.

Between any two lines the words of the block above and of the block below are compared; valleys of that
similarity mark a change of topic. Each piece ends at the best gap of its size window: gaps between
functions come before gaps between statements and those before gaps between lines, and within a class the
deepest valley wins. Only a line that alone is over the limit is cut inside, at a space or delimiter if the
window holds one, else between characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W\d_]{2,}")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
#: A line that opens a declaration in one of the languages or a section of a document.
_OPENS = re.compile(
    r"\s*(?:@\w|(?:export\s+|default\s+|public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|async\s+|inline\s+|extern\s+)*"
    r"(?:def|class|func|function|interface|enum|struct|type|impl|trait|module|namespace)\b|#{1,6}\s"
    r"|(?:(?:public|private|protected|static|final|const|unsigned|struct)\s+)+[\w<>\[\],* ]+\([^;]*$)"
)
_OPEN_END = re.compile(r"(?:[,(\[{=+\-*/%&|<>?:.\\]|\b(?:and|or|not|in|return|else))\s*$")
_SOFT = re.compile(rb"[\s,;)\]}>]")


def gap_depths(lines: list[str], block: int = 6) -> list[float]:
    """Depth of the similarity valley before each line (0 for the first): how far the cosine of the ``block``
    lines above and below falls under the peaks on its two sides."""
    bags = [Counter(w.lower() for w in _WORD.findall(x)) for x in lines]
    n = len(lines)
    left: Counter = Counter()
    right: Counter = Counter()
    dot = ll = rr = 0

    def add(own: Counter, other: Counter, bag: Counter, sign: int) -> tuple[int, int]:
        sq = cross = 0
        for w, c in bag.items():
            c *= sign
            sq += c * (2 * own[w] + c)
            cross += c * other[w]
            own[w] += c
        return sq, cross

    for x in bags[:block]:
        d, c = add(right, left, x, 1)
        rr, dot = rr + d, dot + c
    sims = [1.0]
    for i in range(1, n):
        d, c = add(right, left, bags[i - 1], -1)
        rr, dot = rr + d, dot + c
        if i - 1 + block < n:
            d, c = add(right, left, bags[i - 1 + block], 1)
            rr, dot = rr + d, dot + c
        d, c = add(left, right, bags[i - 1], 1)
        ll, dot = ll + d, dot + c
        if i - 1 - block >= 0:
            d, c = add(left, right, bags[i - 1 - block], -1)
            ll, dot = ll + d, dot + c
        sims.append(dot / (ll * rr) ** 0.5 if ll and rr else 0.0)
    up = list(sims)  # climbing to the left while the similarity rises
    for i in range(1, n):
        up[i] = max(sims[i], up[i - 1]) if sims[i - 1] >= sims[i] else sims[i]
    down = list(sims)
    for i in range(n - 2, -1, -1):
        down[i] = max(sims[i], down[i + 1]) if sims[i + 1] >= sims[i] else sims[i]
    return [up[i] + down[i] - 2 * sims[i] for i in range(n)]


def _class(lines: list[str], i: int) -> int:
    """2: a declaration or paragraph starts at line i; 1: a statement does; 0: only a line does."""
    before, here = lines[i - 1], lines[i]
    if not before.strip() and here.strip() or _OPENS.match(here) and not before.lstrip().startswith(("@", "//", "/*", "*", "#")):
        return 2
    if _OPEN_END.search(before) or here.lstrip()[:1] in (")", "]", "}", ".", ",", "&", "|", "?", ":"):
        return 0
    return 1


def cut(text: str, limit: int = 1500, overlap: int = 150, block: int = 6) -> list[tuple[int, int, int]]:
    """Pieces of ``text`` as byte offsets (start, end, overlap): bytes start..end, of which the first ``overlap``
    repeat the piece before. Without them the pieces join to the text. A text within the limit is one piece."""
    if limit < 8 or not 0 <= overlap <= limit // 2:
        raise ValueError("limit must be at least 8 and overlap at most half of it")
    raw = text.encode("utf-8", "surrogatepass")
    total = len(raw)
    if total <= limit:
        return [(0, total, 0)]
    lines = _LINE.findall(text)
    ends, at = [], 0
    for x in lines:
        at += len(x.encode("utf-8", "surrogatepass"))
        ends.append(at)
    depth = gap_depths(lines, block)
    kind = [0, *(_class(lines, i) for i in range(1, len(lines)))]
    out, start = [], 0
    while start < total:
        back = _back(raw, ends, out[-1][0] if out else 0, start, overlap) if out else 0
        room = limit - back
        if total - start <= room:
            out.append((start - back, total, back))
            break
        # Gap i lies before line i, at ends[i - 1]; pieces under a third of the limit are made only if nothing else fits.
        lo, hi = bisect_right(ends, start + room // 3), bisect_right(ends, start + room)
        first = bisect_right(ends, start)
        gaps = range(lo + 1, hi + 1) if lo < hi else range(first + 1, hi + 1)
        if gaps:
            best = max(gaps, key=lambda g: (kind[g], round(depth[g], 6), g) if g < len(lines) else (0, 0.0, g))
            end = ends[best - 1]
        else:
            end = _inside(raw, start, start + room)
        out.append((start - back, end, back))
        start = end
    return out


def _inside(raw: bytes, start: int, end: int) -> int:
    """A cut in a line: after the last space or delimiter of the window's second half, else between characters."""
    for i in range(end - 1, (start + end) // 2, -1):
        if _SOFT.match(raw, i):
            return i + 1
    while end > start + 1 and raw[end] & 0xC0 == 0x80:
        end -= 1
    return end


def _back(raw: bytes, ends: list[int], floor: int, start: int, overlap: int) -> int:
    """Bytes to repeat: whole lines if one fits, else from a space on, else whole characters."""
    low = max(floor, start - overlap)
    i = bisect_left(ends, low)
    if i < len(ends) and ends[i] < start:
        return start - ends[i]
    for j in range(low, start):
        if _SOFT.match(raw, j) and j + 1 < start:
            return start - j - 1
    while low < start and raw[low] & 0xC0 == 0x80:
        low += 1
    return start - low


def pieces(chunks: DataFrame, limit: int = 1500, overlap: int = 150) -> DataFrame:
    """(id, piece, start_byte, end_byte, overlap_bytes, token_count, content) of each distinct id whose content has
    more than ``limit`` bytes in UTF-8.

    start_byte and end_byte are those of the piece in its file (the chunk's start_byte, which a null leaves at 0,
    plus the offset); token_count counts runs of non-space, as the index does. Redelivered rows count once: the
    row with the largest indexed_at holds, ties going to the larger content. Null or short contents give no rows,
    nor does an empty table; names of other columns can't clash, as they are not read."""
    big = chunks.filter(F.octet_length("content") > limit).select("id", "indexed_at", "content", F.coalesce("start_byte", F.lit(0)).alias("start_byte"))
    one = big.groupBy("id").agg(F.max(F.struct("indexed_at", "content", "start_byte")).alias("m")).select("id", "m.content", "m.start_byte")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("id", "piece", "start_byte", "end_byte", "overlap_bytes", "token_count", "content")
        for b in batches:
            rows: list[tuple] = []
            for i, text, base in zip(b.column("id").to_pylist(), b.column("content").to_pylist(), b.column("start_byte").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for k, (s, e, o) in enumerate(cut(text, limit, overlap)):
                    part = raw[s:e].decode("utf-8", "surrogatepass")
                    rows.append((i, k, base + s, base + e, o, len(part.split()), part))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return one.mapInArrow(run, "id long, piece int, start_byte long, end_byte long, overlap_bytes int, token_count int, content string")
