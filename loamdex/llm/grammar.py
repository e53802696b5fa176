"""Lexing of program text and Re-Pair grammars over token sequences, for many files at once in numpy."""

from __future__ import annotations

import re
import zlib

import numpy as np

_NUMBER = r"\d[\w.]*"
_DQ, _SQ, _BT = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'", r"`(?:[^`\\]|\\.)*`"
#: Comments come first, then literals, names, numbers and single marks; white space is skipped.
LEX = {
    "py": re.compile(rf"#[^\n]*|[rbfuRBFU]{{0,2}}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|{_DQ}|{_SQ})|[^\W\d]\w*|{_NUMBER}|[^\s]", re.S),
    "c": re.compile(rf"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|{_DQ}|{_SQ}|{_BT}|[^\W\d]\w*|{_NUMBER}|[^\s]", re.S),
}
KEYWORDS = frozenset(
    "and as async await break case catch class const continue def default do elif else enum except export extends final finally for from func function "
    "go if implements import in interface is lambda let long int char double float bool boolean string new not null None True False nil or package "
    "pass private public protected raise range return self static struct super switch this throw throws true false try type typedef typeof unsigned "
    "var void while with yield".split()
)


def family(path: str) -> str | None:
    """Lexer of a path's extension, None for other extensions."""
    e = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    return "py" if e == "py" else "c" if e in ("js", "ts", "go", "java", "c") else None


class Symbols(dict):
    """Token -> (kind << 32 | 32-bit value), cached; kinds: 0 comment, 1 mark or keyword, 2 name, 3 number, 4 string."""

    def __missing__(self, t: str) -> int:
        c = t[0]
        if c.isalpha() or c == "_":
            if t[-1] in "\"'":
                kind = 4
            else:
                kind = 1 if t in KEYWORDS else 2
        elif c.isdigit():
            kind = 3
        elif c in "\"'`" and len(t) > 1:
            kind = 4
        elif c == "#" and len(t) > 1 or t.startswith(("//", "/*")):
            kind = 0
        else:
            kind = 1
        v = kind << 32 | zlib.crc32(t.encode("utf-8", "surrogatepass"))
        if len(t) < 40:
            if len(self) > 500_000:
                self.clear()
            self[t] = v
        return v


def tokens(texts: list[str], paths: list[str], symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all files one after the other without comments, and where each file starts (one more entry)."""
    parts, starts = [], [0]
    for text, path in zip(texts, paths):
        toks = LEX[family(path) or "c"].findall(text)
        a = np.fromiter(map(symbols.__getitem__, toks), dtype=np.int64, count=len(toks))
        a = a[a >> 32 != 0]
        parts.append(a)
        starts.append(starts[-1] + len(a))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array(starts)


#: Tokens that :func:`repair` takes at a time: positions and symbols then fit one sorted word.
BATCH = 1 << 18


def repair(seq: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Size of every file's grammar (final sequence plus two symbols a rule) under Re-Pair, all files at once.

    In each round every file replaces the pairs whose counts are local maxima along its sequence, each by a rule
    of its own, so pairs that don't overlap are replaced in one round, until no pair occurs twice."""
    n_files, out = len(starts) - 1, []
    lo = 0
    while lo < n_files:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BATCH, "right")) - 1)
        hi = min(hi, n_files)
        out.append(_repair(seq[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _repair(seq: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n_files = len(starts) - 1
    owner = np.repeat(np.arange(n_files), np.diff(starts))
    # Symbols of different files differ, so a pair belongs to one file and never crosses two.
    _, cur = np.unique(seq, return_inverse=True)
    _, cur = np.unique(cur * n_files + owner, return_inverse=True)
    cur, fresh = cur.astype(np.int64), int(cur.max(initial=-1)) + 1
    rules = np.zeros(n_files, dtype=np.int64)
    while True:
        m = len(cur) - 1
        if m < 1:
            break
        bits, ib = int(fresh).bit_length(), int(m).bit_length()
        key = (cur[:-1] << bits) | cur[1:]
        key[owner[1:] != owner[:-1]] = -1
        if 2 * bits + ib <= 62:  # one sort of (pair, position) words, far faster than an indirect sort
            word = np.sort((key << ib) | np.arange(m))
            order, sorted_key = word & ((1 << ib) - 1), word >> ib
        else:
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        group = np.cumsum(new) - 1
        cnt = np.bincount(group)
        inv = np.empty(m, dtype=np.int64)
        inv[order] = group
        c = cnt[inv]
        c[key < 0] = 0
        if c.max() < 2:
            break
        pr = c * len(cnt) + (len(cnt) - inv)  # count first, then a fixed order of the pairs
        left, right = np.concatenate([[0], pr[:-1]]), np.concatenate([pr[1:], [0]])
        pick = (c >= 2) & (pr > left) & (pr >= right)
        run = np.flatnonzero((c >= 2) & (pr == left))  # in a run of one symbol every second pair
        if len(run):
            first = np.maximum.accumulate(np.where(np.diff(run, prepend=-2) != 1, np.arange(len(run)), 0))
            at = run[(np.arange(len(run)) - first) % 2 == 1]
            pick[at[~pick[np.maximum(at - 1, 0)] & ~pick[np.minimum(at + 1, m - 1)]]] = True
        at = np.flatnonzero(pick)
        at = at[np.concatenate([[True], np.diff(at) > 1])] if len(at) else at
        used = np.bincount(inv[at], minlength=len(cnt))
        at = at[used[inv[at]] >= 2]
        if not len(at):
            break
        ids, one, back = np.unique(inv[at], return_index=True, return_inverse=True)
        np.add.at(rules, owner[at[one]], 1)
        cur[at] = fresh + back
        fresh += len(ids)
        keep = np.ones(len(cur), dtype=bool)
        keep[at + 1] = False
        cur, owner = cur[keep], owner[keep]
    return np.bincount(owner, minlength=n_files) + 2 * rules


def phrases(seq: np.ndarray, starts: np.ndarray, levels: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules that equal texts get wherever they stand: pairs are replaced where the hash of the pair is a local
    maximum, level by level, so what two files share parses alike in both. Returns (hash of the expansion, width
    in tokens, owner, position) of the symbols left after ``levels`` levels."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = _mix(seq.astype(np.uint64))
    width = np.ones(len(seq), dtype=np.int64)
    pos = np.arange(len(seq))
    for level in range(levels):
        if len(h) < 2:
            break
        pair = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(level))
        pair[owner[1:] != owner[:-1]] = 0
        pick = (pair > np.concatenate([np.zeros(1, np.uint64), pair[:-1]])) & (pair >= np.concatenate([pair[1:], np.zeros(1, np.uint64)])) & (pair > 0)
        at = np.flatnonzero(pick)
        at = at[np.concatenate([[True], np.diff(at) > 1])] if len(at) else at
        h[at] = pair[at]
        width[at] += width[at + 1]
        keep = np.ones(len(h), dtype=bool)
        keep[at + 1] = False
        h, owner, width, pos = h[keep], owner[keep], width[keep], pos[keep]
    return h, width, owner, pos


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def abstract(seq: np.ndarray) -> np.ndarray:
    """Names, numbers and strings without their values; keywords and marks as they are."""
    kind = seq >> 32
    return np.where(kind == 1, seq, kind << 32)
