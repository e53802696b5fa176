"""Keyword-stuffed and link-list pages.

Each page becomes a sequence of words, links and code marks. A suffix automaton over that sequence finds for
every position the longest run ending there that occurs at least ``often`` times in the page; the characters
covered by such maximal repeats are the page's repetition. The page is also split into clauses, and a clause
needs structure: small words (articles, pronouns, prepositions, auxiliaries) of four languages, or, in any other,
enough different short words in stretches between commas that are longer than a keyword or a name; in scripts
that write no spaces, a stretch of some length. A word is *said* if its clause has that structure and isn't mostly repeats; links and words of clauses
without it are *listed*; words of program code count as neither, and a line is code by two kinds of signs or
more, never by one mark. A page is spam if most of its characters are listed, linked or repeated.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.session import spread

# Small words that clauses of English, German, French and Spanish are built with.
_EN = """
    a an the this that these those my our your their its his her it we you they he she i me us them who whom whose which what whoever whatever
    is are was were be been being am has have had do does did not no nor cannot can could may might must shall should will would to of in on at
    by for from with without about into onto over under after before since until while when once as than then so but and or if unless although
    though because whereas even there here each every any some all both most many much more another other same such only also just how why where
    out up down off again ever never often now nobody nothing one two
"""
_DE = """
    der die das den dem des ein eine einen einem einer eines dieser diese dieses diesen jeder jede jedes alle mein unser unsere ihr ihre sein seine
    ich wir sie er es man niemand wer was ist sind war waren wird werden wurde hat haben hatte kann konnte können muss musste soll sollte will wollte
    darf nicht kein keine zu zum zur von vom im in an am auf aus bei mit nach vor seit bis durch für gegen ohne um unter über und oder aber sondern
    wenn weil damit dass obwohl während als wie so auch nur noch schon dann hier dort mehr sehr
"""
_FR = """
    le la les l un une des du de d ce cet cette ces mon notre nos leur leurs son sa ses chaque il elle on nous vous ils elles je tu qui que quoi dont
    est sont était étaient sera être a ont avait avoir peut pouvait doit devait devrait va vont veut voulait ne n pas plus à au aux en dans sur sous
    par pour avec sans avant après depuis entre vers chez et ou mais donc or ni car si quand lorsque alors tandis comme bien aussi très tous tout toute
    personne même
"""
_ES = """
    el la los las lo un una unos unas de del al este esta estos estas ese esa mi su sus nuestro nuestra cada él ella ellos nosotros yo tú quien que qué
    es son era eran será ser está están ha han había haber puede podía debe debería va van quiere quería suele no ni a en con sin por para sobre bajo
    tras desde hasta entre antes después y e o u pero sino porque aunque si cuando mientras donde como más muy ya también todos todo toda nadie
"""
SMALL_WORDS = frozenset(f"{_EN} {_DE} {_FR} {_ES}".split())
#: A bare link counts as this many characters, about two words, however long its address is.
LINK_CHARS = 12
_LINK = re.compile(r"!?\[([^\]\n]*)\]\(\s*[^)\s]*\s*\)|<?(?:https?://|www\.)[^\s<>\"')\]]+>?", re.I)
#: Scripts without spaces between words (Thai, Lao, Burmese, Khmer, kana and Chinese characters); each
#: of their characters is a word by itself.
_SPACELESS = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"[{_SPACELESS}]|(?:(?![{_SPACELESS}])[^\W\d_])+(?:['’][^\W\d_]+)?|\d+|_+")
#: The same for texts without such scripts, which is faster.
_SPACED = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|_+")
_ALONE = re.compile(rf"[{_SPACELESS}]")
#: A clause has structure with SMALL of its words being small, or of FEW words and more with SMALL of them different
#: words of up to SHORT_LETTERS letters and STRETCH words between commas, or of RUN characters of a script without
#: spaces, PAUSE of them between commas.
SMALL, FEW, SHORT_LETTERS, STRETCH, RUN, PAUSE = 0.12, 5, 3, 4, 8, 5
_CLAUSE = re.compile(r"(?<=[.!?…])\s+|[。！？]+|[;\n\r|]+|\s[-–—»•*]\s|:\s")
_COMMA = re.compile(r"[,،、，]")
_KEYWORD = r"\s*(?:export|import|from|package|return|const|let|var|def|class|func|function|if|else|elif|for|while|try|except|finally|static|public|private|async|raise|throw|void|int)\b"
#: Kinds of signs of program code. Two kinds are needed, so no sign does alone. Those at the start of a line, and
#: those anywhere, each with characters of which a line has one if it has the sign.
_STARTS = tuple(map(re.compile, (_KEYWORD + r"|\s*#include|\s*@\w+\s*(?:\(|$)", r"\s*@\w+\s*$|\s*#include\s*[<\"]", r"\s*[\w.\[\]]+\s*(?::=|[-+*/|&]?=)\s*\S")))
_ANYWHERE = tuple((c, re.compile(r)) for c, r in (
    ("(", r"\w\("), ("(", r"\w\([^)]*\)\s*[;{:]?\s*$"), ("=", r"\s(?::|[-+*/|&!=<>])?=\s*\S"), ("{}[]", r"[{}\[\]]"), ("\"'", r"\"[^\"]*\"|'[^']*'"),
))
_NAME = re.compile(r"\w[._]\w|[a-z][A-Z]")
#: Marks that also separate keywords: together they are one kind, and only beside another.
_SEPARATOR = re.compile(r"=>|->|::|&&|\|\||[;,:]\s*$")
_BARE = re.compile(r"^\s*[{}()\[\];,]+\s*$")
#: A line with more words than this is code only with two kinds of signs and a sign for every DENSE words.
SHORT, DENSE = 12, 4
#: An indented line with a sign follows a line of code if that is at most so many lines above.
FOLLOW = 3


def signs(line: str) -> int:
    """2 if ``line`` is code by its own signs, 1 if it is where code surrounds it, else 0."""
    if _BARE.match(line):
        return 2
    found = [1 for s in _STARTS if s.match(line)]
    found += [len(s.findall(line)) for chars, s in _ANYWHERE if any(c in line for c in chars)]
    kinds = sum(map(bool, found))
    words = len(_WORD.findall(line)) if len(line) > 2 * SHORT else 0
    if words > SHORT and not kinds:
        return 0
    names = len(_NAME.findall(line))
    kinds, apart = kinds + (names > 0), _SEPARATOR.search(line) is not None
    if words > SHORT:
        return 2 if kinds >= 2 and (sum(found) + names) * DENSE >= words else 0
    return 2 if kinds + apart >= 2 and kinds else int(kinds + apart > 0)


class Automaton:
    """Suffix automaton of a sequence; states carry length, link and number of occurrences."""

    __slots__ = ("length", "link", "next", "count", "last")

    def __init__(self, seq: list[int]):
        self.length, self.link, self.next, self.count = [0], [-1], [{}], [0]
        self.last = 0
        for c in seq:
            self._add(c)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        count, link = self.count, self.link
        for s in order:
            count[link[s]] += count[s]

    def _add(self, c: int) -> None:
        length, link, nxt, count = self.length, self.link, self.next, self.count
        cur, p = len(length), self.last
        length.append(length[p] + 1)
        link.append(0)
        nxt.append({})
        count.append(1)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                nxt.append(dict(nxt[q]))
                count.append(0)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        self.last = cur

    def repeats(self, seq: list[int], often: int) -> list[int]:
        """For every position the length of the longest run ending there that occurs ``often`` times or more."""
        length, link, count, nxt = self.length, self.link, self.count, self.next
        best = [0] * len(length)
        for s in sorted(range(1, len(length)), key=length.__getitem__):
            best[s] = length[s] if count[s] >= often else best[link[s]]
        out, s = [], 0
        for c in seq:
            s = nxt[s][c]
            out.append(best[s])
        return out


def covered(seq: list[int], often: int, least: int) -> list[bool]:
    """Positions covered by maximal repeats of ``least`` items or more that occur ``often`` times or more.

    With ``least`` of two or more, what lies in no pair that occurs so often lies in no such repeat; each stretch of
    it becomes one item of its own, so the automaton of a page without repeats is small."""
    if len(seq) < often:
        return [False] * len(seq)
    where = list(range(len(seq)))
    if least >= 2:
        pairs = Counter(zip(seq, seq[1:]))
        hot = [False] * len(seq)
        for i, p in enumerate(zip(seq, seq[1:])):
            if pairs[p] >= often:
                hot[i] = hot[i + 1] = True
        where = [i for i in range(len(seq)) if hot[i] or i and hot[i - 1]]
        if not where:
            return hot
    own = [seq[i] if least < 2 or hot[i] else -1 - i for i in where]
    runs = Automaton(own).repeats(own, often)
    out, reach = [False] * len(seq), len(own)
    for k in range(len(own) - 1, -1, -1):
        if runs[k] >= least:
            reach = min(reach, k - runs[k] + 1)
        out[where[k]] = k >= reach
        if k <= reach:
            reach = len(own)
    return out


def structured(words: list[str], segments: int) -> bool:
    """Whether a clause of these words, in so many stretches between commas, is built like a sentence."""
    n = len(words)
    if sum(w in SMALL_WORDS for w in words) >= SMALL * n and n >= 3:
        return True
    if 2 * sum(_ALONE.match(w) is not None for w in words) > n:
        return n >= max(RUN, PAUSE * segments)
    short = len({w for w in words if len(w) <= SHORT_LETTERS and w.isalpha()})
    return n >= FEW and n >= STRETCH * segments and short >= SMALL * n


def features(text: str, often: int = 3, least: int = 2) -> tuple[int, int, int, int, int]:
    """Characters of words: (said, listed, repeated, code, link): repeated are those of clauses that repeats cover."""
    vocab: dict[str, int] = {}
    seq: list[int] = []
    clauses: list[tuple[int, int, bool]] = []  # first and last position in seq, whether it has structure
    sizes: list[int] = []
    code = link = 0
    find = (_WORD if _ALONE.search(text) else _SPACED).findall
    since = FOLLOW  # lines since one that was code by its own signs
    for line in text.splitlines():
        if not line.strip():
            continue
        links = 0

        def mark(m: re.Match) -> str:
            nonlocal links
            links += min(len(m[0]), LINK_CHARS) if m[1] is None else max(len(m[1]), 1)
            return " ; "

        plain = _LINK.sub(mark, line) if "://" in line or "](" in line or "www." in line else line
        link += links
        sign = 0 if links else signs(line)
        since = 0 if sign == 2 else FOLLOW if links or line[0] not in " \t" else since + 1
        if sign == 2 or sign and since < FOLLOW:
            # Repeats run through code as well; only what its words count as differs.
            ws = find(line.lower())
            seq += [vocab.setdefault(w, len(vocab)) for w in ws]
            sizes += map(len, ws)
            code += sum(map(len, ws))
            continue
        for part in _CLAUSE.split(plain):
            ws = find(part.lower())
            if not ws:
                continue
            start = len(seq)
            seq += [vocab.setdefault(w, len(vocab)) for w in ws]
            sizes += map(len, ws)
            clauses.append((start, len(seq), structured(ws, len(_COMMA.findall(part)) + 1)))
    cover = covered(seq, often, least)
    said = listed = repeated = 0
    for a, b, built in clauses:
        chars = sum(sizes[a:b])
        rep = sum(s for s, c in zip(sizes[a:b], cover[a:b]) if c)
        if built:
            if rep > 0.7 * chars:
                repeated += chars
            else:
                said += chars
        else:
            listed += chars
    return said, listed, repeated, code, link


def score(text: str) -> tuple[float, float]:
    """(share of characters that are listed, linked or repeated; share of them that are code)."""
    said, listed, repeated, code, link = features(text)
    total = said + listed + repeated + code + link
    return ((listed + repeated + link) / total, code / total) if total else (0.0, 0.0)


def spam(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """(doc_id, score): pages of which more than ``limit`` is listed, linked or repeated.

    Null and empty texts and texts without words are never spam. Every text is read whole; repeated rows of a
    doc_id give its largest score once. The automaton is linear in the length of a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, score(t)[0]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "score"])

    scored = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna()).mapInArrow(run, "doc_id long, score double")
    return scored.filter(F.col("score") > limit).groupBy("doc_id").agg(F.round(F.max("score"), 6).alias("score"))
