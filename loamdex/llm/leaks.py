"""Evaluation items leaking into training documents.

Items are partitioned by size; of each item the ``sketch`` smallest hashes of its word shingles are its
MinHash sketch: items of the lower size classes are sketched whole, larger ones by ever smaller shares. What share
of the sketch a document holds estimates the containment of the item in the document without regard to the
document's length. Pairs whose estimate allows the wanted containment are verified on exact shingles: every run of
shared shingles is extended along its diagonal over single changed words; runs with a few words more or less
between them are one passage; passages are chained in the order of the item, and the words they span count.

Shingles have three words: single changed words don't matter here, and where every fifth word is changed no five
words in a row are left.

Documents are only read and never shuffled. Items are held by every task, so they are handled in blocks of a
fixed number of words (``words_per_block``), one pass over the documents each.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.session import spread

SHINGLE = 3
#: Words of a passage at least, and words that may come in or be left out between two runs of one passage.
PASSAGE, GAP = 8, 3
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|.)", re.S)
_WORDS = re.compile(r"[^\W_]+")
#: What may stand before a line: marks of quotes, comments, lists and tables, and a number.
_PREFIX = re.compile(r"^[^\w\n]*\d{1,6}(?:[.:)\]|>#-]+[ \t]*|[ \t]+|\t)(?=\S)", re.M)
_SENTENCE = re.compile(r"[^.!?:]*[.!?:]+(?=\s)")
_P = np.uint64(0x9E3779B97F4A7C15)


def _unescape(m: re.Match) -> str:
    if m[1]:
        return chr(int(m[1], 16))
    return " " if m[0][1] in "nrtbf" else m[0][1]


def words(text: str) -> list[str]:
    """Lower-case words without regard to spacing, punctuation, line prefixes and escapes."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    text = _PREFIX.sub("", text)
    return _WORDS.findall(text.casefold())


def item_words(texts: list[str]) -> list[list[str]]:
    """Words of each item without its opening instruction sentence: a first sentence that two items or more share."""
    first = [m[0] if (m := _SENTENCE.match(t)) else "" for t in texts]
    seen = Counter(f.strip() for f in first)
    return [words(t[len(f) :] if f and seen[f.strip()] > 1 else t) for t, f in zip(texts, first)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingles(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` ids; runs that hold an unknown word (id 0) hash to 0."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    known = np.ones(n, dtype=bool)
    for j in range(size):
        part = ids[j : j + n]
        h = h * _P + part.astype(np.uint64)
        known &= part > 0
    return np.where(known, _mix(h), np.uint64(0))


class Items:
    """A block of items as every task holds it."""

    def __init__(self, ids: list, texts: list[list[str]], sketch: int):
        self.ids = ids
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in t], dtype=np.int64) for t in texts]
        self.shingles = [_shingles(w) for w in self.words]
        hashes, owner, place, size = [], [], [], []
        for i, s in enumerate(self.shingles):
            # Size classes by powers of two: small items are sketched whole, larger ones by ever smaller shares.
            u = np.unique(s)
            room = sketch if len(u) <= 2 * sketch else int(sketch * np.log2(len(u) / sketch))
            u = u[:room]
            at = np.flatnonzero(np.isin(s, u))  # with every place where the item has them
            hashes.append(s[at])
            owner.append(np.full(len(at), i))
            place.append(at)
            size.append(len(u))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        o = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        p = np.concatenate(place) if place else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.owner, self.place, self.size = h[order], o[order], p[order], np.array(size)


def spans(item: np.ndarray, item_sh: np.ndarray, doc: np.ndarray, doc_sh: np.ndarray, drop: float = 4.0, miss: float = 1.5) -> list[tuple[int, int, int, int]]:
    """Copied runs (item start, item end, doc start, doc end): shared shingles extended on their diagonals."""
    order = np.argsort(item_sh, kind="stable")
    lo, hi = np.searchsorted(item_sh, doc_sh, "left", order), np.searchsorted(item_sh, doc_sh, "right", order)
    n = np.where(doc_sh > 0, hi - lo, 0)
    at = np.repeat(np.arange(len(doc_sh)), n)
    if not len(at):
        return []
    pos = order[np.repeat(lo, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
    out: list[tuple[int, int, int, int]] = []
    reached: dict[int, int] = {}
    for j, i in sorted(zip(at.tolist(), pos.tolist())):
        if reached.get(j - i, -1) > i:
            continue
        a, b = i, i + SHINGLE
        best, score = 0.0, 0.0
        x, y = b, b + j - i
        while x < len(item) and y < len(doc) and score > best - drop:
            score += 1.0 if item[x] == doc[y] else -miss
            x, y = x + 1, y + 1
            if score > best:
                best, b = score, x
        best = score = 0.0
        x, y = a - 1, a - 1 + j - i
        while x >= 0 and y >= 0 and score > best - drop:
            score += 1.0 if item[x] == doc[y] else -miss
            if score > best:
                best, a = score, x
            x, y = x - 1, y - 1
        reached[j - i] = b
        out.append((a, b, a + j - i, b + j - i))
    return out


def passages(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs that follow each other with at most GAP words between them on both sides, as one span each."""
    out: list[list[int]] = []
    recent: list[list[int]] = []
    for a, b, c, d in sorted(runs, key=lambda r: (r[2], r[0])):
        recent = [p for p in recent if c - p[3] <= GAP]
        into = None
        for p in recent:
            # A run may begin inside the passage, as far as both sides agree about it.
            if p[0] < a and p[1] < b and p[3] < d and a - p[1] <= GAP and p[1] - a < b - a and p[3] - c < d - c and (into is None or p[1] > into[1]):
                into = p
        if into is None:
            into = [a, b, c, d]
            out.append(into)
            recent.append(into)
        else:
            into[1], into[3] = b, d
    return [(p[0], p[1], p[2], p[3]) for p in out]


def share(item: np.ndarray, found: list[tuple[int, int, int, int]], least: int = PASSAGE) -> float:
    """Share of the item's words that the best chain of passages of ``least`` words or more spans, in order. Of
    passages that overlap in the item or in the document the common words count once."""
    n = len(item)
    if not n:
        return 0.0
    long = sorted((p for p in passages(found) if p[1] - p[0] >= min(least, n)), key=lambda p: (p[3], p[1]))
    if not long:
        return 0.0
    # Of the chains that end at each word of the item the best, and where in the document it ends.
    best, ends, at = np.zeros(n + 1), np.full(n + 1, -1), np.arange(n + 1)
    for a, b, c, d in long:
        got = best[:b] + (b - a) - np.maximum(0, np.maximum(at[:b] - a, ends[:b] - c))
        top = max(float(got.max()), float(b - a))
        if top > best[b]:
            best[b], ends[b] = top, d
    return float(best.max()) / n


def leaks(
    docs: DataFrame, items: DataFrame, least_share: float = 0.30, sketch: int = 512, estimate: float = 0.08, words_per_block: int = 2_000_000
) -> DataFrame:
    """(doc_id, item_id, share): documents with copied passages of at least ``least_share`` of an item's words.

    An item of fewer than three words has no shingle and can't leak. Null texts, ids and empty tables give no rows;
    repeated rows of either table count once. Whole texts are read whatever their length."""
    spark = docs.sparkSession
    size = F.size(F.split("item_text", r"\s+"))
    sized = items.filter("item_id is not null and item_text is not null").groupBy("item_id").agg(F.max("item_text").alias("item_text"))
    total = sized.agg(F.sum(size)).first()[0] or 0
    blocks = -(-total // words_per_block)
    out = None
    for k in range(blocks):  # one pass for each block of the query set
        part = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").toArrow()
        held = Items(part.column(0).to_pylist(), item_words(part.column(1).to_pylist()), sketch)
        sent = spark.sparkContext.broadcast(held)
        step = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna()).mapInArrow(_scan(sent, least_share, estimate), "doc_id long, item_id long, share double")
        out = step if out is None else out.unionByName(step)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, share double")
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def _scan(sent, least_share: float, estimate: float):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Items = sent.value
        for b in batches:
            rows: list[tuple[int, int, float]] = []
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            get, runs, starts, n = it.vocab.get, [], [0], 0
            for t in texts:
                w = [get(x, 0) for x in words(t)]
                w += [0] * SHINGLE  # no shingle crosses documents
                runs.append(w)
                n += len(w)
                starts.append(n)
            flat = np.fromiter((x for r in runs for x in r), dtype=np.int64, count=n)
            sh = _shingles(flat)
            lo, hi = np.searchsorted(it.h, sh, "left"), np.searchsorted(it.h, sh, "right")
            cnt = np.where(sh > 0, hi - lo, 0)
            at = np.repeat(np.arange(len(sh)), cnt)
            if not len(at):
                continue
            row = np.repeat(lo, cnt) + np.arange(len(at)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            own, doc = it.owner[row], np.searchsorted(starts, at, "right") - 1
            # Members of a copied passage follow each other on about one diagonal; what stands alone is chance.
            key = doc * len(it.ids) + own  # hits are in order of place in the document, and stay so
            order = np.argsort(key, kind="stable")
            at, key, place = at[order], key[order], it.place[row][order]
            linked = np.zeros(len(at), dtype=bool)
            for k in (1, 2, 3):
                near = (key[k:] == key[:-k]) & (at[k:] - at[:-k] <= PASSAGE) & (np.abs((at[k:] - place[k:]) - (at[:-k] - place[:-k])) <= GAP)
                linked[k:] |= near
                linked[:-k] |= near
            if not linked.any():
                continue
            # Distinct sketch members held: a shingle repeated in the document counts once.
            span = int(it.place.max(initial=0)) + 1
            hit = np.unique(key[linked] * span + place[linked]) // span
            pair, held = np.unique(hit, return_counts=True)
            pair = np.stack([pair // len(it.ids), pair % len(it.ids)], axis=1)
            good = held >= np.maximum(np.minimum(2, it.size[pair[:, 1]]), np.ceil(estimate * it.size[pair[:, 1]]))
            for d, i in pair[good].tolist():
                s, e = starts[d], starts[d + 1] - SHINGLE
                got = share(it.words[i], spans(it.words[i], it.shingles[i], flat[s:e], sh[s : max(s, e - SHINGLE + 1)]))
                if got >= least_share:
                    rows.append((ids[d], it.ids[i], round(got, 6)))
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "share"])

    return run
