"""Inverted index and lexical search."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loamdex.functions import text as T
from loamdex.session import spread


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tag: Column | None = None, stem: bool = False) -> DataFrame:
    """(term, id, tf, positions, dl, tag): the inverted index. A document's terms are counted where it is read, so
    nothing is shuffled; ``dl`` is its length and ``tag`` what searches may filter by. Documents without a term
    have no row; :func:`lengths` counts them."""
    base = spread(docs.select(F.col(id_col).alias("id"), F.col(text), (tag if tag is not None else F.lit(None).cast("string")).alias("tag"))).filter(F.col(text).isNotNull())
    base = base.select("id", "tag", T.tokens(text).alias("t"))
    if stem:
        base = base.withColumn("t", stem_tokens("t"))
    kind = dict(base.dtypes)["id"]
    return base.select("id", "tag", "t").mapInArrow(_invert, f"term string, id {kind}, tf long, positions array<int>, dl int, tag string")


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the documents of a batch: their tokens sorted by (document, term), each pair one row."""
    for b in batches:
        t = b.column("t")
        n = t.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = t.flatten().dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        pos = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        key = doc * max(len(words.dictionary), 1) + code
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        offsets = np.append(first, len(key)).astype(np.int32)
        own = doc[order[first]]
        yield pa.RecordBatch.from_arrays(
            [words.dictionary.take(pa.array(code[order[first]])), b.column("id").take(pa.array(own)), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(pos[order])),
             pa.array(n[own].astype(np.int32)), b.column("tag").take(pa.array(own))],
            names=["term", "id", "tf", "positions", "dl", "tag"],
        )


def lengths(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(n, avgdl): one row of corpus statistics; a null text is a document of length 0."""
    dl = F.coalesce(F.size(T.tokens(text)), F.lit(0))
    return docs.select(F.greatest(dl, F.lit(0)).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def phrases(query: str) -> list[list[str]]:
    """White-space pieces of a query as phrases of folded tokens; a piece of several tokens must occur adjacently. A
    piece that occurs twice counts twice."""
    a, b = T._accents()
    low = query.lower().translate(str.maketrans(a, b))
    out = [tuple(re.findall(r"[^\W_]+", p)) for p in low.split()]
    return [p for p in out if p]


def query_terms(query: str, stem: bool = False) -> list[str]:
    """Distinct terms of a query: the keys of the postings that it needs."""
    return sorted({porter(w) if stem else w for p in phrases(query) for w in p})


def search(held: DataFrame, stats: DataFrame, query: str, k: int = 50, tags: list[str] | None = None, stem: bool = False) -> DataFrame:
    """(id, score, rank): the k best by BM25; lower scores are better, as in the index this replaces.

    ``held`` are the postings of :func:`query_terms`, ``stats`` the row of :func:`lengths`. Corpus statistics count the
    whole table while ``tags`` only filter what is ranked. A term that more than half of the documents hold has its
    idf clamped to 1e-6. Ties go to the smaller id. Without a usable term, nothing."""
    parts = [tuple(porter(w) for w in p) if stem else p for p in phrases(query)]
    times = Counter(parts)
    terms = sorted({w for p in parts for w in p})
    if not terms:
        return held.select("id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    at = {t: f"p{i}" for i, t in enumerate(terms)}
    none = F.array().cast("array<int>")
    # One row a document: of every term of the query its positions.
    docs = held.filter(F.col("term").isin(terms)).groupBy("id").agg(
        F.max("dl").alias("dl"), F.max("tag").alias("tag"), *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("positions"))), none).alias(c) for t, c in at.items()]
    )

    def shifted(w: str, j: int) -> Column:
        return F.transform(at[w], lambda x: x - j)

    def tf(p: tuple[str, ...]) -> Column:
        starts = F.col(at[p[0]])
        for j, w in enumerate(p[1:], 1):
            starts = F.array_intersect(starts, shifted(w, j))
        return F.size(starts)

    counted = docs.select("id", "dl", "tag", *[tf(p).alias(f"f{i}") for i, p in enumerate(times)])
    df = counted.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(times))])
    score = F.lit(0.0)
    for i, m in enumerate(times.values()):
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = F.col(f"f{i}")
        score = score - F.when(f > 0, m * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    some = F.greatest(*[F.col(f"f{i}") for i in range(len(times))], F.lit(0)) > 0
    if tags is not None:
        some = some & F.coalesce(F.col("tag").isin(tags), F.lit(False))
    one = F.broadcast(df.crossJoin(stats))  # one row by one row
    return top(counted.filter(some).crossJoin(one).select("id", F.round(score, 9).alias("score")), k, ascending=True)


def bm25(docs: DataFrame, query: str, k: int = 50, id_col: str = "doc_id", text: str = "text", tag: Column | None = None, tags: list[str] | None = None, stem: bool = False) -> DataFrame:
    """:func:`search` over texts that have no index: one pass makes the postings of the query's terms only."""
    held = postings(docs, id_col, text, tag, stem).filter(F.col("term").isin(query_terms(query, stem)))
    return search(held, lengths(docs, id_col, text), query, k, tags, stem)


def top(scored: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The k best rows (id, score) with their rank; TakeOrdered keeps k rows a task, so the window sees k rows."""
    key = F.asc("score") if ascending else F.desc("score")
    best = scored.orderBy(key, "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(key, "id")))


def trigram_index(chunks: DataFrame, id_col: str = "id", text: str = "content") -> DataFrame:
    """(trigram, id, symbol, occurrences). Symbols are counted per chunk before their trigrams are made."""
    per = spread(chunks.select(F.col(id_col), text)).select(F.col(id_col).alias("id"), F.explode(T.identifiers(text)).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))
    per = per.select("id", "n", F.explode(T.identifier_parts(F.col("token"))).alias("symbol")).groupBy("id", "symbol").agg(F.sum("n").alias("occurrences"))
    return per.select(F.explode(T.trigrams(F.col("symbol"))).alias("trigram"), "id", "symbol", "occurrences")


def query_trigrams(query: str) -> list[str]:
    """Distinct trigrams of a query: the keys of the trigram rows that it needs."""
    p = f"  {query.lower()} "
    return sorted({p[i : i + 3] for i in range(len(p) - 2)}) if query.strip() else []


def trigram_search(held: DataFrame, query: str, k: int = 50) -> DataFrame:
    """The k chunks with the most occurrences of symbols over the query's trigrams, of the rows of those trigrams."""
    hits = held.filter(F.col("trigram").isin(query_trigrams(query))).groupBy("id").agg(F.sum("occurrences").cast("double").alias("score"))
    return top(hits, k)


def symbol_search(nodes: DataFrame, symbol: str, k: int = 50, allowed: DataFrame | None = None) -> DataFrame:
    """Chunks of non-block nodes of that name or short name; score is k minus the position in order of id. With
    ``allowed`` (id), only those chunks."""
    hit = nodes.filter((F.col("kind") != "block") & F.col("chunk_id").isNotNull() & ((F.col("short_name") == symbol) | (F.col("name") == symbol)))
    hit = hit.select(F.col("chunk_id").alias("id")).distinct()
    if allowed is not None:
        hit = hit.join(allowed.select("id").distinct(), "id", "left_semi")
    ranked = hit.orderBy("id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("id")))
    return ranked.select("id", (F.lit(k) - F.col("rank") + 1).cast("double").alias("score"), "rank")


_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(w: str) -> str:
    """Porter's suffix stripping (1980)."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w

    def shape(s: str) -> str:
        out = ""
        for i, c in enumerate(s):
            v = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
            out += "v" if v else "c"
        return out

    def m(s: str) -> int:
        return len(re.findall("v+c+", shape(s)))

    def vowel(s: str) -> bool:
        return "v" in shape(s)

    def double(s: str) -> bool:
        return len(s) > 1 and s[-1] == s[-2] and shape(s)[-1] == "c"

    def cvc(s: str) -> bool:
        return shape(s)[-3:] == "cvc" and s[-1] not in "wxy"

    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for suf in ("ed", "ing"):
            if w.endswith(suf) and vowel(w[: -len(suf)]):
                w = w[: -len(suf)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suf, rep in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(suf):
                w = w[: -len(suf)] + rep if m(w[: -len(suf)]) > 0 else w
                break
    for suf in sorted((*_STEP4, "ion"), key=lambda x: -len(x)):
        if w.endswith(suf):
            s = w[: -len(suf)]
            if m(s) > 1 and (suf != "ion" or s[-1:] in ("s", "t")):
                w = s
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or m(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if m(w) > 1 and double(w) and w[-1] == "l":
        w = w[:-1]
    return w


@F.pandas_udf(ArrayType(StringType()))
def _stem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for s in batches:
        out = []
        for row in s:
            if row is None:
                out.append(None)
                continue
            for t in row:
                if t not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[t] = porter(t)
            out.append([known[t] if t in known else porter(t) for t in row])
        yield pd.Series(out)


def stem_tokens(c: str) -> Column:
    return _stem(F.col(c))
