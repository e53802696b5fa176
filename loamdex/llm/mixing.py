"""Mixing sources to target weights, in tokens of a public tokenizer.

Weights come from explicit shares or from temperature mixing (source token shares raised to an exponent that
is bisected to a target entropy). At a budget that the repetition caps don't allow, the weights are tilted
from the targets towards the natural shares by the smallest bisected exponent that keeps every cap. The
weights are realised as block permutations: whole passes over a source, and for the rest a prefix of its
documents in an order by hash, found block by block, so no source is ever sorted in one task.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.session import Scratch, spread

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-tokenising pattern that belongs to the 50,257-entry byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DOCS_PER_BLOCK = 2_000
_loaded: dict[str, object] = {}


def tokenizer(path: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):  # noqa: ANN201
    """The byte-level tokenizer of ``path``, loaded once a process."""
    import tiktoken

    at = os.path.join(path, name)
    if at not in _loaded:
        with open(at, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[at] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[at]


def with_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", path: str = TOKENIZERS) -> DataFrame:
    """Adds the number of tokens of ``text`` (0 for null) to (doc_id, source)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", out])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", text)).mapInArrow(count, f"doc_id long, source string, {out} long")


def temperature_weights(tokens: dict[str, float], entropy: float) -> tuple[dict[str, float], float]:
    """Token shares raised to the exponent whose normalised weights have ``entropy`` (nats), and the exponent.

    Exponent 1 gives the natural shares, 0 equal ones; an entropy out of reach gives the nearest end (0 or 64)."""
    live = {k: v for k, v in tokens.items() if v > 0}

    def at(x: float) -> dict[str, float]:
        top = max(math.log(v) for v in live.values())
        w = {k: math.exp(x * (math.log(v) - top)) for k, v in live.items()}
        s = sum(w.values())
        return {k: v / s for k, v in w.items()}

    if not live:
        return {}, 1.0
    lo, hi = 0.0, 64.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if -sum(w * math.log(w) for w in at(mid).values() if w > 0) > entropy:
            lo = mid
        else:
            hi = mid
    return at(hi), hi


def plan(tokens: dict[str, int], target: dict[str, float], repeats: dict[str, int], budget: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weights, budget, exponent). Without a budget: the targets and the largest budget that every cap allows.

    With one: weights proportional to target^x * natural^(1-x) with the largest x in [0, 1] that keeps
    weight * budget <= repeats * tokens everywhere; if even x = 0 breaks a cap, the budget is lowered to what
    natural shares allow. Sources without tokens or with a target of 0 get nothing."""
    live = [s for s in target if target[s] > 0 and tokens.get(s, 0) > 0 and repeats.get(s, 1) > 0]
    if not live:
        return {}, 0.0, 1.0
    t, n = sum(target[s] for s in live), sum(tokens[s] for s in live)

    def at(x: float) -> dict[str, float]:
        w = {s: (target[s] / t) ** x * (tokens[s] / n) ** (1 - x) for s in live}
        k = sum(w.values())
        return {s: v / k for s, v in w.items()}

    most = lambda w: min(repeats.get(s, 1) * tokens[s] / w[s] for s in live)
    if budget is None or budget <= most(at(1.0)):
        w = at(1.0)
        return w, most(w) if budget is None else budget, 1.0
    if budget > most(at(0.0)):
        return at(0.0), most(at(0.0)), 0.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if budget <= most(at(mid)) else (lo, mid)
    return at(lo), budget, lo


def mix(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 11, path: str = TOKENIZERS, entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, source, n_tokens, uses) for documents used at least once, and per source of
    ``targets`` (source, target_share, max_repeats, n_docs, tokens, tokens_used, share, most_uses).

    Documents with a null doc_id, a null source or one without a target, or without tokens are not used. A
    source's budget is kept to within one document. Repeated rows of targets give the one with the largest
    share; an empty documents table gives shares of 0. ``targets`` is one row a source and is read to the
    driver, with the token sums per source; nothing per document is.

    With ``entropy``, the shares aimed at are those of :func:`temperature_weights` over the sources that have a target
    over 0 and may be used, instead of the target shares; caps and budget hold as before."""
    scratch = Scratch(docs.sparkSession)
    goal = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] if r["max_repeats"] is not None else 1) for r in targets.orderBy("target_share").collect() if r["source"] is not None}
    counted = scratch.keep(with_tokens(docs.filter("doc_id is not null and source is not null"), path=path).filter("n_tokens > 0").filter(F.col("source").isin(list(goal)) if goal else F.lit(False)))
    sums = {r["source"]: (r["t"], r["n"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    tokens, aim = {s: v[0] for s, v in sums.items()}, {s: g[0] for s, g in goal.items()}
    if entropy is not None:
        aim, _ = temperature_weights({s: t for s, t in tokens.items() if goal[s][0] > 0 and goal[s][1] > 0}, entropy)
    weights, total, _ = plan(tokens, aim, {s: g[1] for s, g in goal.items()}, budget)
    rows = []
    for s, (t, n) in sums.items():
        b = weights.get(s, 0.0) * total
        passes = min(int(b // t), goal[s][1])
        rows.append((s, passes, int(round(b - passes * t)) if passes < goal[s][1] else 0, max(1, -(-n // DOCS_PER_BLOCK))))
    spark = docs.sparkSession
    todo = F.broadcast(spark.createDataFrame(rows, "source string, passes int, rest long, blocks int"))  # one row a source
    h = F.xxhash64(F.lit(seed), "doc_id")
    laid = counted.join(todo, "source").withColumn("h", h).withColumn("block", F.pmod(h, F.col("blocks")))
    per = laid.groupBy("source", "block").agg(F.sum("n_tokens").alias("bt"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("block")
    per = per.withColumn("before", F.sum("bt").over(order) - F.col("bt")).select("source", "block", "before", "bt")
    cut = laid.join(per, ["source", "block"])
    within = Window.partitionBy("source", "block").orderBy("h", "doc_id")
    last = cut.filter("before < rest and before + bt > rest").withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
    # The document that crosses the budget is used if more than half of it lies within.
    last = last.withColumn("more", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).select("doc_id", "source", "n_tokens", "passes", "more")
    whole = cut.filter("not (before < rest and before + bt > rest)").withColumn("more", (F.col("before") + F.col("bt") <= F.col("rest")).cast("int")).select("doc_id", "source", "n_tokens", "passes", "more")
    used = whole.unionByName(last).select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("more")).alias("uses")).filter("uses > 0")
    got = used.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses"))
    all_ = got.agg(F.sum("tokens_used").alias("all"))
    want = spark.createDataFrame([(s, float(g[0]), int(g[1])) for s, g in goal.items()], "source string, target_share double, max_repeats int")
    share = want.join(got, "source", "left").crossJoin(F.broadcast(all_)).select(
        "source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "tokens", "tokens_used")],
        F.coalesce(F.round(F.col("tokens_used") / F.col("all"), 6), F.lit(0.0)).alias("share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    return used, share
