"""Files that nobody wrote by hand: generated, minified, data-only and copied from another project.

Evidence comes from Re-Pair grammars first. A file whose grammar over tokens is small against its length reuses
its rules so much that a program wrote it. A file that is mostly literals is data if the grammar over what they
hold hardly shortens it (a blob) or the grammar over its tokens says that they stand in rows (a table). Rules that
a locally consistent grammar also derives in other repositories, weighted by the tokens they span, make a copy,
even one that was reformatted. Only for files about which the grammars say nothing do notices count, in the
comments before the code begins or after it ends, and conventional names and folders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.llm import grammar as G
from loamdex.session import Scratch
from loamdex.sources.files import assemble

CODE = ("py", "js", "ts", "go", "java", "c")
#: Wordings of a tool's notice in English, German, French and Spanish.
_NOTICE = re.compile(
    r"\bgenerated\b|auto-?generated|@generated|machine[- ](?:written|made|generated)|\bdo not (?:edit|modify|touch|change)\b|overwrit|written by \w+\W+do not"
    r"|produced by the \w+ compiler|\bmanual (?:edits?|changes?)\b|changes will be lost|\b(?:erzeugt|generiert)\b|nicht (?:bearbeiten|ändern|editieren)"
    r"|\bproduit par\b|généré|ne pas (?:modifier|éditer)|\b(?:generado|producido)\b|no (?:editar|modificar|tocar)\b",
    re.I,
)
_NOT = re.compile(r"\b(?:not|never|unlike|isn't|no longer|nicht erzeugt|non généré|no generado)\b[^.]*\b(?:generated|erzeugt|généré|generado)|\bunlike\b|edited by hand", re.I)
_NAME = re.compile(r"(?:_pb2|_gen|\.gen|\.g|\.generated|\.min|_generated)\.\w+$|(?:^|/)zz_generated_[^/]*$|[a-z]Stub\.java$")
_VENDOR = re.compile(r"(?:^|/)(?:third[_-]?party|3rd[_-]?party|vendor(?:ed)?|external|externals|extern|deps|contrib/upstream|node_modules|bower_components)/", re.I)
_FOREIGN = re.compile(
    r"^[\s#/*]*(?:package )?([a-z][\w-]+)(?:@|,? release |[ ]v?)\d+\.\d+[\w.]*\b.*(?:copyright|\(c\)|upstream|team|authors|contributors|licen[sc]e|MIT|BSD)", re.I
)
_COMMENT = re.compile(r"^\s*(?:#(?!include)|//|/\*|\*|<!--)")
#: Tokens of a shared rule at least; shorter ones are idioms of a language.
RULE_TOKENS = 10


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


_BEFORE = re.compile(r"^\s*(?:package\b|import\b|from\b.*\bimport\b|using\b|#include\b|['\"]use strict|$)")


def around(text: str) -> tuple[list[str], list[str]]:
    """Comment lines before the code begins (imports and the like don't begin it) and after it has ended, however many."""
    lines = text.splitlines()
    head: list[str] = []
    inside = False
    for x in lines:
        if inside or _COMMENT.match(x) or x.lstrip().startswith(('"""', "'''")):
            head.append(x)
            opened = "/*" in x and "*/" not in x.split("/*")[-1]
            inside = (inside or opened) and "*/" not in x.split("/*")[-1]
        elif not _BEFORE.match(x):
            break
    tail: list[str] = []
    for x in reversed(lines):
        if _COMMENT.match(x) or x.strip().endswith("*/"):
            tail.append(x)
        elif x.strip():
            break
    return head, tail


def notice(comments: list[str], path: str) -> bool:
    """A tool's notice among these comments, or a name that tools give."""
    return _NAME.search(path) is not None or any(_NOTICE.search(x) and not _NOT.search(x) for x in comments)


def own_head(head: list[str], repo: str) -> bool:
    """A copyright of the repository's own organisation."""
    org = repo.split("/")[0].lower()
    return any("copyright" in x.lower() and org in x.lower() for x in head)


def foreign(head: list[str], repo: str, path: str) -> bool:
    """A notice of another project at the head, or a folder for other projects' files, without the own one's copyright."""
    if own_head(head, repo):
        return False
    if any(m and m[1].lower() not in repo.lower() for m in (_FOREIGN.match(x) for x in head)):
        return True
    return bool(_VENDOR.search(path))


#: A grammar over fewer tokens, or over fewer characters of literals, says nothing.
TOKENS, PAYLOAD = 60, 256
#: Grammar size by length and its logarithm under which rules are reused as only a program does; share of a file's
#: characters that literals hold; grammar size by length over which they are near-incompressible.
REUSED, LITERAL, DENSE = 2.4, 0.6, 0.9


def classify(batch: pa.RecordBatch, symbols: G.Symbols) -> pa.RecordBatch:
    repos, paths, texts = (batch.column(i).to_pylist() for i in range(3))
    seq, starts = G.tokens(texts, paths, symbols)
    n = np.diff(starts)
    size = G.repair(G.abstract(seq), starts)
    kind, owner = seq >> 32, np.repeat(np.arange(len(n)), n)
    share = lambda k: np.bincount(owner, weights=kind == k, minlength=len(n)) / np.maximum(n, 1)
    names, literals = share(2), share(3) + share(4)
    reuse = size / np.maximum(n, 1) * np.log2(n + 2)
    h, width, of, _ = G.phrases(seq, starts)
    wide = width >= RULE_TOKENS
    h, width, of = h[wide].view(np.int64), width[wide], of[wide]
    cut = np.searchsorted(of, np.arange(len(n) + 1))
    literal = ["".join(_LITERALS.findall(t)).encode("utf-8", "surrogatepass") for t in texts]
    filled = np.array([len(x) / max(_solid(t), 1) for x, t in zip(literal, texts)])
    some = np.flatnonzero((filled >= LITERAL) & (np.array([len(x) for x in literal]) >= PAYLOAD))
    dense = np.zeros(len(n))
    if len(some):
        ends = np.concatenate([[0], np.cumsum([len(literal[i]) for i in some])])
        held = np.frombuffer(b"".join(literal[i] for i in some), dtype=np.uint8).astype(np.int64)
        dense[some] = G.repair(held, ends) / np.diff(ends)
    reused = (n >= TOKENS) & (reuse < REUSED)
    why, own, by = [], [], []
    for i, (repo, path, text) in enumerate(zip(repos, paths, texts)):
        lines = text.splitlines()
        head, tail = around(text)
        own.append(own_head(head, repo))
        other_language = text.lstrip()[:1] in ("{", "<") and not path.endswith(".c")
        found, how = None, "grammar"
        if dense[i] and (dense[i] >= DENSE or reuse[i] < REUSED) and not other_language:
            found = "data"
        elif reused[i] and names[i] < 0.06 and literals[i] >= 0.3 and not other_language:
            found = "data"
        elif max(map(len, lines), default=0) >= 200 and n[i] >= TOKENS and _squeezed(text, lines):
            found, how = "minified", "layout"
        elif reused[i] and names[i] >= 0.1:
            found = "generated"
        elif notice([*head, *tail], path):
            found, how = "generated", "notice"
        elif foreign(head, repo, path):
            found, how = "vendored", "notice"
        why.append(found)
        by.append(how if found else None)
    phr = [h[cut[i] : cut[i + 1]] for i in range(len(n))]
    wid = [width[cut[i] : cut[i + 1]].astype(np.int32) for i in range(len(n))]
    return pa.RecordBatch.from_pydict({
        "repo": batch.column(0), "file_path": batch.column(1), "why": pa.array(why, pa.string()), "n_tokens": pa.array(n.astype(np.int32)),
        "reuse": pa.array(np.round(reuse, 6)), "rules": pa.array(phr, pa.list_(pa.int64())), "widths": pa.array(wid, pa.list_(pa.int32())),
        "own": pa.array(own, pa.bool_()), "by": pa.array(by, pa.string()),
    })


_LITERALS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\b(?:0x)?[\da-fA-F]*\d[\da-fA-F.]*\b")
_WORDS = re.compile(r"[^\W\d]\w*")


def _solid(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n") - text.count("\r") - text.count("\t")


def _squeezed(text: str, lines: list[str]) -> bool:
    """Long lines of very short names with hardly a space: what a minifier leaves."""
    long = [x for x in lines if len(x) >= 200]
    body = "".join(long)
    if len(body) < 0.6 * len(text):
        return False
    words = _WORDS.findall(body)
    return bool(words) and sum(map(len, words)) / len(words) < 4.5 and body.count(" ") < 0.12 * len(body)


def provenance(chunks: DataFrame, shared: float = 0.6) -> DataFrame:
    """(repo, file_path, why, by, reuse, shared): every code file with what it is: ``generated``, ``minified``,
    ``data``, ``vendored`` or null for hand-written, whatever the chunks' category says, and by which evidence:
    ``grammar``, ``layout`` or, where those say nothing, ``notice`` (words in comments, names and folders).

    ``shared`` is the share of a file's rule tokens that other repositories have too; files at or over the
    parameter are copies unless they bear their own organisation's copyright. Copies within a repository don't
    count. Empty files and files of other extensions are hand-written or left out; an empty table gives none."""
    scratch = Scratch(chunks.sparkSession)
    text = assemble(chunks, extension("file_path").isin(*CODE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = G.Symbols()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                yield classify(b.slice(i, 500), symbols)

    schema = "repo string, file_path string, why string, n_tokens int, reuse double, rules array<long>, widths array<int>, own boolean, by string"
    seen = scratch.keep(text.mapInArrow(run, schema))
    each = seen.select("repo", "file_path", F.explode(F.arrays_zip("rules", "widths")).alias("r")).select("repo", "file_path", F.col("r.rules").alias("rule"), F.col("r.widths").alias("w"))
    # One row a rule and task leaves the partial aggregate, however many files hold the rule.
    rules = each.groupBy("rule").agg(F.min("repo").alias("a"), F.max("repo").alias("z")).filter("a <> z").select("rule")
    total = seen.select("repo", "file_path", "why", "by", "reuse", "own", F.aggregate("widths", F.lit(0), lambda s, w: s + w).alias("all"))
    hit = each.join(rules, "rule").groupBy("repo", "file_path").agg(F.sum("w").alias("hit"))
    out = total.join(hit, ["repo", "file_path"], "left").withColumn("shared", F.coalesce(F.col("hit") / F.col("all"), F.lit(0.0)))
    copied = (F.col("shared") >= shared) & ~F.col("own") & (F.col("all") >= 30)
    copied = copied & (F.col("why").isNull() | (F.col("by") == "notice"))
    return out.select(
        "repo", "file_path", F.when(copied, "vendored").otherwise(F.col("why")).alias("why"), F.when(copied, "grammar").otherwise(F.col("by")).alias("by"), "reuse", F.round("shared", 6).alias("shared")
    )
