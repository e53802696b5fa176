"""Reading source trees, index tables and evaluation files."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions import text as T

MAX_FILE_MB = 1.5


def is_url(spec: str) -> bool:
    return re.match(r"^(?:https?://|git@|ssh://|git://)", spec) is not None


def repo_name(spec: str) -> str:
    """Last path segment without slashes and ``.git``, then what follows the last colon."""
    name = spec.rstrip("/").rsplit("/", 1)[-1]
    return name.removesuffix(".git").rsplit(":", 1)[-1]


def ignore_rules(text: str) -> list[tuple[re.Pattern, bool]]:
    """Patterns of an ignore file as (expression, negated); folders match with all they hold."""
    out = []
    for line in text.splitlines():
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        neg, p = p.startswith("!"), p.lstrip("!")
        p = p.rstrip("/")
        body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, x if x.startswith("[") else re.escape(x)) for x in re.findall(r"\*\*|\*|\?|\[[^\]]+\]|[^*?\[]+|\[", p.lstrip("/")))
        head = "" if "/" in p else "(?:.*/)?"
        out.append((re.compile(rf"^{head}{body}(?:/.*)?$"), neg))
    return out


def ignored(path: str, rules: list[tuple[re.Pattern, bool]]) -> bool:
    hit = False
    for rx, neg in rules:
        if rx.match(path):
            hit = not neg
    return hit


def scan(spark: SparkSession, root: str, max_file_mb: float = MAX_FILE_MB) -> DataFrame:
    """(path, text, length, blob_sha, language, category) of a tree that all executors can read: without ``.git``,
    what the root's .gitignore names, files over the size limit and files with a NUL in their first 8,192 bytes.

    The built-in file sources hide names that start with a dot or an underscore, which a source tree needs, so the
    names are listed here, as a file index would, and the files are read by the tasks. Undecodable bytes become
    U+FFFD and line ends LF; the digest is that of the bytes."""
    base = os.path.abspath(root)
    rules: list[tuple[re.Pattern, bool]] = []
    at = os.path.join(base, ".gitignore")
    if os.path.exists(at):
        with open(at, encoding="utf-8", errors="replace") as f:
            rules = ignore_rules(f.read())
    names = []
    for here, dirs, found in os.walk(base):
        dirs[:] = sorted(d for d in dirs if d != ".git")
        names += [os.path.relpath(os.path.join(here, n), base).replace(os.sep, "/") for n in found]
    names = sorted(n for n in names if not ignored(n, rules))
    most = int(max_file_mb * 1024 * 1024)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n in b["path"]:
                full = os.path.join(base, n)
                if not os.path.isfile(full) or os.path.getsize(full) > most:
                    continue
                with open(full, "rb") as f:
                    raw = f.read()
                if b"\0" not in raw[:8192]:
                    rows.append((n, raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"), len(raw), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "text", "length", "blob_sha"])

    parts = max(spark.sparkContext.defaultParallelism, len(names) // 2_000)
    listed = spark.createDataFrame([(n,) for n in names], "path string").repartition(parts)
    rows = listed.mapInPandas(read, "path string, text string, length long, blob_sha string")
    return rows.withColumns({"language": T.language(F.col("path")), "category": T.category(F.col("path"))})


def assemble(chunks: DataFrame, keep: Column | None = None) -> DataFrame:
    """(repo, file_path, text): the content of a file's distinct chunks in order of start_byte.

    Rows with a null repo, file_path, content or start_byte are left out, and redelivered rows count once. Only
    the chunks of one file ever meet in a group."""
    rows = chunks.select("repo", "file_path", "start_byte", "content").dropna()
    rows = rows if keep is None else rows.filter(keep)
    one = rows.groupBy("repo", "file_path").agg(F.array_sort(F.collect_set(F.struct("start_byte", "content"))).alias("c"))
    return one.select("repo", "file_path", F.array_join(F.transform("c", lambda x: x["content"]), "").alias("text"))


def eval_queries(paths: list[str]) -> list[dict]:
    """Evaluation queries of JSON-lines files, each path once, all read; a row without a non-empty query or with
    expected_files that aren't strings is an error that names file and line."""
    out = []
    for path in dict.fromkeys(os.path.abspath(p) for p in paths if os.path.exists(p)):
        with open(path, encoding="utf-8") as f:
            for n, line in enumerate(f, 1):
                if not line.strip():
                    continue
                try:
                    row = json.loads(line)
                    ok = isinstance(row["query"], str) and row["query"].strip() and all(isinstance(x, str) for x in row["expected_files"])
                except (ValueError, KeyError, TypeError):
                    ok = False
                if not ok:
                    raise ValueError(f"{path}:{n}: needs a query and a list of expected_files")
                out.append(row)
    return out
