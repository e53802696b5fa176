"""Vector expressions and exact nearest neighbours of one query vector."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.operators.lexical import top


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def normalise(a: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda v: v.cast("double") / F.when(n > 0, n).otherwise(1.0))


def quantise(a: Column | str) -> Column:
    """Unit vector times 127, rounded half to even, as bytes."""
    return F.transform(normalise(a), lambda v: F.least(F.greatest(F.rint(v * 127.0), F.lit(-127.0)), F.lit(127.0)).cast("tinyint"))


def dequantise(a: Column | str) -> Column:
    return F.transform(a, lambda v: v.cast("double") / 127.0)


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", emb: str = "embedding", keep: Column | None = None) -> DataFrame:
    """(id, score, rank): the k nearest by cosine; ``keep`` is applied before ranking, so k rows come if there are k."""
    rows = vectors if keep is None else vectors.filter(keep)
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(rows.select(F.col(id_col).alias("id"), F.round(cosine(emb, q), 9).alias("score")), k)


def knn_overfetch(vectors: DataFrame, query: list[float], k: int, keep: Column | str, factor: int = 6, id_col: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """The k nearest after filtering factor * k unfiltered neighbours; may return fewer than k."""
    near = knn(vectors, query, factor * k, id_col, emb)
    ok = near.join(vectors.filter(keep).select(F.col(id_col).alias("id")), "id", "left_semi")
    return top(ok.select("id", "score"), k)


def centroids(vectors: DataFrame, group: str, emb: str = "embedding") -> DataFrame:
    """(group, centroid, size): normalised mean per group, averaged by position with partial aggregation."""
    each = vectors.select(group, F.posexplode(emb).alias("i", "v")).groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    out = each.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"), F.max("n").alias("size"))
    return out.select(group, normalise(F.transform("c", lambda x: x["m"])).alias("centroid"), "size")


def stub_embed(texts: DataFrame, key: str, text: str, dim: int = 1536) -> DataFrame:
    """(key, embedding): repeatable unit vectors seeded by the text's digest, standing in for a model; each distinct
    text of a batch is embedded once. A model is plugged in by another function of the same form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made: dict[str, np.ndarray] = {}
            for t in b[text]:
                if t not in made:
                    seed = int.from_bytes(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:8], "big")
                    v = np.random.default_rng(seed).standard_normal(dim)
                    made[t] = (v / np.linalg.norm(v)).astype(np.float32)
            yield pd.DataFrame({key: b[key], "embedding": [made[t] for t in b[text]]})

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).dropna().mapInPandas(run, f"{key} {kind}, embedding array<float>")


#: Centroids that are sent to every task at a time; more are taken in turns of one pass each.
CENTROIDS = 20_000


def nearest_centroid(vectors: DataFrame, centroids_: DataFrame, id_col: str, emb: str = "embedding", cid: str = "cluster_id", centroid: str = "centroid") -> DataFrame:
    """(id, nearest, dot): for every vector the centroid of largest dot product rounded to 9 decimals, ties going to the
    smaller id. Vectors stay where they are: centroids come to the tasks in blocks of a fixed number, as one matrix
    each. Null vectors and centroids, and those of another length than the first centroid, are left out."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    rows = centroids_.select(F.col(cid).cast("long").alias("c"), F.col(centroid).cast("array<double>").alias("v")).filter("c is not null and v is not null")
    n = rows.count()
    schema = f"id {kind}, nearest long, dot double"
    out = None
    for k in range(-(-n // CENTROIDS)):
        held = rows.filter(F.pmod(F.xxhash64("c"), F.lit(-(-n // CENTROIDS))) == k).toArrow()
        if not held.num_rows:
            continue
        c = held.column("c").to_numpy()
        v = held.column("v").to_pylist()
        keep = [i for i, x in enumerate(v) if len(x) == len(v[0]) and None not in x]
        order = np.argsort(c[keep], kind="stable")
        sent = spark.sparkContext.broadcast((c[keep][order], np.array([v[i] for i in keep])[order]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, m = sent.value
            for b in batches:
                e = b.column("e")
                ok = np.flatnonzero(e.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == m.shape[1])
                e = e.take(pa.array(ok))
                x = np.asarray(e.flatten().fill_null(np.nan)).reshape(-1, m.shape[1])
                whole = ~np.isnan(x).any(axis=1)
                ok, x = ok[whole], x[whole]
                dot_ = np.round(x @ m.T, 9)
                at = dot_.argmax(axis=1) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ok)), pa.array(ids[at]), pa.array(dot_[np.arange(len(at)), at])], names=["id", "nearest", "dot"])

        part = vectors.select(F.col(id_col).alias("id"), F.col(emb).cast("array<double>").alias("e")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    if n <= CENTROIDS:
        return out
    return out.groupBy("id").agg(F.max(F.struct("dot", (-F.col("nearest")).alias("m"))).alias("b")).select("id", (-F.col("b.m")).alias("nearest"), F.col("b.dot").alias("dot"))
