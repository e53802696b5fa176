"""Queries of the lexical, vector, fusion and analytics operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import analytics, density, fusion, graph, incremental, lexical, vector
from loamdex.operators import changes as C
from loamdex.plans.indexes import CONTEXT, PRIMARY, RETRIEVABLE, Index


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


QUERIES = {}
SQL = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TOK = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
_DOCS = f"t AS (SELECT doc_id AS id, lang, {_TOK} AS t FROM documents)"


_CHUNKS = rf"""c0 AS (SELECT * FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) = 1),
cc AS (SELECT id, repo, file_path, kind, name, start_line, end_line, content, content_hash, lower(category) AS lang FROM c0), t AS (SELECT id, lang, {_TOK.replace('text', 'content')} AS t FROM cc)"""


def _bm25_sql(terms: list[list[str]], k: int, keep: str = "true", docs: str = _DOCS) -> str:
    def tf(p: list[str]) -> str:
        if len(p) == 1:
            return f"len(list_filter(t, lambda x: x = '{p[0]}'))"
        same = " AND ".join(f"t[i + {j}] = '{w}'" for j, w in enumerate(p))
        return f"len(list_filter(range(1, len(t) + 1), lambda i: {same}))"

    fs = ", ".join(f"{tf(p)} AS f{i}" for i, p in enumerate(terms))
    ns = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END"
    s = " - ".join(f"CASE WHEN f{i} > 0 THEN ({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""WITH {docs}, c AS (SELECT id, lang, len(t) AS dl, {fs} FROM t), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {ns} FROM c)
SELECT id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score, id) AS rank FROM (SELECT id, round(CAST(0 - {s} AS DOUBLE), 9) AS score FROM c, s WHERE ({some}) AND {keep})) WHERE rank <= {k}"""


@query(f"WITH {_DOCS} SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM t) GROUP BY ALL")
def token_postings(spark: SparkSession, d: str) -> DataFrame:
    return Index(spark, d, "documents").read("postings").select("term", "id", "tf")


@query(f"WITH {_DOCS} SELECT id, len(t) AS dl FROM t")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(T.tokens("text")).cast("long").alias("dl"))


@query(_bm25_sql([["cache"], ["nightly"], ["ledger"]], 50))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return Index(spark, d, "documents").bm25("cache nightly ledger")


@query(_bm25_sql([["cache"], ["cache"], ["ledger"]], 50))
def bm25_repeated(spark: SparkSession, d: str) -> DataFrame:
    return Index(spark, d, "documents").bm25("cache cache ledger")


@query(_bm25_sql([["port"], ["index"]], 20, "lang = 'de'"))
def bm25_category(spark: SparkSession, d: str) -> DataFrame:
    return Index(spark, d, "documents").bm25("port index", 20, ["de"])


@query(_bm25_sql([["nightly", "job"], ["api"]], 50))
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    return Index(spark, d, "documents").bm25("nightly_job api")


@query()
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return Index(spark, d, "documents").bm25("caches measuring", stem=True)


# A run of capitals ends before a capital that a small letter follows.
_CAMEL = r"regexp_extract_all(regexp_replace(token, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+[0-9]*|[A-Z]+|[0-9]+')"
_SPLIT = f"list_filter(list_distinct(list_concat([token], string_split_regex(token, '_+'), {_CAMEL})), lambda p: length(p) >= 2 AND replace(p, '_', '') <> '')"
_SYMBOLS = f"""o AS (SELECT id, token, count(*) AS n FROM cc, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]+')) AS u(token) GROUP BY ALL),
y AS (SELECT id, symbol, CAST(sum(n) AS BIGINT) AS occurrences FROM (SELECT id, n, unnest({_SPLIT}) AS symbol FROM o) GROUP BY ALL),
g AS (SELECT trigram, id, symbol, occurrences FROM (SELECT id, symbol, occurrences, unnest(list_distinct(list_transform(range(1, length(symbol) + 2), lambda i: substr('  ' || lower(symbol) || ' ', i, 3)))) AS trigram FROM y))"""
_GRAMS = "list_transform(range(1, 14), lambda i: substr('  parse_header ', i, 3))"


@query("SELECT id, token, count(*) AS n FROM (SELECT DISTINCT id, content FROM chunks), unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]+')) AS u(token) GROUP BY ALL")
def identifier_extract(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "chunks").select("id", "content").distinct()
    return c.select("id", F.explode(T.identifiers("content")).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))


@query(f"SELECT short_name, unnest({_SPLIT.replace('token', 'short_name')}) AS part FROM (SELECT DISTINCT short_name FROM nodes)")
def identifier_split(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nodes").select("short_name").distinct()
    return n.select("short_name", F.explode(T.identifier_parts(F.col("short_name"))).alias("part"))


@query(
    """SELECT DISTINCT short_name, substr('  ' || lower(short_name) || ' ', i, 3) AS trigram
FROM (SELECT DISTINCT short_name FROM nodes WHERE trim(short_name) <> ''), unnest(range(1, length(short_name) + 2)) AS u(i)"""
)
def symbol_trigrams(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nodes").select("short_name").distinct()
    return n.select("short_name", F.explode(T.trigrams(F.col("short_name"))).alias("trigram"))


@query(f"WITH {_CHUNKS}, {_SYMBOLS} SELECT trigram, id, symbol, occurrences FROM g")
def trigram_index(spark: SparkSession, d: str) -> DataFrame:
    return Index(spark, d, "chunks").read("trigrams")


_TRI = f"SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM (SELECT id, CAST(sum(occurrences) AS DOUBLE) AS score FROM g WHERE list_contains({_GRAMS}, trigram) GROUP BY id) QUALIFY rank <= 50"


@query(f"WITH {_CHUNKS}, {_SYMBOLS} {_TRI}")
def trigram_topk(spark: SparkSession, d: str) -> DataFrame:
    held = Index(spark, d, "chunks").read("trigrams", lexical.query_trigrams("parse_header"))
    return lexical.trigram_search(held, "parse_header")


@query(
    """SELECT id, CAST(50 - rank + 1 AS DOUBLE) AS score, CAST(rank AS INT) AS rank FROM (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM
(SELECT DISTINCT chunk_id AS id FROM nodes WHERE kind <> 'block' AND chunk_id IS NOT NULL AND (short_name = (SELECT min(short_name) FROM nodes WHERE kind = 'function' AND chunk_id IS NOT NULL)))) WHERE rank <= 50"""
)
def symbol_exact(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nodes")
    first = n.filter("kind = 'function' and chunk_id is not null").agg(F.min("short_name")).first()[0]  # one name
    return lexical.symbol_search(n, first or "")


@query(
    r"""SELECT q, CASE WHEN t = '' THEN 'full' WHEN lower(t) LIKE 'regex:%' THEN 'fast' WHEN regexp_full_match(t, '(?i:find |where is )\s*[A-Za-z_][A-Za-z0-9_]*') THEN 'fast'
WHEN regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_]*') THEN 'fast' WHEN regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_]*(\s+[A-Za-z_][A-Za-z0-9_]*){1,2}') THEN 'fast' ELSE 'full' END AS lane
FROM (SELECT q, trim(q) AS t FROM (SELECT item_text AS q FROM eval_items UNION SELECT short_name FROM nodes UNION SELECT 'find ' || short_name FROM nodes UNION SELECT signature FROM nodes WHERE signature IS NOT NULL))"""
)
def route_queries(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nodes")
    q = _t(spark, d, "eval_items").select(F.col("item_text").alias("q")).union(n.select("short_name")).union(n.select(F.concat(F.lit("find "), "short_name"))).union(n.filter("signature is not null").select("signature"))
    q = q.distinct()
    return q.select("q", T.route(F.col("q")).alias("lane"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.preview("text").alias("preview"))


def _two(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    docs = _t(spark, d, "documents")
    order = lambda *c: docs.orderBy(*c).limit(30).select(F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy(*c)).alias("rank"))
    return [("long", order(F.desc(F.length("text")), F.col("doc_id"))), ("new", order(F.desc("created_at"), F.col("doc_id"))), ("bm25", Index(spark, d, "documents").bm25("cache nightly ledger", 30))]


_BM = _bm25_sql([["cache"], ["nightly"], ["ledger"]], 30).replace("WITH ", "", 1)
_TWO = f"""a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 30),
b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, doc_id) AS rank FROM documents QUALIFY rank <= 30), m AS (WITH {_BM})"""


def _rrf_sql(w: tuple[float, float, float]) -> str:
    return f"""WITH {_TWO}, u AS (SELECT id, {w[0]} / (60 + rank) AS s, 0 AS i, rank, 'long' AS source FROM a UNION ALL SELECT id, {w[1]} / (60 + rank), 1, rank, 'new' FROM b
UNION ALL SELECT id, {w[2]} / (60 + rank), 2, rank, 'bm25' FROM m), f AS (SELECT id, round(CAST(sum(CAST(s AS DOUBLE)) AS DOUBLE), 9) AS score, min(i * 1000 + rank) AS first, string_agg(source, '+' ORDER BY source) AS sources FROM u GROUP BY id)
SELECT id, score, sources, CAST(row_number() OVER (ORDER BY score DESC, first) AS INT) AS rank FROM f"""


@query(_rrf_sql((1.0, 1.0, 1.0)))
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_two(spark, d))


@query(_rrf_sql((1.0, 0.3, 0.5)))
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_two(spark, d), [1.0, 0.3, 0.5])


@query(
    rf"""WITH {_TWO}, w AS (SELECT doc_id AS id, len(list_intersect(['the', 'nightly', 'job', 'cache'], list_distinct(list_transform(regexp_split_to_array(substr(text, 1, 512), '\s+'),
lambda x: regexp_replace(regexp_replace(lower(x), '^[.,:;()\[\]{{}}]+', ''), '[.,:;()\[\]{{}}]+$', ''))))) AS score FROM documents)
SELECT id, CAST(score AS DOUBLE) AS score, rank AS fused, CAST(row_number() OVER (ORDER BY score DESC, rank) AS INT) AS rank FROM a JOIN w USING (id)"""
)
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return fusion.rerank(_two(spark, d)[0][1], docs, "The nightly job, cache", "text").select("id", "score", F.col("fused").cast("long").alias("fused"), "rank")


_V = "v AS (SELECT DISTINCT id, kind, name, short_name, chunk_id FROM nodes)"


def _symbol_sql(name: str, allowed: str = "true") -> str:
    return f"""SELECT id, CAST(row_number() OVER (ORDER BY id) AS INT) AS rank FROM (SELECT DISTINCT chunk_id AS id FROM v WHERE kind <> 'block' AND chunk_id IS NOT NULL AND (short_name = '{name}' OR name = '{name}')) WHERE {allowed} QUALIFY rank <= 50"""


@query(
    f"""WITH {_CHUNKS}, {_SYMBOLS}, {_V}, a AS ({_symbol_sql('parse_header')}), b AS ({_TRI}), m AS ({_bm25_sql([['find'], ['parse', 'header']], 50, docs=_CHUNKS)}),
u AS (SELECT id, 1 / (60 + rank) AS s, 0 AS i, rank, 'symbol' AS source FROM a UNION ALL SELECT id, 1 / (60 + rank), 1, rank, 'trigram' FROM b UNION ALL SELECT id, 1 / (60 + rank), 2, rank, 'bm25' FROM m),
f AS (SELECT id, round(CAST(sum(CAST(s AS DOUBLE)) AS DOUBLE), 9) AS score, min(i * 1000 + rank) AS first, string_agg(source, '+' ORDER BY source) AS sources FROM u GROUP BY id)
SELECT id, score, sources, CAST(row_number() OVER (ORDER BY score DESC, first) AS INT) AS rank FROM f"""
)
def fast_lane(spark: SparkSession, d: str) -> DataFrame:
    i, g = Index(spark, d, "chunks"), Index(spark, d, "graph")
    q = "find parse_header"
    symbol = spark.range(1).select(T.last_symbol(F.lit(q))).first()[0]
    return fusion.fast_lane(lexical.symbol_search(_named(g, symbol), symbol), lexical.trigram_search(i.read("trigrams", lexical.query_trigrams(symbol)), symbol), i.bm25(q))


def _named(g: Index, symbol: str) -> DataFrame:
    """Nodes that may bear a name: those of that short name, and of the last part of a qualified one."""
    return g.read("names", sorted({symbol, symbol.rsplit("::", 1)[-1].rsplit("/", 1)[-1]}))


_QUERY = "header parser cache"
_FULL_TERMS = [[w] for w in _QUERY.split()]
_DENSE = """w0 AS (SELECT content_hash AS h, arg_max(embedding, created_at) AS e FROM embedding_cache WHERE model_id = 'quillcode-embed-2' AND content_hash IS NOT NULL GROUP BY 1),
w AS (SELECT cc.id, cc.lang, h, CAST(e AS DOUBLE[]) AS e FROM w0 JOIN cc ON cc.content_hash = h WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0),
wq AS (SELECT e AS q FROM w ORDER BY h, id LIMIT 1), ws AS (SELECT id, lang, round(list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), 9) AS score FROM w, wq),
wr AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM ws)"""


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _dense_sql(k: int, cats: list[str]) -> str:
    return f"SELECT id, CAST(row_number() OVER (ORDER BY r) AS INT) AS rank FROM wr WHERE r <= {6 * k} AND lang IN {_in(cats)} QUALIFY rank <= {k}"


def _fuse_sql(parts: list[tuple[str, str, float]], out: str) -> str:
    u = " UNION ALL ".join(f"SELECT id, CAST({w} AS DOUBLE) / (60 + rank) AS s, {i} AS i, rank, '{name}' AS source FROM {cte}" for i, (name, cte, w) in enumerate(parts))
    return f"""{out}u AS ({u}), {out}f AS (SELECT id, round(sum(s), 9) AS score, min(i * 100000 + rank) AS first, string_agg(source, '+' ORDER BY source) AS sources FROM {out}u GROUP BY id),
{out} AS (SELECT id, score, sources, row_number() OVER (ORDER BY score DESC, first) AS rank FROM {out}f)"""


def _ppr_sql(steps: int = 10) -> str:
    out = ["""pk AS (SELECT DISTINCT id, chunk_id FROM v WHERE chunk_id IS NOT NULL AND kind <> 'block'), pn AS (SELECT DISTINCT id FROM pk), pg AS (SELECT src, dst FROM e SEMI JOIN pn a ON e.src = a.id SEMI JOIN pn b ON e.dst = b.id),
po AS (SELECT src, count(*) AS o FROM pg GROUP BY src), cand AS (SELECT id, max(w) AS w FROM (SELECT id, 1.0::DOUBLE AS w FROM seeds UNION ALL SELECT id, 0.25 FROM ex) GROUP BY id),
p0 AS (SELECT pk.id, max(w) AS w FROM pk JOIN cand ON pk.chunk_id = cand.id GROUP BY pk.id), pp AS (SELECT pn.id, coalesce(w, 0) / (SELECT sum(w) FROM p0) AS p FROM pn LEFT JOIN p0 USING (id)),
x0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM pn) AS x, false AS done FROM pn)"""]
    for i in range(steps):
        out.append(f"""y{i} AS (SELECT pp.id, 0.15 * pp.p + 0.85 * coalesce(f.f, 0) + 0.85 * pp.p * (SELECT coalesce(sum(x), 0) FROM x{i} ANTI JOIN po ON x{i}.id = po.src) AS y
FROM pp LEFT JOIN (SELECT dst, sum(x / o) AS f FROM pg JOIN po ON pg.src = po.src JOIN x{i} ON x{i}.id = pg.src GROUP BY dst) f ON pp.id = f.dst),
x{i + 1} AS (SELECT id, CASE WHEN done THEN x ELSE y END AS x, done OR (SELECT sum(abs(y - x)) FROM y{i} JOIN x{i} USING (id)) < (SELECT count(*) FROM pn) * 1e-6 AS done FROM x{i} JOIN y{i} USING (id))""")
    out.append(f"pr AS (SELECT pk.chunk_id AS id, round(max(x), 12) AS score FROM x{steps} JOIN pk USING (id) SEMI JOIN cand ON pk.chunk_id = cand.id GROUP BY 1), ppr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM pr)")
    return ", ".join(out)


_OVER = r"""len(list_intersect(['header', 'parser', 'cache'], list_distinct(list_transform(regexp_split_to_array(substr(content, 1, 512), '\s+'), lambda x: regexp_replace(regexp_replace(lower(x), '^[.,:;()\[\]{}]+', ''), '[.,:;()\[\]{}]+$', '')))))"""


@query(
    f"""WITH {_CHUNKS}, {_V}, e AS (SELECT DISTINCT n.parent_id AS src, n.id AS dst FROM nodes n SEMI JOIN nodes p ON n.parent_id = p.id), {_DENSE},
b1 AS ({_bm25_sql(_FULL_TERMS, 50, f'lang IN {_in(PRIMARY)}', _CHUNKS)}), d1 AS ({_dense_sql(50, PRIMARY)}), s1 AS ({_symbol_sql('cache', f'id IN (SELECT id FROM cc WHERE lang IN {_in(RETRIEVABLE)})')}),
b2 AS ({_bm25_sql(_FULL_TERMS, 20, f'lang IN {_in(CONTEXT)}', _CHUNKS)}), d2 AS ({_dense_sql(20, CONTEXT)}), {_fuse_sql([('bm25', 'b1', 1.0), ('dense', 'd1', 1.0), ('symbol', 's1', 1.0)], 'pri')},
seeds AS (SELECT id FROM pri WHERE rank <= 20), sn AS (SELECT DISTINCT v.id FROM v SEMI JOIN seeds ON v.chunk_id = seeds.id), en AS (SELECT dst AS id FROM e SEMI JOIN sn ON e.src = sn.id UNION ALL SELECT src FROM e SEMI JOIN sn ON e.dst = sn.id),
ec AS (SELECT DISTINCT chunk_id AS id FROM v SEMI JOIN en USING (id) WHERE chunk_id IN (SELECT id FROM cc WHERE lang IN {_in(RETRIEVABLE)})), ex AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM ec QUALIFY rank <= greatest(1, 3 * (SELECT count(*) FROM seeds))),
{_ppr_sql()}, {_fuse_sql([('bm25', 'b1', 1.0), ('dense', 'd1', 1.0), ('symbol', 's1', 1.0), ('bm25-context', 'b2', 0.3), ('dense-context', 'd2', 0.3), ('graph', 'ex', 1.0), ('ppr', 'ppr', 1.0)], 'fin')}
SELECT CAST(row_number() OVER (ORDER BY o DESC, rank) AS INT) AS rank, id AS chunk_id, file_path, kind, name, start_line, end_line, CAST(o AS DOUBLE) AS score, sources AS why, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview
FROM (SELECT fin.*, {_OVER} AS o, cc.file_path, cc.kind, cc.name, cc.start_line, cc.end_line, cc.content FROM fin JOIN cc USING (id))"""
)
def full_lane(spark: SparkSession, d: str) -> DataFrame:
    i, g = Index(spark, d, "chunks"), Index(spark, d, "graph")
    chunks, vectors = i.read("chunks"), i.read("vectors")
    like = list(vectors.orderBy("content_hash", "id").select("embedding").first()[0])  # the query vector is that of one chunk
    allowed = chunks.filter(F.col("category").isin(RETRIEVABLE)).select("id")
    dense = lambda k, cats: vector.knn_overfetch(vectors, like, k, F.col("category").isin(cats), id_col="id")
    primary = [("bm25", i.bm25(_QUERY, 50, PRIMARY)), ("dense", dense(50, PRIMARY)), ("symbol", lexical.symbol_search(_named(g, "cache"), "cache", 50, allowed))]
    context = [("bm25-context", i.bm25(_QUERY, 20, CONTEXT)), ("dense-context", dense(20, CONTEXT))]
    nodes = g.read("nodes")
    adj, edges = g.adjacency(), g.read("out").select("src", "dst", "kind", "weight")
    best = fusion.full_lane(
        primary, context, lambda seeds: graph.expand(seeds, nodes, adj, allowed=allowed), lambda w: graph.personalised(nodes, edges, w), lambda fused: fusion.rerank(fused, chunks.select("id", "content"), _QUERY, "content")
    )
    return fusion.assemble_results(best, chunks)


_COS = "round(CASE WHEN n > 0 AND qn > 0 THEN dot / (n * qn) ELSE 0 END, 9)"


def _knn_sql(where: str, k: int) -> str:
    return f"""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, label, list_inner_product(CAST(embedding AS DOUBLE[]), q) AS dot,
sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n, sqrt(list_inner_product(q, q)) AS qn FROM embeddings, q)
SELECT id, score, CAST(rank AS INT) AS rank FROM (SELECT id, label, {_COS} AS score, row_number() OVER (ORDER BY {_COS} DESC, id) AS rank FROM s WHERE {where}) WHERE rank <= {k}"""


def _q0(spark: SparkSession, d: str) -> list[float]:
    return list(_t(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0])  # the one query vector


@query(_knn_sql("true", 20))
def vec_knn(spark: SparkSession, d: str) -> DataFrame:
    return vector.knn(_t(spark, d, "embeddings"), _q0(spark, d), 20)


@query(_knn_sql("label = 3", 20))
def vec_knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vector.knn(_t(spark, d, "embeddings"), _q0(spark, d), 20, keep=F.col("label") == 3)


@query(f"SELECT id, score, CAST(row_number() OVER (ORDER BY rank) AS INT) AS rank FROM ({_knn_sql('true', 120)}) JOIN embeddings ON id = vec_id WHERE label = 3 QUALIFY row_number() OVER (ORDER BY rank) <= 20")
def vec_overfetch(spark: SparkSession, d: str) -> DataFrame:
    return vector.knn_overfetch(_t(spark, d, "embeddings"), _q0(spark, d), 20, "label = 3")


_UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda v: v / CASE WHEN list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0 THEN sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) ELSE 1 END)"


@query(f"SELECT vec_id, list_sum(list_transform({_UNIT}, lambda v: CAST(round_even(v * 127, 0) AS BIGINT)))::BIGINT AS checksum, CAST(list_min(list_transform({_UNIT}, lambda v: CAST(round_even(v * 127, 0) AS BIGINT))) AS INT) AS low FROM embeddings")
def vec_quantize(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "embeddings").select("vec_id", vector.quantise("embedding").alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + v).alias("checksum"), F.array_min("q").cast("int").alias("low"))


_CENT = """m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m, count(*) AS size FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY ALL),
l AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)"""


@query(f"WITH {_CENT} SELECT label, CAST(i - 1 AS INT) AS i, round(m / n, 6) AS v, size FROM m JOIN l USING (label)")
def vec_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = vector.centroids(_t(spark, d, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("i", "v"), "size").withColumn("v", F.round("v", 6))


@query(
    f"""WITH {_CENT}, c AS (SELECT label, i, m / n AS v FROM m JOIN l USING (label)), s AS (SELECT vec_id, c.label AS nearest, round(sum(CAST(embedding[i] AS DOUBLE) * v), 9) AS dot FROM embeddings, c GROUP BY ALL)
SELECT vec_id, nearest FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dot DESC, nearest) = 1"""
)
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    near = vector.nearest_centroid(e, vector.centroids(e, "label"), "vec_id", cid="label")
    return near.select(F.col("id").alias("vec_id"), F.col("nearest").cast("int").alias("nearest"))


@query()
def concept_clusters(spark: SparkSession, d: str) -> DataFrame:
    return density.concepts(_t(spark, d, "embeddings"), "vec_id", "embedding")


_ARR = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_PARTS = "string_split(lower(file_path), '/')"
_NAME = f"{_PARTS}[-1]"
_EXT = rf"regexp_extract({_NAME}, '[^.](\.[^.]+)$', 1)"


@query(
    rf"""SELECT file_path, CASE WHEN list_has_any({_PARTS}, {_ARR(T.VENDOR_DIRS)}) THEN 'vendor' WHEN list_has_any({_PARTS}, {_ARR(T.META_DIRS)}) OR {_NAME} IN {tuple(T.META_NAMES)} THEN 'meta'
WHEN list_has_any({_PARTS}, {_ARR(T.TEST_DIRS)}) OR contains({_NAME}, '.test.') OR contains({_NAME}, '.spec.') OR starts_with({_NAME}, 'test_') THEN 'test' WHEN list_has_any({_PARTS}, {_ARR(T.DOC_DIRS)}) THEN 'docs'
WHEN {_NAME} IN {tuple(T.CONFIG_NAMES)} OR {_EXT} IN {tuple(T.CONFIG_EXTS)} OR regexp_matches({_NAME}, '\.config\.[^.]+$') THEN 'config' WHEN {_EXT} IN {tuple(T.DOC_EXTS)} THEN 'docs'
WHEN contains({_NAME}, '.example') OR contains({_NAME}, '.sample') THEN 'docs' ELSE 'source' END AS category FROM (SELECT DISTINCT file_path FROM chunks)"""
)
def classify_paths(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "chunks").select("file_path").distinct().select("file_path", T.category(F.col("file_path")).alias("category"))


_LMAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items()) + "}"
_SMAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.SPECIAL.items()) + "}"


@query(rf"SELECT file_path, coalesce({_SMAP}[string_split(file_path, '/')[-1]], {_LMAP}[lower(regexp_extract(string_split(file_path, '/')[-1], '[^.](\.[^.]+)$', 1))], 'text') AS language FROM (SELECT DISTINCT file_path FROM chunks)")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "chunks").select("file_path").distinct().select("file_path", T.language(F.col("file_path")).alias("language"))


@query(r"SELECT DISTINCT id, sha256(content) AS digest, sha256(content) = content_hash AS ok, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS tokens FROM chunks")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "chunks").select("id", "content", "content_hash").distinct()
    return c.select("id", incremental.digest("content").alias("digest"), (incremental.digest("content") == F.col("content_hash")).alias("ok"), T.content_tokens("content").cast("long").alias("tokens")).distinct()


_NEWEST = r"""b AS (SELECT repo, regexp_replace(regexp_replace(regexp_replace(trim(file_path), '\\', '/', 'g'), '/(\./|/)+', '/', 'g'), '^(\./|/)+', '') AS file_path,
 nullif(regexp_replace(lower(trim(blob_sha)), '^[a-z0-9-]+:', ''), '') AS sha, last_indexed_at AS seen FROM merkle_files),
a AS (SELECT repo, regexp_replace(regexp_replace(regexp_replace(trim(file_path), '\\', '/', 'g'), '/(\./|/)+', '/', 'g'), '^(\./|/)+', '') AS file_path,
 nullif(regexp_replace(lower(trim(blob_sha)), '^[a-z0-9-]+:', ''), '') AS sha, scanned_at AS seen FROM tree_scan),
b1 AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY seen DESC, sha DESC NULLS LAST) = 1), a1 AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY seen DESC, sha DESC NULLS LAST) = 1)"""


def _newest(df: DataFrame, at: str) -> DataFrame:
    rows = df.select("repo", C.clean_path("file_path").alias("file_path"), C.clean_digest("blob_sha").alias("blob_sha"), at)
    return rows.groupBy("repo", "file_path").agg(F.max(F.struct(at, "blob_sha")).alias("m")).select("repo", "file_path", "m.blob_sha")


@query(
    f"""WITH {_NEWEST}, y AS (SELECT * FROM a1 WHERE sha IS NOT NULL) SELECT coalesce(b1.repo, y.repo) AS repo, coalesce(b1.file_path, y.file_path) AS file_path, CASE WHEN b1.repo IS NULL THEN 'added'
WHEN y.repo IS NULL THEN 'removed' WHEN b1.sha IS NOT DISTINCT FROM y.sha THEN 'unchanged' ELSE 'modified' END AS status FROM b1 FULL JOIN y ON b1.repo = y.repo AND b1.file_path = y.file_path"""
)
def delta_plan(spark: SparkSession, d: str) -> DataFrame:
    after = _newest(_t(spark, d, "tree_scan"), "scanned_at").filter("blob_sha is not null")
    return incremental.delta(_newest(_t(spark, d, "merkle_files"), "last_indexed_at"), after, ["repo", "file_path"])


@query(
    f"""WITH {_NEWEST}, p AS (SELECT repo || '/' || file_path AS p, max(sha) AS sha FROM b1 WHERE sha IS NOT NULL GROUP BY 1) SELECT sha256(string_agg(p || chr(0) || sha || chr(0), '' ORDER BY p)) AS root FROM p"""
)
def merkle_root(spark: SparkSession, d: str) -> DataFrame:
    return incremental.merkle_root(_merkle(spark, d))


def _merkle(spark: SparkSession, d: str) -> DataFrame:
    return _newest(_t(spark, d, "merkle_files"), "last_indexed_at").filter("repo is not null").select(F.concat_ws("/", "repo", "file_path").alias("file_path"), "blob_sha")


@query(
    f"""WITH {_NEWEST}, g AS (SELECT substr(sha256(p), 1, 2) AS g, sha256(string_agg(DISTINCT p || chr(0) || sha || chr(0), '' ORDER BY p || chr(0) || sha || chr(0))) AS d
FROM (SELECT repo || '/' || file_path AS p, sha FROM b1 WHERE sha IS NOT NULL) GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY g)) AS root FROM g"""
)
def merkle_fold(spark: SparkSession, d: str) -> DataFrame:
    return incremental.merkle_fold(_merkle(spark, d))


@query(
    f"""WITH {_NEWEST}, gone AS (SELECT DISTINCT c.id FROM chunks c JOIN a1 ON c.repo = a1.repo AND c.file_path = a1.file_path WHERE a1.sha IS NULL)
SELECT chunk_id, cluster_id, count(*) AS n FROM chunk_clusters WHERE chunk_id NOT IN (SELECT id FROM gone) GROUP BY ALL"""
)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = _newest(_t(spark, d, "tree_scan"), "scanned_at").filter("blob_sha is null")
    out = incremental.cascade_delete({"members": (_t(spark, d, "chunk_clusters"), "chunk_id")}, _t(spark, d, "chunks"), gone, ["repo", "file_path"])
    return out["members"].groupBy("chunk_id", "cluster_id").agg(F.count("*").alias("n"))


@query(
    """SELECT content_hash, content_hash IN (SELECT content_hash FROM embedding_cache WHERE model_id = 'quillcode-embed-2' AND len(embedding) = 128) AS hit FROM (SELECT DISTINCT content_hash FROM chunks WHERE content_hash IS NOT NULL)"""
)
def embedding_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    return incremental.cache_lookup(_t(spark, d, "chunks"), _t(spark, d, "embedding_cache"), "quillcode-embed-2", 128)


@query(
    """SELECT content_hash, model_id, max(created_at) AS created_at FROM embedding_cache GROUP BY ALL"""
)
def embedding_cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embedding_cache")
    mid = e.agg(F.percentile_approx("created_at", 0.5)).first()[0]  # one number
    new = e.filter(F.col("created_at") > mid)
    return incremental.upsert(e.filter(F.col("created_at") <= mid), new, ["content_hash", "model_id"], "created_at").select("content_hash", "model_id", "created_at")


@query(
    """WITH e AS (SELECT DISTINCT n.parent_id, n.id FROM nodes n SEMI JOIN nodes p ON n.parent_id = p.id)
SELECT (SELECT count(DISTINCT id) FROM chunks) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT id, kind FROM nodes) WHERE kind <> 'block') AS symbols, (SELECT count(*) FROM (SELECT DISTINCT id, kind FROM nodes) WHERE kind = 'block') AS blocks,
(SELECT count(*) FROM e) AS symbol_edges, 0 AS flow_edges, (SELECT count(DISTINCT id) FROM clusters) AS clusters"""
)
def stats_counts(spark: SparkSession, d: str) -> DataFrame:
    from loamdex.operators.graph import containment_edges

    n = _t(spark, d, "nodes")
    return analytics.counts(_t(spark, d, "chunks"), n, containment_edges(n), _t(spark, d, "clusters"))


@query("SELECT lower(trim(language)) AS language, count(DISTINCT id) AS n FROM chunks GROUP BY 1")
def language_hist(spark: SparkSession, d: str) -> DataFrame:
    return analytics.languages(_t(spark, d, "chunks"))


@query(
    """WITH c AS (SELECT repo, file_path, count(DISTINCT id) AS chunks, count(*) AS r FROM chunks WHERE repo IS NOT NULL AND file_path IS NOT NULL GROUP BY ALL),
n AS (SELECT repo, file_path, count(DISTINCT CASE WHEN kind <> 'block' THEN id END) AS symbols, sum(CASE WHEN kind <> 'block' THEN pagerank ELSE 0 END) AS pr FROM nodes GROUP BY ALL)
SELECT repo, file_path, chunks, symbols, pagerank FROM (SELECT c.repo, c.file_path, chunks, coalesce(symbols, 0) AS symbols, round(coalesce(pr * r, 0), 6) AS pagerank FROM c LEFT JOIN n ON c.repo = n.repo AND c.file_path = n.file_path)
ORDER BY pagerank DESC, symbols DESC, repo, file_path LIMIT 10"""
)
def pivotal_files(spark: SparkSession, d: str) -> DataFrame:
    return analytics.pivotal_files(_t(spark, d, "chunks"), _t(spark, d, "nodes"))


@query(
    """SELECT cluster_id, chunk_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY membership DESC NULLS LAST, chunk_id) AS rank FROM (SELECT DISTINCT * FROM chunk_clusters)) WHERE rank <= 5"""
)
def cluster_samples(spark: SparkSession, d: str) -> DataFrame:
    return analytics.cluster_samples(_t(spark, d, "chunk_clusters"))


@query(
    r"""WITH s AS (SELECT source, text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5),
w AS (SELECT source, regexp_replace(regexp_replace(lower(x), '^[^a-z0-9_]+', ''), '[^a-z0-9_]+$', '') AS w FROM s, unnest(regexp_split_to_array(text, '\s+')) AS u(x)),
r AS (SELECT source, w, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, w) AS i FROM w WHERE length(w) >= 4 GROUP BY source, w)
SELECT source, string_agg(w, ' ' ORDER BY i) AS label FROM r WHERE i <= 3 GROUP BY source"""
)
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    return analytics.labels(_t(spark, d, "documents"), "source", "text", F.col("doc_id"))


_RANKED = """r AS (SELECT source AS query, CAST(doc_id AS VARCHAR) AS item, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20),
x AS (SELECT source AS query, CASE WHEN lang = 'en' AND doc_type = 'guide' THEN CAST(doc_id AS VARCHAR) END AS item FROM documents)"""


@query(
    f"""WITH {_RANKED}, e AS (SELECT query, list_distinct(list(item) FILTER (item IS NOT NULL)) AS want FROM x GROUP BY query),
h AS (SELECT e.query, coalesce(len(want), 0) AS n, min(rank) FILTER (list_contains(want, item) AND rank <= 10) AS f, coalesce(sum(1 / log2(rank + 1)) FILTER (list_contains(want, item) AND rank <= 10), 0) AS dcg,
count(*) FILTER (list_contains(want, item) AND rank <= 5) AS h5, count(*) FILTER (list_contains(want, item) AND rank <= 10) AS h10 FROM e LEFT JOIN r ON e.query = r.query GROUP BY e.query, want)
SELECT query, round(CASE WHEN n = 0 THEN 0 ELSE coalesce(1.0 / f, 0) END, 6)::DOUBLE AS mrr_at_10, round(CASE WHEN n = 0 THEN 1 ELSE dcg / list_sum(list_transform(range(1, least(greatest(n, 1), 10) + 1), lambda i: 1 / log2(i + 1))) END, 6)::DOUBLE AS ndcg_at_10,
round(CASE WHEN n = 0 THEN 1 ELSE h5 / n END, 6)::DOUBLE AS recall_at_5, round(CASE WHEN n = 0 THEN 1 ELSE h10 / n END, 6)::DOUBLE AS recall_at_10 FROM h"""
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").withColumn("item", F.col("doc_id").cast("string"))
    ranked = docs.select(F.col("source").alias("query"), "item", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.length("text")), "doc_id")).alias("rank"))
    want = docs.select(F.col("source").alias("query"), F.when((F.col("lang") == "en") & (F.col("doc_type") == "guide"), F.col("item")).alias("item"))
    return analytics.retrieval_metrics(want, ranked)


@query()
def stub_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return vector.stub_embed(_t(spark, d, "chunks").select("content_hash", "content").distinct(), "content_hash", "content")


@query(
    """SELECT id, coalesce(n.label, c.label) AS label, c.size FROM (SELECT DISTINCT id, label, size FROM clusters) c
LEFT JOIN (SELECT cluster_id AS id, 'members ' || count(DISTINCT chunk_id) AS label FROM chunk_clusters GROUP BY 1) n USING (id)"""
)
def apply_labels(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "chunk_clusters").groupBy(F.col("cluster_id").alias("id")).agg(F.concat(F.lit("members "), F.countDistinct("chunk_id").cast("string")).alias("label"))
    c = _t(spark, d, "clusters").select("id", "label", "size").distinct().withColumn("summary", F.lit(None).cast("string"))
    return analytics.apply_labels(c, m.withColumn("summary", F.lit(None).cast("string"))).select("id", "label", "size")
