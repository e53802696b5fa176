"""The written indexes that the registered queries read: made once for the tables of a folder, then read by key.

An index belongs to the tables as they are: its name holds their sizes and times, so other tables get another one."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import code, graph, lexical
from loamdex.session import Scratch, shared_dir
from loamdex.sources.catalog import Catalog, Files
from loamdex.sources.files import assemble

MODEL = "quillcode-embed-2"
#: Categories whose chunks a search may return, and the two groups of them.
PRIMARY, CONTEXT = ["source", "config"], ["test", "docs"]
RETRIEVABLE = [*PRIMARY, *CONTEXT]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks_once(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with one row an id, the last delivered; category in lower case."""
    c = table(spark, d, "chunks").filter("id is not null")
    cols = [x for x in c.columns if x not in ("id", "indexed_at")]
    one = c.groupBy("id").agg(F.max(F.struct("indexed_at", *cols)).alias("r")).select("id", *[F.col(f"r.{x}").alias(x) for x in cols])
    return one.withColumn("category", F.lower("category"))


def nodes_once(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select("id", "kind", "name", "short_name", "repo", "file_path", "start_line", "end_line", "signature", "chunk_id", "pagerank").distinct()


def _documents(spark: SparkSession, d: str, scratch: Scratch) -> tuple[dict[str, DataFrame], dict[str, str]]:
    docs = table(spark, d, "documents")
    return {
        "postings": lexical.postings(docs, tag=F.col("lang")), "stems": lexical.postings(docs, tag=F.col("lang"), stem=True), "stats": lexical.lengths(docs),
    }, {"postings": "term", "stems": "term"}


def _chunks(spark: SparkSession, d: str, scratch: Scratch) -> tuple[dict[str, DataFrame], dict[str, str]]:
    c = scratch.keep(chunks_once(spark, d))
    e = table(spark, d, "embedding_cache").filter((F.col("model_id") == MODEL) & F.col("content_hash").isNotNull())
    e = e.groupBy("content_hash").agg(F.max(F.struct("created_at", "embedding"))["embedding"].alias("embedding"))
    vectors = c.select("id", "category", "content_hash").join(e.filter(F.exists("embedding", lambda x: x != 0)), "content_hash")
    return {
        "vectors": vectors,
        "postings": lexical.postings(c, "id", "content", F.col("category")), "stats": lexical.lengths(c, "id", "content"), "trigrams": lexical.trigram_index(c), "chunks": c,
    }, {"postings": "term", "trigrams": "trigram", "chunks": "id"}


def _graph(spark: SparkSession, d: str, scratch: Scratch) -> tuple[dict[str, DataFrame], dict[str, str]]:
    n = nodes_once(spark, d)
    e = graph.containment_edges(table(spark, d, "nodes"))
    return {"nodes": n, "names": n, "chunk_nodes": n.select("chunk_id", "id", "kind").filter("chunk_id is not null"), "out": e, "into": e}, {
        "nodes": "id", "names": "short_name", "chunk_nodes": "chunk_id", "out": "src", "into": "dst",
    }


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path, text) of all files that the chunks make up."""
    return assemble(table(spark, d, "chunks")).select(F.concat_ws("/", "repo", "file_path").alias("path"), "text")


def _parsed(spark: SparkSession, d: str, scratch: Scratch) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """What a parse finds, each file parsed once: nodes, edges by name, flow and warnings in folders of their own."""
    rows = code.tagged(files(spark, d), "all")
    return {"rows": rows.withColumn("part", F.when(F.col("e_kind").isin(code.FLOW), "flow").otherwise(F.col("what")))}, {}


def parsed(spark: SparkSession, d: str, part: str) -> DataFrame:
    """The node, edge, flow or warning rows of the parse."""
    rows = Index(spark, d, "parsed").read("rows").filter(F.col("part") == part)
    return {"node": code.nodes_of, "warning": code.warnings_of}.get(part, code.edges_of)(rows)


def _links(spark: SparkSession, d: str, scratch: Scratch) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Numbers of the nodes by place and name, and the resolved edges of the symbols: from names to a graph."""
    found = parsed(spark, d, "node")
    blocks, _ = code.persist_blocks(found.filter("kind = 'block'"), found)
    symbols = found.filter("kind <> 'block'")
    ids = scratch.keep(graph.numbers(symbols.select(*graph.PLACE).unionByName(blocks.select(*graph.PLACE)), scratch))
    sym = scratch.keep(symbols.join(ids, graph.PLACE).select("id", "kind", "name", "short_name", "file_path"))
    return {"ids": ids, "out": graph.resolve_edges(parsed(spark, d, "edge"), sym)}, {"out": "src"}


def _code(spark: SparkSession, d: str, scratch: Scratch) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The rest of the way from source text to graph: parents, chunks and ranks of the nodes, edges and flow by key."""
    found, links = parsed(spark, d, "node"), Index(spark, d, "links")
    blocks, lost = code.persist_blocks(found.filter("kind = 'block'"), found)
    known = scratch.keep(found.filter("kind <> 'block'").unionByName(blocks).join(links.read("ids"), graph.PLACE))
    pieces = chunks_once(spark, d).select("id", F.concat_ws("/", "repo", "file_path").alias("file_path"), "start_byte", (F.col("start_byte") + F.octet_length("content")).alias("end_byte"))
    edges = links.read("out")
    rank = graph.pagerank(known.filter("kind <> 'block'").select("id"), edges, scratch=scratch).withColumnRenamed("score", "pagerank")
    nodes = graph.parents(known).join(graph.assign_chunks(known, pieces), "id", "left").join(rank, "id", "left")
    nodes = scratch.keep(nodes.withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0))))
    scratch.drop(known)
    flow = parsed(spark, d, "flow").withColumn("function", F.regexp_replace("src_name", "#[^#]*$", ""))
    warnings = parsed(spark, d, "warning").unionByName(lost.select(F.col("name").alias("file_path"), F.lit("flow").alias("stage"), "message"))
    return {
        "nodes": nodes, "names": nodes, "into": edges, "flow": flow, "blocks": nodes.filter("kind = 'block'").withColumn("function", F.col("parent_name")), "warnings": warnings,
    }, {"nodes": "id", "names": "short_name", "into": "dst", "flow": "function", "blocks": "function"}


#: Parts of the code index are made one on the other, each when it is first read: what needs the parse only, waits for
#: no graph.
_PARTS = {
    "documents": (_documents, ["documents"]), "chunks": (_chunks, ["chunks", "embedding_cache"]), "graph": (_graph, ["nodes"]),
    "parsed": (_parsed, ["chunks"]), "links": (_links, ["chunks"]), "code": (_code, ["chunks"]),
}
_FOLDERS = {"parsed": {"rows": ["part"]}}
#: Tables that a part reads from the one it was made of.
_HELD = {("code", "out"): "links"}


class Index:
    """One of the parts above, ready to be read."""

    def __init__(self, spark: SparkSession, d: str, part: str):
        make, names = _PARTS[part]
        self.spark, self.d, self.part = spark, d, part
        fs = Files(spark, d)
        seen = repr([(d, n, fs.sizes(f"{d}/{n}.parquet")) for n in names])
        self.name = f"{part}-{hashlib.sha256(seen.encode()).hexdigest()[:16]}"
        self.catalog = Catalog(spark, f"{shared_dir(spark)}/catalog")
        if not self.catalog.files.exists(f"{self.catalog.home}/{self.name}/CURRENT"):
            scratch = Scratch(spark)
            tables, keys = make(spark, d, scratch)
            n = sum(s for t in names for _, s, _ in fs.sizes(f"{d}/{t}.parquet"))
            # A bucket holds about 64 MB of source text at most; few buckets for little data.
            self.catalog.write(self.name, tables, {"source": d}, _FOLDERS.get(part), keys, min(4096, max(8, n // (64 << 20))))
            scratch.close()  # the written index needs none of it

    def read(self, name: str, keys: list | None = None) -> DataFrame:
        held = _HELD.get((self.part, name))
        return Index(self.spark, self.d, held).read(name, keys) if held else self.catalog.read(self.name, name, keys)

    def adjacency(self) -> graph.Adjacency:
        cols = ["src", "dst", "kind", "weight"]
        return graph.Adjacency(lambda ids: self.read("out", ids).select(*cols), lambda ids: self.read("into", ids).select(*cols))

    def bm25(self, query: str, k: int = 50, tags: list[str] | None = None, stem: bool = False) -> DataFrame:
        held = self.read("stems" if stem else "postings", lexical.query_terms(query, stem))
        return lexical.search(held, self.read("stats"), query, k, tags, stem)
