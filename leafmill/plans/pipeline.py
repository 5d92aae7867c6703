"""The whole way from files to answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.functions.text import tokens
from leafmill.operators import encode as E, retrieve as R, sections as S
from leafmill.operators.index import ChunkStore, changes, index_stats
from leafmill.sources.files import as_text, load
from leafmill.tables import cut


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 512
    chunk_overlap: int = 100
    extensions: tuple[str, ...] = (".md", ".html", ".txt")
    recursive: bool = True
    top_k: int = 10
    rerank_n: int = 5
    alpha: float = 0.5
    reingest_batch: int = 50


class IngestionPipeline:
    """Files to chunks in a store below `root`, a shared folder. encoder: texts to vectors."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), encoder=None):
        self.spark, self.settings, self.encoder = spark, settings, encoder
        self.store, self.manifest = ChunkStore(spark, f"{root}/chunks"), ChunkStore(spark, f"{root}/manifest", "doc_key")

    def blobs(self, path: str) -> DataFrame:
        return load(self.spark, path, self.settings.extensions, recursive=self.settings.recursive)

    def chunks(self, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chunks with vectors and links, errors by document)."""
        docs = as_text(blobs).dropDuplicates(["doc_id"])
        sections = S.split_sections(docs)
        made = S.link_chunks(S.split_chunks(sections.where("error is null"), self.settings.chunk_size, self.settings.chunk_overlap))
        named = made.join(docs.select("doc_id", "source", "file_name", "domain"), "doc_id")
        vectors = E.encode(named.dropDuplicates(["node_id"]), self.encoder)
        return named.join(vectors, "node_id", "left"), sections.where("error is not null").select("doc_id", "error")

    def run(self, path: str) -> dict:
        """Ingests a file or folder; what it did. A chunk that is there already is replaced, so a second run changes nothing."""
        return self._ingest(self.blobs(path))

    def _ingest(self, blobs: DataFrame) -> dict:
        made, errors = self.chunks(blobs)
        self.store.upsert(made)
        self.manifest.upsert(blobs.select(F.col("source").alias("doc_key"), F.col("doc_id").alias("content_hash")))
        done = self.store.read().join(blobs.select("doc_id").distinct(), "doc_id", "left_semi")
        s = done.agg(F.count("*").alias("c"), F.sum(F.size(tokens(F.col("text")))).alias("t")).head()
        return {"processed_files": blobs.count(), "generated_chunks": s["c"], "total_tokens": s["t"] or 0, "errors": errors.count()}

    def sync(self, path: str, handler=None) -> dict:
        """Brings the store to the state of a folder: removed and changed files lose their chunks, new and changed ones are
        ingested, or given to `handler` as blobs. The number of files by what became of them."""
        blobs = self.blobs(path)
        now = blobs.select(F.col("source").alias("doc_key"), F.col("doc_id").alias("content_hash"))
        if not self.manifest.exists():
            (handler or self._ingest)(blobs)
            return {"inserted": now.count()}
        before = self.manifest.read()
        diff = cut(changes(before, now))
        counts = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
        gone = before.join(diff.where("change in ('deleted', 'updated')"), "doc_key", "left_semi")
        kept = before.join(diff.where("change = 'unchanged'"), "doc_key", "left_semi")
        if counts.keys() & {"deleted", "updated"}:
            lost = gone.select(F.col("content_hash").alias("doc_id")).distinct().join(kept.select(F.col("content_hash").alias("doc_id")), "doc_id", "left_anti")
            self.store.delete(lost)
            self.manifest.write(kept)
        if counts.keys() & {"inserted", "updated"}:
            (handler or self._ingest)(blobs.join(diff.where("change in ('inserted', 'updated')").select(F.col("doc_key").alias("source")), "source", "left_semi"))
        return counts

    def stats(self) -> DataFrame:
        return index_stats(self.store.read())


class QueryEngine:
    """Batches of questions against chunks (node_id, doc_id, text, embedding ...): hybrid search, rerank, answer."""

    def __init__(self, chunks: DataFrame, settings: Settings = Settings(), encoder=None, scorer=R.overlap_score, complete=None, where=None, chain=()):
        chunks = chunks if where is None else chunks.where(where)
        self.keys = chunks.select("node_id", F.xxhash64("node_id").alias("key"))
        self.docs = chunks.select(F.xxhash64("node_id").alias("node_id"), "doc_id", "text", "embedding")
        self.settings, self.encoder, self.scorer, self.complete, self.chain = settings, encoder, scorer, complete, chain

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """queries: (query_id, text). Hits (query_id, node_id, score, rank) by hashed node ids, through the chain of
        post-processors. A search that fails finds nothing, a reranker that fails leaves the fused order; both warn."""
        s = self.settings

        def search() -> DataFrame:
            vectors = E.encode(queries, self.encoder, id_col="query_id").select("query_id", F.col("embedding").alias("v"))
            dense = R.dense_top_k(vectors, self.docs.where("embedding is not null").select("node_id", F.col("embedding").alias("v")), 2 * s.top_k)
            return R.hybrid(dense, R.bm25_top_k(queries, self.docs, 2 * s.top_k), s.alpha, s.top_k)

        hits = R.search_or_none(search, self.docs.sparkSession)
        hits = hits if self.scorer is None else R.rerank_or_keep(hits, queries, self.docs, s.rerank_n, self.scorer)
        return R.post_process(hits, queries, self.chain)

    def query(self, queries: DataFrame) -> DataFrame:
        """(query_id, prompt, answer, sources)."""
        return R.answers(self.retrieve(queries), queries, self.docs, self.complete)
