"""Retrieval for batches of queries: dense, sparse, BM25 and fused top-k, reranking, projection and evaluation.

All searches score documents where they are, block by block, against queries of checked size, and keep the k best of every task
before anything is shuffled; queries beyond that size meet the documents in blocks of both.
"""

from __future__ import annotations

import warnings
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.functions.text import tokens
from leafmill.tables import cut


def top_k(hits: DataFrame, k: int, query: str = "query_id", doc: str = "node_id", score: str = "score") -> DataFrame:
    """The k best hits of each query with their rank from 1; equal scores by document."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(doc))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


MOST_QUERIES = 1_000_000  # numbers of all queries together, 8 bytes each, that may go to every worker
CELLS = 4_000_000  # scores held at a time: documents of a block by queries
QUERY_BLOCK, DOC_BLOCK = 4096, 65_536  # rows of a block where the queries are too many for every worker


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where they come from fewer tasks than there are cores, as small files do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


class _Best:
    """The k best documents of each query so far; equal scores go to the smaller document."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.doc = k, np.full((n, 0), -np.inf), np.zeros((n, 0), np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        """score: queries by documents, -inf for no hit."""
        if score.shape[1] > 4 * self.k:  # what is below the k-th best of the block is out; ties stay
            least = np.partition(score, -self.k, axis=1)[:, -self.k]
            some = (score >= least[:, None]).any(0)
            score, doc = score[:, some], doc[some]
        score, doc = np.hstack([self.score, score]), np.hstack([self.doc, np.broadcast_to(doc, score.shape)])
        order = np.lexsort((doc, -score), axis=1)[:, : self.k]
        self.score, self.doc = np.take_along_axis(score, order, 1), np.take_along_axis(doc, order, 1)

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        hit = self.score > -np.inf
        return pa.record_batch({"query_id": pa.array(np.repeat(ids, self.score.shape[1])[hit.ravel()], pa.int64()), "node_id": pa.array(self.doc[hit], pa.int64()), "score": pa.array(self.score[hit], pa.float64())})


class _Dense:
    """Unit query vectors against vectors, by cosine."""

    def __init__(self, t: pa.Table):
        self.ids, self.q = t["query_id"].to_numpy(), self.unit(t["v"])

    @staticmethod
    def unit(v) -> np.ndarray:
        x = np.array(v.to_pylist(), dtype=np.float64)
        return x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x

    def score(self, b: pa.RecordBatch) -> np.ndarray:
        return np.round(self.q @ self.unit(b["v"]).T, 9)


class _Sparse:
    """Weighted terms of queries (query_id, terms, weights) against those of documents (node_id, terms, weights): sums of products
    over shared terms. With `weigh`, documents have all their words as terms, and it makes weights of how often one has a
    word and how many words it has."""

    def __init__(self, t: pa.Table, weigh=None):
        self.ids, self.weigh = t["query_id"].to_numpy(), weigh
        terms, weights = t["terms"].combine_chunks(), t["weights"].combine_chunks()
        flat = terms.flatten()
        self.terms = pa.compute.unique(flat)
        at = pa.compute.index_in(flat, value_set=self.terms).to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        self.query = pa.compute.list_parent_indices(terms).to_numpy()[order]
        self.weight = weights.flatten().to_numpy(zero_copy_only=False)[order]
        self.first = np.searchsorted(at[order], np.arange(len(self.terms) + 1))
        self.whole = None  # terms by queries, where that is small
        if len(self.terms) * len(self.ids) <= CELLS:
            self.whole = np.zeros((len(self.terms), len(self.ids)))
            self.whole[at[order], self.query] = self.weight

    def score(self, b: pa.RecordBatch) -> np.ndarray:
        step = max(1, CELLS // 2 // max(1, len(self.terms))) if self.whole is not None else 256
        return np.hstack([np.zeros((len(self.ids), 0)), *(self._score(b.slice(at, step)) for at in range(0, b.num_rows, step))])

    def _score(self, b: pa.RecordBatch) -> np.ndarray:
        n, m, terms = len(self.ids), b.num_rows, b["terms"]
        at = pa.compute.index_in(terms.flatten(), value_set=self.terms)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        term = at.filter(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = pa.compute.list_parent_indices(terms).to_numpy()[known].astype(np.int64)
        if self.weigh is None:
            w = b["weights"].flatten().to_numpy(zero_copy_only=False)[known]
        else:
            key, tf = np.unique(doc * len(self.terms) + term, return_counts=True)
            doc, term = key // max(1, len(self.terms)), key % max(1, len(self.terms))
            w = self.weigh(tf, pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False)[doc])
        if self.whole is not None:
            matrix = np.zeros((m, len(self.terms)))
            matrix[doc, term] = w
            got = (matrix @ self.whole).T
        else:
            n_of = np.diff(self.first)[term]
            src = np.repeat(np.arange(len(term)), n_of)
            k = np.arange(len(src)) - np.repeat(np.cumsum(n_of) - n_of, n_of) + self.first[term][src]
            got = np.bincount(self.query[k].astype(np.int64) * m + doc[src], w[src] * self.weight[k], n * m).reshape(n, m)
        return np.where(got > 0, np.round(got, 6), -np.inf)


def _bm25_weight(tf, dl, k1: float, b: float, mean: float):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


def _dampened(tf, dl):
    return np.round(1 + np.log(tf), 6)


HITS = "query_id long, node_id long, score double"


def _search(batches, side, k: int):
    """Within a partition, keeps the k best of what was seen for each query."""
    best, step = _Best(len(side.ids), k), max(1, CELLS // max(1, len(side.ids)))
    for b in batches:
        for at in range(0, b.num_rows, step):
            s = b.slice(at, step)
            best.add(side.score(s), s["node_id"].to_numpy())
    yield best.rows(side.ids)


def _blocked(queries: DataFrame, docs: DataFrame, make, k: int, numbers: int) -> DataFrame:
    """The k best documents of each query. make: a table of queries to what scores documents against them.

    `numbers` is the size of all queries; up to MOST_QUERIES of them go to every worker and documents stay where they are.
    More are cut into blocks, as the documents are, and every block of the one meets every block of the other.
    """
    spark = docs.sparkSession
    if not numbers:
        return top_k(spark.createDataFrame([], HITS), k)
    if numbers <= MOST_QUERIES:
        side = spark.sparkContext.broadcast(make(queries.orderBy("query_id").toArrow()))
        return top_k(docs.mapInArrow(lambda b: _search(b, side.value, k), HITS), k)
    nq, nd = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (docs, DOC_BLOCK)))
    block = lambda df, key, n, name, other, m: df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q, d = block(queries, "query_id", nq, "qb", "db", nd), block(docs, "node_id", nd, "db", "qb", nq)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        got = list(_search(y.combine_chunks().to_batches(), make(x), k)) if x.num_rows and y.num_rows else []
        return pa.Table.from_batches(got, pa.schema([("query_id", pa.int64()), ("node_id", pa.int64()), ("score", pa.float64())]))

    return top_k(q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInArrow(run, HITS), k)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, node_id, score, rank) by cosine. queries: (query_id, v), vectors: (node_id, v), ids whole numbers, vectors
    of one length. Null, all-zero and non-finite vectors take no part. A query finds itself where it is among the vectors."""
    fine = lambda d: d.where(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    queries, vectors = fine(queries.select(F.col("query_id").cast("long").alias("query_id"), "v")), fine(vectors.select(F.col("node_id").cast("long").alias("node_id"), "v"))
    numbers = queries.agg(F.sum(F.size("v"))).head()[0] or 0
    return _blocked(queries, vectors, _Dense, k, numbers)


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term), each term once."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def _lists(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, terms, weights) of rows (key, term, weight)."""
    pairs = F.array_sort(F.collect_list(F.struct("term", weight)))
    return rows.groupBy(key).agg(pairs.alias("p")).select(F.col(key).cast("long").alias(key), F.col("p.term").alias("terms"), F.col(f"p.{weight}").cast("array<double>").alias("weights"))


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, node_id, score, rank). queries: (query_id, text), docs: (node_id, text). Empty and null texts match nothing.

    A first pass over the documents counts in how many each term is; a second scores them where they are and sends on the k
    best of every task, so that no posting is shuffled. Scores are rounded to 6 places.
    """
    words = spread(docs).select(F.col("node_id").cast("long").alias("node_id"), tokens(F.col("text")).alias("terms"))
    every = F.when(F.size("terms") > 0, F.concat(F.array_distinct("terms"), F.array(F.lit(""))))  # a text counts under the empty term
    stats = cut(words.select(F.size("terms").alias("dl"), F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")))
    head = stats.where("term = ''").head()
    if head is None:
        return top_k(docs.sparkSession.createDataFrame([], HITS), k)
    terms = query_terms(queries)
    idf = F.log(1 + (F.lit(head["df"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = cut(_lists(terms.join(stats, "term").select("query_id", "term", idf.alias("w")), "query_id", "w"))
    numbers = weighed.agg(F.sum(F.size("terms"))).head()[0] or 0
    weigh = partial(_bm25_weight, k1=k1, b=b, mean=head["dl"] / head["df"])
    return _blocked(weighed, words, lambda t: _Sparse(t, weigh), k, numbers)


def sparse_text_top_k(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """`sparse_top_k` of texts (query_id, text) and (node_id, text) by their dampened term frequencies, 1 + ln(tf); the
    documents' are counted where they are."""
    words = spread(docs).select(F.col("node_id").cast("long").alias("node_id"), tokens(F.col("text")).alias("terms"))
    counted = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.round(1 + F.log(F.count("*")), 6).alias("w"))
    q = cut(_lists(counted, "query_id", "w"))
    numbers = q.agg(F.sum(F.size("terms"))).head()[0] or 0
    return _blocked(q, words, lambda t: _Sparse(t, _dampened), k, numbers)


def sparse_top_k(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, node_id, score, rank) by the dot product of sparse vectors (id, term, weight); of a term that an id has
    several times the greatest positive weight counts. The documents' terms come together by document once, and what is
    sent on are the k best of every task."""
    pool = lambda d, key: d.where("weight > 0").where(F.col(key).isNotNull() & F.col("term").isNotNull()).groupBy(key, "term").agg(F.max("weight").alias("weight"))
    q = _lists(pool(queries, "query_id"), "query_id", "weight")
    numbers = q.agg(F.sum(F.size("terms"))).head()[0] or 0
    return _blocked(q, _lists(pool(docs.repartition("node_id"), "node_id"), "node_id", "weight"), _Sparse, k, numbers)


def _scaled(hits: DataFrame, name: str) -> DataFrame:
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return hits.select("query_id", "node_id", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0).alias(name))


def hybrid(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """alpha times the dense and 1 - alpha times the sparse score, both brought to 0..1 within their query; a hit that one
    list lacks has 0 there, and where all scores are equal they are 0."""
    both = _scaled(dense, "d").join(_scaled(sparse, "s"), ["query_id", "node_id"], "full")
    score = F.round(alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0)), 6)
    return top_k(both.select("query_id", "node_id", score.alias("score")), k)


def rrf(lists: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (ranks from 1): the sum of 1 / (constant + rank); equal sums by the first list
    that has the hit, then by rank. An empty list leaves the others as they are."""
    parts = [d.select("query_id", "node_id", (F.lit(i) * 1_000_000_000 + F.col("rank")).cast("long").alias("seen"), (1.0 / (constant + F.col("rank"))).alias("part")) for i, d in enumerate(lists)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    fused = union.groupBy("query_id", "node_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min("seen").alias("seen"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "node_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "node_id", "score", "rank")


def overlap_score(query: Column, text: Column) -> Column:
    """The share of the query's distinct terms that the text has; the reranker used where no model is given."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, tokens(text))) / F.size(q), 6)).otherwise(0.0)


MOST_HITS = 500_000  # hits that may go to every worker for their documents to be picked there


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits joined to docs by node_id: where the hits are few they go to the documents, which then are not shuffled."""
    kept = cut(hits)
    return docs.join(F.broadcast(kept), "node_id") if kept.count() <= MOST_HITS else docs.join(kept, "node_id")


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, n: int = 5, scorer=overlap_score, most_chars: int | None = None) -> DataFrame:
    """The n best hits of each query by `scorer(query, text)` over the whole text, or its first `most_chars` for scorers that
    build a model prompt; a score that could not be had is 0, and hits of no query text keep their order."""
    q = queries.select("query_id", F.col("text").alias("__q"))
    t = docs.select("node_id", (F.col("text") if most_chars is None else F.substring("text", 1, most_chars)).alias("__t"))
    ranked = cut(hits.select("query_id", "node_id", F.col("rank").alias("__r")).join(q, "query_id", "left"))
    scores = with_documents(ranked, t).select("query_id", "node_id", scorer(F.col("__q"), F.col("__t")).alias("score"))
    scored = ranked.select("query_id", "node_id", "__r").join(scores, ["query_id", "node_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "__r", "node_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query_id", "node_id", "score", "rank")


def rerank_or_keep(hits: DataFrame, queries: DataFrame, docs: DataFrame, n: int = 5, scorer=overlap_score) -> DataFrame:
    """`rerank`, or the first n of the fused order where the scorer is missing or fails, with a warning."""
    if scorer is not None:
        try:
            return cut(rerank(hits, queries, docs, n, scorer))
        except Exception as e:  # noqa: BLE001  (a reranker that is down must not end the search)
            warnings.warn(f"reranker failed, fused order kept: {type(e).__name__}", stacklevel=2)
    return hits.where(F.col("rank") <= n).select("query_id", "node_id", "score", "rank")


RERANKERS = {"overlap": overlap_score, "none": None}


def reranker(kind: str | None, **scorers):
    """The scorer of that name among the given ones and the ones here; "none", and no name, stand for no reranking."""
    known = RERANKERS | scorers
    if (kind or "none").lower() not in known:
        raise ValueError(f"unknown reranker {kind!r}; known are {', '.join(sorted(known))}")
    return known[(kind or "none").lower()]


def at_least(cutoff: float):
    """A post-processor: hits of a lower score leave."""
    return lambda hits, queries: hits.where(F.col("score") >= cutoff)


def first(n: int):
    """A post-processor: the n best of each query."""
    return lambda hits, queries: hits.where(F.col("rank") <= n)


def post_process(hits: DataFrame, queries: DataFrame, chain) -> DataFrame:
    """The hits through post-processors (hits, queries) -> hits, one after the other; ranks are given anew behind each."""
    for step in chain:
        w = Window.partitionBy("query_id").orderBy("rank", F.desc("score"), "node_id")
        hits = step(hits, queries).withColumn("rank", F.row_number().over(w))
    return hits


def search_or_none(search, spark) -> DataFrame:
    """What `search()` finds; no hits, and a warning, where it fails."""
    try:
        return cut(search())
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"search failed: {type(e).__name__}", stacklevel=2)
        return spark.createDataFrame([], f"{HITS}, rank int")


def sources(hits: DataFrame, docs: DataFrame, preview: int = 200) -> DataFrame:
    """(query_id, index, node_id, doc_id, score, content): what an answer shows of its hits; long content is cut and marked."""
    content = F.when(F.length("text") > preview, F.concat(F.substring("text", 1, preview), F.lit("..."))).otherwise(F.col("text"))
    return with_documents(hits, docs.select("node_id", "doc_id", content.alias("content"))).select("query_id", F.col("rank").alias("index"), "node_id", "doc_id", "score", "content")


PROMPT = "Context information is below.\n%s\nAnswer the query from the context alone.\nQuery: %s\nAnswer: "


def answers(hits: DataFrame, queries: DataFrame, docs: DataFrame, complete=None) -> DataFrame:
    """(query_id, prompt, answer, sources): the hits' texts in order as context. `complete` maps the prompt column to an
    answer column, a model for instance; without one the answer is the best hit's first sentence."""
    hits = cut(hits)
    s = sources(hits, docs)
    full = with_documents(hits, docs.select("node_id", "text")).select("query_id", F.struct(F.col("rank"), F.col("text")).alias("h"))
    context = full.groupBy("query_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    listed = s.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "node_id", "doc_id", "score", "content"))).alias("sources"))
    prompt = F.format_string(PROMPT, F.array_join(F.transform("hs", lambda h: h["text"]), "\n\n"), F.col("text"))
    out = queries.select("query_id", "text").join(context, "query_id").join(listed, "query_id").withColumn("prompt", prompt)
    first = F.regexp_extract(F.element_at("hs", 1)["text"], r"(?s)\A\s*(.*?[.!?。！？])(\s|\z|(?<=。))", 1)
    return out.select("query_id", "prompt", (complete(F.col("prompt")) if complete else first).alias("answer"), "sources")


def evaluate(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(queries, hit_rate, mrr) over the queries of qrels (query_id, node_id): the share with a relevant hit among the first
    k, and the mean of the first one's reciprocal rank."""
    best = hits.where(F.col("rank") <= k).join(qrels, ["query_id", "node_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("r"))
    per = qrels.select("query_id").distinct().join(best, "query_id", "left")
    return per.agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("r").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))
