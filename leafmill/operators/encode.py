"""Encoders: texts to sparse and dense vectors. Models are given as callables; the stand-ins here need none."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmill.functions.text import tokens


def sparse_vectors(docs: DataFrame, id_col: str = "node_id", text_col: str = "text") -> DataFrame:
    """(id, term, weight): the dampened term frequency of every term, 1 + ln(tf), rounded to 6 places."""
    t = docs.select(F.col(id_col), F.explode(tokens(F.col(text_col))).alias("term"))
    return t.groupBy(id_col, "term").agg(F.round(1 + F.log(F.count("*")), 6).alias("weight"))


def sparse_arrays(weights: DataFrame, id_col: str = "node_id", index: str = "token") -> DataFrame:
    """(id, indices, values): of every token the greatest positive weight, tokens ascending."""
    pooled = weights.where("weight > 0").groupBy(id_col, index).agg(F.max("weight").alias("weight"))
    pairs = F.array_sort(F.collect_list(F.struct(index, "weight")))
    return pooled.groupBy(id_col).agg(pairs.alias("p")).select(id_col, F.transform("p", lambda x: x[index]).alias("indices"), F.transform("p", lambda x: x["weight"]).alias("values"))


def hashed_vector(text: str, dim: int = 64) -> list[float]:
    """A unit vector of signed term counts in hashed places; all zero without terms."""
    import re

    import xxhash

    v = np.zeros(dim)
    for t in re.findall(r"[^\W_]+", text.lower()):
        h = xxhash.xxh3_64_intdigest(t)
        v[h % dim] += 1 if h >> 63 else -1
    n = np.sqrt((v * v).sum())
    return (v / n if n else v).astype(np.float32).tolist()


def encode(docs: DataFrame, encoder: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 12, id_col: str = "node_id", text_col: str = "text", vector_col: str = "embedding") -> DataFrame:
    """(id, embedding) of texts that are not null. encoder: texts to vectors, called with `batch` texts of similar length."""
    run = encoder or (lambda texts: [hashed_vector(t) for t in texts])
    kind = dict(docs.dtypes)[id_col]

    def work(batches):
        for b in batches:
            texts = b["t"].to_pylist()
            order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
            out: list = [None] * len(texts)
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                for k, v in zip(part, run([texts[k] for k in part])):
                    out[k] = v
            yield pa.record_batch({"i": b["i"], "v": pa.array(out, pa.list_(pa.float32()))})

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    return rows.mapInArrow(work, f"i {kind}, v array<float>").select(F.col("i").alias(id_col), F.col("v").alias(vector_col))


def fill_missing(docs: DataFrame, encoder=None, id_col: str = "node_id", text_col: str = "text", vector_col: str = "embedding") -> DataFrame:
    """The rows with vectors where they were null; only those rows are encoded."""
    new = encode(docs.where(F.col(vector_col).isNull()).dropDuplicates([id_col]), encoder, 12, id_col, text_col, "__v")
    return docs.join(new, id_col, "left").withColumn(vector_col, F.coalesce(vector_col, "__v")).drop("__v")


def compare(a: DataFrame, b: DataFrame, id_col: str = "node_id", vector_col: str = "embedding") -> DataFrame:
    """(vectors, worst, mean): absolute differences between two encodings of the same rows."""
    both = a.select(id_col, F.col(vector_col).alias("x")).join(b.select(id_col, F.col(vector_col).alias("y")), id_col)
    d = F.zip_with("x", "y", lambda p, q: F.abs(p.cast("double") - q.cast("double")))
    per = both.select(F.array_max(d).alias("m"), (F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d)).alias("a"))
    return per.agg(F.count("*").alias("vectors"), F.max("m").alias("worst"), F.avg("a").alias("mean"))
