"""Sizes of texts in tokens of a public byte-level tokenizer; the vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts text into words before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches, path: str, text_col: str):
    encode = encoder(path).encode_ordinary
    for b in batches:
        k = b.schema.get_field_index(text_col)
        n = pa.array([len(encode(t)) if t else 0 for t in b.column(k).to_pylist()], pa.int64())
        keep = [i for i in range(b.num_columns) if i != k]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), n], names=[*(b.schema.names[i] for i in keep), "tokens"])


def token_sizes(df: DataFrame, *keep: str, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and tokens, the size of the whole text; 0 for null and empty texts."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "tokens long"])
    return df.select(*keep, F.col(text_col)).mapInArrow(lambda b: _count(b, path, text_col), schema)
