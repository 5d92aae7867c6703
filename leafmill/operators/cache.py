"""Results kept by the content they were made from: only what is new is computed."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def cache_key(content: Column, mode: Column, prompt: Column) -> Column:
    """md5 of the content, the mode and the first 8 figures of the md5 of the prompt."""
    return F.concat_ws("_", F.md5(content), mode, F.substring(F.md5(prompt), 1, 8))


def cached(rows: DataFrame, store: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with their results, what was new). store and what `compute` gives hold the key and the results; `compute` sees
    each missing key once. A null key has no result."""
    new = compute(rows.where(F.col(key).isNotNull()).join(store.select(key), key, "left_anti").dropDuplicates([key]))
    return rows.join(store.unionByName(new), key, "left"), new


def retry(call: Callable, times: int = 3, wait: float = 0.5):
    """The call's result; after a failure again, waiting twice as long each time, at last with its error."""
    for n in range(times):
        try:
            return call()
        except Exception:
            if n + 1 == times:
                raise
            time.sleep(wait * 2**n)
