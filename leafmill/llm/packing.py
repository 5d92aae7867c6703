"""Filling containers of fixed capacity with whole items: harmonic packing, independently in every worker.

An item of size s is of class k where it fits k, but not k + 1 times into the capacity. The containers of class k hold k items of
their class each, no more and no fewer, but for the last one of a worker. What the classes leave open is filled from a
pool of small items, those of all classes beyond the last one that is packed so; that one is chosen so that the pool suffices,
and is 1 at least. What is left of the pool makes containers of its own in the same way. Workers share nothing: a
worker is a hash range of the items. Items above the capacity give full containers and a rest, which is packed like any item.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def last_class(cls: np.ndarray, sizes: np.ndarray, capacity: int) -> int:
    """The last class whose containers, with those before, leave no more open than the items of later classes hold."""
    kinds, n = np.unique(cls, return_counts=True)  # ascending
    total = np.array([sizes[cls == k].sum() for k in kinds])
    open_ = np.cumsum(-(-n // kinds) * capacity - total)
    later = total.sum() - np.cumsum(total)
    fine = kinds[later >= open_]
    return int(fine.max()) if len(fine) else 1


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; sizes from 0 to capacity. Items of size 0 join the first container."""
    out = np.zeros(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    bins = 0
    while len(order):
        cls = capacity // sizes[order]
        last = max(int(cls.min()), last_class(cls, sizes[order], capacity))
        pool = order[cls > last]
        pool_size, pool_id = sizes[pool].tolist(), pool.tolist()  # ascending
        for k in np.unique(cls[cls <= last]):
            own = order[cls == k][::-1]
            for at in range(0, len(own), k):
                mine = own[at : at + k]
                out[mine] = bins
                room = capacity - int(sizes[mine].sum())
                while room and pool_size and pool_size[0] <= room:
                    x = bisect_right(pool_size, room) - 1
                    room -= pool_size.pop(x)
                    out[pool_id.pop(x)] = bins
                bins += 1
        order = np.array(pool_id, np.int64)
    return out


def _pack(t: pa.Table) -> pa.Table:
    capacity, shard = t["capacity"][0].as_py(), t["shard"][0].as_py()
    ids, tokens = t["id"].to_numpy(), t["tokens"].to_numpy()
    order = np.lexsort((ids, tokens))
    ids, tokens = ids[order], tokens[order]
    full = tokens // capacity
    full[(tokens > 0) & (tokens % capacity == 0)] -= 1  # the last full part is the rest
    rest = tokens - full * capacity
    bins = pack(rest, capacity)
    used = int(bins.max()) + 1 if len(bins) else 0
    who = np.repeat(np.arange(len(ids)), full)
    part = np.arange(len(who)) - np.repeat(np.cumsum(full) - full, full)
    container = np.concatenate([bins, used + np.arange(len(who))])
    n = len(container)
    return pa.table({
        "pack_id": pa.array(np.full(n, t["pack_id"][0].as_py()), pa.int32()), "capacity": pa.array(np.full(n, capacity), pa.int32()),
        "container": pa.array((np.int64(shard) << 32) + container, pa.int64()), "id": pa.array(np.concatenate([ids, ids[who]]), pa.int64()),
        "part": pa.array(np.concatenate([full, part]), pa.int32()), "tokens": pa.array(np.concatenate([rest, np.full(len(who), capacity)]), pa.int64()),
    })


def pack_items(sizes: DataFrame, capacities: list[tuple[int, int]], rows: int, per_worker: int = 20_000) -> DataFrame:
    """(pack_id, capacity, container, id, part, tokens): for each (pack_id, capacity), every item's container.

    sizes: (id, tokens). Items are whole, in part 0, unless larger than the capacity: then parts 0, 1, ... are consecutive
    and all but the last fill their container. Ids given twice count once, null ids not; null sizes are 0; capacities below 1 are an error.
    rows: about how many items; it sets the number of workers.
    """
    if any(c is None or c < 1 for _, c in capacities):
        raise ValueError("capacities must be at least 1")
    if not capacities:
        return sizes.sparkSession.createDataFrame([], "pack_id int, capacity int, container long, id long, part int, tokens long")
    packs = F.explode(F.array(*(F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("int").alias("capacity")) for p, c in capacities)))
    shards = max(1, -(-rows // per_worker))
    items = sizes.where("id is not null").groupBy("id").agg(F.greatest(F.max("tokens"), F.lit(0)).cast("long").alias("tokens"))
    items = items.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).select("id", "tokens", "shard", packs.alias("p")).select("id", "tokens", "shard", "p.*")
    return items.groupBy("pack_id", "shard").applyInArrow(_pack, "pack_id int, capacity int, container long, id long, part int, tokens long")


def fill(packed: DataFrame) -> DataFrame:
    """(pack_id, capacity, containers, tokens, fill): how full the containers are."""
    per = packed.groupBy("pack_id", "capacity", "container").agg(F.sum("tokens").alias("t"))
    total = per.groupBy("pack_id", "capacity").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return total.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
