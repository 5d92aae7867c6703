"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Every source becomes a stream of blocks of equal size. Block j of a source with share u is released at j / u and due at
(j + 1) / u; in each slot the released block with the earliest deadline runs, so that at any time every source is within
one block of its share. The schedule is made once for a period, in which a source has a whole number of slots; sources too
small for that share the slots of a bundle, within which they take turns by a schedule of their own, and so on. A document
finds its slot from its offset in its source's stream. Offsets are sums by blocks of a hash range, then within it.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F


@dataclass(frozen=True)
class Share:
    source: str
    weight: float
    cap: int | None
    size: int  # of one pass over its documents
    quota: float
    share: float


def schedule(shares: list[float], slots: int = 65_536) -> list[list[int]]:
    """For each share the slots of one period that it gets, by earliest deadline first. Shares sum to 1 and get one slot at least."""
    slots = max(slots, len(shares))
    want = [s * slots for s in shares]
    n = [max(1, int(w)) for w in want]
    order = sorted(range(len(n)), key=lambda i: n[i] - want[i])  # largest remainders
    k = 0
    while (left := slots - sum(n)) != 0:
        for i in order[k:] if left > 0 else order[::-1]:
            if left and (left > 0 or n[i] > 1):
                n[i] += 1 if left > 0 else -1
                left -= 1 if left > 0 else -1
    out: list[list[int]] = [[] for _ in n]
    later = [(0, i) for i in range(len(n))]  # (release, source)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    heapq.heapify(later)
    for t in range(slots):
        while later and later[0][0] <= t:
            _, i = heapq.heappop(later)
            heapq.heappush(ready, (-(-(len(out[i]) + 1) * slots // n[i]), i))
        _, i = heapq.heappop(ready)
        out[i].append(t)
        if len(out[i]) < n[i]:
            heapq.heappush(later, (len(out[i]) * slots // n[i], i))
    return out


def levels(shares: dict[str, float], slots: int = 65_536, least: int = 32) -> tuple[list[list[tuple[str, str, int, list[int]]]], dict[str, float]]:
    """(schedules from the innermost to the outermost, each of (node, parent, period, slots of the node in the parent's period);
    for the rarest sources, how many slots lie between two of their blocks).

    Sources with fewer than `least` slots are bundled, the smallest first, into nodes that have as many. Those that are too few
    for a bundle, together below `least` slots, take none: their blocks are put where they are due.
    """
    found: dict[int, list] = {}

    def make(members: dict[str, float], parent: str, depth: int) -> dict[str, float]:
        whole = sum(members.values())
        size = slots if depth == 0 else max(2 * least, min(slots, 2 * least * len(members)))
        nodes, bundles, held, rare = {s: u for s, u in members.items() if u / whole * size >= least}, [{}], 0.0, {}
        for s in sorted(members.keys() - nodes.keys(), key=lambda s: (members[s], s)):
            bundles[-1][s], held = members[s], held + members[s]
            if held / whole * size >= least:
                bundles.append({})
                held = 0.0
        *full, rest = bundles
        if depth == 0:
            rare = rest
        elif full:
            full[-1] |= rest
        else:
            nodes |= rest
        for k, b in enumerate(full):
            if len(b) == 1:
                nodes |= b
            else:
                nodes[f"{parent}\x00{k}"] = sum(b.values())
                make(b, f"{parent}\x00{k}", depth + 1)
        names, all_ = sorted(nodes), sum(nodes.values())
        pattern = schedule([nodes[s] / all_ for s in names], size)
        found.setdefault(depth, []).extend((s, parent, sum(map(len, pattern)), p) for s, p in zip(names, pattern))
        return {s: all_ / u for s, u in rare.items()}

    every = make(shares, "", 0)
    return [found[d] for d in sorted(found, reverse=True)], every


def quotas(targets: list[tuple[str, float, int | None]], sizes: dict[str, int], total: float | None = None) -> list[Share]:
    """The size each source contributes. Sources without documents or weight contribute nothing; the others' weights are
    taken relative to each other. Without `total` the mix is the largest in which all shares are met; with it, a source
    that its cap keeps below its share gives all it may, and the rest is shared by the others."""
    live = {s: (w, c) for s, w, c in targets if s is not None and w and w > 0 and sizes.get(s, 0) > 0 and (c is None or c > 0)}
    most = {s: math.inf if c is None else c * sizes[s] for s, (w, c) in live.items()}
    weight = sum(w for w, _ in live.values())
    if total is None:
        reach = [most[s] * weight / w for s, (w, _) in live.items() if most[s] < math.inf]
        total = min(reach) if reach else sum(sizes[s] for s in live)
    quota, open_, left = {}, dict(live), float(total)
    while open_:
        w = sum(x for x, _ in open_.values())
        over = [s for s, (x, _) in open_.items() if left * x / w > most[s] * (1 + 1e-12)]
        if not over:
            quota |= {s: left * x / w for s, (x, _) in open_.items()}
            break
        for s in over:
            quota[s] = most[s]
            open_.pop(s)
        left = float(total) - sum(quota.values())
    whole = sum(quota.values()) or 1.0
    return [Share(s, w, c, sizes[s], quota[s], quota[s] / whole) for s, (w, c) in sorted(live.items())]


def mix(sizes: DataFrame, targets: DataFrame, rows: int, total: float | None = None, block: int = 8192, most_sources: int = 10_000, per_range: int = 50_000) -> tuple[DataFrame, list[Share]]:
    """(id, source, repeat, tokens, slot, offset) of the mixed sequence, to be read by slot and offset; the shares behind it.

    sizes: (id, source, tokens), one row an id; documents of no token, of no source or of a source without a weight are
    not used. Each document comes at most its source's cap of times; all repeats but the last use the whole source.
    """
    spark = sizes.sparkSession
    listed = [(r["source"], r["weight"], r["max_repeats"]) for r in targets.select("source", "weight", "max_repeats").limit(most_sources + 1).collect()]
    if len(listed) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    schema = "id long, source string, repeat int, tokens long, slot long, offset long"
    names = [s for s, w, _ in listed if s is not None and w and w > 0]
    docs = sizes.select("id", "source", "tokens").where("id is not null").where(F.col("source").isin(names) & (F.col("tokens") > 0))
    ranges = max(1, -(-rows // per_range)) * 16
    docs = docs.withColumn("h", F.xxhash64("id")).withColumn("r", F.pmod("h", F.lit(ranges)).cast("int"))
    per_block = docs.groupBy("source", "r").agg(F.sum("tokens").alias("t"))
    totals = {r["source"]: int(r["t"]) for r in per_block.groupBy("source").agg(F.sum("t").alias("t")).collect()}
    shares = quotas(listed, totals, total)
    if not shares:
        return spark.createDataFrame([], schema), shares
    plan = spark.createDataFrame([(s.source, s.size, int(s.quota // s.size), s.quota - (s.quota // s.size) * s.size) for s in shares], "source string, size long, full int, rest double")
    before = per_block.withColumn("base", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "r", "base")
    inside = F.sum("tokens").over(Window.partitionBy("source", "r").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    placed = docs.withColumn("inside", inside).join(before, ["source", "r"]).withColumn("at", F.col("base") + F.col("inside")).join(F.broadcast(plan), "source")
    times = F.col("full") + F.when(F.col("at") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    rows_ = placed.withColumn("times", times).where("times > 0").select("id", "source", "tokens", "at", "size", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("repeat"))
    rows_ = rows_.withColumn("offset", (F.col("repeat") - 1) * F.col("size") + F.col("at")).withColumns({"slot": F.floor(F.col("offset") / block), "node": F.col("source")})
    nested, rare = levels({s.source: s.share for s in shares})
    every = spark.createDataFrame(list(rare.items()), "source string, every double")
    rows_ = rows_.join(F.broadcast(every), "source", "left").withColumn("slot", F.when(F.col("every").isNotNull(), F.floor((F.col("slot") + 0.5) * F.col("every"))).otherwise(F.col("slot"))).drop("every")
    for nodes in nested:
        size = spark.createDataFrame([(s, p, t, len(x)) for s, p, t, x in nodes], "node string, parent string, period long, n long")
        turn = spark.createDataFrame([(s, k, v) for s, _, _, x in nodes for k, v in enumerate(x)], "node string, k long, v long")
        rows_ = rows_.join(F.broadcast(size), "node", "left").withColumn("k", F.col("slot") % F.col("n")).join(F.broadcast(turn), ["node", "k"], "left")
        rows_ = rows_.withColumns({"slot": F.coalesce(F.floor(F.col("slot") / F.col("n")) * F.col("period") + F.col("v"), F.col("slot")), "node": F.coalesce("parent", "node")}).drop("parent", "period", "n", "k", "v")
    return rows_.select("id", "source", "repeat", "tokens", F.col("slot").cast("long").alias("slot"), F.col("offset").cast("long").alias("offset")), shares


def report(mixed: DataFrame, targets: DataFrame, shares: list[Share]) -> DataFrame:
    """(source, weight, target_share, reachable_share, tokens, documents, repeats, actual_share) of every listed source.

    target_share is relative to all positive weights, reachable_share to those of sources that have documents.
    """
    spark = mixed.sparkSession
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("repeat").alias("repeats"))
    reach = spark.createDataFrame([(s.source, s.share) for s in shares], "source string, reachable_share double")
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    listed = targets.select("source", weight.alias("weight"))
    whole, used = listed.agg(F.sum("weight").alias("all_weights")), got.agg(F.sum("tokens").alias("all_tokens"))
    out = listed.join(got, "source", "left").join(reach, "source", "left").join(F.broadcast(whole)).join(F.broadcast(used))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("source", "weight", (F.col("weight") / F.col("all_weights")).alias("target_share"), zero("reachable_share").cast("double").alias("reachable_share"), zero("tokens").cast("long").alias("tokens"), zero("documents").cast("long").alias("documents"), zero("repeats").cast("int").alias("repeats"), (zero("tokens") / F.col("all_tokens")).alias("actual_share"))
