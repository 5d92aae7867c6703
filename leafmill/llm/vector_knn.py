"""The k most similar vectors of every vector: an inverted file with product-quantised residuals.

A coarse quantiser and the product quantiser of the residuals are fitted on a bounded sample; every vector is indexed.
Every vector is held by its nearest cells and searches its nearest cells. Scores come from asymmetric inner-product
tables of the full-precision query against the codes; the best `rerank` of each cell are reranked by their exact cosine.

Vectors that are equal form one class, so that a group of copies of any size costs as one vector. Cells that hold more
than `block` vectors are split: their queries into blocks, their candidates into blocks, one task for a pair of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


@dataclass(frozen=True)
class KnnConfig:
    """dim: length of sound vectors. cell: vectors a cell should have; at most max_cells cells. sample: vectors the
    quantisers are fitted on, at least 16 a cell and at most max_sample. assign: cells that hold a
    vector. probe: cells searched for a vector. parts: bytes
    of a code. rerank: candidates whose exact cosine is taken. block: most vectors of a cell that one task reads as
    queries, and as candidates."""

    dim: int = 64
    k: int = 5
    cell: int = 1024
    max_cells: int = 16384
    sample: int = 20_000
    max_sample: int = 262_144
    assign: int = 2
    probe: int = 4
    parts: int = 8
    rerank: int = 16
    block: int = 8192
    rounds: int = 8
    seed: int = 7


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = n > 0
        c[full] = np.add.reduceat(x[order], start[full], axis=0) / n[full, None]
        if not full.all():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c.astype(np.float32)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half, out = (c * c).sum(1) / 2, np.empty(len(x), np.int64)
    for at in range(0, len(x), 2048):
        out[at : at + 2048] = (x[at : at + 2048] @ c.T - half).argmax(1)
    return out


def _nearest_few(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres, nearest first."""
    half, n, out = (c * c).sum(1) / 2, min(n, len(c)), []
    for at in range(0, len(x), 2048):
        s = half - x[at : at + 2048] @ c.T
        best = np.argpartition(s, n - 1, axis=1)[:, :n]
        out.append(np.take_along_axis(best, np.argsort(np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


class Index:
    """The fitted quantisers; bounded by max_cells, whatever the number of vectors."""

    def __init__(self, sample: np.ndarray, rows: int, cfg: KnnConfig):
        rng = np.random.default_rng(cfg.seed)
        self.cfg = cfg
        cells = max(1, min(cfg.max_cells, rows // cfg.cell, len(sample) // 4))
        self.centre = _kmeans(sample, cells, cfg.rounds, rng)
        own = _nearest(sample, self.centre)
        rest = (sample - self.centre[own]).reshape(len(sample), cfg.parts, -1)
        self.book = np.stack([_kmeans(np.ascontiguousarray(rest[:, j]), min(256, len(sample)), cfg.rounds, rng) for j in range(cfg.parts)])
        few = _nearest_few(sample, self.centre, cfg.assign)
        share = np.bincount(few.ravel(), minlength=len(self.centre)) / max(1, len(sample))
        self.split = np.maximum(1, np.ceil(share * rows / cfg.block)).astype(np.int64)

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = (x - self.centre[own]).reshape(len(x), self.cfg.parts, -1)
        return np.stack([_nearest(np.ascontiguousarray(rest[:, j]), self.book[j]) for j in range(self.cfg.parts)], 1).astype(np.uint8)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


TILE = "cell int, part int, kind int, home binary, ids binary, x binary, code binary"
BOTH, ASKS, OFFERED = 0, 1, 2


def _scatter(batches, index: Index):
    """Sends every vector to its nearest cells: as a candidate to the first `assign`, as a query to the first `probe`."""
    cfg = index.cfg
    for b in batches:
        if not b.num_rows:
            continue
        ids = b["rep"].to_numpy(zero_copy_only=False).astype(np.int64)
        x = _unit(b["v"], cfg.dim)
        near = _nearest_few(x, index.centre, max(cfg.probe, cfg.assign))
        home = near[:, 0].astype(np.int32)
        rows = {c: [] for c in ("cell", "part", "kind", "home", "ids", "x", "code")}
        for rank in range(near.shape[1]):
            own = near[:, rank]
            code = index.encode(x, own) if rank < cfg.assign else None
            order = np.argsort(own, kind="stable")
            at = np.searchsorted(own[order], np.arange(len(index.centre) + 1))
            for c in np.unique(own):
                mine, n = order[at[c] : at[c + 1]], int(index.split[c])
                salt = _salt(ids[mine], n)
                for j in range(n):
                    m = mine[salt == j] if n > 1 else mine
                    if not len(m):
                        continue
                    row = (home[m].tobytes(), ids[m].tobytes(), x[m].tobytes(), b"" if code is None else code[m].tobytes())
                    if n == 1 and rank < min(cfg.assign, cfg.probe):
                        targets = [(0, BOTH)]
                    else:
                        targets = [(j * MANY + g, ASKS) for g in range(n) if rank < cfg.probe] + [(s * MANY + j, OFFERED) for s in range(n) if rank < cfg.assign]
                    for part, kind in targets:
                        for name, value in zip(rows, (c, part, kind, *row)):
                            rows[name].append(value)
        yield pa.record_batch({c: pa.array(rows[c], pa.int32() if c in ("cell", "part", "kind") else pa.binary()) for c in rows})


def _search(t: pa.Table, index: Index) -> pa.Table:
    """The best candidates of a cell, or of a part of it, for each of its queries; a row for each home cell."""
    cfg, rows = index.cfg, t.to_pydict()
    read = lambda c, kind, which: np.concatenate([np.frombuffer(rows[c][k], kind) for k in which])
    cand = [k for k, s in enumerate(rows["kind"]) if s != ASKS]
    ask = [k for k, s in enumerate(rows["kind"]) if s != OFFERED]
    if not cand or not ask:
        return _found([], [], [], [])
    ids, x = read("ids", np.int64, cand), read("x", np.float32, cand).reshape(-1, cfg.dim)
    code = read("code", np.uint8, cand).reshape(-1, cfg.parts)
    qi, q, home = read("ids", np.int64, ask), read("x", np.float32, ask).reshape(-1, cfg.dim), read("home", np.int32, ask)
    columns, out = [np.ascontiguousarray(code[:, j]) for j in range(cfg.parts)], []
    step = max(16, 2_000_000 // len(ids))
    for at in range(0, len(qi), step):
        v, who = q[at : at + step], qi[at : at + step]
        sub = v.reshape(len(v), cfg.parts, -1)
        score = np.zeros((len(v), len(ids)), np.float32)  # of the residuals: the centre adds the same to all candidates
        for j in range(cfg.parts):
            score += np.take(sub[:, j] @ index.book[j].T, columns[j], axis=1)
        r = min(cfg.rerank + 1, len(ids))
        best = np.argpartition(score, len(ids) - r, axis=1)[:, len(ids) - r :]
        exact = np.einsum("qrd,qd->qr", x[best], v).astype(np.float64)
        nid = ids[best]
        exact[nid == who[:, None]] = -np.inf
        order = np.lexsort((nid, -exact), axis=1)[:, : cfg.k]
        top, nid = np.take_along_axis(exact, order, 1), np.take_along_axis(nid, order, 1)
        keep = np.isfinite(top)
        out.append((np.repeat(home[at : at + step], top.shape[1])[keep.ravel()], np.repeat(who, top.shape[1])[keep.ravel()], nid[keep], top[keep]))
    h, q, n, cosine = (np.concatenate(c) for c in zip(*out))
    part = np.zeros(len(h), np.int64)
    for c in np.flatnonzero(index.split > 1):
        m = h == c
        part[m] = _salt(q[m], int(index.split[c]))
    key = h.astype(np.int64) * MANY + part
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
    groups = np.split(order, cuts[1:]) if len(cuts) else []
    return _found([int(key[g[0]]) for g in groups], *([c[g].tobytes() for g in groups] for c in (q, n, cosine)))


def _found(home, q, n, cosine) -> pa.Table:
    return pa.table({"home": pa.array(home, pa.int64()), **{c: pa.array(v, pa.binary()) for c, v in (("q", q), ("n", n), ("cosine", cosine))}})


def _merge(t: pa.Table, k: int) -> pa.Table:
    """The k best of what the cells found for the queries of one home cell."""
    q, n = (np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in t[c]]) for c in ("q", "n"))
    cosine = np.concatenate([np.frombuffer(b.as_buffer(), np.float64) for b in t["cosine"]])
    order = np.lexsort((n, q))
    q, n, cosine = q[order], n[order], cosine[order]
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (n[1:] != n[:-1])])[: len(q)]
    q, n, cosine = q[new], n[new], cosine[new]
    order = np.lexsort((n, -cosine, q))
    q, n, cosine = q[order], n[order], cosine[order]
    start = np.maximum.accumulate(np.where(np.concatenate([[True], q[1:] != q[:-1]])[: len(q)], np.arange(len(q)), 0))
    keep = np.arange(len(q)) - start < k
    return pa.table({"q": q[keep], "n": n[keep], "cosine": cosine[keep]})


def _salt(ids: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


MANY = 100_000


def sound(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v): rows whose vector has `dim` numbers, all finite and not all zero."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where("id is not null").where((F.size("v") == dim)).where(fine & F.exists("v", lambda x: x != 0))


def nearest_vectors(df: DataFrame, id_col: str = "node_no", vector_col: str = "embedding", rows: int | None = None, cfg: KnnConfig = KnnConfig()) -> DataFrame:
    """(id, neighbour, cosine, rank): for every sound vector its k most similar others, best first.

    Null, empty, too short or long, all-zero and non-finite vectors are neither asked for nor found; length does not
    matter. Ids delivered twice count once. Ties go to the smaller id; of a group of equal vectors that is larger than k,
    the smallest ids are the neighbours. Fewer than k others give fewer rows; an empty table gives none.
    """
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    fine = sound(df, id_col, vector_col, cfg.dim)
    cells = max(1, min(cfg.max_cells, rows // cfg.cell))
    bound = min(cfg.max_sample, max(cfg.sample, 16 * cells))
    part = min(1.0, 1.2 * bound / max(1, rows))
    picked = fine.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(part * (1 << 20))).select("v").limit(bound).toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], "id long, neighbour long, cosine double, rank int")
    index = spark.sparkContext.broadcast(Index(_unit(picked["v"].combine_chunks(), cfg.dim), rows, cfg))
    classes = fine.groupBy("v").agg(F.min("id").cast("long").alias("rep"))
    tiles = classes.select("rep", "v").mapInArrow(lambda b: _scatter(b, index.value), TILE)
    found = tiles.groupBy("cell", "part").applyInArrow(lambda t: _search(t, index.value), "home long, q binary, n binary, cosine binary")
    found = found.groupBy("home").applyInArrow(lambda t: _merge(t, cfg.k), "q long, n long, cosine double")
    best = lambda d, key: d.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cosine"), "n"))).where(F.col("rank") <= cfg.k)
    keyed = fine.select(F.col("id").cast("long").alias("id"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(17), "v").alias("h2")).distinct()
    size = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("m")).where("m > 1")
    copies = keyed.join(size, ["h1", "h2"]).select("id", "rep")  # only of vectors that more than one id has
    offers = copies.withColumn("o", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("o") <= cfg.k + 1).select("rep", F.col("id").alias("offer"))
    within = copies.join(offers, "rep").where("id <> offer").select("id", F.col("offer").alias("n"), F.lit(1.0).alias("cosine"))
    given = found.join(offers, found["n"] == offers["rep"], "left").select("q", F.coalesce("offer", "n").alias("n"), "cosine")
    asked = given.join(copies, given["q"] == copies["rep"], "left").select(F.coalesce("id", "q").alias("id"), "n", "cosine")
    return best(asked.unionByName(within), "id").select("id", F.col("n").alias("neighbour"), "cosine", "rank")
