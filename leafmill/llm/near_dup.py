"""Near-duplicate texts: a blocked sparse product of documents by n-grams with size-derived bounds.

The similarity of two texts is the Jaccard similarity of their sets of distinct word n-grams. Texts are cut into
blocks; the product of the document x n-gram incidence matrix with its transpose is evaluated tile by tile, only
over the rare n-grams that a pair at the threshold must share, and pairs whose accumulated overlap plus the most
that their remaining n-grams can add stays below the bound are discarded. An exact check of the survivors follows.

Steps: (A) every text block sends each distinct n-gram once, with a count, to the n-gram's bucket; (B) buckets add up
document frequencies and answer every block; (C) blocks order the n-grams of each text rare-first and post those of
its prefix; frequent n-grams are spread over tiles of documents; (D) tiles accumulate overlaps of pairs; (E) partial
overlaps are summed and bounded: what the prefixes do not show is at most what lies behind the prefix that ends first;
(F) the blocks send the n-grams of the survivors, which are compared exactly. Any total order of n-grams gives the same
result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from leafmill.tables import cut

WORD = re.compile(r"[^ \t\r\n]+")
EPS = 1e-9


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def incidence(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index and n-gram of every distinct (document, n-gram), sorted by both; n-grams of each document."""
    h = xxhash.xxh3_64_intdigest
    words, ends = [], []
    for t in texts:
        words.extend(map(h, WORD.findall(t.lower())))
        ends.append(len(words))
    ends = np.array(ends, dtype=np.int64)
    lens = np.diff(ends, prepend=0)
    if len(words) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    w = np.array(words, dtype=np.uint64)
    doc = np.repeat(np.arange(len(texts)), lens)
    last = len(w) - width + 1
    with np.errstate(over="ignore"):
        g = np.zeros(last, np.uint64)
        for k in range(width):
            g = _mix(g * np.uint64(0x9E3779B97F4A7C15) + w[k : k + last])
    keep = doc[:last] == doc[width - 1 : width - 1 + last]
    g, doc = g[keep], doc[:last][keep]
    order = np.argsort(g, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return doc, g, np.bincount(doc, minlength=len(texts))


def _cut(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by key, the keys that occur and the bounds of their ranges in that order."""
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    return order, keys, np.append(first, len(key))


def _bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(g + np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def _bytes(column) -> list:
    return [x.as_buffer() for x in column]


class _Product:
    """The settings and the steps that run on executors."""

    def __init__(self, width: int, threshold: float, buckets: int, tile: int, slack: float):
        self.width, self.t, self.buckets, self.tile, self.slack = width, threshold, buckets, tile, slack

    def need(self, na, nb):
        return np.ceil(self.t / (1 + self.t) * (na + nb) - EPS)

    def _distinct(self, g: np.ndarray):
        """The distinct n-grams of a block in the order of their buckets, their counts, the buckets and their bounds."""
        g, n = np.unique(g, return_counts=True)
        order, buckets, at = _cut(_bucket(g, self.buckets))
        return g[order], n[order], buckets, at

    def count(self, block: pa.Table) -> pa.Table:
        """Step A."""
        g, n, buckets, at = self._distinct(incidence(block["text"].to_pylist(), self.width)[1])
        n, parts = n.astype(np.uint32), range(len(buckets))
        own = block["block"][0].as_py()
        return pa.table({
            "bucket": pa.array(buckets, pa.int32()), "block": pa.array([own] * len(buckets), pa.int32()),
            "g": pa.array([g[at[k] : at[k + 1]].tobytes() for k in parts], pa.binary()),
            "n": pa.array([n[at[k] : at[k + 1]].tobytes() for k in parts], pa.binary()),
        })

    def frequency(self, rows: pa.Table) -> pa.Table:
        """Step B: answers with the number of texts that have each n-gram, in the order in which the block sent them."""
        parts = [np.frombuffer(x, np.uint64) for x in _bytes(rows["g"])]
        g = np.concatenate(parts)
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in _bytes(rows["n"])]).astype(np.int64)
        order = np.argsort(g, kind="stable")
        s = g[order]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        df = np.empty(len(g), np.int64)
        df[order] = np.repeat(np.add.reduceat(n[order], start), np.diff(np.append(start, len(s))))
        df = np.minimum(df, 2**32 - 1).astype(np.uint32)
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({"bucket": rows["bucket"], "block": rows["block"], "n": pa.array([df[e - len(p) : e].tobytes() for p, e in zip(parts, ends)], pa.binary())})

    def post(self, block: pa.Table, answers: pa.Table) -> pa.Table:
        """Step C."""
        empty = pa.table({"bucket": pa.array([], pa.int32()), "docs": pa.array([], pa.binary()), "rows": pa.array([], pa.binary())})
        if not block.num_rows or not answers.num_rows:
            return empty
        reps = np.array(block["rep"].to_pylist(), dtype=np.int64)
        doc, g, n = incidence(block["text"].to_pylist(), self.width)
        known, _, buckets, at = self._distinct(g)
        often, place = np.zeros(len(known), np.int64), {b: k for k, b in enumerate(buckets.tolist())}
        for b, x in zip(answers["bucket"].to_pylist(), _bytes(answers["n"])):
            k = place[b]
            often[at[k] : at[k + 1]] = np.frombuffer(x, np.uint32)
        order = np.argsort(known)
        df = often[order][np.searchsorted(known[order], g)]
        shared = df > 1
        single = n - np.bincount(doc[shared], minlength=len(n))
        doc, g, df = doc[shared], g[shared], df[shared]
        order = np.lexsort((g, df, doc))
        doc, g, df = doc[order], g[order], df[order]
        start = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))])
        pos = np.arange(len(doc)) - start[doc] + single[doc]
        keep = pos < self.posted(n[doc])
        doc, g, df, pos = doc[keep], g[keep], df[keep], pos[keep]
        tiles = -(-df // self.tile)
        rec = np.zeros(len(doc), dtype=POSTING)
        rec["key"], rec["doc"], rec["pos"], rec["side"] = g, doc, pos, 2
        out = [rec[tiles == 1]]
        if (tiles > 1).any():
            hot, k = rec[tiles > 1], tiles[tiles > 1]
            own = (_mix(reps[hot["doc"]].astype(np.uint64)) % k.astype(np.uint64)).astype(np.int64)
            for j in range(int(k.max())):
                m = j < k
                part, o = hot[m].copy(), own[m]
                lo, hi = np.minimum(o, j), np.maximum(o, j)
                part["side"] = np.where(lo == hi, 2, (o > j).astype(np.int64))
                with np.errstate(over="ignore"):
                    part["key"] = _mix(part["key"] + (lo * 1_000_003 + hi + 1).astype(np.uint64))
                out.append(part)
        rec = np.concatenate(out)
        order, buckets, at = _cut(_bucket(rec["key"], self.buckets))
        rec, docs, rows = rec[order], [], []
        info = np.zeros(len(n), DOC)
        info["doc"], info["n"], info["single"], info["block"] = reps, n, single, block["block"][0].as_py()
        for k in range(len(buckets)):
            r = rec[at[k] : at[k + 1]].copy()
            own, r["doc"] = np.unique(r["doc"], return_inverse=True)
            docs.append(info[own].tobytes())
            rows.append(b"".join(np.ascontiguousarray(r[c]).tobytes() for c in POSTING.names))
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "docs": pa.array(docs, pa.binary()), "rows": pa.array(rows, pa.binary())})

    def posted(self, n):
        """How many of a text's n-grams, rarest first, a text at the threshold must share one of."""
        return n - np.ceil(self.t * n - EPS) + 1

    def reach(self, n, other, need):
        """How many of a text's n-grams count for a pair: `slack` more than needed for one to be shared."""
        return np.minimum(self.posted(n), n - need + 1 + np.ceil(self.slack * np.minimum(n, other)))

    def multiply(self, rows: pa.Table) -> pa.Table:
        """Step D: overlaps of the pairs of a bucket, for each of its n-grams or tiles."""
        docs, recs, at = [], [], 0
        for d, x in zip(_bytes(rows["docs"]), _bytes(rows["rows"])):
            d = np.frombuffer(d, DOC)
            r = np.zeros(len(x) // POSTING.itemsize, POSTING)
            o = 0
            for c in POSTING.names:
                size = POSTING[c].itemsize * len(r)
                r[c] = np.frombuffer(x, POSTING[c], len(r), o)
                o += size
            r["doc"] += at
            at += len(d)
            docs.append(d)
            recs.append(r)
        r, d = np.concatenate(recs), np.concatenate(docs)
        r = r[np.argsort(r["key"], kind="stable")]
        key, pos, side, own = r["key"].copy(), r["pos"].astype(np.int64), r["side"].copy(), r["doc"].astype(np.int64)
        doc, n, block, single = (d[c][own] for c in ("doc", "n", "block", "single"))
        n = n.astype(np.int64)
        before, behind = pos - single, n - pos - 1
        found, held = [], 0
        i = np.arange(len(r) - 1)
        for o in range(1, len(r)):
            i = i[i + o < len(r)]
            i = i[key[i] == key[i + o]]
            if not len(i):
                break
            j = i + o
            need = self.need(n[i], n[j])
            most = 1 + np.minimum(before[i], before[j]) + np.minimum(behind[i], behind[j])
            m = (most >= need) & (np.minimum(n[i], n[j]) >= need) & (doc[i] != doc[j]) & ((side[i] == 2) | (side[i] != side[j]))
            m &= (pos[i] < self.reach(n[i], n[j], need)) & (pos[j] < self.reach(n[j], n[i], need))
            if m.any():
                a, b = i[m], j[m]
                flip = doc[a] > doc[b]
                a, b = np.where(flip, b, a), np.where(flip, a, b)
                p = np.zeros(len(a), dtype=PAIR)
                p["a"], p["b"], p["na"], p["nb"], p["ba"], p["bb"], p["c"] = doc[a], doc[b], n[a], n[b], block[a], block[b], 1
                found.append(p)
                held += len(p)
                if held > 1_000_000:
                    found = [_add(found)]
                    held = 0
        p = _add(found) if found else np.zeros(0, PAIR)
        return pa.table({c: pa.array(np.ascontiguousarray(p[c])) for c in PAIR.names})

    def bring(self, block: pa.Table, asked: pa.Table) -> pa.Table:
        """Step F, in a block: the n-grams of one side of each surviving pair."""
        if not block.num_rows or not asked.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "g": pa.array([], pa.binary())})
        texts = block["text"].to_pylist()
        at = {r: k for k, r in enumerate(block["rep"].to_pylist())}
        rows = [at[r] for r in asked["rep"].to_pylist()]
        own = sorted(set(rows))
        _, g, n = incidence([texts[k] for k in own], self.width)
        ends = np.cumsum(n)
        part = {k: g[e - m : e].tobytes() for k, e, m in zip(own, ends.tolist(), n.tolist())}
        return pa.table({"a": asked["a"], "b": asked["b"], "g": pa.array([part[k] for k in rows], pa.binary())})

    def compare(self, rows: pa.Table) -> pa.Table:
        """Step F: two rows for each pair."""
        first, out = {}, ([], [], [])
        for a, b, g in zip(rows["a"].to_pylist(), rows["b"].to_pylist(), _bytes(rows["g"])):
            other = first.pop((a, b), None)
            if other is None:
                first[a, b] = g
                continue
            x, y = np.frombuffer(other, np.uint64), np.frombuffer(g, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            o = int((both[1:] == both[:-1]).sum())
            s = o / (len(x) + len(y) - o)
            if s >= self.t - EPS:
                for c, v in zip(out, (a, b, s)):
                    c.append(v)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64()), "similarity": pa.array(out[2], pa.float64())})


POSTING = np.dtype([("key", np.uint64), ("doc", np.int32), ("pos", np.int32), ("side", np.int8)])
DOC = np.dtype([("doc", np.int64), ("n", np.int32), ("single", np.int32), ("block", np.int32)])
PAIR = np.dtype([("a", np.int64), ("b", np.int64), ("na", np.int32), ("nb", np.int32), ("ba", np.int32), ("bb", np.int32), ("c", np.int32)])


def _add(found: list[np.ndarray]) -> np.ndarray:
    """One row a pair, overlaps added."""
    p = np.concatenate(found)
    p = p[np.lexsort((p["b"], p["a"]))]
    start = np.flatnonzero(np.concatenate([[True], (p["a"][1:] != p["a"][:-1]) | (p["b"][1:] != p["b"][:-1])]))
    q = p[start].copy()
    q["c"] = np.add.reduceat(p["c"], start)
    return q


def _may_reach(t: float, slack: float):
    """Whether the overlap seen, and what lies behind the counted n-grams of the text that ends first, can be enough."""
    na, nb = F.col("na"), F.col("nb")
    need = F.ceil(t / (1 + t) * (na + nb) - EPS)
    more = 1 + F.ceil(slack * F.least(na, nb))
    behind = [n - F.least(n - F.ceil(t * n - EPS) + 1, n - need + more) for n in (na, nb)]
    return F.col("c") + F.greatest(*behind) >= need


def eligible(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Rows (id, text) of at least `min_words` words; null ids and texts never take part."""
    words = F.size(F.filter(F.split(F.col(text_col), "[ \t\r\n]+"), lambda w: w != ""))
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").where((F.length("text") >= 2 * min_words - 1) & (words >= min_words))


def members(texts: DataFrame) -> DataFrame:
    """(id, rep): the smallest id among the records of equal text, for every distinct record."""
    keyed = texts.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(17), "text").alias("h2")).distinct()
    reps = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    return keyed.join(reps, ["h1", "h2"]).select("id", "rep")


def similar_texts(texts: DataFrame, width: int, threshold: float, rows: int, block_rows: int = 2048, tile: int = 1024, slack: float = 0.06) -> DataFrame:
    """(a, b, similarity) for all pairs of different texts whose similarity is at least the threshold; a < b are the
    smallest ids of their texts. texts: (id, text). rows: about how many rows there are; it only sizes the blocks. slack:
    share of the n-grams that are counted beyond the least; more posts more and leaves fewer pairs to compare."""
    blocks = max(4, -(-rows // block_rows))
    p = _Product(width, threshold, max(4, blocks // 4), tile, slack)
    classes = texts.groupBy("text").agg(F.min("id").alias("rep"))
    blocked = classes.select("rep", "text", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int").alias("block"))
    counts = blocked.groupBy("block").applyInArrow(lambda x: p.count(x), "bucket int, block int, g binary, n binary")
    answers = counts.groupBy("bucket").applyInArrow(lambda x: p.frequency(x), "bucket int, block int, n binary")
    postings = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda x, y: p.post(x, y), "bucket int, docs binary, rows binary")
    partial = postings.groupBy("bucket").applyInArrow(lambda x: p.multiply(x), "a long, b long, na int, nb int, ba int, bb int, c int")
    pairs = partial.groupBy("a", "b", "na", "nb", "ba", "bb").agg(F.sum("c").alias("c"))
    pairs = pairs.where(_may_reach(threshold, slack))
    sides = F.explode(F.array(F.struct(F.col("ba").alias("block"), F.col("a").alias("rep")), F.struct(F.col("bb").alias("block"), F.col("b").alias("rep"))))
    asked = pairs.select("a", "b", sides.alias("s")).select("a", "b", "s.block", "s.rep")
    grams = blocked.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(lambda x, y: p.bring(x, y), "a long, b long, g binary")
    return grams.groupBy(F.pmod(F.xxhash64("a", "b"), F.lit(blocks)).alias("part")).applyInArrow(lambda x: p.compare(x), "a long, b long, similarity double")


def near_duplicate_pairs(df: DataFrame, id_col: str = "node_no", text_col: str = "text", width: int = 3, threshold: float = 0.5, min_words: int = 40, rows: int | None = None) -> DataFrame:
    """(node_a, node_b, similarity), every pair of different ids whose texts are similar, equal texts included.

    Ids delivered more than once count once. Texts that are null, empty or shorter than `min_words` take no part. Other
    columns of `df` are ignored. An empty table gives no rows.
    """
    rows = df.count() if rows is None else rows
    texts = eligible(df, id_col, text_col, min_words)
    own = members(texts)
    pairs = similar_texts(texts, width, threshold, rows)
    a, b = own.select(F.col("id").alias("x"), F.col("rep").alias("a")), own.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    between = pairs.join(a, "a").join(b, "b").select("x", "y", "similarity")
    within = own.withColumnRenamed("rep", "a").withColumnRenamed("id", "x").join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    return between.unionByName(within).select(F.least("x", "y").alias("node_a"), F.greatest("x", "y").alias("node_b"), "similarity")


def components(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, group): the smallest id that links (a, b) connect each id to; ids without a link are left out.

    Large-star and small-star steps in turn: every id links its greater neighbours to its smallest one, then itself and its
    smaller neighbours. Each round is kept in the shared folder; the number of rounds grows with the logarithm of a
    component's diameter, and a component that is not done after `rounds` is an error.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    sign = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
    before = sign(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut(small)
        after = sign(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())
        before = after
    raise RuntimeError(f"components not found in {rounds} rounds")


def near_duplicate_groups(df: DataFrame, id_col: str = "node_no", text_col: str = "text", width: int = 3, threshold: float = 0.5, min_words: int = 40, rows: int | None = None) -> DataFrame:
    """(node_no, class, group, links), one row for each id of a text of at least `min_words` words: the smallest id of equal
    text, the smallest id of all texts that links connect, and the number of different texts its text is linked to. Groups
    of copies cost a row for each copy, not for each pair of them."""
    rows = df.count() if rows is None else rows
    texts = eligible(df, id_col, text_col, min_words)
    pairs = cut(similar_texts(texts, width, threshold, rows).select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    groups = components(pairs).withColumnRenamed("id", "rep")
    own = members(texts).join(links, "rep", "left").join(groups, "rep", "left")
    return own.select(F.col("id").alias("node_no"), F.col("rep").alias("class"), F.coalesce("group", "rep").alias("group"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
