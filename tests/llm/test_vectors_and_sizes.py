import numpy as np
import pytest

from leafmill.llm.mixing import mix, quotas, report, schedule
from leafmill.llm.packing import fill, pack, pack_items
from leafmill.llm.tokens import encoder, VOCABULARY
from leafmill.llm.vector_knn import KnnConfig, nearest_vectors


def exact(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = x @ x.T
    np.fill_diagonal(g, -2)
    return np.argsort(-g, axis=1, kind="stable")[:, :k]


def test_knn_recall(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(400, 16))
    x = (centres[r.integers(0, 400, 3000)] + 0.3 * r.normal(size=(3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_no long, embedding array<float>")
    got = nearest_vectors(df, cfg=KnnConfig(dim=16, cell=200, block=300)).toPandas()
    assert len(got) == 15_000 and not got.duplicated(["id", "neighbour"]).any()
    by, want = got.groupby("id").neighbour.agg(set), exact(x, 5)
    assert sum(len(by[i] & set(want[i])) for i in range(3000)) / 15_000 >= 0.9


def test_knn_unsound_copies_and_few(spark):
    one, two = [1.0, 0.0], [0.0, 2.0]
    rows = [(i, one) for i in range(8)] + [(20, two), (20, two), (30, None), (31, [1.0]), (32, [0.0, 0.0]), (33, [float("nan"), 1.0]), (34, [float("inf"), 1.0]), (None, one)]
    df = spark.createDataFrame(rows, "node_no long, embedding array<double>")
    got = {}
    for r in nearest_vectors(df, cfg=KnnConfig(dim=2, parts=1)).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert set(got) == {*range(8), 20}
    assert got[0] == {1, 2, 3, 4, 5} and got[7] == {0, 1, 2, 3, 4} and got[20] <= set(range(8)) and len(got[20]) == 5
    assert nearest_vectors(df.where("node_no > 29"), cfg=KnnConfig(dim=2, parts=1)).count() == 0


def test_pack_is_whole_and_tight():
    r = np.random.default_rng(2)
    for capacity in (10, 100, 1000):
        s = r.integers(0, capacity + 1, 2000)
        b = pack(s, capacity)
        assert np.bincount(b, s).max() <= capacity
        assert (b.max() + 1) * capacity <= s.sum() * 1.05 + 2 * capacity


def test_pack_items(spark):
    rows = [(1, 5), (2, 25), (3, 0), (4, 10), (4, 10), (None, 3), (5, 7), (6, 20), (7, None)]
    got = pack_items(spark.createDataFrame(rows, "id long, tokens long"), [(1, 10), (2, 100)], 8).collect()
    for p, capacity in ((1, 10), (2, 100)):
        mine = [r for r in got if r.pack_id == p]
        per = {}
        for r in mine:
            per[r.container] = per.get(r.container, 0) + r.tokens
        assert max(per.values()) <= capacity and sum(per.values()) == 67
        assert {r.id for r in mine} == {1, 2, 3, 4, 5, 6, 7}
        parts = sorted((r.part, r.tokens) for r in mine if r.id == 2)
        assert parts == ([(0, 10), (1, 10), (2, 5)] if p == 1 else [(0, 25)])
        assert sorted((r.part, r.tokens) for r in mine if r.id == 6) == ([(0, 10), (1, 10)] if p == 1 else [(0, 20)])
    assert pack_items(spark.createDataFrame([], "id long, tokens long"), [(1, 10)], 0).count() == 0
    with pytest.raises(ValueError):
        pack_items(spark.createDataFrame(rows, "id long, tokens long"), [(1, 0)], 8)
    filled = fill(pack_items(spark.createDataFrame([(i, 5) for i in range(100)], "id long, tokens long"), [(1, 10)], 100)).head()
    assert filled.fill == 1.0 and filled.containers == 50


def test_schedule_stays_within_one_block():
    shares = [0.5, 0.3, 0.19, 0.01]
    p = schedule(shares, 256)
    slots = sorted((t, i) for i, ts in enumerate(p) for t in ts)
    assert [t for t, _ in slots] == list(range(len(slots)))
    n, rate = [0] * 4, [len(x) / len(slots) for x in p]
    for t, i in slots:
        n[i] += 1
        assert all(abs(n[k] - rate[k] * (t + 1)) < 1 for k in range(4))


def test_quotas():
    got = {s.source: s for s in quotas([("a", 2.0, 1), ("b", 1.0, 3), ("c", 1.0, None), ("none", 5.0, 1), ("zero", 0.0, 1), (None, 1.0, 1)], {"a": 100, "b": 10, "c": 5})}
    assert set(got) == {"a", "b", "c"} and got["b"].quota == 30 and got["a"].quota == 60 and got["c"].share == 0.25
    over = {s.source: s.quota for s in quotas([("a", 1.0, 1), ("b", 1.0, None)], {"a": 10, "b": 10}, total=100)}
    assert over == {"a": 10, "b": 90}
    assert quotas([], {}) == []


def test_mix(spark):
    docs = [(i, "big", 10) for i in range(300)] + [(1000 + i, "small", 10) for i in range(10)] + [(5000, None, 9), (5001, "unlisted", 9), (5002, "big", 0)]
    sizes = spark.createDataFrame(docs, "id long, source string, tokens long").selectExpr("*", "0 as h", "1 as r", "2 as base", "3 as size")
    targets = spark.createDataFrame([("big", 3.0, 1), ("small", 1.0, 5), ("absent", 1.0, 2)], "source string, weight double, max_repeats int")
    mixed, shares = mix(sizes, targets, 313, block=50)
    rows = mixed.collect()
    assert {r.source for r in rows} == {"big", "small"}
    small = [r for r in rows if r.source == "small"]
    assert len(small) == 50 and max(r.repeat for r in small) == 5 and sum(r.tokens for r in rows if r.source == "big") == 1500
    assert len({(r.id, r["repeat"]) for r in rows}) == len(rows)
    seen = {"big": 0, "small": 0}
    for r in sorted(rows, key=lambda r: (r.slot, r.offset)):
        seen[r.source] += r.tokens
        assert abs(seen["big"] - 0.75 * sum(seen.values())) <= 60
    out = {r.source: r for r in report(mixed, targets, shares).collect()}
    assert abs(out["big"].actual_share - 0.75) < 0.01 and out["absent"].actual_share == 0
    empty, none = mix(sizes.limit(0), targets, 0)
    assert empty.count() == 0 and none == []


def test_tokens_round_trip():
    e = encoder(VOCABULARY)
    for t in ["plain text", "naïve Ünïcode 数据", "", " spaces\n\n and tabs\t", "x" * 20_000]:
        assert e.decode(e.encode_ordinary(t)) == t


def test_pack_has_fixed_counts():
    """Containers of the classes up to the last hold as many items of their class as fit, but for one container a class."""
    from leafmill.llm.packing import last_class

    r = np.random.default_rng(1)
    for sizes in (r.integers(1, 2049, 5000), np.minimum(2048, r.lognormal(5, 1, 5000).astype(int) + 1), r.integers(900, 2049, 500), np.full(10, 2048)):
        b, cls = pack(sizes, 2048), 2048 // sizes
        last = max(int(cls.min()), last_class(cls, sizes, 2048))
        assert np.bincount(b, sizes).max() <= 2048
        for k in np.unique(cls[cls <= last]):
            per = np.bincount(b[cls == k])
            assert set(per[per > 0]) <= {k, (cls == k).sum() % k} and (per == k).sum() == (cls == k).sum() // k


def test_levels_give_rare_sources_their_due():
    import time

    from leafmill.llm.mixing import levels

    nested, rare = levels({"a": 1 - 1e-7, "b": 1e-7})
    assert len(nested) == 1 and nested[0][0][0] == "a" and abs(rare["b"] - 1e7) < 2
    began = time.time()
    nested, rare = levels({f"s{k}": 1e-4 for k in range(10_000)})
    assert time.time() - began < 30 and not rare
    share = {}
    for nodes in reversed(nested):
        share |= {n: len(x) / p * share.get(parent, 1.0) for n, parent, p, x in nodes}
    assert max(abs(share[f"s{k}"] / 1e-4 - 1) for k in range(10_000)) < 0.05


def test_mix_of_rare_and_many_sources(spark):
    sizes = spark.range(40_000).selectExpr("id", "case when id < 4 then 'rare' when id % 2 = 0 then 'a' else concat('m', id % 300) end as source", "100L as tokens")
    names = ["rare", "a"] + [f"m{k}" for k in range(1, 300, 2)]
    targets = spark.createDataFrame([(n, {"rare": 0.005, "a": 50.0}.get(n, 1 / 3), 2) for n in names], "source string, weight double, max_repeats int")
    mixed, shares = mix(sizes, targets, 40_000, block=100)
    rows = mixed.orderBy("slot", "source", "offset").collect()
    got = {s.source: s.share for s in shares}
    seen: dict = {}
    for n, r in enumerate(rows, 1):
        seen[r.source] = seen.get(r.source, 0) + 1
        if n % 500 == 0:
            assert all(abs(seen.get(s, 0) - n * u) < 3 for s, u in got.items())
    assert len({(r.id, r.repeat) for r in rows}) == len(rows)
