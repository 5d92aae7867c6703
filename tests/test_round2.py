import time

import pytest
from pyspark.sql import functions as F

from leafmill.operators import blocks as B, index as I, layout as L, retrieve as R, runs, sections as S
from leafmill.streaming.ingest import run_windowed_counts


def test_store_writes_only_touched_buckets(spark, tmp_path):
    s = I.ChunkStore(spark, str(tmp_path / "s"), buckets=8)
    s.upsert(spark.range(200).selectExpr("concat('n', id) as node_id", "id % 20 as doc_id", "id as v"))
    before = s._manifest(s.version())["at"]
    s.upsert(spark.createDataFrame([("n7", 7, 1000)], "node_id string, doc_id long, v long"))
    after = s._manifest(s.version())["at"]
    assert sum(before[b] != after[b] for b in after) == 1 and s.read().where("v = 1000").count() == 1 and s.read().count() == 200
    s.delete(spark.createDataFrame([(7,), (None,)], "doc_id long"))
    assert s.read().count() == 190
    s.upsert(spark.createDataFrame([("x", 1, 2, "new")], "node_id string, doc_id long, v long, extra string"))
    assert s.read().where("extra = 'new'").count() == 1 and s.read().count() == 191
    assert len([p for p in (tmp_path / "s" / "versions").iterdir() if p.name.isdigit()]) == 2


def test_store_refuses_a_second_writer(spark, tmp_path):
    a, b = (I.ChunkStore(spark, str(tmp_path / "s")) for _ in "ab")
    row = lambda v: spark.createDataFrame([("n", v)], "node_id string, v long")
    a.upsert(row(1))
    v = b.version()
    b.version = lambda: v  # b read before a's next write
    a.upsert(row(2))
    with pytest.raises(I.ConcurrentWrite):
        b._commit(row(3), None)
    assert a.read().head().v == 2


def test_predelete_and_reingest(spark, tmp_path):
    s = I.ChunkStore(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(list(r), "node_id string, doc_id string")
    s.upsert(rows(("a", "d"), ("b", "d"), ("c", "e")))
    s.predelete_and_upsert(rows(("a2", "d")), predelete=False)
    assert s.read().count() == 4
    s.predelete_and_upsert(rows(("a3", "d")))
    assert {r.node_id for r in s.read().collect()} == {"a3", "c"}

    def handler(k):
        if k == "fail":
            raise ValueError("no")

    items = spark.createDataFrame([("b",), ("a",), ("fail",), (None,), ("z",), ("a",)], "doc_key string")
    began = time.time()
    got = I.reingest(items, handler, most=3, delay=0.05)
    assert [k for k, _ in got] == ["a", "b", "fail"] and got[2][1] == "ValueError: no" and time.time() - began >= 0.1


def test_long_documents_in_stretches(spark):
    import random

    r = random.Random(1)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None]), k, r.randrange(0, 12), r.choice(["t", "u", None])) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id string, k long, level int, title string")
    flat = lambda d: sorted(map(str, d.collect()))
    assert flat(S.breadcrumbs(df)) == flat(S.breadcrumbs(df, size=16))
    chunks = df.selectExpr("doc_id", "k as section_idx", "level as chunk_idx", "concat('n', k) as node_id")
    assert flat(S.link_chunks(chunks)) == flat(S.link_chunks(chunks, size=16))
    pages = df.selectExpr("doc_id", "k as block_no", "cast(k / 9 as int) as page", "case when k % 7 = 0 then title end as title")
    assert flat(L.page_sections(pages)) == flat(L.page_sections(pages, size=16))
    assert runs.running(df.limit(0), ["doc_id"], "k", {"s": ("sum", F.lit(1))}).count() == 0
    with pytest.raises(ValueError):
        S.breadcrumbs(spark.createDataFrame([("a", 1, 99, "t")], "doc_id string, k long, level int, title string"))


def test_searches_in_blocks_agree(spark, monkeypatch):
    import random

    r = random.Random(2)
    docs = spark.createDataFrame([(k, " ".join(r.choice("ab bc cd de ef fg gh hi".split()) for _ in range(r.randrange(12)))) for k in range(200)], "node_id long, text string")
    qs = docs.where("node_id % 5 = 0").selectExpr("node_id as query_id", "text")
    vs = spark.createDataFrame([(k, [r.random() for _ in range(6)]) for k in range(200)], "node_id long, v array<double>")
    runs_ = [lambda: R.bm25_top_k(qs, docs, 4), lambda: R.sparse_text_top_k(qs, docs, 4), lambda: R.dense_top_k(vs.where("node_id < 20").withColumnRenamed("node_id", "query_id"), vs, 4)]
    flat = lambda d: sorted((x.query_id, x.node_id, round(x.score, 5), x.rank) for x in d.collect())
    first = [flat(f()) for f in runs_]
    monkeypatch.setattr(R, "CELLS", 0)  # queries and terms too many for a matrix
    monkeypatch.setattr(R, "MOST_QUERIES", 1)
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "DOC_BLOCK", 30)
    assert [flat(f()) for f in runs_] == first and all(first)


def test_rerank_falls_back_and_chain(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.2, 2), (1, 12, 0.1, 3)], "query_id long, node_id long, score double, rank int")
    q, d = spark.createDataFrame([(1, "x")], "query_id long, text string"), spark.createDataFrame([(10, "a"), (11, "x"), (12, "x")], "node_id long, text string")

    def broken(query, text):
        raise RuntimeError("down")

    with pytest.warns(UserWarning):
        assert [r.node_id for r in R.rerank_or_keep(hits, q, d, 2, broken).orderBy("rank").collect()] == [10, 11]
    assert [r.node_id for r in R.rerank_or_keep(hits, q, d, 2).orderBy("rank").collect()] == [11, 12]
    assert [(r.node_id, r.rank) for r in R.post_process(hits, q, [R.at_least(0.15), R.first(5)]).orderBy("rank").collect()] == [(10, 1), (11, 2)]
    with pytest.warns(UserWarning):
        assert R.search_or_none(lambda: 1 / 0, spark).count() == 0
    assert R.reranker("overlap") is R.overlap_score and R.reranker(None) is None and R.reranker("own", own=broken) is broken
    with pytest.raises(ValueError):
        R.reranker("nothing")


def test_blocks(spark):
    n = spark.createDataFrame([(1, "T h e end [IMAGE_BLOCK_2]"), (2, "plain"), (3, None)], "node_id long, text string")
    got = {r.node_id: r.polished for r in B.polish(n, lambda c: F.concat(F.lit("Sure:\n"), F.upper(c))).collect()}
    assert got == {1: "THE END [IMAGE_BLOCK_2]", 2: "plain", 3: None}
    assert {r.node_id: r.polished for r in B.polish(n).collect()}[1] == "The end [IMAGE_BLOCK_2]"
    b = spark.createDataFrame([(1, 2, "a figure"), (1, 9, "x")], "node_id long, block_id long, text string")
    assert {r.node_id: r.text for r in B.fill_places(n, b).collect()} == {1: "T h e end a figure", 2: "plain", 3: None}
    e = spark.createDataFrame([('{"a": "1\\t2", "s": "0"}',), (None,), ("{",)], "j string")
    assert [tuple(r)[1:] for r in B.flatten(e, "j", {"a": "a", "sex": "s", "tel": "t"}, {"sex": {"0": "m"}}, {"tel": "a"}).collect()] == [("1 2", "m", "1 2"), (None, None, None), (None, None, None)]
    c = spark.createDataFrame([(1, 0, 0, "h", True), (1, 0, 2, "k", True), (1, 1, 0, None, False), (1, 1, 2, "v", None), (1, None, 1, "x", False)], "t long, row int, col int, text string, header boolean")
    assert B.tables_as_html(c, ["t"]).head().html == "<table><tr><th>h</th><th>k</th></tr><tr><td></td><td>v</td></tr></table>"
    assert B.tables_as_html(c.limit(0), ["t"]).count() == 0


def test_windows_run_as_a_stream(spark, tmp_path):
    rows = [[("2025-01-01 00:10:00", "a"), ("2025-01-01 00:50:00", "a")], [("2025-01-01 05:00:00", "b")], [("2025-01-01 05:01:00", "b")], [("2025-01-01 00:20:00", "a"), ("2025-01-01 04:30:00", "b")], [("2025-01-01 12:00:00", "c")], [("2025-01-01 12:01:00", "c")]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "ts string, event_type string").selectExpr("cast(ts as timestamp) as ts", "event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    got = run_windowed_counts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert {(r.window_start.hour, r.event_type, r.events) for r in got.collect()} == {(0, "a", 2), (4, "b", 1), (5, "b", 2)}  # the row of 00:20 came too late
