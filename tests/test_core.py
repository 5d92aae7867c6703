import re

import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions import cells as K, chunk as C, parse as P, text as T
from leafmill.operators import cache, encode as E, index as I, layout as L, retrieve as R, sections as S
from leafmill.operators.incremental import IncrementalSync, capture, current_state, newest, pending_changes
from leafmill.plans.pipeline import IngestionPipeline, QueryEngine, Settings
from leafmill.sources import files as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).head()["x"]


# -- column functions -----------------------------------------------------------------------------------------------------


def test_clean_newlines_and_controls(spark):
    assert one(spark, T.clean_newlines(F.col("t")), t="a\r\nb\rc\x00\x01\x7f\n\n\n\nd\te") == "a\nb\nc\n\nd\te"
    assert one(spark, T.clean_newlines(F.col("t")), t=None) is None


def test_front_matter_comments_and_tags(spark):
    t = "---\ntitle: x\n---\n<!-- gone -->Some <b>bold</b> text"
    assert one(spark, T.strip_placeholders(F.col("t")), t=t) == "Some bold text" == P.strip_tags(t)


@pytest.mark.parametrize(
    ("line", "header"),
    [("第三章 概述", True), ("BIG TITLE", True), ("IV. Parts", True), ("## Title", True), ("1.2 Scope", True), ("Short line", True), ("目录 一", True), ("主要功能", True), ("a plain sentence that goes on", False), ("这是一句话。", False), ("", False), ("lower", False)],
)
def test_header_rules(spark, line, header):
    assert (one(spark, T.header_rule(F.col("t")), t=line) > 0) is header
    assert P.is_header(line) is header


def test_formula_garbled_and_math(spark):
    assert one(spark, T.is_garbled(F.col("t")), t="a" * 30 + "�") and not one(spark, T.is_garbled(F.col("t")), t="fine")
    assert one(spark, T.is_formula(F.col("t")), t="x[n] = 3") and one(spark, T.is_formula(F.col("t")), t="∑ a") and not one(spark, T.is_formula(F.col("t")), t="words only")
    assert one(spark, T.math_delimiters(F.col("t")), t=r"\[a\] and \(b\)") == "$$a$$ and $$b$$"
    assert one(spark, T.wrap_latex(F.col("t")), t=r"\frac{a}{b}") == "$$\n\\frac{a}{b}\n$$" and one(spark, T.wrap_latex(F.col("t")), t="|a_1|\n|b|") == "|a_1|\n|b|"
    assert one(spark, T.clean_pdf_text(F.col("t")), t="hyph-\nen  and $x$[$n$]") == "hyphen and $x[n]$"


def test_cells_bullets_and_tags(spark):
    for t, kind in [("2024年", "Dt"), ("12.5%", "Nu"), ("AB-12", "Ca"), ("plain", "En"), ("12 kg", "NE"), ("字", "Sg"), ("这是 四个 长的 词语 哦哦", "Tx"), ("中文", "Ot")]:
        assert one(spark, T.cell_type(F.col("t")), t=t) == kind
    for t, level in [("第一章 x", 1), ("1. Some", 5), ("1.2 Some", 6), ("•  x", 12), ("12 345", 0), ("ab", None), ("What is it?", 9)]:
        assert one(spark, T.bullet_level(F.col("t")), t=t) == level
    tag = one(spark, T.position_tag(F.array(F.lit(1), F.lit(2)), F.lit(1.0), F.lit(2.5), F.lit(3.0), F.lit(4.0)), t="")
    assert tag == "@@1-2\t1.0\t2.5\t3.0\t4.0##"
    p = one(spark, T.tag_positions(F.col("t")), t=f"x{tag}y")[0]
    assert (p.pages, p.x0, p.x1, p.top, p.bottom) == ([1, 2], 1.0, 2.5, 3.0, 4.0) and one(spark, T.without_tags(F.col("t")), t=f"x{tag}y") == "xy"


def test_dates(spark):
    for t, want in [("2021年3月5日", (2021, 3, 5)), ("2021.13.40", (2021, 1, 1)), ("1600000000000", (2020, 9, 13)), ("2020", (2020, 1, 1)), ("x", (None, 1, 1))]:
        y, m, d = T.date_parts(F.col("t"))
        assert tuple(one(spark, c, t=t) for c in (y, m, d)) == want


# -- parsing --------------------------------------------------------------------------------------------------------------


def test_text_sections():
    got = P.parse_text("第一章 开始\r\nsome text that is\nwrapped over lines.\n\nCHAPTER TWO\nmore text here\x00.")
    assert [s["section_header"] for s in got] == ["第一章 开始", "CHAPTER TWO"] and "text that is wrapped" in got[0]["text"]
    assert P.parse_text("")[0] == {"level": 1, "section_header": "Introduction", "section_path": "Introduction", "text": ""}
    assert len(P.parse_text("```\n# no\ncode\n```")) == 1 and len(P.parse_text("| a | b |\n|---|---|\n| 1 | 2 |")) == 1
    assert P.decode_bytes("中文".encode("gbk")) == "中文" and P.decode_bytes("中文".encode()) == "中文"


def test_merge_lines():
    assert P.merge_short_lines("this is a line, that\nwas cut in the mid-\ndle of a word.\nnext one stands", 60) == "this is a line, that was cut in the middle of a word.\nnext one stands"
    code = "```py\ndef f():\n    return 1\n```"
    assert P.merge_short_lines(f"words go\n{code}") == f"words go\n{code}"


def test_markdown_sections():
    t = "intro\n# A\ntext [here](#x) ![pic](a.png)\n## B\n```\n# not a header\n```\n$$ x $$\n### C\n| # | b |\n|---|---|\n# D\nend"
    got = P.parse_markdown(t)
    assert [(s["level"], s["section_path"]) for s in got] == [(0, "Introduction"), (1, "A"), (2, "A > B"), (3, "A > B > C"), (1, "D")]
    assert got[1]["images"] == ["a.png"] and "here" in got[1]["text"] and "![" not in got[1]["text"] and "# not a header" in got[2]["text"]
    assert P.parse_markdown("") == []


def test_html_sections():
    t = """<html><head><title>The T</title><meta name=keywords content="a,b"><meta property="og:x" content=y><link rel=canonical href=http://e.x/></head>
    <body><div class=ad>buy</div><h1>One</h1><p>a <b>b</b> &lt;script&gt;</p><h2>Two</h2><pre># no\n x</pre><table><tr><th>A<th>B<tr><td colspan=2>c</table><a href=z>link</a><script>1<2</script></body></html>"""
    got = P.parse_html(t, clean=(".ad",))
    assert [s["section_path"] for s in got] == ["One", "One > Two"] and got[0]["title"] == "The T" and got[0]["canonical_url"] == "http://e.x/" and got[0]["web_meta"] == {"keywords": "a,b", "og:x": "y"}
    text = "\n".join(s["text"] for s in got)
    assert "buy" not in text and "<script>" in text and "| c | c |" in text and "# no" in text and "link" in text and "1<2" not in text
    assert P.parse_html("") == [] and len(P.parse_html("<p>just text")) == 1 and P.parse_html("<p>just text")[0]["section_header"] == "Introduction"


def test_large_text_is_quick():
    t = "\n".join(f"第{i}章 Part\nline one of it\nline two of it\nthe end." + ("\n```\n# x\n```" if i % 10 == 0 else "") for i in range(100))
    began = time.time()
    assert len(P.parse_text(t)) > 50 and time.time() - began < 5


# -- chunks ---------------------------------------------------------------------------------------------------------------


def test_sentence_chunks():
    text = " ".join(f"This is sentence number {i} of the text." for i in range(200))
    got = C.split_sentences(text, 60, 20)
    assert all(C.count_tokens(c) <= 60 for c in got)
    assert all(f"number {i} " in " ".join(got) for i in range(200)) and all(any(f"number {i} " in a and f"number {i} " in b for i in range(200)) for a, b in zip(got, got[1:]))
    assert C.split_sentences("", 10, 2) == [] == C.split_sentences(" \n ", 10, 2)
    assert "".join(C.split_sentences("x" * 5000, 10, 0)) == "x" * 5000
    long = C.split_sentences("word " * 1000, 50, 10)
    assert all(C.count_tokens(c) <= 50 for c in long)


def test_table_and_protected_chunks():
    t = "| h | i |\n|---|---|\n" + "\n".join(f"| {i} | value |" for i in range(100))
    got = C.chunk(t, "Table of values", 30)
    assert len(got) > 3 and all(c.startswith("| h | i |") for c in got) and sum(c.count("value") for c in got) == 100
    code = "```\n" + "a = 1. b = 2. " * 3 + "\n```"
    assert code in "".join(C.split_protected(f"Text before. {code} Text after. $$ a. b $$ end.", 60, 5))
    assert C.split_protected("$$ ```x``` $$ done.", 30, 5) == ["$$ ```x``` $$ done."]


def test_delimited_and_json_chunks():
    assert C.split_delimited("a b\nc d!e", "\n!", 3) == ["a b\nc d", "e"] and C.split_delimited("a##b", "`##`", 0) == ["a", "b"]
    value = {"a": [{"b": "x" * 30}] * 20, "c": {"d": 1}}
    got = C.split_json(value, 200)
    assert len(got) > 1 and all(len(json.dumps(c)) < 400 for c in got) and sum(json.dumps(c).count("x" * 30) for c in got) == 20


def test_sections_and_chunks_frames(spark):
    docs = spark.createDataFrame([(1, "# A\ntext one.\n# B\ntext two.", ".md"), (2, None, ".md"), (3, "x", ".exe"), (4, "", ".txt")], "doc_id long, text string, extension string")
    s = S.split_sections(docs)
    assert {(r.doc_id, r.section_header) for r in s.collect()} == {(1, "A"), (1, "B"), (4, "Introduction")}
    c = S.link_chunks(S.split_chunks(s)).orderBy("section_idx").collect()
    assert len(c) == 2 and c[0].next_id == c[1].node_id and c[1].prev_id == c[0].node_id and c[0].prev_id is None and c[0].chunk_id == "1#0#0"


def test_breadcrumbs(spark):
    h = spark.createDataFrame([(1, 1, 1, "A"), (1, 2, 3, "C"), (1, 3, 2, "B"), (1, 4, 3, "D"), (1, 5, 1, "E"), (1, 6, 0, "no")], "doc_id long, k long, level int, title string")
    assert [r.path for r in S.breadcrumbs(h).orderBy("k").collect()] == ["A", "A > C", "A > B", "A > B > D", "E"]


# -- files ----------------------------------------------------------------------------------------------------------------


def test_loader(spark, tmp_path):
    d = tmp_path / "K8s"
    (d / "sub" / ".git").mkdir(parents=True)
    for n, t in (("a.md", "# A"), ("b.exe", "x"), ("c.TXT", "c"), (".hidden.md", "x"), ("sub/d.html", "<p>d"), ("sub/.git/e.md", "x")):
        (d / n).write_text(t)
    (d / "link.md").symlink_to(d / "a.md")
    got = {r.file_name: r for r in X.load(spark, str(d)).collect()}
    assert set(got) == {"a.md", "c.TXT"} and got["a.md"].domain == "Kubernetes" and got["a.md"].size == 3 and got["a.md"].mime_type == "text/markdown" and got["a.md"].doc_id == got["a.md"].file_hash
    assert {r.file_name for r in X.load(spark, str(d), recursive=True).collect()} == {"a.md", "c.TXT", "d.html"}
    assert X.load(spark, str(d / "b.exe"), (".exe",)).count() == 1
    with pytest.raises(ValueError):
        X.load(spark, str(d / "b.exe"))
    with pytest.raises(FileNotFoundError):
        X.load(spark, str(d / "nothing"))
    assert X.from_bytes(spark, [(b"x", "mem/a.txt")]).head().extension == ".txt"


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.csv").write_text("a,b\n1,2\n")
    rows = X.office_rows(X.load(spark, str(tmp_path), (".docx", ".xlsx", ".csv"))).collect()
    texts = {(os.path.basename(r.source), r.text) for r in rows if r.error is None}
    assert texts == {("a.docx", "Head"), ("a.docx", "1\t2"), ("b.xlsx", "name\t\t5"), ("d.csv", "a\tb"), ("d.csv", "1\t2")}
    assert [os.path.basename(r.source) for r in rows if r.error] == ["c.docx"] and next(r.style for r in rows if r.text == "Head") == "Heading1"
    assert X.is_json_lines('{"a":1}\n{"b":2}') and not X.is_json_lines('{"a":1}') and not X.is_json_lines("x\ny")


def test_qa_round_trip(spark, tmp_path):
    q, r, c = (spark.createDataFrame([(1, "x")], s) for s in ("query_id long, text string", "query_id long, node_id string", "node_id long, text string"))
    X.save_qa(q, r, c, str(tmp_path / "qa"))
    assert [d.count() for d in X.load_qa(spark, str(tmp_path / "qa"))] == [1, 1, 1]


# -- index ----------------------------------------------------------------------------------------------------------------


def test_upsert_changes_and_delete(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (2, "z"), (4, "n"), (None, "q")], "k long, v string")
    once = I.upsert(a, b, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "z"), (3, None), (4, "n")] == sorted(map(tuple, I.upsert(once, b, "k").collect()))
    s = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("e", "1")], "doc_key string, content_hash string")
    i = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("e", None), ("f", None)], "doc_key string, content_hash string")
    assert {tuple(r) for r in I.changes(s, i).collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "deleted"), ("d", "inserted"), ("e", "unchanged")}
    docs = spark.createDataFrame([("p", 1), ("q", 2), (None, 3)], "doc_id string, n int")
    assert {r.n for r in I.delete_documents(docs, spark.createDataFrame([("p",), (None,)], "doc_id string")).collect()} == {2, 3}


def test_store_keeps_versions(spark, tmp_path):
    s = I.ChunkStore(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([("a", 1)], "node_id string, n int")
    assert not s.exists() and not s.create(df.limit(0)) and s.create(df) and not s.create(df)
    s.upsert(spark.createDataFrame([("a", 2), ("b", 3)], "node_id string, n int"))
    assert {tuple(r) for r in s.read().collect()} == {("a", 2), ("b", 3)}


def test_pending_changes(spark):
    blobs = spark.createDataFrame([(1, "a", "AA", None, 1), (2, "a", "bb", None, 0), (3, "b", None, "CC", 1), (4, "c", None, None, 1), (5, "d", "dd", None, 1), (6, "d", "dd", None, 1), (7, None, "x", None, 1), (8, "e", "e1", None, None)], "blob_id long, source string, file_hash string, doc_id string, h int")
    blobs = blobs.withColumn("seen_at", F.expr("timestamp '2025-01-01' + make_interval(0, 0, 0, 0, h)")).withColumn("extra", F.lit(1))
    log = spark.createDataFrame([(1, 1, "a", "aa"), (2, 1, "b", "old"), (3, 2, "b", "cc"), (4, 3, "b", "new"), (5, 9, "d", "dd")], "log_id long, run_no int, source string, content_hash string")
    runs = spark.createDataFrame([(1, "success"), (2, "success"), (3, "failed")], "run_no int, status string")
    assert {tuple(r) for r in pending_changes(blobs, log, runs).collect()} == {("d", "dd")}
    assert pending_changes(blobs.limit(0), log, runs).count() == 0
    assert {r.source for r in pending_changes(blobs, log.limit(0), runs).collect()} == {"a", "b", "d"}


def test_capture_in_steps(spark, tmp_path):
    """Rows land in any order of blob_id, many at one time, some at none."""
    import random

    r = random.Random(4)
    rows = [(i, f"s{r.randrange(9)}", r.choice(["AA", "bb", None]), r.choice(["cc", None]), r.randrange(12), r.choice([*range(10), None])) for i in range(120)]
    rows += [(200, None, "a", None, 1, 1), (201, "s1", "zz", None, None, 2)]
    df = spark.createDataFrame(rows, "blob_id long, source string, file_hash string, doc_id string, h int, l int").withColumns({"seen_at": F.expr("timestamp '2025-01-01' + make_interval(0, 0, 0, 0, h)"), "landed_at": F.expr("timestamp '2025-02-01' + make_interval(0, 0, 0, 0, l)")}).cache()
    root = str(tmp_path / "log")
    for n, half in ((0, 2), (4, 2), (4, 1), (4, 1), (7, 1), (30, 1)):  # of the last landing time the odd half of the rows comes later
        part = df.where((F.coalesce("l", F.lit(0)) < n) & ((F.lit(half) == 1) | (F.col("blob_id") % 2 == 0) | (F.col("l") < n - 1)))
        got = {(x.source, x.file_hash) for x in capture(spark, root, part, 4).collect()}
        assert got == {(x.source, x.file_hash) for x in current_state(part).collect()}
    held = [tuple(x) for x in IncrementalSync(spark, root, "source", "landed_at", ("blob_id",), 4).sink().select("source", "landed_at", "blob_id").collect()]
    assert len(held) == len(set(held))


@pytest.mark.parametrize("fail_at", [None, "plan", "apply", "commit"])
def test_capture_in_landing_order(spark, tmp_path, fail_at, monkeypatch):
    """Rows that land late have blob_ids below those of rows captured before; every second call dies at a step and is repeated."""
    blobs = spark.read.parquet("/root/testdata/sf0.01/blobs.parquet")
    cuts = blobs.selectExpr("percentile(unix_micros(cast(landed_at as timestamp)), array(0.25, 0.5, 0.9, 1.0)) as c").head().c
    root = str(tmp_path / "log")
    for n, c in enumerate(cuts):
        part = blobs.where(F.expr("unix_micros(cast(landed_at as timestamp))") <= c)
        if fail_at and n % 2:
            real = getattr(IncrementalSync, fail_at)

            def dies(self, *args):
                if fail_at != "commit":
                    real(self, *args)
                raise Boom

            with monkeypatch.context() as m, pytest.raises(Boom):
                m.setattr(IncrementalSync, fail_at, dies)
                capture(spark, root, part, 4)
        got = {(x.source, x.file_hash) for x in capture(spark, root, part, 4).collect()}
        assert got == {(x.source, x.file_hash) for x in current_state(part).collect()}


def test_capture_reads_only_news(spark, tmp_path):
    rows = lambda days: spark.range(1000).selectExpr("id + %d * 1000 as blob_id" % days, "concat('s', id % 50) as source", "concat('h', id, '-', %d) as file_hash" % days, "string(null) as doc_id", f"timestamp '2025-01-01' + make_interval(0, 0, 0, {days}) as seen_at", f"timestamp '2025-01-01' + make_interval(0, 0, 0, {days}) as landed_at")
    log, root = str(tmp_path / "in"), str(tmp_path / "log")
    for d in range(3):
        rows(d).coalesce(1).write.mode("append").parquet(log)
        capture(spark, root, spark.read.parquet(log), 2)
    sync = IncrementalSync(spark, root, "source", "landed_at", ("blob_id",), 2)
    plan = sync._since(spark.read.parquet(log), sync._read("plan-2.json")["start"])._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\n]*landed_at", plan)
    before = {tuple(r) for r in capture(spark, root, spark.read.parquet(log), 2).collect()}
    assert not sync.compact(lambda df: newest(df, "landed_at"), 3) and sync.compact(lambda df: newest(df, "landed_at"), 2) and len(sync._folders()) == 1
    assert {tuple(r) for r in capture(spark, root, spark.read.parquet(log), 2).collect()} == before


class Boom(Exception):
    pass


@pytest.mark.parametrize("fail_at", ["planned", "applied", "torn", None])
def test_incremental_sync_survives_failures(spark, tmp_path, fail_at):
    root = str(tmp_path / "sync")
    log = spark.createDataFrame([(f"k{i % 7}", i) for i in range(20)] + [("k1", 1), (None, 3)], "key string, off long")
    sync = IncrementalSync(spark, root, "key", "off", (), 4)
    if fail_at:
        batch = sync.plan(log)
        if fail_at != "planned":
            sync.apply(sync.read(log, batch), batch)
        if fail_at == "torn":  # the append died before its success mark
            (tmp_path / "sync" / "sink" / "batch-0" / "_SUCCESS").unlink()
        more = log.union(spark.createDataFrame([("k2", 100)], "key string, off long"))
        assert IncrementalSync(spark, root, "key", "off", (), 4).plan(more) == batch  # replayed as written
        log = more
    again = IncrementalSync(spark, root, "key", "off", (), 4)
    while again.run(log):
        pass
    rows = [tuple(r) for r in again.sink().collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(k, o) for k, o in map(tuple, log.collect()) if k}
    assert again.run(log) is None


def test_shared_folder_is_not_the_machine_s_on_a_cluster(spark):
    from leafmill.tables import shared_dir

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Cluster, "x")


# -- retrieval ------------------------------------------------------------------------------------------------------------


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, node_id long, score double, rank int")


def test_rrf_hybrid_and_evaluation(spark):
    a, b = hits(spark, [(1, 10, 3.0, 1), (1, 11, 2.0, 2)]), hits(spark, [(1, 11, 9.0, 1), (1, 12, 8.0, 2)])
    assert [r.node_id for r in R.rrf([a, b]).orderBy("rank").collect()] == [11, 10, 12]
    assert [r.node_id for r in R.rrf([a, b.limit(0)]).orderBy("rank").collect()] == [10, 11]
    assert [(r.node_id, r.score) for r in R.hybrid(a, b, 0.25).orderBy("rank").collect()] == [(11, 0.75), (10, 0.25), (12, 0.0)]
    q = spark.createDataFrame([(1, 11), (2, 5)], "query_id long, node_id long")
    assert tuple(R.evaluate(a, q).head()) == (2, 0.5, 0.25)


def test_search_edge_cases(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, 1.0])], "node_id long, v array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, None)], "query_id long, v array<double>")
    assert [(r.query_id, r.node_id) for r in R.dense_top_k(q, v, 2).orderBy("rank").collect()] == [(9, 1), (9, 5)]
    assert R.dense_top_k(q.limit(0), v).count() == 0 and R.dense_top_k(q, v.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "the red fox"), (2, None), (3, ""), (4, "red red dog")], "node_id long, text string")
    qs = spark.createDataFrame([(1, "red fox"), (2, None), (3, "")], "query_id long, text string")
    assert [r.node_id for r in R.bm25_top_k(qs, docs).orderBy("rank").collect()] == [1, 4]
    assert R.bm25_top_k(qs, docs.limit(0)).count() == 0


def test_answers(spark):
    docs = spark.createDataFrame([(1, "d", "First. Second."), (2, "d", "x" * 300)], "node_id long, doc_id string, text string")
    q = spark.createDataFrame([(1, "what first?")], "query_id long, text string")
    h = hits(spark, [(1, 1, 2.0, 1), (1, 2, 1.0, 2)])
    r = R.answers(h, q, docs).head()
    assert r.answer == "First." and "what first?" in r.prompt and [s["index"] for s in r.sources] == [1, 2] and r.sources[1].content == "x" * 200 + "..."
    assert R.answers(h, q, docs, lambda p: F.lit("model")).head().answer == "model"
    assert [x.node_id for x in R.rerank(h, q, docs).orderBy("rank").collect()] == [1, 2]


def test_rerank_reads_whole_texts(spark):
    docs = spark.createDataFrame([(1, "d", "red"), (2, "d", "pad " * 500 + "red fox")], "node_id long, doc_id string, text string")
    q = spark.createDataFrame([(1, "red fox")], "query_id long, text string")
    h = hits(spark, [(1, 1, 2.0, 1), (1, 2, 1.0, 2)])
    assert [(x.node_id, x.score) for x in R.rerank(h, q, docs).orderBy("rank").collect()] == [(2, 1.0), (1, 0.5)]
    assert [x.node_id for x in R.rerank(h, q, docs, most_chars=1500).orderBy("rank").collect()] == [1, 2]


def test_pipeline_and_engine(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "lang.md").write_text("# Language\nPython is a programming language. It is simple.")
    (d / "ml.txt").write_text("Machine learning finds patterns in data by training models.")
    p = IngestionPipeline(spark, str(tmp_path / "store"), Settings(recursive=False))
    stats = p.run(str(d))
    assert stats["processed_files"] == 2 and stats["errors"] == 0 and stats["generated_chunks"] == 2
    p.run(str(d))
    assert p.stats().head().chunks == 2
    q = spark.createDataFrame([(1, "programming language"), (2, "training models on data")], "query_id long, text string")
    got = {r.query_id: r for r in QueryEngine(p.store.read()).query(q).collect()}
    assert "Python is a programming language." in got[1].answer and got[2].answer.startswith("Machine learning")
    (d / "ml.txt").write_text("Changed text about boats.")
    (d / "new.txt").write_text("Another file here.")
    assert p.sync(str(d)) == {"updated": 1, "inserted": 1, "unchanged": 1}
    (d / "lang.md").unlink()
    assert p.sync(str(d)) == {"deleted": 1, "unchanged": 2}
    texts = " ".join(r.text for r in p.store.read().collect())
    assert "boats" in texts and "Another" in texts and "Python" not in texts and "Machine" not in texts


# -- encoders, layout, cells, cache ------------------------------------------------------------------------------------------


def test_encoders(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "node_id long, text string")
    v = {r.node_id: r.embedding for r in E.encode(d).collect()}
    assert set(v) == {1, 3} and abs(sum(x * x for x in v[1]) - 1) < 1e-5
    some = d.withColumn("embedding", F.when(F.col("node_id") == 1, F.array(F.lit(9.0).cast("float"))))
    assert {r.node_id: r.embedding and len(r.embedding) for r in E.fill_missing(some).collect()} == {1: 1, 2: None, 3: 64}
    s = {r.node_id: list(zip(r.indices, r["values"])) for r in E.sparse_arrays(spark.createDataFrame([(1, 5, 0.5), (1, 5, 0.75), (1, 2, 1.0), (1, 3, 0.0)], "node_id long, token int, weight double")).collect()}
    assert s == {1: [(2, 1.0), (5, 0.75)]}
    same = E.compare(E.encode(d), E.encode(d)).head()
    assert same.vectors == 2 and same.worst == 0


def test_layout(spark):
    b = spark.createDataFrame([(1, 1, 1, 0.0, 10.0, 0.0, 10.0, "text", "a", 0.9), (1, 1, 2, 1.0, 11.0, 0.0, 10.0, "text", "b", 0.8), (1, 1, 3, 0.0, 10.0, 250.0, 260.0, "text", "c", 0.7)], "doc_id long, page int, box_id long, x0 double, x1 double, top double, bottom double, kind string, text string, score double")
    assert {r.box_id for r in L.suppress(b).collect()} == {1, 3}
    assert [r.text for r in L.merge_lines(b).orderBy("line").collect()] == ["a b", "c"]
    region = spark.createDataFrame([(1, 1, 7, 0.0, 20.0, 0.0, 240.0, "text"), (1, 1, 8, 0.0, 20.0, 0.0, 12.0, "title")], "doc_id long, page int, box_id long, x0 double, x1 double, top double, bottom double, kind string")
    assert {(r.box_id, r.region_id) for r in L.assign_regions(b, region).collect()} == {(1, 8), (2, 8)}
    assert L.overlapping(b, region).where("l_box_id = 1 and r_box_id = 7").head().shared == 100.0
    assert L.overlapping(b.limit(0), region).count() == 0


def test_cells_and_codes(spark):
    d = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(600)], "k long, v string")
    assert [r["__n"] for r in K.numbered(d, "k").orderBy("k").collect()] == list(range(600))
    html = K.sheet_chunks(d, "k", ["k", "v"], "cap").orderBy("chunk").collect()
    assert len(html) == 3 and html[0].html.count("<tr>") == 257 and html[2].html.count("<tr>") == 600 - 512 + 1
    assert one(spark, K.row_line(["a", "b"], "sheet1"), a="x", b=None) == "a：x"
    codes = spark.createDataFrame([(1, None, "w"), (2, 1, "e"), (3, 2, "d"), (8, 9, "x"), (9, 8, "y")], "code long, parent long, name string")
    assert {tuple(r) for r in K.code_paths(codes).collect()} == {(1, "w"), (2, "w > e"), (3, "w > e > d")}


def test_cache_and_retry(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    store = spark.createDataFrame([("a", 1)], "k string, v int")
    got, new = cache.cached(rows, store, "k", lambda r: r.select("k", F.lit(2).alias("v")))
    assert sorted((r.k or "", r.v) for r in got.collect() if r.k) == [("a", 1), ("a", 1), ("b", 2)] and new.count() == 1
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise Boom
        return 7

    assert cache.retry(flaky, wait=0) == 7 and len(calls) == 3
    with pytest.raises(Boom):
        cache.retry(lambda: (_ for _ in ()).throw(Boom()), 2, 0)
