import datetime

import pytest
from pyspark.sql import functions as F

from leafmill.functions import elements as EL, records as RC, spans as SP
from leafmill.operators import layout as L
from leafmill.plans.registry import QUERIES


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).head()["x"]


def test_letters_and_answers(spark):
    t = F.col("t")
    for text, want in [("T h e end", "The end"), ("a b and c", "a b and c"), ("x y z w!", "xyzw!"), ("", ""), (None, None)]:
        assert one(spark, SP.spaced_letters(t), t=text) == want
    assert one(spark, SP.model_answer(t), t="Sure, here it is:\n```latex\n> x^2\n```\n") == "x^2"
    assert one(spark, SP.twiddle(t), t="W_{N}^{nk} and W N ^k") == "W_N^{nk} and W_N^{k}"


def test_titles(spark):
    d = lambda v: F.lit(v).cast("double")
    title = lambda t, y=None, f=None, b=None, h=None: one(spark, SP.is_section_title(F.col("t"), d(y), d(f), d(b), d(h)), t=t)
    assert title("Chapter 3") and title("1.2 Scope of it") and title("GENERAL") and not title("12") and not title("x") and not title("plain words") and not title("3 / 9")
    assert not title("Chapter 3", 700.0, 20.0, 10.0, 1000.0) and not title("Chapter 3", 10.0, 11.0, 10.0, 1000.0) and title("plain words", 10.0, 17.0, 10.0, 1000.0)


def test_spans(spark):
    s = spark.createDataFrame([(1, 1, 1, 1, 1, "let ", "Times", 0, 10.0), (1, 1, 1, 1, 2, "x_1", "Times", 2, 10.0), (1, 1, 1, 2, 1, "code()", "Courier", 0, 9.0)], "doc_id long, page int, block int, line int, span int, text string, font string, flags int, size double")
    rows = {r.line: r for r in SP.block_lines(s).collect()}
    assert rows[1].text == "let $x_1$" and rows[1].math_spans == 1 and rows[2].code and not rows[1].code
    assert SP.body_font(s).head().body_font == 10.0
    need = SP.needs_formula_reading(F.lit(2), F.lit(0), F.lit(4), F.lit(0), F.lit(2), F.col("t"))
    assert one(spark, need, t="short") and not one(spark, need, t="a long line of plain words that is surely prose and nothing else at all")


def test_records(spark):
    t = F.col("t")
    assert one(spark, RC.company_name(t), t="ＡＢＣ Trading (China) Co., Ltd.") == "abc trading" and one(spark, RC.company_name(t), t="阿里有限公司") == "阿里"
    assert one(spark, RC.phone(t), t="+86 138-0013-8000") == "13800138000" and one(spark, RC.phone(t), t="12") is None
    assert one(spark, RC.email(t), t="write to A.b@Ex.org now") == "a.b@ex.org" and one(spark, RC.email(t), t="none") is None
    assert one(spark, RC.prefixes(t), t="abc") == ["a", "ab", "abc"] and one(spark, RC.prefixes(t), t="") == []
    assert one(spark, RC.field(t, "a", "0", "b"), t='{"a":[{"b":7}]}') == "7" and one(spark, RC.field(t, "a"), t="{broken") is None
    assert one(spark, RC.combined_tags(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x")), F.array().cast("array<string>")), t="") == ["ax", "bx"]
    day = lambda d: datetime.date(2020, 1, d)
    df = spark.createDataFrame([([(day(1), day(3)), (day(5), None), (None, day(1)), (day(9), day(2))],)], "i array<struct<s:date,e:date>>")
    got = df.select(RC.spans_in_time(F.col("i"), "s", "e", F.lit(day(10))).alias("d"), RC.latest_first(F.col("i"), "s").alias("l")).head()
    assert got.d == [2, 5, None, None] and got.l[0]["x"]["s"] == day(9)
    h = RC.history(spark.createDataFrame([(1, day(1), 5), (1, day(4), 9), (1, day(5), 1), (1, None, 99)], "k long, t date, v int"), "k", "t", "v").head()
    assert (h.entries, h.mean_gap, h.longest_gap, h.greatest, h.days) == (3, 2.0, 3, 9, 4)


def test_elements():
    t = "# H\npara one\npara two\n\n- a\n  more\n- b\n> q\n```\ncode # x\n\n```\n| a | b |\n|---|---|\n| 1 | 2 |"
    got = EL.markdown_elements(t)
    assert [(e["kind"], e["start"], e["end"]) for e in got] == [("header", 0, 0), ("paragraph", 1, 2), ("list", 4, 6), ("quote", 7, 7), ("code", 8, 11), ("table", 12, 14)]
    rest, tables = EL.pull_tables("before\n| a | b |\n|---|---|\n| 1 | 2 |\nmiddle\na | b\n--- | ---\n1 | 2\nend <table><tr><td>x</table> z")
    assert len(tables) == 3 and rest.split() == ["before", "middle", "end", "z"] and EL.pull_tables("none") == ("none", [])
    blocks = EL.html_blocks("<h2>Head</h2><p>One <b>two</b></p><table><tr><td>a<td>b</table><script>x</script>tail")
    assert blocks[:2] == [("h2", "## Head"), ("p", "One two")] and blocks[2][0] == "table" and blocks[-1][1] == "tail"
    packed = EL.pack_blocks([("p", "w " * 30), ("p", "v " * 5), ("table", "\n".join("| r |" for _ in range(20)))], 20)
    assert sum(p.count("w") for p in packed) == 30 and sum(p.count("r") for p in packed) == 20 and EL.pack_blocks([]) == []


@pytest.mark.parametrize(("rows", "want"), [([["h", "k"], ["1", "2"], ["3", ""]], ["h: 1; k: 2\nh: 3"]), ([["a", "b", "c", "d"], ["u", "v", "w", "z"], ["1", "2", "3", "4"], ["5", "6", "7", "8"]], ["a,u: 1; b,v: 2; c,w: 3; d,z: 4", "a,u: 5; b,v: 6; c,w: 7; d,z: 8"]), ([], []), ([["only", ""]], ["only"])])
def test_table_sentences(rows, want):
    assert EL.table_sentences(rows) == want


def test_converter_and_json():
    c = '[{"type":"text","text":"a","page_idx":0},{"type":"discarded","text":"x"},{"type":"table","table_caption":["T"],"table_body":"<table/>"},{"type":"list","list_items":["1","2"]},{"type":"equation","text":"$x$"}]'
    assert [t for _, t, _ in EL.converter_sections(c)] == ["a", "T\n<table/>", "1\n2", "$x$"]
    assert EL.json_pieces('{"a":1}\nbroken\n{"b":2}') == ['{"a": 1}', '{"b": 2}'] and EL.json_pieces("") == []


BOX = "doc_id long, page int, box_id long, x0 double, x1 double, top double, bottom double, kind string, text string, score double"


def test_layout_more(spark):
    b = spark.createDataFrame([(1, 1, 1, 0.0, 10.0, 0.0, 10.0, "text", "a", 0.9), (1, 1, 2, 0.0, 10.0, 1.0, 11.0, "text", "b", 0.8), (1, 1, 3, 100.0, 110.0, 0.0, 10.0, "text", "c", 0.3)], BOX)
    assert {r.box_id for r in L.drop_covered(b).collect()} == {1, 3}
    assert [r.box_id for r in L.reading_order(L.columns(b)).orderBy("place").collect()] == [1, 2, 3]
    t = spark.createDataFrame([(1, 1, 9, 90.0, 120.0, 0.0, 20.0)], "doc_id long, page int, box_id long, x0 double, x1 double, top double, bottom double")
    assert {r.box_id for r in L.without_contained(b, t).collect()} == {1, 2}
    assert {(r.caption_id, r.figure_id) for r in L.nearest_captions(b.where("box_id < 3"), t).collect()} == {(1, 9), (2, 9)}
    rows = spark.createDataFrame([(1, 1, 1, 0.0, 200.0, 0.0, 10.5)], t.schema)
    cols = spark.createDataFrame([(1, 1, 1, 0.0, 50.0, 0.0, 50.0), (1, 1, 2, 90.0, 150.0, 0.0, 50.0)], t.schema)
    assert {(r.row, r.col, r.text) for r in L.table_cells(b, rows, cols).collect()} == {(1, 1, "a b"), (1, 2, "c")}
    dots = spark.createDataFrame([(1, 1, i, 0.0, 1.0, 0.0, 1.0, "text", f"Part {i} ......... {i}", 1.0) for i in range(5)], BOX)
    assert L.contents_pages(dots).count() == 1 and L.contents_pages(b).count() == 0
    assert {r.text for r in L.confident(b).collect()} == {"a", "b", ""}


def test_prefixes_of_all_names(spark, sf):
    named = spark.read.parquet(f"{sf}/customer.parquet").where("c_name <> ''").select("c_custkey").distinct()
    assert QUERIES["name_prefixes"](spark, sf).select("c_custkey").distinct().count() == named.count() > 0


def test_page_sections_have_all_titles(spark, sf):
    n = spark.read.parquet(f"{sf}/text_nodes.parquet").where("page is not null and section_header is not null")
    want = {tuple(r) for r in n.select("doc_id", "section_header").distinct().collect()}
    got = {tuple(r) for r in QUERIES["page_sections"](spark, sf).where("title is not null").select("doc_id", "title").distinct().collect()}
    assert want == got and want


def test_contents_are_dropped(spark):
    texts = {1: ["Preface", "Table of Contents", "Chapter 1 Start", "Chapter 2 More", None, "Chapter 1 Start", "Body", "Chapter 2 More"], 2: ["目 录", "", "第一章 甲", "第二章 乙", "第一章 甲", "文"], 3: [f"{i} ........ 3" for i in range(4)] + ["Text"], 4: ["Contents", "Alone"]}
    rows = [(d, 1 if i < 4 else 2, i, 0.0, float(i), t) for d, ts in texts.items() for i, t in enumerate(ts)]
    boxes = spark.createDataFrame(rows, "doc_id int, page int, box_id int, x0 double, top double, text string")
    got = {}
    for r in L.drop_contents(boxes).orderBy("doc_id", "box_id").collect():
        got.setdefault(r.doc_id, []).append(r.box_id)
    assert got == {1: [0, 5, 6, 7], 2: [4, 5], 3: [4]}


def test_table_alignment(spark):
    few = [(1, "table row", 10.0, 90.0, 0.0, 9.0), (1, "table row", 12.0, 95.0, 10.0, 19.0), (1, "table column header", 11.0, 80.0, 0.0, 9.0), (1, "table column", 10.0, 50.0, 2.0, 18.0), (1, "table column", 50.0, 90.0, 1.0, 19.0), (1, "table", 5.0, 99.0, 0.0, 20.0)]
    many = [(2, "table row", float(x), 100.0, 0.0, 1.0) for x in (0, 0, 0, 0, 10)] + [(2, "table column", 0.0, 1.0, float(y), 50.0) for y in (1, 2, 3, 4, 100)]
    parts = spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(few + many)], "doc_id int, page int, n int, table_id int, label string, x0 double, x1 double, top double, bottom double")
    got = {r.n: (r.x0, r.x1, r.top, r.bottom) for r in L.align_tables(parts).collect()}
    assert got[1] == (10.0, 95.0, 10.0, 19.0) and got[2] == (10.0, 95.0, 0.0, 9.0) and got[3] == (10.0, 50.0, 1.0, 19.0) and got[5] == (5.0, 99.0, 0.0, 20.0)
    assert [got[6 + i][0] for i in range(5)] == [0.0, 0.0, 0.0, 0.0, 2.0] and [got[11 + i][2] for i in range(5)] == [1.0, 2.0, 3.0, 3.0, 3.0]


def test_tables_over_pages(spark):
    rows = [(1, 1, 10, 50.0, 780.0), (1, 2, 11, 20.0, 790.0), (1, 3, 12, 30.0, 200.0), (1, 3, 13, 250.0, 300.0), (1, 5, 14, 20.0, 90.0), (2, 1, 20, 10.0, 400.0), (2, 2, 21, 10.0, 90.0)]
    tables = spark.createDataFrame([(*r[:3], 0.0, *r[3:], 800.0, 10.0) for r in rows], "doc_id int, page int, table_id int, x0 double, top double, bottom double, page_height double, line_height double")
    assert {r.table_id: r.whole for r in L.continued_tables(tables).collect()} == {10: 10, 11: 10, 12: 10, 13: 13, 14: 14, 20: 20, 21: 21}


def test_scraps_are_dropped(spark):
    rows = [(1, "title", "1.2 Scope", 50.0, 90.0, 0.0), (2, "text", "below it", 50.0, 110.0, 12.0), (3, "text", "wide", 50.0, 300.0, 200.0), (4, "text", "scrap", 500.0, 520.0, 400.0), (5, None, "7", 10.0, 15.0, 500.0)]
    boxes = spark.createDataFrame([(1, 1, i, k, t, a, b, y, y + 10.0, 600.0) for i, k, t, a, b, y in rows], "doc_id int, page int, box_id int, kind string, text string, x0 double, x1 double, top double, bottom double, page_width double")
    assert [r.box_id for r in L.drop_scraps(boxes).orderBy("box_id").collect()] == [1, 2, 3]


def test_every_box_is_a_region(spark, sf):
    boxes = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    assert QUERIES["box_overlaps"](spark, sf).select("r_box_id").distinct().count() == boxes
    assert QUERIES["region_assignment"](spark, sf).count() == boxes
