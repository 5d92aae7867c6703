"""Blocks whose text comes from models, and what is made of their answers: refinement, polish, placeholders, tables.

Models are given as columns to columns; without one the text as read stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.functions.spans import model_answer, spaced_letters, twiddle
from leafmill.functions.text import math_delimiters

SPACED = r"\b([A-Za-z]\s){2,}[A-Za-z]\b"
NO_FIGURE = "Figure (description unavailable)."


def formula_text(latex: Column) -> Column:
    """A formula as a block: spaced letters joined, the rotating factor in one form, delimiters of one kind."""
    s = math_delimiters(spaced_letters(F.trim(twiddle(latex))))
    return F.when(F.trim(latex) == "", F.lit("")).when(s.contains("$$"), s).otherwise(F.concat(F.lit("$$\n"), s, F.lit("\n$$")))


def unsure(latex: Column, score: Column, least: float = 0.85) -> Column:
    """Whether a reading should be read again: no text, fewer than 3 characters, or a score that is known and below `least`."""
    return F.coalesce(F.length(F.trim(latex)) < 3, F.lit(True)) | F.coalesce(score < least, F.lit(False))


def read_formulas(readings: DataFrame, refine: Callable[[Column], Column] | None = None) -> DataFrame:
    """readings (.., latex, score) with text and refined: unsure ones go through `refine`, all are brought to one form; a null
    reading is empty."""
    again = unsure(F.col("latex"), F.col("score")) & F.lit(refine is not None)
    latex = F.when(again, model_answer(refine(F.col("latex")))).otherwise(F.col("latex")) if refine else F.col("latex")
    return readings.withColumn("text", formula_text(F.coalesce(latex, F.lit("")))).withColumn("refined", again)


def needs_polish(text: Column) -> Column:
    """Text with spaced letters, or with places of blocks to be put in."""
    return F.coalesce(text.rlike(SPACED) | text.contains("[IMAGE_BLOCK_"), F.lit(False))


def polish(nodes: DataFrame, complete: Callable[[Column], Column] | None = None) -> DataFrame:
    """nodes (.., text) with polished: spaced letters joined; what needs more goes through `complete`, where an answer that is
    null or empty leaves the text."""
    fixed = spaced_letters(F.col("text"))
    if complete is None:
        return nodes.withColumn("polished", fixed)
    answer = spaced_letters(model_answer(complete(fixed)))
    return nodes.withColumn("polished", F.when(needs_polish(fixed) & (F.coalesce(answer, F.lit("")) != ""), answer).otherwise(fixed))


def resolve_blocks(items: DataFrame, results: DataFrame) -> DataFrame:
    """items (block_id, kind, raw_text) with text: the place mark and, below it, the answer for the block (results: block_id,
    answer). Images without an answer say so, formulas fall back on what was read, tables on nothing. A block answered
    twice takes the greater answer."""
    given = results.where("block_id is not null").groupBy("block_id").agg(F.max("answer").alias("__a"))
    mark = F.concat(F.lit("[IMAGE_BLOCK_"), F.col("block_id").cast("string"), F.lit("]"))
    answer = F.coalesce(model_answer(F.col("__a")), F.lit(""))
    content = F.when(F.col("kind") == "image", F.when(answer != "", answer).otherwise(F.lit(NO_FIGURE))).when(F.col("kind") == "formula", formula_text(F.when(answer != "", answer).otherwise(F.coalesce("raw_text", F.lit(""))))).otherwise(answer)
    return items.join(given, "block_id", "left").withColumn("text", F.when(content != "", F.concat(mark, F.lit("\n"), content)).otherwise(mark)).drop("__a")


def fill_places(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """nodes (node_id, text, ..) with the place marks in the text replaced by the text of their blocks (node_id, block_id, text),
    in order of block_id; marks of no block stay."""
    listed = blocks.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("block_id", F.col("text").alias("t")))).alias("__b"))
    mark = lambda b: F.concat(F.lit("[IMAGE_BLOCK_"), b["block_id"].cast("string"), F.lit("]"))
    put = F.aggregate(F.coalesce("__b", F.array()), F.col("text"), lambda s, b: F.replace(s, mark(b), F.coalesce(b["t"], F.lit(""))))
    return nodes.join(listed, "node_id", "left").withColumn("text", put).drop("__b")


def ctc_text(classes: Column, scores: Column, alphabet: str, blank: int = 0) -> tuple[Column, Column]:
    """(text, confidence) of a line's best classes and their scores step by step: repeats count once, blanks not at all; the
    confidence is the mean score of what is kept, 0 without any. Class k stands for the k-th character behind the blank."""
    steps = F.arrays_zip(classes.alias("c"), scores.alias("s"))
    kept = F.filter(steps, lambda x, i: (x["c"] != blank) & ((i == 0) | (F.get(classes, i - 1) != x["c"])))
    letters = F.transform(kept, lambda x: F.substring(F.lit(alphabet), x["c"].cast("int"), F.lit(1)))
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["s"]) / F.size(kept)
    return F.array_join(letters, ""), F.when(F.size(kept) > 0, mean).otherwise(0.0)


def tables_as_html(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html) of cells (keys, row, col, text, header): rows in order, cells by column, gaps empty. A row most of whose
    filled cells are headers is a header row. Columns with less than a cell in four rows, of tables of four and more
    columns, join the column before, as stray pieces of its cells."""
    c = cells.where(F.col("row").isNotNull() & F.col("col").isNotNull()).withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    per = Window.partitionBy(*keys)
    shape = c.groupBy(*keys, "col").agg(F.countDistinct("row").alias("filled")).withColumns({"cols": F.count("*").over(per), "first": F.min("col").over(per)})
    rows = c.groupBy(*keys).agg(F.countDistinct("row").alias("rows"))
    stray = (F.col("cols") >= 4) & (F.col("filled") * 4 < F.col("rows")) & (F.col("col") > F.col("first"))
    place = F.sum(F.when(stray, 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy("col"))
    at = shape.join(rows, keys).withColumn("place", place).select(*keys, "col", "place")
    width = at.groupBy(*keys).agg(F.max("place").alias("width"))
    one = c.join(at, [*keys, "col"]).groupBy(*keys, "row", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " ").alias("text"), F.max(F.coalesce(F.col("header").cast("int"), F.lit(0))).alias("h"))
    head = F.sum("h") * 2 > F.count("*")
    line = one.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("place", "text"))).alias("m"), F.when(head, "th").otherwise("td").alias("tag")).join(width, keys)
    cell = F.transform(F.sequence(F.lit(1).cast("long"), F.col("width").cast("long")), lambda k: F.concat(F.lit("<"), F.col("tag"), F.lit(">"), F.coalesce(F.try_element_at("m", k), F.lit("")), F.lit("</"), F.col("tag"), F.lit(">")))
    tr = line.select(*keys, "row", F.concat(F.lit("<tr>"), F.array_join(cell, ""), F.lit("</tr>")).alias("tr"))
    return tr.groupBy(*keys).agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "tr"))), lambda x: x["tr"]), ""), F.lit("</table>")).alias("html"))


def flatten(df: DataFrame, json: str, fields: dict[str, str], decode: dict[str, dict[str, str]] | None = None, fallback: dict[str, str] | None = None) -> DataFrame:
    """df with a text column for each of `fields`, {name: path}, of its JSON column, by name: tabs and line ends to spaces,
    codes of `decode` to their words, empty fields of `fallback` from another field."""
    got = {n: F.regexp_replace(F.get_json_object(F.col(json), f"$.{p}"), r"[\t\r\n]+", " ") for n, p in fields.items()}
    for n, to in (decode or {}).items():
        words = F.create_map(*(F.lit(x) for pair in to.items() for x in pair))
        got[n] = F.coalesce(F.try_element_at(words, got[n]), got[n])
    for n, other in (fallback or {}).items():
        got[n] = F.when(F.coalesce(got[n], F.lit("")) != "", got[n]).otherwise(got[other])
    return df.withColumns(got)


def lexical_items(items: Column) -> Column:
    """A map of token number to weight from a map of texts: what is no whole number, or no number but zero, leaves."""
    entries = F.transform(F.map_entries(items), lambda e: F.struct(e["key"].try_cast("int").alias("key"), e["value"].try_cast("float").alias("value")))
    fine = F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull() & (e["value"] != 0) & ~F.isnan(e["value"]))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(fine, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.array_max(F.transform(F.filter(fine, lambda e: e["key"] == k), lambda e: e["value"])).alias("value"))))


def embed_content(metadata: list[str], text: str = "text") -> Column:
    """What an encoder sees of a node: a line ``name: value`` for each field that has one, an empty line, the text."""
    lines = F.filter(F.array(*(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in metadata)), lambda x: x.isNotNull())
    head = F.array_join(lines, "\n")
    return F.when(head == "", F.coalesce(text, F.lit(""))).otherwise(F.concat(head, F.lit("\n\n"), F.coalesce(text, F.lit(""))))


def line_range(text: Column) -> Column:
    """``1-n`` for a text of n lines."""
    return F.concat(F.lit("1-"), F.size(F.split(text, "\n")).cast("string"))


# Parts of a path that tell the domain of a document.
PROTOCOLS, SIGNALS = ("http", "protocol", "rfc", "tcp", "udp", "ip"), ("dsp",)


def domain_of_pdf(domain: Column, source: Column) -> Column:
    """The domain given, else HTTP or DSP by the parts of the path, else null."""
    parts = F.split(F.lower(F.coalesce(source, F.lit(""))), "/")
    any_of = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return F.when(F.coalesce(domain, F.lit("")) != "", domain).when(any_of(PROTOCOLS), "HTTP").when(any_of(SIGNALS), "DSP")
