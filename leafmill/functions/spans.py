"""Columns over text spans and blocks of pages, and over what models answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.text import spaced_letters  # noqa: F401  (part of the public surface)

# What names monospace and mathematical fonts, and how section titles begin.
MONO = r"(?i)mono|courier|consol|menlo|code"
MATH_FONT = r"(?i)math|symbol|cmmi|cmsy|cmex|euclid"
TITLE = r"(?i)^(chapter\s+\d+|section\s+\d+|lecture\s+\d+|part\s+[ivx]+|table\s+of\s+contents|references|appendix|\d+(\.\d+)*\s+[\w\s]+|[ivx]+\.\s+[\w\s]+)"


def model_answer(text: Column) -> Column:
    """A model's answer without its opening courtesy, fences and quote marks."""
    s = F.regexp_replace(F.trim(text), r"(?i)\A(sure|certainly|of course|here is|here's|okay)[^\n]*[:!.]\s*\n", "")
    s = F.regexp_replace(s, r"(?m)^```[a-zA-Z]*[ \t]*$\n?", "")
    return F.regexp_replace(F.regexp_replace(s, r"(?m)^>[ \t]?", ""), r"\A\s+|\s+\z", "")


def twiddle(text: Column) -> Column:
    """Ways of writing the rotating factor brought to ``W_N^{..}``."""
    s = F.regexp_replace(text, r"W\s*_?\s*\{?N\}?\s*\^\s*\{([^{}]*)\}", r"W_N^{$1}")
    return F.regexp_replace(s, r"W\s*_?\s*\{?N\}?\s*\^\s*(-?\w+)", r"W_N^{$1}")


def is_code_font(font: Column) -> Column:
    return font.rlike(MONO)


def is_math_span(font: Column, flags: Column, text: Column) -> Column:
    """A mathematical font, or short italics shaped like a symbol with its index."""
    token = (F.length(text) <= 40) & text.rlike(r"^[A-Za-z\p{IsGreek}][\w\p{IsGreek}]{0,2}([_^\[(=+*/<>-].*)?$")
    return font.rlike(MATH_FONT) | (flags.bitwiseAND(2) == 2) & token


def needs_formula_reading(math_spans: Column, symbol_spans: Column, spans: Column, math_lines: Column, lines: Column, text: Column) -> Column:
    """Whether a block should be read as a formula: by its shares of mathematical spans (0.3), symbol spans (0.25) and lines
    (0.2); prose of 60 characters and more, above 60 % letters, is not."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))
    prose = (F.length(text) >= 60) & (letters > 0.6)
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    return ~prose & ((share(math_spans, spans) >= 0.3) | (share(symbol_spans, spans) >= 0.25) | (share(math_lines, lines) >= 0.2))


def is_section_title(text: Column, y: Column, font: Column, body_font: Column, height: Column) -> Column:
    """2 to 100 characters and no page number; a title's beginning (upper 60 %, font 1.2 times the body's), four and more
    capitals alone (75 %, 1.1 times), or a font 1.6 times the body's (70 %). Sizes that are not known do not count against."""
    known = lambda c, otherwise: F.coalesce(c, F.lit(otherwise))
    letters = F.regexp_replace(text, r"[^A-Za-z]", "")
    begin = text.rlike(TITLE) & known(y <= height * 0.6, True) & known(font >= body_font * 1.2, True)
    caps = ~text.rlike(TITLE) & (F.length(letters) >= 4) & (F.upper(letters) == letters) & known(y <= height * 0.75, True) & known(font >= body_font * 1.1, True)
    large = ~text.rlike(TITLE) & known(font >= body_font * 1.6, False) & known(y <= height * 0.7, False)
    return F.length(text).between(2, 100) & ~text.rlike(r"^\d+(\s*[-/]\s*\d+)?$") & (begin | caps | large)


def block_lines(spans: DataFrame) -> DataFrame:
    """(doc_id, page, block, line, text, spans, math_spans, code, font): spans (.., line, span, text, font, flags, size) put
    together, runs of mathematics between dollar signs, lines of code alone marked."""
    math = is_math_span(F.col("font"), F.col("flags"), F.col("text"))
    s = spans.withColumn("m", math).withColumn("c", is_code_font(F.col("font")))
    parts = F.array_sort(F.collect_list(F.struct("span", "text", "m")))
    text = F.array_join(F.transform(parts, lambda p: F.when(p["m"], F.concat(F.lit("$"), p["text"], F.lit("$"))).otherwise(p["text"])), "")
    return s.groupBy("doc_id", "page", "block", "line").agg(text.alias("text"), F.count("*").alias("spans"), F.sum(F.col("m").cast("long")).alias("math_spans"), F.every("c").alias("code"), F.max("size").alias("font"))


def body_font(spans: DataFrame) -> DataFrame:
    """(doc_id, page, body_font): the median size of a page's spans."""
    return spans.groupBy("doc_id", "page").agg(F.median("size").alias("body_font"))


def prompt_mode(kind: Column, domain: Column) -> Column:
    """The name of the prompt for a block: by its kind, for protocols an own one."""
    return F.when(kind == "formula", "formula").when(kind == "table", "table").when(domain.isin("RFC", "HTTP"), "protocol").otherwise("figure")


def language_vote(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, english): whether most pages of a document are written in Latin letters and common signs alone."""
    return docs.groupBy(id_col).agg((F.avg(F.col(text_col).rlike(r"^[ -~\s]*$").cast("int")) > 0.5).alias("english"))
