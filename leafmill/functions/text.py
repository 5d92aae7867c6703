"""Column functions: normalising, classifying and hashing text. All stay in the JVM and give null for null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Path components that name a domain, and the labels.
DOMAINS = {"rfc": "RFC", "k8s": "Kubernetes", "docker": "Docker", "dsp": "DSP", "llamaindex": "LlamaIndex", "langchain": "LangChain", "langgraph": "LangGraph"}
# File types by extension.
MIME = {".md": "text/markdown", ".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf", ".json": "application/json", ".csv": "text/csv", ".xml": "text/xml"}
# Patterns of the classes of table cells, in order.
CELL_TYPES = [
    (r"^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$", "Dt"),
    (r"^(20|19)[0-9]{2}年$", "Dt"),
    (r"^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$", "Dt"),
    (r"^[0-9]{1,2}[月-][0-9]{1,2}日*$", "Dt"),
    (r"^第*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}年*[一二三四1-4]季度$", "Dt"),
    (r"^(20|19)[0-9]{2}[ABCDE]$", "Dt"),
    (r"^[0-9.,+%/ -]+$", "Nu"),
    (r"^[0-9A-Z/\._~-]+$", "Ca"),
    (r"^[A-Z]*[a-z' -]+$", "En"),
    (r"^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$", "NE"),
    (r"^.{1}$", "Sg"),
]
# Patterns of bullets and numbered headings with their levels, in order.
BULLETS = [
    (r"^第[零一二三四五六七八九十百]+章", 1),
    (r"^第[零一二三四五六七八九十百]+[条节]", 2),
    (r"^[零一二三四五六七八九十百]+[、 　]", 3),
    (r"^[\(（][零一二三四五六七八九十百]+[）\)]", 4),
    (r"^[0-9]+(、|\.[　 ]|\.[^0-9])", 5),
    (r"^[0-9]+\.[0-9]+(、|[. 　]|[^0-9])", 6),
    (r"^[0-9]+\.[0-9]+\.[0-9]+(、|[ 　]|[^0-9])", 7),
    (r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(、|[ 　]|[^0-9])", 8),
    (r"^.{0,48}[：:?？]$", 9),
    (r"^[0-9]+）", 10),
    (r"^[\(（][0-9]+[）\)]", 11),
    (r"^[零一二三四五六七八九十百]+是", 12),
    (r"^[⚫•➢✓]", 12),
]
# What a formula looks like, and signs that only formulas have.
FORMULA_PATTERNS = [r"W_N", r"x\[n\]", r"X\(z\)", r"H\(e\^", r"e\^\{?[j-]\w", r"\\[a-zA-Z]+", r"[_^]\{?[\w+-]+\}?"]
FORMULA_SIGNS = "[∫∑∏∂√∈∀∃≠≈≤≥]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"
TOKEN = r"[\p{L}\p{N}]+"


def domain_of(path: Column) -> Column:
    """The label of the first path component that names a domain, in any letter case; null where none does."""
    parts = F.filter(F.transform(F.split(path, "/"), F.lower), lambda p: p.isin(list(DOMAINS)))
    labels = F.create_map(*(F.lit(x) for kv in DOMAINS.items() for x in kv))
    return F.when(F.size(parts) > 0, F.element_at(labels, F.element_at(parts, 1)))


def extension_of(path: Column) -> Column:
    """The lower-case extension with its dot; empty where the name has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def mime_of(extension: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), extension)


def clean_newlines(text: Column) -> Column:
    """CRLF and CR become LF; control characters but tab and LF go; three and more LF become two."""
    text = F.regexp_replace(text, r"\r\n|\r", "\n")
    return F.regexp_replace(F.regexp_replace(text, CONTROL, ""), r"\n{3,}", "\n\n")


def strip_placeholders(text: Column, after_space: bool = False) -> Column:
    """Front matter at the start, comments and tags removed. after_space: the front matter may follow white space."""
    lead = r"\A\s*" if after_space else r"\A"
    text = F.regexp_replace(text, rf"(?s){lead}---[ \t]*\n.*?\n---[ \t]*(\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"<[^>]+>", "")


def anchor_links(text: Column) -> Column:
    """Links to places of the same document become their text."""
    return F.regexp_replace(text, r"\[([^\]]*)\]\(#[^)]*\)", "$1")


def image_targets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))


def without_images(text: Column) -> Column:
    return F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")


def header_rule(line: Column) -> Column:
    """The number of the first rule that makes a line a heading, 0 for none.

    1 a chapter; 2 all capitals; 3 a roman number; 4 number signs; 5 a short numbered line; 6 a short line with a capital;
    7 a short Chinese line with a chapter word; 8 one that ends a title word and has no sentence marks.
    """
    s = F.regexp_replace(line, r"^\s+|\s+$", "")
    n = F.length(s)
    han = s.rlike("[一-鿿]") & (n <= 25)
    return (
        F.when(s.isNull(), None)
        .when(n == 0, 0)
        .when(s.rlike(r"^第[一二三四五六七八九十0-9]+章"), 1)
        .when((n > 3) & s.rlike(r"\p{Lu}") & ~s.rlike(r"[\p{Ll}\p{Lt}]"), 2)
        .when(s.rlike(r"^[IVXLCDM]+\.\s"), 3)
        .when(s.rlike(r"^#+\s"), 4)
        .when((n < 50) & s.rlike(r"^[0-9]+(\.[0-9]+)*\s"), 5)
        .when((n < 30) & s.rlike(r"^[A-Z]"), 6)
        .when(han & s.rlike("^(章|节|部分|小结|概述|前言|后记|目录|摘要)|(章|节|部分|小结|概述|前言|后记|目录|摘要) "), 7)
        .when(han & s.rlike("(主要|功能|特性|方法|结果|讨论|结论)( |$)") & ~s.rlike("[。！？，、；：]"), 8)
        .otherwise(0)
    )


def short_line_threshold(lengths: Column) -> Column:
    """0.7 of the median of line lengths (an array), cut to whole numbers and held within 30 and 200; 80 without lines."""
    s, n = F.array_sort(lengths), F.size(lengths)
    mid = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2
    cut = F.floor(F.floor(mid) * 7 / 10).cast("int")
    return F.when(n > 0, F.greatest(F.lit(30), F.least(F.lit(200), cut))).otherwise(F.lit(80))


def line_lengths(text: Column) -> Column:
    """Lengths of the lines that are not blank, without white space around them."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.filter(lines, lambda n: n > 0)


def spaced_letters(text: Column) -> Column:
    """``T h e`` becomes ``The``: spaces go between three and more single letters."""
    return F.regexp_replace(text, r"(?<=\b[A-Za-z]) (?=[A-Za-z]\s[A-Za-z]\b)|(?<=\b[A-Za-z]\s[A-Za-z]) (?=[A-Za-z]\b)", "")


def clean_pdf_text(text: Column) -> Column:
    """Words joined over hyphenated line ends, spaced letters and fragments of inline formulas joined, white space to single
    spaces."""
    text = spaced_letters(F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2"))
    text = F.regexp_replace(text, r"\$([A-Za-z])\$\s*\[\s*\$([A-Za-z0-9]+)\$\s*\]", r"\$$1[$2]\$")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def math_delimiters(text: Column) -> Column:
    r"""``\[..\]`` becomes ``$$..$$``, ``\(..\)`` becomes ``$..$``, and ``$..$`` on one line becomes ``$$..$$``."""
    s = F.regexp_replace(F.regexp_replace(text, r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$"), r"(?s)\\\((.*?)\\\)", r"\$$1\$")
    return F.regexp_replace(s, r"(?<!\$)\$([^\n$]+)\$(?!\$)", r"\$\$$1\$\$")


def wrap_latex(text: Column) -> Column:
    """Text that looks like LaTeX becomes a formula block; tables and text with formula blocks stay."""
    s = F.trim(text)
    table = s.contains("|") & s.contains("\n")
    return F.when(table | s.contains("$$") | ~s.rlike(r"[\\_^]"), s).otherwise(F.concat(F.lit("$$\n"), s, F.lit("\n$$")))


def printable_share(text: Column) -> Column:
    """The share of characters that are printable or white space; 1 for empty text."""
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}\x{e000}-\x{f8ff}]", ""))
    return F.when(F.length(text) > 0, 1 - odd / F.length(text)).otherwise(1.0)


def is_garbled(text: Column) -> Column:
    """Less than three quarters printable, or more than 2 % replacement characters."""
    lost = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return (F.length(text) > 0) & ((printable_share(text) < 0.75) | (lost > 0.02 * F.length(text)))


def is_formula(text: Column) -> Column:
    """Empty, less than 80 % printable, garbled, or with a formula's patterns or signs."""
    hit = text.rlike("|".join(FORMULA_PATTERNS) + "|" + FORMULA_SIGNS)
    return (F.length(text) == 0) | (printable_share(text) < 0.8) | is_garbled(text) | hit


def cell_type(text: Column) -> Column:
    """The class of a table cell: Dt date, Nu number, Ca code, En English, NE number with unit, Sg one character, then by
    words of several characters Tx (4 to 11), Lx (more) or Ot."""
    s = F.trim(text)
    out = F.when(s.isNull(), None)
    for p, name in CELL_TYPES:
        out = out.when(s.rlike(p), name)
    n = F.size(F.filter(F.split(s, r"\s+"), lambda w: F.length(w) > 1))
    return out.when((n > 3) & (n < 12), "Tx").when(n >= 12, "Lx").otherwise("Ot")


def bullet_level(line: Column) -> Column:
    """1 to 12 by the first pattern that fits; 0 for lines of figures alone; null for others and for lines up to 2 characters."""
    out = F.when(F.length(line) <= 2, None).when(line.rlike(r"^[0-9 ().,%+/-]+$"), 0)
    for p, level in BULLETS:
        out = out.when(line.rlike(p), level)
    return out


def position_tag(pages: Column, x0: Column, x1: Column, top: Column, bottom: Column) -> Column:
    """The text form of a place: ``@@pages<TAB>x0<TAB>x1<TAB>top<TAB>bottom##``, one decimal each, pages joined by hyphens."""
    number = lambda c: F.format_string("%.1f", c.cast("double"))
    return F.concat(F.lit("@@"), F.array_join(pages.cast("array<string>"), "-"), F.lit("\t"), F.concat_ws("\t", *(number(c) for c in (x0, x1, top, bottom))), F.lit("##"))


TAG = r"@@[0-9-]+\t[0-9.\t]+##"


def tag_positions(text: Column) -> Column:
    """All places in a text, as structs."""
    one = lambda t: F.struct(
        F.split(F.regexp_extract(t, r"@@([0-9-]+)\t", 1), "-").cast("array<int>").alias("pages"),
        *(F.regexp_extract(t, r"@@[0-9-]+" + r"\t([0-9.]+)" * k, k).cast("double").alias(n) for k, n in enumerate(("x0", "x1", "top", "bottom"), 1)),
    )
    return F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), one)


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def date_parts(value: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of a tolerant date: epoch milliseconds, or the year first; bad months and days become 1."""
    s = F.trim(value)
    s = F.when(s.rlike(r"^[0-9]{10,}"), F.date_format(F.timestamp_seconds(F.substring(s, 1, 10).cast("long")), "yyyy-MM-dd HH:mm:ss")).otherwise(s)
    y = F.when(s.rlike("^[0-9]{4}"), F.substring(s, 1, 4).cast("int"))
    m, d = F.regexp_extract(s, r"[0-9]{4}.?([0-9]{1,2})", 1).try_cast("int"), F.regexp_extract(s, r"[0-9]{4}.?[0-9]{1,2}.?([0-9]{1,2})", 1).try_cast("int")
    return y, F.when(m.between(1, 12), m).otherwise(1), F.when(d.between(1, 31), d).otherwise(1)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and figures."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def content_id(owner: Column, text: Column) -> Column:
    """md5 of the owner, a bar and the md5 of the text; null text as empty."""
    return F.md5(F.concat_ws("|", owner, F.md5(F.coalesce(text, F.lit("")))))
