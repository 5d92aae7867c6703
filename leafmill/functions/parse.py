"""Text, Markdown and HTML documents into titled sections; per-row functions for Arrow UDFs.

A section is (level, header, path, text). A header line starts one; fenced code, formula blocks and pipe tables are taken
over untouched, so heading-like lines inside them start nothing.
"""

from __future__ import annotations

import html as _html
import re
from html.parser import HTMLParser
from statistics import median

# How chapter, numbered and Roman headings begin.
CHAPTER = re.compile(r"第[一二三四五六七八九十\d]+章")
NUMBERED = re.compile(r"\d+(\.\d+)*\s")
ROMAN = re.compile(r"[IVXLCDM]+\.\s")
# Words that open Chinese chapters, and words that end Chinese titles.
CHAPTER_WORDS = ("章", "节", "部分", "小结", "概述", "前言", "后记", "目录", "摘要")
TITLE_WORDS = re.compile("(主要|功能|特性|方法|结果|讨论|结论)( |$)")
# Marks that end a line's sentence; a comma does not.
TERMINAL = tuple("。.!?！？：;；:")
DEFAULT_HEADER = "Introduction"


def decode_bytes(data: bytes) -> str:
    """UTF-8 where it is valid, else GBK where that is, else UTF-8 with replacement characters."""
    for codec in ("utf-8-sig", "gbk"):
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def clean(text: str) -> str:
    text = re.sub(r"\r\n?", "\n", text)
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "", text)
    return re.sub(r"\n{3,}", "\n\n", text)


def strip_tags(text: str, front_after_space: bool = False) -> str:
    text = re.sub((r"\A\s*" if front_after_space else r"\A") + r"---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", "", text, flags=re.S)
    return re.sub(r"<[^>]+>", "", re.sub(r"<!--.*?-->", "", text, flags=re.S))


def is_header(line: str) -> bool:
    """The rules of `text.header_rule`, for a line of a plain text."""
    s = line.strip()
    if not s:
        return False
    if CHAPTER.match(s) or (len(s) > 3 and s.isupper()) or ROMAN.match(s) or re.match(r"#+\s", s):
        return True
    if len(s) < 50 and NUMBERED.match(s) or len(s) < 30 and "A" <= s[0] <= "Z":
        return True
    if len(s) > 25 or not re.search("[一-鿿]", s):
        return False
    if s.startswith(CHAPTER_WORDS) or any(w + " " in s for w in CHAPTER_WORDS):
        return True
    return bool(TITLE_WORDS.search(s)) and not re.search("[。！？，、；：]", s)


def threshold(lines: list[str]) -> int:
    lens = [len(x.strip()) for x in lines if x.strip()]
    return max(30, min(200, int(int(median(lens)) * 0.7))) if lens else 80


def merge_short_lines(text: str, limit: int | None = None, header=is_header) -> str:
    """Hard-wrapped lines joined: a line goes on in the one before where that ends in a hyphen, which leaves, or where the line
    is short and no sentence ended before it. Fenced code, blank lines, lists, headers and table rows stand alone."""
    out = []
    for joins, s in _merges(text.split("\n"), limit, header):
        if not joins:
            out.append([s])
        elif out[-1][-1].endswith("-"):
            out[-1][-1] = out[-1][-1][:-1] + s
        else:
            out[-1] += [" ", s]
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n".join("".join(x) for x in out)).strip()


def _merges(lines: list[str], limit: int | None, header):
    """(whether the line goes on in the one before, what of it stays) of every line."""
    limit = threshold(lines) if limit is None else limit
    fenced, before = False, None  # before: the line before where it may go on
    for line in lines:
        s, was, before = line.strip(), before, None
        if fenced or s.startswith("```"):
            fenced ^= s.startswith("```")
            yield False, line.rstrip()
        elif not s or re.match(r"(\d+\.|[-*+•])\s", s) or s.startswith("|") or header(s):
            yield False, s
        else:
            yield was is not None and (was.endswith("-") or len(s) < limit and not was.endswith(TERMINAL)), s
            before = s


def merged_counts(text: str) -> tuple[int, int]:
    """(lines that stand alone or begin, lines that go on in the one before)."""
    joins = [j for j, _ in _merges(text.split("\n"), None, is_header)]
    return joins.count(False), joins.count(True)


def blocks(lines: list[str]):
    """(protected, lines) groups in order: fences to their end, formula blocks, runs of pipe rows, and single lines. A
    formula block that ends on its own line takes that line only; unclosed blocks run to the end."""
    i, n = 0, len(lines)
    while i < n:
        s = lines[i].strip()
        j = i + 1
        if s.startswith("```") or s.startswith("$$") and not (len(s) > 3 and s.endswith("$$")):
            mark = s[:3] if s[0] == "`" else "$$"
            while j < n and not lines[j].strip().startswith(mark) and not (mark == "$$" and lines[j].strip().endswith("$$")):
                j += 1
            yield True, lines[i : j + 1]
            i = j + 1
        elif s.startswith("$$"):
            yield True, lines[i:j]
            i = j
        elif s.startswith("|"):
            while j < n and lines[j].strip().startswith("|"):
                j += 1
            yield True, lines[i:j]
            i = j
        else:
            yield False, lines[i:j]
            i = j


def sections(text: str, heading, default_level: int, keep_empty: bool = False) -> list[dict]:
    """heading(line) gives (level, title) or None. Sections in order, with the path of their headings."""
    out, stack = [], []
    level, title, body = default_level, DEFAULT_HEADER, []

    def close():
        joined = "\n".join(body).strip()
        if joined or keep_empty and not out and not stack:
            path = [t for lv, t in stack if lv > 0] or [title]
            out.append({"level": level, "section_header": title, "section_path": " > ".join(path), "text": joined})

    for protected, group in blocks(text.split("\n")):
        h = None if protected else heading(group[0])
        if h is None:
            body.extend(group)
            continue
        if "".join(body).strip():
            close()
        level, title = h
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        body = [group[0].strip(), ""]
    close()
    return out


def _md_heading(line: str):
    m = re.match(r"(#+)\s+(.*\S)", line.strip())
    return (len(m[1]), m[2].strip()) if m else None


def parse_text(text: str, merge: bool = True, limit: int | None = None) -> list[dict]:
    """Sections of a plain text: flat, every heading of level 1. An empty text is one empty section."""
    text = strip_tags(clean(text))
    if merge:
        text = merge_short_lines(text, limit)
    got = sections(text, lambda x: (1, re.sub(r"^#+\s+", "", x.strip())) if is_header(x) else None, 1, keep_empty=True)
    for s in got:
        s["section_path"] = s["section_header"]
    return got


def parse_markdown(text: str) -> list[dict]:
    """Sections of Markdown; images are taken out and listed, links within the document become text."""
    text = strip_tags(clean(text), True)
    text = re.sub(r"\[([^\]]*)\]\(#[^)]*\)", r"\1", text)
    got = []
    for s in sections(text, _md_heading, 0):
        s["images"] = re.findall(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)", s["text"])
        s["text"] = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", s["text"]).strip()
        if s["text"]:
            got.append(s)
    return got


class Html(HTMLParser):
    """Writes HTML as Markdown and collects what the head says. clean: selectors ("tag", ".class", "#id") to leave out."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, clean=(), links: bool = False, images: bool = False):
        super().__init__(convert_charrefs=True)
        self.drop, self.links, self.images = set(clean) | {"script", "style", "noscript", "template"}, links, images
        self.out, self.meta, self.title, self.canonical = [], {}, None, None
        self.skip, self.stack, self.pre, self.rows, self.href, self.lists = 0, [], 0, None, [], []
        self.in_title = False

    def put(self, s: str) -> None:
        if self.rows is not None and self.rows and self.rows[-1]:
            self.rows[-1][-1][0] += s
        else:
            self.out.append(s)

    def unwanted(self, tag, attrs) -> bool:
        return tag in self.drop or any(f".{c}" in self.drop for c in (attrs.get("class") or "").split()) or f"#{attrs.get('id')}" in self.drop

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "meta":
            name, content = attrs.get("name") or attrs.get("property"), attrs.get("content")
            if name and content is not None:
                self.meta[name] = content
            return
        if tag == "link":
            if "canonical" in (attrs.get("rel") or "").split():
                self.canonical = attrs.get("href")
            return
        if tag not in self.VOID:
            gone = bool(self.skip) or self.unwanted(tag, attrs)
            self.stack.append((tag, gone))
            self.skip += gone
        if self.skip:
            return
        if tag == "title":
            self.in_title = True
        elif re.fullmatch("h[1-6]", tag):
            self.put(f"\n\n{'#' * int(tag[1])} ")
        elif tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n")
        elif tag == "pre":
            self.pre += 1
            self.put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
            self.put("\n")
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            mark = f"{self.lists[-1]}." if self.lists and self.lists[-1] is not None else "-"
            self.put(f"\n{'  ' * max(0, len(self.lists) - 1)}{mark} ")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            if not self.rows:
                self.rows.append([])
            span = attrs.get("colspan") or "1"
            self.rows[-1].append(["", min(int(span), 1000) if span.isdigit() and int(span) > 0 else 1])
        elif tag == "a" and self.links:
            self.href.append(attrs.get("href") or "")
            self.put("[")
        elif tag == "img" and self.images:
            self.put(f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})")
        elif tag == "svg":
            self.put("\n\n[图表]\n\n")
        elif tag in ("p", "div", "section", "article", "blockquote", "main", "header", "footer", "nav", "aside", "figure", "dl", "dd", "dt"):
            self.put("\n\n")

    def handle_endtag(self, tag):
        if tag in self.VOID or not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, gone = self.stack.pop()
            self.skip -= gone
            if t == tag:
                break
        if gone or self.skip:
            return
        if tag == "title":
            self.in_title = False
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.put("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "a" and self.links and self.href:
            self.put(f"]({self.href.pop()})")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.put("\n\n")
        elif tag == "table" and self.rows is not None:
            rows, self.rows = self.rows, None
            self.out.append(table_markdown([[(" ".join(x.split()).replace("|", "\\|"), n) for x, n in r] for r in rows]))
        elif re.fullmatch("h[1-6]", tag) or tag in ("p", "div", "section", "article", "blockquote"):
            self.put("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        elif not self.skip:
            self.put(data if self.pre else re.sub(r"\s+", " ", data))


def table_markdown(rows: list[list[tuple[str, int]]]) -> str:
    """A pipe table with one line a row: cells that span columns are repeated, short rows filled, the first row the header."""
    wide = [[x for x, n in r for _ in range(n)] for r in rows if r]
    if not wide:
        return ""
    n = max(map(len, wide))
    lines = ["| " + " | ".join(r + [""] * (n - len(r))) + " |" for r in wide]
    return "\n\n" + "\n".join([lines[0], "|" + " --- |" * n, *lines[1:]]) + "\n\n"


def html_markdown(text: str, clean=(), links: bool = False, images: bool = False) -> tuple[str, Html]:
    p = Html(clean, links, images)
    p.feed(text)
    p.close()
    md = re.sub(r"[ \t]+\n", "\n", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", md).strip(), p


def parse_html(text: str, clean=(), links: bool = False, images: bool = False) -> list[dict]:
    """Sections of HTML, with the title, the canonical address and the head's other values."""
    if not text.strip():
        return []
    md, p = html_markdown(text, clean, links, images)
    got = sections(md, _md_heading, 0)
    for s in got:
        s |= {"title": p.title.strip() if p.title is not None else None, "canonical_url": p.canonical, "web_meta": dict(p.meta)}
    return got


def unescape(text: str) -> str:
    return _html.unescape(text)
