"""Elements of documents: Markdown blocks, tables pulled out of text, HTML blocks, sentences of tables, converter output."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from leafmill.functions.chunk import count_tokens, split_json
from leafmill.functions.parse import table_markdown


def markdown_elements(text: str) -> list[dict]:
    """(kind, start, end, text) with line numbers from 0: header, code, table, list, quote, paragraph."""
    lines, out, i = text.split("\n"), [], 0

    def kind(s: str) -> str:
        if re.match(r"#{1,6}\s", s):
            return "header"
        if s.startswith(("```", "~~~")):
            return "code"
        if s.startswith("|"):
            return "table"
        if re.match(r"([-*+]|\d+[.)])\s", s):
            return "list"
        return "quote" if s.startswith(">") else "paragraph"

    while i < len(lines):
        s = lines[i].strip()
        if not s:
            i += 1
            continue
        k, j = kind(s), i + 1
        if k == "code":
            while j < len(lines) and not lines[j].strip().startswith(s[:3]):
                j += 1
            j = min(j + 1, len(lines))
        elif k == "list":
            while j < len(lines) and lines[j].strip() and (kind(lines[j].strip()) == "list" or lines[j][:1] in " \t"):
                j += 1
        elif k != "header":
            while j < len(lines) and lines[j].strip() and kind(lines[j].strip()) == k:
                j += 1
        out.append({"kind": k, "start": i, "end": j - 1, "text": "\n".join(lines[i:j])})
        i = j
    return out


TABLES = re.compile(
    r"(?:^[ \t]*\|[^\n]*\n[ \t]*\|[ :|-]*-[ :|-]*(?:\n[ \t]*\|[^\n]*)*(?:\n|\Z))|(?:^[^\n|]*\|[^\n]*\n[ \t]*:?-+:?[ \t]*\|[ :|-]*(?:\n[^\n|]+\|[^\n]*)*(?:\n|\Z))|<table\b(?s:.*?)</table>",
    re.M | re.I,
)


def pull_tables(text: str) -> tuple[str, list[str]]:
    """(the text without its tables, the tables): with pipes at the edges, without them, and HTML ones."""
    if "|" not in text and "<table" not in text.lower():
        return text, []
    return TABLES.sub("", text), [m[0].strip() for m in TABLES.finditer(text)]


class _Blocks(HTMLParser):
    BLOCK = frozenset("address article aside blockquote body dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section ul".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.skip, self.table = [], [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table:
            self.table[-1].append(["", 1])
        elif tag in self.BLOCK:
            self.open.append((tag, len(self.out)))
            self.out.append([tag, ""])
        elif tag == "br":
            self.handle_data("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.table is not None:
            self.out.append(["table", table_markdown([[(" ".join(x.split()), n) for x, n in r] for r in self.table]).strip()])
            self.table = None
        elif tag in self.BLOCK:
            while self.open and self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.skip:
            return
        if self.table is not None:
            if self.table and self.table[-1]:
                self.table[-1][-1][0] += data
        elif self.open and self.open[-1][1] == len(self.out) - 1:
            self.out[-1][1] += data
        elif data.strip():
            self.out.append([self.open[-1][0] if self.open else "body", data])


def html_blocks(text: str) -> list[tuple[str, str]]:
    """(tag, text) of the blocks that hold text, in order; headings by number signs, tables as Markdown."""
    p = _Blocks()
    p.feed(text)
    p.close()
    out = []
    for tag, t in p.out:
        s = t.strip() if tag in ("table", "pre") else " ".join(t.split())
        if s:
            out.append((tag, "#" * int(tag[1]) + " " + s if re.fullmatch("h[1-6]", tag) else s))
    return out


def pack_blocks(blocks: list[tuple[str, str]], size: int = 512, count=count_tokens) -> list[str]:
    """Blocks put together up to the size; a larger block is cut hard, a table after its rows."""
    out, now, n = [], [], 0
    for tag, t in blocks:
        if tag == "table":
            parts, rows, m = [], [], 0
            for row in t.split("\n"):
                if rows and m + count(row) > size:
                    parts.append("\n".join(rows))
                    rows, m = [], 0
                rows.append(row)
                m += count(row)
            parts.append("\n".join(rows))
        else:
            words = re.findall(r"\S+\s*", t)
            parts, rows, m = [], [], 0
            for w in words:
                if rows and m + count(w) > size:
                    parts.append("".join(rows).strip())
                    rows, m = [], 0
                rows.append(w)
                m += count(w)
            parts.append("".join(rows).strip())
        for p in parts:
            k = count(p)
            if now and n + k > size:
                out.append("\n".join(now))
                now, n = [], 0
            now.append(p)
            n += k
    return [*out, "\n".join(now)] if now else out


NUMBER = re.compile(r"^[\d.,+%/ -]+$")


def table_sentences(rows: list[list[str]]) -> list[str]:
    """``h1,h2: v; ...`` for every row. A first row is the header; where most cells below are numbers, further rows without
    any number are header rows as well."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if len(rows) < 2:
        return ["; ".join(c for c in r if c.strip()) for r in rows]
    body = [c for r in rows[1:] for c in r if c.strip()]
    heads = 1
    if sum(bool(NUMBER.match(c)) for c in body) * 2 > len(body):
        while heads < len(rows) - 1 and not any(NUMBER.match(c) for c in rows[heads] if c.strip()):
            heads += 1
    names = [",".join(dict.fromkeys(r[k].strip() for r in rows[:heads] if k < len(r) and r[k].strip())) for k in range(max(map(len, rows)))]
    out = ["; ".join(f"{names[k]}: {c.strip()}" if names[k] else c.strip() for k, c in enumerate(r) if c.strip()) for r in rows[heads:]]
    return out if len(names) > 3 else ["\n".join(out)]


def converter_sections(content: str) -> list[tuple[str, str, int | None]]:
    """(kind, text, page) of the blocks that document converters list as JSON; what they discarded is left out."""
    out = []
    for b in json.loads(content):
        kind = b.get("type")
        join = lambda *names: "\n".join(x for n in names for x in ([b.get(n)] if isinstance(b.get(n), str) else b.get(n) or []) if x)  # noqa: B023, E731
        if kind in (None, "discarded"):
            continue
        text = {"table": lambda: join("table_caption", "table_body", "table_footnote"), "image": lambda: join("image_caption", "image_footnote"), "code": lambda: join("code_caption", "code_body"), "list": lambda: join("list_items")}.get(kind, lambda: join("text"))()  # noqa: B023
        if text.strip():
            out.append((kind, text, b.get("page_idx")))
    return out


def json_pieces(text: str, most: int = 2000) -> list[str]:
    """A JSON text, or lines of JSON, as JSON pieces of about `most` characters; lines that are broken are left out."""
    try:
        values = [json.loads(text)]
    except ValueError:
        values = []
        for line in text.split("\n"):
            try:
                values.append(json.loads(line)) if line.strip() else None
            except ValueError:
                continue
    return [json.dumps(p, ensure_ascii=False) for v in values for p in split_json(v, most)]
