"""Cutting section texts into chunks; per-row functions for Arrow UDFs. Sizes are in tokens of a counter that is given."""

from __future__ import annotations

import json
import re

TOKEN = re.compile(r"[^\W_]+|[^\s\w]|_", re.U)
SENTENCE = re.compile(r".+?(?:[.!?][\"'”’)\]]*(?=\s)|[。！？]|\n{2,}|\Z)\s*", re.S)
CODE = re.compile(r"^[ \t]*```.*?^[ \t]*```[ \t]*$|^[ \t]*```.*\Z", re.S | re.M)
MATH = re.compile(r"\$\$.*?\$\$", re.S)


def count_tokens(text: str) -> int:
    return len(TOKEN.findall(text))


def _cut_long(s: str, size: int, count) -> list[str]:
    """A stretch above the size, cut at words, and inside a word where that alone is too long."""
    out, now = [], ""
    for w in re.findall(r"\S+\s*|\s+", s):
        while count(w) > size:
            spans = [m.end() for m in TOKEN.finditer(w)]
            k = spans[min(size, len(spans)) - 1] if len(spans) > size else max(1, len(w) // 2)
            if now:
                out.append(now)
                now = ""
            out.append(w[:k])
            w = w[k:]
        if now and count(now + w) > size:
            out.append(now)
            now = ""
        now += w
    return [*out, now] if now else out


def split_sentences(text: str, size: int = 512, overlap: int = 100, count=count_tokens) -> list[str]:
    """Sentences put together up to the size; a chunk begins with the last sentences of the one before, within the overlap.
    No text is lost, and blank texts have no chunk."""
    if overlap >= size:
        raise ValueError("the overlap must be below the size")
    parts = [(p, count(p)) for m in SENTENCE.finditer(text) if m[0].strip() for p in ([m[0]] if count(m[0]) <= size else _cut_long(m[0], size, count))]
    out, now, n, fresh = [], [], 0, False
    for p, k in parts:
        if now and n + k > size and fresh:
            out.append("".join(x for x, _ in now).strip())
            keep, m = [], 0
            for x in reversed(now):
                if m + x[1] > overlap or m + x[1] + k > size:
                    break
                keep.insert(0, x)
                m += x[1]
            now, n = keep, m
        now.append((p, k))
        n, fresh = n + k, True
    if now and fresh:
        out.append("".join(x for x, _ in now).strip())
    return out


def split_table(text: str, size: int = 512) -> list[str]:
    """Lines put together while they stay within three characters a token; every chunk begins with the first pipe line."""
    lines = [x for x in text.split("\n") if x.strip()]
    head = next((x for x in lines if x.strip().startswith("|")), None)
    out, now, n = [], [], 0
    for x in lines:
        if now and n + len(x) > size * 3:
            out.append(now)
            now, n = [], 0
        now.append(x)
        n += len(x)
    if now:
        out.append(now)
    return ["\n".join(c if head is None or c[0] == head else [head, *c]) for c in out]


def split_protected(text: str, size: int = 512, overlap: int = 100, count=count_tokens) -> list[str]:
    """As `split_sentences`, with code and formula blocks as single words; a chunk above four characters a token is split
    again, blocks included."""
    held: list[str] = []

    def hide(m: re.Match) -> str:
        held.append(m[0])
        return f"{len(held) - 1}"

    masked = MATH.sub(hide, CODE.sub(hide, text))
    out = []
    for c in split_sentences(masked, size, overlap, count):
        while "" in c:  # a formula may hold code
            c = re.sub("(\\d+)", lambda m: held[int(m[1])], c)
        out.extend(split_sentences(c, size, overlap, count) if len(c) > size * 4 else [c])
    return out


def chunk(text: str, header: str | None, size: int = 512, overlap: int = 100) -> list[str]:
    """Tables by their header's word, then texts with blocks, then plain texts."""
    if "table" in (header or "").lower():
        return split_table(text, size)
    if "```" in text or "$$" in text:
        return split_protected(text, size, overlap)
    return split_sentences(text, size, overlap)


def split_delimited(text: str, delimiters: str = "\n!?。；！？", size: int = 128, count=count_tokens) -> list[str]:
    """Pieces between delimiters put together until a chunk is above the size. Delimiters in back quotes count as a whole."""
    long = re.findall(r"`([^`]+)`", delimiters)
    single = re.sub(r"`[^`]+`", "", delimiters)
    p = "|".join([*(re.escape(x) for x in sorted(long, key=len, reverse=True)), *([f"[{re.escape(single)}]"] if single else [])])
    out: list[str] = []
    open_ = False
    for piece in re.split(p, text) if p else [text]:
        if not piece.strip():
            continue
        if open_ and count(out[-1]) <= size:
            out[-1] += "\n" + piece
        else:
            out.append(piece)
            open_ = True
    return out


def split_json(value, most: int = 2000, least: int | None = None) -> list[dict]:
    """Objects of at most about `most` characters each that hold every leaf under its path; lists become objects by index."""
    least = max(most - 200, 50) if least is None else least
    out: list[dict] = [{}]

    def put(path: list[str], leaf) -> None:
        at = out[-1]
        for p in path[:-1]:
            at = at.setdefault(p, {})
        at[path[-1]] = leaf

    def walk(v, path: list[str]) -> None:
        if isinstance(v, list):
            v = {str(i): x for i, x in enumerate(v)}
        if not isinstance(v, dict) or not v:
            if path:
                put(path, v)
            return
        for k, x in v.items():
            size, room = len(json.dumps({k: x}, ensure_ascii=False)), most - len(json.dumps(out[-1], ensure_ascii=False))
            if size < room:
                put([*path, k], x if not isinstance(x, list) else {str(i): y for i, y in enumerate(x)})
                continue
            if len(json.dumps(out[-1], ensure_ascii=False)) >= least:
                out.append({})
            walk(x, [*path, k])

    walk(value, [])
    return [c for c in out if c]
