"""Restoring text that was decoded with the wrong character encoding.

A best-first search walks from the text as found over operations that undo a wrong decoding: encoding with one codec and
decoding with another, wholly or only where the bytes form valid UTF-8, and unescaping character references. States are
visited once. The cost of a state is how implausible its characters are beside their neighbours; the cheapest reachable
text is the restored one, provided it is clearly cheaper than the text as found.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Letters beyond ASCII of the Latin-script languages expected here, and pairs of them that are usual.
LETTERS = set("äöüßÄÖÜẞéèêëàâçîïôûùœæÿñáíóúÉÈÊËÀÂÇÎÏÔÛÙŒÆÑÁÍÓÚ")
PAIRS = {"öß", "üß", "äß", "éé", "ïé", "çà", "çû", "çé", "éâ", "ÖẞS", "ñí", "ñó", "ñá", "íó", "éà", "óé", "üé"}
# The signs that wrong decodings put beside letters.
SIGNS = set("¡¢£¤¥¦§¨©ª¬®¯°±²³´µ¶·¸¹º¼½¾¿×÷ƒˆ˜˘˙˛˝ˇ‚„†‡•‰‹›€№⌐¬ⁿ₧∙√∞≤≥≠≈∂∑∏π∫Ω◊∆⌠⌡")
MATHS = set("√∞≤≥≠≈∂∑∏π∫Ω◊∆⌠⌡⌐¬ⁿ₧∙")
JOINERS = set("’‘'–—-‐‑…™")
WORD_END_MARKS = {"¬", "\xad", "‐", "‑"}  # hyphens of scanned lines where a line ends


def _single(codec: str) -> str:
    return "".join(bytes([b]).decode(codec, "ignore") for b in range(128, 256))


# cp1252 with its five undefined bytes as control characters, as common decoders have it
_FROM_1252 = {ord(bytes([b]).decode("cp1252")): b for b in range(128, 160) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_TO_1252 = {b: chr(c) for c, b in _FROM_1252.items()}


def encode(s: str, codec: str) -> bytes:
    return s.translate(_FROM_1252).encode("latin-1") if codec == "cp1252" else s.encode(codec)


def decode(b: bytes, codec: str) -> str:
    return b.decode("latin-1").translate(_TO_1252) if codec == "cp1252" else b.decode(codec)


BYTE_CODECS = ("cp1252", "iso8859_15", "mac_roman", "cp437", "cp1250", "cp1251", "cp850", "iso8859_2", "koi8_r", "cp866", "cp1254", "cp1253", "cp1257", "cp852")
WIDE_CODECS = ("gbk", "big5", "shift_jis", "euc_kr")
UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+")
_HIGH = {c: (_single(c) if c != "cp1252" else _single("cp1252") + _single("latin-1")) for c in BYTE_CODECS}
RUNS = {c: re.compile("[" + re.escape(_HIGH[c]) + "]{2,}") for c in BYTE_CODECS}
#: (read as, meant as): bytes meant as the second and read as the first.
SWAPS = (
    [(e, "cp1252") for e in ("mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "cp1253", "cp1254", "cp1257", "cp852", "koi8_r", "cp866")]
    + [(e, d) for d in ("cp1251", "koi8_r", "cp866", "iso8859_5") for e in ("cp1252", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "iso8859_5", "cp1250") if e != d]
    + [("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850")]
    + [(e, d) for d in ("gb18030", "big5") for e in ("cp1252", "big5", "gbk", "shift_jis", "euc_kr", "cp437", "mac_roman") if e != d and not (e == "gbk" and d == "gb18030")]
)


def partial_utf8(s: str, codec: str) -> str:
    """Undoes reading UTF-8 as a one-byte codec wherever the bytes are valid UTF-8."""

    def run(m: re.Match) -> str:
        try:
            b = encode(m[0], codec)
        except UnicodeError:
            return m[0]
        out, at = [], 0
        for x in UTF8.finditer(b):
            out += [decode(b[at : x.start()], codec), x[0].decode("utf-8")]
            at = x.end()
        return "".join([*out, decode(b[at:], codec)]) if at else m[0]

    return RUNS[codec].sub(run, s)


WIDE_RUN = re.compile("[^\x00-\x7f�]+")


def wide_utf8(s: str, codec: str) -> str:
    """Undoes reading UTF-8 as a two-byte codec: the whole text where it fits, else run by run."""
    try:
        return s.encode(codec).decode("utf-8")
    except UnicodeError:
        pass

    def run(m: re.Match) -> str:
        try:
            t = m[0].encode(codec).decode("utf-8", "replace")
        except UnicodeError:
            return m[0]
        return t if t.count("�") <= 1 + len(t) // 8 else m[0]

    return WIDE_RUN.sub(run, s)


@lru_cache(maxsize=8192)
def _kind(c: str) -> str:
    """A letter for what a character is: a ASCII letter, l known Latin letter, x other Latin letter, r Russian letter, y other
    Cyrillic, g Greek, h common Hanzi, H less common Hanzi, J Hanzi outside the simplified set, k kana, c control,
    f replacement or private, b box drawing, s sign, w white space or digit, j joiner, o other."""
    n = ord(c)
    if n < 128:
        return "a" if c.isalpha() else "w" if c.isspace() or c.isdigit() else "o"
    if c in LETTERS:
        return "l"
    if c == "�" or 0xE000 <= n <= 0xF8FF:
        return "f"
    if n < 160:
        return "c"
    if c in JOINERS:
        return "j"
    if c in SIGNS:
        return "s"
    if n == 0xA0:
        return "w"
    if 0x2190 <= n < 0x2500 or 0x2600 <= n < 0x2C00:
        return "s"
    if 0x2500 <= n <= 0x25FF:
        return "b"
    if 0x400 <= n <= 0x52F:
        return "r" if "а" <= c <= "я" or "А" <= c <= "Я" or c in "ёЁ" else "y"
    if 0x370 <= n <= 0x3FF:
        return "g"
    if 0x3040 <= n <= 0x312F:
        return "k"
    if 0x3400 <= n <= 0x9FFF:
        try:
            b = c.encode("gb2312")
        except UnicodeError:
            return "J"
        return "h" if 0xB0 <= b[0] <= 0xD7 else "H"
    if unicodedata.category(c)[0] == "L" and n < 0x250:
        return "x"
    if unicodedata.category(c) in ("Lo", "Lm", "Mn", "Cn", "Ll", "Lu") and not 0xFF00 <= n < 0xFFEF:
        return "z"
    return "o"


LATIN, ANY = "alx", "alxrygz"


@lru_cache(maxsize=200_000)
def _run_cost(before: str, run: str, after: str) -> float:
    s, cost = before + run + after, 0.0
    kinds = [_kind(c) for c in s]
    lo, hi = len(before), len(before) + len(run)
    if len(run) <= 2 and (kinds[0] in LATIN and before or kinds[-1] in LATIN and after) and all(k in "hHJ" for k in kinds[lo:hi]):
        cost += 1.0
    if len(run) <= 4 and before and after and kinds[0] in LATIN and kinds[-1] in LATIN and all(k in "hHJ" for k in kinds[lo:hi]):
        cost += 1.0 + len(run)
    for i in range(lo, hi):
        c, k = s[i], kinds[i]
        p, q = kinds[i - 1] if i else "w", kinds[i + 1] if i + 1 < len(s) else "w"
        if k == "l" or k == "x":
            if k == "x":
                cost += 1.5
            if c.isupper() and i and p in LATIN and s[i - 1].islower():
                cost += 2
            if i > lo and p in "lx" and s[i - 1 : i + 1] not in PAIRS:
                cost += 0.6
            if c in "ÂÃÄÅÐÑâã" and (q == "c" or q == "s" or i + 1 < len(s) and "\x80" <= s[i + 1] <= "\xbf"):
                cost += 2
        elif k in "cf":
            cost += 5
        elif k == "s":
            if c in WORD_END_MARKS and (i + 1 == len(s) or s[i + 1] == "\n"):
                continue
            near = 1.6 if c in MATHS else 1.0
            cost += (p in ANY) * near + (q in ANY) * near + (p in "sb" and i > lo) * 0.7 if c not in "¿¡ºª°µ•" else (p in ANY and q in ANY) * 2.0 + (p in "sb" and i > lo) * 0.7
        elif k == "b":
            cost += 0.3 + (p in ANY) * 1.0 + (q in ANY) * 1.0 + (p in "sb" and i > lo) * 0.7
        elif k == "g":
            cost += (p in "alxry") * 2.0 + (q in "alxry") * 2.0
        elif k in "ry":
            if k == "y":
                cost += 1.5
            if p in LATIN or q in LATIN:
                cost += 2
            if c.isupper() and i and p in "ry" and s[i - 1].islower():
                cost += 2
        elif k in "hHJ":
            cost += {"h": 0.0, "H": 0.6, "J": 1.5}[k]
            if q in LATIN and p not in "hHJko":
                cost += 0.7
            elif p in LATIN and q not in "hHJko":
                cost += 0.7
        elif k == "k":
            cost += 0.4 if p in "hHJ" or q in "hHJ" else 0
        elif k == "z":
            cost += 1.5
        elif k == "o" and c in "⌂№ﬁﬂ":
            cost += 0.3 + (p in "lxsb" and i > lo) * 1.0 + (q in "lxsb" and i + 1 < hi) * 1.0
        elif k == "o" and c == "\xad" and not (i + 1 == len(s) or s[i + 1] == "\n"):
            cost += 0.5
    return cost


NON_ASCII = re.compile("[^\x00-\x7f]+")
REFERENCE = re.compile(r"&(?:#\d{2,7}|#x[0-9a-fA-F]{2,6}|[A-Z][a-z]{3,6}|[a-z]{3,7}\d?);")


def implausibility(s: str) -> float:
    """0 for text whose characters all suit their neighbours."""
    return sum(_run_cost(s[m.start() - 1] if m.start() else "", m[0], s[m.end()] if m.end() < len(s) else "") for m in NON_ASCII.finditer(s))


PRICE = {"utf8": 0.4, "unescape": 0.4, "wide": 0.8, "swap": 1.2}  # of an operation; more of a rarer one
CHEAPEST = min(PRICE.values())


def _moves(s: str, first: tuple | None, swaps: bool):
    kinds = {_kind(c) for c in set(s) if c > "\x7f"}
    wide = bool(kinds & set("hHJk")) and not kinds & set("cbs")
    if swaps:
        moves = [("swap", x) for x in SWAPS if (x[0] in WIDE_CODECS) == wide]
    else:
        moves = [("utf8", c) for c in BYTE_CODECS] if not wide else []
        moves += [("wide", c) for c in WIDE_CODECS] if kinds & set("hHJkz") else []
        moves += [("unescape", None)] if "&" in s else []
    if first in moves:
        moves.remove(first)
        moves.insert(0, first)
    for move in moves:
        kind, x = move
        try:
            t = partial_utf8(s, x) if kind == "utf8" else wide_utf8(s, x) if kind == "wide" else html.unescape(s) if kind == "unescape" else decode(encode(s, x[0]), x[1])
        except (UnicodeError, LookupError):
            continue
        if t != s:
            yield move, t


@lru_cache(maxsize=4096)
def search(s: str, first: tuple | None = None) -> tuple[str, float, float, tuple | None, bool]:
    """(text, its cost, the cost of `s`, the first move, whether a swap and another move led there) of the cheapest text reachable from `s`, prices of moves included.

    The search ends where no open state can lead to a cheaper text, as each move has a price. It is finite: a move that
    goes on takes a quarter of the cost, a swap half of it, or shortens the text by a tenth. One byte codec is swapped for
    another in the text as found, and, to go on from there, in every state that no other move makes more plausible.
    """
    start = implausibility(s)
    best = (start, s, None, start, False)
    queue, seen = [(start, 0.0, s, start, None, False)], {s}
    while queue:
        _, paid, t, cost, move, swapped = heapq.heappop(queue)
        if paid + CHEAPEST >= best[0]:
            continue
        better = False
        for swaps in (False, True):
            if swaps and better and paid:
                break
            alone = not better
            for m, u in _moves(t, first, swaps):
                price = paid + PRICE[m[0]]
                if price >= best[0] or u in seen or len(u) > 4 * len(s) + 8:
                    continue
                seen.add(u)
                c = implausibility(u)
                better |= c < cost
                chain = swapped or swaps
                if c + price < best[0]:
                    best = (c + price, u, move or m, c, chain and paid > 0)
                if best[0] <= CHEAPEST:
                    break
                if alone and c < 0.5 * cost if swaps else c < 0.75 * cost or len(u) < 0.9 * len(t) and c < 1.2 * cost + 2:
                    heapq.heappush(queue, (c + price, price, u, c, move or m, chain))
            if best[0] <= CHEAPEST:
                break
    return best[1], best[3], start, best[2], best[4]


SEGMENT = re.compile(r"[。！？]+|[^\n。！？]*?(?:[.!?](?=\s)|\n|$|(?=[。！？]))\s*", re.S)
LOST = re.compile("[�\x80-\x9f-]")


def restore(text: str | None) -> tuple[str | None, bool]:
    """(restored text, whether it was garbled), see `restored`."""
    return restored(text)[:2]


def restored(text: str | None) -> tuple[str | None, bool, float | None]:
    """(restored text, whether it was garbled, confidence): the share of the garbled sentences' implausibility that is gone, 0
    where nothing could be restored, null for text that was not garbled. Null stays null. Text with characters that only a wrong decoding leaves
    (replacement and C1 control characters) counts as garbled even where nothing can be restored."""
    if not text or text.isascii() and not REFERENCE.search(text):
        return text, False, None
    total = implausibility(text)
    if total < 1.0:
        return text, False, None
    out, garbled, first, was, left_over = [], LOST.search(text) is not None, None, 0.0, 0.0
    for m in SEGMENT.finditer(text):
        s = m[0]
        if s.isascii():
            out.append(s)
            continue
        t, cost, before, move, chain = search(s, first)
        gain, left = (6.0, 0.15) if chain else (1.8, 0.25) if move and move[0] == "swap" else (1.2, 0.45)
        if t != s and before - cost >= gain and cost <= left * before:
            garbled, first = True, move
            was, left_over = was + before, left_over + cost
            out.append(t)
        else:
            if LOST.search(s):
                was, left_over = was + before, left_over + before
            out.append(s)
    return "".join(out), garbled, (1 - left_over / was if was else 0.0) if garbled else None


def _restore(batches):
    for b in batches:
        got = [restored(t) for t in b["text"].to_pylist()]
        yield pa.record_batch({"node_no": b["node_no"], "restored": pa.array([t for t, _, _ in got], pa.string()), "garbled": pa.array([g for _, g, _ in got], pa.bool_()), "confidence": pa.array([c for *_, c in got], pa.float64())})


def may_be_garbled(text: Column) -> Column:
    """False only for texts that `restore_encoding` leaves: those of ASCII without character references."""
    return F.coalesce(text.rlike(r"[^\x00-\x7f]|&[#A-Za-z]"), F.lit(False))


def restore_encoding(df: DataFrame) -> DataFrame:
    """(node_no, restored, garbled, confidence) for every row of (node_no, text); null and empty texts are not garbled."""
    return df.select("node_no", "text").mapInArrow(_restore, "node_no long, restored string, garbled boolean, confidence double")
