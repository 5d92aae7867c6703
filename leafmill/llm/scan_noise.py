"""Repairing text of scanned pages into continuous paragraphs.

Page numbers, and headers that carry one, are told by their shape. Other lines that look like a running header or footer
leave only with evidence: the decoded line comes again on another node of the document, or it cuts a sentence in two.
The other lines lose their ends and become one stream of characters. Where it holds anything but known words, a lattice over the
characters is decoded as a whole: a word may take in line ends, hyphens before them and spaces, undo any confusions of
similar shapes, and end where no space is; the cheapest path through the stretch is what is read. A lexicon of the words
of born-digital files says what a word is. A dynamic program over the line ends then chooses the paragraph boundaries.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Shapes that scans take for each other, (one, other). Either may be read for the other.
SHAPES = [
    ("l", "1"), ("i", "1"), ("o", "0"), ("s", "5"), ("g", "9"), ("b", "6"), ("b", "8"), ("z", "2"), ("l", "|"), ("l", "!"), ("i", "!"),
    ("e", "c"), ("t", "f"), ("m", "rn"), ("n", "ri"), ("u", "ii"), ("h", "li"), ("d", "cl"), ("w", "vv"),
]
# Joined letters and what they stand for.
LIGATURES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]
# Costs of a path through the lattice.
CONFUSED, REVERSED = 0.8, 1.0  # a shape read for the usual one; the usual one read for the rarer shape
HYPHEN, LINE_END, SPACE = 0.1, 0.7, 1.0  # taken into a word
SPLIT, SHORT = 1.1, 0.4  # a word that ends without a space; one of two letters there
UNKNOWN, LETTER = 2.5, 0.15  # a token that is no word; each of its letters beyond eight
HYPHENS = "-‐‑\xad¬"


def _readings() -> dict[str, list[tuple[str, str, float]]]:
    """By first character: (as read, as meant, price)."""
    out: dict = {}
    for a, b in SHAPES:
        out.setdefault(b[0], []).append((b, a, CONFUSED))
        if b.isalpha():
            out.setdefault(a, []).append((a, b, REVERSED))
    for b, a in LIGATURES:
        out.setdefault(b, []).append((b, a, CONFUSED))
    return out


READINGS = _readings()
# Words before a page number and before a chapter's.
PAGE_WORD = r"(?:page|pages|p|pg|seite|s|página|pág|стр|с)"
CHAPTER = r"[^\W\d_]{4,10}"
PAGE = re.compile(rf"(?i)^(?=.*\d)\W*(?:{PAGE_WORD}\.?\s*)?(\d{{1,4}}|[lIoO0-9]{{1,4}})(?:\s*(?:/|of|von|de|sur)\s*\d{{1,5}})?\W*$")
BARE = re.compile(r"^\d{1,4}$")
WITH_NUMBER = re.compile(r"^\S.{1,70}?\s{3,}[0-9lIoOsSgiz]{1,4}$|^\d{1,4}\s{3,}\S.{1,70}$")
NUMBERED = re.compile(rf"^{CHAPTER} [0-9lIoOsSgiz]{{1,3}}\s{{2,}}\S.{{0,60}}$")
SECTIONED = re.compile(r"^\S.{1,60} [—–-] [0-9lIoO]{1,3}\.[0-9lIoO]{1,3}$")
ENDS = ".!?:;,。！？；："
STOPS = ".!?。！？"


def _parts(t: str) -> tuple[str, str, str]:
    """What is before the token's first letter or figure, the core, and what is behind its last one."""
    a, b = 0, len(t)
    while a < b and not (t[a].isalnum() or t[a] == "_"):
        a += 1
    while b > a and not (t[b - 1].isalnum() or t[b - 1] == "_"):
        b -= 1
    return t[:a], t[a:b], t[b:]


NO, SURE, IF_REPEATED = 0, 1, 2


def _furniture(lines: list[str], pages: set[int]) -> list[int]:
    """Which lines are running headers, footers or page numbers by their shape: NO, SURE (they hold a page or chapter number,
    or cut a sentence) or IF_REPEATED (they may as well be headings)."""
    body = [len(x) for x in lines if x.strip()]
    wide = sorted(body)[-max(1, len(body) // 3)] if body else 0
    flags = []
    for i, raw in enumerate(lines):
        s = raw.strip()
        if not s or s[0] in "•*" or len(s) > 80:
            flags.append(False)
            continue
        m = PAGE.match(s)
        if m:
            number = int(m[1]) if m[1].isdigit() else None
            flags.append(len(body) > 1 and (not BARE.match(s) or not pages or number in pages))
            continue
        if WITH_NUMBER.match(s) or NUMBERED.match(s) or SECTIONED.match(s):
            flags.append(len(body) > 1)
            continue
        letters = [c for c in s if c.isalpha()]
        if any(not (c.isalnum() or c in " .,'’&:/()—–-|") for c in s):
            flags.append(False)
            continue
        short = len(s) < 0.72 * wide and s[-1] not in ENDS and len(s.split()) <= 6 and s[0] not in "•({[" and len(letters) > 2
        if not short or len(body) < 2:
            flags.append(False)
            continue
        loud = sum(c.isupper() for c in letters) >= 0.8 * len(letters)
        before = next((x.strip() for x in reversed(lines[:i]) if x.strip()), "")
        after = next((x.strip() for x in lines[i + 1 :] if x.strip()), "")
        titled = s[0].isupper() and not re.search(r"[.!?]\s", s)
        edge = not before or not after
        following = lines[i + 1] if i + 1 < len(lines) else ""
        if following.strip() and len(s) + 1 + len(following.split()[0]) >= wide - 1:  # the line is full
            flags.append(IF_REPEATED if loud else NO)
            continue
        alone = not following.strip() and not (lines[i - 1].strip() if i else "")
        cut = before and before[-1] not in STOPS and (alone or after[:1].islower())
        shaped = loud or titled and (edge or cut or before[-1:] in ".!?" and after[:1].isupper() and wide - len(s) > 12)
        flags.append(NO if not shaped else SURE if before and before[-1] not in STOPS and after[:1].islower() else IF_REPEATED)
    return flags


class Decoder:
    """lexicon: known words, in lower case. Sorted, they are a trie: the words of a prefix are a stretch."""

    def __init__(self, lexicon):
        self.words, self.known, self.memo = sorted(lexicon), frozenset(lexicon), {}

    def _down(self, lo: int, hi: int, prefix: str) -> tuple[int, int]:
        """The stretch of the words that begin with the prefix, within that of a shorter one."""
        lo = bisect_left(self.words, prefix, lo, hi)
        return lo, bisect_left(self.words, prefix + "\U0010ffff", lo, hi)

    def keep(self, core: str) -> float:
        """The cost of a token as it is."""
        if core.lower() in self.known or len(core) < 2 or not any(c.isalpha() for c in core):
            return 0.0
        if not self._plain(core):
            return 0.5
        return UNKNOWN + LETTER * max(0, len(core) - 8)

    def _plain(self, core: str) -> bool:
        """Whether it is written like a word: not an identifier, a name with capitals inside, or of a script without spaces."""
        return not (any(c in "_.-/" or c >= "\u2e80" and not "\ufb00" <= c <= "\ufb04" for c in core) or any(c.isupper() for c in core[1:]) and not core.isupper())

    def _words(self, text: str, at: int, skips: dict[int, tuple[float, int]], most: float):
        """(end, word, cost, confusions, line ends) of the words that can be read from `at` on at a cost up to `most`; `skips`
        has the price of going on behind a position, and whether a line ends there."""
        stack = [(at, "", 0, len(self.words), 0.0, 0, 0)]
        while stack:
            p, prefix, lo, hi, cost, wrong, over = stack.pop()
            if prefix and self.words[lo] == prefix:
                yield p, prefix, cost, wrong, over
            if p in skips and prefix:
                price, line = skips[p]
                cost, over = cost + price, over + line
            if p >= len(text) or cost > most:
                continue
            moves = [(1, text[p], 0.0)] + [(len(b), a, price) for b, a, price in READINGS.get(text[p], ()) if cost + price <= most and text.startswith(b, p)]
            for n, c, price in moves:
                if any(q in skips for q in range(p + 1, p + n)):
                    continue
                a, b = self._down(lo, hi, prefix + c)
                if a < b:
                    stack.append((p + n, prefix + c, a, b, cost + price, wrong + (price > 0), over))

    def decode(self, tokens: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], int, int]:
        """tokens: (what is before it: "" or white space, token). (tokens as read, words joined over a line end, confusions)."""
        n = len(tokens)
        parts = [_parts(t) for _, t in tokens]
        cost = [self.keep(c) for _, c, _ in parts]

        def joint(k: int) -> str:
            """How token k may go on in the next one: "-" over a hyphen at the line end, "n" over the line end, " " or ""."""
            if k + 1 >= n or not parts[k][1] or parts[k + 1][0] or not parts[k + 1][1][:1].isalpha():
                return ""
            over, (_, core, tail) = "\n" in tokens[k + 1][0], parts[k]
            if over and len(tail) == 1 and tail in HYPHENS and core[-1:].isalpha():
                return "-"
            if tail or not core.isalpha() or not parts[k + 1][1].islower() or tokens[k + 1][0] == "\n\n" or not (self._plain(core) and self._plain(parts[k + 1][1])):
                return ""
            return ("n" if over else " ") if cost[k] >= UNKNOWN or cost[k + 1] >= UNKNOWN and over is False else ""

        out, joined, wrong, i = [], 0, 0, 0
        while i < n:
            j = i
            while joint(j):
                j += 1
            if i == j and cost[i] < UNKNOWN:
                out.append(tokens[i])
                i += 1
                continue
            kinds = [joint(k) for k in range(i, j)]
            if i == j:
                core = parts[i][1]
                if core not in self.memo:
                    if len(self.memo) > 200_000:
                        self.memo.clear()
                    self.memo[core] = self._stretch([("", core, "")], [], [cost[i]])
                read, x, w = self.memo[core]
                read = [(read[0][0], parts[i][0] + read[0][1] + parts[i][2])]
            else:
                read, x, w = self._stretch(parts[i : j + 1], kinds, cost[i : j + 1])
            out += [(tokens[i + k][0], t) for k, t in read]
            joined, wrong, i = joined + x, wrong + w, j + 1
        return out, joined, wrong

    def _stretch(self, parts, kinds: list[str], cost: list[float]):
        """((token it begins in, reading) in order, words joined over a line end, confusions) of tokens that may go on in each other."""
        raw = "".join(c for _, c, _ in parts)
        text = "".join(c.lower() if len(c.lower()) == 1 else c for c in raw)
        starts, at = [], 0
        for _, c, _ in parts:
            starts.append(at)
            at += len(c)
        ends = [*starts[1:], len(text)]
        skips = {ends[k]: ({"-": HYPHEN, "n": LINE_END, " ": SPACE}[kind], int(kind != " ")) for k, kind in enumerate(kinds)}
        token, stops = {p: k for k, p in enumerate(starts)}, {p: k for k, p in enumerate(ends)}
        best: dict[int, tuple] = {0: (0.0, None)}
        for p in range(len(text)):
            if p not in best:
                continue
            here = best[p][0]
            k = token.get(p)

            def reach(to: int, price: float, reading: str, x: int, w: int, p=p, k=k, here=here):
                e = token.get(to)
                if e is not None and e > 0 and kinds[e - 1] == "-" and reading[-1:] not in HYPHENS:
                    reading, price = reading + "-", price + 1.5  # a hyphen that ends a line is rarely the word's own
                if to not in best or here + price < best[to][0] - 1e-9:
                    best[to] = (here + price, (p, reading, x, w))

            if k is not None:
                reach(ends[k], cost[k], parts[k][1], 0, 0)
                if k < len(kinds) and kinds[k] == "-":
                    a, b = parts[k][1], parts[k + 1][1]
                    if (a + b).lower() not in self.known:
                        reach(ends[k + 1], min(self.keep(a + b), 1.6) + HYPHEN, a + b, 1, 0)
                        if a.lower() in self.known and b.lower() in self.known and parts[k][2] in "-‐‑":
                            reach(ends[k + 1], 1.0, f"{a}-{b}", 1, 0)
            inside = bisect_right(starts, p) - 1
            whole = k is not None
            if whole and cost[inside] == 0 and not (inside < len(kinds) and kinds[inside]):
                continue  # a known word that goes on in nothing
            most = UNKNOWN - 0.1 + LETTER * max(0, ends[inside] - starts[inside] - 8)
            for to, word, price, w, over in self._words(text, p, skips, most):
                at_end = to in stops
                if not at_end and (ends[inside] - starts[inside] < 8 or len(word) < 2 or w and len(word) < 3 or not text[to].isalnum()) or not whole and (len(word) < 2 or w and len(word) < 3):
                    continue
                price += 0.0 if at_end else SPLIT + SHORT * (len(word) < 3)
                price += SHORT * (not whole and len(word) < 3)
                reading = _cased(word, raw[p:to])
                reach(to, price, reading, over, w)
        path, p, x, w = [], len(text), 0, 0
        while p > 0:
            back, reading, a, b = best[p][1]
            path.append((back, p, reading))
            x, w, p = x + (a > 0), w + b, back
        out = []
        for begin, end, reading in path[::-1]:
            first = bisect_right(starts, begin) - 1
            lead = parts[first][0] if begin == starts[first] else ""
            e = stops.get(end)
            tail = parts[e][2] if e is not None and (e == len(kinds) or kinds[e] != "-") else ""
            if begin == starts[first]:
                out.append((first, [lead + reading + tail]))
            else:
                out[-1][1].append(reading + tail)
        out = [(k, " ".join(words)) for k, words in out]
        return out, x, w


def _cased(w: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    return w.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else w.capitalize() if like[:1].isupper() else w


def _breaks(lines: list[str], blank: list[bool]) -> list[bool]:
    """Whether a paragraph ends before line i, by dynamic programming over the two choices at every line end."""
    wide = max((len(x) for x in lines), default=0)
    cost, path = [(0.0, 0.0)], []
    for i in range(1, len(lines)):
        before, here = lines[i - 1].rstrip(), lines[i]
        ended, starts = before[-1:] in ".!?。！？:", here.strip()[:1]
        room = wide - len(before)
        first = len(here.split(" ", 1)[0]) if here.split() else 0
        join = (1.5 if blank[i] and ended else 0.0) + (2.0 if here[:1] in " \t" and here.strip() else 0.0) + (1.0 if ended and room > first + 8 else 0.0) + (2.0 if starts in "•" else 0.0)
        part = 1.0 + (0.0 if ended else 2.5) + (2.0 if starts.islower() else 0.0) - (0.8 if blank[i] else 0.0)
        a, b = cost[-1]
        path.append((a <= b, a <= b + 0.2))  # for join and break here: whether the choice before was to join
        cost.append((min(a, b) + join, min(a, b + 0.2) + part))
    out, state = [False] * len(lines), None
    for i in range(len(lines) - 1, 0, -1):
        if state is None:
            state = cost[i][0] <= cost[i][1]
        out[i] = not state
        state = path[i - 1][0 if state else 1]
    return out


def line_key(line: str, decoder: Decoder) -> str:
    """The line as it is read, in lower case with # for figures, to tell whether it comes again."""
    read, _, _ = decoder.decode([(" " if k else "", t) for k, t in enumerate(line.split())])
    return re.sub(r"\d+", "#", " ".join(t for _, t in read).lower())


def repair(text: str | None, pages: set[int], decoder: Decoder, repeated=frozenset()) -> tuple[str | None, int, int, int]:
    """(repaired text, furniture lines, words joined over a line end, confusions undone); null and empty stay as they are.
    repeated: keys of lines that come on several nodes of the document."""
    if not text:
        return text, 0, 0, 0
    lines = text.split("\n")
    gone = [f == SURE or f == IF_REPEATED and line_key(x, decoder) in repeated for x, f in zip(lines, _furniture(lines, pages))]
    kept, blank, gap = [], [], False
    for x, g in zip(lines, gone):
        if g or not x.strip():
            gap = True if not g else gap
            continue
        kept.append(x)
        blank.append(gap)
        gap = False
    breaks = _breaks(kept, blank)
    tokens = []
    for i, x in enumerate(kept):
        for k, t in enumerate(x.split()):
            tokens.append(("" if not tokens else " " if k else "\n\n" if breaks[i] else "\n", t))
    out, joined, wrong = decoder.decode(tokens)
    fixed = "".join(("\n\n" if g == "\n\n" else " " if g else "") + t for g, t in out)
    return fixed, sum(gone), joined, wrong


def scanned(df: DataFrame) -> Column:
    return F.lower(F.coalesce("file_name", "source")).endswith(".pdf")


def lexicon(df: DataFrame, least: int = 3, rate: float = 1e-6) -> list[str]:
    """The words of born-digital nodes: runs of letters that occur `least` times and are `rate` of all words at least, which
    leaves 1 / rate of them at most, however large the collection."""
    words = df.where(F.coalesce(~scanned(df), F.lit(True)) & F.col("text").isNotNull()).select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}\p{Nd}_.\-]+")).alias("w"))
    words = words.where(F.col("w").rlike(r"^\p{L}{2,}\.?$")).select(F.regexp_replace("w", r"\.$", "").alias("w"))
    counts = words.groupBy("w").count()
    total = counts.agg(F.sum("count").alias("all"))
    return [r["w"] for r in counts.join(F.broadcast(total)).where((F.col("count") >= least) & (F.col("count") >= rate * F.col("all"))).select("w").collect()]


def _pages(b) -> list[set]:
    return [set(p or ()) | ({q} if q is not None else set()) for p, q in zip(b["page_numbers"].to_pylist(), b["page"].to_pylist())]


def _candidates(batches, known):
    decoder = Decoder(known.value)
    for b in batches:
        who, keys = [], []
        for k, (t, pages) in enumerate(zip(b["text"].to_pylist(), _pages(b))):
            lines = t.split("\n") if t else []
            for x, f in zip(lines, _furniture(lines, pages)):
                if f == IF_REPEATED or f == SURE and not any(c.isdigit() for c in x):
                    who.append(k)
                    keys.append(line_key(x, decoder))
        yield pa.record_batch({"node_no": b["node_no"].take(pa.array(who, pa.int64())), "doc_id": b["doc_id"].take(pa.array(who, pa.int64())), "key": pa.array(keys, pa.string())})


def _repair(batches, known):
    decoder = Decoder(known.value)
    for b in batches:
        got = [repair(t, p, decoder, frozenset(r or ())) for t, p, r in zip(b["text"].to_pylist(), _pages(b), b["repeated"].to_pylist())]
        cols = list(zip(*got)) if got else [(), (), (), ()]
        yield pa.record_batch({"node_no": b["node_no"], "repaired": pa.array(cols[0], pa.string()), **{c: pa.array(v, pa.int32()) for c, v in zip(("furniture", "joined", "confusions"), cols[1:])}})


def repair_scans(df: DataFrame) -> DataFrame:
    """(node_no, repaired, furniture, joined, confusions) for the nodes of scanned files; a clean node has three zeros.

    The lexicon, a list of bounded size, is taken from all nodes of other files first. Headings that may be running headers
    are counted by document; nodes without a document have none that repeat. Null texts are left out.
    """
    known = df.sparkSession.sparkContext.broadcast(frozenset(lexicon(df)))
    pages = df.where(scanned(df) & F.col("text").isNotNull()).select("node_no", (F.col("doc_id").cast("string") if "doc_id" in df.columns else F.lit(None).cast("string")).alias("doc_id"), "text", "page", "page_numbers")
    lines = pages.mapInArrow(lambda b: _candidates(b, known), "node_no long, doc_id string, key string").where("doc_id is not null and node_no is not null")
    again = lines.groupBy("doc_id", "key").agg(F.min("node_no").alias("a"), F.max("node_no").alias("b")).where("a < b").select("doc_id", "key")
    found = lines.join(again, ["doc_id", "key"], "left_semi").groupBy("node_no").agg(F.collect_set("key").alias("repeated"))
    rows = pages.select("node_no", "text", "page", "page_numbers").join(found, "node_no", "left")
    return rows.mapInArrow(lambda b: _repair(b, known), "node_no long, repaired string, furniture int, joined int, confusions int")
