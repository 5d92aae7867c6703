"""Cutting oversized texts at natural boundaries by dynamic programming.

A text longer than its limit is cut at boundary positions: paragraph, line, sentence, clause and word ends, and between
any two characters only inside an unbroken run that is itself too long. The program minimises the sum of the cuts'
penalties and of the squared deviation of the pieces' sizes from equal sizes, subject to every piece, with the text it
repeats from the piece before it, being within the limit. What is repeated begins at the first boundary within the
overlap. Each piece is a slice of the text, so the text can be put together again from the offsets.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Cost of a cut after a boundary of each kind.
PENALTY = {"paragraph": 0.0, "line": 0.3, "sentence": 0.5, "clause": 1.5, "word": 3.0, "character": 12.0}
BOUNDARY = re.compile(r"(?P<paragraph>\n[ \t]*\n\s*)|(?P<line>\n)|(?P<sentence>[.!?…][\"'”’)\]]*\s+|[。！？])|(?P<clause>[,;:]\s+|[，；：、])|(?P<word>\s+)")
IMBALANCE = 4.0


def boundaries(text: str, gap: int, forced: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and penalties. Clause and word ends only count within stretches of more than `gap` characters
    without a better one, single characters only within unbroken runs of more than `forced`."""
    pos, pen, weak = [], [], []
    for m in BOUNDARY.finditer(text):
        (weak if m.lastgroup in ("clause", "word") else pos).append((m.end(), PENALTY[m.lastgroup]))
    edges = [0, *(p for p, _ in pos), len(text)]
    wide = [(a, b) for a, b in zip(edges, edges[1:]) if b - a > gap]
    if wide:
        at = [p for p, _ in weak]
        for a, b in wide:
            pos.extend(weak[bisect_left(at, a + 1) : bisect_left(at, b)])
        pos.sort()
        edges = [0, *(p for p, _ in pos), len(text)]
        for a, b in zip(edges, edges[1:]):
            if b - a > forced:
                pos.extend((p, PENALTY["character"]) for p in range(a + forced // 2, b, max(1, forced // 8)))
        pos.sort()
    pos = [(p, c) for p, c in pos if 0 < p < len(text)]
    return np.array([0, *(p for p, _ in pos), len(text)], np.int64), np.array([0.0, *(c for _, c in pos), 0.0])


def split_text(text: str, limit: int, overlap: int = 400) -> list[tuple[int, int, int]]:
    """(start, fresh, end) of each piece: text[start:end], of which text[start:fresh] repeats the piece before.

    A text within the limit, the empty text too, is one piece. The overlap is cut down to a third of a small limit.
    """
    if limit < 3:
        raise ValueError("limit must be at least 3")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    overlap = min(overlap, limit // 3)
    room = limit - overlap
    pos, pen = boundaries(text, room // 4, room // 3)
    # where the repeated part of a piece starting with new text at pos[j] begins: the first boundary within the overlap
    first = np.searchsorted(pos, pos - overlap, side="left")
    begin = np.where(pos[first] < pos, pos[first], np.maximum(0, pos - overlap))
    begin[0] = 0
    n = int(np.ceil((len(text) - limit) / room)) + 1
    target = len(text) / n
    best, back = np.full(len(pos), np.inf), np.zeros(len(pos), np.int64)
    best[0] = 0.0
    low = 0
    for j in range(1, len(pos)):
        while begin[low] < pos[j] - limit:
            low += 1
        fresh = pos[j] - pos[low:j]
        cost = best[low:j] + IMBALANCE * ((fresh - target) / target) ** 2
        k = int(cost.argmin())
        best[j], back[j] = cost[k] + pen[j], low + k
    cuts, j = [], len(pos) - 1
    while j > 0:
        i = int(back[j])
        cuts.append((int(begin[i]), int(pos[i]), int(pos[j])))
        j = i
    return cuts[::-1]


def limit_of(section_header: Column, plain: int = 2048, table: int = 1536) -> Column:
    """The limit of a node: smaller where the header contains "table" in any letter case; null headers count as plain."""
    return F.when(F.lower(section_header).contains("table"), F.lit(table)).otherwise(F.lit(plain))


PIECES = "piece int, pieces int, start int, fresh int, end int, piece_text string"


def _split(batches, overlap: int):
    for b in batches:
        keep, rows = [], []
        for k, (t, limit) in enumerate(zip(b["text"].to_pylist(), b["limit"].to_pylist())):
            cuts = split_text(t, limit, overlap)
            for i, (s, f, e) in enumerate(cuts):
                keep.append(k)
                rows.append((i, len(cuts), s, f, e, t[s:e]))
        ids = b["node_no"].take(pa.array(keep, pa.int64()))
        cols = list(zip(*rows)) if rows else [[]] * 6
        yield pa.record_batch({"node_no": ids, **{c: pa.array(v, pa.string() if c == "piece_text" else pa.int32()) for c, v in zip(("piece", "pieces", "start", "fresh", "end", "piece_text"), cols)}})


def split_oversized(df: DataFrame, overlap: int = 400, plain: int = 2048, table: int = 1536) -> DataFrame:
    """(node_no, piece, pieces, start, fresh, end, piece_text) of the nodes whose text exceeds their limit, in characters.

    Nodes delivered twice give their pieces once for each delivery of different text and once for equal ones; null texts
    exceed nothing. Only oversized texts leave the JVM.
    """
    big = df.select("node_no", "text", limit_of(F.col("section_header"), plain, table).alias("limit")).where(F.length("text") > F.col("limit"))
    return big.mapInArrow(lambda b: _split(b, overlap), f"node_no long, {PIECES}")
