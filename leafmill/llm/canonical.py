"""One consistent form for texts that look the same but differ in their characters.

Whole Arrow batches are turned into one array of code points. Lookup tables, built from the Unicode database by rules and
from the short lists below, give every code point its expansion; gathers and offsets write the expanded text. Combining
marks are then composed over the whole array: rank by rank, every mark that directly follows its base is looked up as a
pair. No row is touched by itself. What looks different stays different: digits, letter case, accents, line breaks, and
superscripts, fractions and other compatibility forms that are not drawn like their plain ones.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafmill.tables import cut

# Letters of other scripts that are drawn like Latin ones, side by side with these.
LOOK_ALIKE = dict(
    zip(
        "АВЕЅЗІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝүѵ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιϲϳαρυ" + "ոօսԼՕՍ" + "ɑɡ" + "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ"
        + "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ" + "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ",
        "ABES3IJKMHOPCTYXYGQWaesijopcyxhdqwyv" + "ABEZHIKMNOPTYXovicjapu" + "nouLOU" + "ag" + "IVXLCDMivxlcdm"
        + "ABCDEFGHIJKLMNOPRSTUVWXYZ" + "ABCDEGHJKLMPRSTVWZ",
        strict=True,
    )
)
del LOOK_ALIKE["З"], LOOK_ALIKE["ι"]
# Hyphens, quotes that are one sign in several codes, and signs with two codes.
SAME = {"‐": "-", "‑": "-", "﹣": "-", "－": "-", "−": "-", "⁃": "-", "˗": "-", "µ": "μ", "Ω": "Ω", "K": "K", "Å": "Å", "∙": "·", "‧": "·", "･": "・", "ſ": "s", "¨": "¨"}
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]
SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
SIZE = 0x110000
HANGUL_L, HANGUL_V, HANGUL_T, HANGUL_S = 0x1100, 0x1161, 0x11A7, 0xAC00


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(expansion length, start in the pool, pool, combining class, pair keys, pair values)."""
    plain = {}
    for c in range(SIZE):
        if 0xD800 <= c < 0xE000:
            continue
        d = unicodedata.decomposition(chr(c))
        if d and (not d.startswith("<") or d.startswith(("<wide>", "<narrow>"))) or 0xFB00 <= c <= 0xFB06 or 0xFB13 <= c <= 0xFB17 or 0xAC00 <= c < 0xD7A4 or 0xF900 <= c < 0xFB00:
            plain[c] = unicodedata.normalize("NFKD" if d.startswith("<") else "NFD", chr(c))
    for c in INVISIBLE:
        plain[c] = ""
    for c in SPACES:
        plain[c] = " "
    for a, b in SAME.items():
        plain[ord(a)] = unicodedata.normalize("NFD", b)
    for a, b in LOOK_ALIKE.items():
        plain[ord(a)] = b
    out = {}
    for c, s in plain.items():  # what an expansion holds may itself be drawn like a Latin letter
        out[c] = "".join(plain.get(ord(x), x) if x != chr(c) else x for x in s)
    size, start, pool = np.ones(SIZE, np.int8), np.zeros(SIZE, np.int32), []
    for c, s in out.items():
        size[c], start[c] = len(s), len(pool)
        pool.extend(map(ord, s))
    size[0xD800:0xE000] = 1
    changed = np.array(sorted(out))
    start[np.setdiff1d(np.arange(SIZE), changed, assume_unique=True)] = -1
    mark = np.zeros(SIZE, np.uint8)
    pairs = {}
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        mark[c] = unicodedata.combining(chr(c))
        d = unicodedata.decomposition(chr(c))
        if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", chr(c)) == chr(c):
            a, b = (int(x, 16) for x in d.split())
            a2 = LOOK_ALIKE.get(chr(a))  # "й" of its own letter stays; a Latin base takes the Latin composition
            if a2 is None:
                pairs[a << 21 | b] = c
    keys = np.array(sorted(pairs), np.int64)
    return size, start, np.array(pool or [0], np.uint32), mark, keys, np.array([pairs[k] for k in keys], np.uint32)


def fold(points: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, lengths of the texts) in the consistent form."""
    size, start, pool, mark, keys, values = tables()
    row = np.repeat(np.arange(len(lens)), lens)
    if len(points) and (points > 0x7F).any():
        n, s = size[points].astype(np.int64), start[points]
        if (s >= 0).any():
            at = np.cumsum(n) - n
            src = np.repeat(np.arange(len(points)), n)
            k = np.arange(len(src)) - at[src]
            base = s[src]
            points, row = np.where(base >= 0, pool[np.maximum(base, 0) + np.where(base >= 0, k, 0)], points[src]), row[src]
        points, row = _compose(points, row, mark, keys, values)
        points = _own_script(points, row)
    return points.astype(np.uint32), np.bincount(row, minlength=len(lens)).astype(np.int64)


@lru_cache(maxsize=1)
def _scripts() -> tuple[np.ndarray, list[tuple[np.ndarray, int, np.ndarray]]]:
    """(whether a code point is a letter; for Cyrillic and Greek: whether it is one of theirs, how many of those a word of
    theirs has, the letter drawn like a Latin one)."""
    n = 0x2000
    letter = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(n)])
    found = []
    for first, last, least in ((0x400, 0x530, 1), (0x370, 0x400, 2)):  # a single Greek letter is a sign, as in units
        back = np.arange(n, dtype=np.uint32)
        for a, b in LOOK_ALIKE.items():
            if first <= ord(a) < last and a in "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдежзийклмнопрстуфхцчшщъыьэюя" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρυ":
                back[ord(b)] = ord(a)
        for c in range(first, last):  # letters with marks, by those without
            d = unicodedata.normalize("NFD", chr(c))
            latin = unicodedata.normalize("NFC", LOOK_ALIKE.get(d[0], "") + d[1:])
            if len(d) > 1 and len(latin) == 1 and ord(latin) < n and back[ord(LOOK_ALIKE.get(d[0], "\0"))] == ord(d[0]):
                back[ord(latin)] = c
        found.append(((np.arange(n) >= first) & (np.arange(n) < last), least, back))
    return letter, found


def _own_script(p: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words that hold a letter only Cyrillic has, or two that only Greek has, are written in that script; all others stay
    Latin. A word that could be either has one form as well, so this keeps equal forms equal."""
    letter, scripts = _scripts()
    q = np.minimum(p, len(letter) - 1)
    known = p < len(letter)
    is_letter, word, out = letter[q] & known, None, p
    for own, least, back in scripts:
        c = own[q] & known & is_letter
        if not c.any():
            continue
        if word is None:
            word = np.cumsum(np.concatenate([[True], (is_letter[1:] != is_letter[:-1]) | (row[1:] != row[:-1])])) - 1
        mixed = np.bincount(word[c], minlength=int(word[-1]) + 1) >= least
        out = np.where(mixed[word] & is_letter & (out == p), back[q], out)
    return out


def _compose(p: np.ndarray, row: np.ndarray, mark: np.ndarray, keys: np.ndarray, values: np.ndarray):
    """Marks sorted within their sequence, then composed with their base, nearest first; Hangul from its letters."""
    cc = mark[p]
    if cc.any():
        seq = np.cumsum((cc == 0) | np.concatenate([[True], row[1:] != row[:-1]]))
        run = cc > 0
        idx = np.flatnonzero(run)
        order = np.lexsort((idx, cc[idx], seq[idx]))
        q = p.copy()
        q[idx] = p[idx[order]]
        p, cc = q, mark[q]
        alive = np.ones(len(p), bool)
        starter = np.maximum.accumulate(np.where(cc == 0, np.arange(len(p)), -1))
        rank = np.arange(len(p)) - starter
        last = np.zeros(len(p), np.uint8)  # at each base: class of the last mark that stayed
        for r in range(1, int(rank[idx].max()) + 1 if len(idx) else 1):
            m = np.flatnonzero((rank == r) & (cc > 0) & (starter >= 0))
            m = m[row[m] == row[starter[m]]]
            if not len(m):
                break
            b = starter[m]
            key = p[b].astype(np.int64) << 21 | p[m].astype(np.int64)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[at] == key) & (last[b] < cc[m])
            p[b[hit]] = values[at[hit]]
            alive[m[hit]] = False
            last[b[~hit]] = np.maximum(last[b[~hit]], cc[m[~hit]])
        p, row = p[alive], row[alive]
    if len(p) > 1:
        lead = (p[:-1] >= HANGUL_L) & (p[:-1] < HANGUL_L + 19) & (p[1:] >= HANGUL_V) & (p[1:] < HANGUL_V + 21) & (row[1:] == row[:-1])
        if lead.any():
            i = np.flatnonzero(lead)
            p = p.copy()
            p[i] = HANGUL_S + ((p[i] - HANGUL_L) * 21 + (p[i + 1] - HANGUL_V)) * 28
            alive = np.ones(len(p), bool)
            alive[i + 1] = False
            j = i[(i + 2 < len(p))]
            j = j[(p[j + 2] > HANGUL_T) & (p[j + 2] < HANGUL_T + 28) & (row[j + 2] == row[j])]
            p[j] += p[j + 2] - HANGUL_T
            alive[j + 2] = False
            p, row = p[alive], row[alive]
    return p, row


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, length of each) of an Arrow string array without nulls, by its buffers."""
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, np.diff(first[ends - ends[0]])


def to_arrow(points: np.ndarray, lens: np.ndarray) -> pa.Array:
    """The Arrow string array of code points, by its buffers."""
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    total = np.concatenate([[0], np.cumsum(width)])
    ends = total[np.concatenate([[0], np.cumsum(lens)])]
    raw = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.Array.from_buffers(pa.large_string(), len(lens), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw)])


STEP = 512


def canonical_array(column: pa.Array) -> pa.Array:
    """Every text of the array in the consistent form; nulls stay null."""
    parts = []
    for at in range(0, len(column), STEP):
        c = column.slice(at, STEP)
        got = to_arrow(*fold(*code_points(c.fill_null("")))).cast(pa.string())
        parts.append(pa.compute.if_else(c.is_valid(), got, pa.scalar(None, pa.string())) if c.null_count else got)
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


import pyarrow.compute  # noqa: E402, F401


def _canonical(batches, text_col: str):
    for b in batches:
        k = b.schema.get_field_index(text_col)
        yield pa.RecordBatch.from_arrays([*b.columns, canonical_array(b.column(k))], names=[*b.schema.names, "canonical"])


def canonical_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, canonical) for every row; null gives null, empty gives empty."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _canonical(b, "text"), "id long, text string, canonical string")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, c1, c2, t1, t2): hashes of the form and of the text of every distinct record, kept in the shared folder, so that
    every text is brought to its form once."""
    rows = canonical_texts(df, id_col, text_col).where("id is not null and text is not null")
    return cut(rows.select("id", F.xxhash64("canonical").alias("c1"), F.xxhash64(F.lit(17), "canonical").alias("c2"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(17), "text").alias("t2")).distinct())


def look_alike_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form, texts) for every record: the smallest id whose text looks the same, and how many different texts do."""
    keyed = _keyed(df, id_col, text_col)
    forms = keyed.groupBy("c1", "c2", "t1", "t2").agg(F.min("id").alias("m")).groupBy("c1", "c2").agg(F.min("m").alias("form"), F.count("*").alias("texts"))
    return keyed.join(forms, ["c1", "c2"]).select("id", "form", "texts")


def look_alike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b), a < b: ids whose texts have one consistent form but are not the same sequence of characters.

    Null texts and ids take no part; empty ones do. Ids given twice count once. Texts are compared by 128 bits of hash;
    only forms that come in several texts are joined, so groups of exact copies alone cost nothing.
    """
    keyed = _keyed(df, id_col, text_col)
    varied = keyed.groupBy("c1", "c2").agg(F.min("t1").alias("lo1"), F.max("t1").alias("hi1"), F.min("t2").alias("lo2"), F.max("t2").alias("hi2")).where("lo1 <> hi1 or lo2 <> hi2").select("c1", "c2")
    some = keyed.join(varied, ["c1", "c2"], "left_semi")
    x, y = (some.select("c1", "c2", *(F.col(c).alias(f"{c}{s}") for c in ("id", "t1", "t2"))) for s in "xy")
    return x.join(y, ["c1", "c2"]).where("idx < idy and (t1x <> t1y or t2x <> t2y)").select(F.col("idx").alias("a"), F.col("idy").alias("b"))
