"""Reading files as blobs, and office, table and JSON files as rows; writing and reading evaluation sets."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmill.functions.parse import decode_bytes
from leafmill.functions.text import domain_of, extension_of, mime_of

DEFAULT_EXTENSIONS = (".md", ".html", ".pdf", ".txt")
# Folders and files that are never read.
SKIPPED_DIRS = ("_images", ".git", "__pycache__")
SKIPPED_FILES = (".DS_Store",)


def describe(files: DataFrame) -> DataFrame:
    """(source, content) with what a blob says of itself; doc_id is the md5 of its bytes, file_hash the same."""
    name = F.element_at(F.split("source", "/"), -1)
    ext = extension_of(F.col("source"))
    size = F.octet_length("content").cast("long")
    return files.select("source", "content", size.alias("size"), size.alias("file_size"), name.alias("file_name"), F.md5("content").alias("doc_id"), F.md5("content").alias("file_hash"), ext.alias("extension"), mime_of(ext).alias("mime_type"), domain_of(F.col("source")).alias("domain"))


def load(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None, enabled: tuple[str, ...] = DEFAULT_EXTENSIONS, recursive: bool = False, follow_links: bool = False) -> DataFrame:
    """The files at a path as blobs. One file of another type is an error; a folder gives the files of the wanted types,
    hidden ones, those in skipped folders and, for local paths, symbolic links left out; a path that is not there is an error."""
    wanted = tuple(e.lower() for e in (extensions or enabled))
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        raise FileNotFoundError(path)
    single = fs.getFileStatus(jpath).isFile()
    if single and os.path.splitext(path)[1].lower() not in wanted:
        raise ValueError(f"unsupported file type: {path}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive or single).lower()).load(path)
    source = F.regexp_replace("path", r"^file:/*", "/")
    out = files.select(source.alias("source"), "content").where(F.lower("path").rlike("(" + "|".join(re.escape(e) for e in wanted) + ")$"))
    if single:
        return describe(out)
    base = re.sub(r"^file:/*", "/", path).rstrip("/")
    below = F.split(F.substring("source", len(base) + 2, 1_000_000), "/")
    out = out.where(~F.exists(below, lambda p: p.startswith(".") | p.isin(*SKIPPED_DIRS, *SKIPPED_FILES)))
    if not recursive:
        out = out.where(F.size(below) == 1)
    if not follow_links and os.path.isdir(base):
        linked = [os.path.join(d, x) for d, ds, fs_ in os.walk(base) for x in (*ds, *fs_) if os.path.islink(os.path.join(d, x))]
        for x in linked:
            out = out.where(~(F.col("source") == x) & ~F.col("source").startswith(x + "/"))
    return describe(out)


def from_bytes(spark: SparkSession, blobs: list[tuple[bytes, str]]) -> DataFrame:
    """Blobs of (bytes, source) pairs held in memory."""
    return describe(spark.createDataFrame([(s, bytearray(b)) for b, s in blobs], "source string, content binary"))


def _decode(batches):
    for b in batches:
        yield pa.record_batch({**{n: b[n] for n in b.schema.names if n != "content"}, "text": pa.array([None if c is None else decode_bytes(c) for c in b["content"].to_pylist()], pa.string())})


def as_text(blobs: DataFrame) -> DataFrame:
    """The blobs with their text in place of their bytes."""
    rest = [c for c in blobs.columns if c != "content"]
    kinds = dict(blobs.dtypes)
    return blobs.mapInArrow(_decode, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "text string"]))


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
PML = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def docx_rows(data: bytes):
    """(part, index, kind, style, text): paragraphs with style and page, by rendered page breaks; tables one row a line."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{W}body")
    page = n = 0
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    for e in body if body is not None else ():
        if e.tag == f"{W}p":
            page += sum(1 for _ in e.iter(f"{W}lastRenderedPageBreak"))
            style = e.find(f"{W}pPr/{W}pStyle")
            yield str(page), n, "paragraph", None if style is None else style.get(f"{W}val"), text(e)
            n += 1
        elif e.tag == f"{W}tbl":
            for r in e.iter(f"{W}tr"):
                yield str(page), n, "row", None, "\t".join(text(c) for c in r.findall(f"{W}tc"))
                n += 1


def xlsx_rows(data: bytes):
    """(sheet, row, "row", null, cells joined by tabs) of every sheet; text that is no workbook is read as CSV."""
    if data[:4] != b"PK\x03\x04":
        for n, r in enumerate(csv.reader(io.StringIO(decode_bytes(data)))):
            yield "sheet", n, "row", None, "\t".join(r)
        return
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
        t = targets[sheet.get(R)]
        for n, row in enumerate(ET.fromstring(z.read(t.lstrip("/") if t.startswith("/") else f"xl/{t}")).iter(f"{S}row")):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.iter(f"{S}c")):
                col = 0
                for ch in re.match("[A-Z]*", c.get("r") or "")[0]:
                    col = col * 26 + ord(ch) - 64
                v, inline = c.find(f"{S}v"), c.find(f"{S}is")
                x = "".join(t.text or "" for t in inline.iter(f"{S}t")) if inline is not None else "" if v is None else v.text or ""
                cells[col - 1 if col else k] = shared[int(x)] if c.get("t") == "s" and x else x
            yield sheet.get("name"), n, "row", None, "\t".join(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", cells.get(k, "")) for k in range(max(cells, default=-1) + 1))


def pptx_rows(data: bytes):
    """(slide, index, "shape", null, text): shapes from top to bottom in steps of ten points, then from the left; bullets by
    their level indented, tables as header: value."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for name in slides:
        found = []
        for e in ET.fromstring(z.read(name)).iter():
            if e.tag not in (f"{PML}sp", f"{PML}graphicFrame"):
                continue
            off = next(e.iter(f"{A}off"), None)
            x, y = (int(off.get("x")), int(off.get("y"))) if off is not None else (0, 0)
            rows = [["".join(t.text or "" for t in c.iter(f"{A}t")) for c in r.iter(f"{A}tc")] for r in e.iter(f"{A}tr")]
            if rows:
                text = "\n".join("; ".join(f"{h}: {v}" for h, v in zip(rows[0], r) if v) for r in rows[1:])
            else:
                text = "\n".join("  " * int((p.find(f"{A}pPr").get("lvl") or 0) if p.find(f"{A}pPr") is not None else 0) + "".join(t.text or "" for t in p.iter(f"{A}t")) for p in e.iter(f"{A}p"))
            if text.strip():
                found.append((y // 127_000, x, text))
        for n, (_, _, text) in enumerate(sorted(found, key=lambda f: f[:2])):
            yield str(int(re.findall(r"\d+", name)[-1])), n, "shape", None, text


OFFICE = {".docx": docx_rows, ".xlsx": xlsx_rows, ".csv": xlsx_rows, ".pptx": pptx_rows}


def _office(batches):
    for b in batches:
        rows = []
        for source, ext, data in zip(b["source"].to_pylist(), b["extension"].to_pylist(), b["content"].to_pylist()):
            if ext not in OFFICE or data is None:
                continue
            try:
                rows += [(source, *r, None) for r in OFFICE[ext](data)]
            except Exception as e:  # noqa: BLE001  (isolated to its file)
                rows.append((source, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        cols = list(zip(*rows)) or [()] * 7
        yield pa.record_batch({n: pa.array(c, pa.int32() if n == "idx" else pa.string()) for n, c in zip(("source", "part", "idx", "kind", "style", "text", "error"), cols)})


def office_rows(blobs: DataFrame) -> DataFrame:
    """(source, part, idx, kind, style, text, error) of .docx, .xlsx, .csv and .pptx blobs; a broken file is one error row."""
    return blobs.select("source", "extension", "content").mapInArrow(_office, "source string, part string, idx int, kind string, style string, text string, error string")


def is_json_lines(text: str) -> bool:
    """Not one JSON value, and of the first ten lines that are not blank at least four fifths are."""
    def ok(s):
        try:
            json.loads(s)
            return True
        except ValueError:
            return False

    if ok(text):
        return False
    lines = [x for x in text.split("\n") if x.strip()][:10]
    return bool(lines) and sum(map(ok, lines)) >= 0.8 * len(lines)


def save_qa(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, path: str) -> None:
    """An evaluation set: queries (query_id, text), qrels (query_id, node_id), corpus (node_id, text), as JSON."""
    for name, d in (("queries", queries), ("qrels", qrels), ("corpus", corpus)):
        d.write.mode("overwrite").json(f"{path}/{name}")


def load_qa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.json(f"{path}/{name}") for name in ("queries", "qrels", "corpus"))
