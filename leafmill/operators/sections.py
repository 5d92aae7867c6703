"""Documents to sections and sections to chunks as DataFrame operators; a failing document gives an error row, not an end."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leafmill.functions import chunk as C, parse as P
from leafmill.functions.text import content_id
from leafmill.operators.runs import SIZE, neighbours, running

SECTION = "section_idx int, level int, section_header string, section_path string, text string, images array<string>, title string, canonical_url string, web_meta map<string,string>, error string"
PARSERS = {".txt": P.parse_text, ".md": P.parse_markdown, ".html": P.parse_html, ".htm": P.parse_html}


def _sections(batches, options: dict):
    kinds = {"section_idx": pa.int32(), "level": pa.int32(), "images": pa.list_(pa.string()), "web_meta": pa.map_(pa.string(), pa.string())}
    names = [x.strip().split(" ")[0] for x in SECTION.split(", ")]
    for b in batches:
        keep, rows = [], []
        for k, (text, ext) in enumerate(zip(b["text"].to_pylist(), b["extension"].to_pylist())):
            parser = PARSERS.get(ext)
            if text is None or parser is None:
                continue
            try:
                got = parser(text, **options.get(ext, {}))
            except Exception as e:  # noqa: BLE001  (isolated to its document)
                got = [{"error": f"{type(e).__name__}: {e}"}]
            for i, s in enumerate(got):
                keep.append(k)
                rows.append({"section_idx": i, **s})
        ids = b["doc_id"].take(pa.array(keep, pa.int64()))
        cols = {c: [list(r[c].items()) if c == "web_meta" and r.get(c) is not None else r.get(c) for r in rows] for c in names}
        yield pa.record_batch({"doc_id": ids, **{c: pa.array(v, kinds.get(c, pa.string())) for c, v in cols.items()}})


def split_sections(docs: DataFrame, options: dict | None = None) -> DataFrame:
    """(doc_id, section ...) of documents (doc_id, text, extension). Other file types and null texts give no rows.

    options: keyword arguments of the parsers by extension, e.g. ``{".html": {"clean": (".ad",)}}``.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", "extension").mapInArrow(lambda b: _sections(b, options or {}), f"doc_id {kind}, {SECTION}")


def _chunks(batches, size: int, overlap: int):
    for b in batches:
        keep, idx, out = [], [], []
        for k, (text, header) in enumerate(zip(b["text"].to_pylist(), b["section_header"].to_pylist())):
            for i, c in enumerate(C.chunk(text, header, size, overlap)) if text else ():
                keep.append(k)
                idx.append(i)
                out.append(c)
        rows = pa.array(keep, pa.int64())
        names = [n for n in b.schema.names if n != "text"]
        yield pa.record_batch({**{n: b[n].take(rows) for n in names}, "chunk_idx": pa.array(idx, pa.int32()), "text": pa.array(out, pa.string())})


def split_chunks(sections: DataFrame, size: int = 512, overlap: int = 100) -> DataFrame:
    """(doc_id, section_idx, section_header, section_path, level, chunk_idx, text, chunk_id, node_id) of sections. Empty and
    null texts have no chunks. node_id is md5 of the document and the md5 of the text, so equal chunks of one document share
    it and come once."""
    path = F.coalesce("section_path", "section_header", F.lit("Unknown")).alias("section_path")
    s = sections.select("doc_id", "section_idx", "section_header", path, "level", "text")
    kinds = dict(s.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in s.columns if c != "text") + ", chunk_idx int, text string"
    out = s.mapInArrow(lambda b: _chunks(b, size, overlap), schema)
    doc = F.col("doc_id").cast("string")
    out = out.withColumn("chunk_id", F.concat_ws("#", doc, "section_idx", "chunk_idx")).withColumn("node_id", content_id(doc, F.col("text")))
    w = Window.partitionBy("node_id").orderBy("section_idx", "chunk_idx")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def link_chunks(chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """The chunks with prev_id and next_id, their neighbours within the document. Long documents are worked on in stretches of
    `size` sections."""
    return neighbours(chunks, ["doc_id"], "section_idx", "node_id", ("prev_id", "next_id"), ("chunk_idx", "node_id"), size)


def breadcrumbs(headings: DataFrame, deepest: int | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, k, path) for headings (doc_id, k, level, title) in order k: the titles of the open ancestors and its own.

    Of each level the last heading so far is open unless one of a lower level came after it. Headings of level 0 and of no
    level have no path. Levels go as deep as there are headings, or to `deepest`; more than 64 are an error.
    """
    h = headings.where("level >= 1").select("doc_id", "k", "level", "title")
    if deepest is None:
        deepest = h.agg(F.max("level")).head()[0] or 1
        if deepest > 64:
            raise ValueError(f"headings of level {deepest}")
    h, levels = h.where(F.col("level") <= deepest), range(1, deepest + 1)
    last = {f"__l{n}": ("last", F.when(F.col("level") == n, F.struct("k", "title"))) for n in levels}
    cut = {f"__x{n}": ("max", F.when(F.col("level") < n, F.col("k"))) for n in levels}
    h = running(h, ["doc_id"], "k", last | cut, size=size)
    part = lambda n: F.when((F.col("level") >= n) & F.col(f"__l{n}").isNotNull() & (F.col(f"__x{n}").isNull() | (F.col(f"__x{n}") < F.col(f"__l{n}.k"))), F.col(f"__l{n}.title"))
    return h.select("doc_id", "k", F.concat_ws(" > ", *(part(n) for n in levels)).alias("path"))
