"""The queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from leafmill.functions import cells as K, chunk as C, elements as EL, parse as P, records as RC, spans as SP, text as T
from leafmill.operators import blocks as B, cache, encode as E, index as I, layout as L, retrieve as R, sections as S
from leafmill.operators.incremental import applied_state, capture, current_state, pending, pending_changes
from leafmill.sources.files import OFFICE  # noqa: F401  (part of the public surface)
from leafmill.streaming.ingest import stream_table, upsert_stream
from leafmill.tables import shared_dir, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def nodes(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Distinct nodes: rows delivered twice agree in all but ingested_at."""
    return table(spark, sf, "text_nodes").select("node_no", *columns).dropDuplicates(["node_no"])


NODES = "select distinct node_no, {} from text_nodes"


# -- files and change detection ------------------------------------------------------------------------------------------


@query("""
    with now as (
        select source, arg_max(h, (seen_at, blob_id)) as file_hash
        from (select source, seen_at, blob_id, lower(coalesce(file_hash, doc_id)) as h from blobs)
        where h is not null and source is not null and seen_at is not null group by source),
    before as (
        select source, lower(arg_max(content_hash, (run_no, log_id))) as content_hash
        from ingest_log where run_no in (select run_no from sync_runs where status = 'success') and source is not null group by source)
    select now.source, now.file_hash from now left join before using (source)
    where now.file_hash is distinct from before.content_hash
""")
def p5_found(spark, sf):
    """Through the change log in two calls over one root: what had landed when the last run began, then what landed since."""
    root, blobs, runs = shared_dir(spark, "sync"), table(spark, sf, "blobs"), table(spark, sf, "sync_runs")
    last = runs.agg(F.max("started_at").cast("string")).head()[0]
    if last is not None:
        capture(spark, root, blobs.where(F.col("landed_at") <= F.lit(last).cast(dict(blobs.dtypes)["landed_at"])))
    return pending(capture(spark, root, blobs), applied_state(table(spark, sf, "ingest_log"), runs))


@query(r"""
    with b as (select distinct source from blobs),
    p as (select source, string_split(source, '/')[-1] as file_name, lower(regexp_extract(source, '[^/.][^/]*?(\.[^./]+)$', 1)) as extension,
        list_filter(list_transform(string_split(source, '/'), lambda x: lower(x)), lambda x: x in ('rfc', 'k8s', 'docker', 'dsp', 'llamaindex', 'langchain', 'langgraph')) as d from b)
    select source, file_name, extension,
        case extension when '.md' then 'text/markdown' when '.txt' then 'text/plain' when '.html' then 'text/html' when '.pdf' then 'application/pdf' when '.json' then 'application/json' end as mime_type,
        case d[1] when 'rfc' then 'RFC' when 'k8s' then 'Kubernetes' when 'docker' then 'Docker' when 'dsp' then 'DSP' when 'llamaindex' then 'LlamaIndex' when 'langchain' then 'LangChain' when 'langgraph' then 'LangGraph' end as domain
    from p
""")
def blob_manifest(spark, sf):
    b = table(spark, sf, "blobs").select("source").distinct()
    ext = T.extension_of(F.col("source"))
    return b.select("source", F.element_at(F.split("source", "/"), -1).alias("file_name"), ext.alias("extension"), T.mime_of(ext).alias("mime_type"), T.domain_of(F.col("source")).alias("domain"))


@query("select source, extension, size from blobs where extension in ('.md', '.txt') and size is not null")
def extension_filter(spark, sf):
    return table(spark, sf, "blobs").where(F.col("extension").isin(".md", ".txt") & F.col("size").isNotNull()).select("source", "extension", "size")


@query("select md5(text) as content_hash, min(doc_id) as doc_id, count(*) as copies, max(length(text)) as chars from documents where text is not null group by 1")
def exact_dedup(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.groupBy(F.md5("text").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max(F.length("text")).cast("long").alias("chars"))


@query("""
    with now as (select source as doc_key, arg_max(h, (seen_at, blob_id)) as new from (select *, lower(coalesce(file_hash, doc_id)) as h from blobs) where h is not null group by source),
    old as (select source as doc_key, lower(arg_max(content_hash, (run_no, log_id))) as old from ingest_log where run_no in (select run_no from sync_runs where status = 'success') group by source)
    select doc_key, case when new is null then 'deleted' when old is null then 'inserted' when old = new then 'unchanged' else 'updated' end as change from now full join old using (doc_key)
""")
def refresh_changes(spark, sf):
    now = current_state(table(spark, sf, "blobs")).select(F.col("source").alias("doc_key"), F.col("file_hash").alias("content_hash"))
    old = applied_state(table(spark, sf, "ingest_log"), table(spark, sf, "sync_runs")).withColumnRenamed("source", "doc_key")
    return I.changes(old, now)


@query("""
    with p as (select source, file_hash, row_number() over (order by source) as n from (""" + SQL["p5_found"] + """))
    select source, file_hash from p where n <= 50
""")
def reingest_batch(spark, sf):
    """The first fifty files to process, as one throttled batch takes them."""
    changed = pending_changes(table(spark, sf, "blobs"), table(spark, sf, "ingest_log"), table(spark, sf, "sync_runs"))
    return changed.orderBy("source").limit(50)


# -- text normalisation ---------------------------------------------------------------------------------------------------

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({}, '\r\n|\r', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_STRIP = r"regexp_replace(regexp_replace(regexp_replace({}, '(?s)\A\s*---[ \t]*\n.*?\n---[ \t]*(\n|\z)', ''), '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g')"


@query(f"select node_no, md5(t) as clean_md5, length(t) as clean_chars from (select node_no, {_STRIP.format(_CLEAN.format('text'))} as t from ({NODES.format('text')})) where t is not null")
def text_clean(spark, sf):
    t = T.strip_placeholders(T.clean_newlines(F.col("text")), after_space=True)
    return nodes(spark, sf, "text").select("node_no", t.alias("t")).where("t is not null").select("node_no", F.md5("t").alias("clean_md5"), F.length("t").cast("long").alias("clean_chars"))


_LENS = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda n: n > 0)"


@query(f"select node_no, cast(case when len(l) = 0 then 80 else greatest(30, least(200, floor(floor(list_aggregate(l, 'median')) * 7 / 10))) end as bigint) as short_line from (select node_no, {_LENS} as l from ({NODES.format('text')}) where text is not null)")
def short_line_threshold(spark, sf):
    n = nodes(spark, sf, "text").where("text is not null")
    return n.select("node_no", T.short_line_threshold(T.line_lengths(F.col("text"))).cast("long").alias("short_line"))


@query(r"""
    with l as (select node_no, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from (select distinct node_no, text from text_nodes where text is not null)),
    s as (select node_no, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') as s from l),
    r as (select node_no, line_no, case when length(s) = 0 then 0
        when regexp_matches(s, '^第[一二三四五六七八九十0-9]+章') then 1
        when length(s) > 3 and regexp_matches(s, '\p{Lu}') and not regexp_matches(s, '[\p{Ll}\p{Lt}]') then 2
        when regexp_matches(s, '^[IVXLCDM]+\.\s') then 3 when regexp_matches(s, '^#+\s') then 4
        when length(s) < 50 and regexp_matches(s, '^[0-9]+(\.[0-9]+)*\s') then 5 when length(s) < 30 and regexp_matches(s, '^[A-Z]') then 6
        when length(s) <= 25 and regexp_matches(s, '[一-鿿]') and regexp_matches(s, '^(章|节|部分|小结|概述|前言|后记|目录|摘要)|(章|节|部分|小结|概述|前言|后记|目录|摘要) ') then 7
        when length(s) <= 25 and regexp_matches(s, '[一-鿿]') and regexp_matches(s, '(主要|功能|特性|方法|结果|讨论|结论)( |$)') and not regexp_matches(s, '[。！？，、；：]') then 8
        else 0 end as rule from s)
    select node_no, line_no, rule from r where rule > 0
""")
def header_candidates(spark, sf):
    lines = nodes(spark, sf, "text").where("text is not null").select("node_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("node_no", F.col("line_no").cast("long").alias("line_no"), T.header_rule(F.col("line")).alias("rule")).where("rule > 0")


@query(r"select node_no, unnest(regexp_extract_all(text, '!\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1)) as href from (select distinct node_no, text from text_nodes)")
def image_targets(spark, sf):
    return nodes(spark, sf, "text").select("node_no", F.explode(T.image_targets(F.col("text"))).alias("href"))


@query(r"""select node_no, md5(regexp_replace(regexp_replace(text, '\[([^\]]*)\]\(#[^)]*\)', '\1', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g')) as linkless_md5
    from (select distinct node_no, text from text_nodes where contains(text, ']('))""")
def markdown_links(spark, sf):
    n = nodes(spark, sf, "text").where(F.col("text").contains("]("))
    return n.select("node_no", F.md5(T.without_images(T.anchor_links(F.col("text")))).alias("linkless_md5"))


@query(r"""select node_no, md5(trim(regexp_replace(regexp_replace(list_reduce(list_prepend(regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g'), list_distinct(regexp_extract_all(regexp_replace(text, '(\w)-\n(\w)', '\1\2', 'g'), '\b(?:[A-Za-z]\s){2,}[A-Za-z]\b'))), lambda t, r: replace(t, r, replace(r, ' ', ''))), '\$([A-Za-z])\$\s*\[\s*\$([A-Za-z0-9]+)\$\s*\]', '$\1[\2]$', 'g'), '\s+', ' ', 'g'))) as clean_md5
    from (select distinct node_no, text from text_nodes where file_name like '%.pdf' and text is not null)""")
def pdf_clean_text(spark, sf):
    n = nodes(spark, sf, "text", "file_name").where(F.col("file_name").endswith(".pdf") & F.col("text").isNotNull())
    return n.select("node_no", F.md5(T.clean_pdf_text(F.col("text"))).alias("clean_md5"))


_ONE_DOLLAR = "regexp_replace({}, '(^|[^$])\\$([^\\n$]+)\\$($|[^$])', '\\1$$\\2$$\\3', 'g')"


@query(r"""with m as (select node_no, regexp_replace(regexp_replace(text, '(?s)\\\[(.*?)\\\]', '$$\1$$', 'g'), '(?s)\\\((.*?)\\\)', '$\1$', 'g') as t
    from (select distinct node_no, text from text_nodes where contains(text, '\[') or contains(text, '\(') or contains(text, '$')))
    select node_no, md5(""" + _ONE_DOLLAR.format(_ONE_DOLLAR.format("t")) + r""") as math_md5 from m""")
def math_delimiters(spark, sf):
    n = nodes(spark, sf, "text").where(F.col("text").contains("\\[") | F.col("text").contains("\\(") | F.col("text").contains("$"))
    return n.select("node_no", F.md5(T.math_delimiters(F.col("text"))).alias("math_md5"))


_ODD = r"[\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}\x{e000}-\x{f8ff}]"


@query(rf"""
    with n as (select node_no, text, length(text) as l, length(text) - length(regexp_replace(text, '{_ODD}', '', 'g')) as odd, length(text) - length(replace(text, '�', '')) as lost from (select distinct node_no, text from text_nodes where text is not null)),
    s as (select *, case when l > 0 then 1 - odd / l else 1.0 end as share from n),
    g as (select *, l > 0 and (share < 0.75 or lost > 0.02 * l) as garbled from s)
    select node_no, round(share, 6) as printable, garbled, l = 0 or share < 0.8 or garbled or regexp_matches(text, '{"|".join(T.FORMULA_PATTERNS)}|{T.FORMULA_SIGNS}') as formula from g
""")
def garbled_and_formula(spark, sf):
    t = F.col("text")
    return nodes(spark, sf, "text").where(t.isNotNull()).select("node_no", F.round(T.printable_share(t), 6).alias("printable"), T.is_garbled(t).alias("garbled"), T.is_formula(t).alias("formula"))


_CASES = " ".join(f"when regexp_matches(s, '{p.replace(chr(39), chr(39) * 2)}') then '{n}'" for p, n in T.CELL_TYPES)


@query(rf"""
    with l as (select distinct node_no, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from (select distinct node_no, text from text_nodes where contains(text, '|'))),
    c as (select trim(unnest(string_split(line, '|'))) as s from l where starts_with(line, '|'))
    select case {_CASES} when len(list_filter(string_split_regex(s, '\s+'), lambda w: length(w) > 1)) between 4 and 11 then 'Tx' when len(list_filter(string_split_regex(s, '\s+'), lambda w: length(w) > 1)) >= 12 then 'Lx' else 'Ot' end as cell_type, count(*) as cells
    from c where s <> '' group by 1
""")
def cell_types(spark, sf):
    lines = nodes(spark, sf, "text").where(F.col("text").contains("|")).select(F.explode(F.split("text", "\n")).alias("line")).where(F.startswith("line", F.lit("|")))
    c = lines.select(F.explode(F.split("line", r"\|")).alias("s")).where(F.trim("s") != "")
    return c.groupBy(T.cell_type(F.col("s")).alias("cell_type")).agg(F.count("*").alias("cells"))


_LEVELS = " ".join(f"when regexp_matches(line, '{p}') then {n}" for p, n in T.BULLETS)


@query(rf"""
    with l as (select unnest(string_split(text, chr(10))) as line from (select distinct node_no, text from text_nodes where text is not null))
    select case when length(line) <= 2 then null when regexp_matches(line, '^[0-9 ().,%+/-]+$') then 0 {_LEVELS} end as bullet_level, count(*) as lines from l group by 1
""")
def bullet_levels(spark, sf):
    lines = nodes(spark, sf, "text").where("text is not null").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(T.bullet_level(F.col("line")).alias("bullet_level")).agg(F.count("*").alias("lines"))


@query("""
    select l_orderkey, l_linenumber, '@@' || l_linenumber || '-' || (l_linenumber + 1) || chr(9) || format('{:.1f}', l_quantity) || chr(9) || format('{:.1f}', l_quantity + 10) || chr(9) || format('{:.1f}', l_linenumber * 12.0) || chr(9) || format('{:.1f}', l_linenumber * 12.0 + 10) || '##' as tag,
        l_quantity as x0, l_linenumber * 12.0 + 10 as bottom, 2::bigint as pages from lineitem
""")
def position_tags(spark, sf):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    tag = T.position_tag(F.array(n, n + 1), q, q + 10, n * 12.0, n * 12.0 + 10)
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tag.alias("tag")).withColumn("p", F.element_at(T.tag_positions(F.col("tag")), 1))
    return t.select("l_orderkey", "l_linenumber", "tag", F.col("p.x0").alias("x0"), F.col("p.bottom").alias("bottom"), F.size("p.pages").cast("long").alias("pages"))


@query("""
    select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d from orders
""")
def date_parts(spark, sf):
    y, m, d = T.date_parts(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return table(spark, sf, "orders").select("o_orderkey", y.cast("long").alias("y"), m.cast("long").alias("m"), d.cast("long").alias("d"))


# -- sections, chunks and links -------------------------------------------------------------------------------------------


@query("select distinct node_no, md5(concat_ws('|', doc_id, md5(coalesce(text, '')))) as content_id, md5(concat_ws('|', doc_id, md5(coalesce(text, '')))) = node_id as agrees from text_nodes")
def content_ids(spark, sf):
    n = nodes(spark, sf, "node_id", "doc_id", "text").withColumn("content_id", T.content_id(F.col("doc_id"), F.col("text")))
    return n.select("node_no", "content_id", (F.col("content_id") == F.col("node_id")).alias("agrees"))


@query("""
    with n as (select distinct node_no, doc_id, node_id from text_nodes)
    select node_no, lag(node_id) over w as prev_id, lead(node_id) over w as next_id from n window w as (partition by doc_id order by node_no)
""")
def chunk_links(spark, sf):
    n = nodes(spark, sf, "doc_id", "node_id").withColumn("section_idx", F.col("node_no")).withColumn("chunk_idx", F.lit(0))
    return S.link_chunks(n).select("node_no", "prev_id", "next_id")


@query("""
    with h as (select distinct node_no as k, doc_id, level, section_header as title from text_nodes where level >= 1 and section_header is not null),
    a as (select x.doc_id, x.k, y.k as yk, y.title from h x join h y on y.doc_id = x.doc_id and y.k <= x.k
        where not exists (select 1 from h z where z.doc_id = x.doc_id and z.k > y.k and z.k <= x.k and z.level <= y.level))
    select doc_id, k, string_agg(title, ' > ' order by yk) as path from a group by doc_id, k
""")
def breadcrumbs(spark, sf):
    n = nodes(spark, sf, "doc_id", "level", "section_header").where("section_header is not null")
    return S.breadcrumbs(n.select("doc_id", F.col("node_no").alias("k"), "level", F.col("section_header").alias("title")))


def _documents(spark, sf) -> DataFrame:
    """Nodes as documents of the type of their file."""
    n = nodes(spark, sf, "text", "file_name")
    return n.select(F.col("node_no").alias("doc_id"), "text", T.extension_of(F.col("file_name")).alias("extension"))


@query()
def parsed_sections(spark, sf):
    return S.split_sections(_documents(spark, sf)).select("doc_id", "section_idx", "level", "section_header", "section_path", "text", "error")


@query()
def chunks(spark, sf):
    """Sections to linked chunks; here each node is a section of its document."""
    n = nodes(spark, sf, "doc_id", "section_header", "section_path", "level", "text").withColumnRenamed("node_no", "section_idx")
    return S.link_chunks(S.split_chunks(n))


@query()
def merged_lines(spark, sf):
    """How many lines of each node stand alone or begin, and how many go on in the one before."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            counts = [P.merged_counts(P.clean(t)) for t in b["text"].to_pylist()]
            yield pa.record_batch({"node_no": b["node_no"], "kept_lines": pa.array([k for k, _ in counts], pa.int64()), "joined_lines": pa.array([j for _, j in counts], pa.int64())})

    return nodes(spark, sf, "text").where("text is not null").mapInArrow(run, "node_no long, kept_lines long, joined_lines long")


@query()
def delimited_chunks(spark, sf):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch({"doc_id": b["doc_id"], "pieces": pa.array([C.split_delimited(t) for t in b["text"].to_pylist()], pa.list_(pa.string()))})

    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, pieces array<string>")
    return d.select("doc_id", F.posexplode("pieces").alias("piece", "text"))


# -- index maintenance ----------------------------------------------------------------------------------------------------


@query("""
    select doc_id, case when doc_id % 7 = 0 then upper(coalesce(lang, '')) else lang end as lang from documents
    union all select doc_id + 1000000000, 'new' from documents where doc_id % 11 = 0
""")
def upsert_rows(spark, sf):
    """A second delivery in which some rows are changed, some the same and some new."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    changed = d.where("doc_id % 7 = 0").withColumn("lang", F.upper(F.coalesce("lang", F.lit(""))))
    new = d.where("doc_id % 11 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit("new").alias("lang"))
    return I.upsert(d, changed.unionByName(changed).unionByName(new), "doc_id")


@query("""
    select distinct node_no, doc_id from text_nodes
    where doc_id not in (select lower(coalesce(file_hash, doc_id)) from blobs where coalesce(file_hash, doc_id) is not null and extension = '.txt') or doc_id is null
""")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "blobs").where("extension = '.txt'").select(F.lower(F.coalesce("file_hash", "doc_id")).alias("doc_id"))
    return I.delete_documents(nodes(spark, sf, "doc_id"), gone).select("node_no", "doc_id")


@query("""
    select count(distinct doc_id) as documents, count(*) as chunks, count(e) as vectors, count(*) = count(e) as in_sync
    from (select node_no, any_value(doc_id) as doc_id, any_value(case when embedding is not null then 1 end) as e from text_nodes group by node_no)
""")
def index_stats(spark, sf):
    return I.index_stats(nodes(spark, sf, "doc_id", "embedding"))


@query("""
    with n as (select distinct node_no, source, text from text_nodes)
    select source, count(*) as generated_chunks, sum(len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')))::bigint as total_tokens from n group by source
""".replace("\\\\", "\\"))
def pipeline_stats(spark, sf):
    n = nodes(spark, sf, "source", "text")
    return n.groupBy("source").agg(F.count("*").alias("generated_chunks"), F.sum(F.size(T.tokens(F.coalesce("text", F.lit(""))))).alias("total_tokens"))


@query("""
    select d.doc_id, d.h in (select md5(text) from documents where doc_id % 2 = 0 and text is not null) as hit, length(d.text) as chars from (select doc_id, text, md5(text) as h from documents where text is not null) d
""")
def cached_results(spark, sf):
    """Lengths of texts, of which every other document's are kept already by content; whether each was."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5("text").alias("h"), "text")
    work = lambda r: r.select("h", F.length("text").cast("long").alias("chars"))
    store = work(d.where("doc_id % 2 = 0").dropDuplicates(["h"]))
    rows, _ = cache.cached(d, store, "h", work)
    return rows.join(store.select("h", F.lit(True).alias("kept")), "h", "left").select("doc_id", F.coalesce("kept", F.lit(False)).alias("hit"), "chars")


@query("""
    select source, arg_max(h, (landed_at, r)) as file_hash, max(landed_at) as landed_at
    from (select *, lower(coalesce(file_hash, '')) as h, lower(coalesce(file_hash, '')) as r from blobs where source is not null) group by source
""")
def stream_upsert(spark, sf):
    """The table as a stream into a store of the latest row of every source."""
    root = shared_dir(spark, "stream")
    s = stream_table(spark, f"{sf}/blobs.parquet").select("source", F.lower(F.coalesce("file_hash", F.lit(""))).alias("file_hash"), "landed_at", F.struct("landed_at", F.lower(F.coalesce("file_hash", F.lit("")))).alias("o"))
    upsert_stream(s, f"{root}/store", "source", "o", f"{root}/checkpoint")
    return I.ChunkStore(spark, f"{root}/store", "source").read().drop("o")


# -- retrieval ------------------------------------------------------------------------------------------------------------

_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_FIRST = "regexp_extract(text, '^[^\\n]*', 0)"


def _doc_queries(spark, sf) -> DataFrame:
    """Every hundredth document's first line as a query."""
    d = table(spark, sf, "documents").where("doc_id % 100 = 0 and text is not null")
    return d.select(F.col("doc_id").alias("query_id"), F.regexp_extract("text", r"^[^\n]*", 0).alias("text"))


def _corpus(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("node_id"), "doc_id", "text")


_BM25 = f"""
    p as (select node_id, term, count(*) as tf from (select doc_id as node_id, unnest({_TOK.format('text')}) as term from documents where text is not null) group by all),
    dl as (select node_id, sum(tf) as dl from p group by 1), st as (select count(*) as n, avg(dl) as a from dl),
    q as (select distinct query_id, term from (select doc_id as query_id, unnest({_TOK.format(_FIRST)}) as term from documents where doc_id % 100 = 0 and text is not null)),
    df as (select term, count(*) as df from p where term in (select term from q) group by 1),
    b as (select query_id, node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) as score from q join p using (term) join df using (term) join dl using (node_id), st group by all),
    bm as (select *, row_number() over (partition by query_id order by score desc, node_id) as rank from b)
"""


@query(f"with {_BM25} select query_id, node_id, score, rank from bm where rank <= 10")
def bm25_topk(spark, sf):
    return R.bm25_top_k(_doc_queries(spark, sf), _corpus(spark, sf), 10)


_DENSE = """
    v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
    dq as (select q.vec_id as query_id, d.vec_id as node_id, round(list_cosine_similarity(q.v, d.v), 9) as score from v q, v d where q.vec_id % 100 = 0 {}),
    dn as (select *, row_number() over (partition by query_id order by score desc, node_id) as rank from dq)
"""


def _vector_queries(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("v"), "label")


def _six(d: DataFrame) -> DataFrame:
    return d.select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_DENSE.format('')} select query_id, node_id, round(score, 6) as score, rank from dn where rank <= 10")
def dense_topk(spark, sf):
    return _six(R.dense_top_k(_vector_queries(spark, sf), _vectors(spark, sf), 10))


@query(f"with {_DENSE.format('and d.label < 5')} select query_id, node_id, round(score, 6) as score, rank from dn where rank <= 10")
def dense_topk_filtered(spark, sf):
    """The filter comes before the search, so that the ten best of what it leaves are found."""
    return _six(R.dense_top_k(_vector_queries(spark, sf), _vectors(spark, sf).where("label < 5"), 10))


_SPARSE = f"""
    w as (select node_id, term, round(1 + ln(count(*)), 6) as weight from (select doc_id as node_id, unnest({_TOK.format('text')}) as term from documents where text is not null) group by all),
    sq as (select query_id, term, round(1 + ln(count(*)), 6) as weight from (select doc_id as query_id, unnest({_TOK.format(_FIRST)}) as term from documents where doc_id % 100 = 0 and text is not null) group by all),
    ss as (select query_id, node_id, round(sum(w.weight * sq.weight), 6) as score from sq join w using (term) group by all),
    sp as (select *, row_number() over (partition by query_id order by score desc, node_id) as rank from ss)
"""


def _sparse(spark, sf, k: int) -> DataFrame:
    return R.sparse_text_top_k(_doc_queries(spark, sf), _corpus(spark, sf), k)


@query(f"with {_SPARSE} select query_id, node_id, score, rank from sp where rank <= 10")
def sparse_topk(spark, sf):
    return _sparse(spark, sf, 10)


_HYBRID = f"""
    nv as (select node_no, any_value(text) as text, any_value(list_transform(embedding, lambda x: x::double)) as v from text_nodes where len(embedding) = 64
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by node_no),
    dq as (select q.node_no as query_id, d.node_no as node_id, round(list_cosine_similarity(q.v, d.v), 9) as score from nv q, nv d where q.node_no % 100 = 0),
    dn as (select *, row_number() over (partition by query_id order by score desc, node_id) as rank from dq),
    w as (select node_id, term, round(1 + ln(count(*)), 6) as weight from (select node_no as node_id, unnest({_TOK.format('text')}) as term from nv) group by all),
    sq as (select query_id, term, round(1 + ln(count(*)), 6) as weight from (select node_no as query_id, unnest({_TOK.format(_FIRST)}) as term from nv where node_no % 100 = 0) group by all),
    ss as (select query_id, node_id, round(sum(w.weight * sq.weight), 6) as score from sq join w using (term) group by all),
    sp as (select *, row_number() over (partition by query_id order by score desc, node_id) as rank from ss),
    x as (select query_id, node_id, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0 end as d from dn where rank <= 20 window w as (partition by query_id)),
    y as (select query_id, node_id, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0 end as s from sp where rank <= 20 window w as (partition by query_id)),
    h as (select query_id, node_id, round(0.7 * coalesce(d, 0) + (1 - 0.7) * coalesce(s, 0), 6) as score from x full join y using (query_id, node_id)),
    hy as (select *, row_number() over (partition by query_id order by score desc, node_id) as rank from h)
"""


@query(f"with {_HYBRID} select query_id, node_id, score, rank from hy where rank <= 10")
def hybrid_alpha(spark, sf):
    """Dense and sparse scores of the nodes, weighted 0.7 to 0.3 after scaling each to 0..1 within the query. Queries are
    every hundredth node: its embedding, and the first line of its text."""
    fine = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    n = nodes(spark, sf, "text", "embedding").where(fine)
    q, d = n.where("node_no % 100 = 0").withColumn("query_id", F.col("node_no")), n.withColumn("node_id", F.col("node_no"))
    dense = R.dense_top_k(q.select("query_id", F.col("embedding").alias("v")), d.select("node_id", F.col("embedding").alias("v")), 20)
    sparse = R.sparse_text_top_k(q.select("query_id", F.regexp_extract("text", r"^[^\n]*", 0).alias("text")), d.select("node_id", "text"), 20)
    return R.hybrid(dense, sparse, 0.7, 10)


_RRF = """
    u as (select query_id, node_id, rank as seen, 1.0::double / (60 + rank) as part from bm where rank <= 20 union all select query_id, node_id, 1000000000 + rank, 1.0::double / (60 + rank) from sp where rank <= 20),
    f as (select query_id, node_id, round(sum(part), 9) as score, min(seen) as seen from u group by all),
    rr as (select *, row_number() over (partition by query_id order by score desc, seen, node_id) as rank from f)
"""


def _fused(spark, sf, k: int) -> DataFrame:
    return R.rrf([R.bm25_top_k(_doc_queries(spark, sf), _corpus(spark, sf), 20), _sparse(spark, sf, 20)], k)


@query(f"with {_BM25}, {_SPARSE}, {_RRF} select query_id, node_id, score, rank from rr where rank <= 10")
def rrf_fusion(spark, sf):
    return _fused(spark, sf, 10)


_TOP = f"""
    qt as (select doc_id as query_id, list_distinct({_TOK.format(_FIRST)}) as qt from documents where doc_id % 100 = 0 and text is not null),
    dt as (select doc_id as node_id, {_TOK.format('text')} as dt from documents where text is not null),
    o as (select rr.query_id, node_id, rr.rank as r, case when len(qt) > 0 then round(len(list_intersect(qt, dt)) / len(qt), 6) else 0.0 end as score from rr join qt using (query_id) join dt using (node_id) where rr.rank <= 10),
    rk as (select query_id, node_id, score, row_number() over (partition by query_id order by score desc, r, node_id) as rank from o)
"""


@query(f"with {_BM25}, {_SPARSE}, {_RRF}, {_TOP} select query_id, node_id, score, rank from rk where rank <= 5")
def rerank_topn(spark, sf):
    return R.rerank(_fused(spark, sf, 10), _doc_queries(spark, sf), _corpus(spark, sf))


@query(f"""with {_BM25} select query_id, rank as index, node_id, node_id as doc_id, score, case when length(text) > 200 then text[1:200] || '...' else text end as content
    from bm join documents on node_id = doc_id where rank <= 5""")
def source_projection(spark, sf):
    return R.sources(R.bm25_top_k(_doc_queries(spark, sf), _corpus(spark, sf), 5), _corpus(spark, sf))


@query(f"""with {_BM25}, best as (select query_id, min(rank) as r from bm where rank <= 10 and query_id = node_id group by 1),
    qs as (select doc_id as query_id from documents where doc_id % 100 = 0 and text is not null)
    select count(*) as queries, round(avg(case when r is not null then 1.0 else 0.0 end), 6) as hit_rate, round(avg(coalesce(1.0 / r, 0.0)), 6) as mrr from qs left join best using (query_id)""")
def hit_rate_mrr(spark, sf):
    """How well a document is found by its own first line."""
    q = _doc_queries(spark, sf)
    return R.evaluate(R.bm25_top_k(q, _corpus(spark, sf), 10), q.select("query_id", F.col("query_id").alias("node_id")), 10)


@query(f"""with {_DENSE.format('and d.vec_id <> q.vec_id')}, r as (select query_id, max(case when a.label = b.label then 1 else 0 end) as hit, min(case when a.label = b.label then rank end) as r from dn join v a on a.vec_id = query_id join v b on b.vec_id = node_id where rank <= 5 group by 1)
    select count(*) as queries, round(avg(hit), 6) as hit_rate, round(avg(coalesce(1.0 / r, 0.0)), 6) as mrr from r""")
def label_hit_rate(spark, sf):
    """Dense search judged by whether neighbours have the query's label."""
    v = table(spark, sf, "embeddings").select("vec_id", "label")
    hits = R.dense_top_k(_vector_queries(spark, sf), _vectors(spark, sf), 6).where("query_id <> node_id")
    hits = R.top_k(hits.drop("rank"), 5)
    same = hits.join(v.toDF("query_id", "lq"), "query_id").join(v.toDF("node_id", "ln"), "node_id").where("lq = ln")
    per = hits.select("query_id").distinct().join(same.groupBy("query_id").agg(F.min("rank").alias("r")), "query_id", "left")
    return per.agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("r").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


@query(rf"""with {_BM25}, {_SPARSE}, {_RRF}, {_TOP}, fa as (select query_id, max(case when rank = 1 then node_id end) as best, count(*)::int as n from rk where rank <= 5 group by 1)
    select query_id, regexp_replace(regexp_extract(text, '(?s)^\s*(.*?(?:。|[.!?！？](?:\s|$)))', 1), '\s$', '') as answer, n as source_count from fa join documents on doc_id = best""")
def query_answers(spark, sf):
    """Retrieval, fusion, rerank, and an extractive answer with its sources."""
    q, d = _doc_queries(spark, sf), _corpus(spark, sf)
    out = R.answers(R.rerank(_fused(spark, sf, 10), q, d), q, d)
    return out.select("query_id", "answer", F.size("sources").alias("source_count"))


@query()
def encoded_vectors(spark, sf):
    return E.encode(table(spark, sf, "documents"), id_col="doc_id")


@query(f"""
    with w as (select doc_id, term, 1 + ln(count(*)) as weight from (select doc_id, unnest({_TOK.format('text')}) as term from documents where text is not null) group by all)
    select doc_id, count(*) as terms, round(max(weight), 6) as top_weight, min(term) as first_term from w group by 1
""")
def sparse_encoding(spark, sf):
    w = E.sparse_arrays(E.sparse_vectors(table(spark, sf, "documents"), "doc_id"), "doc_id", "term")
    return w.select("doc_id", F.size("indices").cast("long").alias("terms"), F.array_max("values").alias("top_weight"), F.element_at("indices", 1).alias("first_term"))


# -- layout ---------------------------------------------------------------------------------------------------------------

_BOX = """
    li as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity, min(l_shipdate) as l_shipdate, min(l_discount) as l_discount from lineitem group by 1, 2),
    bx as (select l_orderkey // 40 as doc_id, l_linenumber as page, l_orderkey * 10 + l_linenumber as box_id, (l_partkey % 400)::double as x0, (l_partkey % 400 + 20 + l_quantity)::double as x1,
        ((l_orderkey * 7 + l_suppkey * 13) % 700)::double as top, ((l_orderkey * 7 + l_suppkey * 13) % 700 + 8 + l_linenumber * 2)::double as bottom,
        case l_suppkey % 4 when 0 then 'text' when 1 then 'title' when 2 then 'header' else 'table' end as kind, (l_shipdate::varchar)[1:7] as text, l_discount as score from li)
"""
_REGIONS = "rg as (select doc_id, page, box_id, x0 - 30 as x0, x1 + 60 as x1, top - 20 as top, bottom + 40 as bottom, kind from bx)"
_OVER = "greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.bottom, r.bottom) - greatest(l.top, r.top))"


def _boxes(spark, sf) -> DataFrame:
    n = F.col("l_linenumber")
    top, x0 = F.pmod(F.col("l_orderkey") * 7 + F.col("l_suppkey") * 13, F.lit(700)).cast("double"), F.pmod("l_partkey", F.lit(400)).cast("double")
    kind = F.element_at(F.array(*map(F.lit, ("text", "title", "header", "table"))), (F.pmod("l_suppkey", F.lit(4)) + 1).cast("int"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_discount")))
    return lines.select(
        F.floor(F.col("l_orderkey") / 40).alias("doc_id"), n.alias("page"), (F.col("l_orderkey") * 10 + n).alias("box_id"), x0.alias("x0"), (x0 + 20 + F.col("l_quantity")).alias("x1"),
        top.alias("top"), (top + 8 + n * 2).alias("bottom"), kind.alias("kind"), F.substring(F.col("l_shipdate").cast("string"), 1, 7).alias("text"), F.col("l_discount").alias("score"))


def _regions(spark, sf) -> DataFrame:
    """A region around every box."""
    return _boxes(spark, sf).select("doc_id", "page", "box_id", (F.col("x0") - 30).alias("x0"), (F.col("x1") + 60).alias("x1"), (F.col("top") - 20).alias("top"), (F.col("bottom") + 40).alias("bottom"), "kind")


@query(f"with {_BOX}, {_REGIONS}, o as (select l.doc_id, l.page, l.box_id as l_box_id, r.box_id as r_box_id, {_OVER} as shared from bx l join rg r on l.doc_id = r.doc_id and l.page = r.page) select * from o where shared > 0")
def box_overlaps(spark, sf):
    return L.overlapping(_boxes(spark, sf), _regions(spark, sf)).select("doc_id", "page", "l_box_id", "r_box_id", "shared")


@query(f"""with {_BOX}, {_REGIONS}, o as (select l.doc_id, l.page, l.box_id, r.box_id as region_id, r.kind, {_OVER} / ((l.x1 - l.x0) * (l.bottom - l.top)) as share from bx l join rg r on l.doc_id = r.doc_id and l.page = r.page),
    n as (select *, row_number() over (partition by doc_id, page, box_id order by list_position(['footer', 'header', 'reference', 'figure caption', 'table caption', 'title', 'table', 'text', 'figure', 'equation'], kind), share desc, region_id) as n from o where share >= 0.4)
    select doc_id, page, box_id, region_id, kind from n where n = 1""")
def region_assignment(spark, sf):
    return L.assign_regions(_boxes(spark, sf), _regions(spark, sf))


@query(f"""with {_BOX} select doc_id, page, box_id from bx b where kind <> 'header' and not exists (select 1 from (select doc_id, text from bx where kind = 'header' group by all having count(*) > 1) g where g.doc_id = b.doc_id and g.text = b.text)""")
def repeated_furniture(spark, sf):
    return L.drop_repeated_furniture(_boxes(spark, sf)).select("doc_id", "page", "box_id")


@query(f"""with {_BOX}, g as (select *, top - lag(top) over w as gap, ((bottom - top) + lag(bottom - top) over w) / 2 as mean from bx window w as (partition by doc_id, page order by top, x0, box_id)),
    l as (select *, sum(case when gap is null or gap > mean / 3 then 1 else 0 end) over (partition by doc_id, page order by top, x0, box_id) as line from g)
    select doc_id, page, line::bigint as line, min(x0) as x0, max(x1) as x1, min(top) as top, max(bottom) as bottom, string_agg(text, ' ' order by x0, box_id, text) as text from l group by doc_id, page, line""")
def text_lines(spark, sf):
    return L.merge_lines(_boxes(spark, sf))


@query(f"""with {_BOX}, g as (select *, coalesce(top - lag(bottom) over w <= 10 and least(x1, lag(x1) over w) - greatest(x0, lag(x0) over w) >= 0.5 * least(x1 - x0, lag(x1) over w - lag(x0) over w), false) as near from bx window w as (partition by doc_id, page order by top, x0, box_id)),
    l as (select *, sum(case when near then 0 else 1 end) over (partition by doc_id, page order by top, x0, box_id) as region from g)
    select doc_id, page, region::bigint as region, min(x0) as x0, max(x1) as x1, min(top) as top, max(bottom) as bottom, count(*) as parts from l group by doc_id, page, region""")
def formula_regions(spark, sf):
    return L.merge_regions(_boxes(spark, sf))


@query()
def suppressed_boxes(spark, sf):
    return L.suppress(_boxes(spark, sf))


@query("""
    with m as (select distinct node_no as block_no, doc_id, page, section_header from text_nodes where page is not null),
    n as (select block_no, doc_id, page, case when section_header is not null and section_header is distinct from last_value(section_header ignore nulls) over (partition by doc_id order by block_no rows between unbounded preceding and 1 preceding) then section_header end as title from m),
    t as (select *, sum(case when title is not null then 1 else 0 end) over (partition by doc_id order by block_no) as t from n),
    p as (select *, floor((page - min(page) over (partition by doc_id, t)) / 2) as p from t),
    g as (select doc_id, t, p, max(title) as title, min(page) as first_page, max(page) as last_page, count(*) as blocks, min(block_no) as first from p group by doc_id, t, p)
    select doc_id, row_number() over (partition by doc_id order by first) as section, title, first_page, last_page, blocks from g
""")
def page_sections(spark, sf):
    """Every node names its section; the first of each stretch under one name has the title."""
    n = nodes(spark, sf, "doc_id", "page", "section_header").where("page is not null").withColumnRenamed("node_no", "block_no")
    before = F.last("section_header", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1))
    return L.page_sections(n.withColumn("title", F.when(~F.col("section_header").eqNullSafe(before), F.col("section_header"))))


@query(f"""with {_BOX}, {_REGIONS} select doc_id, page, box_id from bx l where not exists (select 1 from rg r where r.doc_id = l.doc_id and r.page = l.page and r.kind = 'table' and {_OVER} > 0.6 * ((l.x1 - l.x0) * (l.bottom - l.top)))""")
def blocks_outside_tables(spark, sf):
    return L.without_contained(_boxes(spark, sf), _regions(spark, sf).where("kind = 'table'")).select("doc_id", "page", "box_id")


@query(f"""with {_BOX} select doc_id, page, box_id from bx l where not exists (select 1 from bx r where r.doc_id = l.doc_id and r.page = l.page and r.kind = l.kind and r.box_id <> l.box_id and {_OVER} > 0
    and {_OVER} >= 0.7 * least((l.x1 - l.x0) * (l.bottom - l.top), (r.x1 - r.x0) * (r.bottom - r.top)) and (r.score > l.score or r.score = l.score and r.box_id < l.box_id))""")
def uncovered_boxes(spark, sf):
    return L.drop_covered(_boxes(spark, sf)).select("doc_id", "page", "box_id")


@query(f"""with {_BOX}, j as (select *, x0 - lag(x0) over w as jump from bx window w as (partition by doc_id, page order by x0, box_id)),
    c as (select *, sum(case when jump > 40 then 1 else 0 end) over (partition by doc_id, page order by x0, box_id rows unbounded preceding) as col from j)
    select doc_id, page, box_id, col::int as col, row_number() over (partition by doc_id, page order by col, floor(top / 10), x0, box_id) as place from c""")
def reading_order(spark, sf):
    b = L.columns(_boxes(spark, sf))
    return L.reading_order(b).join(b.select("doc_id", "page", "box_id", "col"), ["doc_id", "page", "box_id"])


@query(f"""with {_BOX}, p as (select l.doc_id, l.page, l.box_id as caption_id, r.box_id as figure_id, ((l.x0 + l.x1) / 2 - (r.x0 + r.x1) / 2) ** 2 + ((l.top + l.bottom) / 2 - (r.top + r.bottom) / 2) ** 2 as d from bx l join bx r on l.doc_id = r.doc_id and l.page = r.page and l.kind = 'title' and r.kind = 'table'),
    n as (select *, row_number() over (partition by doc_id, page, caption_id order by d, figure_id) as n, min(d) over (partition by doc_id, page, caption_id) as m from p)
    select doc_id, page, caption_id, figure_id from n where n = 1 and m < 10000""")
def nearest_captions(spark, sf):
    """Captions with a table within 100 points of their centre."""
    b = _boxes(spark, sf)
    near = L.nearest_captions(b.where("kind = 'title'"), b.where("kind = 'table'"), 1000.0)
    c = b.select("doc_id", "page", "box_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("top") + F.col("bottom")) / 2).alias("y"))
    both = near.join(c.toDF("doc_id", "page", "caption_id", "xa", "ya"), ["doc_id", "page", "caption_id"]).join(c.toDF("doc_id", "page", "figure_id", "xb", "yb"), ["doc_id", "page", "figure_id"])
    return both.where("(xa - xb) * (xa - xb) + (ya - yb) * (ya - yb) < 10000").select("doc_id", "page", "caption_id", "figure_id")


# -- sheets, records and codes --------------------------------------------------------------------------------------------


@query("""select c_custkey, concat_ws('; ', 'c_name：' || c_name, 'c_mktsegment：' || c_mktsegment, 'c_nationkey：' || c_nationkey) || ' ——customers' as line from customer""")
def sheet_lines(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", K.row_line(["c_name", "c_mktsegment", "c_nationkey"], "customers").alias("line"))


@query("""
    with n as (select *, row_number() over (order by p_partkey) - 1 as n from part)
    select n // 256 as chunk, '<table><caption>parts</caption><tr><th>p_partkey</th><th>p_name</th><th>p_brand</th></tr>' || string_agg('<tr><td>' || p_partkey || '</td><td>' || coalesce(p_name, '') || '</td><td>' || coalesce(p_brand, '') || '</td></tr>', '' order by n) || '</table>' as html from n group by 1
""")
def sheet_html(spark, sf):
    return K.sheet_chunks(table(spark, sf, "part"), "p_partkey", ["p_partkey", "p_name", "p_brand"], "parts")


@query("""
    select n_nationkey::bigint + 100 as code, 'world > ' || r_name || ' > ' || n_name as path from nation join region on n_regionkey = r_regionkey
    union all select r_regionkey::bigint, 'world > ' || r_name from region union all select -1, 'world'
""")
def code_paths(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    codes = r.select(F.col("r_regionkey").cast("long").alias("code"), F.lit(-1).cast("long").alias("parent"), F.col("r_name").alias("name"))
    codes = codes.unionByName(n.select((F.col("n_nationkey").cast("long") + 100).alias("code"), F.col("n_regionkey").cast("long").alias("parent"), F.col("n_name").alias("name")))
    return K.code_paths(codes.unionByName(spark.createDataFrame([(-1, None, "world")], "code long, parent long, name string")))


@query("select blob_id, round((case when coalesce(file_hash, '') <> '' then 1 else 0 end + case when coalesce(doc_id, '') <> '' then 1 else 0 end + case when size is not null then 1 else 0 end + case when coalesce(mime_type, '') <> '' then 1 else 0 end + case when coalesce(domain, '') <> '' then 1 else 0 end) / 5, 6) as filled from blobs")
def record_completeness(spark, sf):
    return table(spark, sf, "blobs").select("blob_id", F.round(K.filled_share(["file_hash", "doc_id", "size", "mime_type", "domain"]), 6).alias("filled"))


@query(r"select p_partkey, unnest(list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[\s,;，；、。./|]+'), lambda w: w <> '' and w <> 'the'))) as keyword from part")
def part_keywords(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(K.keywords(F.concat_ws(" ", "p_name", "p_type"), ("the",))).alias("keyword"))


@query("select event_id, json_extract_string(props, '$.' || list_sort(json_keys(props))[1]) as first_value, list_sort(json_keys(props))[1] as first_key from events where props is not null")
def json_fields(spark, sf):
    e = table(spark, sf, "events").where("props is not null").withColumn("m", F.from_json("props", "map<string,string>"))
    key = F.element_at(F.array_sort(F.map_keys("m")), 1)
    return e.select("event_id", F.element_at("m", key).alias("first_value"), key.alias("first_key"))


@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as events from events where ts is not null group by all")
def windowed_events(spark, sf):
    from leafmill.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, sf, "events"))


@query("""
    with g as (select *, date_diff('day', lag(o_orderdate) over (partition by o_custkey order by o_orderdate), o_orderdate) as gap from orders where o_orderdate is not null)
    select o_custkey, count(*) as entries, min(o_orderdate) as first_time, max(o_orderdate) as last_time, round(avg(gap), 6) as mean_gap, max(gap) as longest_gap, max(o_totalprice) as greatest, date_diff('day', min(o_orderdate), max(o_orderdate)) as days from g group by 1
""")
def record_history(spark, sf):
    return RC.history(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


@query(r"""
    select node_no, regexp_matches(text, '^[ -~\s]*$') as latin, md5(trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) as plain_md5 from (select distinct node_no, text from text_nodes where text is not null)
""")
def plain_text(spark, sf):
    n = nodes(spark, sf, "text").where("text is not null")
    return n.select("node_no", F.col("text").rlike(r"^[ -~\s]*$").alias("latin"), F.md5(RC.without_markup(F.col("text"))).alias("plain_md5"))


@query("select doc_id, avg(case when regexp_matches(coalesce(text, ''), '^[ -~\\s]*$') then 1 else 0 end) > 0.5 as english from (select distinct node_no, doc_id, text from text_nodes) group by 1")
def language_vote(spark, sf):
    return SP.language_vote(nodes(spark, sf, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))))


@query(r"""
    with t as (select distinct node_no, section_header as t, node_no * 37 % 1000 as y, 10.0 + node_no % 9 as font from text_nodes where section_header is not null),
    k as (select *, regexp_matches(t, '(?i)^(chapter\s+\d+|section\s+\d+|lecture\s+\d+|part\s+[ivx]+|table\s+of\s+contents|references|appendix|\d+(\.\d+)*\s+[\w\s]+|[ivx]+\.\s+[\w\s]+)') as opens, regexp_replace(t, '[^A-Za-z]', '', 'g') as letters from t)
    select node_no, length(t) between 2 and 100 and not regexp_matches(t, '^\d+(\s*[-/]\s*\d+)?$') and (opens and y <= 600 and font >= 12 or not opens and length(letters) >= 4 and upper(letters) = letters and y <= 750 and font >= 11 or not opens and font >= 16 and y <= 700) as title from k
""")
def section_titles(spark, sf):
    n = nodes(spark, sf, "section_header").where("section_header is not null")
    y, font = F.pmod(F.col("node_no") * 37, F.lit(1000)).cast("double"), F.lit(10.0) + F.pmod(F.col("node_no"), F.lit(9))
    return n.select("node_no", SP.is_section_title(F.col("section_header"), y, font, F.lit(10.0), F.lit(1000.0)).alias("title"))


@query("select c_custkey, unnest(list_transform(range(1, least(length(c_name), 20) + 1), lambda k: substring(c_name, 1, k))) as prefix from customer")
def name_prefixes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.explode(RC.prefixes(F.col("c_name"))).alias("prefix"))


def _per_row(df: DataFrame, run, schema: str) -> DataFrame:
    """Rows (id, value) from a function of the text that gives a list of strings."""
    import pyarrow as pa

    def work(batches):
        for b in batches:
            yield pa.record_batch({"id": b["id"], "v": pa.array([run(t) for t in b["text"].to_pylist()], pa.list_(pa.string()))})

    return df.mapInArrow(work, "id long, v array<string>").select("id", F.posexplode("v").alias("n", schema))


@query()
def markdown_elements(spark, sf):
    n = nodes(spark, sf, "text").where("text is not null").select(F.col("node_no").alias("id"), "text")
    return _per_row(n, lambda t: [f"{e['kind']}:{e['start']}-{e['end']}" for e in EL.markdown_elements(t)], "element")


@query()
def pulled_tables(spark, sf):
    n = nodes(spark, sf, "text").where(F.col("text").contains("|") | F.lower("text").contains("<table")).select(F.col("node_no").alias("id"), "text")
    return _per_row(n, lambda t: EL.pull_tables(t)[1], "table_text")


@query()
def html_block_chunks(spark, sf):
    n = nodes(spark, sf, "text").where(F.col("text").contains("<")).select(F.col("node_no").alias("id"), "text")
    return _per_row(n, lambda t: EL.pack_blocks(EL.html_blocks(t)), "chunk")


@query()
def json_chunks(spark, sf):
    e = table(spark, sf, "events").where("props is not null").select(F.col("event_id").alias("id"), F.col("props").alias("text"))
    return _per_row(e, EL.json_pieces, "piece")


@query(r"""
    with s as (select doc_id, md5(doc_id::varchar) as h, regexp_extract(text, '^[^.!?。\n]*[.!?。]', 0) as question from documents where text is not null),
    n as (select *, row_number() over (order by h, doc_id) as n from s where question <> '')
    select doc_id, question from n where n <= 100
""")
def question_sample(spark, sf):
    """A hundred documents by the hash of their number, each with its first sentence as a question it answers."""
    s = table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"), F.regexp_extract("text", r"^[^.!?。\n]*[.!?。]", 0).alias("question"))
    return s.where("question <> ''").orderBy("h", "doc_id").limit(100).select("doc_id", "question")


# -- blocks, nodes and fields ---------------------------------------------------------------------------------------------


@query("select node_no, '1-' || len(string_split(text, chr(10))) as line_range from (select distinct node_no, text from text_nodes where text is not null)")
def line_ranges(spark, sf):
    return nodes(spark, sf, "text").where("text is not null").select("node_no", B.line_range(F.col("text")).alias("line_range"))


@query("""
    with b as (select distinct source, domain from blobs)
    select source, domain as given, case when coalesce(domain, '') <> '' then domain when list_has_any(string_split(lower(coalesce(source, '')), '/'), ['http', 'protocol', 'rfc', 'tcp', 'udp', 'ip']) then 'HTTP'
        when list_contains(string_split(lower(coalesce(source, '')), '/'), 'dsp') then 'DSP' end as domain from b
""")
def inferred_domains(spark, sf):
    b = table(spark, sf, "blobs").select("source", "domain").distinct()
    return b.select("source", F.col("domain").alias("given"), B.domain_of_pdf(F.col("domain"), F.col("source")).alias("domain"))


@query("""
    select node_no, md5(concat_ws(chr(10), 'file_name: ' || file_name, 'section_path: ' || section_path, 'page: ' || page) || case when coalesce(file_name, section_path, page::varchar) is null then '' else chr(10) || chr(10) end || coalesce(text, '')) as content_md5
    from (select distinct node_no, file_name, section_path, page, text from text_nodes)
""")
def embed_contents(spark, sf):
    n = nodes(spark, sf, "file_name", "section_path", "page", "text")
    return n.select("node_no", F.md5(B.embed_content(["file_name", "section_path", "page"])).alias("content_md5"))


@query("""
    with v as (select distinct node_no, doc_id, node_id, md5(coalesce(text, '')) as h from text_nodes),
    old as (select node_id, min(h) as h from v where node_no % 3 <> 0 group by 1),
    new as (select node_id, min(case when node_no % 5 = 0 then h || '*' else h end) as h from v where node_no % 7 <> 0 group by 1)
    select node_id, case when old.node_id is null then 'inserted' when new.node_id is null then 'deleted' when old.h = new.h then 'unchanged' else 'updated' end as change from old full join new using (node_id)
""")
def node_changes(spark, sf):
    """Changes by node instead of by file: a stored state against one in which some nodes are new, gone or rewritten."""
    v = nodes(spark, sf, "node_id", "text").withColumn("h", F.md5(F.coalesce("text", F.lit(""))))
    old = v.where("node_no % 3 <> 0").groupBy("node_id").agg(F.min("h").alias("content_hash"))
    new = v.where("node_no % 7 <> 0").withColumn("h", F.when(F.col("node_no") % 5 == 0, F.concat("h", F.lit("*"))).otherwise(F.col("h"))).groupBy("node_id").agg(F.min("h").alias("content_hash"))
    return I.changes(old, new, "node_id")


@query(r"""
    with l as (select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then 'image' when 1 then 'table' else 'formula' end as kind, case when min(l_quantity) > 25 then 'part ' || min(l_partkey) end as answer, 'W_N^{' || min(l_suppkey) || '}' as raw from lineitem group by all),
    c as (select *, case kind when 'image' then coalesce(answer, 'Figure (description unavailable).') when 'table' then coalesce(answer, '') else '$$' || chr(10) || coalesce(answer, raw) || chr(10) || '$$' end as content from l)
    select l_orderkey * 10 + l_linenumber as block_id, kind, '[IMAGE_BLOCK_' || (l_orderkey * 10 + l_linenumber) || ']' || case when content = '' then '' else chr(10) || content end as text from c
""")
def resolved_blocks(spark, sf):
    """Answers of models put behind the place marks of their blocks, half of which have none."""
    key, n = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block_id"), F.col("l_linenumber") % 3
    line = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_quantity", "l_partkey", "l_suppkey")))
    items = line.select(key, F.when(n == 0, "image").when(n == 1, "table").otherwise("formula").alias("kind"), F.concat(F.lit("W_N^{"), F.col("l_suppkey"), F.lit("}")).alias("raw_text"))
    results = line.where("l_quantity > 25").select(key, F.concat(F.lit("part "), F.col("l_partkey")).alias("answer"))
    return B.resolve_blocks(items, results).select("block_id", "kind", "text")


@query(r"""
    select p_partkey, length(trim(p_brand)) < 3 or p_size / 50 < 0.85 as refined, '$$' || chr(10) || case when length(trim(p_brand)) < 3 or p_size / 50 < 0.85 then '\mathrm{' || p_brand || '}' else p_brand end || chr(10) || '$$' as text from part
""")
def formula_readings(spark, sf):
    """Readings of formulas with a score; unsure ones are read again."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("latex"), (F.col("p_size") / 50).alias("score"))
    return B.read_formulas(p, lambda c: F.concat(F.lit("\\mathrm{"), c, F.lit("}"))).select("p_partkey", "refined", "text")


@query(r"""
    select node_no, regexp_matches(text, '\b([A-Za-z]\s){2,}[A-Za-z]\b') or contains(text, '[IMAGE_BLOCK_') as needed from (select distinct node_no, text from text_nodes where text is not null)
""")
def polish_needed(spark, sf):
    return nodes(spark, sf, "text").where("text is not null").select("node_no", B.needs_polish(F.col("text")).alias("needed"))


@query("""
    with s as (select l_orderkey, l_linenumber as n, l_suppkey % 4 as c, l_discount as p, lag(l_suppkey % 4) over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_discount, l_quantity) as b, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_discount, l_quantity) as k from lineitem),
    kept as (select * from s where c <> 0 and c is distinct from b)
    select o.l_orderkey, coalesce(string_agg('abc'[c], '' order by k), '') as text, round(coalesce(avg(p), 0.0), 6) as confidence from (select distinct l_orderkey from lineitem) o left join kept using (l_orderkey) group by 1
""")
def ctc_lines(spark, sf):
    """Best classes of each step, an order's lines, decoded: repeats once, blanks not."""
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_discount", "l_quantity")))
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(steps.alias("x")).select("l_orderkey", F.transform("x", lambda x: F.pmod(x["l_suppkey"], F.lit(4))).alias("c"), F.col("x.l_discount").alias("p"))
    text, sure = B.ctc_text(F.col("c"), F.col("p"), "abc")
    return o.select("l_orderkey", text.alias("text"), F.round(sure, 6).alias("confidence"))


@query("""
    with c as (select r_regionkey as t, n_nationkey // 5 as row, n_nationkey % 5 as col, n_name as text, n_nationkey < 5 as header from nation join region on true where n_nationkey % 7 <> r_regionkey),
    g as (select t, row, col, g.text, g.header from c g), w as (select t, count(distinct col) as w from g group by 1),
    x as (select t, row, dense_rank() over (partition by t order by col) as place, text, header from g),
    h as (select t, row, sum(header::int) * 2 > count(*) as h from x group by all),
    l as (select h.t, h.row, string_agg(case when h then '<th>' else '<td>' end || coalesce(x.text, '') || case when h then '</th>' else '</td>' end, '' order by k) as tr from h join w using (t) cross join lateral unnest(range(1, w + 1)) as u(k) left join x on x.t = h.t and x.row = h.row and x.place = k group by all)
    select t, '<table>' || string_agg('<tr>' || tr || '</tr>', '' order by row) || '</table>' as html from l group by 1
""")
def tables_as_html(spark, sf):
    """Recognised cells, with gaps, as tables: one for each region."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    cells = n.join(F.broadcast(r.select("r_regionkey")), n["n_nationkey"] % 7 != r["r_regionkey"])
    c = cells.select(F.col("r_regionkey").alias("t"), F.floor(F.col("n_nationkey") / 5).alias("row"), (F.col("n_nationkey") % 5).alias("col"), F.col("n_name").alias("text"), (F.col("n_nationkey") < 5).alias("header"))
    return B.tables_as_html(c, ["t"])


@query("select event_id, coalesce(json_extract_string(props, '$.k'), '') as k, event_type as kind, case when coalesce(json_extract_string(props, '$.missing'), '') <> '' then json_extract_string(props, '$.missing') else json_extract_string(props, '$.k') end as either from events")
def flat_fields(spark, sf):
    e = B.flatten(table(spark, sf, "events"), "props", {"k": "k", "either": "missing"}, fallback={"either": "k"})
    return e.select("event_id", F.coalesce("k", F.lit("")).alias("k"), F.col("event_type").alias("kind"), "either")


@query("""
    select p_partkey, p_size::int as token, round(p_retailprice::float::double, 3) as weight from part where p_retailprice <> 0 and p_size is not null
""")
def lexical_weights(spark, sf):
    """Weights as texts, with what is no number or zero among them."""
    m = F.create_map(F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.lit("word"), F.lit("1.0"), F.lit("-1"), F.lit("0"), F.lit("-2"), F.lit("none"))
    p = table(spark, sf, "part").where("p_size is not null").select("p_partkey", F.explode(B.lexical_items(m)).alias("token", "weight"))
    return p.select("p_partkey", "token", F.round(F.col("weight").cast("double"), 3).alias("weight"))


_TRIM = r"[\s\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+"
_STRIPPED = f"regexp_replace(line, '^{_TRIM}|{_TRIM}$', '', 'g')".replace("{{", "{").replace("}}", "}")

SQL["merged_lines"] = rf"""
    with t as (select node_no, {_CLEAN.format('text')} as text from (select distinct node_no, text from text_nodes where text is not null)),
    l as (select node_no, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from t),
    s as (select *, {_STRIPPED} as s from l),
    c as (select *, greatest(30, least(200, floor(floor(median(case when length(s) > 0 then length(s) end) over (partition by node_no)) * 7 / 10))) as most, starts_with(s, '```') as fence,
        sum(case when starts_with(s, '```') then 1 else 0 end) over (partition by node_no order by i) as fences from s),
    k as (select *, not fence and fences % 2 = 0 and s <> '' and not regexp_matches(s, '^([0-9]+\.|[-*+•])\s') and not starts_with(s, '|') and not (regexp_matches(s, '^第[一二三四五六七八九十0-9]+章')
        or length(s) > 3 and regexp_matches(s, '\p{{Lu}}') and not regexp_matches(s, '[\p{{Ll}}\p{{Lt}}]') or regexp_matches(s, '^[IVXLCDM]+\.\s') or regexp_matches(s, '^#+\s')
        or length(s) < 50 and regexp_matches(s, '^[0-9]+(\.[0-9]+)*\s') or length(s) < 30 and regexp_matches(s, '^[A-Z]')
        or length(s) <= 25 and regexp_matches(s, '[一-鿿]') and regexp_matches(s, '^(章|节|部分|小结|概述|前言|后记|目录|摘要)|(章|节|部分|小结|概述|前言|后记|目录|摘要) ')
        or length(s) <= 25 and regexp_matches(s, '[一-鿿]') and regexp_matches(s, '(主要|功能|特性|方法|结果|讨论|结论)( |$)') and not regexp_matches(s, '[。！？，、；：]')) as prose from c),
    j as (select *, coalesce(prose and lag(prose) over w and (lag(s) over w like '%-' or length(s) < most and not regexp_matches(lag(s) over w, '[。.!?！？：;；:]$')), false) as joins from k window w as (partition by node_no order by i))
    select node_no, sum(case when not joins then 1 else 0 end)::bigint as kept_lines, sum(case when joins then 1 else 0 end)::bigint as joined_lines from j group by node_no
"""
