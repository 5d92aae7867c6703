"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from leafmill.llm.canonical import canonical_texts, look_alike_groups, look_alike_pairs
from leafmill.llm.encoding import may_be_garbled, restore_encoding
from leafmill.llm.markup import may_have_markup, strip_markup
from leafmill.llm.mixing import mix, report
from leafmill.llm.near_dup import near_duplicate_groups, near_duplicate_pairs
from leafmill.llm.packing import fill, pack_items
from leafmill.llm.scan_noise import repair_scans
from leafmill.llm.split import limit_of, split_oversized
from leafmill.llm.tokens import token_sizes
from leafmill.llm.vector_knn import nearest_vectors
from leafmill.operators.retrieve import dense_top_k
from leafmill.tables import cut, table


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return strip_markup(table(spark, sf, "text_nodes").where(may_have_markup(F.col("text")))).where("pieces > 0")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("node_no").distinct()


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).dropDuplicates(["node_no"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf, "text_nodes"))
    return pieces.where("pieces > 1").select("node_no").distinct()


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf, "text_nodes"))
    return pieces.dropDuplicates(["node_no", "piece"])


def _garbled(spark: SparkSession, sf: str) -> DataFrame:
    return restore_encoding(table(spark, sf, "text_nodes").where(may_be_garbled(F.col("text")))).where("garbled")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).select("node_no").distinct()


def p3_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).dropDuplicates(["node_no"]).select("node_no", "restored", "confidence")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf, "text_nodes")).select("node_a", "node_b")


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf, "text_nodes"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    near = nearest_vectors(table(spark, sf, "text_nodes"))
    return near.select(F.least("id", "neighbour").alias("node_a"), F.greatest("id", "neighbour").alias("node_b")).distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return repair_scans(table(spark, sf, "text_nodes")).where("furniture + joined + confusions > 0").select("node_no").distinct()


def p7_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return repair_scans(table(spark, sf, "text_nodes")).dropDuplicates(["node_no"])


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return token_sizes(table(spark, sf, "documents"), "doc_id", "source").withColumnRenamed("doc_id", "id")


MOST_CAPACITIES = 10_000


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    capacities = [(r["pack_id"], r["capacity_tokens"]) for r in table(spark, sf, "pack_sizes").orderBy("pack_id").limit(MOST_CAPACITIES + 1).collect()]
    if len(capacities) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    return pack_items(_sizes(spark, sf).drop("source"), capacities, table(spark, sf, "documents").count())


def p8_packs(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill(_packed(spark, sf))


def _mixed(spark: SparkSession, sf: str):
    sizes = cut(_sizes(spark, sf).dropDuplicates(["id"]))
    return mix(sizes, table(spark, sf, "mix_targets"), table(spark, sf, "documents").count())


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    mixed, shares = _mixed(spark, sf)
    return report(mixed, table(spark, sf, "mix_targets"), shares)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf, "documents")).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p10_groups(spark: SparkSession, sf: str) -> DataFrame:
    return look_alike_groups(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def p10_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_texts(table(spark, sf, "documents")).select(F.col("id").alias("doc_id"), "canonical")


def p2_rejoined(spark: SparkSession, sf: str) -> DataFrame:
    """(node_no, text_md5, kept): what the new parts of the pieces make together, and whether limit and overlap are kept."""
    limits = table(spark, sf, "text_nodes").select("node_no", limit_of(F.col("section_header"), 2048, 1536).alias("limit")).dropDuplicates(["node_no"])
    p = p2_pieces(spark, sf).join(limits, "node_no")
    new = F.substring("piece_text", F.col("fresh") - F.col("start") + 1, F.lit(2**31 - 1))
    parts = F.array_sort(F.collect_list(F.struct("piece", new.alias("t"))))
    fine = (F.length("piece_text") <= F.col("limit")) & (F.col("fresh") - F.col("start") <= 400) & (F.length("piece_text") > 0)
    return p.groupBy("node_no").agg(F.md5(F.array_join(F.transform(parts, lambda x: x["t"]), "")).alias("text_md5"), F.every(fine).alias("kept"))


def p6_recall(spark: SparkSession, sf: str) -> DataFrame:
    """(queries, recall, enough): the share of the five nearest by brute force that the index finds, over every hundredth node."""
    n = table(spark, sf, "text_nodes").select("node_no", "embedding").where(F.size("embedding") == 64).dropDuplicates(["node_no"])
    exact = dense_top_k(n.where("node_no % 100 = 0").select(F.col("node_no").alias("query_id"), F.col("embedding").alias("v")), n.select(F.col("node_no").alias("node_id"), F.col("embedding").alias("v")), 6)
    w = Window.partitionBy("query_id").orderBy("rank")
    exact = exact.where("query_id <> node_id").withColumn("r", F.row_number().over(w)).where("r <= 5").select("query_id", "node_id", F.round("score", 5).alias("s"))
    found = nearest_vectors(table(spark, sf, "text_nodes")).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.round("cosine", 5).alias("s"), F.row_number().over(Window.partitionBy("id").orderBy("rank")).alias("r"))
    least = exact.groupBy("query_id").agg(F.min("s").alias("least"), F.count("*").alias("n"))  # equal neighbours stand for each other
    hit = least.join(found, "query_id", "left").groupBy("query_id", "n").agg(F.sum((F.col("s") >= F.col("least") - 1e-5).cast("int")).alias("h"))
    out = hit.agg(F.count("*").alias("queries"), (F.sum(F.least(F.coalesce("h", F.lit(0)), "n")) / F.sum("n")).alias("recall"))
    return out.select("queries", (F.col("recall") >= 0.9).alias("enough"))


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """(pack_id, documents, whole, overfull): documents packed, whether each has all its parts once, containers above capacity."""
    p = cut(_packed(spark, sf))
    docs = p.groupBy("pack_id", "id").agg(F.count("*").alias("n"), F.countDistinct("part").alias("d"), (F.max("part") + 1).alias("m")).groupBy("pack_id").agg(F.count("*").alias("documents"), F.every((F.col("n") == F.col("d")) & (F.col("n") == F.col("m"))).alias("whole"))
    over = p.groupBy("pack_id", "capacity", "container").agg(F.sum("tokens").alias("t")).groupBy("pack_id").agg(F.sum((F.col("t") > F.col("capacity")).cast("long")).alias("overfull"))
    return docs.join(over, "pack_id")


def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """(source, cap_kept, share_kept): whether no document of a listed source is used more often than its cap allows, and whether
    the source misses its share by a document at most."""
    mixed, shares = _mixed(spark, sf)
    mixed = cut(mixed)
    used = mixed.groupBy("source", "id").agg(F.count("*").alias("n"), F.max("tokens").alias("t")).groupBy("source").agg(F.max("n").alias("most"), F.max("t").alias("longest"))
    got = report(mixed, table(spark, sf, "mix_targets"), shares).join(used, "source", "left")
    whole = mixed.agg(F.sum("tokens").alias("all"))
    longest = mixed.agg(F.max("tokens").alias("any"))
    caps = table(spark, sf, "mix_targets").select("source", "max_repeats")
    near = F.abs(F.col("actual_share") - F.col("reachable_share")) * F.col("all") <= F.coalesce("longest", F.lit(0)) + F.col("any")
    return got.join(caps, "source").join(F.broadcast(whole)).join(F.broadcast(longest)).select("source", F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("cap_kept"), F.coalesce(near, F.lit(True)).alias("share_kept"))


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_restored": p3_restored, "p4_found": p4_found, "p4_groups": p4_groups, "p6_found": p6_found, "p7_found": p7_found, "p7_repaired": p7_repaired, "p8_packs": p8_packs, "p8_fill": p8_fill, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_canonical": p10_canonical, "p10_groups": p10_groups, "p2_rejoined": p2_rejoined, "p6_recall": p6_recall, "p8_kept": p8_kept, "p9_kept": p9_kept}

SQL = {
    "p2_rejoined": """
        select distinct node_no, md5(text) as text_md5, true as kept from text_nodes where length(text) > case when lower(section_header) like '%table%' then 1536 else 2048 end
    """,
    "p6_recall": """
        select count(distinct node_no) as queries, true as enough from text_nodes where node_no % 100 = 0 and len(embedding) = 64
            and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
    """,
    "p8_kept": "select pack_id, (select count(distinct doc_id) from documents) as documents, true as whole, 0::bigint as overfull from pack_sizes",
    "p9_kept": "select source, true as cap_kept, true as share_kept from mix_targets",
    "p2_found": """
        select distinct node_no from text_nodes
        where length(text) > case when lower(section_header) like '%table%' then 1536 else 2048 end
    """,
    "p4_groups": r"""
        with recursive n as (select distinct node_no, text from text_nodes where text is not null),
        w as (select node_no, text, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '') as w from n),
        c as (select node_no, min(node_no) over (partition by text) as class, w from w where len(w) >= 40),
        r as (select node_no, w from c where node_no = class),
        g as (select distinct node_no, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from r),
        s as (select node_no, count(*) as n from g group by node_no),
        o as (select a.node_no as a, b.node_no as b, count(*) as o from g a join g b on a.g = b.g and a.node_no <> b.node_no group by all),
        e as (select a, b from o join s x on x.node_no = a join s y on y.node_no = b where 2 * o >= x.n + y.n - o),
        t as (select node_no as id, node_no as to_ from r union select t.id, e.b from t join e on e.a = t.to_)
        select node_no, class, coalesce((select min(to_) from t where t.id = class), class) as "group", (select count(*) from e where e.a = class) as links from c
    """,
    "p4_found": r"""
        with n as (select distinct node_no, text from text_nodes where text is not null),
        w as (select node_no, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '') as w from n),
        g as (select distinct node_no, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) >= 40),
        s as (select node_no, count(*) as n from g group by node_no),
        o as (select a.node_no as node_a, b.node_no as node_b, count(*) as o from g a join g b on a.g = b.g and a.node_no < b.node_no group by all)
        select node_a, node_b from o join s x on x.node_no = node_a join s y on y.node_no = node_b where 2 * o >= x.n + y.n - o
    """,
}
