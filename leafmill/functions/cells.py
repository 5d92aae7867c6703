"""Rows of sheets and records as text, dates and codes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.tables import cut


def row_line(columns: list[str], sheet: str | None = None) -> Column:
    """``header：value`` of the cells that hold something, joined by semicolons; the sheet's name follows unless it is a
    plain "sheet"."""
    parts = F.filter(F.array(*(F.struct(F.lit(c).alias("h"), F.col(c).cast("string").alias("v")) for c in columns)), lambda x: x["v"].isNotNull() & (x["v"] != ""))
    line = F.array_join(F.transform(parts, lambda x: F.concat(x["h"], F.lit("："), x["v"])), "; ")
    return line if sheet is None or "sheet" in sheet.lower() else F.concat(line, F.lit(f" ——{sheet}"))


def sheet_chunks(df: DataFrame, order: str, columns: list[str], caption: str, rows: int = 256) -> DataFrame:
    """(chunk, html): tables of `rows` rows each with the caption and the header repeated. The row numbers come from sorted
    partitions and their sizes, so no task sees the whole sheet."""
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>"))
    tr = F.concat(F.lit("<tr>"), *(cell(c) for c in columns), F.lit("</tr>"))
    head = f"<table><caption>{caption}</caption><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    n = numbered(df, order)
    lines = F.array_sort(F.collect_list(F.struct("__n", tr.alias("r"))))
    return n.withColumn("chunk", F.floor(F.col("__n") / rows)).groupBy("chunk").agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["r"]), ""), F.lit("</table>")).alias("html"))


def numbered(df: DataFrame, order: str, name: str = "__n", per_part: int = 100_000) -> DataFrame:
    """The rows numbered from 0 in the order of a numeric column of distinct values: ranges of about `per_part` rows are
    counted first, then each range numbers its own rows. Null values come first."""
    parts = min(10_000, max(1, -(-df.count() // per_part)))
    bounds = sorted(set(df.approxQuantile(order, [k / parts for k in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    ends = F.array(*(F.lit(float(b)) for b in bounds)) if bounds else F.array().cast("array<double>")
    part = F.size(F.filter(ends, lambda b: F.col(order) >= b))
    cut = df.withColumn("__p", part)
    before = cut.groupBy("__p").count().withColumn("__b", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1
    return cut.withColumn("__i", inside).join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__b", "__i")


def filled_share(columns: list[str]) -> Column:
    """The share of columns that are neither null nor empty."""
    return sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in columns), F.lit(0)) / F.lit(len(columns))


def keywords(text: Column, drop: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words between punctuation and white space, in order of first occurrence."""
    words = F.filter(F.split(F.lower(text), r"[\s,;，；、。./|]+"), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, drop))) if drop else F.array_distinct(words)


def code_paths(codes: DataFrame, most: int = 64) -> DataFrame:
    """(code, path): names from the root of a table (code, parent, name) down to each code, by repeated joins as deep as there
    are codes. Codes in a circle have no root and are left out; more than `most` levels are an error."""
    at = cut(codes.where("parent is null").select("code", F.col("name").alias("path")))
    out = at
    for _ in range(most):
        p = at.select(F.col("code").alias("parent"), F.col("path").alias("above"))
        at = cut(codes.join(p, "parent").select("code", F.concat_ws(" > ", "above", "name").alias("path")))
        if at.isEmpty():
            return out
        out = out.unionByName(at)
    raise ValueError(f"codes of more than {most} levels")
