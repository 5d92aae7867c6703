"""Nested records: flattening, lists in time, names and numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def field(json: Column, *path: str) -> Column:
    """A value from JSON text by its path; null where the path or the text is broken."""
    return F.get_json_object(json, "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path))


def latest_first(items: Column, time: str) -> Column:
    """An array of structs by a time field, latest first, those without a time last."""
    return F.reverse(F.array_sort(F.transform(items, lambda x: F.struct(x[time].alias("t"), x.alias("x")))))


def spans_in_time(items: Column, start: str, end: str, now: Column) -> Column:
    """Days of each item, an open one until `now`; without a start, and where the end comes first, null."""
    days = lambda x: F.datediff(F.coalesce(x[end], now), x[start])
    return F.transform(items, lambda x: F.when(days(x) >= 0, days(x)))


def history(records: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, entries, first_time, last_time, days, mean_gap, longest_gap, greatest): a key's rows as one history."""
    from pyspark.sql import Window

    gap = F.datediff(F.col(time), F.lag(time).over(Window.partitionBy(key).orderBy(time)))
    g = records.where(F.col(time).isNotNull()).withColumn("gap", gap)
    out = g.groupBy(key).agg(F.count("*").alias("entries"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.max("gap").alias("longest_gap"), F.max(value).alias("greatest"))
    return out.withColumn("days", F.datediff("last_time", "first_time"))


def combined_tags(*lists: Column) -> Column:
    """Every tag of the first list with every tag of the second, and so on; an empty list takes no part."""
    out = lists[0]
    for b in lists[1:]:
        pairs = F.flatten(F.transform(out, lambda x: F.transform(b, lambda y: F.concat(x, y))))  # noqa: B023
        out = F.when(F.size(b) == 0, out).when(F.size(out) == 0, b).otherwise(pairs)
    return out


def company_name(name: Column) -> Column:
    """A name in lower case with plain characters for full-width ones, without what stands in brackets, punctuation and the
    words for the kind of company."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    s = F.translate(name, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))
    s = F.regexp_replace(F.lower(s), r"\([^)]*\)|\[[^\]]*\]", "")
    s = F.regexp_replace(s, r"(股份有限公司|有限责任公司|有限公司|集团|公司|\b(inc|ltd|llc|corp|co|gmbh|company|limited|corporation)\b\.?)", "")
    return F.trim(F.regexp_replace(s, r"[\s\p{P}\p{S}]+", " "))


def phone(text: Column) -> Column:
    """The eleven figures of a mobile number, the country code left out; null without one."""
    s = F.regexp_replace(F.regexp_replace(text, r"[^0-9]", ""), r"^(0*86)(?=1[0-9]{10}$)", "")
    found = F.regexp_extract(s, r"(1[3-9][0-9]{9})", 1)
    return F.when(found != "", found)


def email(text: Column) -> Column:
    found = F.lower(F.regexp_extract(text, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+)", 1))
    return F.when(found != "", found)


def prefixes(text: Column, most: int = 20) -> Column:
    """All beginnings of a text, from one character up to `most`."""
    n = F.least(F.length(text), F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(text, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def without_markup(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"\s+", " "))
