"""Boxes on pages: overlaps, assignment to layout regions, suppression, lines and reading order.

Boxes are rows (doc_id, page, box_id, x0, x1, top, bottom, ...). Pairs are only formed within a page and within the same or
neighbouring horizontal bands, so a page with many boxes is spread over its bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafmill.operators.runs import SIZE, join_safe, running

PAGE = ["doc_id", "page"]
# Layout types in the order in which they claim boxes.
PRIORITY = ["footer", "header", "reference", "figure caption", "table caption", "title", "table", "text", "figure", "equation"]


def area(p: str = "") -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{p}x1") - F.col(f"{p}x0")) * F.greatest(F.lit(0.0), F.col(f"{p}bottom") - F.col(f"{p}top"))


def overlap(a: str, b: str) -> Column:
    """The area that two boxes of column prefixes a and b share."""
    w = F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0"))
    h = F.least(F.col(f"{a}bottom"), F.col(f"{b}bottom")) - F.greatest(F.col(f"{a}top"), F.col(f"{b}top"))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def _bands(boxes: DataFrame, prefix: str, band: float) -> DataFrame:
    named = boxes.select(*PAGE, *(F.col(c).alias(f"{prefix}{c}") for c in boxes.columns if c not in PAGE))
    first, last = F.floor(F.col(f"{prefix}top") / band), F.floor(F.col(f"{prefix}bottom") / band)
    return named.where(F.col(f"{prefix}bottom") >= F.col(f"{prefix}top")).withColumn("band", F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, band: float = 100.0) -> DataFrame:
    """All pairs of boxes of one page that share some area, columns prefixed l_ and r_, with shared (the area)."""
    pairs = _bands(left, "l_", band).join(_bands(right, "r_", band), [*PAGE, "band"])
    # a pair meets in every band that both touch; it counts in the first of them
    first = F.greatest(F.floor(F.col("l_top") / band), F.floor(F.col("r_top") / band))
    return pairs.where(F.col("band") == first).withColumn("shared", overlap("l_", "r_")).where("shared > 0").drop("band")


def assign_regions(boxes: DataFrame, regions: DataFrame, least: float = 0.4) -> DataFrame:
    """(doc_id, page, box_id, region_id, kind): for every box the region of the first kind by priority that covers at least
    `least` of it, of one kind the one that covers most; boxes of no region are left out."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(PRIORITY) for x in (k, i)))
    hit = overlapping(boxes, regions).withColumn("share", F.col("shared") / area("l_")).where(F.col("share") >= least)
    w = Window.partitionBy(*PAGE, "l_box_id").orderBy(F.coalesce(F.element_at(order, F.col("r_kind")), F.lit(99)), F.desc("share"), "r_box_id")
    return hit.withColumn("n", F.row_number().over(w)).where("n = 1").select(*PAGE, F.col("l_box_id").alias("box_id"), F.col("r_box_id").alias("region_id"), F.col("r_kind").alias("kind"))


def drop_repeated_furniture(boxes: DataFrame, kinds: tuple[str, ...] = ("header", "footer", "reference")) -> DataFrame:
    """Without boxes of the given kinds, and without any whose text occurs more than once among those of a document."""
    gone = boxes.where(F.col("kind").isin(*kinds)).groupBy("doc_id", "text").count().where("count > 1")
    return boxes.where(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).join(gone.select("doc_id", "text"), ["doc_id", "text"], "left_anti")


def suppress(boxes: DataFrame, threshold: float = 0.45, plus: float = 1.0, parts: int | None = None) -> DataFrame:
    """Greedy suppression per page and kind: best score first, a box stays unless it overlaps a kept one by more than the
    threshold of their union. Areas count `plus` pixels more on each side. Equal scores go to the smaller box_id. Pages and
    kinds are worked on in `parts` groups of many, by default as many as make about 50,000 boxes each."""
    import numpy as np
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        """Many pages and kinds at once: their groups are stretches of the rows sorted by group and score."""
        x0, x1, y0, y1, s, i, g = (t[c].to_numpy() for c in ("x0", "x1", "top", "bottom", "score", "box_id", "g"))
        size, order, keep = (x1 - x0 + plus) * (y1 - y0 + plus), np.lexsort((i, -s, g)), []
        cuts = np.flatnonzero(np.diff(g[order])) + 1
        for left in np.split(order, cuts) if len(order) else ():
            while len(left):
                k, left = left[0], left[1:]
                keep.append(k)
                if len(left):
                    w = np.maximum(0, np.minimum(x1[k], x1[left]) - np.maximum(x0[k], x0[left]) + plus)
                    h = np.maximum(0, np.minimum(y1[k], y1[left]) - np.maximum(y0[k], y0[left]) + plus)
                    left = left[w * h <= threshold * (size[k] + size[left] - w * h)]
        return t.select([c for c in t.column_names if c not in ("g", "part")]).take(pa.array(sorted(keep), pa.int64()))

    kinds = dict(boxes.dtypes)
    cols = [*PAGE, "box_id", "kind", "x0", "x1", "top", "bottom", "score"]
    typed = boxes.select(*PAGE, "box_id", "kind", *(F.col(c).cast("double").alias(c) for c in cols[4:])).withColumn("g", F.xxhash64(*PAGE, "kind"))
    parts = parts or max(1, -(-boxes.count() // 50_000))
    part = F.pmod("g", F.lit(parts)).cast("int")
    return typed.withColumn("part", part).groupBy("part").applyInArrow(run, ", ".join(f"{c} {kinds[c] if c in cols[:4] else 'double'}" for c in cols))


def merge_lines(boxes: DataFrame, share: float = 1 / 3) -> DataFrame:
    """(doc_id, page, line, x0, x1, top, bottom, text): boxes from top to bottom whose tops are within a share of the mean
    height of the two make one line; its text goes from left to right."""
    w = Window.partitionBy(*PAGE).orderBy("top", "x0", "box_id")
    height = F.col("bottom") - F.col("top")
    gap = F.col("top") - F.lag("top").over(w)
    mean = (height + F.lag(height).over(w)) / 2
    line = F.sum(F.when(gap.isNull() | (gap > share * mean), 1).otherwise(0)).over(w)
    parts = F.array_sort(F.collect_list(F.struct("x0", "box_id", "text")))
    return boxes.withColumn("line", line).groupBy(*PAGE, "line").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def merge_regions(regions: DataFrame, most_gap: float = 10.0, least_overlap: float = 0.5) -> DataFrame:
    """(doc_id, page, region, x0, x1, top, bottom, parts): neighbours from top to bottom become one region where the gap
    is small and the narrower one overlaps the other sideways."""
    w = Window.partitionBy(*PAGE).orderBy("top", "x0", "box_id")
    before = {c: F.lag(c).over(w) for c in ("x0", "x1", "bottom")}
    side = F.least(F.col("x1"), before["x1"]) - F.greatest(F.col("x0"), before["x0"])
    near = (F.col("top") - before["bottom"] <= most_gap) & (side >= least_overlap * F.least(F.col("x1") - F.col("x0"), before["x1"] - before["x0"]))
    n = F.sum(F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).over(w)
    return regions.withColumn("region", n).groupBy(*PAGE, "region").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count("*").alias("parts"))


def page_sections(pages: DataFrame, most_pages: int = 2, size: int = SIZE) -> DataFrame:
    """(doc_id, section, title, first_page, last_page, blocks): blocks (doc_id, block_no, page, title or null) in order; a
    title starts a section, and so does a page that would make it span `most_pages` or more. Long documents are worked on in
    stretches of `size` blocks."""
    titled = running(pages.where("block_no is not null"), ["doc_id"], "block_no", {"t": ("sum", F.when(F.col("title").isNotNull(), 1).otherwise(0))}, size=size)
    start = titled.groupBy("doc_id", "t").agg(F.min("page").alias("start"))
    cut = join_safe(titled, start, ["doc_id", "t"]).withColumn("p", F.floor((F.col("page") - F.col("start")) / most_pages))
    parts = cut.groupBy("doc_id", "t", "p").agg(F.max("title").alias("title"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("blocks"), F.min("block_no").alias("first"))
    return running(parts, ["doc_id"], "first", {"section": ("sum", F.lit(1))}, size=size).select("doc_id", F.col("section").cast("int").alias("section"), "title", "first_page", "last_page", "blocks")


def without_contained(blocks: DataFrame, tables: DataFrame, share: float = 0.6) -> DataFrame:
    """The blocks of which no table covers more than the share."""
    inside = overlapping(blocks, tables).where(F.col("shared") > share * area("l_")).select(*PAGE, F.col("l_box_id").alias("box_id")).distinct()
    return blocks.join(inside, [*PAGE, "box_id"], "left_anti")


def drop_covered(boxes: DataFrame, share: float = 0.7) -> DataFrame:
    """Without every box that another one of its kind overlaps by the share of either and beats: by score, then by box_id."""
    pairs = overlapping(boxes, boxes).where("l_box_id <> r_box_id and l_kind = r_kind")
    near = F.col("shared") >= share * F.least(area("l_"), area("r_"))
    beaten = (F.col("r_score") > F.col("l_score")) | ((F.col("r_score") == F.col("l_score")) & (F.col("r_box_id") < F.col("l_box_id")))
    gone = pairs.where(near & beaten).select(*PAGE, F.col("l_box_id").alias("box_id")).distinct()
    return boxes.join(gone, [*PAGE, "box_id"], "left_anti")


def reading_order(boxes: DataFrame, step: float = 10.0) -> DataFrame:
    """(doc_id, page, box_id, place): by column, then from top to bottom in steps, then from the left."""
    w = Window.partitionBy(*PAGE).orderBy("col", F.floor(F.col("top") / step), "x0", "box_id")
    return boxes.select(*PAGE, "box_id", F.row_number().over(w).alias("place"))


def columns(boxes: DataFrame, gap: float = 40.0, most: int | None = None) -> DataFrame:
    """The boxes with col, from 0: sorted by their left edge, a gap to the next edge starts a column. Where `most` is given,
    what is beyond as many columns belongs to the last."""
    w = Window.partitionBy(*PAGE).orderBy("x0", "box_id")
    jump = F.col("x0") - F.lag("x0").over(w)
    n = F.sum(F.when(jump > gap, 1).otherwise(0)).over(w)
    return boxes.withColumn("col", (n if most is None else F.least(n, F.lit(most - 1))).cast("int"))


def nearest_captions(captions: DataFrame, figures: DataFrame, reach: float = 200.0) -> DataFrame:
    """(doc_id, page, caption_id, figure_id): for every caption the figure or table of its page whose centre is nearest,
    within a reach from top to bottom."""
    centre = lambda p, a, b: (F.col(f"{p}{a}") + F.col(f"{p}{b}")) / 2
    near = figures.withColumns({"top": F.col("top") - reach, "bottom": F.col("bottom") + reach})
    pairs = _bands(captions, "l_", reach).join(_bands(near, "r_", reach), [*PAGE, "band"]).dropDuplicates([*PAGE, "l_box_id", "r_box_id"])
    d = (centre("l_", "x0", "x1") - centre("r_", "x0", "x1")) ** 2 + (centre("l_", "top", "bottom") - centre("r_", "top", "bottom")) ** 2
    w = Window.partitionBy(*PAGE, "l_box_id").orderBy(d, "r_box_id")
    return pairs.withColumn("n", F.row_number().over(w)).where("n = 1").select(*PAGE, F.col("l_box_id").alias("caption_id"), F.col("r_box_id").alias("figure_id"))


LEADERS = r"[·.…]{6,}|(\. ){6,}"
CONTENTS = r"(contents|目录|目次|tableofcontents|致谢|acknowledge(e?ments?)?)$"


def contents_pages(boxes: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, page) of pages with more than `most` lines of dot leaders: contents, not text."""
    return boxes.where(F.col("text").rlike(LEADERS)).groupBy(*PAGE).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*PAGE)


def drop_contents(boxes: DataFrame, reach: int = 128, most: int = 3) -> DataFrame:
    """The boxes without contents and acknowledgements: the box that names them, the first entry after it, and what follows
    up to the next box within `reach` that begins like that entry (by two words, in other scripts by three characters).
    Documents without such a box lose their `contents_pages`. From top to bottom in each page."""
    import re

    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("page", "top", "x0", "box_id")])
        texts = [(x or "").strip() for x in t["text"].to_pylist()]
        keep, i, n, found = [True] * len(texts), 0, len(texts), False
        while i < n:
            if not re.match(CONTENTS, re.sub(r"[ \u3000]+", "", texts[i].lower())):
                i += 1
                continue
            words, entry, found = re.match(r"[0-9a-zA-Z :'.-]{5,}", texts[i]), "", True
            keep[i] = False
            i += 1
            while i < n and not entry:
                entry = " ".join(texts[i].split()[:2]) if words else texts[i][:3]
                keep[i] = False
                i += 1
            end = next((j for j in range(i, min(i + reach, n)) if texts[j].startswith(entry)), i)
            keep[i:end] = [False] * (end - i)
            i = end
        if not found:
            pages = t["page"].to_pylist()
            led = [p for p, x in zip(pages, texts) if re.search(LEADERS, x)]
            gone = {p for p in led if led.count(p) > most}
            keep = [p not in gone for p in pages]
        return t.filter(pa.array(keep, pa.bool_()))

    return boxes.groupBy("doc_id").applyInArrow(run, boxes.schema)


def align_tables(parts: DataFrame, many: int = 4) -> DataFrame:
    """Parts (doc_id, page, table_id, label, x0, x1, top, bottom) of recognised tables: rows and headers are widened to the
    table's mean edges, columns heightened to its median ones; with `many` or fewer of them to the outermost. Nothing shrinks."""
    w = Window.partitionBy(*PAGE, "table_id")
    row = F.col("label").rlike("(?s)^.+(row|header)")
    col = F.col("label") == "table column"

    def edge(of: Column, c: str, usual, few, reach) -> Column:
        mine = F.when(of, F.col(c))
        common = F.when(F.count(mine).over(w) > many, usual(mine).over(w)).otherwise(few(mine).over(w))
        return F.when(of, reach(F.col(c), common)).otherwise(F.col(c))

    return parts.withColumns({
        "x0": edge(row, "x0", F.avg, F.min, F.least), "x1": edge(row, "x1", F.avg, F.max, F.greatest),
        "top": edge(col, "top", F.median, F.min, F.least), "bottom": edge(col, "bottom", F.median, F.max, F.greatest),
    })


def continued_tables(tables: DataFrame, most_gap: float = 23.0) -> DataFrame:
    """Tables (doc_id, page, table_id, x0, top, bottom, page_height, line_height) with whole, the table_id of the first part:
    one goes on in the next on the following page if no more than `most_gap` lines lie between them."""
    w = Window.partitionBy("doc_id").orderBy("page", "top", "x0", "table_id")
    gap = F.lag(F.col("page_height") - F.col("bottom")).over(w) + F.col("top")
    on = (F.col("page") == F.lag("page").over(w) + 1) & (gap <= most_gap * F.col("line_height"))
    parts = tables.withColumn("n", F.sum(F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).over(w))
    return parts.withColumn("whole", F.first("table_id").over(Window.partitionBy("doc_id", "n").orderBy("page"))).drop("n")


def drop_scraps(boxes: DataFrame, share: float = 0.35, wide: float = 200.0) -> DataFrame:
    """The boxes (with kind, text, page_width) without scraps: from top to bottom, boxes near each other sideways, or after a
    title, make a block; it stays if it begins with a title or its mean width is `share` of the page or above `wide`. Boxes of
    no kind that are neither a third of the page wide nor higher than the page's mean are scraps."""
    import pyarrow as pa

    from leafmill.functions.spans import is_section_title

    none = F.lit(None).cast("double")
    titled = F.coalesce(F.col("kind") == "title", F.lit(False)) | F.coalesce(is_section_title(F.col("text"), none, none, none, none), F.lit(False))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("top", "x0", "box_id")])
        x0, x1, top, bottom, page, kind, title = (t[c].to_pylist() for c in ("x0", "x1", "top", "bottom", "page_width", "kind", "__title"))
        high = sum(b - a for a, b in zip(top, bottom)) / len(top)
        useful = [bool(kind[i]) or x1[i] - x0[i] > page[i] / 3 or bottom[i] - top[i] > high for i in range(len(x0))]

        def follows(a: int, b: int) -> bool:
            aside = min(abs(x1[a] - x0[b]), abs(x0[a] - x1[b]), abs(x0[a] + x1[a] - x0[b] - x1[b]) / 2)
            return useful[b] and (title[a] or aside < page[a] / 10)

        rest, keep = list(range(len(x0))), []
        while rest:
            block, at = [rest.pop(0)], 0
            if not useful[block[0]]:
                continue
            while at is not None:
                a, start, at = block[-1], at, None
                for q in range(start, min(start + 19, len(rest))):
                    b = rest[q]
                    if not title[a] and (top[b] + bottom[b] - top[a] - bottom[a]) / 2 >= 3 * high and bottom[a] - top[a] < 1.5 * high:
                        break
                    if follows(a, b):
                        at = q
                        block.append(rest.pop(q))
                        break
            mean = sum(x1[i] - x0[i] for i in block) / len(block)
            if title[block[0]] or mean >= share * page[block[0]] or mean > wide:
                keep += block
        return t.drop_columns(["__title"]).take(pa.array(sorted(keep), pa.int64()))

    return boxes.withColumn("__title", titled).groupBy(*PAGE).applyInArrow(run, boxes.schema)


def table_cells(boxes: DataFrame, rows: DataFrame, cols: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc_id, page, row, col, text): boxes in the row and the column that cover most of them, at least the share; the
    texts of one cell in reading order. Boxes without a row or column are left out."""
    def best(areas: DataFrame, name: str) -> DataFrame:
        hit = overlapping(boxes, areas).withColumn("part", F.col("shared") / area("l_")).where(F.col("part") >= share)
        w = Window.partitionBy(*PAGE, "l_box_id").orderBy(F.desc("part"), "r_box_id")
        return hit.withColumn("n", F.row_number().over(w)).where("n = 1").select(*PAGE, F.col("l_box_id").alias("box_id"), F.col("r_box_id").alias(name))

    placed = boxes.join(best(rows, "row"), [*PAGE, "box_id"]).join(best(cols, "col"), [*PAGE, "box_id"])
    parts = F.array_sort(F.collect_list(F.struct("top", "x0", "box_id", "text")))
    return placed.groupBy(*PAGE, "row", "col").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def confident(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """The boxes, with the text of those read with less confidence left empty."""
    return boxes.withColumn("text", F.when(F.col("score") >= least, F.col("text")).otherwise(""))
