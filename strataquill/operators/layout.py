"""Page layout as relational operations: reading order, neighbours in space, headings, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as fl
from . import telemetry


def reading_order(df: DataFrame, page: list[str], item: str, across: list[str] | None = None) -> DataFrame:
    """(page, item, ord, prev, next): blocks from top to bottom, then left to right; links stay within `across` (by default `page`)."""
    order = [*(c for c in page if c not in (across or page)), F.desc("y1"), "x0", item]
    w = Window.partitionBy(*(across or page)).orderBy(*order)
    return df.select(*page, item, F.row_number().over(w).alias("ord"), F.lag(item).over(w).alias("prev"), F.lead(item).over(w).alias("next"))


def spatial_edges(df: DataFrame, page: list[str], item: str, least: float = 0.5) -> DataFrame:
    """(page, item, relation, neighbour): the nearest block above, below, left and right of each.

    Blocks are related if they overlap by `least` of the shorter extent in the other direction. The join is on the page, with the side tests behind it.
    """
    cols = ["x0", "y0", "x1", "y1"]
    a = df.select(*page, F.col(item).alias("a"), *(F.col(c).alias(f"a_{c}") for c in cols))
    b = df.select(*page, F.col(item).alias("b"), *(F.col(c).alias(f"b_{c}") for c in cols))
    both = a.join(b, page).where("a <> b")
    across = fl.overlap_ratio(F.col("a_x0"), F.col("a_x1"), F.col("b_x0"), F.col("b_x1")) >= least
    along = fl.overlap_ratio(F.col("a_y0"), F.col("a_y1"), F.col("b_y0"), F.col("b_y1")) >= least
    sides = F.array(
        F.when(across & (F.col("b_y0") >= F.col("a_y1")), F.struct(F.lit("above").alias("relation"), (F.col("b_y0") - F.col("a_y1")).alias("gap"))),
        F.when(across & (F.col("b_y1") <= F.col("a_y0")), F.struct(F.lit("below").alias("relation"), (F.col("a_y0") - F.col("b_y1")).alias("gap"))),
        F.when(along & (F.col("b_x1") <= F.col("a_x0")), F.struct(F.lit("left").alias("relation"), (F.col("a_x0") - F.col("b_x1")).alias("gap"))),
        F.when(along & (F.col("b_x0") >= F.col("a_x1")), F.struct(F.lit("right").alias("relation"), (F.col("b_x0") - F.col("a_x1")).alias("gap"))),
    )
    each = both.select(*page, "a", "b", F.inline(F.array_compact(sides)))
    return each.groupBy(*page, F.col("a").alias(item), "relation").agg(F.min_by("b", F.struct("gap", "b")).alias("neighbour"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median): the middle value of each group's sorted values, the upper one of two."""
    return telemetry.order_statistics(df, by, value, lambda n: [F.floor(n / 2)]).select(*by, F.col("v0").alias("median"))


def heading_levels(blocks: DataFrame, doc: str, item: str, size: str) -> DataFrame:
    """(doc, item, level): the dense rank of a heading's size among its document's, 6 at most.

    The distinct sizes are ranked, not the blocks, so a document with most of the blocks is no large window.
    """
    sizes = blocks.select(doc, size).distinct().select(doc, size, F.least(F.dense_rank().over(Window.partitionBy(doc).orderBy(F.desc(size))), F.lit(6)).alias("level"))
    return blocks.select(doc, item, size).join(sizes, [doc, size]).select(doc, item, "level")


def heading_parent(blocks: DataFrame, doc: list[str], item: str, order: list[str], is_heading: str) -> DataFrame:
    """(doc, item, parent): the last heading before each block that is none."""
    w = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("parent", F.last(F.when(F.col(is_heading), F.col(item)), ignorenulls=True).over(w)).where(~F.col(is_heading)).select(*doc, item, "parent")


def page_columns(df: DataFrame, page: list[str], gap: float = 20.0) -> DataFrame:
    """(page, columns, blocks, layout): columns are runs of left edges less than `gap` apart that hold two blocks or more."""
    w = Window.partitionBy(*page).orderBy("x0")
    starts = df.withColumn("_new", F.coalesce(F.col("x0") - F.lag("x0").over(w) > gap, F.lit(True)).cast("int"))
    runs = starts.withColumn("_col", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.groupBy(*page, "_col").agg(F.count("*").alias("_n"))
    out = sizes.groupBy(*page).agg(F.count_if(F.col("_n") >= 2).alias("columns"), F.sum("_n").alias("blocks"))
    name = F.when(F.col("columns") == 0, "unknown").when(F.col("columns") == 1, "single").when(F.col("columns") == 2, "double").otherwise("multi")
    return out.withColumn("layout", name)


def column_confidence(df: DataFrame, page: list[str], width: float = 612.0, gap: float = 20.0) -> DataFrame:
    """(page, columns, confidence): how evenly a page's columns of two blocks or more are filled and how alike their widths are, between 0 and 1.

    Columns meet halfway between left edges more than `gap` apart; the first begins at 0 and the last ends at `width`, what lies outside counts in none. A page
    without such a gap is one column around its blocks. Without a column the confidence is 0.
    """
    edges = Window.partitionBy(*page).orderBy("x0")
    starts = df.withColumn("_new", F.coalesce(F.col("x0") - F.lag("x0").over(edges) > gap, F.lit(True)).cast("int"))
    runs = starts.withColumn("_col", F.sum("_new").over(edges.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*page, "_col")
    ends = runs.agg(F.min("x0").alias("_lo"), F.max("x0").alias("_hi"), F.max("x1").alias("_end"), F.count("*").alias("_all"), F.count_if(F.col("x0") >= 0).alias("_right"), F.count_if(F.col("x0") <= width).alias("_left"))
    w = Window.partitionBy(*page).orderBy("_col")
    before, behind = F.lag("_hi").over(w), F.lead("_lo").over(w)
    sides = ends.withColumns({"_before": before, "_behind": behind})
    first, last = F.col("_before").isNull(), F.col("_behind").isNull()
    lo = F.when(first & last, F.col("_lo")).when(first, 0.0).otherwise((F.col("_before") + F.col("_lo")) / 2)
    hi = F.when(first & last, F.col("_end")).when(last, F.lit(width)).otherwise((F.col("_hi") + F.col("_behind")) / 2)
    n = F.when(first & ~last, F.col("_right")).when(last & ~first, F.col("_left")).otherwise(F.col("_all"))
    held = sides.select(*page, n.alias("_n"), (hi - lo).alias("_w")).withColumn("_ok", F.col("_n") >= 2)
    even = lambda c: 1 / (1 + F.var_pop(F.when(F.col("_ok"), F.col(c))) / (F.avg(F.when(F.col("_ok"), F.col(c))) + 1))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * even("_n") + 0.4 * even("_w")))
    return held.groupBy(*page).agg(F.count_if("_ok").alias("columns"), F.round(F.coalesce(F.when(F.count_if("_ok") > 0, score), F.lit(0.0)), 6).alias("confidence"))


def page_siblings(df: DataFrame, page: list[str], item: str) -> DataFrame:
    """(page, item, sibling): the other blocks of each block's page, by an equality join on the page."""
    return df.select(*page, item).join(df.select(*page, F.col(item).alias("sibling")), page).where(F.col(item) != F.col("sibling"))


def heading_children(parents: DataFrame, doc: str, item: str) -> DataFrame:
    """(doc, parent, children): how many blocks stand under each heading and the first of them, from (doc, item, parent)."""
    return parents.where("parent is not null").groupBy(doc, "parent").agg(F.count("*").alias("children"), F.min(item).alias("first_child"))


def layout_consensus(columns: DataFrame, doc: str) -> DataFrame:
    """(doc, layout): the one layout its pages agree on, `complex` if two or more known ones differ, `unknown` if none is known."""
    known = F.when(F.col("layout") != "unknown", F.col("layout"))
    low, high = F.min(known), F.max(known)
    return columns.groupBy(doc).agg(F.when(low.isNull(), "unknown").when(low == high, low).otherwise("complex").alias("layout"))


def font_sections(blocks: DataFrame, doc: str, order: str, text: str, size: str, page: str, pages: str) -> DataFrame:
    """(doc, title, first_page, last_page): headings by font size; with more than three candidates those at least as large as the one three tenths down the sizes.

    Candidates are larger than 12, shorter than 100 characters, not all in capitals and hold a capital. The sizes are counted, so no document's blocks are collected.
    """
    t = F.col(text)
    c = blocks.where((F.col(size) > 12) & (F.length(t) < 100) & (t != F.upper(t)) & (t != F.lower(t)))
    # Place int(0.3 n) of the sizes from the largest is place n - 1 - int(0.3 n) from the smallest.
    limit = telemetry.order_statistics(c, [doc], size, lambda n: [n - 1 - F.floor(n * F.lit(0.3))]).select(doc, "n", F.col("v0").alias("_least"))
    kept = c.join(limit, doc).where((F.col("n") <= 3) | (F.col(size) >= F.col("_least")))
    w = Window.partitionBy(doc).orderBy(order)
    last = F.greatest(F.col(page), F.coalesce(F.lead(page).over(w) - 1, F.col(pages)))
    return kept.select(doc, t.alias("title"), F.col(page).alias("first_page"), last.alias("last_page"))


def choose_sections(doc: str, contents: DataFrame, headings: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc, title, first_page, last_page, strategy): sections by the table of contents where there is one, else by two or more headings, else by runs of pages."""
    cols = [doc, "title", "first_page", "last_page"]
    many = headings.groupBy(doc).agg(F.count("*").alias("_n")).where("_n > 1").select(doc)
    listed = contents.select(doc).distinct()
    by_heads = headings.join(many, doc, "left_semi").join(listed, doc, "left_anti")
    rest = runs.join(listed, doc, "left_anti").join(many, doc, "left_anti")
    named = lambda df, s: df.select(*cols).withColumn("strategy", F.lit(s))
    return named(contents, "contents").unionByName(named(by_heads, "headings")).unionByName(named(rest, "pages"))
