"""Documents to sections: heading islands, tables of contents, page runs, HTML text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def section_islands(elements: DataFrame, doc: str, order: str, is_heading: str, text: str, page: str) -> DataFrame:
    """(doc, section, title, text, first_page, last_page): each heading begins a section; what stands before the first is section 0."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    each = elements.withColumn("section", F.sum(F.col(is_heading).cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col(is_heading), F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))), lambda s: s["t"]), "\n\n")
    return each.groupBy(doc, "section").agg(F.max(F.when(F.col(is_heading), F.col(text))).alias("title"), body.alias("text"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))


def toc_ranges(toc: DataFrame, doc: str, order: str, level: str, title: str, page: str, pages: str) -> DataFrame:
    """(doc, title, first_page, last_page): entries of level 2 at most end before the next begins; pages before the first are an introduction."""
    w = Window.partitionBy(doc).orderBy(order)
    top = toc.where(F.col(level) <= 2)
    own = top.select(doc, F.col(title).alias("title"), F.col(page).alias("first_page"), F.greatest(F.col(page), F.coalesce(F.lead(page).over(w) - 1, F.col(pages))).alias("last_page"))
    intro = top.groupBy(doc).agg(F.min(page).alias("_f")).where("_f > 1").select(doc, F.lit("Introduction").alias("title"), F.lit(1).alias("first_page"), (F.col("_f") - 1).alias("last_page"))
    return own.unionByName(intro)


def page_runs(docs: DataFrame, doc: str, pages: str, most: int = 10) -> DataFrame:
    """(doc, first_page, last_page): runs of 5, 10 or 15 pages by the length of the document, `most` at most."""
    step = F.least(F.lit(most), F.when(F.col(pages) <= 50, 5).when(F.col(pages) <= 200, 10).otherwise(15))
    each = docs.where(F.col(pages) > 0).select(doc, F.col(pages).alias("_p"), step.alias("_s"), F.explode(F.sequence(F.lit(1), F.col(pages), step)).alias("first_page"))
    return each.select(doc, "first_page", F.least(F.col("first_page") + F.col("_s") - 1, F.col("_p")).alias("last_page"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def html_text(df: DataFrame, key: str, html: str) -> DataFrame:
    """(`key`, text): the text nodes of HTML, one to a line; null gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h in b["_h"]:
                if h is None:
                    out.append(None)
                    continue
                p = _Text()
                p.feed(h)
                p.close()
                out.append("\n".join(p.parts))
            yield pd.DataFrame({key: b["_k"], "text": out})

    src = df.select(F.col(key).alias("_k"), F.col(html).alias("_h"))
    return src.mapInPandas(run, f"`{key}` {src.schema['_k'].dataType.simpleString()}, text string")
