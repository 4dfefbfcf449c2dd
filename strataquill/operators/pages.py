"""Pages of documents, and the context of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covered_pages(df: DataFrame, first: str = "start_page", last: str = "end_page") -> DataFrame:
    """One row for each page a row covers; a null or earlier last page is the first."""
    return df.withColumn("page", F.explode(F.sequence(F.col(first), F.greatest(F.col(first), F.coalesce(F.col(last), F.col(first))))))


def page_documents(chunks: DataFrame, doc: str = "document_id") -> DataFrame:
    """(doc, page, page_id, chunk_ids, text): what stands on each page, in order of chunk_no and chunk_id."""
    each = covered_pages(chunks.where(F.col("start_page").isNotNull()))
    rows = each.groupBy(doc, "page").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_id", "text"))).alias("_r"))
    texts = F.array_join(F.filter(F.col("_r.text"), lambda t: F.trim(t) != ""), "\n\n")
    return rows.select(doc, "page", F.concat(F.col(doc), F.lit("_page"), F.col("page")).alias("page_id"), F.array_sort(F.array_distinct("_r.chunk_id")).alias("chunk_ids"), texts.alias("text"))


def context_pages(results: DataFrame, chunk_pages: DataFrame, query: str, item: str) -> DataFrame:
    """(query, page_id, rank): the pages of results, each once, by its best result."""
    return results.join(chunk_pages, item).groupBy(query, "page_id").agg(F.min("rank").alias("rank"))


def visual_links(chunks: DataFrame, visuals: DataFrame, doc: str, chunk: str, visual: str) -> DataFrame:
    """(doc, chunk, visual): visuals within a page of a chunk's pages, by equality on shifted pages."""
    pages = covered_pages(chunks.where(F.col("start_page").isNotNull())).select(doc, chunk, "page").distinct()
    near = visuals.where(F.col("page").isNotNull()).select(doc, visual, F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page"))
    return pages.join(near, [doc, "page"]).select(doc, chunk, visual).distinct()
