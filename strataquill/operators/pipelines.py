"""Composite pipelines: each joins operators of this package into one public function over tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import vector as fv
from ..sources import tables
from . import chunking, layout, records, semantic, sparse, terms, vectors


def retrieve(
    queries: DataFrame, chunks: DataFrame, *, tenant: list[str], k: int = 10, depth: int = 24, dim: int = 32,
    edges: DataFrame | None = None, feedback: DataFrame | None = None, aliases: int = 3, least_tokens: int = 8, boost: float = 0.15,
) -> DataFrame:
    """(query_id, chunk_id, rank, track, score, explanation, snippet): expand, search each track, drop noise, fuse, cut, boost, explain.

    `queries` has query_id, text and the tenant columns; `chunks` chunk_id, text, chunk_tier, token_count and the tenant columns, one row for each chunk.
    The dense track compares hash embeddings, the word track sparse vectors of the query with its strongest aliases. Noise goes after a track's list is cut, never before.
    Queries and chunks of different tenants never meet. Null texts are found by no query.
    """
    q = queries.where("query_id is not null and text is not null").select("query_id", "text", *tenant)
    c = chunks.where("chunk_id is not null and text is not null")
    embed = lambda df, key: df.select(key, fv.hash_embedding(F.col("text"), dim).alias("v"), *tenant)
    dense = vectors.dense_topk(embed(q, "query_id"), embed(c, "chunk_id"), query="query_id", item="chunk_id", vector="v", k=depth, partition=tenant)
    asked = q
    if edges is not None:
        more = terms.expand_queries(q, edges, "query_id", "text", tenant, aliases).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), " ").alias("more"))
        asked = q.join(more, "query_id", "left").withColumn("text", F.concat_ws(" ", "text", "more")).drop("more")
    wanted = sparse.text_vectors(asked, "query_id", "text", scope=tenant)
    among = [r["idx"] for r in wanted.select("idx").distinct().collect()]  # as many as a sparse vector has dimensions, at most
    had = sparse.text_vectors(c, "chunk_id", "text", scope=tenant, among=among)
    words = sparse.sparse_topk(_scoped(wanted, "query_id", tenant), _scoped(had, "chunk_id", tenant), "query_id", "chunk_id", depth)
    lists = dense.withColumn("track", F.lit("text")).unionByName(words.withColumn("track", F.lit("words")).withColumn("rank", F.col("rank").cast("int")))
    lists = vectors.drop_noise(lists.join(c.select("chunk_id", "token_count"), "chunk_id"), "token_count", least_tokens)
    fused = vectors.ranked(vectors.fuse_tracks(lists, "query_id", "chunk_id", "track"), ["query_id"], "score", "chunk_id", k)
    if feedback is not None:
        fused = vectors.feedback_boost(fused, feedback, "chunk_id", boost)
    # Joined before the snippet is made, which only results need.
    shown = fused.join(c.select("chunk_id", "chunk_tier", "text"), "chunk_id").withColumns({"tier": F.coalesce("chunk_tier", F.lit("semantic")), "snippet": ft.first_sentence(F.col("text"))})
    return shown.select("query_id", "chunk_id", "rank", F.col("best_track").alias("track"), "score", records.explanation(F.col("rank"), F.col("best_track"), F.col("tier"), F.col("score")).alias("explanation"), "snippet")


def _scoped(rows: DataFrame, key: str, tenant: list[str]) -> DataFrame:
    """Sparse rows whose dimension names the tenant too, so that one join keeps tenants apart."""
    if not tenant:
        return rows
    return rows.select(key, F.xxhash64(F.xxhash64(*tenant), "idx").alias("idx"), "weight")


@dataclass
class Ingested:
    """The tables that `ingest` makes."""

    chunks: DataFrame
    rejected: DataFrame
    vectors: DataFrame
    edges: DataFrame


def ingest(documents: DataFrame, tenant: list[str], dim: int = 32, whole: bool = True) -> Ingested:
    """Chunks, rejected documents and pieces, vectors and alias edges of `documents` (document_id, text, schema_name and the tenant columns).

    Documents without an id or with blank text are rejected with a reason, and so are pieces over their policy's size; nothing vanishes.
    """
    blank = F.coalesce(ft.strip(F.col("text")), F.lit("")) == ""
    reason = F.when(F.col("document_id").isNull(), "no document_id").when(blank, "no text")
    fine = documents.where(reason.isNull())
    sections = chunking.resolve_policies(fine.select("document_id", F.lit(0).alias("section_ord"), F.lit("body").alias("section_slug"), "text", "schema_name"), "schema_name")
    over = chunking.oversized_pieces(sections, whole).select("document_id", F.concat_ws("|", "document_id", "section_slug", "chunk_no").alias("chunk_id"), F.lit("piece over the policy's size").alias("reason"))
    rejected = documents.where(reason.isNotNull()).select("document_id", F.lit(None).cast("string").alias("chunk_id"), reason.alias("reason")).unionByName(over)
    scope = fine.select("document_id", *tenant).distinct()
    chunks = chunking.generate_chunks(sections, whole).join(scope, "document_id")
    embedded = chunks.select("chunk_id", *tenant, F.lit("text").alias("track"), fv.hash_embedding(F.col("text"), dim).alias("vector"))
    found = sparse.top_terms(chunks, "chunk_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), 5)
    ordered = found.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))  # five at most
    edges = terms.alias_edges(chunks.select("chunk_id", *tenant).join(ordered, "chunk_id"), tenant, "chunk_id", "terms")
    return Ingested(chunks, rejected, embedded, edges)


def ingest_from_cache(wanted: DataFrame, chunks: DataFrame, cached: DataFrame, tenant: list[str]) -> DataFrame:
    """(chunk_id, tenant, track, vector) of the chunks of the wanted documents, from vectors made before; a chunk that has none fails the job."""
    own = chunks.join(wanted.select("document_id").distinct(), "document_id", "left_semi").select("chunk_id", *tenant)
    return tables.align_cached(own, cached.select("chunk_id", "track", "vector"), "chunk_id")


def answer(queries: DataFrame, cache: DataFrame, results: DataFrame, *, tenant: list[str], most: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Cited answers, and what is new for the cache.

    A query (query_id, v, tenant) near to a cached one (query_id, v, answer, tenant) takes its answer; the others cite their `results` (query_id, rank, chunk_id, snippet) in order.
    The first table is (query_id, cached, answer), the second the cache rows of the queries that missed.
    """
    near = vectors.nearest_cached(queries, cache, query="query_id", item="query_id", vector="v", tenant=tenant, most=most).withColumnsRenamed({"query_id": "of", "query_query_id": "query_id"})
    hit = near.join(cache.select(F.col("query_id").alias("of"), "answer"), "of").select("query_id", F.lit(True).alias("cached"), "answer")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("snippet"), F.lit(" ("), F.col("chunk_id"), F.lit(")"))
    missed = results.join(near.select("query_id"), "query_id", "left_anti")
    cited = missed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("s")))), lambda x: x["s"]).alias("lines"))  # k results at most
    fresh = cited.select("query_id", F.lit(False).alias("cached"), F.array_join("lines", "\n").alias("answer"))
    return hit.unionByName(fresh), fresh.join(queries, "query_id").select("query_id", "v", "answer", *tenant)


def clear_cache(spark: SparkSession, path: str) -> None:
    """Forgets the cached answers of a scope, a folder by itself."""
    tables.drop_folder(spark, path)


def layout_layer(blocks: DataFrame, doc: str, page: str, item: str, is_heading: str) -> DataFrame:
    """(doc, page, item, ord, prev, next, parent): blocks in reading order across the pages with the heading each stands under."""
    order = layout.reading_order(blocks, [doc, page], item, [doc])
    marked = order.join(blocks.select(doc, item, is_heading), [doc, item])
    parent = layout.heading_parent(marked, [doc], item, ["ord"], is_heading)
    return order.join(parent, [doc, item], "left")


def semantic_layer(pieces: DataFrame, doc: str, item: str, order: list[str], vector: str, boundary: float = 0.3) -> DataFrame:
    """(doc, item, sim_prev, sim_next, is_boundary, group_id, members): topics of each document, and how many pieces each has."""
    near = semantic.adjacent_similarity(pieces, doc, item, order, vector, boundary)
    sizes = near.groupBy(doc, "group_id").agg(F.count("*").alias("members"))
    return near.join(sizes, [doc, "group_id"])
