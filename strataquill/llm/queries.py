"""The numbered problems over the platform's tables: pN_found as TESTDATA.md gives it, and fuller results beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import corpus, leaks, near_dupes, neighbours, quality, scans, splitting, tokens


def p1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token count of every document and every distinct chunk, with the slice each belongs to."""
    path = tokens.tokenizer_path(spark)
    docs = table(spark, sf_dir, "documents")
    d = tokens.token_counts(docs.withColumns({"_source": tokens.source_name(F.col("source")), "_lang": tokens.lang_code(F.col("lang")), "_id": F.col("doc_id").cast("string")}), ["_id", "_source", "_lang", "knowledge_base_id"], "text", path)
    d = d.select(F.lit("documents").alias("corpus"), F.col("_id").alias("id"), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("knowledge_base_id").alias("kb"), "n_tokens")
    c = tokens.token_counts(table(spark, sf_dir, "chunks"), ["chunk_id", "document_id", "knowledge_base_id"], "text", path)
    c = c.where("chunk_id is not null").dropDuplicates(["chunk_id"])
    s = corpus.current_submissions(spark, sf_dir)
    c = c.join(s, "document_id", "left").select(
        F.lit("chunks").alias("corpus"), F.col("chunk_id").alias("id"), tokens.source_name(F.col("source_type")).alias("source"), tokens.lang_code(F.col("lang")).alias("lang"),
        F.coalesce("kb", "knowledge_base_id").alias("kb"), "n_tokens",
    )
    both = d.unionByName(c).join(corpus.domains(spark, sf_dir), "kb", "left")
    return both.select("corpus", "id", "source", "lang", F.coalesce("domain", F.lit("unknown")).alias("domain"), "n_tokens")


def p1_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and tokens by source, language and domain, with all totals."""
    return tokens.token_budget(p1_token_counts(spark, sf_dir))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every usable current vector."""
    return neighbours.nearest_vectors(table(spark, sf_dir, "vectors"), "chunk_id", "knowledge_base_id", "track", "vector", "upserted_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a cosine of 0.90 or more, one among the ten most similar of the other."""
    near = p2_neighbours(spark, sf_dir).where("similarity >= 0.9")
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b"), "track").dropDuplicates()


def p3_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All noise of scanned pages with the words it concerns."""
    return scans.scan_noise(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "common_words"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each noisy line and kind."""
    return p3_noise(spark, sf_dir).select("chunk_id", "line_no", "kind").dropDuplicates()


def p3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy chunks as continuous readable text."""
    return scans.repaired_text(table(spark, sf_dir, "chunks"), cut(p3_noise(spark, sf_dir)))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "document_id", "knowledge_base_id", "section_slug", "text", "start_page", "end_page")
    kbs = table(spark, sf_dir, "knowledge_bases").select(F.col("knowledge_base_id").alias("kb"), "max_chunk_chars", "overlap_chars").dropDuplicates(["kb"])
    # No chunk within the smallest limit of all can be over its own.
    least = kbs.agg(F.min("max_chunk_chars").alias("least"))
    long = chunks.where("chunk_id is not null").join(F.broadcast(least), F.length("text") > F.col("least")).drop("least")
    kb_of = table(spark, sf_dir, "submissions").groupBy("document_id").agg(F.max("knowledge_base_id").alias("own"))
    sized = long.join(kb_of, "document_id", "left").withColumn("kb", F.coalesce("own", "knowledge_base_id")).join(kbs, "kb")
    slugs = sized.groupBy("chunk_id").agg(F.min("section_slug").alias("section_slug"))
    return splitting.split_oversized(sized, "chunk_id", "text", "max_chunk_chars", "overlap_chars", "start_page", "end_page").join(slugs, "chunk_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized chunk with the coarsest boundary that suffices."""
    return p4_pieces(spark, sf_dir).where("piece_no = 1").select("chunk_id", "boundary")


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of different documents with a Jaccard similarity of word triples of 0.60 or more."""
    return near_dupes.near_duplicate_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "document_id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of p5_links without their similarity."""
    return p5_links(spark, sf_dir).select(F.col("chunk_id_a").alias("chunk_a"), F.col("chunk_id_b").alias("chunk_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk that has a near-duplicate, with the group it belongs to."""
    return near_dupes.near_duplicate_groups(table(spark, sf_dir, "chunks"), "chunk_id", "document_id", "text")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text", tokens.tokenizer_path(spark))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return tokens.decoded(p6_ids(spark, sf_dir), "doc_id", "ids", tokens.tokenizer_path(spark))


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document with the characters each token covers."""
    return tokens.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text", tokens.tokenizer_path(spark), spans=True)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with twelve consecutive words of an evaluation item's question or answer."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", ["question", "answer"])


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one word put in, left out or changed among the twelve, found by repeated bit sampling of the walks."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", ["question", "answer"], max_edits=1, sampled=10)


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality statistics of every document."""
    return quality.text_stats(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "common_words"))


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not prose, their kind and the share of their characters outside prose."""
    return quality.document_kinds(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return p8_kinds(spark, sf_dir).select("doc_id", "kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_token_budget, p1_token_counts, p2_found, p2_neighbours, p3_found, p3_noise, p3_text, p4_found, p4_pieces, p5_found, p5_links, p5_groups, p6_ids, p6_decoded, p6_spans, p7_found, p7_near, p8_found, p8_kinds, p8_stats)
}

ORACLE_SQL: dict[str, str] = {
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_found": r"""
        WITH kb AS (SELECT knowledge_base_id AS kb, max_chunk_chars AS most FROM knowledge_bases),
        own AS (SELECT document_id, max(knowledge_base_id) AS own FROM submissions GROUP BY 1),
        c AS (SELECT DISTINCT chunk_id, text, most FROM chunks LEFT JOIN own USING (document_id) JOIN kb ON kb.kb = coalesce(own.own, chunks.knowledge_base_id)
              WHERE chunk_id IS NOT NULL AND length(text) > most),
        w AS (SELECT *, '[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]' AS ws FROM c),
        p AS (SELECT *, '\n' || ws || '*\n' AS blank, regexp_replace(text, '([.!?…]["''”’»›“‘)\]}]*)(' || ws || ')', '\1' || chr(1) || '\2', 'g') AS marked FROM w),
        m AS (SELECT chunk_id, most,
                     list_max(list_transform(regexp_split_to_array(text, blank), lambda x: length(regexp_replace(x, '^' || ws || '+|' || ws || '+$', '', 'g')))) AS par,
                     list_max(list_transform(regexp_split_to_array(marked, chr(1) || '|' || blank), lambda x: length(regexp_replace(replace(x, chr(1), ''), '^' || ws || '+|' || ws || '+$', '', 'g')))) AS sen,
                     list_max(list_transform(regexp_split_to_array(text, ws || '+'), lambda x: length(x))) AS wor
              FROM p)
        SELECT chunk_id, CASE WHEN par <= most THEN 'paragraph' WHEN sen <= most THEN 'sentence' WHEN wor <= most THEN 'word' ELSE 'none' END AS boundary FROM m""",
    "p8_stats": r"""
        WITH c AS (SELECT list(DISTINCT lower(word)) AS common FROM common_words WHERE word IS NOT NULL),
        t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        u AS (
            SELECT doc_id, t,
                   list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words,
                   list_filter(list_transform(regexp_split_to_array(t, '[\r\n\f]+'), lambda x: regexp_replace(x, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '')), lambda x: x <> '') AS lines,
                   length(regexp_replace(t, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g')) AS solid,
                   length(regexp_replace(t, '[\p{L}\p{N}\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g')) AS signs
            FROM t)
        SELECT doc_id, len(words)::INT AS n_words,
               round(length(array_to_string(words, ''))::DOUBLE / nullif(len(words), 0), 6) AS mean_word_length,
               round(signs::DOUBLE / nullif(solid, 0), 6) AS symbol_ratio,
               round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;,…]$')))::DOUBLE / nullif(len(lines), 0), 6) AS terminal_line_share,
               round(len(list_filter(words, lambda w: list_contains(common, w)))::DOUBLE / nullif(len(words), 0), 6) AS common_word_share
        FROM u, c""",
}
