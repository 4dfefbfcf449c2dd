"""Records and results: ids, serial forms, filters, previews, explanations, table statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as ft


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based UUID (version 5) of a text, worked out in the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    part = lambda start, n: F.substring(h, start, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def merge_filters(*filters: dict[str, object] | None, knowledge_bases: list[str] | None = None) -> dict[str, object]:
    """Filters from the general to the particular; a later value replaces an earlier one, None is no filter, knowledge bases keep their order, each once."""
    out = {k: v for f in filters if f for k, v in f.items() if v is not None}
    return out | ({"knowledge_base_id": list(dict.fromkeys(knowledge_bases))} if knowledge_bases else {})


def resolve_scopes(asked: DataFrame, known: DataFrame, key: str, scopes: str, tenant: list[str]) -> DataFrame:
    """(`key`, scope, place): the scopes that each request names, in order and once each; `*` names all of its tenant's. An unknown scope fails the job, as does a request without any."""
    each = asked.select(key, *tenant, F.posexplode_outer(F.array_distinct(scopes)).alias("place", "scope"))
    checked = each.withColumn("scope", F.when(F.col("scope").isNull(), F.raise_error(F.concat(F.lit("no scope: "), F.col(key).cast("string")))).otherwise(F.col("scope")))
    own = known.select(*tenant, F.col("scope").alias("own")).distinct()
    named = checked.where("scope <> '*'").join(own, [*tenant], "left").where(F.col("own") == F.col("scope")).select(key, "scope", "place")
    lost = checked.where("scope <> '*'").join(own.withColumnRenamed("own", "scope"), [*tenant, "scope"], "left_anti").select(key, F.raise_error(F.concat(F.lit("unknown scope: "), F.col("scope"))).cast("string").alias("scope"), "place")
    every = checked.where("scope = '*'").join(own, tenant).select(key, F.col("own").alias("scope"), "place")
    return named.unionByName(lost).unionByName(every).groupBy(key, "scope").agg(F.min("place").alias("place"))


def guard_tokens(df: DataFrame, key: str, tokens: str, most: int = 8191) -> DataFrame:
    """`df` unchanged; a row with more than `most` tokens fails the job and is named, for an embedding would cut it in silence."""
    ok = F.when(F.col(tokens) > most, F.raise_error(F.concat(F.lit("too many tokens: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return df.withColumn("_ok", ok).where("_ok").drop("_ok")


def override_policy(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Policy columns replaced by the overrides of the same key that are not null."""
    o = overrides.dropDuplicates([key]).withColumnsRenamed({c: f"_{c}" for c in overrides.columns if c != key})
    names = [c for c in overrides.columns if c != key]
    return df.join(o, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in names}).drop(*(f"_{c}" for c in names))


RECORD = "chunk_id string, section_slug string, text string, chunk_tier string, start_page int, end_page int, key_terms array<string>"


def to_record(df: DataFrame) -> DataFrame:
    """(chunk_id, record): chunks as JSON, nulls left out."""
    names = [f.strip().split()[0] for f in RECORD.split(", ")]
    return df.select("chunk_id", F.to_json(F.struct(*names)).alias("record"))


def from_record(df: DataFrame) -> DataFrame:
    """Chunks from JSON; what is missing or broken has its default: tier semantic, page 1, the last page the first, no terms."""
    r = df.select("chunk_id", F.from_json("record", RECORD).alias("r"))
    first = F.coalesce("r.start_page", F.lit(1))
    return r.select(
        "chunk_id", F.coalesce("r.section_slug", F.lit("")).alias("section_slug"), F.coalesce("r.text", F.lit("")).alias("text"), F.coalesce("r.chunk_tier", F.lit("semantic")).alias("chunk_tier"),
        first.alias("start_page"), F.coalesce("r.end_page", first).alias("end_page"), F.coalesce("r.key_terms", F.array().cast("array<string>")).alias("key_terms"),
    )


def explanation(rank: Column, track: Column, tier: Column, score: Column) -> Column:
    """Why a result stands where it does."""
    return F.format_string("Rank %d from %s track, tier=%s, score=%.3f.", rank, track, tier, score)


def top_keywords(keywords: Column, search_terms: Column, k: int = 10) -> Column:
    """Keywords and search terms in lower case, sorted, the first `k`."""
    both = F.concat(F.coalesce(keywords, F.array()), F.coalesce(search_terms, F.array()))
    clean = F.filter(F.transform(both, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))
    return F.slice(F.array_sort(F.array_distinct(clean)), 1, k)


def section_preview(sections: DataFrame, doc: str, order: str, title: str, text: str, page: str, limit: int = 4000) -> DataFrame:
    """(doc, preview): of each document's sections behind page 3 (of all, if there are none) the first two, the middle one and the last, or all of three, each cut to its share of `limit`."""
    w = Window.partitionBy(doc)
    late = F.coalesce(F.col(page) > 3, F.lit(False))
    kept = sections.select(doc, order, title, text, late.alias("_late")).withColumn("_any", F.max("_late").over(w)).where(F.col("_late") | ~F.col("_any"))
    at = kept.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    few = at.where((F.col("_n") <= 3) | F.col("_i").isin(0, 1) | (F.col("_i") == F.floor(F.col("_n") / 2)) | (F.col("_i") == F.col("_n") - 1))
    share = F.floor(F.lit(limit) / F.least(F.col("_n"), F.lit(4))).cast("int")
    line = F.concat(F.lit("## "), F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.left(F.coalesce(F.col(text), F.lit("")), share))
    parts = few.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_i", line.alias("s")))).alias("p"))  # four at most
    return parts.select(doc, F.array_join(F.col("p.s"), "\n\n").alias("preview"))


def table_stats(df: DataFrame, wide: int = 8) -> DataFrame:
    """(numeric_columns, text_columns, wide, cells, empty_cells) of a table: numeric columns by type, empty cells null or blank. One pass."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    empty = sum((F.count_if(F.coalesce(ft.strip(F.col(c).cast("string")), F.lit("")) == "") for c in df.columns), F.lit(0))
    n = len(df.columns)
    return df.agg(F.lit(len(numeric)).alias("numeric_columns"), F.lit(n - len(numeric)).alias("text_columns"), F.lit(n > wide).alias("wide"), (F.count("*") * n).alias("cells"), empty.cast("bigint").alias("empty_cells"))


def typed_chunks(blocks: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """(document_id, chunk_id, type, page, text, tokens): the blocks, tables and images of documents as chunks of one kind of row.

    `blocks` (document_id, block_id, page, text, is_heading) are headings or text, blank ones left out; `tables` (document_id, page, place, markdown) and `images`
    (document_id, page, place, ocr_text, caption) are numbered on their page by `place`. Tokens are words; images have none.
    """
    t = ft.strip(F.col("text"))
    plain = blocks.where(t != "").select("document_id", F.col("block_id").alias("chunk_id"), F.when(F.col("is_heading"), "heading").otherwise("text").alias("type"), "page", t.alias("text"), F.size(ft.words(t)).alias("tokens"))

    def numbered(df: DataFrame, kind: str, text: Column, tokens: Column) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("document_id", "page").orderBy("place")) - 1
        name = F.format_string(f"%s_{kind}_p%d_%d", "document_id", "page", n)
        return df.select("document_id", name.alias("chunk_id"), F.lit(kind).alias("type"), "page", text.alias("text"), tokens.alias("tokens"))

    cells = F.coalesce("markdown", F.lit(""))
    seen = F.coalesce(F.nullif("ocr_text", F.lit("")), "caption", F.lit(""))
    return plain.unionByName(numbered(tables, "table", cells, F.size(ft.words(cells)))).unionByName(numbered(images, "image", seen, F.lit(0)))


def page_format(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, text): pages in order under their numbers. A document's pages come together, so the documents must be of a size one row may have."""
    line = F.concat(F.lit("=== Page "), F.col(page).cast("string"), F.lit(" ===\n"), F.coalesce(F.col(text), F.lit("")))
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), line.alias("s")))).alias("r"))
    return rows.select(doc, F.array_join(F.col("r.s"), "\n\n---\n\n").alias("text"))


def overlay_feedback(chunks: DataFrame, feedback: DataFrame, key: str) -> DataFrame:
    """Chunks with the counters of the feedback view; a chunk without feedback keeps its own."""
    f = feedback.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in ("positive", "negative")))
    return chunks.join(f, key, "left").withColumns({c: F.coalesce(f"_{c}", c, F.lit(0)) for c in ("positive", "negative")}).drop("_positive", "_negative")


#: References to figures, tables and other visuals in a text (fixed values).
VISUAL_REFERENCE = r"(?i)\b(?:figure|fig\.?|table|chart|diagram|graph|image)\s+(\d+(?:\.\d+)?)"


def visual_references(t: Column) -> Column:
    """The numbers of the visuals a text refers to, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(t, F.lit(VISUAL_REFERENCE), F.lit(1)))


def result_visuals(results: DataFrame, visuals: DataFrame, query: str, item: str, ids: str, visual: str) -> DataFrame:
    """(query, item, visuals): the visuals that each result names, in its order; unknown ids are left out."""
    each = results.select(query, item, F.posexplode_outer(ids).alias("_p", visual))
    known = each.join(visuals.select(visual, F.lit(True).alias("_known")).distinct(), visual, "left")
    rows = known.groupBy(query, item).agg(F.array_sort(F.collect_list(F.when(F.col("_known"), F.struct("_p", visual)))).alias("_v"))
    return rows.select(query, item, F.col("_v")[visual].alias("visuals"))


def lossy_text(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 is left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def truncate_bytes(t: Column, most: int) -> Column:
    """The longest start of a text that takes `most` bytes in UTF-8 at most; no character is cut."""
    raw = F.encode(t, "UTF-8")
    cut = F.make_valid_utf8(F.substring(raw, 1, most).cast("string"))
    inside = F.hex(F.substring(raw, most + 1, 1)).rlike("^[89AB]")  # the cut goes through a character
    return F.when(F.octet_length(t) <= most, t).when(inside, F.regexp_replace(cut, "\ufffd+$", "")).otherwise(cut)


def hit_rate(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """(by, lookups, rate): the share of lookups that hit."""
    return df.groupBy(*by).agg(F.count("*").alias("lookups"), F.round(F.avg(hit.cast("int")), 6).alias("rate"))


def scope_id(given: Column, title: Column) -> Column:
    """The knowledge base given, else one named by the title."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), ft.slugify(F.coalesce(title, F.lit(""))))
