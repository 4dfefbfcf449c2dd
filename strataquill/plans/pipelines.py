"""Composite pipelines, records and document structure as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import feedback, layout, pipelines, records
from ..session import spread, table
from .base import ORACLE_SQL, query
from .documents import _BOXES, _boxes, _strip, _words
from .search import _CHUNKS, _RATED, STOPS, _chunk_vectors, _chunks

def _place() -> Column:
    """A chunk's number in its document, the last part of its id."""
    return F.element_at(F.split("chunk_id", r"\|"), 3).cast("int")


def _sparse(src: str, key: str, tag: str) -> str:
    return f"""
    t{tag} AS (SELECT {key}, kb, list_filter(regexp_split_to_array(translate(lower(t), 'ς', 'σ'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM {src}),
    p{tag} AS (SELECT {key}, kb, unnest(w) AS token, unnest(range(len(w))) AS pos FROM t{tag}),
    n{tag} AS (SELECT {key}, kb, token, count(*) AS n, min(pos) AS first FROM p{tag} WHERE token NOT IN ({STOPS}) GROUP BY ALL),
    x{tag} AS (SELECT {key}, kb, first, n::DOUBLE / max(n) OVER (PARTITION BY {key}) AS weight, ('0x' || left(sha1(token), 8))::BIGINT % 131071 AS i FROM n{tag}),
    v{tag} AS (SELECT {key}, kb, CASE WHEN i = 0 THEN 1 ELSE i END AS idx, round(arg_min(weight, first), 6) AS weight FROM x{tag} GROUP BY 1, 2, 3)"""


_BYTES = "list_transform(range(32), lambda i: ('0x' || sha256(t)[(2 * i + 1):(2 * i + 2)])::BIGINT::DOUBLE)"


@query(f"""WITH {_CHUNKS}, {_RATED}, q AS (SELECT knowledge_base_id AS query_id, knowledge_base_id AS kb, description AS t, {_BYTES.replace('(t)', '(description)')} AS e FROM knowledge_bases WHERE description IS NOT NULL),
    c AS (SELECT chunk_id, knowledge_base_id AS kb, text AS t, {_BYTES.replace('(t)', '(text)')} AS e, floor(len({_words('text')}) * 1.3::DOUBLE)::INT AS tok FROM ch WHERE text IS NOT NULL AND knowledge_base_id IS NOT NULL),
    {_sparse('q', 'query_id', '1')}, {_sparse('c', 'chunk_id', '2')},
    d AS (SELECT query_id, chunk_id, 'text' AS track, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM q JOIN c USING (kb)),
    s AS (SELECT query_id, chunk_id, 'words' AS track, sum(round(v2.weight * 1000000)::BIGINT * round(v1.weight * 1000000)::BIGINT)::DOUBLE / 1e12 AS score FROM v1 JOIN v2 USING (kb, idx) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, track ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM d UNION ALL SELECT * FROM s)),
    l AS (SELECT r.* FROM r JOIN c USING (chunk_id) WHERE rank <= 24 AND NOT (tok > 0 AND tok < 8)),
    g AS (SELECT query_id, chunk_id, max(score) AS best, arg_min(track, (-score, rank, track)) AS track, sum(1.0::DOUBLE / (60 + rank)) AS bonus FROM l GROUP BY 1, 2),
    m AS (SELECT query_id, count(DISTINCT track) AS tracks FROM l GROUP BY 1),
    z AS (SELECT query_id, chunk_id, track, round(CASE WHEN tracks = 1 THEN best ELSE best + bonus END, 6) AS score FROM g JOIN m USING (query_id)),
    y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM z),
    x AS (SELECT DISTINCT feedback_id, positive, c AS chunk_id FROM (SELECT *, unnest(chunk_ids) AS c FROM f)), fs AS (SELECT chunk_id, sum(CASE WHEN positive THEN 1 ELSE -1 END) AS fs FROM x GROUP BY 1)
    SELECT query_id, y.chunk_id, rank::INT AS rank, track, round(score + 0.15 * coalesce(fs, 0), 6) AS score FROM y LEFT JOIN fs ON fs.chunk_id = y.chunk_id WHERE rank <= 10""")
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each knowledge base's description as a query over its own chunks, through the whole pipeline."""
    q = table(spark, sf_dir, "knowledge_bases").select(F.col("knowledge_base_id").alias("query_id"), "knowledge_base_id", F.col("description").alias("text"))
    c = _chunks(spark, sf_dir, "knowledge_base_id", "text", "chunk_tier").where("knowledge_base_id is not null").withColumn("token_count", ft.approx_tokens(F.col("text")))
    f = feedback.by_chunk(table(spark, sf_dir, "feedback_log")).select("chunk_id", F.col("score").alias("feedback_score"))
    return pipelines.retrieve(q, c, tenant=["knowledge_base_id"], feedback=f).select("query_id", "chunk_id", "rank", "track", "score")


@query(f"""WITH g AS ({ORACLE_SQL['generate_chunks']}), n AS (SELECT split_part(chunk_id, '|', 1) AS document_id, count(*) AS chunks FROM g GROUP BY 1)
    SELECT d.doc_id::VARCHAR AS document_id, coalesce(n.chunks, 0) AS chunks, coalesce(n.chunks, 0) AS vectors, (coalesce({_strip('text')}, '') = '')::INT AS rejected FROM documents d LEFT JOIN n ON n.document_id = d.doc_id::VARCHAR""")
def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document comes to when it is taken in: chunks, vectors, or a rejection."""
    d = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text", F.lit("default").alias("schema_name"), F.coalesce("knowledge_base_id", F.lit("")).alias("kb")))
    done = pipelines.ingest(d, ["kb"])
    chunks = done.chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    vectors = done.vectors.groupBy(F.element_at(F.split("chunk_id", r"\|"), 1).alias("document_id")).agg(F.count("*").alias("vectors"))
    lost = done.rejected.where("chunk_id is null").select("document_id", F.lit(1).alias("rejected")).distinct()
    each = d.select("document_id").join(chunks, "document_id", "left").join(vectors, "document_id", "left").join(lost, "document_id", "left")
    return each.na.fill(0)


@query(f"""WITH {_BOXES}, t AS (SELECT b.*, coalesce(ch.chunk_tier = 'criteria', false) AS h FROM b JOIN ch USING (chunk_id)),
    o AS (SELECT *, row_number() OVER w AS ord, lag(chunk_id) OVER w AS prev, lead(chunk_id) OVER w AS next FROM t WINDOW w AS (PARTITION BY t.document_id ORDER BY page, y1 DESC, x0, chunk_id)),
    p AS (SELECT *, last_value(CASE WHEN h THEN chunk_id END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o)
    SELECT document_id, page, chunk_id, ord::INT AS ord, prev, next, CASE WHEN NOT h THEN last END AS parent FROM p""")
def layout_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order and headings of all boxes, set-off blocks being the headings."""
    tier = _chunks(spark, sf_dir, "chunk_tier").select("chunk_id", F.coalesce(F.col("chunk_tier") == "criteria", F.lit(False)).alias("h"))
    return pipelines.layout_layer(_boxes(spark, sf_dir).drop("text").join(tier, "chunk_id"), "document_id", "page", "chunk_id", "h")


@query(f"WITH t AS ({ORACLE_SQL['topic_groups']}) SELECT *, count(*) OVER (PARTITION BY document_id, group_id) AS members FROM t")
def semantic_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of every document with their sizes."""
    return pipelines.semantic_layer(_chunk_vectors(spark, sf_dir), "document_id", "chunk_id", ["place", "chunk_id"], "v")


@query(f"WITH {_BOXES} SELECT a.document_id, a.page, a.chunk_id, b.chunk_id AS sibling FROM b a JOIN b ON a.document_id = b.document_id AND a.page = b.page AND a.chunk_id <> b.chunk_id")
def page_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other boxes of each box's page."""
    return layout.page_siblings(_boxes(spark, sf_dir), ["document_id", "page"], "chunk_id")


@query(f"WITH p AS ({ORACLE_SQL['heading_parent']}) SELECT document_id, parent, count(*) AS children, min(chunk_id) AS first_child FROM p WHERE parent IS NOT NULL GROUP BY 1, 2")
def heading_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much stands under each set-off block."""
    c = _chunks(spark, sf_dir, "document_id", "chunk_tier").withColumn("place", _place()).withColumn("h", F.col("chunk_tier") == "criteria").where("h is not null")
    return layout.heading_children(layout.heading_parent(c, ["document_id"], "chunk_id", ["place", "chunk_id"], "h"), "document_id", "chunk_id")


@query(f"WITH p AS ({ORACLE_SQL['page_columns']}), k AS (SELECT document_id, min(layout) FILTER (WHERE layout <> 'unknown') AS a, max(layout) FILTER (WHERE layout <> 'unknown') AS b FROM p GROUP BY 1) SELECT document_id, CASE WHEN a IS NULL THEN 'unknown' WHEN a = b THEN a ELSE 'complex' END AS layout FROM k")
def layout_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout that the pages of a document agree on."""
    return layout.layout_consensus(layout.page_columns(_boxes(spark, sf_dir), ["document_id", "page"]), "document_id")


_SIZED = f"""{_CHUNKS}, z AS (SELECT document_id, split_part(chunk_id, '|', 3)::INT AS place, left(text, 40) AS title, (length(text) % 11 + 8)::DOUBLE AS size, start_page AS page, max(end_page) OVER (PARTITION BY document_id) AS pages FROM ch WHERE text IS NOT NULL AND start_page IS NOT NULL),
    c AS (SELECT * FROM z WHERE size > 12 AND length(title) < 100 AND title <> upper(title) AND title <> lower(title)),
    m AS (SELECT document_id, count(*) AS n, list_sort(list(size), 'DESC')[floor(count(*) * 0.3::DOUBLE)::BIGINT + 1] AS least FROM c GROUP BY 1),
    k AS (SELECT c.* FROM c JOIN m USING (document_id) WHERE n <= 3 OR size >= least),
    hd AS (SELECT document_id, title, page AS first_page, greatest(page, coalesce(lead(page) OVER (PARTITION BY document_id ORDER BY place) - 1, pages)) AS last_page FROM k)"""


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir, "document_id", "text", "start_page", "end_page").where("text is not null and start_page is not null")
    last = c.groupBy("document_id").agg(F.max("end_page").alias("pages"))
    return c.select("document_id", _place().alias("place"), F.left("text", F.lit(40)).alias("title"), (F.length("text") % 11 + 8).cast("double").alias("size"), F.col("start_page").alias("page")).join(last, "document_id")


@query(f"WITH {_SIZED} SELECT * FROM hd")
def font_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by the size of headings, which a chunk's length stands for."""
    return layout.font_sections(_sized(spark, sf_dir), "document_id", "place", "title", "size", "page", "pages").select("document_id", "title", "first_page", "last_page")


@query(f"""WITH {_SIZED}, many AS (SELECT document_id FROM hd GROUP BY 1 HAVING count(*) > 1), toc AS ({ORACLE_SQL['toc_ranges']}), tc AS (SELECT * FROM toc WHERE md5(document_id) < '6'), runs AS ({ORACLE_SQL['page_runs']})
    SELECT *, 'contents' AS strategy FROM tc
    UNION ALL SELECT *, 'headings' FROM hd WHERE document_id IN (FROM many) AND document_id NOT IN (SELECT document_id FROM tc)
    UNION ALL SELECT document_id, '' AS title, first_page, last_page, 'pages' FROM runs WHERE document_id NOT IN (SELECT document_id FROM tc) AND document_id NOT IN (FROM many)""")
def choose_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every document by the best strategy; a third of the documents has a table of contents."""
    from .documents import page_runs, toc_ranges

    contents = toc_ranges(spark, sf_dir).where(F.md5("document_id") < "6")
    return layout.choose_sections("document_id", contents, font_sections(spark, sf_dir), page_runs(spark, sf_dir).withColumn("title", F.lit("")))


@query(f"""WITH {_CHUNKS}, s AS (SELECT document_id, split_part(chunk_id, '|', 3)::INT AS place, section_slug, text, coalesce(start_page > 3, false) AS late FROM ch),
    k AS (SELECT * FROM (SELECT *, bool_or(late) OVER (PARTITION BY document_id) AS any_late FROM s) WHERE late OR NOT any_late),
    a AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS n FROM k),
    w AS (SELECT * FROM a WHERE n <= 3 OR i IN (0, 1) OR i = n // 2 OR i = n - 1)
    SELECT document_id, md5(string_agg('## ' || coalesce(section_slug, '') || chr(10) || left(coalesce(text, ''), (4000 // least(n, 4))::INT), chr(10) || chr(10) ORDER BY i)) AS digest FROM w GROUP BY 1""")
def section_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews of all documents, chunks standing for sections."""
    s = _chunks(spark, sf_dir, "document_id", "section_slug", "text", "start_page").withColumn("place", _place())
    return records.section_preview(s, "document_id", "place", "section_slug", "text", "start_page").select("document_id", F.md5("preview").alias("digest"))


@query(f"""WITH {_CHUNKS} SELECT chunk_id, coalesce(section_slug, '') AS section_slug, md5(coalesce(text, '')) AS digest, coalesce(chunk_tier, 'semantic') AS chunk_tier, coalesce(start_page, 1) AS start_page, coalesce(end_page, start_page, 1) AS end_page, coalesce(len(key_terms), 0)::INT AS terms FROM ch""")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks written as JSON and read again, with defaults for what is missing."""
    back = records.from_record(records.to_record(_chunks(spark, sf_dir, "section_slug", "text", "chunk_tier", "start_page", "end_page", "key_terms")))
    return back.select("chunk_id", "section_slug", F.md5("text").alias("digest"), "chunk_tier", "start_page", "end_page", F.size("key_terms").alias("terms"))


@query("""WITH k AS (SELECT feedback_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(feedback_id)) AS h FROM feedback_log WHERE feedback_id IS NOT NULL)
    SELECT DISTINCT feedback_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM k""")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based UUIDs of all feedback rows."""
    return table(spark, sf_dir, "feedback_log").where("feedback_id is not null").select("feedback_id", records.uuid5(F.col("feedback_id")).alias("point_id")).distinct()


@query(f"""WITH {_CHUNKS}, w AS (SELECT chunk_id, list_concat(coalesce(key_terms, []), [section_slug]) AS l FROM ch)
    SELECT chunk_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(l, lambda t: lower(trim(t))), lambda t: t <> '')))[1:10], ',') AS keywords FROM w""")
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key terms and slug of every chunk as one sorted list of ten at most."""
    k = records.top_keywords(F.col("key_terms"), F.array("section_slug"))
    return _chunks(spark, sf_dir, "key_terms", "section_slug").select("chunk_id", F.array_join(k, ",").alias("keywords"))


@query(f"""SELECT 2 AS numeric_columns, 6 AS text_columns, false AS wide, count(*) * 8 AS cells, (count(*) FILTER (WHERE coalesce(trim(doc_id::VARCHAR), '') = '') + count(*) FILTER (WHERE coalesce({_strip('text')}, '') = '') + count(*) FILTER (WHERE coalesce(trim(lang), '') = '')
    + count(*) FILTER (WHERE coalesce(trim(source), '') = '') + count(*) FILTER (WHERE n_chars IS NULL) + count(*) FILTER (WHERE coalesce(trim(knowledge_base_id), '') = '') + count(*) FILTER (WHERE created_at IS NULL) + count(*) FILTER (WHERE received_at IS NULL))::BIGINT AS empty_cells FROM documents""")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by kind and empty cells of the documents table."""
    return records.table_stats(table(spark, sf_dir, "documents"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS lookups, round(avg((event_type = 'click')::INT), 6) AS rate FROM events GROUP BY 1")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of clicks among each day's events."""
    return records.hit_rate(table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"], F.col("event_type") == "click")


@query(f"""WITH {_CHUNKS}, {_RATED}, x AS (SELECT DISTINCT feedback_id, positive, c AS chunk_id FROM (SELECT *, unnest(chunk_ids) AS c FROM f)), v AS (SELECT chunk_id, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS n FROM x GROUP BY 1)
    SELECT ch.chunk_id, coalesce(p, 0) AS positive, coalesce(n, 0) AS negative FROM ch LEFT JOIN v ON v.chunk_id = ch.chunk_id""")
def payload_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks with the counters of the feedback view."""
    c = _chunks(spark, sf_dir).withColumns({"positive": F.lit(None).cast("bigint"), "negative": F.lit(None).cast("bigint")})
    return records.overlay_feedback(c, feedback.by_chunk(table(spark, sf_dir, "feedback_log")), "chunk_id").select("chunk_id", "positive", "negative")


@query(f"WITH {_CHUNKS} SELECT document_id, md5(string_agg('=== Page ' || p.page || ' ===' || chr(10) || p.t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p.page)) AS digest FROM (SELECT document_id, start_page AS page, min(coalesce(section_slug, '')) AS t FROM ch WHERE start_page IS NOT NULL GROUP BY 1, 2) p GROUP BY 1")
def page_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first slug of each page under its number, by document."""
    p = _chunks(spark, sf_dir, "document_id", "start_page", "section_slug").where("start_page is not null").groupBy("document_id", F.col("start_page").alias("page")).agg(F.min(F.coalesce("section_slug", F.lit(""))).alias("t"))
    return records.page_format(p, "document_id", "page", "t").select("document_id", F.md5("text").alias("digest"))
