"""Queries on texts and document structure: parsing, chunking, pages, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout as fl
from ..functions import text as ft
from ..operators import chunking, layout, pages, parsing, sparse
from ..session import spread, table
from .base import query
from .search import _CHUNKS, STOPS, _chunks

#: Whitespace as the engines' patterns know it.
_WS = "[ \\t\\n\\x0B\\f\\r]"
_NORMAL = f"""n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g'), '(?m)^[ \\t]*[-*•][ \\t]+', '- ', 'g'), '[ \\t]+', ' ', 'g') AS t
    FROM documents WHERE text IS NOT NULL)"""
_WORDS = f"list_filter(regexp_split_to_array(COL, '{_WS}+'), lambda w: w <> '')"


#: Outer whitespace of any kind, as a pattern.
_OUTER = "^[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$"


def _strip(col: str) -> str:
    return f"regexp_replace({col}, '{_OUTER}', '', 'g')"


def _words(col: str) -> str:
    return _WORDS.replace("COL", col)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars", "lang").where("text is not null"))


@query(f"WITH {_NORMAL} SELECT doc_id, md5(t) AS digest, length(t) AS n FROM n")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised documents, by digest and length."""
    return _docs(spark, sf_dir).select("doc_id", ft.normalize_text(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


@query(f"SELECT doc_id, floor(len({_words('text')}) * 1.3::DOUBLE)::INT AS by_words, greatest(1, floor(length(text) / 4))::INT AS by_chars FROM documents WHERE text IS NOT NULL")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two token estimates of every document."""
    return _docs(spark, sf_dir).select("doc_id", ft.approx_tokens(F.col("text")).alias("by_words"), ft.quarter_tokens(F.col("text")).alias("by_chars"))


@query(f"""WITH w AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 231) / 184.0))::BIGINT + 1)) AS i FROM w WHERE len(w) > 0)
    SELECT doc_id, i::INT AS idx, md5(array_to_string(w[(184 * i + 1):(184 * i + 231)], ' ')) AS digest FROM i""")
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word windows of every document under the policy of 300 tokens with an overlap of 60."""
    n, step = chunking.window_steps(300, 60)
    w = chunking.windows(ft.words(F.col("text")), F.lit(n), F.lit(step))
    return ft.pieces_of(_docs(spark, sf_dir), ["doc_id"], w, "idx", "piece").select("doc_id", "idx", F.md5("piece").alias("digest"))


@query(f"""WITH {_NORMAL}, s AS (SELECT doc_id, t FROM n WHERE length(t) > 0),
    p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, chr(10) || '{{2,}}'), lambda x: {_strip('x')}), lambda x: x <> '') AS ps FROM s),
    u AS (SELECT doc_id, unnest(ps) AS x, unnest(range(len(ps))) AS pi FROM p),
    a AS (SELECT doc_id, pi, x, {_words('x')} AS w FROM u),
    sem AS (SELECT doc_id, 0 AS mode, pi, 0::BIGINT AS wi, x AS piece FROM a WHERE floor(len(w) * 1.3::DOUBLE) <= 500
        UNION ALL SELECT doc_id, 0, pi, wi, array_to_string(w[(385 * wi + 1):(385 * wi + 385)], ' ') FROM (SELECT *, unnest(range(0, greatest(0, ceil((len(w) - 385) / 385.0))::BIGINT + 1)) AS wi FROM a WHERE floor(len(w) * 1.3::DOUBLE) > 500)),
    d AS (SELECT doc_id, {_words('t')} AS w FROM s),
    win AS (SELECT doc_id, 1 AS mode, 0::BIGINT AS pi, wi, array_to_string(w[(308 * wi + 1):(308 * wi + 308)], ' ') AS piece FROM (SELECT *, unnest(range(0, greatest(0, ceil((len(w) - 308) / 308.0))::BIGINT + 1)) AS wi FROM d)),
    big AS (SELECT doc_id FROM d WHERE floor(len(w) * 1.3::DOUBLE) > 15000),
    al AS (SELECT * FROM (SELECT * FROM sem WHERE doc_id NOT IN (SELECT doc_id FROM big) UNION ALL SELECT * FROM win UNION ALL SELECT doc_id, 0, pi, wi, piece FROM win WHERE doc_id IN (SELECT doc_id FROM big)) WHERE {_strip('piece')} <> ''),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mode, pi, wi) AS chunk_no, floor(len({_words('piece')}) * 1.3::DOUBLE)::INT AS token_count FROM al),
    k AS (SELECT doc_id::VARCHAR AS document_id, mode, chunk_no, piece, token_count FROM o WHERE token_count <= 500)
    SELECT document_id || '|body|' || chunk_no AS chunk_id, CASE mode WHEN 0 THEN 'semantic' ELSE 'window' END AS chunk_tier, token_count, md5(piece) AS digest,
           lag(document_id || '|body|' || chunk_no) OVER (PARTITION BY document_id ORDER BY chunk_no) AS prev_chunk_id FROM k""")
def generate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document under the default policy, with their chain."""
    src = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("section_ord"), F.lit("body").alias("section_slug"), "text", F.lit("default").alias("schema"))
    c = chunking.generate_chunks(chunking.resolve_policies(src, "schema"), whole=True)
    return c.select("chunk_id", "chunk_tier", "token_count", F.md5("text").alias("digest"), "prev_chunk_id")


@query()
def policy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all chunk texts as sections, under the policy of their document's schema."""
    s = table(spark, sf_dir, "submissions").groupBy("document_id").agg(F.max("schema_name").alias("schema_name"))
    src = _chunks(spark, sf_dir, "document_id", "section_slug", "text").join(s, "document_id", "left").withColumn("section_ord", F.element_at(F.split("chunk_id", r"\|"), 3).cast("int"))
    return chunking.generate_chunks(chunking.resolve_policies(src, "schema_name", "section_slug")).drop("text")


@query(f"""WITH t AS (SELECT doc_id, replace(text, 'The ', 'Criterion A. The ') AS t FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, regexp_split_to_array(regexp_replace(t, '(?i)(criterion{_WS}+[a-z0-9]+\\.?{_WS})', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM t),
    f AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: {_strip('p')}), lambda p: p <> '') AS parts FROM s),
    u AS (SELECT doc_id, unnest(parts) AS p, unnest(range(len(parts))) AS idx FROM f)
    SELECT doc_id, idx::INT AS idx, md5(p) AS digest FROM u""")
def criteria_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut before each criterion."""
    t = F.replace("text", F.lit("The "), F.lit("Criterion A. The "))
    return ft.pieces_of(_docs(spark, sf_dir), ["doc_id"], chunking.criteria(t), "idx", "p").select("doc_id", "idx", F.md5("p").alias("digest"))


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\\n.]+'), lambda x: {_strip('x')}), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, unnest(ps) AS x, unnest(range(len(ps))) AS place FROM p),
    h AS (SELECT * FROM u WHERE contains(lower(x), 'safety plan') OR contains(lower(x), 'carta de alta') OR (x = upper(x) AND x <> lower(x)))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS idx, md5(x) AS digest FROM h""")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and sentences of documents with a wanted phrase or in capitals."""
    parts = chunking.highlights(F.col("text"), F.array(F.lit("safety plan"), F.lit("Carta de alta")))
    return ft.pieces_of(_docs(spark, sf_dir), ["doc_id"], parts, "idx", "p").select("doc_id", "idx", F.md5("p").alias("digest"))


@query()
def pack_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed greedily by paragraphs."""
    return chunking.pack_paragraphs(_docs(spark, sf_dir), "doc_id", "text", 120, 200)


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{4,}}') AS w FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM w),
    c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM p WHERE term NOT IN ({STOPS}) GROUP BY ALL)
    SELECT doc_id, term, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 10""")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent terms of each document."""
    return sparse.top_terms(_docs(spark, sf_dir), "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), 10)


@query(f"""WITH t AS (SELECT doc_id, {_strip('text')} AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, left(coalesce(nullif(regexp_extract(t, '(?s)^(.*?[.!?]){_WS}', 1), ''), t), 200) AS summary FROM t""")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of every document."""
    return _docs(spark, sf_dir).select("doc_id", ft.first_sentence(F.col("text")).alias("summary"))


@query(f"""WITH {_CHUNKS} SELECT chunk_id, coalesce(nullif(summary, ''), left(text, 200)) AS snippet, start_page::VARCHAR || '-' || end_page::VARCHAR AS pages FROM ch""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippet and pages of every chunk."""
    return _chunks(spark, sf_dir, "summary", "text", "start_page", "end_page").select("chunk_id", ft.snippet(F.col("summary"), F.col("text")).alias("snippet"), ft.page_span(F.col("start_page"), F.col("end_page")).alias("pages"))


@query(f"""WITH {_CHUNKS}, s AS (SELECT *, split_part(chunk_id, '|', 3)::INT AS chunk_no FROM ch WHERE start_page IS NOT NULL),
    e AS (SELECT document_id, unnest(range(start_page, greatest(start_page, coalesce(end_page, start_page)) + 1)) AS page, chunk_no, chunk_id, text FROM s)
    SELECT document_id, e.page::INT AS page, document_id || '_page' || e.page AS page_id, array_to_string(list_sort(list(DISTINCT chunk_id)), ',') AS chunk_ids,
           md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY chunk_no, chunk_id) FILTER (WHERE trim(text) <> ''), '')) AS digest FROM e GROUP BY document_id, e.page""")
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands on every page of every document."""
    c = _chunks(spark, sf_dir, "document_id", "start_page", "end_page", "text").withColumn("chunk_no", F.element_at(F.split("chunk_id", r"\|"), 3).cast("int"))
    return pages.page_documents(c).select("document_id", "page", "page_id", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.md5("text").alias("digest"))


@query(f"""WITH {_CHUNKS}, c AS (SELECT document_id, chunk_id, unnest(range(start_page, greatest(start_page, coalesce(end_page, start_page)) + 1)) AS page FROM ch WHERE start_page IS NOT NULL),
    v AS (SELECT document_id, chunk_id AS visual_id, start_page AS page FROM ch WHERE chunk_tier = 'criteria' AND start_page IS NOT NULL)
    SELECT DISTINCT c.document_id, c.chunk_id, v.visual_id FROM c JOIN v ON c.document_id = v.document_id AND abs(c.page - v.page) <= 1""")
def visual_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks linked with the set-off blocks within a page of them."""
    c = _chunks(spark, sf_dir, "document_id", "start_page", "end_page", "chunk_tier")
    v = c.where("chunk_tier = 'criteria'").select("document_id", F.col("chunk_id").alias("visual_id"), F.col("start_page").alias("page"))
    return pages.visual_links(c, v, "document_id", "chunk_id", "visual_id")


_BOXES = f"""{_CHUNKS}, b AS (SELECT document_id, chunk_id, regexp_extract(bbox_pointer, '^p(\\d+):(\\d+),(\\d+)$', 1)::INT AS page, regexp_extract(bbox_pointer, '^p(\\d+):(\\d+),(\\d+)$', 2)::DOUBLE AS x0, regexp_extract(bbox_pointer, '^p(\\d+):(\\d+),(\\d+)$', 3)::DOUBLE AS y1
    FROM ch WHERE regexp_matches(bbox_pointer, '^p\\d+:\\d+,\\d+$'))"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = r"^p(\d+):(\d+),(\d+)$"
    part = lambda i, kind: F.regexp_extract("bbox_pointer", p, i).cast(kind)
    return _chunks(spark, sf_dir, "document_id", "bbox_pointer", "text").where(F.col("bbox_pointer").rlike(p)).select("document_id", "chunk_id", part(1, "int").alias("page"), part(2, "double").alias("x0"), part(3, "double").alias("y1"), "text")


@query(f"""WITH {_BOXES} SELECT document_id, page, chunk_id, (row_number() OVER w)::INT AS ord, lag(chunk_id) OVER w AS prev, lead(chunk_id) OVER w AS next FROM b
    WINDOW w AS (PARTITION BY document_id ORDER BY page, y1 DESC, x0, chunk_id)""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a document in the order their boxes are read."""
    return layout.reading_order(_boxes(spark, sf_dir), ["document_id", "page"], "chunk_id", ["document_id"])


@query(f"""WITH {_BOXES}, s AS (SELECT *, (x0 - lag(x0) OVER (PARTITION BY document_id, page ORDER BY x0) > 20) AS gap FROM b),
    r AS (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY document_id, page ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS c FROM s),
    g AS (SELECT document_id, page, c, count(*) AS n FROM r GROUP BY ALL)
    SELECT document_id, page, count(*) FILTER (WHERE n >= 2) AS columns, sum(n)::BIGINT AS blocks,
           CASE count(*) FILTER (WHERE n >= 2) WHEN 0 THEN 'unknown' WHEN 1 THEN 'single' WHEN 2 THEN 'double' ELSE 'multi' END AS layout FROM g GROUP BY 1, 2""")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of every page from the left edges of its boxes."""
    return layout.page_columns(_boxes(spark, sf_dir), ["document_id", "page"])


_LINES = """l AS (SELECT l_orderkey AS page, l_linenumber AS item, l_quantity AS x0, l_linenumber * 10.0::DOUBLE AS y0, l_quantity + 10 + l_discount * 100 AS x1, l_linenumber * 10.0::DOUBLE + 5 + l_tax * 100 AS y1
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)"""


@query(f"""WITH {_LINES}, p AS (SELECT a.page, a.item, b.item AS b, a.x0 AS ax0, a.x1 AS ax1, a.y0 AS ay0, a.y1 AS ay1, b.x0 AS bx0, b.x1 AS bx1, b.y0 AS by0, b.y1 AS by1,
        greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) AS ox, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) AS oy
        FROM l a JOIN l b ON a.page = b.page AND a.item <> b.item),
    e AS (SELECT page, item, b, 'above' AS relation, by0 - ay1 AS gap FROM p WHERE ox >= 0.5 AND by0 >= ay1 UNION ALL SELECT page, item, b, 'below', ay0 - by1 FROM p WHERE ox >= 0.5 AND by1 <= ay0
        UNION ALL SELECT page, item, b, 'left', ax0 - bx1 FROM p WHERE oy >= 0.5 AND bx1 <= ax0 UNION ALL SELECT page, item, b, 'right', bx0 - ax1 FROM p WHERE oy >= 0.5 AND bx0 >= ax1)
    SELECT page, item, relation, b AS neighbour FROM e QUALIFY row_number() OVER (PARTITION BY page, item, relation ORDER BY gap, b) = 1""")
def spatial_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest block on each side, order lines standing for blocks of a page."""
    y = F.col("l_linenumber") * F.lit(10.0)
    src = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("item")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", y.alias("y"))).alias("s"))
    box = src.select("page", "item", F.col("s.l_quantity").alias("x0"), F.col("s.y").alias("y0"), (F.col("s.l_quantity") + 10 + F.col("s.l_discount") * 100).alias("x1"), (F.col("s.y") + 5 + F.col("s.l_tax") * 100).alias("y1"))
    return layout.spatial_edges(box, ["page"], "item")


@query(f"""WITH {_CHUNKS}, c AS (SELECT document_id, chunk_id, split_part(chunk_id, '|', 3)::INT AS place, chunk_tier = 'criteria' AS h FROM ch)
    SELECT document_id, chunk_id, parent FROM (SELECT *, last_value(CASE WHEN h THEN chunk_id END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY place, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM c) WHERE NOT h""")
def heading_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last set-off block before each chunk."""
    c = _chunks(spark, sf_dir, "document_id", "chunk_tier").withColumn("place", F.element_at(F.split("chunk_id", r"\|"), 3).cast("int")).withColumn("h", F.col("chunk_tier") == "criteria")
    return layout.heading_parent(c.where("h is not null"), ["document_id"], "chunk_id", ["place", "chunk_id"], "h")


_FIRST = "f AS (SELECT doc_id, source, trim(split_part(text, chr(10), 1)) AS line, (n_chars % 20)::DOUBLE AS size FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {_FIRST}, m AS (SELECT source, list_sort(list(size))[(count(*) // 2 + 1)::BIGINT] AS median FROM f GROUP BY 1),
    w AS (SELECT f.*, median, list_filter(regexp_split_to_array(line, '{_WS}+'), lambda x: x <> '') AS ws FROM f JOIN m ON f.source IS NOT DISTINCT FROM m.source)
    SELECT doc_id, (size > median * 1.2)::DOUBLE * 3.0::DOUBLE + (length(line) < 100)::INT * 1.0
        + ((line = upper(line) AND line <> lower(line) AND length(line) > 3) OR (len(ws) > 0 AND len(list_filter(ws, lambda x: regexp_matches(left(x, 1), '\\p{{Lu}}'))) / greatest(len(ws), 1) >= 0.6))::INT * 1.0
        + 2.0 + regexp_matches(line, '(?i)^(\\d+\\.?{_WS}+|\\d+\\.\\d+\\.?{_WS}+|\\d+\\.\\d+\\.\\d+\\.?{_WS}+|[IVXLCDM]+\\.?{_WS}+|[A-Z]\\.?{_WS}+|Chapter{_WS}+\\d+|Section{_WS}+\\d+|Part{_WS}+\\d+|Appendix{_WS}+[A-Z])')::INT * 2.5 AS score FROM w""")
def heading_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the first line of each document looks like a heading, its size against the median of its source."""
    f = _docs(spark, sf_dir).select("doc_id", "source", F.trim(F.element_at(F.split("text", "\n"), 1)).alias("line"), (F.col("n_chars") % 20).cast("double").alias("size"))
    m = layout.upper_median(f, ["source"], "size").withColumnRenamed("source", "s")
    j = f.join(m, F.col("source").eqNullSafe(F.col("s")))
    return j.select("doc_id", fl.heading_score(F.col("line"), F.col("size"), F.col("median"), F.lit(False), F.lit(0.0)).alias("score"))


@query("""WITH s AS (SELECT document_id, submitted_at, length(document_title) AS size FROM submissions WHERE document_title IS NOT NULL), d AS (SELECT DISTINCT knowledge_base_id, document_id, length(document_title) AS size FROM submissions WHERE document_title IS NOT NULL AND knowledge_base_id IS NOT NULL)
    SELECT knowledge_base_id, document_id, least(dense_rank() OVER (PARTITION BY knowledge_base_id ORDER BY size DESC), 6)::INT AS level FROM d""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of headings by size, titles standing for headings of their knowledge base."""
    d = table(spark, sf_dir, "submissions").where("document_title is not null and knowledge_base_id is not null").select("knowledge_base_id", "document_id", F.length("document_title").alias("size")).distinct()
    return layout.heading_levels(d, "knowledge_base_id", "document_id", "size")


@query(f"""WITH {_CHUNKS}, c AS (SELECT document_id, split_part(chunk_id, '|', 3)::INT AS place, coalesce(chunk_tier = 'criteria', false) AS h, section_slug, start_page FROM ch),
    i AS (SELECT *, sum(h::INT) OVER (PARTITION BY document_id ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM c)
    SELECT document_id, section, max(CASE WHEN h THEN coalesce(section_slug, '') END) AS title, coalesce(string_agg(coalesce(section_slug, ''), chr(10) || chr(10) ORDER BY place) FILTER (WHERE NOT h), '') AS text, min(start_page) AS first_page, max(start_page) AS last_page
    FROM i GROUP BY 1, 2""")
def section_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each document, every set-off block beginning one."""
    c = _chunks(spark, sf_dir, "document_id", "chunk_tier", "section_slug", "start_page")
    e = c.select("document_id", F.element_at(F.split("chunk_id", r"\|"), 3).cast("int").alias("place"), F.coalesce(F.col("chunk_tier") == "criteria", F.lit(False)).alias("h"), F.coalesce("section_slug", F.lit("")).alias("slug"), "start_page")
    return parsing.section_islands(e, "document_id", "place", "h", "slug", "start_page")


@query(f"""WITH {_CHUNKS}, t AS (SELECT document_id, split_part(chunk_id, '|', 3)::INT AS place, split_part(chunk_id, '|', 3)::INT % 3 + 1 AS level, coalesce(section_slug, '') AS title, start_page AS page FROM ch WHERE start_page IS NOT NULL),
    p AS (SELECT document_id, max(end_page) AS pages FROM ch GROUP BY 1), o AS (SELECT t.*, p.pages FROM t JOIN p USING (document_id) WHERE level <= 2)
    SELECT document_id, title, page AS first_page, greatest(page, coalesce(lead(page) OVER (PARTITION BY document_id ORDER BY place) - 1, pages))::INT AS last_page FROM o
    UNION ALL SELECT document_id, 'Introduction', 1, (min(page) - 1)::INT FROM o GROUP BY 1 HAVING min(page) > 1""")
def toc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges of contents entries, chunks standing for entries."""
    c = _chunks(spark, sf_dir, "document_id", "section_slug", "start_page", "end_page")
    p = c.groupBy("document_id").agg(F.max("end_page").alias("pages"))
    place = F.element_at(F.split("chunk_id", r"\|"), 3).cast("int")
    t = c.where("start_page is not null").select("document_id", place.alias("place"), (place % 3 + 1).alias("level"), F.coalesce("section_slug", F.lit("")).alias("title"), F.col("start_page").alias("page")).join(p, "document_id")
    return parsing.toc_ranges(t, "document_id", "place", "level", "title", "page", "pages")


@query("""WITH p AS (SELECT document_id, max(end_page) AS pages FROM chunks GROUP BY 1), s AS (SELECT *, CASE WHEN pages <= 50 THEN 5 WHEN pages <= 200 THEN 10 ELSE 10 END AS step FROM p WHERE pages > 0),
    u AS (SELECT document_id, pages, step, unnest(range(1, pages + 1, step)) AS f FROM s)
    SELECT document_id, f::INT AS first_page, least(f + step - 1, pages)::INT AS last_page FROM u""")
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut by their number of pages."""
    return parsing.page_runs(table(spark, sf_dir, "chunks").groupBy("document_id").agg(F.max("end_page").alias("pages")), "document_id", "pages")


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped in markup and read back by the HTML parser."""
    page = F.concat(F.lit("<html><body><p>"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))
    return parsing.html_text(_docs(spark, sf_dir).withColumn("html", page), "doc_id", "html")


@query("""WITH s AS (SELECT doc_id, text, source, lower(text[:256]) AS h FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, CASE WHEN text LIKE '%PDF-%' AND starts_with(text, '%PDF-') THEN 'application/pdf' WHEN contains(left(text, 256), '<html') OR contains(left(text, 256), '<body') THEN 'text/html'
        WHEN regexp_matches(decode(array_slice(encode(text), 1, 256)), '^[\\x20-\\x7e\\t\\n\\r]*$') THEN 'text/plain' ELSE 'application/octet-stream' END AS content_type FROM s)
    SELECT doc_id, content_type, CASE content_type WHEN 'application/pdf' THEN 'pdf' WHEN 'text/html' THEN 'html' WHEN 'text/plain' THEN 'plain_text' END AS parser FROM t""".replace("regexp_matches(decode(array_slice(encode(text), 1, 256)), '^[\\x20-\\x7e\\t\\n\\r]*$')", "regexp_matches(left(text, 256), '^[\\x20-\\x7e\\t\\n\\r]*$')"))
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content type and parser of every document's bytes."""
    d = _docs(spark, sf_dir).select("doc_id", ft.content_type(F.encode("text", "UTF-8"), F.lit(None).cast("string")).alias("content_type"))
    return d.withColumn("parser", ft.parser_for(F.col("content_type")))
