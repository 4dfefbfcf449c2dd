"""Further queries on result lists, page layout, keywords and typed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, chunking, feedback, layout, records, telemetry, vectors
from ..session import table
from .base import query
from .documents import _BOXES, _boxes, _docs, _strip, _words
from .search import _CHUNKS, _LISTS, _RATED, _chunks, _two_lists


@query(f"""{_LISTS}, m AS (SELECT query_vec_id, track, avg(score) AS m, stddev_samp(score) AS s FROM l GROUP BY 1, 2)
    SELECT query_vec_id, vec_id, round(sum(CASE WHEN s > 1e-9 THEN greatest(0::DOUBLE, least(1::DOUBLE, (score - m) / (6 * s) + 0.5::DOUBLE)) ELSE 0.5::DOUBLE END), 6) AS score
    FROM l JOIN m USING (query_vec_id, track) GROUP BY 1, 2""")
def dbsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of two lists by where a score stands in its list's distribution."""
    return vectors.dbsf(_two_lists(spark, sf_dir), "query_vec_id", "vec_id", "track")


#: The chunk lists of the feedback log as ranked results.
_LISTED = f"""{_RATED}, li AS (SELECT feedback_id, c AS chunk_id, min(p) AS rank FROM (SELECT feedback_id, unnest(chunk_ids) AS c, unnest(range(len(chunk_ids))) AS p FROM f) WHERE c IS NOT NULL GROUP BY 1, 2)"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = feedback.current_feedback(table(spark, sf_dir, "feedback_log")).select("feedback_id", F.posexplode("chunk_ids").alias("p", "chunk_id"))
    return log.where("chunk_id is not null").groupBy("feedback_id", "chunk_id").agg(F.min("p").alias("rank"))


@query(f"""WITH {_CHUNKS}, {_LISTED}, w AS (SELECT feedback_id, prev_chunk_id AS chunk_id, min(rank) AS rank FROM li JOIN ch USING (chunk_id) WHERE requires_previous AND prev_chunk_id IS NOT NULL GROUP BY 1, 2),
    a AS (SELECT * FROM w WHERE chunk_id IN (SELECT chunk_id FROM ch) AND NOT EXISTS (FROM li WHERE li.feedback_id = w.feedback_id AND li.chunk_id = w.chunk_id)),
    b AS (SELECT *, false AS stitched FROM li UNION ALL SELECT *, true FROM a)
    SELECT feedback_id, chunk_id, row_number() OVER (PARTITION BY feedback_id ORDER BY rank, stitched DESC, chunk_id) AS place, stitched FROM b""")
def stitch_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rated result lists with the chunks their results need before them."""
    return vectors.stitch_previous(_listed(spark, sf_dir), _chunks(spark, sf_dir, "prev_chunk_id", "requires_previous"), "feedback_id", "chunk_id")


@query(f"""WITH {_CHUNKS}, {_LISTED} SELECT feedback_id, chunk_id, rank FROM li JOIN ch USING (chunk_id)
    QUALIFY row_number() OVER (PARTITION BY feedback_id, document_id, section_slug, chunk_tier ORDER BY rank, chunk_id) = 1""")
def distinct_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rated result lists with one result for each section."""
    both = _listed(spark, sf_dir).join(_chunks(spark, sf_dir, "document_id", "section_slug", "chunk_tier"), "chunk_id")
    return vectors.distinct_sections(both, "feedback_id", "chunk_id", ["document_id", "section_slug", "chunk_tier"]).select("feedback_id", "chunk_id", "rank")


@query(f"""WITH {_CHUNKS} SELECT chunk_id FROM ch WHERE coalesce(knowledge_base_id <> '', false) AND NOT coalesce(chunk_tier = 'window', false)
    AND (coalesce(requires_previous, false) OR coalesce(len(list_filter(key_terms, lambda k: k LIKE 's%' AND length(k) > 5)) > 0, false))""")
def clause_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by clauses that must, should and must not hold, one of them nested in the key terms."""
    nested = F.exists("key_terms", lambda k: F.coalesce(k.like("s%") & (F.length(k) > 5), F.lit(False)))
    test = vectors.clauses(must=[F.col("knowledge_base_id") != ""], should=[F.col("requires_previous"), nested], must_not=[F.col("chunk_tier") == "window"])
    return _chunks(spark, sf_dir, "knowledge_base_id", "requires_previous", "key_terms", "chunk_tier").where(test).select("chunk_id")


@query(f"""WITH {_RATED}, x AS (SELECT DISTINCT feedback_id, positive, c AS chunk_id FROM (SELECT *, unnest(chunk_ids) AS c FROM f)),
    v AS (SELECT chunk_id, count(*) FILTER (WHERE positive) AS positive, count(*) FILTER (WHERE NOT positive) AS negative FROM x WHERE chunk_id IS NOT NULL GROUP BY 1)
    SELECT * FROM v WHERE negative >= 2 AND negative > positive""")
def repeat_downvotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that users keep voting down."""
    return feedback.repeat_downvotes(table(spark, sf_dir, "feedback_log"))


@query(f"""WITH {_CHUNKS}, e AS (SELECT document_id, split_part(chunk_id, '|', 3)::INT AS place, chunk_id, trim(t) AS w, p FROM (SELECT *, unnest(key_terms) AS t, unnest(range(len(key_terms))) AS p FROM ch) WHERE trim(t) <> ''),
    c AS (SELECT document_id, lower(w) AS low, count(*) AS n, min((place, chunk_id, p, w)) AS f FROM e GROUP BY 1, 2),
    r AS (SELECT document_id, n, f, low, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, f, low) AS i FROM c)
    SELECT document_id, string_agg(struct_extract(f, 4), ',' ORDER BY i) AS keywords FROM r WHERE i <= 5 GROUP BY 1""")
def document_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five key terms that most chunks of a document have."""
    c = _chunks(spark, sf_dir, "document_id", "key_terms").withColumn("place", F.element_at(F.split("chunk_id", r"\|"), 3).cast("int"))
    return catalog.frequent_keywords(c, "document_id", "key_terms", ["place", "chunk_id"], 5).select("document_id", F.array_join("keywords", ",").alias("keywords"))


@query("""SELECT event_type, count(*) AS n, list_sort(list(value))[greatest(floor(0.95::DOUBLE * count(*))::BIGINT - 1, 0) + 1] AS p95 FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1""")
def truncated_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of each kind of event, by a truncated place."""
    return telemetry.truncated_p95(table(spark, sf_dir, "events"), ["event_type"], "value")


@query(f"""WITH {_BOXES}, x AS (SELECT document_id, page, x0, x0 + 40 + coalesce(length(ch.text), 0) % 200 AS x1 FROM b JOIN ch USING (document_id, chunk_id)),
    s AS (SELECT *, coalesce(x0 - lag(x0) OVER (PARTITION BY document_id, page ORDER BY x0) > 20, true)::INT AS gap FROM x),
    r AS (SELECT *, sum(gap) OVER (PARTITION BY document_id, page ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS c FROM s),
    g AS (SELECT document_id, page, c, min(x0) AS lo, max(x0) AS hi, max(x1) AS e, count(*) AS a, count(*) FILTER (WHERE x0 >= 0) AS inr, count(*) FILTER (WHERE x0 <= 612) AS inl FROM r GROUP BY 1, 2, 3),
    h AS (SELECT *, lag(hi) OVER w AS before, lead(lo) OVER w AS behind FROM g WINDOW w AS (PARTITION BY document_id, page ORDER BY c)),
    k AS (SELECT document_id, page, CASE WHEN before IS NULL AND behind IS NOT NULL THEN inr WHEN behind IS NULL AND before IS NOT NULL THEN inl ELSE a END AS n,
        CASE WHEN before IS NULL AND behind IS NULL THEN e - lo WHEN before IS NULL THEN (hi + behind) / 2 WHEN behind IS NULL THEN 612 - (before + lo) / 2 ELSE (hi + behind) / 2 - (before + lo) / 2 END AS w FROM h),
    v AS (SELECT document_id, page, count(*) AS columns, 0.6::DOUBLE / (1 + var_pop(n) / (avg(n) + 1)) + 0.4::DOUBLE / (1 + var_pop(w) / (avg(w) + 1)) AS f FROM k WHERE n >= 2 GROUP BY 1, 2)
    SELECT p.document_id, p.page, coalesce(v.columns, 0) AS columns, round(CASE WHEN f IS NULL THEN 0 ELSE greatest(0, least(1, f)) END, 6) AS confidence FROM (SELECT DISTINCT document_id, page FROM b) p LEFT JOIN v ON v.document_id = p.document_id AND v.page = p.page""")
def column_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure the columns of every page are; a box is as wide as its text's length says."""
    x1 = F.col("x0") + 40 + F.coalesce(F.length("text"), F.lit(0)) % 200
    return layout.column_confidence(_boxes(spark, sf_dir).withColumn("x1", x1), ["document_id", "page"])


@query(f"""WITH {_CHUNKS}, b AS (SELECT document_id, chunk_id, CASE WHEN coalesce(chunk_tier = 'criteria', false) THEN 'heading' ELSE 'text' END AS type, start_page AS page, {_strip('text')} AS t FROM ch WHERE {_strip('text')} <> ''),
    s AS (SELECT DISTINCT document_id, document_title AS t FROM submissions WHERE document_id IS NOT NULL),
    v AS (SELECT DISTINCT chunk_id, split_part(chunk_id, '|', 1) AS document_id FROM vectors WHERE track = 'vision' AND chunk_id IS NOT NULL)
    SELECT document_id, chunk_id, type, page, md5(t) AS digest, len({_words('t')})::INT AS tokens FROM b
    UNION ALL SELECT document_id, document_id || '_table_p1_' || (row_number() OVER (PARTITION BY document_id ORDER BY t NULLS FIRST) - 1), 'table', 1, md5(coalesce(t, '')), len({_words("coalesce(t, '')")})::INT FROM s
    UNION ALL SELECT document_id, document_id || '_image_p1_' || (row_number() OVER (PARTITION BY document_id ORDER BY chunk_id) - 1), 'image', 1, md5(chunk_id), 0 FROM v""")
def typed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as blocks, titles as tables and vision vectors as images, in one table."""
    blocks = _chunks(spark, sf_dir, "document_id", "chunk_tier", "start_page", "text").select("document_id", F.col("chunk_id").alias("block_id"), F.col("start_page").alias("page"), "text", (F.col("chunk_tier") == "criteria").alias("is_heading"))
    titles = table(spark, sf_dir, "submissions").where("document_id is not null").select("document_id", F.lit(1).alias("page"), F.col("document_title").alias("place"), F.col("document_title").alias("markdown")).distinct()
    seen = table(spark, sf_dir, "vectors").where("track = 'vision' and chunk_id is not null").select("chunk_id").distinct()
    images = seen.select(F.element_at(F.split("chunk_id", r"\|"), 1).alias("document_id"), F.lit(1).alias("page"), F.col("chunk_id").alias("place"), F.lit("").alias("ocr_text"), F.col("chunk_id").alias("caption"))
    return records.typed_chunks(blocks, titles, images).select("document_id", "chunk_id", "type", "page", F.md5("text").alias("digest"), "tokens")


@query()
def token_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of every document, ended at good breaks."""
    return chunking.token_slices(_docs(spark, sf_dir), "doc_id", "text", 300, 60).select("doc_id", "slice_no", F.md5("text").alias("digest"))
