"""Queries on the platform's logs and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import catalog, feedback, telemetry, vectors
from ..session import table
from .base import query
from .search import _CHUNKS, _RATED, _chunks

_KEY = "trim(regexp_replace(lower(query_text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_AGG = """sum(CASE WHEN positive THEN W ELSE 0 END)::BIGINT AS positive, sum(CASE WHEN NOT positive THEN W ELSE 0 END)::BIGINT AS negative,
    round(sum(CASE WHEN positive THEN W ELSE 0 END)::DOUBLE / sum(W), 6) AS ratio, sum(CASE WHEN positive THEN W ELSE -W END)::BIGINT AS score,
    arg_max(trim(comment_text), (given_at, feedback_id)) FILTER (WHERE trim(comment_text) <> '') AS last_comment, epoch_us(max(given_at)) AS last_us"""


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("last_us", F.unix_micros("last_at")).drop("last_at")


@query(f"WITH {_RATED} SELECT {_KEY} AS query, {_AGG.replace('W', '1').replace('1HEN', 'WHEN').replace('1HERE', 'WHERE')} FROM f WHERE {_KEY} <> '' GROUP BY 1")
def feedback_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by query."""
    return _plain(feedback.by_query(table(spark, sf_dir, "feedback_log")))


@query(f"""WITH {_RATED}, x AS (SELECT DISTINCT feedback_id, positive, comment_text, given_at, c AS chunk_id FROM (SELECT *, unnest(chunk_ids) AS c FROM f))
    SELECT chunk_id, {_AGG.replace('W', '1').replace('1HEN', 'WHEN').replace('1HERE', 'WHERE')} FROM x WHERE chunk_id IS NOT NULL GROUP BY 1""")
def feedback_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by chunk."""
    return _plain(feedback.by_chunk(table(spark, sf_dir, "feedback_log")))


@query(f"""WITH {_RATED}, x AS (SELECT *, strftime(given_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, greatest(1, len(coalesce(chunk_ids, []))) AS n FROM f)
    SELECT day, {_AGG.replace('W', 'n').replace('nHEN', 'WHEN').replace('nHERE', 'WHERE')} FROM x GROUP BY 1""")
def feedback_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by day, weighed by chunks."""
    log = table(spark, sf_dir, "feedback_log").withColumn("day", F.date_format("given_at", "yyyy-MM-dd"))
    return _plain(feedback.totals(log, ["day"]))


@query(f"""WITH {_RATED}, d AS (SELECT strftime(given_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, positive::INT AS p FROM f), g AS (SELECT day, sum(p) AS p, count(*) AS n FROM d GROUP BY 1)
    SELECT day, sum(p) OVER (ORDER BY day)::BIGINT AS positive, (sum(n) OVER (ORDER BY day) - sum(p) OVER (ORDER BY day))::BIGINT AS negative FROM g""")
def feedback_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of verdicts by day; days are few, so their one window is small."""
    from pyspark.sql import Window

    log = feedback.current_feedback(table(spark, sf_dir, "feedback_log"))
    days = log.groupBy(F.date_format("given_at", "yyyy-MM-dd").alias("day")).agg(F.count_if("positive").alias("p"), F.count("*").alias("n"))
    w = Window.orderBy("day")
    return days.select("day", F.sum("p").over(w).alias("positive"), (F.sum("n").over(w) - F.sum("p").over(w)).alias("negative"))


@query(f"SELECT feedback_id, {_KEY} AS query, left(sha256({_KEY}), 16) AS cache_key FROM feedback_log")
def query_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised queries and their cache keys."""
    q = F.col("query_text")
    return table(spark, sf_dir, "feedback_log").select("feedback_id", ft.query_key(q).alias("query"), ft.cache_key(q).alias("cache_key"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency by kind of event."""
    return telemetry.latency_summary(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""WITH b AS (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 'inf'::DOUBLE]) AS bound, unnest(['0.01', '0.05', '0.1', '0.25', '0.5', '1.0', '2.5', '+Inf']) AS le)
    SELECT event_type, le, count(*) FILTER (WHERE value / 10 <= bound) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1, 2""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative latency buckets by kind of event."""
    return telemetry.histogram(table(spark, sf_dir, "events"), ["event_type"], F.col("value") / 10)


@query("""SELECT epoch(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL
    GROUP BY 1 HAVING round(quantile_cont(value, 0.95), 6) > 25""")
def alert_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours with a high 95th percentile."""
    return telemetry.alert_windows(table(spark, sf_dir, "events"), "ts", "value", "6 hours", 25.0).withColumn("start", F.unix_seconds(F.col("start").cast("timestamp")))


@query("""WITH w AS (SELECT epoch(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1)
    SELECT start, n, failures, round(failures::DOUBLE / n, 6) AS rate FROM w WHERE round(failures::DOUBLE / n, 6) > 0.2""")
def error_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with many errors."""
    return telemetry.error_windows(table(spark, sf_dir, "events"), "ts", F.col("event_type") == "error", "1 hour", 0.2).withColumn("start", F.unix_seconds(F.col("start").cast("timestamp")))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum((props->>'$.k')::INT)::BIGINT AS total_k FROM events GROUP BY 1""")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of events with a value from their JSON properties."""
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999")).cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum(k).alias("total_k"))


_JOBS = """j AS (SELECT *, row_number() OVER (PARTITION BY job_id, document_id ORDER BY updated_at DESC NULLS LAST, chunk_count DESC NULLS LAST, status DESC NULLS LAST) AS nth FROM job_documents WHERE job_id IS NOT NULL AND document_id IS NOT NULL)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(table(spark, sf_dir, "job_documents").where("job_id is not null and document_id is not null"), ["job_id", "document_id"], "updated_at", "chunk_count", "status")


@query(f"WITH {_JOBS} SELECT job_id, document_id, status, coalesce(chunk_count, -1)::INT AS chunk_count, parser, epoch_us(updated_at) AS updated_us FROM j WHERE nth = 1")
def job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of every job's document."""
    return _jobs(spark, sf_dir).select("job_id", "document_id", "status", F.coalesce("chunk_count", F.lit(-1)).alias("chunk_count"), "parser", F.unix_micros("updated_at").alias("updated_us"))


@query(f"""WITH {_JOBS} SELECT job_id, count(*) AS documents, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed, coalesce(sum(chunk_count), 0)::BIGINT AS chunks,
    string_agg(error_note, '; ' ORDER BY document_id) AS errors FROM j WHERE nth = 1 GROUP BY 1""")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, chunks and error notes of every job."""
    note = F.array_sort(F.collect_list(F.when(F.col("error_note").isNotNull(), F.struct("document_id", "error_note"))))
    return _jobs(spark, sf_dir).groupBy("job_id").agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("bigint").alias("chunks"), F.nullif(F.array_join(F.transform(note, lambda x: x["error_note"]), "; "), F.lit("")).alias("errors"),
    )


@query(f"""WITH {_JOBS}, s AS (SELECT job_id, document_id, CASE WHEN json_valid(progress) THEN progress::JSON END AS p FROM j WHERE nth = 1)
    SELECT stage, count(*) FILTER (WHERE (p->stage->>'status') = 'completed') AS completed, count(p) AS readable, count(*) AS documents
    FROM s, (SELECT unnest(['acquired', 'parsed', 'chunked', 'embedded', 'uploaded']) AS stage) GROUP BY 1""")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents completed each stage, from progress that is at times broken JSON."""
    stages = ["acquired", "parsed", "chunked", "embedded", "uploaded"]
    p = F.try_parse_json("progress")
    src = _jobs(spark, sf_dir).select(p.alias("p"))
    each = src.select(F.col("p").isNotNull().alias("readable"), F.inline(F.array(*(F.struct(F.lit(s).alias("stage"), F.try_variant_get("p", f"$.{s}.status", "string").alias("status")) for s in stages))))
    return each.groupBy("stage").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if("readable").alias("readable"), F.count("*").alias("documents"))


_SUBMITTED = """s AS (SELECT * FROM submissions WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY submitted_at DESC NULLS LAST, document_title DESC NULLS LAST, source_type DESC NULLS LAST) = 1)"""


def _submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(table(spark, sf_dir, "submissions").where("document_id is not null"), ["document_id"], "submitted_at", "document_title", "source_type")


@query(f"""WITH {_SUBMITTED} SELECT k.knowledge_base_id, count(s.document_id) AS documents, arg_max(s.document_title, (s.submitted_at, s.document_id)) FILTER (WHERE s.document_title IS NOT NULL) AS last_title, coalesce(epoch_us(max(s.submitted_at)), 0) AS last_us
    FROM knowledge_bases k LEFT JOIN s ON s.knowledge_base_id = k.knowledge_base_id GROUP BY 1""")
def kb_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every knowledge base, counted before the join."""
    s = _submitted(spark, sf_dir)
    title = F.max(F.when(F.col("document_title").isNotNull(), F.struct("submitted_at", "document_id", "document_title")))["document_title"]
    n = s.groupBy("knowledge_base_id").agg(F.count("*").alias("n"), title.alias("last_title"), F.unix_micros(F.max("submitted_at")).alias("last_us"))
    return table(spark, sf_dir, "knowledge_bases").select("knowledge_base_id").join(n, "knowledge_base_id", "left").select("knowledge_base_id", F.coalesce("n", F.lit(0)).alias("documents"), "last_title", F.coalesce("last_us", F.lit(0)).alias("last_us"))


@query(f"""WITH {_CHUNKS}, t AS (SELECT coalesce(knowledge_base_id, '') AS kb, chunk_id, unnest(key_terms) AS w, unnest(range(len(key_terms))) AS p FROM ch),
    f AS (SELECT kb, lower(trim(w)) AS low, min(({{'c': chunk_id, 'p': p, 'w': trim(w)}})) AS first FROM t WHERE trim(w) <> '' GROUP BY 1, 2),
    r AS (SELECT kb, first.w AS w, row_number() OVER (PARTITION BY kb ORDER BY first.c, first.p, low) AS n FROM f)
    SELECT kb, array_to_string(list(w ORDER BY n), ',') AS keywords FROM r WHERE n <= 50 GROUP BY 1""")
def kb_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty distinct key terms of every knowledge base."""
    c = _chunks(spark, sf_dir, "knowledge_base_id", "key_terms").withColumn("kb", F.coalesce("knowledge_base_id", F.lit("")))
    return catalog.merge_keywords(c, "kb", "key_terms", "chunk_id").select("kb", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT feedback_id || '-' || (p + 1)::VARCHAR AS feedback_id, c AS uri FROM (SELECT feedback_id, unnest(chunk_ids) AS c, unnest(range(len(chunk_ids))) AS p FROM feedback_log)")
def expand_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each chunk of a feedback row, numbered."""
    return catalog.expand_bulk(table(spark, sf_dir, "feedback_log").select("feedback_id", "chunk_ids"), "feedback_id", "chunk_ids").select("feedback_id", "uri")


@query("""WITH o AS (SELECT document_id, min(coalesce(document_title, '') || '|' || source_type) AS b FROM submissions WHERE document_id IS NOT NULL AND source_type IS NOT NULL AND parser_hint IS NOT NULL GROUP BY 1),
    n AS (SELECT document_id, max(coalesce(document_title, '') || '|' || source_type) AS b FROM submissions WHERE document_id IS NOT NULL AND source_type IS NOT NULL AND schema_name IS NOT NULL GROUP BY 1)
    SELECT document_id, CASE WHEN o.b IS NULL THEN 'new' WHEN n.b IS NULL THEN 'deleted' WHEN o.b = n.b THEN 'same' ELSE 'updated' END AS change FROM o FULL JOIN n USING (document_id)""")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents sent with a parser hint as the old table, those sent with a schema as the new one."""
    s = table(spark, sf_dir, "submissions").where("document_id is not null and source_type is not null")
    body = F.concat(F.coalesce("document_title", F.lit("")), F.lit("|"), "source_type")
    old = s.where("parser_hint is not null").groupBy("document_id").agg(F.min(body).alias("body"))
    new = s.where("schema_name is not null").groupBy("document_id").agg(F.max(body).alias("body"))
    return catalog.changes(old, new, "document_id", "body")


@query(f"""WITH {_SUBMITTED} SELECT document_id, coalesce(nullif(rtrim(left(trim(regexp_replace(lower(coalesce(document_title, '')), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), 64), '-'), ''), 'section') AS slug FROM s""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of all titles."""
    return _submitted(spark, sf_dir).select("document_id", ft.slugify(F.coalesce("document_title", F.lit(""))).alias("slug"))


@query(f"""WITH {_SUBMITTED} SELECT document_id, regexp_replace(coalesce(document_title, ''), '([\\\\`*_{{}}\\[\\]()#+\\-.!|>~])', '\\\\\\1', 'g') AS escaped,
    repeat('#', least(6, greatest(1, length(coalesce(document_title, '')) % 9))::BIGINT) || ' ' || trim(coalesce(document_title, '')) AS heading,
    '| ' || document_id || ' | ' || replace(coalesce(document_title, ''), '|', '\\|') || ' | ' || coalesce(source_type, '') || ' |' AS row_text FROM s""")
def markdown_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as escaped text, headings and table rows."""
    t = F.coalesce("document_title", F.lit(""))
    return _submitted(spark, sf_dir).select("document_id", ft.markdown_escape(t, full=True).alias("escaped"), ft.markdown_heading(t, F.length(t) % 9).alias("heading"), ft.markdown_row(F.col("document_id"), F.col("document_title"), F.col("source_type")).alias("row_text"))


@query(f"""WITH {_CHUNKS} SELECT chunk_id FROM ch WHERE element_at(metadata, 'policy')[1] IN ('dsm5', 'clinical_note') AND chunk_tier = 'semantic'""".replace("element_at(metadata, 'policy')[1]", "metadata['policy']"))
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that pass a filter on metadata."""
    c = _chunks(spark, sf_dir, "chunk_tier", "metadata").withColumn("policy", F.try_element_at("metadata", F.lit("policy")))
    return c.where(vectors.metadata_filter({"policy": ["dsm5", "clinical_note"], "chunk_tier": "semantic", "namespace": None})).select("chunk_id")


@query(f"""WITH {_CHUNKS} SELECT f.feedback_id, p::INT AS place, c AS chunk_id, ch.section_slug FROM (SELECT feedback_id, unnest(chunk_ids) AS c, unnest(range(len(chunk_ids))) AS p FROM (SELECT DISTINCT feedback_id, chunk_ids FROM feedback_log)) f JOIN ch ON ch.chunk_id = f.c""")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by id in the order they were asked for; unknown ids are dropped."""
    asked = table(spark, sf_dir, "feedback_log").select("feedback_id", "chunk_ids").distinct().select("feedback_id", F.posexplode("chunk_ids").alias("place", "chunk_id"))
    return asked.join(_chunks(spark, sf_dir, "section_slug"), "chunk_id").select("feedback_id", "place", "chunk_id", "section_slug")


@query("""SELECT c_custkey AS id, 'acctbal' AS variable, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'nationkey', c_nationkey::DOUBLE FROM customer""")
def unpivot_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns as (variable, value) rows."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nationkey"))
    return c.unpivot("id", ["acctbal", "nationkey"], "variable", "value")


@query("""SELECT knowledge_base_id, track, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM vectors GROUP BY 1, 2""")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by knowledge base and track."""
    return table(spark, sf_dir, "vectors").groupBy("knowledge_base_id", "track").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("chunks"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, track ORDER BY upserted_at DESC) AS nth FROM vectors WHERE chunk_id IS NOT NULL)
    SELECT chunk_id, track, knowledge_base_id, epoch_us(upserted_at) AS upserted_us, coalesce(len(vector), -1) AS dim FROM n WHERE nth = 1""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table after all upserts: one row for each chunk and track, the latest."""
    v = table(spark, sf_dir, "vectors").where("chunk_id is not null").select("chunk_id", "track", "knowledge_base_id", F.unix_micros("upserted_at").alias("upserted_us"), F.size("vector").cast("bigint").alias("dim"))
    return catalog.latest(v.withColumn("dim", F.coalesce("dim", F.lit(-1))), ["chunk_id", "track"], "upserted_us")
