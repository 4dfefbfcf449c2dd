"""Retrieval queries: dense, sparse, fused, reranked, expanded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions import vector as fv
from ..operators import feedback, pages, semantic, sparse, terms, vectors
from ..session import spread, table
from .base import query

STOPS = ", ".join(f"'{w}'" for w in ft.STOP_WORDS)


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


#: The query set of dense searches: every row whose id is divisible by 50, against all rows.
_ASKED = "vec_id % 50 = 0"
_DENSE = """
    e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
    s AS (SELECT q.vec_id AS query_vec_id, d.vec_id AS vec_id, d.label, q.label AS q_label, round(list_cosine_similarity(q.v, d.v), 6) AS score
          FROM e q, e d WHERE q.vec_id % 50 = 0),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return vectors.dense_topk(e.where(_ASKED), e, query="vec_id", item="vec_id", vector="v", k=k, partition=[])


@query(f"WITH {_DENSE} SELECT query_vec_id, vec_id, score, rank::INT AS rank FROM top WHERE rank <= 24")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 most similar vectors of each query vector."""
    return _dense(spark, sf_dir, 24)


@query(f"""WITH {_DENSE}, own AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY score DESC, vec_id) AS place FROM s WHERE label = q_label)
    SELECT query_vec_id, vec_id, score, place::INT AS rank FROM own WHERE place <= 10""")
def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar vectors with the query's label."""
    e = _embeddings(spark, sf_dir)
    return vectors.dense_topk(e.where(_ASKED), e, query="vec_id", item="vec_id", vector="v", k=10, partition=["label"])


@query(f"""WITH {_DENSE}, v AS (SELECT query_vec_id, label, count(*) AS votes, sum(score) AS weight FROM top WHERE rank <= 24 AND query_vec_id <> vec_id GROUP BY ALL)
    SELECT query_vec_id, label AS voted, votes FROM v QUALIFY row_number() OVER (PARTITION BY query_vec_id ORDER BY votes DESC, label) = 1""")
def knn_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label most of a query's neighbours have."""
    near = _dense(spark, sf_dir, 24).where("query_vec_id <> vec_id").join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    votes = near.groupBy("query_vec_id", "label").agg(F.count("*").alias("votes"))
    return votes.groupBy("query_vec_id").agg(F.max(F.struct("votes", (-F.col("label")).alias("low"))).alias("m")).select("query_vec_id", (-F.col("m.low")).alias("voted"), "m.votes")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_vec_id, d.vec_id, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM e q, e d WHERE q.vec_id % 50 = 0 AND d.vec_id % 50 <> 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_vec_id, vec_id, round(1 - score, 6) AS distance FROM t WHERE rank = 1 AND round(1 - score, 6) <= 0.9""")
def nearest_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the nearest cached entry within a distance; the cache is all rows that are no queries."""
    e = _embeddings(spark, sf_dir)
    return vectors.nearest_cached(e.where(_ASKED), e.where(f"not ({_ASKED})"), query="vec_id", item="vec_id", vector="v", tenant=[], most=0.9)


@query(f"""WITH {_DENSE}, own AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY score DESC, vec_id) AS place FROM s WHERE label = q_label),
    l AS (SELECT query_vec_id, vec_id, score, rank FROM top WHERE rank <= 24 UNION ALL SELECT query_vec_id, vec_id, score, place FROM own WHERE place <= 12)
    SELECT query_vec_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM l GROUP BY ALL""")
def rrf_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the open and the same-label list."""
    return vectors.rrf_classic(_two_lists(spark, sf_dir), "query_vec_id", "vec_id")


def _two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    own = vectors.dense_topk(e.where(_ASKED), e, query="vec_id", item="vec_id", vector="v", k=12, partition=["label"])
    return _dense(spark, sf_dir, 24).withColumn("track", F.lit("text")).unionByName(own.withColumn("track", F.lit("vision")))


_LISTS = f"""WITH {_DENSE}, own AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY score DESC, vec_id) AS place FROM s WHERE label = q_label),
    l AS (SELECT query_vec_id, vec_id, score, rank, 'text' AS track FROM top WHERE rank <= 24 UNION ALL SELECT query_vec_id, vec_id, score, place, 'vision' FROM own WHERE place <= 12)"""


@query(f"{_LISTS} SELECT query_vec_id, vec_id, round(max(score + 1.0::DOUBLE / (60 + rank)), 6) AS combined, max(score) AS score FROM l GROUP BY ALL")
def rrf_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion by the largest score plus rank bonus."""
    return vectors.rrf_max(_two_lists(spark, sf_dir), "query_vec_id", "vec_id")


@query(f"""{_LISTS}, g AS (SELECT query_vec_id, vec_id, max(score) AS best, arg_min(track, (-score, rank, track)) AS best_track, sum(1.0::DOUBLE / (60 + rank)) AS bonus FROM l GROUP BY ALL)
    SELECT query_vec_id, vec_id, best_track, round(best + bonus, 6) AS score FROM g""")
def track_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the text and the vision track."""
    return vectors.fuse_tracks(_two_lists(spark, sf_dir), "query_vec_id", "vec_id", "track")


@query(f"""WITH {_DENSE}, r AS (SELECT t.query_vec_id, t.vec_id, round(0.7 * t.score + 0.3 * list_inner_product(q.v, d.v), 6) AS score
        FROM top t JOIN e q ON q.vec_id = t.query_vec_id JOIN e d ON d.vec_id = t.vec_id WHERE t.rank <= 24),
    z AS (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY score DESC, vec_id) AS rank FROM r)
    SELECT query_vec_id, vec_id, score, rank::INT AS rank FROM z WHERE rank <= 20""")
def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense list blended with the inner product and ranked again."""
    e = _embeddings(spark, sf_dir)
    q, d = e.select(F.col("vec_id").alias("query_vec_id"), F.col("v").alias("qv")), e.select("vec_id", F.col("v").alias("dv"))
    both = _dense(spark, sf_dir, 24).join(q, "query_vec_id").join(d, "vec_id")
    return vectors.rerank_blend(both, "query_vec_id", "vec_id", F.col("score"), fv.dot(F.col("qv"), F.col("dv")), 0.3, 20).select("query_vec_id", "vec_id", "score", "rank")


@query(f"""WITH {_DENSE}, f AS (SELECT user_id AS vec_id, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS fs FROM events GROUP BY 1)
    SELECT query_vec_id, top.vec_id, round(score + 0.15 * coalesce(fs, 0), 6) AS score, rank::INT AS rank FROM top LEFT JOIN f ON f.vec_id = top.vec_id WHERE rank <= 24""")
def feedback_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense list with scores raised by feedback; ranks stay."""
    f = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("vec_id")).agg(F.sum(F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).otherwise(0)).alias("feedback_score"))
    return vectors.feedback_boost(_dense(spark, sf_dir, 24), f, "vec_id")


@query()
def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten diverse results out of each query's first fifty."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("dv"))
    return vectors.mmr(_dense(spark, sf_dir, 50).join(d, "vec_id"), "query_vec_id", "vec_id", "dv", 10)


@query(f"""WITH {_DENSE}, r AS (SELECT query_vec_id, vec_id, (label = q_label)::INT AS hit FROM top WHERE rank <= 10),
    n AS (SELECT label, count(*) AS c FROM e GROUP BY 1)
    SELECT query_vec_id, round(sum(hit)::DOUBLE / count(*), 6) AS precision, round(sum(hit)::DOUBLE / any_value(n.c), 6) AS recall
    FROM r JOIN e ON e.vec_id = r.query_vec_id JOIN n ON n.label = e.label GROUP BY 1""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall at 10, rows with the query's label being relevant."""
    e = _embeddings(spark, sf_dir).select("vec_id", "label")
    asked = e.where(_ASKED).select(F.col("vec_id").alias("query_vec_id"), F.col("label").alias("wanted"))
    judged = _dense(spark, sf_dir, 10).join(asked, "query_vec_id").join(e, "vec_id").withColumn("hit", F.col("label") == F.col("wanted"))
    sizes = asked.join(e.groupBy(F.col("label").alias("wanted")).agg(F.count("*").alias("all")), "wanted")
    return feedback.precision_at_k(judged, sizes, "query_vec_id", 10)


_TOKENS = f"""
    t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(lower(text), 'ς', 'σ'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM t),
    c AS (SELECT doc_id, token, count(*) AS n, min(pos) AS first FROM p WHERE token NOT IN ({STOPS}) GROUP BY ALL),
    x AS (SELECT doc_id, token, first, n::DOUBLE / max(n) OVER (PARTITION BY doc_id) AS weight, ('0x' || left(sha1(token), 8))::BIGINT % 131071 AS i FROM c),
    v AS (SELECT doc_id, CASE WHEN i = 0 THEN 1 ELSE i END AS idx, round(arg_min(weight, first), 6) AS weight FROM x GROUP BY 1, 2)"""


def _document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.text_vectors(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


@query(f"WITH {_TOKENS} SELECT doc_id, idx, weight FROM v")
def sparse_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vectors of all documents."""
    return _document_vectors(spark, sf_dir)


_ITEMS = f"""
    qt AS (SELECT item_id, list_filter(regexp_split_to_array(translate(lower(COL), 'ς', 'σ'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM eval_items WHERE COL IS NOT NULL),
    qp AS (SELECT item_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM qt),
    qc AS (SELECT item_id, token, count(*) AS n, min(pos) AS first FROM qp WHERE token NOT IN ({STOPS}) GROUP BY ALL),
    qx AS (SELECT item_id, token, first, n::DOUBLE / max(n) OVER (PARTITION BY item_id) AS weight, ('0x' || left(sha1(token), 8))::BIGINT % 131071 AS i FROM qc),
    qv AS (SELECT item_id, CASE WHEN i = 0 THEN 1 ELSE i END AS idx, round(arg_min(weight, first), 6) AS weight FROM qx GROUP BY 1, 2),
    s AS (SELECT item_id, doc_id, sum(round(v.weight * 1000000)::BIGINT * round(qv.weight * 1000000)::BIGINT)::DOUBLE / 1e12 AS score FROM v JOIN qv USING (idx) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _item_search(spark: SparkSession, sf_dir: str, part: str, k: int) -> DataFrame:
    q = sparse.text_vectors(table(spark, sf_dir, "eval_items"), "item_id", part)
    return sparse.sparse_topk(q, _document_vectors(spark, sf_dir), "item_id", "doc_id", k)


@query(f"WITH {_TOKENS}, {_ITEMS.replace('COL', 'question')} SELECT item_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 10")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents closest in words to each evaluation question."""
    return _item_search(spark, sf_dir, "question", 10).select("item_id", "doc_id", "score", "rank")


def _renamed(sql: str, tag: str) -> str:
    for n in ("qt", "qp", "qc", "qx", "qv"):
        sql = sql.replace(f"{n} AS", f"{n}{tag} AS").replace(f"FROM {n}", f"FROM {n}{tag}").replace(f"JOIN {n} ", f"JOIN {n}{tag} ").replace(f"({n}.weight", f"({n}{tag}.weight")
    return sql.replace(" s AS", f" s{tag} AS").replace("FROM s)", f"FROM s{tag})").replace(" r AS", f" r{tag} AS")


@query(f"""WITH {_TOKENS}, {_renamed(_ITEMS.replace('COL', 'question'), '1')}, {_renamed(_ITEMS.replace('COL', 'answer'), '2')},
    l AS (SELECT item_id, doc_id, rank FROM r1 WHERE rank <= 24 UNION ALL SELECT item_id, doc_id, rank FROM r2 WHERE rank <= 24)
    SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM l GROUP BY ALL""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank fusion of the searches with an item's question and with its answer."""
    items = table(spark, sf_dir, "eval_items")
    sides = [sparse.text_vectors(items, "item_id", c).withColumn("side", F.lit(c)) for c in ("question", "answer")]
    both = sparse.sparse_topk(sides[0].unionByName(sides[1]), _document_vectors(spark, sf_dir), ["item_id", "side"], "doc_id", 24)
    return vectors.rrf_classic(both, "item_id", "doc_id")


_CHUNKS = "ch AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) = 1)"


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct chunks; rows of one chunk_id have the same content."""
    return table(spark, sf_dir, "chunks").select("chunk_id", *columns).where("chunk_id is not null").dropDuplicates(["chunk_id"])


@query(f"""WITH {_CHUNKS},
    k AS (SELECT chunk_id, lower(t) AS term FROM (SELECT chunk_id, unnest(key_terms) AS t FROM ch)),
    kt AS (SELECT DISTINCT chunk_id, token FROM (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(term, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS token FROM k)),
    a AS (SELECT chunk_id, ('0x' || left(sha1(token), 8))::BIGINT % 131071 AS i, 1.5 AS weight, 1 AS source FROM kt),
    tt AS (SELECT chunk_id, list_filter(regexp_split_to_array(translate(lower(text), 'ς', 'σ'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM ch WHERE text IS NOT NULL),
    p AS (SELECT chunk_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM tt),
    c AS (SELECT chunk_id, token, count(*) AS n, min(pos) AS first FROM p WHERE token NOT IN ({STOPS}) GROUP BY ALL),
    x AS (SELECT chunk_id, first, n::DOUBLE / max(n) OVER (PARTITION BY chunk_id) AS weight, ('0x' || left(sha1(token), 8))::BIGINT % 131071 AS i FROM c),
    v AS (SELECT chunk_id, i, round(arg_min(weight, first), 6) AS weight, 2 AS source FROM x GROUP BY 1, 2),
    u AS (SELECT chunk_id, i, weight::DOUBLE AS weight, source FROM a UNION ALL SELECT chunk_id, i, weight, source FROM v)
    SELECT chunk_id, CASE WHEN i = 0 THEN 1 ELSE i END AS idx, arg_min(weight, source) AS weight FROM u GROUP BY 1, 2""")
def sparse_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vectors of all chunks, their key terms weighing more than their text."""
    return sparse.sparse_vectors(_chunks(spark, sf_dir, "text", "key_terms"), "chunk_id", "text", "key_terms")


_EDGES = f"""{_CHUNKS}, a AS (SELECT coalesce(knowledge_base_id, '') AS kb, chunk_id, lower(trim(t)) AS alias, place
        FROM (SELECT knowledge_base_id, chunk_id, unnest(l) AS t, unnest(range(len(l))) AS place FROM (SELECT knowledge_base_id, chunk_id, list_filter(key_terms, lambda x: lower(trim(x)) <> '') AS l FROM ch))),
    e AS (SELECT kb, chunk_id, alias, round(max(greatest(0.1, 1 - 0.1 * place))::DOUBLE, 6) AS weight FROM a GROUP BY ALL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.alias_edges(_chunks(spark, sf_dir, "knowledge_base_id", "key_terms").withColumn("kb", F.coalesce("knowledge_base_id", F.lit(""))), ["kb"], "chunk_id", "key_terms")


@query(f"WITH {_EDGES} SELECT kb, chunk_id, alias, weight FROM e")
def alias_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias index of all chunks' key terms."""
    return _edges(spark, sf_dir)


@query(f"""WITH {_EDGES}, q AS (SELECT DISTINCT trim(regexp_replace(lower(query_text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS query FROM feedback_log WHERE query_text IS NOT NULL),
    t AS (SELECT DISTINCT query, unnest(regexp_extract_all(query, '[a-z0-9]{{3,}}')) AS token FROM q),
    s AS (SELECT kb, alias, sum(weight) AS score FROM e GROUP BY ALL),
    h AS (SELECT DISTINCT t.query, s.kb, s.alias, round(s.score, 6) AS score FROM t JOIN s ON contains(s.alias, t.token))
    SELECT query, kb, alias, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, alias, kb) AS rank FROM h) WHERE rank <= 5""")
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest aliases for each query of the log."""
    q = table(spark, sf_dir, "feedback_log").select(ft.query_key(F.col("query_text")).alias("query")).where("query is not null").distinct()
    return terms.expand_queries(q, _edges(spark, sf_dir), "query", "query", ["kb"], 5)


@query(f"""WITH {_EDGES}, f AS (SELECT * FROM feedback_log WHERE feedback_id IS NOT NULL AND positive IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY received_at DESC NULLS LAST, given_at DESC NULLS LAST) = 1),
    x AS (SELECT DISTINCT feedback_id, given_at, positive, regexp_extract_all(lower(query_text), '[a-z0-9]{{3,}}') AS tokens, c AS chunk_id FROM (SELECT feedback_id, given_at, positive, query_text, unnest(chunk_ids) AS c FROM f)),
    o AS (SELECT chunk_id, alias, max(weight) AS weight FROM e GROUP BY ALL),
    h AS (SELECT o.chunk_id, o.alias, list(CASE WHEN x.positive THEN 0.2::DOUBLE ELSE -0.3::DOUBLE END ORDER BY x.given_at, x.feedback_id) AS steps
          FROM o JOIN x ON x.chunk_id = o.chunk_id AND list_has_any(regexp_split_to_array(o.alias, '[ \\t\\n\\x0B\\f\\r]+'), x.tokens) GROUP BY ALL)
    SELECT o.chunk_id, o.alias, round(CASE WHEN steps IS NULL THEN o.weight ELSE list_reduce(list_prepend(o.weight, steps), lambda w, s: greatest(0.05::DOUBLE, w + s)) END, 6) AS weight
    FROM o LEFT JOIN h ON h.chunk_id = o.chunk_id AND h.alias = o.alias""")
def alias_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias weights after all feedback, in the order it was given."""
    edges = _edges(spark, sf_dir).groupBy("chunk_id", "alias").agg(F.max("weight").alias("weight"))
    log = feedback.current_feedback(table(spark, sf_dir, "feedback_log"))
    events = log.select("feedback_id", "given_at", "positive", "query_text", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    return terms.learn_aliases(edges, events.withColumnsRenamed({"given_at": "at", "feedback_id": "event_id"}), "chunk_id")


_VECTORS = """
    n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, track ORDER BY upserted_at DESC) AS nth FROM vectors WHERE track = 'text' AND chunk_id IS NOT NULL),
    u AS (SELECT split_part(chunk_id, '|', 1) AS document_id, chunk_id, knowledge_base_id, split_part(chunk_id, '|', 3)::INT AS place, vector::DOUBLE[] AS v FROM n
          WHERE nth = 1 AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""


def _chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, chunk_id, place, v) of current usable text vectors."""
    w = Window.partitionBy("chunk_id").orderBy(F.desc("upserted_at"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    src = table(spark, sf_dir, "vectors").where("track = 'text' and chunk_id is not null").withColumn("nth", F.row_number().over(w)).where((F.col("nth") == 1) & (F.size("vector") == 64) & fine)
    parts = F.split("chunk_id", r"\|")
    return src.select(parts[0].alias("document_id"), "chunk_id", "knowledge_base_id", parts[2].cast("int").alias("place"), F.col("vector").cast("array<double>").alias("v"))


@query(f"""WITH {_VECTORS}, s AS (SELECT q.chunk_id AS query_chunk_id, d.chunk_id, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM u q JOIN u d ON q.knowledge_base_id = d.knowledge_base_id
        WHERE regexp_extract(q.document_id, '(\\d+)$', 1)::BIGINT % 50 = 0)
    SELECT query_chunk_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_chunk_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def chunk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar chunks of the same knowledge base, for the chunks of every document whose number is divisible by 50."""
    v = _chunk_vectors(spark, sf_dir).where("knowledge_base_id is not null")
    asked = v.where(F.regexp_extract("document_id", r"(\d+)$", 1).try_cast("bigint") % 50 == 0)
    return vectors.dense_topk(asked, v, query="chunk_id", item="chunk_id", vector="v", k=10, partition=["knowledge_base_id"])


@query(f"""WITH {_VECTORS}, l AS (SELECT document_id, chunk_id, place, round(list_cosine_similarity(v, lag(v) OVER w), 6) AS sim_prev, round(list_cosine_similarity(v, lead(v) OVER w), 6) AS sim_next FROM u WINDOW w AS (PARTITION BY document_id ORDER BY place, chunk_id)),
    b AS (SELECT *, coalesce(sim_next < 0.3, false) AS is_boundary FROM l)
    SELECT document_id, chunk_id, sim_prev, sim_next, is_boundary,
           coalesce(sum(is_boundary::INT) OVER (PARTITION BY document_id ORDER BY place, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS group_id FROM b""")
def topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of adjacent chunks, and the topics it divides a document into."""
    return semantic.adjacent_similarity(_chunk_vectors(spark, sf_dir), "document_id", "chunk_id", ["place", "chunk_id"], "v")


@query(f"""WITH {_VECTORS}, s AS (SELECT a.document_id, a.chunk_id, b.chunk_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.document_id = b.document_id AND abs(a.place - b.place) > 1)
    SELECT document_id, chunk_id, neighbour, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY score DESC, neighbour) AS rank FROM s WHERE score >= 0.2) WHERE rank <= 5""")
def document_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar chunks elsewhere in the same document."""
    return semantic.document_neighbours(_chunk_vectors(spark, sf_dir), "document_id", "chunk_id", "place", "v", 0.2)


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS d FROM documents),
    b AS (SELECT doc_id, list_transform(range(8), lambda i: ('0x' || d[(2 * i + 1):(2 * i + 2)])::BIGINT::DOUBLE) AS raw FROM h)
    SELECT doc_id, round(list_aggregate(raw, 'sum') / sqrt(list_inner_product(raw, raw)), 6) AS total, round(raw[1] / sqrt(list_inner_product(raw, raw)), 6) AS first FROM b""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-dimensional hash embeddings of all documents, by their sum and first value."""
    e = table(spark, sf_dir, "documents").select("doc_id", fv.hash_embedding(F.coalesce("text", F.lit("")), 8).alias("v"))
    return e.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("v")[0], 6).alias("first"))


_RATED = """f AS (SELECT * FROM feedback_log WHERE feedback_id IS NOT NULL AND positive IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY received_at DESC NULLS LAST, given_at DESC NULLS LAST) = 1)"""


@query(f"""WITH {_CHUNKS}, {_RATED},
    x AS (SELECT DISTINCT feedback_id, trim(regexp_replace(lower(query_text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS query, positive, c AS chunk_id FROM (SELECT feedback_id, query_text, positive, unnest(chunk_ids) AS c FROM f)),
    s AS (SELECT query, chunk_id, sum(CASE WHEN positive THEN 1 ELSE -1 END) AS score FROM x WHERE query <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank FROM s),
    p AS (SELECT chunk_id, document_id || '_page' || unnest(range(start_page, greatest(start_page, coalesce(end_page, start_page)) + 1)) AS page_id FROM ch WHERE start_page IS NOT NULL)
    SELECT query, page_id, min(rank)::INT AS rank FROM r JOIN p USING (chunk_id) WHERE rank <= 10 GROUP BY ALL""")
def context_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages behind the ten best-rated chunks of each query."""
    log = feedback.current_feedback(table(spark, sf_dir, "feedback_log")).withColumn("query", ft.query_key(F.col("query_text"))).where("query <> ''")
    each = log.select("query", F.when(F.col("positive"), 1).otherwise(-1).alias("one"), F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    best = vectors.ranked(each.groupBy("query", "chunk_id").agg(F.sum("one").alias("score")), ["query"], "score", "chunk_id", 10)
    covered = pages.covered_pages(_chunks(spark, sf_dir, "document_id", "start_page", "end_page").where("start_page is not null"))
    return pages.context_pages(best, covered.select("chunk_id", F.concat("document_id", F.lit("_page"), "page").alias("page_id")), "query", "chunk_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: the evaluation questions over all documents by words and by hash embeddings, fused by rank, with a snippet."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    words = _item_search(spark, sf_dir, "question", 24)
    emb = lambda df, k, t: df.select(k, fv.hash_embedding(F.col(t), 32).alias("v"))
    dense = vectors.dense_topk(emb(table(spark, sf_dir, "eval_items"), "item_id", "question"), emb(docs, "doc_id", "text"), query="item_id", item="doc_id", vector="v", k=24, partition=[])
    fused = vectors.ranked(vectors.rrf_classic(words.unionByName(dense), "item_id", "doc_id"), ["item_id"], "score", "doc_id", 10)
    return fused.join(docs.select("doc_id", ft.first_sentence(F.col("text")).alias("snippet")), "doc_id")
