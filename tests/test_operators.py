"""Hand-computed cases of the core operators, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from strataquill.functions import layout as fl
from strataquill.functions import text as ft
from strataquill.functions import vector as fv
from strataquill.operators import catalog, chunking, feedback, layout, pages, parsing, pipelines, records, semantic, sparse, telemetry, terms, vectors
from strataquill.sources import acquire, tables
from strataquill.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_window_steps_match_the_policy_table():
    want = {(400, 80): (308, 308), (350, 70): (269, 269), (300, 60): (231, 184), (300, 50): (231, 192), (500, 100): (385, 385), (550, 110): (423, 423), (450, 90): (346, 346), (100, 20): (77, 61)}
    assert {k: chunking.window_steps(*k) for k in want} == want


def test_windows_cover_all_words(spark):
    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(" ".join(words),)], "t string")
    got = df.select(chunking.windows(ft.words(F.col("t")), F.lit(231), F.lit(184)).alias("w")).first()["w"]
    assert [len(x.split()) for x in got] == [231, 116]
    assert got[0].split() == words[:231] and got[1].split() == words[184:]


def test_criteria(spark):
    df = spark.createDataFrame([("pre Criterion A. x Criterion B. y",)], "t string")
    assert df.select(chunking.criteria(F.col("t"))).first()[0] == ["pre", "Criterion A. x", "Criterion B. y"]


def test_generate_chunks_of_null_blank_and_unknown_policy(spark):
    df = spark.createDataFrame([("d", 0, "s", None, "x"), ("d", 1, "s", " \u00a0 ", "x"), ("e", 0, "s", "one\n\ntwo", "dsm5"), ("e", 0, "s", "one\n\ntwo", "dsm5")], "document_id string, section_ord int, section_slug string, text string, schema string")
    got = chunking.generate_chunks(chunking.resolve_policies(df, "schema")).collect()
    assert {r["document_id"] for r in got} == {"e"}
    assert {r["chunk_tier"] for r in got} == {"criteria", "semantic"}
    assert chunking.generate_chunks(chunking.resolve_policies(df.limit(0), "schema")).count() == 0


def test_pack_keeps_all_paragraphs(spark):
    text = "\n\n".join(f"paragraph number {i} " * 6 for i in range(40))
    got = [r["text"] for r in chunking.pack_paragraphs(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t", 100, 200).orderBy("k", "pack_no").collect()]
    assert "\n\n".join(got).split() == text.split()
    assert all(max(1, len(g) // 4) <= 100 for g in got)


def test_token_index(spark):
    assert one(spark, ft.token_index(F.lit("ccbhc"))) == 48892


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(3.0))
    assert one(spark, fv.dot(a, b)) == 8.0
    assert round(one(spark, fv.cosine(a, b)), 6) == 0.992278
    assert one(spark, fv.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, fv.dot(a, F.array(F.lit(1.0)))) is None


def test_dense_topk_ties_nulls_and_other_dimensions(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (None, [1.0, 0.0]), (6, [float("nan"), 1.0])], "id int, v array<double>")
    got = vectors.dense_topk(items.where("id = 1"), items, query="id", item="id", vector="v", k=3, partition=[])
    assert [(r["id"], r["score"], r["rank"]) for r in got.orderBy("rank").collect()] == [(1, 1.0, 1), (2, 1.0, 2), (5, 0.0, 3)]
    assert vectors.dense_topk(items.limit(0), items, query="id", item="id", vector="v", k=3, partition=[]).count() == 0
    with pytest.raises(TypeError):
        vectors.dense_topk(items, items, query="id", item="id", vector="v", k=3)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_queries_of_several_dimensions_all_get_their_items(spark, sent):
    q = spark.createDataFrame([(1, [1.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], "b"), (4, [0.0, 1.0], None)], "id int, v array<double>, kb string")
    items = spark.createDataFrame([(10 + i, [1.0, i / 9.0], "ab"[i % 2]) for i in range(9)] + [(50, [2.0], "a")], "id int, v array<double>, kb string")
    got = vectors.dense_topk(q, items, query="id", item="id", vector="v", k=2, partition=["kb"], broadcast_bytes=sent, block_rows=2).collect()
    assert {(r["query_id"], r["id"], r["rank"]) for r in got} == {(1, 50, 1), (2, 10, 1), (2, 12, 2), (3, 17, 1), (3, 15, 2)}


def test_shuffled_blocks_equal_the_sent_query_set(spark):
    import random

    rng = random.Random(1)
    df = spark.createDataFrame([(f"i{i:03d}", [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)], rng.choice("xy")) for i in range(120)], "id string, v array<double>, kb string")
    run = lambda **o: {tuple(r) for r in vectors.dense_topk(df, df, query="id", item="id", vector="v", k=5, partition=["kb"], **o).collect()}
    assert run() == run(broadcast_bytes=0, block_rows=17)


def lists(spark):
    return spark.createDataFrame([("q", "X", 0.9, 1, "text"), ("q", "X", 0.5, 2, "vision")], "q string, item string, score double, rank int, track string")


def test_fusions(spark):
    assert vectors.fuse_tracks(lists(spark), "q", "item", "track").first()["score"] == 0.932522
    r = vectors.rrf_max(lists(spark), "q", "item").first()
    assert (r["combined"], r["score"]) == (0.916393, 0.9)
    assert vectors.rrf_classic(lists(spark), "q", "item").first()["score"] == 0.032522
    assert vectors.fuse_tracks(lists(spark).where("rank = 1"), "q", "item", "track").first()["score"] == 0.9


def test_noise_filter_boost_and_append(spark):
    df = spark.createDataFrame([("q", i, 1.0, i, t) for i, t in enumerate((0, 5, 8, None), 1)], "q string, item int, score double, rank int, token_count int")
    assert [r["item"] for r in vectors.drop_noise(df).orderBy("item").collect()] == [1, 3, 4]
    f = spark.createDataFrame([(1, -2)], "item int, feedback_score int")
    assert vectors.feedback_boost(df.where("item = 1").withColumn("score", F.lit(0.5)), f, "item").first()["score"] == 0.2
    kept = df.where("item = 3").withColumn("rank", F.lit(1))
    assert [(r["item"], r["rank"]) for r in vectors.append_unreturned(kept, df, "q", "item").orderBy("rank").collect()] == [(3, 1), (1, 2), (2, 3), (4, 4)]


def test_metadata_filter(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "tier string, n int")
    assert df.where(vectors.metadata_filter({"tier": ["a", "c"], "n": 1, "x": None})).count() == 1
    assert df.where(vectors.metadata_filter({"tier": "None"})).count() == 0


def test_sparse_priority(spark):
    df = spark.createDataFrame([(1, "alpha beta beta the", ["beta"], ["gamma gamma"]), (2, None, None, None), (3, "", [], [])], "k int, t string, kw array<string>, st array<string>")
    idx = {w: one(spark, ft.token_index(F.lit(w))) for w in ("alpha", "beta", "gamma")}
    got = {(r["k"], r["idx"]): r["weight"] for r in sparse.sparse_vectors(df, "k", "t", "kw", "st").collect()}
    assert got == {(1, idx["alpha"]): 0.5, (1, idx["beta"]): 1.5, (1, idx["gamma"]): 4.0}


def test_sparse_weights_round_halves_up(spark):
    df = spark.createDataFrame([(1, "beta " * 128 + "alpha"), (2, "beta " * 128 + "alpha " * 3), (3, "beta " * 128 + "alpha " * 5)], "k int, t string")
    got = {r["k"]: r["weight"] for r in sparse.text_vectors(df, "k", "t").where("weight < 1").collect()}
    assert got == {1: 0.007813, 2: 0.023438, 3: 0.039063}


def test_hash_embedding_works_out_its_digest_once(spark):
    import hashlib

    texts = ["one", "", None, "Größe ς"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").select("k", fv.hash_embedding(F.col("t"), 40).alias("v"))
    # Within the lambda of each element the digest would stand there, and be made, many times.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    for r in got.collect():
        if texts[r["k"]] is None:
            assert r["v"] == [None] * 40
        else:
            raw = [float(b) for b in (hashlib.sha256(texts[r["k"]].encode()).digest() * 2)[:40]]
            assert r["v"] == [x / sum(y * y for y in raw) ** 0.5 for x in raw]


def test_sparse_vectors_of_some_dimensions_with_their_scope(spark):
    df = spark.createDataFrame([(1, "kb", "alpha beta beta"), (2, None, "beta gamma"), (3, "kb", None)], "k int, kb string, t string")
    idx = {w: sparse.index_of(w) for w in ("alpha", "beta", "gamma")}
    got = {tuple(r) for r in sparse.text_vectors(df, "k", "t", scope=["kb"], among=[idx["alpha"], idx["gamma"], 7]).collect()}
    assert got == {(1, "kb", idx["alpha"], 0.5), (2, None, idx["gamma"], 1.0)}
    assert sparse.text_vectors(df, "k", "t", among=[]).count() == 0


def test_retrieve_gives_out_only_rows_of_asked_dimensions(spark, monkeypatch):
    made = []
    plain = sparse.sparse_topk
    monkeypatch.setattr(sparse, "sparse_topk", lambda q, items, *a: made.append(items) or plain(q, items, *a))
    q = spark.createDataFrame([("q1", "red fox", "a"), ("q2", "red hen", "b")], "query_id string, text string, kb string")
    c = spark.createDataFrame([("c1", "a red fox ran over many green hills", None, 9, "a"), ("c2", "one red hen sat upon many brown eggs", "window", 9, "b"), ("c3", None, None, 9, "a")], "chunk_id string, text string, chunk_tier string, token_count int, kb string")
    got = {(r["query_id"], r["chunk_id"], r["rank"], r["snippet"]) for r in pipelines.retrieve(q, c, tenant=["kb"]).collect()}
    assert got == {("q1", "c1", 1, "a red fox ran over many green hills"), ("q2", "c2", 1, "one red hen sat upon many brown eggs")}
    assert made[0].count() == 4
    assert "Join" not in made[0]._jdf.queryExecution().optimizedPlan().toString()


def test_alias_weights_and_learning(spark):
    df = spark.createDataFrame([("kb", "c", ["A", " b ", "c", "", None])], "kb string, chunk_id string, al array<string>")
    e = terms.alias_edges(df, ["kb"], "chunk_id", "al")
    assert {r["alias"]: r["weight"] for r in e.collect()} == {"a": 1.0, "b": 0.9, "c": 0.8}
    edges = spark.createDataFrame([("c", "pain", 1.0)], "chunk_id string, alias string, weight double")
    t = lambda i: dt.datetime(2024, 1, 1, 0, i)
    ev = spark.createDataFrame([(f"e{i}", "Pain relief", "c", i == 4, t(i)) for i in range(5)], "event_id string, query_text string, chunk_id string, positive boolean, at timestamp")
    assert terms.learn_aliases(edges, ev, "chunk_id").first()["weight"] == 0.25
    assert terms.learn_aliases(edges, ev.limit(0), "chunk_id").first()["weight"] == 1.0


def test_expansion_finds_parts_of_words(spark):
    edges = spark.createDataFrame([("kb", "behavioral activation", 1.0), ("kb", "activate", 0.5), ("kb", "rest", 1.0)], "kb string, alias string, weight double")
    q = spark.createDataFrame([("q", "activa it"), ("r", None)], "q string, t string")
    assert [(r["alias"], r["rank"]) for r in terms.expand_queries(q, edges, "q", "t", ["kb"], 5).orderBy("rank").collect()] == [("behavioral activation", 1), ("activate", 2)]


def test_feedback(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("f1", "Q", ["1", "2"], True, "helpful", t, t), ("f2", " q", ["1"], False, "no", t + dt.timedelta(1), t), ("f2", " q", ["1"], False, "no", t + dt.timedelta(1), t), ("f3", None, [], None, None, None, None)]
    log = spark.createDataFrame(rows, "feedback_id string, query_text string, chunk_ids array<string>, positive boolean, comment_text string, given_at timestamp, received_at timestamp")
    q = feedback.by_query(log).collect()
    assert [(r["query"], r["positive"], r["negative"], r["ratio"]) for r in q] == [("q", 1, 1, 0.5)]
    c = {r["chunk_id"]: (r["score"], r["last_comment"]) for r in feedback.by_chunk(log).collect()}
    assert c == {"1": (0, "no"), "2": (1, "helpful")}
    assert feedback.by_chunk(log.limit(0)).count() == 0


def test_latency(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("a", None)], "k string, v double")
    r = telemetry.latency_summary(df, ["k"], "v").first()
    assert (r["n"], r["mean"], r["p50"], r["p95"], r["max"]) == (3, 4.333333, 2.0, 9.2, 10.0)
    assert {x["le"]: x["n"] for x in telemetry.histogram(df, ["k"], F.col("v")).collect()}["+Inf"] == 3


def test_topic_groups(spark):
    v = {0: [1.0, 0.0], 1: [0.0, 1.0]}
    df = spark.createDataFrame([("d", i, v[k]) for i, k in enumerate((0, 0, 1, 1, 1, 0))], "d string, i int, v array<double>")
    got = semantic.adjacent_similarity(df, "d", "i", ["i"], "v").orderBy("i").collect()
    assert [r["group_id"] for r in got] == [0, 0, 1, 1, 1, 2]


def test_spatial_and_columns(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 10.0, 5.0, 15.0), (1, "b", 0.0, 0.0, 5.0, 5.0), (1, "c", 20.0, 0.0, 25.0, 5.0)], "p int, i string, x0 double, y0 double, x1 double, y1 double")
    got = {(r["i"], r["relation"]): r["neighbour"] for r in layout.spatial_edges(df, ["p"], "i").collect()}
    assert got == {("a", "below"): "b", ("b", "above"): "a", ("b", "right"): "c", ("c", "left"): "b"}
    assert layout.page_columns(df, ["p"]).first()["layout"] == "single"
    assert one(spark, fl.overlap_ratio(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == 0.0


def test_pages_and_visuals(spark):
    c = spark.createDataFrame([("d", "a", 1, 2, "x", 1), ("d", "b", 2, None, " ", 2), ("d", "c", None, None, "z", 3)], "document_id string, chunk_id string, start_page int, end_page int, text string, chunk_no int")
    got = {r["page"]: (r["chunk_ids"], r["text"]) for r in pages.page_documents(c).collect()}
    assert got == {1: (["a"], "x"), 2: (["a", "b"], "x")}
    v = spark.createDataFrame([("d", "v", 3), ("d", "w", None)], "document_id string, visual_id string, page int")
    assert [(r["chunk_id"], r["visual_id"]) for r in pages.visual_links(c, v, "document_id", "chunk_id", "visual_id").orderBy("chunk_id").collect()] == [("a", "v"), ("b", "v")]


def test_parsing(spark):
    e = spark.createDataFrame([("d", 1, True, "Section 1", 1), ("d", 2, False, "Paragraph A", 1), ("d", 3, True, "Section 2", 2), ("d", 4, False, "Paragraph B", 2)], "d string, o int, h boolean, t string, p int")
    assert [(r["title"], r["text"]) for r in parsing.section_islands(e, "d", "o", "h", "t", "p").orderBy("section").collect()] == [("Section 1", "Paragraph A"), ("Section 2", "Paragraph B")]
    h = spark.createDataFrame([(1, "<p>a &amp; b</p><script>x</script>"), (2, None), (3, "")], "k int, h string")
    assert {r["k"]: r["text"] for r in parsing.html_text(h, "k", "h").collect()} == {1: "a & b\nx", 2: None, 3: ""}
    p = spark.createDataFrame([("d", 12), ("e", 0), ("f", None)], "d string, n int")
    assert [(r["first_page"], r["last_page"]) for r in parsing.page_runs(p, "d", "n").orderBy("first_page").collect()] == [(1, 5), (6, 10), (11, 12)]


def test_content_types(spark):
    df = spark.createDataFrame([(b"%PDF-1.7", None), (b"PK\x03\x04....word/document.xml", None), (b" <HTML><body>", None), (b"plain text", None), (b"\x00\x01", None), (b"x", "a/b.docx"), (None, None)], "c binary, n string")
    got = [r[0] for r in df.select(ft.parser_for(ft.content_type(F.col("c"), F.col("n")))).collect()]
    assert got[:6] == ["pdf", "docx", "html", "plain_text", None, "docx"]


def test_text_functions(spark):
    assert one(spark, ft.slugify(F.lit("Über — uns!"))) == "über-uns"
    assert one(spark, ft.slugify(F.lit("--"))) == "section"
    assert one(spark, ft.first_sentence(F.lit("One. Two."))) == "One."
    assert one(spark, ft.markdown_heading(F.lit("Introduction"), F.lit(0))) == "# Introduction"
    assert one(spark, ft.markdown_row(F.lit("a|b"), F.lit(None), F.lit(1))) == r"| a\|b |  | 1 |"
    assert one(spark, ft.strip_markdown(F.lit("# *A* **b** [c](d)"))) == "A b c"
    assert one(spark, ft.normalize_text(F.lit(" \r\n*  x\ty "))) == "- x y"


def test_catalog(spark):
    a = spark.createDataFrame([("k", 1, "x"), ("k", 1, "x"), ("l", None, "y")], "k string, v int, t string")
    b = spark.createDataFrame([("k", 2, "z")], "k string, v int, t string")
    assert {r["k"]: r["t"] for r in catalog.upsert(a, b, ["k"], "v").collect()} == {"k": "z", "l": "y"}
    w = spark.createDataFrame([("k", ["A", "b", None], 1), ("k", ["a", "C", " "], 2)], "k string, w array<string>, o int")
    assert catalog.merge_keywords(w, "k", "w", "o").first()["keywords"] == ["A", "b", "C"]
    c = {r["k"]: r["change"] for r in catalog.changes(a.select("k", "t").distinct(), b.select("k", "t").union(spark.createDataFrame([("m", None)], "k string, t string")), "k", "t").collect()}
    assert c == {"k": "updated", "l": "deleted", "m": "new"}
    assert [r["k"] for r in catalog.expand_bulk(spark.createDataFrame([("d", ["u", "v"]), ("e", None)], "k string, u array<string>"), "k", "u").orderBy("k").collect()] == ["d-1", "d-2"]


def test_mmr_prefers_diversity(spark):
    df = spark.createDataFrame([("q", "a", 1.0, [1.0, 0.0]), ("q", "b", 0.99, [1.0, 0.01]), ("q", "c", 0.8, [0.0, 1.0])], "q string, item string, score double, v array<double>")
    assert [r["item"] for r in vectors.mmr(df, "q", "item", "v", 2).orderBy("pick").collect()] == ["a", "c"]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<html>x</html>")
    got = acquire.files(spark, str(tmp_path / "in")).first()
    assert (got["parser"], bytes(got["content"])) == ("html", b"<html>x</html>")
    import base64

    pdf = base64.b64encode(b"%PDF-" + b"0" * 100).decode()
    s = spark.createDataFrame([("a", "inline", pdf, None, None), ("b", "inline", None, None, None), ("c", "ftp", "x", None, None), ("d", "inline", "text", None, "html")], "document_id string, source_type string, content string, content_uri string, parser_hint string")
    got = {r["document_id"]: (r["parser"], r["error"]) for r in acquire.inline(s).collect()}
    assert got["a"] == ("pdf", None) and got["b"][1] == "no content" and got["c"][1] == "unsupported source type" and got["d"] == ("html", None)
    spark.dataSource.register(acquire.UrlSource)
    r = spark.read.format("urls").option("urls", f"file://{tmp_path}/in/a.html\nfile:///none").load().collect()
    assert sorted((x["error"] is None) for x in r) == [False, True]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("o", "k", 1, "x"), ("p", "l", 1, "y")], "org string, k string, v int, t string")
    tables.write_partitioned(a, path, ["org"])
    tables.merge_into(spark, path, spark.createDataFrame([("o", "k", 2, "z")], "org string, k string, v int, t string"), ["org", "k"], "v", ["org"])
    assert {(r["k"], r["t"]) for r in spark.read.parquet(path).collect()} == {("k", "z"), ("l", "y")}
    assert tables.table_path("s3a://b/", "org:ws", "kb") == "s3a://b/org-ws/kb"
    assert tables.missing_rows(a, a.where("k = 'k'"), "k").count() == 1


@pytest.mark.parametrize("empty", ["chunks", "feedback_log"])
def test_empty_tables(spark, sf, empty):
    df = spark.read.parquet(f"{sf}/{empty}.parquet").limit(0)
    if empty == "feedback_log":
        assert feedback.by_query(df).count() == 0
    else:
        assert pages.page_documents(df.withColumn("chunk_no", F.lit(1))).count() == 0


def test_texts_are_not_shuffled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df in (sparse.text_vectors(docs, "doc_id", "text"), sparse.top_terms(docs, "doc_id", ft.words(F.col("text")), 10)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_oversized_pieces_are_given_out(spark):
    long = " ".join(["Criterion A. x", "Criterion B. " + "word " * 900])
    df = chunking.resolve_policies(spark.createDataFrame([("d", 0, "s", long, "dsm5")], "document_id string, section_ord int, section_slug string, text string, schema string"), "schema")
    kept, over = chunking.generate_chunks(df).collect(), chunking.oversized_pieces(df).collect()
    assert [(r["chunk_tier"], r["chunk_no"]) for r in over] == [("criteria", 2)]
    assert sorted([r["chunk_no"] for r in kept] + [2]) == list(range(1, len(kept) + 2))


def test_numbers_run_through_the_sections(spark):
    rows = [("d", 1, "b", "one\n\ntwo", "clinical_note"), ("d", 0, "a", "three", "clinical_note"), ("e", 0, "a", "four", "clinical_note")]
    df = chunking.resolve_policies(spark.createDataFrame(rows, "document_id string, section_ord int, section_slug string, text string, schema string"), "schema")
    got = {(r["document_id"], r["text"]): (r["chunk_no"], r["prev_chunk_id"]) for r in chunking.generate_chunks(df).collect()}
    assert got == {("d", "three"): (1, None), ("d", "one"): (2, None), ("d", "two"): (3, "d|b|2"), ("e", "four"): (1, None)}


def test_order_statistics_of_ties_and_wide_values(spark):
    import random

    rng = random.Random(4)
    rows = [(k, v) for k in ("a", None) for v in [rng.choice([1.0, 2.0, rng.gauss(0, 1e6)]) for _ in range(501)]] + [("one", 5.0), ("none", None), ("nan", float("nan"))]
    got = {r["k"]: (r["n"], r["v0"], r["v1"], r["v2"]) for r in telemetry.order_statistics(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", lambda n: [F.lit(0), F.floor(n / 2), n - 1]).collect()}
    want = {}
    for k in ("a", None, "one"):
        v = sorted(x for kk, x in rows if kk == k and x is not None)
        want[k] = (len(v), v[0], v[len(v) // 2], v[-1])
    assert got == want


def test_records(spark):
    import uuid

    assert one(spark, records.uuid5(F.lit("a|b"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a|b"))
    assert one(spark, records.explanation(F.lit(1), F.lit("text"), F.lit("semantic"), F.lit(0.93251))) == "Rank 1 from text track, tier=semantic, score=0.933."
    assert one(spark, records.lossy_text(F.unhex(F.lit("61FF62C3")))) == "ab"
    assert [one(spark, records.truncate_bytes(F.lit("aéb"), n)) for n in (1, 2, 3, 4, 9)] == ["a", "a", "aé", "aéb", "aéb"]
    assert one(spark, records.visual_references(F.lit("See Figure 2 and table 3.1, fig. 2."))) == ["2", "3.1"]
    assert records.merge_filters({"a": 1, "b": 2}, None, {"b": None, "a": 3}, knowledge_bases=["k", "l", "k"]) == {"a": 3, "b": 2, "knowledge_base_id": ["k", "l"]}
    bad = spark.createDataFrame([("c", "{broken"), ("d", None), ("e", '{"start_page": 4}')], "chunk_id string, record string")
    assert {(r["chunk_tier"], r["start_page"], r["end_page"]) for r in records.from_record(bad).collect()} == {("semantic", 1, 1), ("semantic", 4, 4)}
    assert records.guard_tokens(spark.createDataFrame([("a", 5)], "k string, n int"), "k", "n").count() == 1
    with pytest.raises(Exception, match="too many tokens: a"):
        records.guard_tokens(spark.createDataFrame([("a", 9000)], "k string, n int"), "k", "n").collect()
    known = spark.createDataFrame([("o", "k1"), ("o", "k2"), ("p", "k3")], "org string, scope string")
    asked = spark.createDataFrame([(1, "o", ["k2", "k1", "k2"]), (2, "o", ["*"])], "id int, org string, scopes array<string>")
    assert {tuple(r) for r in records.resolve_scopes(asked, known, "id", "scopes", ["org"]).collect()} == {(1, "k2", 0), (1, "k1", 1), (2, "k1", 0), (2, "k2", 0)}
    with pytest.raises(Exception, match="unknown scope: k3"):
        records.resolve_scopes(spark.createDataFrame([(1, "o", ["k3"])], asked.schema), known, "id", "scopes", ["org"]).collect()
    res = spark.createDataFrame([("q", "c", ["v2", "x", "v1"]), ("q", "d", None)], "q string, c string, ids array<string>")
    vis = spark.createDataFrame([("v1",), ("v2",), ("v2",)], "v string")
    assert {r["c"]: r["visuals"] for r in records.result_visuals(res, vis, "q", "c", "ids", "v").collect()} == {"c": ["v2", "v1"], "d": []}
    p = records.override_policy(spark.createDataFrame([("a", 1, 2)], "policy string, n int, step int"), spark.createDataFrame([("a", None, 9)], "policy string, n int, step int"), "policy").first()
    assert (p["n"], p["step"]) == (1, 9)


def test_answers_cite_or_come_from_the_cache(spark):
    q = spark.createDataFrame([("q1", [1.0, 0.0], "o"), ("q2", [0.0, 1.0], "o"), ("q3", [1.0, 0.0], "p")], "query_id string, v array<double>, org string")
    cache = spark.createDataFrame([("old", [1.0, 0.01], "as before", "o")], "query_id string, v array<double>, answer string, org string")
    res = spark.createDataFrame([(x, r, f"c{r}", f"text {r}") for x in ("q1", "q2", "q3") for r in (2, 1)], "query_id string, rank int, chunk_id string, snippet string")
    answers, new = pipelines.answer(q, cache, res, tenant=["org"])
    got = {r["query_id"]: (r["cached"], r["answer"]) for r in answers.collect()}
    cited = "[1] text 1 (c1)\n[2] text 2 (c2)"
    assert got == {"q1": (True, "as before"), "q2": (False, cited), "q3": (False, cited)}
    assert {r["query_id"] for r in new.collect()} == {"q2", "q3"}


def test_ingest_rejects_and_cache_gaps_fail(spark):
    docs = spark.createDataFrame([("a", "Some text of the note.", None, "k"), ("b", " \n", "dsm5", "k"), (None, "x", None, "k")], "document_id string, text string, schema_name string, kb string")
    done = pipelines.ingest(docs, ["kb"])
    assert {(r["document_id"], r["reason"]) for r in done.rejected.collect()} == {("b", "no text"), (None, "no document_id")}
    chunks = done.chunks.cache()
    assert pipelines.ingest_from_cache(docs, chunks, done.vectors, ["kb"]).count() == chunks.count() == 2
    with pytest.raises(Exception, match="not cached"):
        pipelines.ingest_from_cache(docs, chunks, done.vectors.limit(1), ["kb"]).collect()


def test_large_paragraphs_are_cut_between_sentences_then_words(spark):
    long = " ".join(f"word{i}" for i in range(400)) + "."
    text = "A short one.\n\n" + " ".join(f"Sentence number {i} stands here." for i in range(60)) + f" {long}\n\nThe end."
    got = [r["text"] for r in chunking.pack_paragraphs(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", 50, 100).orderBy("pack_no").collect()]
    assert " ".join(got).split() == text.split()
    assert all(len(g) // 4 <= 100 for g in got)
    assert got[0] == "A short one." and got[-1] == "The end." and got[1].endswith("here.")
    whole = spark.createDataFrame([(1, "x" * 1000)], "k int, t string")
    assert chunking.pack_paragraphs(whole, "k", "t", 50, 100).count() == 1


def test_slices_lose_no_word_and_end(spark):
    text = "  " + " ".join(f"w{i}." if i % 9 == 0 else f"w{i}" for i in range(1000)) + "\n\nlast words"
    rows = spark.createDataFrame([("a", text), ("b", None), ("c", "  \n"), ("d", "one")], "k string, t string")
    for most, overlap in ((50, 10), (7, 7), (1, 0), (5000, 3)):
        got = [r["text"].split() for r in chunking.token_slices(rows, "k", "t", most, overlap).where("k = 'a'").orderBy("slice_no").collect()]
        assert all(len(g) <= most for g in got) and got[-1][-1] == "words"
        place = {w: i for i, w in enumerate(text.split())}
        spans = [(place[g[0]], place[g[-1]]) for g in got]
        assert spans[0][0] == 0 and all(a[0] < b[0] <= a[1] + 1 for a, b in zip(spans, spans[1:], strict=False))
    assert sorted(r["k"] for r in chunking.token_slices(rows, "k", "t", 5000).collect()) == ["a", "d"]
    with pytest.raises(ValueError):
        chunking.token_slices(rows, "k", "t", 0)


def test_distribution_fusion(spark):
    lists = spark.createDataFrame([(1, "a", "t", 1.0), (1, "b", "t", 2.0), (1, "c", "t", 3.0), (1, "b", "u", 5.0), (2, "z", "t", 4.0), (2, "y", "t", 4.0)], "q int, item string, track string, score double")
    got = {(r["q"], r["item"]): r["score"] for r in vectors.dbsf(lists, "q", "item", "track").collect()}
    assert got == {(1, "a"): 0.333333, (1, "b"): 1.0, (1, "c"): 0.666667, (2, "z"): 0.5, (2, "y"): 0.5}


def test_stitching_and_clauses(spark):
    results = spark.createDataFrame([(1, "c", 1), (1, "e", 2), (1, "d", 3), (1, "x", 4)], "q int, item string, rank int")
    chunks = spark.createDataFrame([("c", "b", True), ("b", "a", True), ("e", "d", True), ("d", "c", True), ("x", "gone", True), ("a", None, None)], "item string, prev_chunk_id string, requires_previous boolean")
    got = vectors.stitch_previous(results, chunks, "q", "item").orderBy("place").collect()
    assert [(r["item"], r["stitched"]) for r in got] == [("b", True), ("c", False), ("e", False), ("d", False), ("x", False)]
    df = spark.createDataFrame([(1, "a", None), (2, None, True), (3, "b", True)], "i int, s string, t boolean")
    keep = lambda **kw: [r["i"] for r in df.where(vectors.clauses(**kw)).orderBy("i").collect()]
    assert keep() == [1, 2, 3]
    assert keep(must=[F.col("t")]) == [2, 3]
    assert keep(must_not=[F.col("t")]) == [1]
    assert keep(should=[F.col("s") == "a", F.col("s") == "b"]) == [1, 3]


def test_column_confidence(spark):
    even = [(1, x, x + 10.0) for x in (100.0, 101.0, 400.0, 401.0)]
    one = [(2, 5.0, 50.0), (2, 6.0, 60.0)]
    alone = [(3, 5.0, 50.0)]
    got = {r["p"]: (r["columns"], r["confidence"]) for r in layout.column_confidence(spark.createDataFrame(even + one + alone, "p int, x0 double, x1 double"), ["p"]).collect()}
    # Widths 250.5 and 361.5 have a variance of 55.5 squared.
    assert got == {1: (2, round(0.6 + 0.4 / (1 + 55.5**2 / 307), 6)), 2: (1, 1.0), 3: (0, 0.0)}


def test_frequent_keywords_and_downvotes(spark):
    c = spark.createDataFrame([("d", 1, ["Pain", " mood "]), ("d", 2, ["pain", "", None, "Sleep"]), ("d", 3, ["SLEEP", "PAIN"]), ("e", 1, None)], "doc string, place int, k array<string>")
    assert [(r["doc"], r["keywords"]) for r in catalog.frequent_keywords(c, "doc", "k", ["place"], 3).collect()] == [("d", ["Pain", "Sleep", "mood"])]
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("1", ["a", "a"], False, t), ("2", ["a", "b"], False, t), ("3", ["b"], True, t), ("4", None, False, t)], "feedback_id string, chunk_ids array<string>, positive boolean, given_at timestamp")
    log = log.withColumns({"received_at": F.col("given_at"), "query_text": F.lit("q"), "comment_text": F.lit(None).cast("string")})
    assert [tuple(r) for r in feedback.repeat_downvotes(log).collect()] == [("a", 0, 2)]


def test_typed_chunks(spark):
    blocks = spark.createDataFrame([("d", "b1", 1, " A head ", True), ("d", "b2", 1, " ", False), ("d", "b3", None, "text of four words", None)], "document_id string, block_id string, page int, text string, is_heading boolean")
    tabs = spark.createDataFrame([("d", 2, 7, "| a | b |"), ("d", 2, 9, None)], "document_id string, page int, place int, markdown string")
    pics = spark.createDataFrame([("d", 2, 1, "", "a picture")], "document_id string, page int, place int, ocr_text string, caption string")
    got = sorted((r["chunk_id"], r["type"], r["text"], r["tokens"]) for r in records.typed_chunks(blocks, tabs, pics).collect())
    assert got == [("b1", "heading", "A head", 2), ("b3", "text", "text of four words", 4), ("d_image_p2_0", "image", "a picture", 0), ("d_table_p2_0", "table", "| a | b |", 5), ("d_table_p2_1", "table", "", 0)]


def _in_batches(spark, folder, rows, schema):
    """One file for each list of rows, older files first."""
    folder.mkdir()
    for i, part in enumerate(rows):
        name = folder / f"{i}.parquet"
        spark.createDataFrame(part, schema).toPandas().to_parquet(name, coerce_timestamps="us", index=False)
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    return f"{folder}"


def test_streams_keep_state_across_batches(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    parts = [[("a", False, at(0)), ("b", True, at(1))], [("a", False, at(2)), ("a", False, at(3))], [("a", False, at(4)), ("a", True, at(5))]]
    src = jobs.read_log(spark, _in_batches(spark, tmp_path / "log", parts, "edge string, positive boolean, at timestamp"), 1).withColumns({"at": F.col("at").cast("timestamp"), "event_id": F.lit(1)})
    jobs.drain(jobs.alias_weights(src), f"{tmp_path}/w", "update")
    out = spark.read.parquet(f"{tmp_path}/w/out")
    assert out.agg(F.count_distinct("batch")).first()[0] >= 3
    last = {r["edge"]: r["weight"] for r in out.groupBy("edge").agg(F.max_by("weight", "batch").alias("weight")).collect()}
    assert last == {"a": 0.25, "b": 1.2}
    windows = jobs.sliding_failures(src, "at", ~F.col("positive"), "1 day", "4 hours", "2 hours")
    jobs.drain(windows, f"{tmp_path}/f", "complete")
    done = spark.read.parquet(f"{tmp_path}/f/out")
    top = done.agg(F.max("batch")).first()[0]
    assert sorted((r["start"].hour, r["n"], r["failures"]) for r in done.where(F.col("batch") == top).collect()) == [(0, 4, 3), (2, 4, 3), (4, 2, 1), (22, 2, 1)]


def test_upserts_across_batches_rewrite_only_what_they_touch(spark, tmp_path):
    parts = [[(k, 1, "first") for k in range(40)], [(3, 2, "second")], [(3, 0, "late"), (99, 1, "new")]]
    src = jobs.read_log(spark, _in_batches(spark, tmp_path / "log", parts, "k int, v int, t string"), 1)
    where = f"{tmp_path}/table"
    jobs.upsert_stream(src, where, ["k"], "v", f"{tmp_path}/state", buckets=8).awaitTermination()
    got = {r["k"]: r["t"] for r in jobs.current_version(spark, where).collect()}
    assert got == {k: "first" for k in range(40)} | {3: "second", 99: "new"}
    versions = [len(jobs._folders(spark, v)) for v in jobs._folders(spark, f"{where}/data")]
    assert len(jobs._folders(spark, f"{where}/lists")) == 2
    assert max(versions) >= 6 and sum(versions) <= 8 + 3
