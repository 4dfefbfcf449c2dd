"""The training-data operators against brute force, exact round trips and hand-made cases."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataquill.llm import leaks, near_dupes, neighbours, quality, queries, scans, splitting, tokens

WORD = re.compile(r"[^\W_]+")
ODD = ["", None, " ", "<|endoftext|> plain", "naïve café 😀👩‍👩‍👧 ́x", "a" * 5000, "x\r\n\f\t  y", " ", "日本語 テキスト", "don't  stop\n\n\nnow 123456", "퟿  \U0001f9ff"]


def found(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.select(*columns).collect()}


# ---- tokens


def test_ids_equal_the_library_and_decode_again(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.DEFAULT_PATH)
    tok.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD + ODD[:2])], "doc_id long, text string, ids string")
    out = tokens.token_ids(df, "doc_id", "text", spans=True)
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(ODD):
        want = tok.encode(t or "", add_special_tokens=False)
        assert rows[i]["ids"] == want.ids
        covered = set()
        for a, b in zip(rows[i]["starts"], rows[i]["ends"], strict=True):
            assert a < b
            covered |= set(range(a, b))
        assert covered == set(range(len(t or "")))
    assert {r["doc_id"]: r["text"] for r in tokens.decoded(out, "doc_id", "ids").collect()} == {i: t or "" for i, t in enumerate(ODD + ODD[:2])}
    assert tokens.token_ids(df.limit(0), "doc_id", "text").count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, "doc_id", "text").collect()} == {i: len(r["ids"]) for i, r in rows.items()}


def test_part_of_a_character_decodes_to_the_replacement():
    dec, enc = tokens.PieceDecoder.of(tokens.DEFAULT_PATH), tokens.PieceEncoder.of(tokens.DEFAULT_PATH)
    _, ids = enc.ids(["😀"])
    assert len(ids) > 1 and dec.text(ids) == "😀" and "�" in dec.text(ids[:1])


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 2000)
    enc = tokens.PieceEncoder(tokens.DEFAULT_PATH)
    a = [f"word{i} and more" for i in range(50)]
    assert [int(enc.counts([t])[0]) for t in a] == [len(enc.tok.encode(t).ids) for t in a]
    assert enc.held < 4000


def test_texts_of_other_scripts_leave_nothing_behind():
    enc = tokens.PieceEncoder(tokens.DEFAULT_PATH)
    a = [f"{i} " * 1000 + "\U0001f600" for i in range(200)] + ["x" * 5000, "a short text"]
    assert enc.counts(a).tolist() == [len(enc.tok.encode(t).ids) for t in a]
    assert max(map(len, enc.number)) <= tokens.LONGEST_CACHED and enc.held < 10_000 and len(enc.pool) < 1000
    offsets, ids = enc.ids(a)
    assert [ids[i:j].tolist() for i, j in zip(offsets, offsets[1:], strict=False)] == [enc.tok.encode(t).ids for t in a]


def test_budget_totals(spark, sf):
    counts = queries.p1_token_counts(spark, sf).cache()
    cube = queries.p1_token_budget(spark, sf).collect()
    want = Counter()
    for r in counts.collect():
        for m in range(8):
            k = [v if m >> i & 1 else "ALL" for i, v in enumerate((r["source"], r["lang"], r["domain"]))]
            want[r["corpus"], *k] += r["n_tokens"]
    assert {(r["corpus"], r["source"], r["lang"], r["domain"]): r["tokens"] for r in cube} == dict(want)
    assert {r["lang"] for r in cube} <= {"ALL", "unknown", "en", "fr", "de", "es"}
    n = spark.read.parquet(f"{sf}/chunks.parquet").select("chunk_id").distinct().count()
    assert counts.where("corpus = 'chunks'").count() == n


# ---- neighbours


def brute(df, k=10):
    import pandas as pd

    t = df.toPandas().sort_values("upserted_at", kind="stable").drop_duplicates(["chunk_id", "track"], keep="last")
    ok = t.vector.map(lambda v: v is not None and len(v) == 64 and np.isfinite(np.array(v, float)).all() and np.any(v))
    t = t[ok & t.knowledge_base_id.notna()].sort_values("chunk_id")
    out = {}
    for _, g in t.groupby(["knowledge_base_id", "track"]):
        x = np.stack(g.vector.to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        s = x @ x.T
        np.fill_diagonal(s, -9)
        ids = g.chunk_id.to_numpy()
        for i, row in enumerate(np.round(s, 12)):
            out[ids[i], g.track.iloc[0]] = [(ids[j], s[i, j]) for j in np.argsort(-row, kind="stable")[:k] if j != i]
    assert isinstance(t, pd.DataFrame)
    return out


def test_found_pairs_and_recall(spark):
    sf = "/root/testdata/sf0.01"
    want = brute(spark.read.parquet(f"{sf}/vectors.parquet"))
    near = queries.p2_neighbours(spark, sf).cache()
    got = {}
    for r in near.collect():
        got.setdefault((r["chunk_id"], r["track"]), []).append(r["neighbour"])
    assert got.keys() == {k for k, v in want.items() if v}
    hits = sum(len({n for n, _ in v} & set(got.get(k, ()))) for k, v in want.items())
    assert hits / sum(map(len, want.values())) > 0.95
    pairs = {(min(a, b), max(a, b), t) for (a, t), v in want.items() for b, s in v if s >= 0.9}
    assert found(queries.p2_found(spark, sf), "chunk_a", "chunk_b", "track") == pairs


def test_many_cells_keep_recall_and_parts_keep_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 64))
    x = np.concatenate([base, base + 0.1 * rng.normal(size=base.shape), base[:20], base[:1].repeat(40, 0)])
    df = spark.createDataFrame([(f"c{i:04d}", "kb", "t", [float(v) for v in row], 0, "clash") for i, row in enumerate(x)], "chunk_id string, knowledge_base_id string, track string, vector array<float>, upserted_at int, item string")
    want = brute(df)
    for options in ({"cell_rows": 64}, {"cell_rows": 32, "block_cells": 2, "slice_rows": 100}, {"part_rows": 50, "max_level": 0}):
        got = {}
        for r in neighbours.nearest_vectors(df, "chunk_id", "knowledge_base_id", "track", "vector", "upserted_at", **options).collect():
            got.setdefault((r["chunk_id"], "t"), {})[r["rank"]] = r["neighbour"]
        assert all(len(v) == 10 for v in got.values()) and len(got) == len(x)
        near = [(k, n) for k, v in want.items() for n, s in v if s >= 0.9]
        assert sum(n in got[k].values() for k, n in near) / len(near) > 0.99


def test_a_close_group_is_split_by_its_real_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    apart, close = rng.normal(size=(600, 64)), np.ones(64) + 0.01 * rng.normal(size=(600, 64))
    rows = [(f"{g}{i:04d}", g, "t", [float(v) for v in row], 0) for g, x in (("a", apart), ("b", close)) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "chunk_id string, knowledge_base_id string, track string, vector array<float>, upserted_at int")
    seen = spark.sparkContext.accumulator(0)
    found_in = neighbours._search

    def counted(*args):
        run = found_in(*args)
        def spied(batches):
            def seen_by(b):
                seen.add(len(set(zip(*(b.column(c).to_pylist() for c in ("grp", "block", "part")), strict=True)) & {("b", x, p) for x in range(8) for p in range(1, 99)}))
                return b
            return run(map(seen_by, batches))
        return spied

    monkeypatch.setattr(neighbours, "_search", counted)
    near = neighbours.nearest_vectors(df, "chunk_id", "knowledge_base_id", "track", "vector", "upserted_at", cell_rows=75, part_rows=150, slice_rows=100, recall=0.9999)
    got = {(r["chunk_id"], r["rank"]): r["neighbour"] for r in near.collect()}
    want = {(k, n): x for (k, _), v in brute(df).items() for n, (x, _) in enumerate(v, 1)}
    assert seen.value > 0
    assert {k: v for k, v in got.items() if k[0] > "b"} == {k: v for k, v in want.items() if k[0] > "b"}


def test_code_books_fit_the_residuals_of_their_level():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 64))
    x = neighbours._unit(np.concatenate([c + 0.1 * rng.normal(size=(256, 64)) for c in centres])).astype(np.float32)
    own, other = neighbours.Level.fit(x, 3, 4), neighbours.Level.fit(x, 0, 4)
    cell = neighbours.nearest(x, own.coarse)
    error = lambda lv: ((x - lv.decode(cell, lv.encode(x, cell))) ** 2).sum(1).mean()
    right = error(own)
    own.books = other.books
    assert right < 0.8 * error(own)


def test_many_centroids_take_little_memory():
    import tracemalloc

    c = np.random.default_rng(1).normal(size=(4096, 64)).astype(np.float32)
    tracemalloc.start()
    near = neighbours._near_cells(c, neighbours.MOST_PROBES)
    neighbours.nearest(np.repeat(c, 4, 0), c)
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert near.shape == (4096, 64) and (near[:, 0] == np.arange(4096)).all()
    d = ((c[7] - c) ** 2).sum(1)
    assert near[7].tolist() == np.argsort(d)[:64].tolist()


def test_recall_is_met_where_vectors_are_loosely_clustered(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 64)).repeat(200, 0) + rng.normal(size=(4000, 64))
    df = spark.createDataFrame([(f"v{i:05d}", "kb", "t", [float(v) for v in row], 0) for i, row in enumerate(x)], "chunk_id string, knowledge_base_id string, track string, vector array<float>, upserted_at int")
    got = {}
    for r in neighbours.nearest_vectors(df, "chunk_id", "knowledge_base_id", "track", "vector", "upserted_at", cell_rows=250, block_cells=4).collect():
        got.setdefault((r["chunk_id"], "t"), set()).add(r["neighbour"])
    want = brute(df)
    assert sum(len({n for n, _ in v} & got[k]) for k, v in want.items()) / sum(map(len, want.values())) > 0.95


def test_unusable_vectors(spark):
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0] * 63, [None] + [1.0] * 63]
    rows = [(f"b{i}", "kb", "t", v, 1) for i, v in enumerate(bad)] + [("a", "kb", "t", [1.0] * 64, 2), ("a", "kb", "t", None, 1), ("c", "kb", "t", [2.0] * 64, 1), ("c", "kb", "t", [2.0] * 64, 1), ("d", None, "t", [1.0] * 64, 1), ("e", "kb", "t", [1.0] * 64, 1), ("e", "kb", "t", None, 9)]
    df = spark.createDataFrame(rows, "chunk_id string, knowledge_base_id string, track string, vector array<float>, upserted_at int")
    got = neighbours.nearest_vectors(df, "chunk_id", "knowledge_base_id", "track", "vector", "upserted_at")
    assert found(got, "chunk_id", "neighbour", "rank") == {("a", "c", 1), ("c", "a", 1)}
    assert neighbours.nearest_vectors(df.limit(0), "chunk_id", "knowledge_base_id", "track", "vector", "upserted_at").count() == 0


# ---- splitting


@pytest.mark.parametrize("seed", range(25))
def test_pieces_cover_the_text_within_the_limit(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "longerword", " ", "\n\n", ". ", "!” ", "\n \n", "x" * rng.randint(1, 80), "é", " "]) for _ in range(rng.randint(1, 200)))
    limit, overlap = rng.randint(5, 120), rng.randint(0, 40)
    pieces = splitting.split_text(text, limit, overlap)
    end = 0
    for n, (a, new, b) in enumerate(pieces):
        assert a <= new < b and b - a <= limit and text[a:b] == text[a:b].strip()
        assert not text[end:new].strip(), "nothing is lost"
        assert new - a <= overlap + (new - end) and (n or a == new)
        end = b
    assert not text[end:].strip()


def test_boundaries():
    kind = lambda t, m: splitting.boundary_of(t, m)
    assert kind("aaaa\n \t\nbbbb", 5) == "paragraph"
    assert kind("aaa. bbb! (ccc.) ddd", 6) == "sentence"
    assert kind("aaa bbb ccc ddd", 6) == "word"
    assert kind("a" * 20, 6) == "none"


def test_sections_begin_pieces():
    body = "Some words of a sentence here. " * 3
    text = f"First Part\n\n{body}\n\nSecond Part\n\n{body}\n\nno heading as it ends.\n\n{body}"
    pieces = [text[a:b] for a, _, b in splitting.split_text(text, 150)]
    assert [p.split("\n")[0] for p in pieces[:2]] == ["First Part", "Second Part"]
    assert pieces[1].endswith("no heading as it ends.")  # ends in a stop, so it begins nothing
    assert splitting._cuts("a\fb", -1) == [0, 2, 3]


def test_split_rows(spark):
    df = spark.createDataFrame(
        [("a", "one two three. four five six.\fseven", 20, 5, 3, 4), ("a", "one two three. four five six.\fseven", 20, 5, 3, 4), ("b", "short", 20, 5, 1, 1), ("c", None, 20, 5, 1, 1), ("d", "x" * 50, 20, None, None, None), ("e", "y" * 50, None, 5, 1, 1)],
        "id string, t string, m int, o int, p int, q int",
    )
    got = splitting.split_oversized(df, "id", "t", "m", "o", "p", "q").orderBy("id", "piece_no").collect()
    assert {r["id"] for r in got} == {"a", "d"}
    assert [(r["start_page"], r["end_page"]) for r in got if r["id"] == "a"][-1] == (3, 4)  # its overlap stands on page 3
    assert [r["text"] for r in got if r["id"] == "d"] == ["x" * 20, "x" * 20, "x" * 10]
    assert splitting.split_oversized(df.limit(0), "id", "t", "m", "o").count() == 0


# ---- near-duplicates


def grams(t):
    w = WORD.findall(t.lower())
    return set(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 20 else set()


def brute_pairs(rows):
    rows = {r[0]: (r[1], grams(r[2])) for r in rows if r[2]}
    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (da, x), (db, y) = rows[a], rows[b]
            if x and y and da != db and len(x & y) / len(x | y) >= 0.6:
                yield a, b


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for v in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[at] = rng.choice(vocab)
                else:
                    w.insert(at, rng.choice(vocab))
            rows.append((f"c{g:02d}{v}", f"d{rng.randrange(200)}", " ".join(w)))
    rows += [("s1", "x", "too short"), ("s2", "y", "too short"), ("n", "z", None), ("e", "z", ""), *rows[:5]]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, text string").withColumn("rid", F.lit("clash"))
    got = found(near_dupes.near_duplicate_pairs(df, "chunk_id", "document_id", "text"), "chunk_id_a", "chunk_id_b")
    assert got == set(brute_pairs(rows))
    assert near_dupes.near_duplicate_pairs(df.limit(0), "chunk_id", "document_id", "text").count() == 0


def test_hot_shard_is_split_without_loss(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(f"c{i:03d}", f"d{i}", " ".join(base[: i % 60] + [f"x{i}"] + base[i % 60 :])) for i in range(120)]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, text string")
    signed = near_dupes.signed_items(df, "chunk_id", "document_id", "text", 3, 20)
    whole = found(near_dupes.candidate_pairs(signed, 0.6), "rid_a", "rid_b")
    assert found(near_dupes.candidate_pairs(signed, 0.6, part_size=7), "rid_a", "rid_b") == whole
    assert len(whole) == 120 * 119 // 2


def test_bk_tree_equals_a_scan():
    rng = random.Random(1)
    codes = [rng.getrandbits(128) for _ in range(200)] + [0, 0]
    tree = near_dupes.BKTree()
    for i, c in enumerate(codes):
        tree.add(c, i)
    for r in (0, 20, 55, 128):
        assert sorted(tree.within(codes[3], r)) == [i for i, c in enumerate(codes) if (c ^ codes[3]).bit_count() <= r]


def test_groups(spark):
    links = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("z1", "z2"), ("z1", "z2")], "a string, b string")
    got = {r["item"]: r["group"] for r in near_dupes.components(links, "a", "b").collect()}
    assert set(got.values()) == {"n00", "z1"} and len(got) == 23


def test_groups_of_classes_equal_those_of_pairs(spark):
    base, other = [f"w{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    near = " ".join([*base[:20], "x", *base[20:]])
    rows = [("a", "d1", " ".join(base)), ("b", "d1", " ".join(base)), ("c", "d1", near), ("e", "d2", near), ("f", "d3", " ".join(other)), ("g", "d3", " ".join(other)), ("h", "d3", " ".join(other[1:])), ("i", None, " ".join(v + "z" for v in base)), ("j", None, " ".join(v + "z" for v in base))]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, text string")
    pairs = near_dupes.near_duplicate_pairs(df, "chunk_id", "document_id", "text")
    want = {r["item"]: r["group"] for r in near_dupes.components(pairs, "chunk_id_a", "chunk_id_b").collect()}
    assert want == {**dict.fromkeys("abce", "a"), "i": "i", "j": "i"}
    assert {r["chunk_id"]: r["group_id"] for r in near_dupes.near_duplicate_groups(df, "chunk_id", "document_id", "text").collect()} == want


def test_a_search_visits_few_nodes_of_its_tree():
    rng, shard, visited = random.Random(2), near_dupes._Shard(None), 0
    for i in range(4000):
        shard.add(rng.getrandbits(64), i, rng.getrandbits(64))
    for _ in range(100):
        code, stack = rng.getrandbits(near_dupes.TREE_BITS), [shard.tree.root]
        while stack:
            node = stack.pop()
            visited += 1
            d = (node[0] ^ code).bit_count()
            stack += [c for e, c in node[2].items() if abs(d - e) <= near_dupes.TREE_RADIUS]
    assert visited / 100 <= 400


@pytest.mark.parametrize(("own", "least"), [(20, 0.985), (16, 0.997)])
def test_recall_from_the_threshold_up(own, least):
    found, n = 0, 1500  # 60 triples in common and 20 of each own: similarity 0.60; 16: 0.65
    texts = [[*(f"c{t}x{i}" for i in range(62)), *(f"{s}{t}x{i}" for i in range(own))] for t in range(n) for s in "ab"]
    bands, codes = near_dupes.signatures(texts, 3)
    radius = near_dupes.radius_for(0.6)
    for x, y, c, d in zip(bands[::2].tolist(), bands[1::2].tolist(), codes[::2].tolist(), codes[1::2].tolist(), strict=True):
        met = any(i >> near_dupes.TREE_BITS == j >> near_dupes.TREE_BITS and (i ^ j).bit_count() <= near_dupes.TREE_RADIUS for i, j in zip(x, y, strict=True))
        found += met and ((c ^ d) & 2**64 - 1).bit_count() <= radius
    assert found / n >= least


def test_found_on_the_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/chunks.parquet").select("chunk_id", "document_id", "text").dropDuplicates(["chunk_id"]).collect()]
    share = Counter(g for r in rows if r[2] for g in grams(r[2]))
    few = [r for r in rows if r[2] and any(share[g] > 1 for g in grams(r[2]))]
    index = {}
    for r in few:
        for g in grams(r[2]):
            index.setdefault(g, []).append(r)
    close = {(a[0], b[0]) for v in index.values() if len(v) < 40 for a in v for b in v if a[0] < b[0]}
    by = {r[0]: r for r in few}
    want = {p for p in close if list(brute_pairs([by[p[0]], by[p[1]]]))}
    assert found(queries.p5_found(spark, sf), "chunk_a", "chunk_b") == want


# ---- leaks


def test_leaks_against_all_windows(spark, sf):
    fold = lambda t: WORD.findall("".join(c for c in unicodedata.normalize("NFD", t or "") if not unicodedata.combining(c)).lower())
    sf = "/root/testdata/sf0.01"
    items, docs = (spark.read.parquet(f"{sf}/{n}.parquet").collect() for n in ("eval_items", "documents"))
    windows = {}
    for r in items:
        for t in (r["question"], r["answer"]):
            w = fold(t)
            for i in range(len(w) - 11):
                windows.setdefault(tuple(w[i : i + 12]), set()).add(r["item_id"])
    want = set()
    for r in docs:
        w = fold(r["text"])
        for g in zip(*(w[i:] for i in range(12)), strict=False):
            want |= {(r["doc_id"], i) for i in windows.get(g, ())}
    assert found(queries.p7_found(spark, sf), "doc_id", "item_id") == want


def test_leaks_with_edits_blocks_and_odd_rows(spark):
    w = [f"word{i}" for i in range(30)]
    edited = [*w[:5], "other", *w[6:20], *w[21:]]
    docs = spark.createDataFrame([(1, "Prefix " + " — ".join(w).upper()), (2, " ".join(edited)), (3, None), (4, ""), (5, " ".join(w[::-1]))], "doc_id int, text string")
    items = spark.createDataFrame([(7, " ".join(w), None), (8, " ".join(w), ""), (9, "short one", None), (9, "short one", None)], "item_id int, q string, a string")
    run = lambda **k: found(leaks.find_leaks(docs, items, "doc_id", "text", "item_id", ["q", "a"], **k), "doc_id", "item_id")
    assert run() == {(1, 7), (1, 8), (2, 7), (2, 8)}
    assert run(window=30) == {(1, 7), (1, 8)}
    assert run(window=29, max_edits=3, sampled=3) == {(1, 7), (1, 8), (2, 7), (2, 8)}
    assert run(max_edits=1, sampled=3, block_windows=10) >= {(1, 7), (1, 8), (2, 7), (2, 8)}
    assert run(block_windows=10) == {(1, 7), (1, 8), (2, 7), (2, 8)}
    assert leaks.find_leaks(docs, items.limit(0), "doc_id", "text", "item_id", ["q", "a"]).count() == 0
    assert leaks.find_leaks(docs.limit(0), items, "doc_id", "text", "item_id", ["q", "a"]).count() == 0


def test_near_leaks_against_all_windows(spark, sf):
    near = found(queries.p7_near(spark, sf), "doc_id", "item_id")
    assert found(queries.p7_found(spark, sf), "doc_id", "item_id") <= near
    items, docs = (spark.read.parquet(f"{sf}/{n}.parquet").collect() for n in ("eval_items", "documents"))
    parts = [(r["item_id"], w[i : i + 12]) for r in items for t in (r["question"], r["answer"]) for w in [leaks._words(t)] for i in range(len(w) - 11)]
    theirs = np.stack([leaks.word_hashes(w) for _, w in parts])
    want = set()
    for r in docs:
        w = leaks.word_hashes(leaks._words(r["text"]))
        for i in range(len(w) - 11):
            # A pair within one edit has most words in common.
            few = np.flatnonzero(np.isin(theirs, w[i : i + 12]).sum(1) >= 11)
            near_by = leaks.edit_distances(np.broadcast_to(w[i : i + 12], (len(few), 12)), theirs[few], 1) <= 1
            want |= {(r["doc_id"], parts[k][0]) for k in few[near_by]}
    assert near <= want and len(near & want) >= 0.98 * len(want)


def test_repetitions_hold_on_fresh_pairs():
    n = leaks.repetitions(12, 1, 4, 0.99)
    rng, rows = np.random.default_rng(77), []
    for _ in range(4000):
        a = list(rng.integers(1, 2**63, 12, dtype=np.uint64))
        b, at = list(a), int(rng.integers(12))
        kind = rng.integers(3)
        if kind == 0:
            b[at] = rng.integers(1, 2**63, dtype=np.uint64)
        elif kind == 1:
            b.insert(at, rng.integers(1, 2**63, dtype=np.uint64))
        else:
            del b[at]
        rows += [a, (b + list(rng.integers(1, 2**63, 12, dtype=np.uint64)))[:12]]
    h = np.concatenate([np.array(rows, np.uint64).ravel(), np.zeros(13, np.uint64)])
    hit = np.zeros(4000, bool)
    for seed in range(n):
        k = leaks.walk_keys(h, np.arange(8000) * 12, 12, 4, seed)
        hit |= k[::2] == k[1::2]
    assert hit.mean() >= 0.988


def test_edit_distance():
    assert leaks.edit_distance(list("kitten"), list("sitting"), 3) == 3
    assert leaks.edit_distance(list("kitten"), list("sitting"), 2) == 3
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, (300, 6)), rng.integers(0, 3, (300, 6))
    for most in (0, 1, 3):
        assert leaks.edit_distances(a, b, most).tolist() == [min(int(leaks.edit_distance(list(x), list(y), most)), most + 1) for x, y in zip(a, b, strict=True)]


# ---- scans


def test_scan_noise(spark):
    body = ["The visiting nurse compared the progress note with the safety", "plan after the team meeting of the month. The family and the nurse"]
    pages = []
    for p, word in enumerate(("river", "stone", "cloud", "table"), 1):
        lines = [f"Notes on the plan Ostbrook  {p}", *(x.replace("The", f"The {word}") for x in body), f"The {word} of the well-known home-", "based team had the pro-", "gress note and the sarety plan." if p == 9 else "gress note and the safety plan.", f"- {p} -"]
        pages.append((f"d|s|{p}", "d", "semantic", p, p, "\n".join(lines)))
    text = " ".join(["The nurse had the progress note and the home-based plan of the family."] * 60)
    clean = [(f"e|s|{i}", f"e{i}", "semantic", 1, 1, text) for i in range(4)]
    bad = [("f|s|1", "f", "semantic", 7, 8, "The nur5e had the progrcss note\r\nand 7\r\n365\r\nCode T-1910 of the farnily."), ("n", "f", "semantic", 1, 1, None), ("m", "f", None, None, None, " \n ")]
    df = spark.createDataFrame(pages + clean + bad + pages[:1], "chunk_id string, document_id string, chunk_tier string, start_page int, end_page int, text string")
    cw = spark.createDataFrame([("en", w, i) for i, w in enumerate(("the", "of", "and", "had", "with", "after"))], "lang string, word string, word_rank int")
    noise = scans.scan_noise(df, cw)
    got = found(noise, "chunk_id", "line_no", "kind")
    want = {(f"d|s|{p}", n, k) for p in range(1, 5) for n, k in ((1, "header"), (5, "hyphen"), (7, "page_number"))}
    want |= {("f|s|1", 1, "char"), ("f|s|1", 4, "char")}
    assert got == want
    fixed = {r["chunk_id"]: r["text"] for r in scans.repaired_text(df, noise).collect()}
    assert fixed["d|s|1"].endswith("had the progress note and the safety plan.") and "Notes on" not in fixed["d|s|1"]
    assert fixed["f|s|1"] == "The nurse had the progress note and 7 365 Code T-1910 of the family."
    assert scans.scan_noise(df.limit(0), cw).count() == 0


def test_a_repeated_corpus_has_the_same_noise(spark):
    clean = "The counselor had the note of the work and of the shop."
    texts = [*[clean] * 24, *["The counsclor had the note of the week."] * 3, *["The plan of the work-\nshop of the day."] * 8, "The form of the note-\nshop of the day."]
    cw = spark.createDataFrame([("en", w, i) for i, w in enumerate(("the", "of", "and", "had"))], "lang string, word string, word_rank int")
    got = []
    for times in (1, 10):
        rows = [(f"{r}|{i}", f"{r}|{i}", "semantic", 1, 1, t) for r in range(times) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_tier string, start_page int, end_page int, text string")
        got.append(sorted(found(scans.scan_noise(df, cw).where("chunk_id like '0|%'"), "chunk_id", "line_no", "kind")))
    # The halves of the first cut stand alone three times as often as it comes, those of the second 24 times.
    assert got[0] == got[1] == sorted([*((f"0|{i}", 1, "char") for i in range(24, 27)), *((f"0|{i}", 1, "hyphen") for i in range(27, 35))])


@pytest.mark.parametrize(("line", "first", "last", "page"), [("x" * 30, 3, 4, None), ("~ 3 ~", 3, 4, 3), ("iv", 4, 4, 4), ("Page l of 33", 1, 1, 1), ("[2l]", 20, 21, 21), ("4/53", 2, 4, 4), ("365", 1, 3, None), ("p. 3", 3, 3, 3), ("Seite 5 von 48", 5, 5, 5), ("x", 1, 9, None), ("3 items", 3, 3, None)])
def test_page_numbers(line, first, last, page):
    assert scans.page_of(line, first, last) == page


def test_misreadings():
    for right, wrong in (("morning", "morriing"), ("within", "vvithin"), ("should", "sliould"), ("budget", "buclget"), ("sample", "5ample")):
        assert scans.skeleton(right) == scans.skeleton(wrong)
        assert scans.misreading(right, wrong, 2)
    assert scans.misreading("family", "famly", 3) is None
    assert scans._likely("1ncxpcricnced", 1, 1, "inexperienced", 40, 40) == [0, 2, 5, 8] and scans._likely("a8out", 1, 1, "about", 40, 40) == [1]
    assert scans.misreading("form", "from", 3) is None


# ---- quality


def test_kinds(spark, sf):
    prose = "The nurse had the note of the family. It was sent to the team in the morning, and they read it with care. "
    rows = [
        (1, prose * 3), (2, "- plan\n- note\n- list of names\n- safety card\n- visit"), (3, "a;b;c\n1;2;3\n4;5;6\n7;8;9\n1;2;2\n"), (4, "QmFzZTY0IGRhdGEgaXMgaGVyZQ9876543210QmFzZTY0IGRhdGEgaXMgaGVyZQ9876543210"),
        (5, "plan note card list visit tool chart map drill home sheet file group call sleep mood risk goal audit trail"), (6, None), (7, ""), (8, " \n"), (9, prose.upper() * 2), (10, "#$%^&*(){}[]<>~~|\\/@@!!" * 6), (11, "buy now " * 60),
    ]
    docs = spark.createDataFrame(rows + rows[1:2], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    cw = spark.read.parquet(f"{sf}/common_words.parquet")
    found_kinds = quality.document_kinds(docs, "doc_id", "text", cw).collect()
    got = [(r["doc_id"], r["kind"]) for r in found_kinds]
    assert {r["doc_id"]: r["profile"] for r in found_kinds} == {2: "marked", 3: "cells", 4: "coded", 5: "heap", 10: "repeated", 11: "repeated"}
    assert all(r["divergence"] < r["prose_divergence"] for r in found_kinds)
    assert sorted(got) == [(2, "list"), (2, "list"), (3, "table"), (4, "junk"), (5, "junk"), (10, "junk"), (11, "junk")]
    assert quality.document_kinds(docs.limit(0), "doc_id", "text", cw).count() == 0
    s = {r["doc_id"]: r for r in quality.text_stats(docs, "doc_id", "text", cw).collect()}
    assert s[6]["n_words"] == 0 and s[6]["mean_word_length"] is None and s[1]["terminal_line_share"] == 1.0


def test_divergence():
    p = np.array([1.0, 0.0])
    assert quality.divergence(p, p) == 0 and quality.divergence(p, p[::-1]) == 1


# ---- registry


def test_twins(spark, sf, duck):
    for name, sql in queries.ORACLE_SQL.items():
        got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        plain = lambda df: Counter(tuple(None if v != v else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
        assert plain(got) == plain(want), name
