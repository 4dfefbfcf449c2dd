"""Weighted sparse vectors and search over them as an inverted index.

A vector is rows (item, idx, weight). All of a vector lies within one row of text, so it is made there, a batch at a time, and nothing is shuffled.

Defined results: null and blank texts have no rows; every row is a text of its own, so repeated keys are to be dropped before; a token in several sources
takes the weight of the strongest source; tokens that share an index count as one, the first in the text deciding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as ft

SEARCH_TERM, KEYWORD, TEXT = 2.0, 1.5, 1.0


class RowTokens:
    """The distinct tokens of each row of a list column, with how often each stands there and where it first does."""

    def __init__(self, lists: pa.Array, without: frozenset[str] = frozenset()) -> None:
        # Offsets and values of a slice are those of the whole array, hence flatten and value lengths.
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.tokens: list[str] = flat.dictionary.to_pylist()
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        if without:
            keep = ~np.array([t in without for t in self.tokens] or [False])[code]
            row, place, code = row[keep], place[keep], code[keep]
        _, at, self.count = np.unique(row * max(1, len(self.tokens)) + code, return_index=True, return_counts=True)
        self.row, self.code, self.first = row[at], code[at], place[at]

    def peaks(self, rows: int) -> np.ndarray:
        """The largest count of each row."""
        out = np.zeros(rows, np.int64)
        np.maximum.at(out, self.row, self.count)
        return out


def index_of(token: str) -> int:
    """The sparse dimension of a token, as `functions.text.token_index` has it."""
    return int(hashlib.sha1(token.encode()).hexdigest()[:8], 16) % ft.SPARSE_DIM or 1


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Values of zero and above with so many digits, halves going up as in SQL; `np.round` takes 1/128 down to the even digit."""
    y = x * 10.0**digits
    low = np.floor(y)
    return (low + (y - low >= 0.5)) / 10.0**digits


def top_terms(df: DataFrame, key: str, terms: Column, k: int) -> DataFrame:
    """(`key`, term, n, rank): the `k` most frequent of each row's `terms` without stop words, ties by the first place."""
    src = df.select(F.col(key).alias("key"), terms.alias("terms"))
    kind, without = src.schema["key"].dataType, frozenset(ft.STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = RowTokens(b.column("terms"), without)
            order = np.lexsort((t.first, -t.count, t.row))
            row = t.row[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row, "left") + 1
            order, rank = order[rank <= k], rank[rank <= k]
            names = pa.array(t.tokens, pa.string()).take(pa.array(t.code[order]))
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(t.row[order])), names, pa.array(t.count[order], pa.int64()), pa.array(rank, pa.int32())], [key, "term", "n", "rank"])

    return src.mapInArrow(run, f"`{key}` {kind.simpleString()}, term string, n bigint, rank int")


def text_vectors(df: DataFrame, key: str, text: str, stop_words: bool = True, scope: list[str] | None = None, among: Iterable[int] | None = None) -> DataFrame:
    """(`key`, `scope`, idx, weight): term frequency over the text's largest; of tokens with one index the first in the text counts.

    `scope` names columns of `df` that go along. With `among` only the rows of these dimensions are given out, the weights staying as they are.
    """
    return _vectors(df, key, {"text": ft.words(ft.fold_case(F.col(text)))}, stop_words, scope or [], among)


def sparse_vectors(df: DataFrame, key: str, text: str, keywords: str | None = None, search_terms: str | None = None) -> DataFrame:
    """(`key`, idx, weight): search terms add 2.0 for each token, keywords give 1.5, the text its term frequency; the first of these that has an index decides."""
    split = lambda c: F.flatten(F.transform(F.filter(c, lambda t: t.isNotNull()), lambda t: ft.words(F.lower(t))))
    lists = {"search": split(search_terms)} if search_terms else {}
    if keywords:
        lists["keyword"] = split(keywords)
    return _vectors(df, key, lists | {"text": ft.words(ft.fold_case(F.col(text)))}, True)


def _vectors(df: DataFrame, key: str, lists: dict[str, Column], stop_words: bool, scope: list[str] | None = None, among: Iterable[int] | None = None) -> DataFrame:
    """Vectors from lists of tokens, the strongest source first."""
    owner = {"key": key} | {f"scope{i}": c for i, c in enumerate(scope or [])}
    src = df.select(*(F.col(c).alias(n) for n, c in owner.items()), *(c.alias(n) for n, c in lists.items()))
    kinds, without = [src.schema[n].dataType for n in owner], frozenset(ft.STOP_WORDS if stop_words else ())
    arrow, names = [to_arrow_type(k) for k in kinds], list(lists)
    asked = None
    if among is not None:
        bits = np.zeros(ft.SPARSE_DIM, bool)
        bits[list(among)] = True
        asked = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            parts = []
            for source, name in enumerate(names):
                t = RowTokens(b.column(name), without if name == "text" else frozenset())
                if len(known) > 500_000:
                    known.clear()
                idx = np.array([known.get(x) or known.setdefault(x, index_of(x)) for x in t.tokens] or [0], np.int64)[t.code]
                weight = t.count * SEARCH_TERM if name == "search" else np.full(len(idx), KEYWORD) if name == "keyword" else t.count / np.maximum(t.peaks(b.num_rows), 1)[t.row] * TEXT
                row, first = t.row, t.first
                if asked is not None:
                    met = asked.value[idx]
                    row, first, idx, weight = row[met], first[met], idx[met], weight[met]
                order = np.lexsort((first, idx, row))
                row, idx, weight = row[order], idx[order], weight[order]
                begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (idx[1:] != idx[:-1])])) if len(row) else np.empty(0, np.int64)
                # Search terms of one index add up; of words of the text the first decides.
                own = np.add.reduceat(weight, begins) if name == "search" and len(begins) else weight[begins]
                parts.append((row[begins], idx[begins], rounded(own), np.full(len(begins), source)))
            row, idx, weight, source = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((source, idx, row))
            row, idx, weight = row[order], idx[order], weight[order]
            keep = np.concatenate([[True], (row[1:] != row[:-1]) | (idx[1:] != idx[:-1])]) if len(row) else np.empty(0, bool)
            at = pa.array(row[keep])
            whose = [b.column(n).take(at).cast(a) for n, a in zip(owner, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*whose, pa.array(idx[keep]), pa.array(weight[keep])], [*owner.values(), "idx", "weight"])

    head = ", ".join(f"`{c}` {k.simpleString()}" for c, k in zip(owner.values(), kinds, strict=True))
    return src.mapInArrow(run, f"{head}, idx bigint, weight double")


def sparse_topk(queries: DataFrame, items: DataFrame, query: str | list[str], item: str, k: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(query, item, score, rank): the `k` items with the largest inner product with each query, ties by item.

    Products are summed as whole millionths, so a score is the same in whatever order it is summed.

    A query may be named by several columns, as its id and its side, so that several query sets share one pass over the index. The index is joined on the
    dimension. The query side is broadcast if it has `broadcast_rows` rows at most, which spares the index its shuffle; else Spark shuffles both and splits skewed dimensions.
    """
    names = [query] if isinstance(query, str) else query
    micro = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    q = queries.select(*(F.col(n).alias(f"_q{i}") for i, n in enumerate(names)), "idx", F.col("weight").alias("_w"))
    by = [f"_q{i}" for i in range(len(names))]
    if q.count() <= broadcast_rows:
        q = F.broadcast(q)
    score = items.join(q, "idx").groupBy(*by, item).agg((F.sum(micro("weight") * micro("_w")) / 1e12).alias("score"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), item)
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnsRenamed(dict(zip(by, names, strict=True)))
