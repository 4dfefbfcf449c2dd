"""Vector search with a stated query set, and operations on ranked lists.

Ranked lists are rows (query, item, rank or score). Every order has the item as its last key, so results are the same in any run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def metadata_filter(filters: dict[str, object]) -> Column:
    """The conjunction of filters: a list means any of its values, a scalar equality as strings, None nothing; a missing value never matches."""
    tests = [F.lit(True)]
    for name, value in filters.items():
        if value is None:
            continue
        c = F.col(name).cast("string")
        tests.append(F.coalesce(c.isin([str(v) for v in value]) if isinstance(value, list | tuple | set) else c == str(value), F.lit(False)))
    return reduce(lambda a, b: a & b, tests)


def dense_topk(
    queries: DataFrame, items: DataFrame, *, query: str, item: str, vector: str, k: int, partition: list[str],
    digits: int = 6, broadcast_bytes: int = 48 << 20, block_rows: int = 65536,
) -> DataFrame:
    """(query, item, score, rank): the `k` items most similar to each query by cosine, rounded to `digits`, ties by item.

    `partition` names the columns that must be equal in query and item: tenant, knowledge base, track. An empty list must be given
    openly. Vectors are compared with those of their own length only. A query set of `broadcast_bytes` at most is sent to the tasks, which read the items where they
    lie; a larger one is shuffled in blocks of `block_rows` queries, each against the items of its partition in blocks of as many, so no task
    holds more than two blocks. Either way a task keeps the best k for each query. Null ids, null vectors and vectors with a null, NaN or infinite
    value match nothing; an all-zero vector scores 0; repeated ids each count.
    """
    by = [*partition, "dim"]
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def side(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), *partition).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine).withColumn("dim", F.size("v"))

    asked, src = side(queries, query), side(items, item)
    kinds = asked.schema["id"].dataType, src.schema["id"].dataType
    out = f"q {kinds[0].simpleString()}, item {kinds[1].simpleString()}, score double"
    size = asked.agg(F.count("*").alias("n"), F.sum(F.col("dim") * 8 + 64).alias("bytes")).first()
    if (size["bytes"] or 0) <= broadcast_bytes:
        sent = asked.sparkSession.sparkContext.broadcast(asked.toArrow())
        found = src.mapInArrow(_scan(sent, by, k, digits, to_arrow_type(kinds[0])), out)
    else:
        found = _blocks(asked, src, by, block_rows).mapInArrow(_meet(k, digits, len(by) + 2), out)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query if query != item else f"query_{query}"), F.col("item").alias(item), "score", "rank")


def _blocks(asked: DataFrame, src: DataFrame, by: list[str], block_rows: int) -> DataFrame:
    """Rows of both sides sorted by block, queries first: each block of queries meets each block of items of its partition."""
    n = lambda df, name: df.groupBy(*by).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    many = n(asked, "nq").join(n(src, "ni"), by)  # a partition without queries or items drops out
    home = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    q = asked.join(many, by).select(*by, home("nq").alias("qb"), every("ni").alias("ib"), F.lit(True).alias("asks"), F.col("id").alias("q"), F.lit(None).cast(src.schema["id"].dataType).alias("item"), "v")
    i = src.join(many, by).select(*by, every("nq").alias("qb"), home("ni").alias("ib"), F.lit(False).alias("asks"), F.lit(None).cast(asked.schema["id"].dataType).alias("q"), F.col("id").alias("item"), "v")
    at = [*by, "qb", "ib"]
    return q.unionByName(i).repartition(*at).sortWithinPartitions(*at, F.desc("asks")).select(*at, "asks", "q", "item", "v")


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class _Best:
    """A block of queries and the best items found for each so far."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int, digits: int) -> None:
        self.ids, self.unit, self.k, self.digits = ids, _unit(vectors), k, digits
        self.score: np.ndarray | None = None
        self.items: pa.Array | None = None

    def add(self, items: pa.Array, vectors: np.ndarray) -> None:
        """Take in some items; a step looks at few queries at a time, so the scores held stay few."""
        unit = _unit(vectors)
        order = np.empty(len(items), np.int64)
        order[pc.sort_indices(items).to_numpy()] = np.arange(len(items))
        n = min(self.k, len(items))
        step = max(1, 4_000_000 // max(1, len(items)))
        tops, scores = [], []
        for i in range(0, len(self.ids), step):
            score = np.round(self.unit[i : i + step] @ unit.T, self.digits)
            top = np.lexsort((np.broadcast_to(order, score.shape), -score), axis=1)[:, :n]
            tops.append(top)
            scores.append(np.take_along_axis(score, top, 1))
        top, score = np.concatenate(tops), np.concatenate(scores)
        flat = items.take(pa.array(top.ravel()))
        if self.score is None:
            self.score, self.items = score, flat
            return
        # Both lists side by side, the best k of them kept.
        had = self.score.shape[1]
        both = np.concatenate([self.score, score], 1)
        pool = pa.concat_arrays([self.items, flat])
        place = np.concatenate([np.arange(self.score.size).reshape(-1, had), self.score.size + np.arange(score.size).reshape(score.shape)], 1)
        order = np.empty(len(pool), np.int64)
        order[pc.sort_indices(pool).to_numpy()] = np.arange(len(pool))
        keep = np.lexsort((order[place], -both), axis=1)[:, : self.k]
        self.score = np.take_along_axis(both, keep, 1)
        self.items = pool.take(pa.array(np.take_along_axis(place, keep, 1).ravel()))

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.score is not None:
            rows = np.repeat(np.arange(len(self.ids)), self.score.shape[1])
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(rows)), self.items, pa.array(self.score.ravel())], ["q", "item", "score"])


def _groups(b: pa.RecordBatch, by: list[str]) -> dict[tuple, list[int]]:
    """The rows of a batch by the values of columns; rows with a null among them belong to no group."""
    out: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in by), strict=True)):
        if None not in key:
            out.setdefault(key, []).append(i)
    return out


def _scan(sent, by: list[str], k: int, digits: int, kind: pa.DataType):
    """Every item against the queries of its group, which the driver sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: pa.Table = sent.value
        best: dict[tuple, _Best] = {}
        if asked.num_rows:
            (q,) = asked.combine_chunks().to_batches()
            for key, rows in _groups(q, by).items():
                own = q.take(pa.array(rows))
                best[key] = _Best(own.column("id").cast(kind), _matrix(own.column("v")), k, digits)
        for b in batches:
            for key, rows in _groups(b, by).items():
                if key in best:
                    own = b.take(pa.array(rows))
                    best[key].add(own.column("id"), _matrix(own.column("v")))
        for x in best.values():
            yield from x.result()

    return run


def _meet(k: int, digits: int, keys: int):
    """Rows sorted by block (the first `keys` columns), queries first -> the best items of each block's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None
        waiting: list[pa.RecordBatch] = []

        def begin() -> _Best | None:
            if not waiting:
                return None
            q = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting.clear()
            return _Best(q.column("q"), _matrix(q.column("v")), k, digits)

        for b in batches:
            names = b.schema.names[:keys]
            for key, rows in _groups(b, [*names, "asks"]).items():
                own = b.slice(rows[0], len(rows))  # sorted, so the rows of a group lie together
                if key[:-1] != block:
                    if best:
                        yield from best.result()
                    block, best = key[:-1], None
                    waiting.clear()
                if key[-1]:
                    waiting.append(own)
                else:
                    best = best or begin()
                    if best:
                        best.add(own.column("item"), _matrix(own.column("v")))
        if best:
            yield from best.result()

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def ranked(df: DataFrame, by: list[str], score: str = "score", item: str = "item", k: int | None = None) -> DataFrame:
    """`df` with the rank of each row in its list; only the first `k`, if given."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), item)))
    return out.where(F.col("rank") <= k) if k else out


def rrf_classic(lists: DataFrame, query: str, item: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the lists an item is in."""
    return lists.groupBy(query, item).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 6).alias("score"))


def rrf_max(lists: DataFrame, query: str, item: str, k: int = 60) -> DataFrame:
    """Fusion by the largest score + 1 / (k + rank); the score given out is the raw one of that list."""
    combined = F.col("score") + 1 / (F.lit(k) + F.col("rank"))
    return lists.groupBy(query, item).agg(F.round(F.max(combined), 6).alias("combined"), F.max_by("score", F.struct(combined, -F.col("rank"))).alias("score"))


def fuse_tracks(lists: DataFrame, query: str, item: str, track: str, k: int = 60) -> DataFrame:
    """Fusion of tracks: an item's best score plus the sum of 1 / (k + rank); a query with one track keeps its scores."""
    n = F.size(F.collect_set(track).over(Window.partitionBy(query)))
    best = F.struct(-F.col("score"), "rank", track)  # of equal tracks the first by name
    return (
        lists.withColumn("tracks", n)
        .groupBy(query, item)
        .agg(F.max("score").alias("best"), F.min_by(track, best).alias("best_track"), F.sum(1 / (F.lit(k) + F.col("rank"))).alias("bonus"), F.max("tracks").alias("tracks"))
        .select(query, item, "best_track", F.round(F.when(F.col("tracks") == 1, F.col("best")).otherwise(F.col("best") + F.col("bonus")), 6).alias("score"))
    )


def dbsf(lists: DataFrame, query: str, item: str, track: str) -> DataFrame:
    """Distribution-based fusion: the sum of the scores, each put between 0 and 1 by three deviations around the mean of its query's list.

    A list of one row, or of equal scores, gives its items one half.
    """
    shape = lists.groupBy(query, track).agg(F.avg("score").alias("_m"), F.stddev_samp("score").alias("_s"))
    placed = (F.col("score") - F.col("_m")) / (6 * F.col("_s")) + 0.5
    share = F.when(F.col("_s") > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), placed))).otherwise(0.5)
    return lists.join(shape, [query, track]).groupBy(query, item).agg(F.round(F.sum(share), 6).alias("score"))


def stitch_previous(results: DataFrame, chunks: DataFrame, query: str, item: str) -> DataFrame:
    """(query, item, place, stitched): ranked results, each behind the chunk it needs before it.

    `chunks` has `item`, prev_chunk_id and requires_previous. A previous chunk that is unknown or in the list already is not added; one that several results need
    comes before the first of them.
    """
    own = results.groupBy(query, item).agg(F.min("rank").alias("rank"))
    links = chunks.where("requires_previous and prev_chunk_id is not null").select(item, F.col("prev_chunk_id").alias("_prev")).dropDuplicates([item])
    wanted = own.join(links, item).groupBy(query, F.col("_prev").alias(item)).agg(F.min("rank").alias("rank"))
    added = wanted.join(own.select(query, item), [query, item], "left_anti").join(chunks.select(item), item, "left_semi")
    both = own.withColumn("stitched", F.lit(False)).unionByName(added.withColumn("stitched", F.lit(True)))
    return both.select(query, item, F.row_number().over(Window.partitionBy(query).orderBy("rank", F.desc("stitched"), item)).alias("place"), "stitched")


def distinct_sections(results: DataFrame, query: str, item: str, section: list[str]) -> DataFrame:
    """The best ranked result of each query and section (its document, slug and tier); nulls are equal to each other."""
    first = F.row_number().over(Window.partitionBy(query, *section).orderBy("rank", item))
    return results.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def clauses(must: list[Column] | None = None, should: list[Column] | None = None, must_not: list[Column] | None = None) -> Column:
    """One condition of three kinds of clauses: all of `must`, one of `should` if there are any, none of `must_not`. A null test counts as not met."""
    met = lambda c: F.coalesce(c, F.lit(False))
    tests = [*map(met, must or []), *(~met(c) for c in must_not or [])]
    if should:
        tests.append(reduce(lambda a, b: a | b, map(met, should)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def drop_noise(df: DataFrame, tokens: str = "token_count", least: int = 8) -> DataFrame:
    """Results without very short chunks; an unknown or zero count stays. Apply after a limit, never before it."""
    t = F.col(tokens)
    return df.where(~F.coalesce((t > 0) & (t < least), F.lit(False)))


def rerank_blend(df: DataFrame, query: str, item: str, score: Column, fresh: Column, weight: float, limit: int) -> DataFrame:
    """Scores blended with a second opinion and ranked again."""
    out = df.withColumn("score", F.round((1 - weight) * score + weight * fresh, 6))
    return ranked(out, [query], "score", item, limit)


def append_unreturned(returned: DataFrame, before: DataFrame, query: str, item: str) -> DataFrame:
    """A reranker's list with the items it left out behind it, in their former order."""
    last = returned.groupBy(query).agg(F.max("rank").alias("last"))
    rest = before.join(returned, [query, item], "left_anti").join(last, query, "left")
    shifted = rest.withColumn("rank", F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy(query).orderBy("rank", item)))
    return returned.select(query, item, "score", "rank").unionByName(shifted.select(query, item, "score", "rank"))


def feedback_boost(results: DataFrame, feedback: DataFrame, item: str, weight: float = 0.15) -> DataFrame:
    """Scores raised by `weight` times the feedback score; ranks stay as they were."""
    f = feedback.select(F.col(item).alias("_i"), F.col("feedback_score").alias("_f"))
    out = results.join(f, F.col(item) == F.col("_i"), "left")
    return out.withColumn("score", F.round(F.col("score") + weight * F.coalesce("_f", F.lit(0)), 6)).drop("_i", "_f")


def nearest_cached(queries: DataFrame, cache: DataFrame, *, query: str, item: str, vector: str, tenant: list[str], most: float = 0.15) -> DataFrame:
    """(query, item, distance): the cached entry nearest to each query within cosine distance `most`, within its tenant."""
    top = dense_topk(queries, cache, query=query, item=item, vector=vector, k=1, partition=tenant)
    q = query if query != item else f"query_{query}"
    return top.select(q, item, F.round(1 - F.col("score"), 6).alias("distance")).where(F.col("distance") <= most)


def mmr(candidates: DataFrame, query: str, item: str, vector: str, k: int, diversity: float = 0.4, pool: int = 50) -> DataFrame:
    """(query, item, pick): `k` of each query's first `pool` candidates, chosen by relevance less similarity to those chosen before."""
    few = ranked(candidates, [query], "score", item, pool).select(F.col(query).alias("q"), F.col(item).alias("item"), "score", F.col(vector).cast("array<double>").alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in few.schema}

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["score", "item"], ascending=[False, True]).reset_index(drop=True)
        x = _unit(np.stack(pdf["v"].to_numpy()).astype(float))
        sim, score = x @ x.T, pdf["score"].to_numpy()
        chosen: list[int] = []
        left = list(range(len(pdf)))
        while left and len(chosen) < k:
            gain = [(1 - diversity) * score[i] - diversity * (sim[i, chosen].max() if chosen else 0) for i in left]
            chosen.append(left.pop(int(np.argmax(np.round(gain, 9)))))
        return pd.DataFrame({"q": pdf["q"].iloc[chosen], "item": pdf["item"].iloc[chosen], "pick": range(1, len(chosen) + 1)})

    out = few.where("v is not null").groupBy("q").applyInPandas(run, f"q {kinds['q']}, item {kinds['item']}, pick int")
    return out.withColumnsRenamed({"q": query, "item": item})
