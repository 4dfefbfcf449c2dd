"""The most similar vectors of every vector, within its group (problem 2).

An inverted file of coarse centroids with product-quantised residuals. Coarse centroids and code books
are fitted on a bounded sample (`sample_rows`, or 16 rows a centroid up to `most_sample_rows`) of all rows; every row is indexed. A group (knowledge base and
track) uses a level of the coarse quantiser with about one cell for `cell_rows` of its rows, so small groups are
one cell. A vector looks for its neighbours in the cells nearest to its own, where asymmetric distance tables of the query against the codes give a shortlist, which is ranked
by the exact cosine. How many cells it probes and how long the shortlist is, is measured for each level: a sample of queries (`measured` for each level) is
compared with all rows of their groups by brute force, and both are set so that `recall` of the true neighbours is found.

Cells near each other form blocks of up to `block_cells` cells, and a row is sent once to each block with a cell that probes the row's own: far fewer copies than one for
each cell. Nothing but the fitted quantiser and the sampled queries is broadcast; their sizes are set by parameters. The queries of every block are
counted, and a block with more than `part_rows` of them is split in parts: each part has some of the queries and reads
all of the rows sent to the block, in slices of `slice_rows` with a shortlist each, so a task holds one slice at a time.

Defined results: per key the row with the latest time counts (of rows with one time, the one with
the largest hash of its vector); null, empty, all-zero, non-finite vectors and vectors of another dimension are left out, as are
rows with a null key, group or track; a vector is not its own neighbour; ties go to the smaller key; a group
of n vectors gives each n - 1 neighbours at most; equal vectors are neighbours with similarity 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SUBSPACES, CODES = 16, 256
#: The most cells that a query may probe.
MOST_PROBES = 64


def usable_vectors(vectors: DataFrame, key: str, group: str, track: str, vector: str, at: str, dim: int) -> DataFrame:
    """(item, grp, track, vec): the latest row of each (key, track), kept if its vector is `dim` finite values, not all zero."""
    src = vectors.select(F.col(key).alias("item"), F.col(group).alias("grp"), F.col(track).alias("track"), F.col(vector).alias("vec"), F.col(at).alias("at"))
    w = Window.partitionBy("item", "track").orderBy(F.desc_nulls_last("at"), F.desc(F.xxhash64("vec")))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        src.where("item is not null and grp is not null and track is not null")
        .withColumn("nth", F.row_number().over(w))
        .where((F.col("nth") == 1) & (F.size("vec") == dim) & finite & F.exists("vec", lambda x: x != 0))
        .select("item", "grp", "track", "vec")
    )


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster is set on the point farthest from its centre."""
    rng = np.random.default_rng([seed, k])
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds if k > 1 else 1):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            far = np.argsort(((x - c[near]) ** 2).sum(1))[::-1]
            empty = np.flatnonzero(n == 0)[: len(far)]
            c[empty] = x[far[: len(empty)]]
    return c.astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of the centroid nearest to each row; a few rows at a time, so that many centroids take little memory."""
    half = (c * c).sum(1) / 2
    step = max(1, 4_000_000 // len(c))
    return np.concatenate([np.argmax(x[i : i + step] @ c.T - half, 1) for i in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)


def _near_cells(c: np.ndarray, most: int) -> np.ndarray:
    """For each centroid the `most` nearest, itself first."""
    square = (c * c).sum(1)
    out = np.empty((len(c), min(most, len(c))), np.int32)
    for i in range(0, len(c), 512):
        d = square[None] - 2 * c[i : i + 512] @ c.T
        d[np.arange(len(d)), i + np.arange(len(d))] = -np.inf
        some = np.argpartition(d, out.shape[1] - 1, 1)[:, : out.shape[1]] if out.shape[1] < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
        out[i : i + 512] = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), 1, kind="stable"), 1)
    return out


@dataclass
class Level:
    """Coarse centroids, the cells near each, the block of each cell, and the code books of the residuals."""

    coarse: np.ndarray
    near: np.ndarray
    block: np.ndarray
    books: np.ndarray
    probes: int = MOST_PROBES
    shortlist: int = 100

    @classmethod
    def fit(cls, sample: np.ndarray, level: int, block_cells: int) -> Level:
        """Fit on rows of unit length; the code books on the first 16,384 of them."""
        c = kmeans(sample, 2**level)
        n_blocks = -(-len(c) // block_cells)
        block = nearest(c, kmeans(c, n_blocks)) if n_blocks > 1 else np.zeros(len(c), np.int64)
        few = sample[:16384]
        residual = few - c[nearest(few, c)]
        width = sample.shape[1] // SUBSPACES
        return cls(c, _near_cells(c, MOST_PROBES), block.astype(np.int32), np.stack([kmeans(residual[:, m * width : (m + 1) * width], CODES, 8, m) for m in range(SUBSPACES)]))

    def encode(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Codes (rows x SUBSPACES) of the residuals."""
        r = x - self.coarse[cells]
        width = self.books.shape[2]
        return np.stack([nearest(r[:, m * width : (m + 1) * width], b) for m, b in enumerate(self.books)], 1).astype(np.uint8)

    def decode(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return self.coarse[cells] + np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)

    def reached(self) -> list[np.ndarray]:
        """For each cell the blocks with a cell that probes it."""
        own = self.near[:, : self.probes]
        owner = np.repeat(np.arange(len(own)), own.shape[1])
        order = np.argsort(own.ravel(), kind="stable")
        cuts = np.searchsorted(own.ravel()[order], np.arange(1, len(own)))
        return [np.unique(self.block[owner[o]]) for o in np.split(order, cuts)]


Quantiser = dict[int, Level]


def fit_quantiser(vectors: DataFrame, key: str, vector: str, dim: int, total: int, levels: list[int], block_cells: int, sample_rows: int) -> Quantiser:
    """Fit on about `sample_rows` rows, chosen by a hash of the key."""
    share = min(1.0, sample_rows / max(total, 1))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = vectors.where((F.size(vector) == dim) & (F.pmod(F.xxhash64(key), F.lit(1 << 20)) < math.ceil(share * (1 << 20))) & fine).select(F.col(vector).cast("array<float>").alias("v"))
    x = _matrix(rows.toArrow().column("v").combine_chunks(), dim)
    x = np.eye(dim, dtype=np.float32) if not len(x) else _unit(x).astype(np.float32)
    return {level: Level.fit(x, level, block_cells) for level in levels}


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _placed(b: pa.RecordBatch, q: Quantiser, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, level and cell of the rows of a batch."""
    x = _unit(_matrix(b.column("vec"), dim)).astype(np.float32)
    level = b.column("level").to_numpy()
    cell = np.zeros(len(x), np.int32)
    for v in np.unique(level):
        own = np.flatnonzero(level == v)
        cell[own] = nearest(x[own], q[v].coarse)
    return x, level, cell


def _assign(sent, dim: int):
    """Rows with their level -> one row for each block they are sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = sent.value
        reached = {v: x.reached() for v, x in q.items()}
        for b in batches:
            if not b.num_rows:
                continue
            x, level, cell = _placed(b, q, dim)
            codes, own = np.zeros((len(x), SUBSPACES), np.uint8), np.zeros(len(x), np.int32)
            for v in np.unique(level):
                at = np.flatnonzero(level == v)
                codes[at] = q[v].encode(x[at], cell[at])
                own[at] = q[v].block[cell[at]]
            to = [reached[v][c] for v, c in zip(level, cell, strict=True)]
            rows = pa.array(np.repeat(np.arange(len(x)), [len(t) for t in to]))
            packed = pa.array([bytes(c) for c in codes], pa.binary())
            sent_rows = pa.RecordBatch.from_arrays([b.column("grp"), b.column("track"), b.column("level"), pa.array(cell), b.column("item"), b.column("vec"), packed, pa.array(own)], ["grp", "track", "level", "cell", "item", "vec", "code", "own"]).take(rows)
            yield sent_rows.append_column("block", pa.array(np.concatenate(to).astype(np.int32)))

    return run


def _queries(sent, dim: int):
    """Rows with their level -> the number of queries of each block, summed over a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            _, level, cell = _placed(b, q, dim)
            block = np.zeros(len(cell), np.int32)
            for v in np.unique(level):
                block[level == v] = q[v].block[cell[level == v]]
            rows = pa.Table.from_arrays([b.column("grp"), b.column("track"), pa.array(block)], ["grp", "track", "block"])
            yield from rows.group_by(["grp", "track", "block"]).aggregate([([], "count_all")]).select(["grp", "track", "block", "count_all"]).rename_columns(["grp", "track", "block", "queries"]).to_batches()

    return run


class _Sample:
    """The sampled queries of each group, with their level and cell."""

    def __init__(self, t: pa.Table, q: Quantiser, dim: int) -> None:
        self.groups: dict[tuple, np.ndarray] = {}
        self.items = t.column("item").to_pylist()
        keys = list(zip(t.column("grp").to_pylist(), t.column("track").to_pylist(), strict=True))
        for k in dict.fromkeys(keys):
            self.groups[k] = np.array([i for i, x in enumerate(keys) if x == k])
        (b,) = t.combine_chunks().to_batches() or [None]
        self.x, self.level, self.cell = _placed(b, q, dim)

    def met(self, b: pa.RecordBatch, q: Quantiser, dim: int) -> Iterator[tuple[np.ndarray, Level, np.ndarray, np.ndarray, np.ndarray, list]]:
        """(queries, level, rows' vectors, rows' cells, place of each row's cell among those near the query's, items) for each group in a batch."""
        if not b.num_rows:
            return
        x, _, cell = _placed(b, q, dim)
        items = b.column("item").to_pylist()
        keys = list(zip(b.column("grp").to_pylist(), b.column("track").to_pylist(), strict=True))
        at: dict[tuple, list[int]] = {}
        for i, k in enumerate(keys):
            if k in self.groups:
                at.setdefault(k, []).append(i)
        for k, rows in at.items():
            own = self.groups[k]
            lv = q[int(self.level[own[0]])]
            place = np.full((len(own), len(lv.coarse)), MOST_PROBES, np.int32)
            near = lv.near[self.cell[own]]
            np.put_along_axis(place, near, np.broadcast_to(np.arange(near.shape[1], dtype=np.int32), near.shape), 1)
            yield own, lv, x[rows], cell[rows], place[:, cell[rows]], [items[i] for i in rows]


def _true_neighbours(sent, sample: pa.Table, dim: int, k: int):
    """The `k` rows of a task most similar to each sampled query: (query, similarity, place of its cell, score of its code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = sent.value
        s = _Sample(sample, q, dim)
        best = np.full((len(s.x), k, 3), -9.0)
        for b in batches:
            for own, lv, x, cell, place, items in s.met(b, q, dim):
                sim = s.x[own] @ x.T
                mine = {v: i for i, v in enumerate(items)}
                for r, i in enumerate(own):
                    if s.items[i] in mine:
                        sim[r, mine[s.items[i]]] = -9
                n = min(k, sim.shape[1])
                top = np.argpartition(sim, sim.shape[1] - n, 1)[:, sim.shape[1] - n :]
                some, back = np.unique(top, return_inverse=True)
                made = lv.decode(cell[some], lv.encode(x[some], cell[some]))[back.reshape(top.shape)]
                score = np.einsum("qd,qnd->qn", s.x[own], made)
                new = np.stack([np.take_along_axis(sim, top, 1), np.take_along_axis(place, top, 1), score], 2)
                both = np.concatenate([best[own], new], 1)
                best[own] = np.take_along_axis(both, np.argsort(-both[:, :, 0], 1)[:, :k, None], 1)
        rows = np.repeat(np.arange(len(s.x)), k)
        flat = best.reshape(-1, 3)
        keep = flat[:, 0] > -5
        yield pa.RecordBatch.from_arrays([pa.array(rows[keep], pa.int32()), *(pa.array(flat[keep, c]) for c in range(3))], ["query", "sim", "place", "score"])

    return run


def _better(sent, sample: pa.Table, wanted: np.ndarray, dim: int):
    """(query, nth, n): how many rows in the probed cells have codes with a better score than each of the query's true neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = sent.value
        s = _Sample(sample, q, dim)
        n = np.zeros(wanted.shape, np.int64)
        for b in batches:
            for own, lv, x, cell, place, _ in s.met(b, q, dim):
                score = np.where(place < lv.probes, s.x[own] @ lv.decode(cell, lv.encode(x, cell)).T, -9)
                score.sort(1)
                for r, i in enumerate(own):
                    n[i] += score.shape[1] - np.searchsorted(score[r], wanted[i] + 1e-6, "right")
        i, j = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n[i, j])], ["query", "nth", "n"])

    return run


def measure(placed: DataFrame, quantiser: Quantiser, rows_of: dict[int, int], dim: int, k: int, recall: float, sample_queries: int) -> Quantiser:
    """Sets the probed cells and the shortlist of every level with several cells so that each finds the square root of `recall` of the true neighbours of the sampled queries.

    The queries are about `sample_queries` a level, chosen by hash, against all rows of their groups. The driver receives `k` rows for each of them.
    """
    levels = [v for v in quantiser if v > 0]
    if not levels:
        return quantiser
    share = F.coalesce(*(F.when(F.col("level") == v, F.lit(math.ceil(min(1.0, sample_queries / max(rows_of[v], 1)) * (1 << 20)))) for v in levels), F.lit(0))
    deep = placed.where(F.col("level") > 0)
    sample = deep.where(F.pmod(F.xxhash64("item", "track", F.lit(11)), F.lit(1 << 20)) < share).toArrow()
    if not sample.num_rows:
        return quantiser
    sc = placed.sparkSession.sparkContext
    near = deep.mapInArrow(_true_neighbours(sc.broadcast(quantiser), sample, dim, k), "query int, sim double, place double, score double")
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "score")
    true = near.withColumn("nth", F.row_number().over(w) - 1).where(F.col("nth") < k).toPandas()
    level_of = sample.column("level").to_numpy()[true["query"].to_numpy()]
    part = recall**0.5
    for v in levels:
        places = np.sort(true["place"].to_numpy()[level_of == v])
        if len(places):
            quantiser[v].probes = min(MOST_PROBES, 1 + int(places[min(len(places) - 1, math.ceil(part * len(places)) - 1)]))
    wanted = np.full((sample.num_rows, k), 9.0)
    wanted[true["query"], true["nth"]] = true["score"]
    better = deep.mapInArrow(_better(sc.broadcast(quantiser), sample, wanted, dim), "query int, nth int, n bigint").groupBy("query", "nth").agg(F.sum("n").alias("n")).toPandas()
    ahead = true.merge(better, "left", ["query", "nth"])["n"].fillna(0).to_numpy()
    for v in levels:
        own = np.sort(ahead[(level_of == v) & (true["place"].to_numpy() < quantiser[v].probes)])
        if len(own):
            quantiser[v].shortlist = max(100, math.ceil(1.1 * (1 + own[min(len(own) - 1, math.ceil(part * len(own)) - 1)])))
    return quantiser


def by_group(batches: Iterator[pa.RecordBatch], columns: list[str], most: int) -> Iterator[tuple[bool, pa.Table]]:
    """(whether a group begins, rows) of batches sorted by `columns`: the rows of each group in slices of `most`."""
    held: list[pa.RecordBatch] = []
    size, begins, last = 0, True, None
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in columns), strict=True))
        start = 0
        for i, k in enumerate([*keys, None]):
            if k is None or k != last or size + i - start >= most:
                if i > start:
                    held.append(b.slice(start, i - start))
                    size += i - start
                if held and (k is not None and k != last or size >= most):
                    yield begins, pa.Table.from_batches(held)
                    held, size, begins = [], 0, False
                start = i
                if k is not None and k != last:
                    begins, last = True, k
    if held:
        yield begins, pa.Table.from_batches(held)


def _search(sent, dim: int, k: int, slice_rows: int):
    """Rows sorted by block, part, queries before others, and item -> the k most similar rows of each query of the part."""

    class Part:
        """The queries of one part and the best rows found for them in the slices so far."""

        def __init__(self, t: pa.Table) -> None:
            self.level = t.column("level")[0].as_py()
            self.track = t.column("track")[0]
            self.asking = True
            self.items: list = []
            self.exact = np.empty((0, dim))
            self.cell = np.empty(0, np.int32)
            self.sim = np.empty((0, k))
            self.near = np.empty((0, k), object)
            self.waiting: list[pa.Table] = []

        def read(self, q: Quantiser, t: pa.Table) -> None:
            """Take in one slice; the queries come first, and slices wait until all of them are known."""
            self.waiting.append(t)
            mine = t.column("mine").to_numpy()
            if self.asking:
                own = t.slice(0, int(mine.sum()))
                if own.num_rows:
                    self.items += own.column("item").to_pylist()
                    self.exact = np.concatenate([self.exact, _unit(_matrix(own.column("vec").combine_chunks(), dim))])
                    self.cell = np.concatenate([self.cell, own.column("cell").to_numpy()])
                self.asking = bool(mine.all())
            if not self.asking:
                self.search(q)

        def search(self, q: Quantiser) -> None:
            self.asking = False
            if not len(self.sim):
                self.sim, self.near = np.full((len(self.items), k), -2.0), np.full((len(self.items), k), None, object)
                self.at = {x: i for i, x in enumerate(self.items)}
            for t in self.waiting:
                if self.items:
                    self.slice(q, t)
            self.waiting = []

        def slice(self, q: Quantiser, t: pa.Table) -> None:
            t = t.sort_by("item")
            items = np.array([*t.column("item").to_pylist(), None], object)[:-1]
            exact = _unit(_matrix(t.column("vec").combine_chunks(), dim))
            self_at = np.full(len(self.items), -1)
            for j in np.flatnonzero(t.column("mine").to_numpy()):
                self_at[self.at[items[j]]] = j
            # Of equal vectors only the first k + 1 items can be among the nearest of any query.
            _, same = np.unique(exact.astype(np.float32).view(f"V{4 * dim}").ravel(), return_inverse=True)
            order = np.argsort(same, kind="stable")
            s = same[order]
            nth = np.empty(len(s), np.int64)
            nth[order] = np.arange(len(s)) - np.searchsorted(s, s, "left")
            base = np.flatnonzero(nth <= k)
            codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
            cell = t.column("cell").to_numpy()
            lv = q[self.level]
            for c in np.unique(self.cell):
                probed = base[np.isin(cell[base], lv.near[c, : lv.probes])]
                if len(probed):
                    self.look(lv, np.flatnonzero(self.cell == c), probed, codes[probed].astype(np.intp), cell[probed], items, exact, self_at)

        def look(self, lv: Level, mine: np.ndarray, base: np.ndarray, codes: np.ndarray, cell: np.ndarray, items: np.ndarray, exact: np.ndarray, self_at: np.ndarray) -> None:
            """The queries `mine` against the rows `base` of a slice."""
            cells, cell_of = np.unique(cell, return_inverse=True)
            centres, width = lv.coarse[cells], dim // SUBSPACES
            take = min(lv.shortlist, len(base))
            step = max(16, min(256, 8_000_000 // max(1, len(base))))
            for i in range(0, len(mine), step):
                rows = mine[i : i + step]
                asked = self.exact[rows].astype(np.float32)
                score = (centres @ asked.T)[cell_of]
                part_of = np.empty_like(score)
                for m in range(SUBSPACES):
                    table = lv.books[m] @ asked[:, m * width : (m + 1) * width].T
                    np.take(table, codes[:, m], axis=0, out=part_of, mode="clip")
                    score += part_of
                score = np.ascontiguousarray(score.T)
                near = np.argpartition(score, len(base) - take, axis=1)[:, len(base) - take :] if take < len(base) else np.tile(np.arange(len(base)), (len(rows), 1))
                near = base[np.sort(near, axis=1)]
                sim = np.stack([exact[n] @ x for n, x in zip(near, self.exact[rows], strict=True)])
                sim[near == self_at[rows][:, None]] = -2
                best = np.argsort(-np.round(sim, 12), axis=1, kind="stable")[:, :k]
                picked, found = items[np.take_along_axis(near, best, 1)], np.take_along_axis(sim, best, 1)
                for r, p, f in zip(rows, picked, found, strict=True):
                    n = int((f > -1.5).sum())
                    had = int((self.sim[r] > -1.5).sum())
                    if had:
                        if had == k and n and f[0] < self.sim[r, -1] - 1e-9:
                            continue
                        both = sorted(zip(-np.round([*self.sim[r, :had], *f[:n]], 12), [*self.near[r, :had], *p[:n]], [*self.sim[r, :had], *f[:n]], strict=True))[:k]
                        p, f, n = [x[1] for x in both], [x[2] for x in both], len(both)
                    self.near[r, :n], self.sim[r, :n] = p[:n], f[:n]

        def results(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            ok = self.sim > -1.5
            n = ok.sum(1)
            if n.sum():
                ask = [x for x, c in zip(self.items, n, strict=True) for _ in range(c)]
                rank = np.concatenate([np.arange(1, c + 1) for c in n])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ask, kind), pa.array([self.track.as_py()] * len(ask), self.track.type), pa.array(rank, pa.int32()), pa.array(self.near[ok].tolist(), kind), pa.array(np.minimum(self.sim[ok], 1.0))],
                    ["item", "track", "rank", "neighbour", "similarity"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = kind = None
        for begins, t in by_group(batches, ["grp", "track", "block", "part"], slice_rows):
            kind = t.schema.field("item").type
            if begins:
                if part:
                    part.search(sent.value)
                    yield from part.results(kind)
                part = Part(t)
            part.read(sent.value, t)
        if part:
            part.search(sent.value)
            yield from part.results(kind)

    return run


def nearest_vectors(
    vectors: DataFrame, key: str, group: str, track: str, vector: str, at: str, *,
    k: int = 10, dim: int = 64, recall: float = 0.97, cell_rows: int = 8192, block_cells: int = 16, part_rows: int = 131072, slice_rows: int = 32768,
    max_level: int = 12, sample_rows: int = 16384, most_sample_rows: int = 65536, measured: int = 200,
) -> DataFrame:
    """(`key`, `track`, rank, neighbour, similarity): the `k` most similar usable vectors of the same group and track for every usable vector.

    `dim` must be a multiple of 16. `recall` is what the probed cells and shortlists are set for; groups of one cell have recall close to 1.
    """
    usable = usable_vectors(vectors, key, group, track, vector, at, dim)
    kinds = {f.name: f.dataType.simpleString() for f in usable.schema}
    usable = usable.withColumn("vec", F.col("vec").cast("array<float>"))
    # Sizes count every row, also those that are left out in the end: they set levels only.
    sizes = vectors.groupBy(F.col(group).alias("grp"), F.col(track).alias("track")).agg(F.count("*").alias("n"))
    level = F.least(F.lit(max_level), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / cell_rows)))).cast("int")
    rows_of = {r["level"]: r["n"] for r in sizes.groupBy(level.alias("level")).agg(F.sum("n").alias("n")).collect()}
    total, top = sum(rows_of.values()), max(rows_of, default=0)
    placed = usable.join(sizes.select("grp", "track", level.alias("level")), ["grp", "track"]).select("grp", "track", "item", "vec", "level")
    if top:
        placed = cut(placed)
    quantiser = fit_quantiser(vectors, key, vector, dim, total, sorted(rows_of) or [0], block_cells, max(sample_rows, min(most_sample_rows, 16 << top)))
    quantiser = measure(placed, quantiser, rows_of, dim, k, recall, measured)
    sent = vectors.sparkSession.sparkContext.broadcast(quantiser)
    blocks = placed.mapInArrow(_assign(sent, dim), f"grp {kinds['grp']}, track {kinds['track']}, level int, cell int, item {kinds['item']}, vec array<float>, code binary, own int, block int")
    # Vectors of a group may lie close together, so what counts is the number of rows that each block has.
    queries = placed.mapInArrow(_queries(sent, dim), f"grp {kinds['grp']}, track {kinds['track']}, block int, queries bigint")
    parts = queries.groupBy("grp", "track", "block").agg(F.ceil(F.sum("queries") / part_rows).cast("int").alias("parts")).where("parts > 1")
    spread = (
        # One row for each block over `part_rows`, so fewer than a row for each `part_rows` vectors of all.
        blocks.join(F.broadcast(parts), ["grp", "track", "block"], "left")
        .na.fill(1, ["parts"])
        .withColumn("home", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("mine", (F.col("own") == F.col("block")) & (F.col("home") == F.col("part")))
    )
    by = ["grp", "track", "block", "part"]
    sorted_parts = spread.drop("parts", "home", "own").repartition(*by).sortWithinPartitions(*by, F.desc("mine"), "item")
    found = sorted_parts.mapInArrow(_search(sent, dim, k, slice_rows), f"item {kinds['item']}, track {kinds['track']}, rank int, neighbour {kinds['item']}, similarity double")
    return found.withColumnRenamed("item", key)
