"""Evaluation texts inside training texts (problem 7).

Every window of `window` words, of the items and of the corpus, is embedded by the CGK random walk:
at each step the walk copies the word under its pointer to the output and moves on or stays, as a
random bit of (step, word) says. Windows at a small edit distance so get outputs at a small Hamming
distance. Bit sampling keeps some positions of the output as one key; it is repeated until the
target recall is reached. Windows with a common key are verified by their exact edit distance.

With no edits allowed equal windows have equal walks, so one repetition already has recall 1.

Walks run for all windows of an Arrow batch at once in numpy. The item windows are a query set: up to `block_windows` of them are sent to the tasks, more are
joined with the corpus by their keys, so what is broadcast is bounded whatever the number of items, and the corpus is read once.

Defined results: null and empty texts, and texts with fewer words than a window, leak nothing; accents, case
and everything between words are ignored; an item leaks into a document once, however often it
stands there; items with the same text leak together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut
from .words import WORD, bit_field, mix, slices, unaccent, word_hashes

_U = np.uint64
_PAD = _U(0x9E3779B97F4A7C15)


def walk_keys(hashes: np.ndarray, starts: np.ndarray, window: int, sampled: int, seed: int) -> np.ndarray:
    """The sampled CGK key of the window of words that begins at each of `starts`.

    `hashes` must have a padding of `window` values behind the last start.
    """
    rng = np.random.default_rng([seed, window, sampled])
    steps = np.sort(rng.choice(3 * window, sampled, replace=False))
    bits = mix(hashes ^ mix(np.array([seed + 1], _U)))
    pointer = np.zeros(len(starts), np.int64)
    key = np.full(len(starts), _U(seed), _U)
    for step in range(int(steps[-1]) + 1):
        at = starts + pointer
        if step in steps:
            symbol = np.where(pointer < window, hashes[at], _PAD)
            key = (key ^ symbol) * _U(0xD6E8FEB86659FD93)
            key ^= key >> _U(32)
        if step < steps[-1]:
            move = (bits[at] >> _U(step)) & _U(1) if step < 64 else mix(bits[at] + _U(step)) & _U(1)
            pointer = np.minimum(pointer + move.astype(np.int64), window)
    return key


def repetitions(window: int, max_edits: int, sampled: int, recall: float, most: int = 200, pairs: int = 4000) -> int:
    """Repetitions of bit sampling for `recall` of the windows within `max_edits` edits, measured on random pairs of such windows.

    The share found must be above `recall` by two standard errors, so that fresh pairs meet it too. Walks that an edit parts come together again after a number of steps without a mean, so no closed form is used.
    """
    if max_edits == 0:
        return 1
    rng = np.random.default_rng([window, max_edits, sampled])
    rows = []
    for _ in range(pairs):
        a = list(rng.integers(1, 2**63, window, dtype=_U))
        b = list(a)
        for _ in range(max_edits):
            at, kind = int(rng.integers(len(b))), rng.integers(3)
            if kind == 0:
                b[at] = rng.integers(1, 2**63, dtype=_U)
            elif kind == 1:
                b.insert(at, rng.integers(1, 2**63, dtype=_U))
            else:
                del b[at]
        rows += [a, (b + list(rng.integers(1, 2**63, window, dtype=_U)))[:window]]
    hashes = np.concatenate([np.array(rows, _U).ravel(), np.zeros(window + 1, _U)])
    starts = np.arange(len(rows)) * window
    hit = np.zeros(pairs, bool)
    for seed in range(most):
        keys = walk_keys(hashes, starts, window, sampled, seed)
        hit |= keys[::2] == keys[1::2]
        if hit.mean() >= recall + 2 * (recall * (1 - recall) / pairs) ** 0.5:
            return seed + 1
    raise ValueError(f"{most} repetitions do not reach the recall; sample fewer positions")


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Word edit distance, or `most` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The edit distance of each row of `a` from that of `b`, rows of as many word hashes; anything over `most` is `most` + 1. Only the band that can stay within it is worked out."""
    n, w = a.shape
    far = np.full(n, most + 1, np.int16)
    row = [np.full(n, min(j, most + 1), np.int16) for j in range(w + 1)]
    for i in range(w):
        new = [far] * (w + 1)
        new[0] = np.full(n, min(i + 1, most + 1), np.int16)
        for j in range(max(0, i - most), min(w, i + most + 1)):
            best = row[j] + (a[:, i] != b[:, j])
            np.minimum(best, row[j + 1] + 1, out=best)
            np.minimum(best, new[j] + 1, out=best)
            new[j + 1] = np.minimum(best, most + 1)
        row = new
    return row[w]


def _words(text: str | None) -> list[str]:
    return WORD.findall(unaccent(text).lower()) if text else []


def _windows(texts: list[str | None], window: int) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, hashes of all words with a padding, window starts, and each window's text and place in it."""
    words = [_words(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    hashes = np.concatenate([word_hashes([x for w in words for x in w]), np.zeros(window + 1, _U)])
    first = np.cumsum(n) - n
    many = np.maximum(n - window + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return words, hashes, first[text] + place, text, place


class _Queries:
    """The item windows of one block, ready for search by key."""

    def __init__(self, items: list[tuple], window: int, sampled: int, seeds: list[int]) -> None:
        self.items = items
        parts = [(i, t) for i, item in enumerate(items) for t in item[1:]]
        words, hashes, starts, text, place = _windows([t for _, t in parts], window)
        self.owner = np.array([i for i, _ in parts], np.int64)[text] if len(text) else np.empty(0, np.int64)
        self.windows = [words[t][p : p + window] for t, p in zip(text, place, strict=True)]
        self.hashes = hashes[starts[:, None] + np.arange(window)]
        self.sorted: list[tuple[np.ndarray, np.ndarray]] = []
        self.maybe: list[np.ndarray] = []
        for seed in seeds:
            keys = walk_keys(hashes, starts, window, sampled, seed)
            order = np.argsort(keys, kind="stable")
            self.sorted.append((keys[order], order))
            bits = np.zeros(1 << 22, bool)
            bits[(keys >> _U(42)).astype(np.int64)] = True
            self.maybe.append(bits)


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_key: str, text: str, item_key: str, parts: list[str], *,
    window: int = 12, max_edits: int = 0, sampled: int = 6, recall: float = 0.99, block_windows: int = 2_000_000,
) -> DataFrame:
    """Distinct (`doc_key`, `item_key`): the document's text has a window within `max_edits` word edits of one of the item's parts.

    Items of `block_windows` windows at most are sent to the tasks. More are never collected: their keys meet those of the corpus in a shuffle, for which only
    corpus windows come up that a bit field of all item keys, of a fixed size, lets through.
    """
    seeds = list(range(repetitions(window, max_edits, sampled, recall)))
    asked = items.select(F.col(item_key).alias("_item"), *(F.col(p).cast("string").alias(f"_part{i}") for i, p in enumerate(parts))).where("_item is not null").dropDuplicates()
    # A bound of the windows: one for every two characters.
    size = sum((F.coalesce(F.length(f"_part{i}"), F.lit(0)) for i in range(len(parts))), F.lit(0))
    total = asked.agg(F.sum(size)).first()[0] or 0
    src = docs.select(F.col(doc_key).alias("_doc"), F.col(text).alias("_text")).where(F.length("_text") >= 2 * window - 1)
    d, i = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    if total / 2 <= block_windows:
        sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in asked.collect()])
        found = src.mapInArrow(_searcher(sent, window, max_edits, sampled, seeds, doc_key, item_key, to_arrow_type(items.schema[item_key].dataType)), f"`{doc_key}` {d}, `{item_key}` {i}")
        return found.dropDuplicates()
    each = asked.select(F.col("_item").alias("_doc"), F.explode(F.array(*(f"_part{k}" for k in range(len(parts))))).alias("_text")).where("_text is not null")
    keys = lambda df, kind, sent: df.mapInArrow(_keys(window, sampled, seeds, sent), f"id {kind}, key bigint, words array<string>")
    wanted = cut(keys(each, i, None).dropDuplicates(["id", "key", "words"]))
    field = bit_field(wanted.select(F.shiftrightunsigned("key", 64 - FIELD_BITS).cast("int").alias("bit")), FIELD_BITS)
    met = keys(src, d, docs.sparkSession.sparkContext.broadcast(field)).dropDuplicates(["id", "key", "words"])
    pairs = met.withColumnsRenamed({"id": "_doc", "words": "a"}).join(wanted.withColumnsRenamed({"id": "_item", "words": "b"}), "key").select("_doc", "_item", "a", "b")
    near = pairs.mapInArrow(_near(max_edits, doc_key, item_key), f"`{doc_key}` {d}, `{item_key}` {i}")
    return near.dropDuplicates()


FIELD_BITS = 26


def _keys(window: int, sampled: int, seeds: list[int], sent):
    """(_doc, _text) rows -> a row for each window and repetition whose key the field has; all of them without a field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.unpackbits(sent.value).view(bool) if sent else None
        for whole in batches:
            for b in slices(whole, 1000):
                words, hashes, starts, text, place = _windows(b.column("_text").to_pylist(), window)
                for seed in seeds:
                    own = mix(walk_keys(hashes, starts, window, sampled, seed))
                    at = np.flatnonzero(field[(own >> _U(64 - FIELD_BITS)).astype(np.int64)]) if field is not None else np.arange(len(own))
                    lists = pa.array([words[t][p : p + window] for t, p in zip(text[at], place[at], strict=True)], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([b.column("_doc").take(pa.array(text[at])), pa.array(own[at].view(np.int64)), lists], ["id", "key", "words"])

    return run


def _near(max_edits: int, doc_key: str, item_key: str):
    """The pairs of windows within the edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [i for i, (x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)) if edit_distance(x, y, max_edits) <= max_edits]
            rows = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_doc").take(rows), b.column("_item").take(rows)], [doc_key, item_key])

    return run


def _stretches(n: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Numbers of consecutive entries of `n` that add up to about `most`, without those that are 0."""
    at = np.flatnonzero(n)
    if len(at):
        yield from np.split(at, np.flatnonzero(np.diff(np.cumsum(n[at]) // most)) + 1)


def _searcher(sent, window: int, max_edits: int, sampled: int, seeds: list[int], doc_key: str, item_key: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = _Queries(sent.value, window, sampled, seeds)
        for whole in batches:
            for b in slices(whole, 1000):
                words, hashes, starts, text, place = _windows(b.column("_text").to_pylist(), window)
                hits: set[tuple[int, int]] = set()
                for seed, (keys, order), maybe in zip(seeds, q.sorted, q.maybe, strict=True):
                    own = walk_keys(hashes, starts, window, sampled, seed)
                    near = np.flatnonzero(maybe[(own >> _U(42)).astype(np.int64)])
                    lo, hi = np.searchsorted(keys, own[near], "left"), np.searchsorted(keys, own[near], "right")
                    for k in _stretches(hi - lo, 1_000_000):
                        mine = np.repeat(near[k], (hi - lo)[k])
                        theirs = order[np.repeat(lo[k] - np.cumsum((hi - lo)[k]) + (hi - lo)[k], (hi - lo)[k]) + np.arange(len(mine))]
                        ok = edit_distances(hashes[starts[mine][:, None] + np.arange(window)], q.hashes[theirs], max_edits) <= max_edits
                        # What the hashes say is confirmed on the words, once for a text and an item.
                        for w, c in zip(mine[ok].tolist(), theirs[ok].tolist(), strict=True):
                            pair = (int(text[w]), int(q.owner[c]))
                            if pair not in hits and edit_distance(words[text[w]][place[w] : place[w] + window], q.windows[c], max_edits) <= max_edits:
                                hits.add(pair)
                pairs = sorted(hits)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_doc").take(pa.array([t for t, _ in pairs], pa.int64())), pa.array([q.items[i][0] for _, i in pairs], kind)],
                    [doc_key, item_key],
                )

    return run
