"""Words of texts as flat numpy arrays, the form in which the text operators work on an Arrow batch.

A word is a longest run of letters or digits, in lower case.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def unaccent(text: str) -> str:
    """`text` without combining marks; letters that carry one are reduced to their base letter."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def coded(words: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Each word's number in the list of distinct words, and that list."""
    d = pa.array(words, pa.large_string()).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word; a distinct word is hashed once."""
    if not words:
        return np.empty(0, _U)
    codes, distinct = coded(words)
    return np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], _U)[codes]


def slices(batch: pa.RecordBatch, rows: int):
    """`batch` in pieces of at most `rows` rows, so that work arrays stay small for long texts."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def bit_field(hashes: DataFrame, bits: int) -> np.ndarray:
    """A field of 2**`bits` bits, as packed bytes, of which those are set whose numbers are in the only column of `hashes`.

    Every task sets its own bits and gives out the stretches that have any; equal stretches are joined before they come to the driver, which so receives
    the field once, however many rows there are.
    """
    (column,) = hashes.columns
    size = 1 << min(15, bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(1 << bits, bool)
        for b in batches:
            field[b.column(column).to_numpy(zero_copy_only=False)] = True
        parts = field.reshape(-1, size)
        at = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([np.packbits(parts[i]).tobytes() for i in at], pa.binary())], ["at", "part"])

    def join(t: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in t.column("part").to_pylist()]))
        return pa.table({"at": t.column("at").slice(0, 1), "part": pa.array([both.tobytes()], pa.binary())})

    found = hashes.mapInArrow(mark, "at bigint, part binary").groupBy("at").applyInArrow(join, "at bigint, part binary").toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for at, part in zip(found.column("at").to_pylist(), found.column("part").to_pylist(), strict=True):
        out[at * size // 8 : (at + 1) * size // 8] = np.frombuffer(part, np.uint8)
    return out
