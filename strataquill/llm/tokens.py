"""Token ids and token counts under a public tokenizer (problems 1 and 6).

Byte-level BPE merges inside the pieces that its pre-splitting pattern cuts, never across them.
So a batch is cut into pieces, the `tokenizers` library encodes each distinct piece once, and the
ids of a text are gathered from the pieces by numpy. The tokenizer file is loaded once per worker.

Defined results: a null text and an empty text both have the empty list of ids and 0 tokens; text
that looks like a special token is plain text; texts of any length are encoded whole; repeated
rows each keep their row.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import slices

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
PATH_CONF = "spark.strataquill.tokenizer.path"

#: The pre-splitting pattern of the vocabulary (fixed value, given with the tokenizer files).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside these long-settled blocks the Unicode tables of two libraries may differ; such texts go to the library whole.
UNSETTLED = r"[^\u0000-ԯḀ-῿ -⁯₠-₿℀-⯿　-ヿ一-龥가-힣！-～�]"
#: Pieces of more characters than this, and texts that go whole, are encoded each time they come.
LONGEST_CACHED = 40
#: Bytes of pieces and ids that a worker remembers, as an estimate of what Python takes for them.
CACHE_BYTES = 64 << 20


def tokenizer_path(spark: SparkSession) -> str:
    """The tokenizer file that the session names, else the installed one."""
    return spark.conf.get(PATH_CONF, None) or DEFAULT_PATH


class PieceEncoder:
    """Encodes lists of texts; remembers the ids of short pieces seen before, up to a number of bytes."""

    _of: dict[str, PieceEncoder] = {}

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        """The worker's encoder for `path`."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.find = regex.compile(PIECES).findall
        self.unsettled = regex.compile(UNSETTLED).search
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.size = np.empty(0, np.int64)
        self.start = np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        """The ids of new pieces behind those known."""
        ids = [e.ids for e in self.tok.encode_batch(new, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, flat])

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces in order, and how many each text has. Pieces that are not remembered have numbers until `_forget`."""
        if self.held > CACHE_BYTES:
            self._clear()
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                found = [t] if self.unsettled(t) else self.find(t)
                counts[i] = len(found)
                pieces += found
        new = {p: None for p in pieces if p not in self.number}
        kept = [p for p in new if len(p) <= LONGEST_CACHED]
        once = [p for p in new if len(p) > LONGEST_CACHED]
        if kept:
            self._learn(kept)
            self.number.update(zip(kept, range(len(self.number), len(self.number) + len(kept)), strict=True))
            self.held += 150 * len(kept) + sum(map(len, kept))
        numbers = self.number
        self.last = len(self.size), len(self.pool)
        if once:
            self._learn(once)
            numbers = dict(zip(once, range(len(numbers), len(numbers) + len(once)), strict=True))
            known = self.number
            return np.fromiter((known[p] if p in known else numbers[p] for p in pieces), np.int64, len(pieces)), counts
        return np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces)), counts

    def _forget(self) -> None:
        """Drops what the last batch had of pieces that are not remembered."""
        n, m = self.last
        if len(self.size) > n:
            self.size, self.start, self.pool = self.size[:n].copy(), self.start[:n].copy(), self.pool[:m].copy()

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens in each text."""
        numbers, counts = self._numbers(texts)
        total = np.concatenate([[0], np.cumsum(self.size[numbers])])
        ends = np.cumsum(counts)
        self._forget()
        return total[ends] - total[ends - counts]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts, one after the other."""
        numbers, counts = self._numbers(texts)
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[numbers] - (ends - sizes), sizes) + np.arange(total)
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        ids = self.pool[at]
        self._forget()
        return offsets, ids


def byte_table() -> dict[str, int]:
    """The byte that each printable stand-in character of a byte-level vocabulary means.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceDecoder:
    """Bytes of ids; characters that tokens share come out whole, as bytes are joined before decoding."""

    _of: dict[str, PieceDecoder] = {}

    @classmethod
    def of(cls, path: str) -> PieceDecoder:
        """The worker's decoder for `path`."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str) -> None:
        tok = PieceEncoder.of(path).tok
        table = byte_table()
        self.bytes = [bytes(table[c] for c in (tok.id_to_token(i) or "")) for i in range(tok.get_vocab_size())]
        self.size = np.array([len(b) for b in self.bytes], np.int64)

    def text(self, ids: np.ndarray) -> str:
        """The text of `ids`; a character cut at either end becomes U+FFFD."""
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one character positions in `text` of each token; tokens that share a character both cover it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.size[ids])
        first = char[end - self.size[ids]] if len(ids) else np.empty(0, np.int64)
        return first, (char[end - 1] + 1 if len(ids) else first)


def _plain(df: DataFrame, key: str | list[str], text: str) -> tuple[DataFrame, list[str]]:
    """The key columns and the text under the name `_text`; other columns, whatever their names, stay out."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, F.col(text).alias("_text")), keys


def token_counts(df: DataFrame, key: str | list[str], text: str, path: str = DEFAULT_PATH, out: str = "n_tokens") -> DataFrame:
    """`key` columns and the exact token count of `text` for every row."""
    src, keys = _plain(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder.of(path)
        for whole in batches:
            for b in slices(whole, 2000):
                n = enc.counts(b.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(n, pa.int64())], [*keys, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keys]
    return src.mapInArrow(run, f"{', '.join(fields)}, `{out}` bigint")


def token_ids(df: DataFrame, key: str, text: str, path: str = DEFAULT_PATH, spans: bool = False) -> DataFrame:
    """`key` and `ids` ARRAY<INT> of `text` for every row, without special tokens.

    With `spans`, also `starts` and `ends` ARRAY<INT>: the characters of the text that each token covers.
    """
    src, keys = _plain(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder.of(path)
        for whole in batches:
            for b in slices(whole, 2000):
                texts = b.column("_text").to_pylist()
                offsets, ids = enc.ids(texts)
                lists = [ids]
                if spans:
                    dec = PieceDecoder.of(path)
                    found = [dec.spans(t or "", ids[i:j]) for t, i, j in zip(texts, offsets, offsets[1:], strict=False)]
                    lists += [np.concatenate([x[k] for x in found]) for k in (0, 1)]
                at = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in lists)], [*keys, *["ids", "starts", "ends"][: len(lists)]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keys)
    return src.mapInArrow(run, f"{fields}, ids array<int>" + ", starts array<int>, ends array<int>" * spans)


def decoded(df: DataFrame, key: str, ids: str, path: str = DEFAULT_PATH) -> DataFrame:
    """`key` and the `text` that the ids in column `ids` spell; null ids give the empty text."""
    src = df.select(key, F.col(ids).alias("_ids"))
    kind = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = PieceDecoder.of(path)
        for whole in batches:
            for b in slices(whole, 2000):
                texts = [dec.text(x or ()) for x in b.column("_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string())], [key, "text"])

    return src.mapInArrow(run, f"`{key}` {kind}, text string")


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, words joined by an underscore; `unknown` for null and blank."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_"), F.lit("")), F.lit("unknown"))


#: Three-letter codes of the corpus languages (fixed values).
LANG3 = {"eng": "en", "fra": "fr", "deu": "de", "spa": "es"}


def lang_code(c: Column) -> Column:
    """The two-letter code of a language in any of its spellings (`EN`, `eng`, `en-EN`); `unknown` for null and blank."""
    base = F.element_at(F.split(F.lower(F.trim(c)), r"[-_]"), 1)
    long = F.coalesce(*(F.when(base == k, F.lit(v)) for k, v in LANG3.items()))
    return F.coalesce(long, F.nullif(base, F.lit("")), F.lit("unknown"))


def token_budget(counts: DataFrame) -> DataFrame:
    """Cube of (corpus, source, lang, domain, n_tokens) rows: texts and tokens of every combination; `ALL` is a total.

    The rows are summed by full combination first, on the map side, so the cube expands a few rows only
    and a slice that holds most of the corpus costs no more than any other.
    """
    fine = counts.groupBy("corpus", "source", "lang", "domain").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))
    cube = fine.groupingSets(
        [["corpus", *(d for k, d in enumerate(("source", "lang", "domain")) if m >> k & 1)] for m in range(8)],
        "corpus", "source", "lang", "domain",
    ).agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))
    return cube.na.fill("ALL", ["source", "lang", "domain"])
