"""Cutting oversized items into pieces at natural boundaries (problem 4).

The separators form a hierarchy: section, paragraph, sentence, word, character. A section begins at a form feed or at a heading, a short line
without end punctuation that stands between blank lines. An item is first cut at the
coarsest; a part that is still too long is cut at the next. The parts are packed greedily into
pieces within the limit, and a piece starts with the last words of the piece before it, as many as
fit in the wanted overlap. A section begins a new piece, unless the one before is under a quarter of the limit.

Defined results: items within the limit, null texts and items without a limit give no rows; a null
or negative overlap counts as 0, one of half the limit or more as half the limit; outer whitespace belongs to no piece;
repeated rows of an item give its pieces once; a text without any whitespace is cut between characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION = re.compile(r"\f|(?:\A|(?<=\n)[^\S\n]*\n)[^\S\n]*(?=(?:#{1,6} )?\w[^\n]{0,78}[^\s.!?…:;,\-][^\S\n]*\n[^\S\n]*\n)")
PARAGRAPH = re.compile(r"\n\s*\n")
SENTENCE = re.compile(r"[.!?…][\"'”’»›“‘)\]}]*(?=\s)")
SPACE = re.compile(r"\s+")
LEVELS = ("paragraph", "sentence", "word", "none")


def _cuts(text: str, level: int) -> list[int]:
    """Positions at which `text` may be cut at `level` or a coarser one; level -1 is the section."""
    at = {m.end() for m in SECTION.finditer(text)} if level < 0 else {m.end() for m in PARAGRAPH.finditer(text)}
    if level >= 1:
        at |= {m.end() for m in SENTENCE.finditer(text)}
    if level >= 2:
        at |= {m.end() for m in SPACE.finditer(text)}
    return sorted(at | {0, len(text)})


def _span(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without outer whitespace."""
    s = text[start:end]
    return start + len(s) - len(s.lstrip()), start + len(s.rstrip())


def boundary_of(text: str, limit: int) -> str:
    """The coarsest boundary at which cutting everywhere leaves every piece within `limit`; `none` if there is none."""
    for level, name in enumerate(LEVELS[:3]):
        cuts = _cuts(text, level)
        if all(b - a <= limit or len(text[a:b].strip()) <= limit for a, b in zip(cuts, cuts[1:], strict=False)):
            return name
    return "none"


def _parts(text: str, start: int, end: int, most: int, level: int) -> Iterator[tuple[int, int]]:
    """Spans in order, each within `most`, cut no finer than needed."""
    a, b = _span(text, start, end)
    if b <= a:
        return
    if b - a <= most:
        yield a, b
    elif level > 2:
        yield from ((i, min(i + most, b)) for i in range(a, b, most))
    else:
        own = text[a:b]
        cuts = _cuts(own, level)
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield from _parts(text, a + i, a + j, most, level + 1)


def _lap_start(text: str, low: int, end: int) -> int:
    """The first word start in text[low:end]; `low` if that stretch has no whitespace, `end` if only its tail of a word."""
    for i in range(low, end):
        if not text[i].isspace() and (i == 0 or text[i - 1].isspace()):
            return i
    return low if SPACE.search(text, low, end) is None else end


def split_text(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """(start of the piece, start of what is new in it, end) of each piece, in order."""
    overlap = max(0, min(overlap, limit // 2))
    pieces: list[tuple[int, int, int]] = []
    begin = fresh = stop = -1
    sections = {_span(text, c, len(text))[0] for c in _cuts(text, -1)}
    for a, b in _parts(text, 0, len(text), limit - overlap, -1):
        closed = a in sections and 4 * (stop - begin) >= limit
        if begin >= 0 and b - begin <= limit and not closed:
            stop = b
            continue
        if begin >= 0:
            pieces.append((begin, fresh, stop))
        begin = fresh = a
        if overlap and pieces:
            begin = _lap_start(text, max(pieces[-1][0], a - overlap, b - limit), a)
        stop = b
    if begin >= 0:
        pieces.append((begin, fresh, stop))
    return pieces


def split_oversized(items: DataFrame, key: str, text: str, limit: str, overlap: str, first_page: str | None = None, last_page: str | None = None) -> DataFrame:
    """The pieces of every item whose text is longer than its limit.

    Columns: `key`, piece_no (from 1), start_char, new_char, end_char, start_page, end_page, boundary, text.
    new_char is where the text not already in the piece before begins. boundary is the coarsest level at
    which cutting everywhere would have done. Pages follow the form feeds of the text if there is one for each page turn,
    else a piece has all pages of its item.
    """
    page = lambda c: F.col(c).cast("int") if c else F.lit(None).cast("int")
    long = items.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(limit).cast("int").alias("_limit"),
        F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("_overlap"), page(first_page).alias("_first"), page(last_page).alias("_last"),
    ).where((F.col("_limit") > 0) & (F.length("_text") > F.col("_limit"))).dropDuplicates(["_key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for k, t, most, lap, p, q in df.itertuples(index=False, name=None):
                kind = boundary_of(t, most)
                feeds = [m.start() for m in re.finditer("\f", t)]
                exact = pd.notna(p) and pd.notna(q) and len(feeds) == q - p
                for n, (a, new, b) in enumerate(split_text(t, most, lap), 1):
                    first, last = (p + sum(f < a for f in feeds), p + sum(f < b for f in feeds)) if exact else (p, q)
                    rows.append((k, n, a, new, b, first, last, kind, t[a:b]))
            out = pd.DataFrame(rows, columns=[key, "piece_no", "start_char", "new_char", "end_char", "start_page", "end_page", "boundary", "text"])
            yield out.astype({"start_page": "Int32", "end_page": "Int32"})

    kind = long.schema["_key"].dataType.simpleString()
    return long.mapInPandas(run, f"`{key}` {kind}, piece_no int, start_char int, new_char int, end_char int, start_page int, end_page int, boundary string, text string")
