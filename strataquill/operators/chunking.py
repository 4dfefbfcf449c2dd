"""Policy-driven chunking: rows of text to rows of chunks, by Spark expressions.

Defined results: null and blank texts give no chunks; texts of any length are chunked whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as ft

#: name, modes, window, overlap, largest chunk in tokens (fixed values).
POLICIES = [
    ("default", ["semantic", "window"], 400, 80, 500),
    ("ccbhc", ["criteria", "semantic", "window"], 350, 70, 450),
    ("dsm5", ["criteria", "semantic"], 300, 60, 400),
    ("treatment_planner", ["semantic", "window"], 450, 90, 550),
    ("clinical_note", ["semantic"], 300, 50, 400),
    ("legal_document", ["semantic", "window"], 500, 100, 600),
    ("research_paper", ["semantic", "window"], 550, 110, 650),
    ("policy_manual", ["semantic", "window"], 400, 80, 500),
    ("technical_spec", ["semantic", "window"], 350, 70, 450),
]
OVERSIZE_SECTION = 15000


def window_steps(window: int, overlap: int) -> tuple[int, int]:
    """Words in a window and words from one window to the next, for a budget in estimated tokens.

    An overlap that fifty words do not reach is dropped.
    """
    w, o = max(window, 100), max(overlap, 10)
    n = max(i for i in range(1, w + 1) if int(1.3 * i) <= w)
    lap = next((j for j in range(1, min(n, 50) + 1) if int(1.3 * j) >= o), 0)
    return n, max(1, n - lap)


def policy_table(spark: SparkSession) -> DataFrame:
    """One row for each policy, with the word counts of its windows and of the windows that cut its long paragraphs."""
    rows = [(*p, *window_steps(p[2], p[3]), *window_steps(p[4], p[4] // 5)) for p in POLICIES]
    return spark.createDataFrame(rows, "policy string, modes array<string>, window_tokens int, overlap_tokens int, max_tokens int, n int, step int, para_n int, para_step int")


def resolve_policies(df: DataFrame, name: str, fallback: str | None = None) -> DataFrame:
    """`df` with the policy columns of column `name`, or of `fallback` where that is empty; unknown names have the default policy."""
    wanted = F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), *([F.col(fallback)] if fallback else []))
    known = F.array(*(F.lit(p[0]) for p in POLICIES))
    picked = df.withColumn("policy", F.when(F.array_contains(known, wanted), wanted).otherwise("default"))
    return picked.join(F.broadcast(policy_table(df.sparkSession)), "policy")


def windows(words: Column, n: Column, step: Column) -> Column:
    """The windows of an array of words as ARRAY<STRING>: every `step` words one of `n`, the last the first that reaches the end."""
    return F.coalesce(_counted_windows(words, n, step)["t"], F.array().cast("array<string>"))


def _counted_windows(words: Column, n: Column, step: Column) -> Column:
    """The same as ARRAY<STRUCT<t, n>> with the words in each."""
    last = F.greatest(F.lit(0), F.ceil((F.size(words) - n) / step)).cast("int")
    starts = F.sequence(F.lit(0), last)
    pieces = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i * step + 1, n), " ").alias("t"), F.least(n, F.size(words) - i * step).cast("int").alias("n")))
    return F.when(F.size(words) > 0, pieces).otherwise(F.array().cast("array<struct<t:string,n:int>>"))


def _counted_paragraphs(text: Column, max_tokens: Column, n: Column, step: Column) -> Column:
    """Paragraphs as ARRAY<STRUCT<t, n>>; those beyond `max_tokens` in windows. Each paragraph is split into words once."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: ft.strip(p)), lambda p: p != "")
    split = F.transform(parts, lambda p: F.struct(p.alias("t"), ft.words(p).alias("w")))
    whole = lambda p: F.array(F.struct(p["t"].alias("t"), F.size(p["w"]).alias("n")))
    return F.flatten(F.transform(split, lambda p: F.when(F.floor(F.size(p["w"]) * F.lit(1.3)) <= max_tokens, whole(p)).otherwise(_counted_windows(p["w"], n, step))))


def criteria(text: Column) -> Column:
    """Parts as ARRAY<STRING>, cut before each numbered or lettered criterion."""
    return F.filter(F.transform(F.split(text, r"(?i)(?=criterion\s+[a-z0-9]+\.?\s)"), lambda p: ft.strip(p)), lambda p: p != "")


def highlights(text: Column, phrases: Column) -> Column:
    """Lines and sentences as ARRAY<STRING> that hold one of `phrases` or are in capitals."""
    parts = F.filter(F.transform(F.split(text, r"[\n.]+"), lambda p: ft.strip(p)), lambda p: p != "")
    return F.filter(parts, lambda p: F.exists(phrases, lambda q: F.contains(F.lower(p), F.lower(q))) | ft.is_caps(p))


def _pieces(sections: DataFrame) -> DataFrame:
    """(document_id, section_ord, section_slug, max_tokens, pieces) of non-blank sections; all pieces of a section, of every mode in order, in one array."""
    text = ft.normalize_text(F.col("text"))
    src = sections.select("document_id", "section_ord", "section_slug", text.alias("text"), "modes", "max_tokens", "n", "step", "para_n", "para_step")
    src = src.withColumn("w", ft.words(F.col("text")))
    in_windows = _counted_windows(F.col("w"), F.col("n"), F.col("step"))
    by_criteria = F.transform(criteria(F.col("text")), lambda p: F.struct(p.alias("t"), F.size(ft.words(p)).alias("n")))
    by_paragraphs = _counted_paragraphs(F.col("text"), F.col("max_tokens"), F.col("para_n"), F.col("para_step"))
    oversize = F.floor(F.size("w") * F.lit(1.3)) > OVERSIZE_SECTION
    of = lambda m: F.when(oversize | ~m.isin("semantic", "criteria"), in_windows).when(m == "criteria", by_criteria).otherwise(by_paragraphs)
    each = F.transform("modes", lambda m: F.transform(of(m), lambda p: F.struct(m.alias("tier"), p["t"].alias("t"), F.floor(p["n"] * F.lit(1.3)).cast("int").alias("tokens"))))
    # Blank pieces hold no word, as estimates of tokens show but for other blanks than words are cut at.
    full = F.filter(F.flatten(each), lambda p: ft.strip(p["t"]) != "")
    return src.select("document_id", "section_ord", "section_slug", "max_tokens", F.coalesce(full, F.array().cast("array<struct<tier:string,t:string,tokens:int>>")).alias("pieces"))


def _numbered(sections: DataFrame, whole: bool) -> DataFrame:
    """One row for each section with its numbered pieces.

    Numbers run on through the sections of a document, so the sections (each once, not its pieces) are shuffled by document, unless each document is one row.
    """
    src = sections if whole else sections.repartition("document_id")
    rows = _pieces(src)
    if whole:
        rows = rows.withColumn("first", F.lit(0).cast("bigint"))
    else:
        w = Window.partitionBy("document_id").orderBy("section_ord", "section_slug").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("first", F.coalesce(F.sum(F.size("pieces")).over(w), F.lit(0)))
    number = F.transform("pieces", lambda p, i: F.struct((F.col("first") + i + 1).cast("int").alias("no"), p["tier"].alias("tier"), p["t"].alias("t"), p["tokens"].alias("tokens")))
    return rows.withColumn("pieces", number)


def generate_chunks(sections: DataFrame, whole: bool = False) -> DataFrame:
    """Numbered chunks of `sections` (document_id, section_ord, section_slug, text and the columns of `resolve_policies`).

    Columns: document_id, section_slug, chunk_no, chunk_id, chunk_tier, text, token_count, prev_chunk_id, requires_previous.
    Blank pieces take no number; pieces beyond the policy's largest size take one but are left out here and given out by `oversized_pieces`. `whole` says that each document is one row,
    which spares the only shuffle. Rows of equal document, place and slug are sections of their own, one after the other.
    """
    kept = _numbered(sections, whole).withColumn("kept", F.filter("pieces", lambda p: p["tokens"] <= F.col("max_tokens")))
    each = ft.pieces_of(kept, ["document_id", "section_slug", F.col("kept.no").alias("_no")], F.col("kept"), "_at", "p")
    name = lambda no: F.concat_ws("|", "document_id", "section_slug", no)
    prev = F.when(F.col("_at") > 0, name(F.get("_no", F.col("_at") - 1)))
    return each.select("document_id", "section_slug", F.col("p.no").alias("chunk_no"), name(F.col("p.no")).alias("chunk_id"), F.col("p.tier").alias("chunk_tier"), F.col("p.t").alias("text"), F.col("p.tokens").alias("token_count"), prev.alias("prev_chunk_id")).withColumn("requires_previous", F.col("prev_chunk_id").isNotNull())


def oversized_pieces(sections: DataFrame, whole: bool = False) -> DataFrame:
    """(document_id, section_slug, chunk_no, chunk_tier, text, token_count): the pieces that `generate_chunks` leaves out for their size."""
    over = _numbered(sections, whole).withColumn("over", F.filter("pieces", lambda p: p["tokens"] > F.col("max_tokens")))
    return ft.pieces_of(over, ["document_id", "section_slug"], F.col("over"), "_at", "p").select("document_id", "section_slug", F.col("p.no").alias("chunk_no"), F.col("p.tier").alias("chunk_tier"), F.col("p.t").alias("text"), F.col("p.tokens").alias("token_count"))


def pack_paragraphs(df: DataFrame, key: str, text: str, target: int = 800, most: int = 1200) -> DataFrame:
    """(`key`, pack_no, text): whole paragraphs packed greedily up to `target` estimated tokens; a text within `most` stays whole.

    A paragraph over `most` is cut apart by itself, between sentences and, in a sentence over `most`, between words; a word over `most` stays whole.
    """
    src = df.select(F.col(key), ft.normalize_text(F.col(text)).alias("text"))
    return _cut_rows(src, key, "pack_no", lambda t: _packs(t, target * 4 + 3, most * 4 + 3))


def token_slices(df: DataFrame, key: str, text: str, most: int = 1200, overlap: int = 100) -> DataFrame:
    """(`key`, slice_no, text): slices of `most` words at most, each but the last trimmed to a sentence, paragraph or word break near its end.

    The next slice begins `overlap` words before the place where the last one was cut, and one word later than it at least, so no word is lost and the
    slices come to an end. Null and blank texts give none.
    """
    if most < 1 or overlap < 0:
        raise ValueError("most must be positive and overlap not negative")
    return _cut_rows(df.select(F.col(key), F.col(text).alias("text")), key, "slice_no", lambda t: _slices(t, most, overlap))


def _cut_rows(src: DataFrame, key: str, number: str, cut: Callable[[str], list[str]]) -> DataFrame:
    """(`key`, `number`, text): the pieces of each text, numbered from 0; null and empty texts have none.

    Empty texts are passed over here, for a filter on a computed text has Spark compute it twice.
    """
    kind = src.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = [cut(t) if t else [] for t in b.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
            numbers = pa.array([i for p in pieces for i in range(len(p))], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), numbers, pa.array([x for p in pieces for x in p], pa.string())], [key, number, "text"])

    return src.mapInArrow(run, f"`{key}` {kind}, {number} int, text string")


def _greedy(units: Iterable[str], most: int, glue: str = "") -> Iterator[str]:
    """Units joined in order as long as they stay within `most` characters."""
    held: list[str] = []
    size = 0
    for u in units:
        more = len(u) + (len(glue) if held else 0)
        if held and size + more > most:
            yield glue.join(held)
            held, size, more = [], 0, len(u)
        held.append(u)
        size += more
    if held:
        yield glue.join(held)


def _packs(text: str, target: int, most: int) -> list[str]:
    """The packs of a text; sizes in characters, four to a token."""
    if len(text) <= most:
        return [text]
    out: list[str] = []
    paragraphs = [p for p in (p.strip() for p in re.split(r"\n\s*\n", text)) if p]
    for large, run in groupby(paragraphs, lambda p: len(p) > most):
        if not large:
            out += _greedy(run, target, "\n\n")
            continue
        for p in run:
            sentences = re.findall(r".+?(?:[.!?]+\s+|\Z)", p, re.S)
            for long, part in groupby(sentences, lambda x: len(x) > most):
                units = (w for x in part for w in re.findall(r"\S+\s*", x)) if long else part
                out += (x.strip() for x in _greedy(units, most))
    return out


#: Breaks in the order they are tried: marks, the share of the slice they must lie behind, whether the mark stays (fixed values).
BREAKS = (((". ", "! ", "? ", ".\n"), 0.8, True), (("\n\n",), 0.7, False), ((" ",), 0.9, False))


def _trimmed(piece: str) -> str:
    """A slice up to its last good break."""
    for marks, share, stays in BREAKS:
        for m in marks:
            at = piece.rfind(m)
            if at > len(piece) * share:
                return piece[: at + len(m) * stays]
    return piece


def _slices(text: str, most: int, overlap: int) -> list[str]:
    spans = [m.span() for m in re.finditer(r"\S+\s*", text)]
    starts = [a for a, _ in spans]
    out, i = [], 0
    while i < len(spans):
        piece = text[starts[i] : spans[min(i + most, len(spans)) - 1][1]]
        if i + most >= len(spans):
            out.append(piece)
            break
        out.append(_trimmed(piece))
        i = max(i + 1, bisect_left(starts, starts[i] + len(out[-1])) - overlap)
    return out
