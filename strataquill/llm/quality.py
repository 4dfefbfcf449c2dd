"""Text quality statistics, and which documents are lists, tables or junk (problem 8).

`text_stats` computes the basic counts by Spark expressions. `document_kinds` cuts a text into segments, runs of lines of one shape,
and describes each by five distributions: its words over function-word ranks of the best language, its characters over classes,
its words inside and outside sentences, its characters over shapes of line, and over what is and is not one phrase over and over. Line marks are features only. A segment belongs to
the nearest of the structural profiles, by the weighted sum of the Jensen-Shannon divergences of its distributions: prose in each language, in another
language, in another script, and headings; lists of marked entries, of short lines, of dotted leaders; tables; encoded data, wrongly decoded text, repetitions, and words heaped without
sentences. A profile is the mean over the clear cases of all documents; prose in another language is prose without function words, heaped words are that without sentence ends.

Defined results: null, empty and blank texts have zero counts, null ratios and no kind; a document gets a kind if
more than half of its non-space characters stand in segments of lists, tables or junk, the kind with most of them (of
equal ones the first in the order junk, list, table); repeated rows each keep their row.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .words import slices

WORD = re.compile(r"[^\W_]+")
STOP = re.compile(r"[.!?…。！？]+[\"'”’»“)\]]*(?=\s|$)")
ENDS = re.compile(r"[.!?…。！？]+[\"'”’»“)\]]*$")
NOT_ALNUM = re.compile(r"[\W_]+")
HEX = re.compile(r"(?:[0-9a-fA-F]{4,16}[: ]\s*)?(?:[0-9a-fA-F]{2,8}[ :]+){5,}.*")
CODED = re.compile(r"[A-Za-z0-9+/=_%\\-]{36,}")
MARK = re.compile(r"(?:[-*•·–—▪◦‣●○■□☐☑✓➢>+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|[ivxIVX]{1,5}[.)]|\[[ xX]?\])\s+(?=\S)")
LEADER = re.compile(r"(?:\.{3,}|(?: \.){3,}|…{2,}|_{4,})\s*[\divxlc]+$")
GAP = re.compile(r"\S(?: {3,}|\t+)(?=\S)")
#: An ordinary line of text: it begins with a letter and has no sign that cells, entries or data are known by.
ORDINARY = re.compile(r"[^\W\d_](?:[\w.:!?'’()«»…–-]|,(?=\s)|,$| (?! ))*")
ROMAN_MARK = re.compile(r"[ivxIVX]{2,5}[.)]\s")
LONG = re.compile(r"\S{36}")
RANKS = (5, 15)
CLASSES = ("lower", "upper", "digit", "space", "stop", "sign", "foreign", "odd")
SHAPES = ("running", "lone", "entry", "marked", "leader", "cells", "coded")
SIZES = (4, len(CLASSES), 2, len(SHAPES), 2)
#: Weights of the distributions; sentence ends tell little beside function words, as prose may lack them.
WEIGHTS = (1.0, 1.0, 0.15, 1.5, 1.0)
#: Where each distribution begins in a description.
AT_CLASS, AT_INSIDE, AT_SHAPE, AT_REPEAT = (int(x) for x in np.cumsum(SIZES)[:-1])


def _class(c: str) -> int:
    if c.isspace():
        return 3
    if c.isdigit():
        return 2
    kind = unicodedata.category(c)
    if kind[0] == "L":
        latin = c.isascii() or unicodedata.name(c, "").startswith("LATIN")
        return 6 if not latin else 1 if kind in ("Lu", "Lt") else 0
    if c in ".,;:!?'\"-()«»“”’‘„…–—¿¡":
        return 4
    return 5 if c.isascii() else 6 if kind[0] == "M" else 7


_known = np.full(0x110000, -1, np.int8)


def char_classes(text: str) -> np.ndarray:
    """The class of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _known[points]
    if (out < 0).any():
        for p in np.unique(points[out < 0]):
            _known[p] = _class(chr(p))
        out = _known[points]
    return out


def ranked(common_words: DataFrame) -> dict[str, dict[str, int]]:
    """Rank bucket of every function word by language; the table has a fixed size."""
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, word, rank in common_words.select("lang", "word", "word_rank").where("lang is not null and word is not null").collect():
        out[lang][word.lower()] = sum((rank or 99) > r for r in RANKS)
    return dict(out)


class Describer:
    """The three distributions of many texts at once."""

    def __init__(self, common: dict[str, dict[str, int]]) -> None:
        self.langs = sorted(common) or [""]
        self.code: dict[str, int] = {}
        rows = [np.zeros((len(self.langs), 3), np.int64)]
        for k, lang in enumerate(self.langs):
            for w, r in common.get(lang, {}).items():
                if w not in self.code:
                    self.code[w] = len(rows)
                    rows.append(np.zeros((len(self.langs), 3), np.int64))
                rows[self.code[w]][k, r] = 1
        self.table = np.stack(rows)

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the language with most function words, its first three distributions one after the other, words and sentence ends."""
        k = len(texts)
        words = [WORD.findall(t.lower()) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        get = self.code.get
        codes = np.fromiter((get(x, 0) for w in words for x in w), np.int64, int(n.sum()))
        size = len(self.table)
        seen = np.bincount(np.repeat(np.arange(k), n) * size + codes, minlength=k * size).reshape(k, size)
        hits = np.tensordot(seen[:, 1:], self.table[1:], 1) if size > 1 else np.zeros((k, len(self.langs), 3), np.int64)
        best = hits.sum(2).argmax(1)
        ranks = hits[np.arange(k), best] / np.maximum(n, 1)[:, None]
        chars = np.array([len(t) for t in texts], np.int64)
        width = len(CLASSES)
        classes = np.bincount(np.repeat(np.arange(k), chars) * width + char_classes("".join(texts)), minlength=k * width).reshape(k, width) / np.maximum(chars, 1)[:, None]
        ends = np.array([len(STOP.findall(t)) for t in texts], np.int64)
        inside = np.minimum(1.0, ends * 40 / np.maximum(n, 1))
        x = np.concatenate([ranks, 1 - ranks.sum(1, keepdims=True), classes, inside[:, None], 1 - inside[:, None]], 1)
        return [self.langs[i] if h.any() else "" for i, h in zip(best, hits, strict=True)], x, n, ends


def _entropy(p: np.ndarray) -> np.ndarray:
    """Entropy in bits along the last axis."""
    return -(p * np.log2(np.maximum(p, 1e-300))).sum(-1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits along the last axis: the entropy of the mean less the mean of the entropies."""
    return _entropy((p + q) / 2) - (_entropy(p) + _entropy(q)) / 2


def distances(x: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """The weighted sum of the divergences of the distributions, of each row of `x` from each profile."""
    cuts = np.cumsum(SIZES)[:-1]
    parts = list(zip(WEIGHTS, np.split(x, cuts, 1), np.split(profiles, cuts, 1), strict=True))
    return np.stack([sum(w * divergence(a, b[k]) for w, a, b in parts) for k in range(len(profiles))], 1)


def _delimiter(line: str) -> tuple[str, int] | None:
    """The cell delimiter of a line and how often it stands there."""
    if "|" in line and not line.isalnum():
        n = line.count("|")
        if n >= 2 or " | " in line:
            return "|", n
    if '","' in line or line.startswith('"') and line.endswith('"') and "," in line:
        return '"', line.count('","')
    if "\t" in line.strip():
        return "\t", line.strip().count("\t")
    n = len(re.findall(r";(?! )", line))
    if n >= 2 or n == 1 and "; " not in line and not line.endswith(";"):
        return ";", n
    n = len(re.findall(r",(?! )", line.rstrip(",")))
    if n >= 2 and ", " not in line:
        return ",", n
    n = len(GAP.findall(line.strip()))
    if n or len(line) - len(line.lstrip()) >= 10:
        return " ", n
    return None


def _coded(line: str) -> bool:
    """Whether a line is data of a narrow alphabet or signs only."""
    s = line.strip()
    words = s.split()
    solid = "".join(words)
    if len(solid) < 12:
        return False
    letters = len(NOT_ALNUM.sub("", solid))
    if letters > 0.8 * len(solid) and max(map(len, words)) < 36 and not solid[:8].isdigit() and not HEX.fullmatch(s):
        return False
    if HEX.fullmatch(s) and sum(c in "0123456789abcdefABCDEF" for c in solid) > 0.6 * len(solid):
        return True
    runs = "".join(CODED.findall(s))
    if len(runs) > 0.6 * len(solid) and (sum(c.isdigit() for c in runs) >= 2 or sum(a.islower() and b.isupper() for a, b in zip(runs, runs[1:], strict=False)) >= 3 or len(set(runs)) <= 6):
        return True
    if LEADER.search(s):
        return False
    return letters < 0.35 * len(solid) and not re.fullmatch(r"[\s|:+=-]+", s)


def _wrapped(lines: list[str]) -> bool:
    """Whether each line is as full as the longest allows, so that the lines are one paragraph."""
    if len(lines) < 2:
        return True
    most = max(map(len, lines))
    full = [len(a) + 1 + len((b.split() or [""])[0]) > most for a, b in zip(lines, lines[1:], strict=False)]
    return sum(full) >= 0.75 * len(full)


def _solid(s: str) -> int:
    return len(s) - sum(map(s.count, " \t\n\r\f\v\xa0"))


def segments(text: str) -> list[tuple[str, str]]:
    """(shape, text) of the segments: runs of lines of one shape, short lines without sentences being `entry`."""
    lines = re.split(r"\r\n|\n|\r|\f|\u2028|\x85", text)
    shapes: list[str] = []
    ordinary = [bool(ORDINARY.fullmatch(x)) and not (len(x) >= 36 and LONG.search(x)) for x in lines]
    cells = [None if fine or not x.strip() else _delimiter(x) for fine, x in zip(ordinary, lines, strict=True)]
    for i, x in enumerate(lines):
        s = x.strip()
        if not s:
            shapes.append("")
        elif ordinary[i] and s[1:2] not in (")", ".") and ".." not in s and "…" not in s and not ROMAN_MARK.match(s):
            shapes.append("plain")
        elif _coded(s):
            shapes.append("coded")
        elif LEADER.search(s):
            shapes.append("leader")
        elif (c := cells[i]) and any(0 <= j < len(lines) and cells[j] and cells[j][0] == c[0] and (c[0] == " " or abs(cells[j][1] - c[1]) <= (c[0] in '|";,')) for j in (i - 1, i + 1)):
            shapes.append("cells")
        elif m := MARK.match(s):
            body = s[m.end() :]
            shapes.append("plain" if ENDS.search(body) and len(WORD.findall(body)) >= 6 else "marked")
        else:
            shapes.append("plain")
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(lines):
        k = shapes[i]
        j = i
        while j < len(lines) and shapes[j] == k:
            j += 1
        run = [x.strip() for x in lines[i:j]]
        if k == "plain":
            out += _plain_segments(run)
        elif k:
            out.append((k, "\n".join(run)))
        i = max(j, i + 1)
    return _lone_lines(out)


def _plain_segments(run: list[str]) -> list[tuple[str, str]]:
    """Lines without marks: one paragraph if they are wrapped, else sentences and short lines."""
    if _wrapped(run):
        return [("running", " ".join(run))]
    out: list[tuple[str, str]] = []
    held: list[str] = []
    for x in run:
        n = len(WORD.findall(x))
        if n > 14 or ENDS.search(x) and n >= 3 or STOP.search(x):
            if held:
                out.append(("entry", "\n".join(held)))
                held = []
            out.append(("running", x))
        else:
            held.append(x)
    return [*out, ("entry", "\n".join(held))] if held else out


def _lone_lines(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Short lines that stand alone are no list, unless the text has many of them and little else; nor is a running line of a few words a stretch of text."""
    lines = [s.count("\n") + 1 if k == "entry" else 0 for k, s in found]
    listed = sum(lines) >= 4 and sum(lines) > 2 * sum(k == "running" for k, _ in found)
    few = lambda s: len(s) < 60 and _solid(s) < 40 and len(WORD.findall(s)) < 6
    return [("lone" if k == "entry" and n < 3 and not listed or k == "running" and few(s) else k, s) for (k, s), n in zip(found, lines, strict=True)]


def _repeats(text: str) -> bool:
    """Whether a text is one phrase over and over."""
    w = WORD.findall(text.lower())
    if len(w) >= 24:
        if len(set(w)) >= 0.25 * len(w) + 2:
            return False
        grams = list(zip(w, w[1:], w[2:], strict=False))
        return len(set(grams)) < 0.25 * len(grams)
    raw = text.encode()
    return len(raw) >= 60 and len(zlib.compress(raw)) < 0.25 * len(raw)


#: A segment's row: its non-space characters, words, sentence ends, language number, and its description.
HEAD = 4
WIDTH = HEAD + sum(SIZES)


def features(texts: list[str], describe: Describer) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each text its non-space characters, and the rows of its segments."""
    found = [segments(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    parts = [p for f in found for p in f]
    rows = np.zeros((len(parts), WIDTH))
    if parts:
        langs, x, n, ends = describe([s for _, s in parts])
        rows[:, 0] = [_solid(s) for _, s in parts]
        rows[:, 1], rows[:, 2] = n, ends
        rows[:, 3] = [describe.langs.index(v) if v else -1 for v in langs]
        rows[:, HEAD : HEAD + AT_SHAPE] = x
        rows[np.arange(len(parts)), HEAD + AT_SHAPE + np.array([SHAPES.index(k) for k, _ in parts])] = 1
        again = np.array([_repeats(t) for t in texts], float)[owner]
        rows[:, HEAD + AT_REPEAT], rows[:, HEAD + AT_REPEAT + 1] = again, 1 - again
    return np.array([_solid(t) for t in texts], np.int64), np.split(rows, np.searchsorted(owner, np.arange(1, len(texts))))


def _read_features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of texts, the rows of all their segments, and the text each belongs to."""
    rows = b.column("rows").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(float)
    n = b.column("rows").value_lengths().to_numpy(zero_copy_only=False) // WIDTH
    return b.column("size").to_numpy(zero_copy_only=False), rows, np.repeat(np.arange(b.num_rows), n)


def clear_cases(rows: np.ndarray, langs: list[str]) -> list[tuple[str, str, np.ndarray]]:
    """(kind, profile, which rows): the segments that plainly are what a profile stands for."""
    words, ends, x = rows[:, 1], rows[:, 2], rows[:, HEAD:]
    shape = lambda name: x[:, AT_SHAPE + SHAPES.index(name)] == 1
    of = lambda name: x[:, AT_CLASS + CLASSES.index(name)]
    once, plain = x[:, AT_REPEAT] == 0, shape("running")
    strange = plain & once & (of("odd") > 0.08)
    script = plain & once & (of("foreign") > 0.6) & (of("odd") + of("sign") < 0.06)
    per = words / np.maximum(ends, 1)
    spoken = plain & once & ~strange & ~script & (ends > 0) & (words >= 12) & (per >= 4) & (per <= 40)
    return [
        *(("prose", lang, spoken & (x[:, 3] <= 0.85) & (rows[:, 3] == k)) for k, lang in enumerate(langs)),
        ("prose", "another script", script), ("prose", "heading", shape("lone") & once),
        *(("list", name, shape(name) & once) for name in ("entry", "marked", "leader")), ("table", "cells", shape("cells") & once),
        ("junk", "coded", shape("coded") & once), ("junk", "decoded", strange), ("junk", "repeated", ~once),
    ]


def _fit_part(langs: list[str]):
    """Sums of the descriptions of clear cases: (kind, name, n, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, rows, _ = _read_features(b)
            picks = [p for p in clear_cases(rows, langs) if p[2].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in picks], pa.string()), pa.array([v for _, v, _ in picks], pa.string()), pa.array([int(m.sum()) for _, _, m in picks], pa.int64()), pa.array([list(rows[m, HEAD:].sum(0)) for _, _, m in picks], pa.list_(pa.float64()))],
                ["kind", "name", "n", "total"],
            )

    return run


def _profile(ranks: list[float], classes: list[float], inside: float, shape: str, again: float = 0.0) -> np.ndarray:
    return np.array([*ranks, *classes, inside, 1 - inside, *(float(s == shape) for s in SHAPES), again, 1 - again])


#: Profiles used where a corpus has no clear case: shares of ranks, then of classes.
WITHOUT_CASES = {
    ("prose", ""): _profile([0.15, 0.12, 0.1, 0.63], [0.76, 0.03, 0.02, 0.16, 0.03, 0, 0, 0], 0.95, "running"),
    ("prose", "another script"): _profile([0, 0, 0, 1], [0.02, 0.01, 0.02, 0.1, 0.05, 0, 0.8, 0], 0.5, "running"),
    ("prose", "heading"): _profile([0.05, 0.05, 0.05, 0.85], [0.7, 0.12, 0.02, 0.13, 0.03, 0, 0, 0], 0, "lone"),
    ("list", "entry"): _profile([0.05, 0.05, 0.05, 0.85], [0.7, 0.1, 0.03, 0.14, 0.03, 0, 0, 0], 0, "entry"),
    ("list", "marked"): _profile([0.05, 0.05, 0.05, 0.85], [0.7, 0.06, 0.03, 0.16, 0.05, 0, 0, 0], 0, "marked"),
    ("list", "leader"): _profile([0.05, 0.05, 0.05, 0.85], [0.35, 0.05, 0.05, 0.1, 0.45, 0, 0, 0], 0, "leader"),
    ("table", "cells"): _profile([0.02, 0.02, 0.02, 0.94], [0.4, 0.08, 0.25, 0.12, 0.1, 0.05, 0, 0], 0, "cells"),
    ("junk", "coded"): _profile([0, 0, 0, 1], [0.2, 0.2, 0.2, 0.02, 0.05, 0.2, 0.03, 0.1], 0, "coded"),
    ("junk", "repeated"): _profile([0.05, 0.05, 0.05, 0.85], [0.76, 0.03, 0.02, 0.16, 0.03, 0, 0, 0], 0.3, "running", 1.0),
}


def fit_profiles(described: DataFrame, langs: list[str]) -> dict[tuple[str, str], np.ndarray]:
    """Mean descriptions by (kind, name) over all documents; one row for each profile comes to the driver."""
    parts = described.select("size", "rows").mapInArrow(_fit_part(langs), "kind string, name string, n bigint, total array<double>")
    sums = parts.groupBy("kind", "name").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(sum(SIZES)))).alias("total"))
    profiles = {(k, name): np.array(t) / n for k, name, n, t in sums.collect() if n}
    spoken = [v for (k, name), v in profiles.items() if k == "prose" and name in langs]
    for k, v in WITHOUT_CASES.items():
        if k[1] or not spoken:
            profiles.setdefault(k, v)
    foreign = np.mean(spoken or [WITHOUT_CASES["prose", ""]], 0)
    foreign[:4] = [0, 0, 0, 1]
    heap = foreign.copy()
    heap[AT_INSIDE : AT_INSIDE + 2] = [0, 1]
    profiles["prose", "another language"], profiles["junk", "heap"] = foreign, heap
    return profiles


def nearest_profiles(rows: np.ndarray, profiles: dict[tuple[str, str], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment: its nearest profile's place in the sorted names, the divergence from it, and that from the nearest profile of prose."""
    names = sorted(profiles)
    d = distances(rows[:, HEAD:], np.stack([profiles[k] for k in names]))
    prose = np.array([k[0] == "prose" for k in names])
    return d.argmin(1), d.min(1), d[:, prose].min(1)


def document_kinds(docs: DataFrame, key: str, text: str, common_words: DataFrame) -> DataFrame:
    """(`key`, kind, share, profile, divergence, prose_divergence): documents that are not prose.

    share is that of the characters outside prose; profile the one with most characters of the document's kind, divergence the mean of its segments from it, prose_divergence
    their mean from the nearest profile of prose. Texts are read once: their descriptions, a few numbers for each segment, are written to the shared folder, and both the fit and the decision read them.
    """
    spark: SparkSession = docs.sparkSession
    common = ranked(common_words)
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    kind = src.schema["key"].dataType.simpleString()

    def describe_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = Describer(common)
        for whole in batches:
            for b in slices(whole, 500):
                sizes, rows = features(b.column("text").to_pylist(), describe)
                at = pa.array(np.concatenate([[0], np.cumsum([r.size for r in rows])]), pa.int32())
                flat = np.concatenate([r.ravel() for r in rows]) if rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sizes), pa.ListArray.from_arrays(at, pa.array(flat.astype(np.float32)))], ["key", "size", "rows"])

    described = cut(src.mapInArrow(describe_all, f"key {kind}, size bigint, rows array<float>"))
    profiles = fit_profiles(described, Describer(common).langs)
    names = sorted(profiles)
    sent = spark.sparkContext.broadcast(profiles)
    kinds = np.array([("junk", "list", "table", "prose").index(k) for k, _ in names])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size, rows, owner = _read_features(b)
            out: list[tuple] = []
            if len(rows):
                near, d, prose = nearest_profiles(rows, sent.value)
                chars = np.zeros((b.num_rows, len(names)))
                np.add.at(chars, (owner, near), rows[:, 0])
                by_kind = np.stack([chars[:, kinds == k].sum(1) for k in range(3)], 1)
                share = by_kind.sum(1) / np.maximum(size, 1)
                for i in np.flatnonzero(share > 0.5):
                    k = int(by_kind[i].argmax())
                    best = int(np.where(kinds == k, chars[i], -1).argmax())
                    own = (owner == i) & (near == best)
                    out.append((i, ("junk", "list", "table")[k], min(float(share[i]), 1.0), names[best][1], float(np.average(d[own], weights=rows[own, 0] + 1e-9)), float(np.average(prose[own], weights=rows[own, 0] + 1e-9))))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.string()), *(pa.array(np.round(np.array(c, float), 6)) for c in cols[4:])],
                [key, "kind", "share", "profile", "divergence", "prose_divergence"],
            )

    return described.mapInArrow(decide, f"`{key}` {kind}, kind string, share double, profile string, divergence double, prose_divergence double")


def text_stats(docs: DataFrame, key: str, text: str, common_words: DataFrame) -> DataFrame:
    """Word count, mean word length, symbol ratio, share of lines that end in punctuation and share of common words of each text.

    A word is a run of letters or digits; a symbol is a character that is no letter, digit or whitespace, and its
    ratio is to the non-space characters; lines that are blank do not count; common words are those of any language of `common_words`.
    """
    common = [r[0] for r in common_words.where("word is not null").select(F.lower("word")).distinct().collect()]  # a table of fixed size
    t = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    lines = F.filter(F.transform(F.split(t, r"[\r\n\f]+"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x != "")
    solid = F.length(F.regexp_replace(t, r"(?U)\s+", ""))
    signs = F.length(F.regexp_replace(t, r"(?U)[\p{L}\p{N}\s]+", ""))
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).select("key", words.alias("words"), lines.alias("lines"), solid.alias("solid"), signs.alias("signs"))
    n, m = F.size("words"), F.size("lines")
    return src.select(
        F.col("key").alias(key), n.alias("n_words"),
        F.round(F.try_divide(F.length(F.array_join("words", "")), n), 6).alias("mean_word_length"),
        F.round(F.try_divide(F.col("signs"), F.col("solid")), 6).alias("symbol_ratio"),
        F.round(F.try_divide(F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;,…]$"))), m), 6).alias("terminal_line_share"),
        F.round(F.try_divide(F.size(F.filter("words", lambda w: w.isin(common))), n), 6).alias("common_word_share"),
    )
