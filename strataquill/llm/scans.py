"""Noise in text from scanned pages (problem 3).

Lines are classified in this order. *Running heads*: the digits and outer numbers of a line are
masked, its letters reduced to their skeleton, and masks that come again on the pages of one document
are heads. *Page numbers*: lines that hold a number of one of the chunk's pages and nothing else.
*Cut words*: a line's last word ends in a hyphen sign and the next running line goes on in it, unless
the corpus writes the two as a compound or, where it knows neither form, as their halves stand alone far more often than the two are cut.
*Misread letters*: words of one language are grouped by the
skeleton in which look-alike glyphs are one; a rare form that arises from a frequent form of its group by
listed misreadings is misread, and the language is the context that supports the frequent form.

Counts are taken over the whole corpus and only ever compared with each other, so a corpus and its repetition have the same noise. What is broadcast has a fixed size: a bit field of hashes that only
spares the join words that cannot match.

Defined results: null and blank texts have no noise; a chunk_id counts once; chunks without
pages have no page numbers; without a document_id there are no running heads; line ends may be CRLF; form
feeds belong to no line's text; a line with several misread words is one row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import bit_field

HYPHENS = "-­¬‐‑"
#: Misreadings of scanned letters, right form to wrong form (fixed values of the trade).
MISREAD = {"a": ["o"], "b": ["6", "8"], "cl": ["d"], "d": ["cl"], "e": ["c"], "g": ["q", "9"], "h": ["li"], "i": ["1", "l"], "l": ["1", "i"], "m": ["rn"], "n": ["ri"], "o": ["0"], "rn": ["m"], "s": ["5"], "t": ["f"], "u": ["ii"], "w": ["vv"], "z": ["2"]}
#: Glyph strokes: what a letter may be taken apart into, so that a word and its misreadings have one skeleton.
STROKES = str.maketrans({"m": "rri", "n": "ri", "h": "ii", "u": "ii", "d": "ci", "w": "vv", "l": "i", "1": "i", "e": "c", "o": "a", "0": "a", "f": "t", "5": "s", "q": "g", "9": "g", "6": "b", "8": "b", "2": "z"})
WORD = re.compile(r"[^\W_]+")
COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
CUT = re.compile(rf"([^\W\d_]+)[{HYPHENS}]$")
GOES_ON = re.compile(r"[^\W_]+")
CODE = re.compile(r"[a-z]{1,2}\d+")
CLOSING = "\"'”’»)]"
ROMAN = re.compile(r"(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")
NUMBER = r"[0-9lIiO]{1,4}"
#: Forms in which a page number stands alone (fixed values).
PAGE = [re.compile(p) for p in (
    rf"({NUMBER})", rf"[-–—~*·|] ?({NUMBER}) ?[-–—~*·|]", rf"[\[(<{{]({NUMBER})[\])>}}]", rf"({NUMBER}) ?/ ?{NUMBER}",
    rf"(?:[Pp][aáo][gq9][eci]?n?[ao]?|[S5][ec][i1l][tf][ec]|[Pp]|[S5]|[Bb]l[ao]tt|[Ff]ol)\.? ?({NUMBER})(?: ?(?:[o0a][ft]|von|vori|[dc][ec]|sur|5ur|siir|/) ?{NUMBER})?",
)]
#: No form of a page number is longer (22 characters at most), so longer lines need no test.
LONGEST_PAGE = 24
FIELD_BITS = 24
#: Halves that stand alone so many times as often as they are cut are words of a compound.
COMPOUND_TIMES = 5


def skeleton(word: str) -> str:
    """The strokes of a word in lower case."""
    return word.lower().translate(STROKES)


def _number(s: str) -> int:
    return int(s.translate(str.maketrans("lIiO", "1110")))


def page_of(line: str, first: int, last: int) -> int | None:
    """The page number that the stripped `line` is, if it is one of the pages first to last."""
    if len(line) > LONGEST_PAGE:
        return None
    for p in PAGE:
        if m := p.fullmatch(line):
            n = _number(m[1])
            if first <= n <= last and (line[0] not in "iI" or len(line) > 2 or first == 1):
                return n
    low = line.lower().strip("-~.[]() –")
    if low and len(low) <= 8 and (m := ROMAN.fullmatch(low)) and any(m.groups()):
        values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
        v = [values[c] for c in low]
        n = sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True))
        if first <= n <= last:
            return n
    return None


NUMBERED = re.compile(r"^(\d{1,4}) {2,}|[ ·|]{2,}(\d{1,4})$")
_OUTER = re.compile(r"^[\W_]*(?:[0-9lIO]{1,4}|[ivxlIVXL]{1,6})(?=[\W_])[\W_]+|[\W_]+(?:[0-9lIO]{1,4}|[ivxlIVXL]{1,6})[\W_]*$")


def head_mask(line: str) -> int:
    """A hash of the line's skeleton without outer numbers; 0 if too little is left of it."""
    s = "".join(WORD.findall(skeleton(_OUTER.sub("", line))))
    return 0 if len(s) < 5 else xxhash.xxh3_64_intdigest(s) >> 1


def _ends(line: str) -> bool:
    """Whether a line ends in punctuation, perhaps with closing signs behind it."""
    return line.rstrip(CLOSING)[-1:] in _STOPS


_STOPS = tuple(".!?…:;,")


def _lines(text: str) -> list[str]:
    return [x.strip("\r\f\v \t ") for x in text.split("\n")]


def head_candidates(lines: list[str], first: int | None, last: int | None) -> Iterator[tuple[int, int, bool, bool]]:
    """(line index, mask, may be a head here, has its page's number) of the lines that look like heads."""
    full = [i for i, x in enumerate(lines) if x]
    for at, i in enumerate(full):
        x = lines[i]
        if x[0].islower() or _ends(x):
            continue
        start = WORD.search(x)
        if not start or not (start[0][0].isupper() or start[0][0].isdigit()):
            continue
        if first is not None and page_of(x, first, last) is not None:
            continue
        mask = head_mask(x)
        if not mask:
            continue
        before = lines[full[at - 1]] if at else ""
        after = lines[full[at + 1]] if at + 1 < len(full) else ""
        begins = not before or _ends(before)
        numbered = False
        if first is not None and (x[0].isdigit() or x[-1].isdigit()) and (m := NUMBERED.search(x)):
            numbered = first <= int(m[1] or m[2]) <= last
        yield i, mask, not (begins and after[:1].islower() and not after.isupper()), numbered


def _pages(p: int | None, q: int | None) -> tuple[int | None, int | None]:
    return (p, q if q is not None else p) if p is not None else (q, q)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for chunk, doc, p, q, text in zip(*(b.column(c).to_pylist() for c in ("chunk_id", "doc", "p", "q", "text")), strict=True):
            first, last = _pages(p, q)
            for i, mask, may, numbered in head_candidates(_lines(text), first, last):
                rows.append((doc, mask, xxhash.xxh3_64_intdigest(f"{chunk}\n{i}") >> 1, may, numbered))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc", "mask", "place", "may", "numbered"])


class Page:
    """A chunk's lines with what each of them is, the words of its running text and its cut words."""

    def __init__(self, text: str, first: int | None, last: int | None, heads: set[int]) -> None:
        self.lines = _lines(text)
        self.kind = [""] * len(self.lines)
        for i, mask, may, numbered in head_candidates(self.lines, first, last):
            if numbered and may or mask in heads:
                self.kind[i] = "header"
        if heads:  # a head whose first letter is misread does not look like one
            for i, x in enumerate(self.lines):
                if x and not self.kind[i] and not _ends(x) and head_mask(x) in heads:
                    self.kind[i] = "header"
        if first is not None:
            full = [i for i, x in enumerate(self.lines) if x]
            lone = {i for i in full if len(self.lines[i]) <= 4 and self.lines[i].isdigit()}
            for at, i in enumerate(full):
                if len(self.lines[i]) > LONGEST_PAGE or self.kind[i] or page_of(self.lines[i], first, last) is None:
                    continue
                beside = {full[k] for k in (at - 1, at + 1) if 0 <= k < len(full)}
                if i in lone and any(j in lone and page_of(self.lines[j], first, last) is None for j in beside):
                    continue
                self.kind[i] = "page_number"
        self.running = [i for i, x in enumerate(self.lines) if x and not self.kind[i]]
        #: (line of the first half, line of the second half, first half, second half)
        self.cuts: list[tuple[int, int, str, str]] = []
        for i, j in zip(self.running, self.running[1:], strict=False):
            if self.lines[i][-1] not in HYPHENS:
                continue
            m = CUT.search(self.lines[i])
            if m and (n := GOES_ON.match(self.lines[j])) and n[0][0].isalpha():
                self.cuts.append((i, j, m[1], n[0]))

    def words(self) -> list[str]:
        """The words of the running text; cut words are left out."""
        if not self.cuts:
            return WORD.findall("\n".join([self.lines[i] for i in self.running]))
        return [w for _, own in self.by_line() for w in own]

    def by_line(self) -> Iterator[tuple[int, list[str]]]:
        """The words of each running line without the halves of cut words."""
        ends = {i for i, _, _, _ in self.cuts}
        begins = {j for _, j, _, _ in self.cuts}
        for i in self.running:
            w = WORD.findall(self.lines[i])
            yield i, w[i in begins : len(w) - (i in ends)]


def language_of(words: list[str], common: dict[str, list[str]]) -> str:
    """The language with the most different function words among `words`; empty if there are none."""
    votes: dict[str, int] = {}
    for w in common.keys() & set(words):
        for lang in common[w]:
            votes[lang] = votes.get(lang, 0) + 1
    return max(sorted(votes), key=votes.__getitem__) if votes else ""


def _read(b: pa.RecordBatch, common: dict) -> Iterator[tuple[str, Page, str, list[str]]]:
    """Each chunk with its page, its language and the words of its running text."""
    for chunk, p, q, text, heads in zip(*(b.column(c).to_pylist() for c in ("chunk_id", "p", "q", "text", "heads")), strict=True):
        first, last = _pages(p, q)
        page = Page(text, first, last, set(heads or ()))
        words = page.words()
        yield chunk, page, language_of(words, common), words


def _count(common: dict):
    """Word counts of every batch: (lang, word, whole in lines, beginning in lower case, cut over lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[str]] = {}
            whole: Counter[tuple[str, str]] = Counter()
            small: Counter[tuple[str, str]] = Counter()
            cut: Counter[tuple[str, str]] = Counter()
            for _, page, lang, words in _read(b, common):
                seen.setdefault(lang, []).extend(words)
                for _, _, x, y in page.cuts:
                    cut[lang, (x + y).lower()] += 1
                for i in page.running:
                    if "-" in page.lines[i]:
                        for x in page.lines[i].split():
                            if "-" in x:
                                for c in COMPOUND.findall(x):
                                    whole[lang, c.lower()] += 1
            for lang, words in seen.items():
                for w, n in Counter(words).items():
                    low = w.lower()
                    whole[lang, low] += n
                    if w[0] == low[0]:
                        small[lang, low] += n
            keys = list(whole.keys() | cut.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (whole, small, cut))],
                ["lang", "word", "n", "n_small", "n_cut"],
            )

    return run


def misreading(right: str, wrong: str, most: int) -> list[int] | None:
    """Places in `wrong` where it departs from `right` by at most `most` listed misreadings; None if it is not made so."""

    def go(i: int, j: int, left: int) -> list[int] | None:
        while i < len(right) and j < len(wrong) and right[i] == wrong[j]:
            found = _turn(i, j, left)
            if found is not None:
                return found
            i, j = i + 1, j + 1
        if i == len(right) and j == len(wrong):
            return []
        return _turn(i, j, left)

    def _turn(i: int, j: int, left: int) -> list[int] | None:
        if left:
            for size in (1, 2):
                for bad in MISREAD.get(right[i : i + size], ()) if i + size <= len(right) else ():
                    if wrong.startswith(bad, j):
                        rest = go(i + size, j + len(bad), left - 1)
                        if rest is not None:
                            return [*range(j, j + len(bad)), *rest]
        return None

    return go(0, 0, most)


def _likely(w: str, n: int, small: int, f: str, nf: int, small_f: int) -> list[int] | None:
    """Whether form `w`, seen `n` times, is a misreading of `f`, seen `nf` times; the places, if so."""
    if len(w) < 2 or not f.isalpha() or w.isdigit() or CODE.fullmatch(w):
        return None
    # Shares only: an absolute count would judge the same text otherwise in a larger corpus. A digit among letters hardly ever is a word of its own.
    if n > (nf / 4 if len(w) > 3 and not w.isalpha() else nf / 8):
        return None
    if len(w) == 2 and nf < 1000 * n:
        return None
    places = misreading(f, w, max(3, len(f) // 3))
    if not places:
        return None
    if not small_f and w.isalpha() and len(w) == len(f) and all((a, b) in {("o", "a")} for a, b in zip(w, f, strict=True) if a != b) and nf < 40 * n:
        return None  # invented names differ by such letters too
    return places


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, forms) rows, the forms of one skeleton -> (lang, word, right, places)."""
    for b in batches:
        rows: list[tuple] = []
        for lang, forms in zip(b.column("lang").to_pylist(), b.column("forms").to_pylist(), strict=True):
            forms = sorted(forms, key=lambda f: (-f["n"], f["word"]))
            for w in forms:
                for f in forms:
                    if f["n"] < 4 * w["n"]:
                        break
                    places = _likely(w["word"], w["n"], w["n_small"], f["word"], f["n"], f["n_small"])
                    if places:
                        rows.append((lang, w["word"], f["word"], places))
                        break
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["lang", "word", "right", "places"])


def _bit(lang: str, word: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{lang}\n{word}") & ((1 << FIELD_BITS) - 1)


def _noise(common: dict, sent):
    """(chunk_id, line, kind, lang, word, half, line2, first, second) of all noise that the line shows, and of words that may be misread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.unpackbits(sent.value).view(bool)
        known: dict[str, dict[str, bool]] = {}

        def may(lang: str, words: set[str]) -> list[str]:
            """Those of the words whose bit is set."""
            own = known.setdefault(lang, {})
            if len(own) > 300_000:
                own.clear()
            for w in words:
                if w not in own:
                    own[w] = bool(field[_bit(lang, w.lower())])
            return [w for w in words if own[w]]

        for b in batches:
            rows: list[tuple] = []
            for chunk, page, lang, words in _read(b, common):
                rows += [(chunk, i, k, lang, None, 0, i, None, None) for i, k in enumerate(page.kind) if k]
                rows += [(chunk, i, "hyphen", lang, None, 0, j, x, y) for i, j, x, y in page.cuts]
                for i, j, x, y in page.cuts:
                    if may(lang, {x + y}):
                        rows.append((chunk, i, "char", lang, (x + y).lower(), len(x), j, None, None))
                if hits := set(may(lang, set(words))):
                    for i, own in page.by_line():
                        rows += [(chunk, i, "char", lang, w.lower(), 0, i, None, None) for w in own if w in hits]
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["chunk_id", "line", "kind", "lang", "word", "half", "line2", "first", "second"])

    return run


def scan_noise(chunks: DataFrame, common_words: DataFrame) -> DataFrame:
    """(chunk_id, line_no, kind, line_to, wrong, right) of all noise; `chunks` has chunk_id, document_id, chunk_tier, start_page, end_page, text.

    wrong and right are the word as it stands and as it was for `char`, the two halves for `hyphen`.
    """
    spark: SparkSession = chunks.sparkSession
    common: dict[str, list[str]] = {}
    for lang, word in common_words.select("lang", "word").where("lang is not null and word is not null").distinct().collect():
        for form in {word.lower(), word.capitalize(), word.upper()}:
            common.setdefault(form, []).append(lang)
    src = chunks.where("chunk_id is not null and length(trim(text)) > 0").select("chunk_id", F.col("document_id").alias("doc"), F.col("start_page").cast("int").alias("p"), F.col("end_page").cast("int").alias("q"), "text", "chunk_tier")
    # Chunks of tier `window` repeat text of their document: they would make any line come twice.
    masks = src.where("doc is not null and coalesce(chunk_tier, '') <> 'window'").drop("chunk_tier").mapInArrow(_masks, "doc string, mask bigint, place bigint, may boolean, numbered boolean")
    per = masks.groupBy("doc", "mask", "place").agg(F.max("may").alias("may"), F.max("numbered").alias("numbered")).groupBy("doc", "mask").agg(F.count("*").alias("n"), F.count_if("may").alias("n_may"))
    heads = per.where("n >= 2 and n_may * 2 > n").groupBy("doc").agg(F.collect_set("mask").alias("heads"))
    heads = _kept(heads)
    # Chunks without a document have no heads; a name of their own spreads them over the tasks.
    alone = F.coalesce("doc", F.concat(F.lit("\0"), "chunk_id"))
    read = src.drop("chunk_tier").withColumn("doc", alone).join(heads.hint("shuffle_hash"), "doc", "left").select("chunk_id", "p", "q", "text", "heads")
    counts = read.mapInArrow(_count(common), "lang string, word string, n bigint, n_small bigint, n_cut bigint")
    forms = _kept(counts.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("n_small").alias("n_small"), F.sum("n_cut").alias("n_cut")))
    strokes = F.col("word")
    for a, b in (("m", "rri"), ("n", "ri"), ("h", "ii"), ("u", "ii"), ("d", "ci"), ("w", "vv")):
        strokes = F.replace(strokes, F.lit(a), F.lit(b))
    strokes = F.translate(strokes, "l1eo0f5q9682", "iicaatsggbbz")
    single = forms.where(~F.contains("word", F.lit("-"))).groupBy("lang", strokes.alias("strokes")).agg(F.collect_list(F.struct("word", (F.col("n") + F.col("n_cut")).alias("n"), "n_small")).alias("forms")).where(F.size("forms") > 1)
    wrong = single.select("lang", "forms").mapInArrow(_judge, "lang string, word string, right string, places array<int>")
    wrong = _kept(wrong)
    sent = spark.sparkContext.broadcast(bit_field(wrong.mapInArrow(_bits, "bit int"), FIELD_BITS))
    noise = read.mapInArrow(_noise(common, sent), "chunk_id string, line int, kind string, lang string, word string, half int, line2 int, first string, second string")
    noise = _kept(noise)
    out = [F.col("chunk_id"), (F.col("line") + 1).alias("line_no"), F.col("kind"), (F.col("line2") + 1).alias("line_to")]
    plain = noise.where("kind in ('header', 'page_number')").select(*out, F.lit(None).cast("string").alias("wrong"), F.lit(None).cast("string").alias("right"))
    chars = noise.where("kind = 'char'").join(wrong, ["lang", "word"])
    first = chars.where((F.col("half") == 0) | F.exists("places", lambda x: x < F.col("half")))
    second = chars.where((F.col("half") > 0) & F.exists("places", lambda x: x >= F.col("half"))).withColumn("line", F.col("line2"))
    chars = first.unionByName(second).select(*out, F.col("word").alias("wrong"), "right")
    cuts = noise.where("kind = 'hyphen'").withColumns({"joined": F.lower(F.concat("first", "second")), "compound": F.lower(F.concat_ws("-", "first", "second")), "a": F.lower("first"), "b": F.lower("second")})
    for name in ("joined", "compound", "a", "b"):
        cuts = cuts.join(forms.select("lang", F.col("word").alias(name), F.col("n").alias(f"n_{name}"), *(["n_cut"] if name == "joined" else [])), ["lang", name], "left")
    cuts = cuts.na.fill(0, ["n_joined", "n_compound", "n_a", "n_b"])
    # A compound that keeps its hyphen: the corpus writes it with one, or it is unknown both ways and its halves are words.
    kept = (F.col("n_compound") > F.col("n_joined")) | ((F.col("n_joined") + F.col("n_compound") == 0) & (F.least("n_a", "n_b") >= COMPOUND_TIMES * F.col("n_cut")) & (F.least(F.length("a"), F.length("b")) >= 3))
    hyphens = cuts.where(~kept).select(*out, F.col("first").alias("wrong"), F.col("second").alias("right"))
    return plain.unionByName(chars).unionByName(hyphens).dropDuplicates()


def repaired_text(chunks: DataFrame, noise: DataFrame) -> DataFrame:
    """(chunk_id, text): chunks with noise as continuous paragraphs, by windows over their lines.

    Heads and page numbers go, cut words are joined, misread words are set right in the case they stand in, and the lines of a paragraph become one.
    """
    own = chunks.where("chunk_id is not null and text is not null").select("chunk_id", "text").join(noise.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    lines = own.select("chunk_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("chunk_id", (F.col("at") + 1).alias("line_no"), F.regexp_replace("line", r"^[\s\f]+|[\s\f]+$", "").alias("line"))
    marks = noise.where("kind <> 'char'").groupBy("chunk_id", "line_no").agg(F.bool_or(F.col("kind") != "hyphen").alias("gone"), F.bool_or(F.col("kind") == "hyphen").alias("cut"))
    kept = lines.join(marks, ["chunk_id", "line_no"], "left").where(~F.coalesce("gone", F.lit(False)))
    w = Window.partitionBy("chunk_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = kept.withColumn("paragraph", F.sum((F.col("line") == "").cast("int")).over(w)).where("line <> ''")
    piece = F.when(F.coalesce("cut", F.lit(False)), F.regexp_replace("line", f"[{HYPHENS}]$", "")).otherwise(F.concat("line", F.lit(" ")))
    joined = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("s")))), lambda x: x["s"]), ""))
    paragraphs = placed.groupBy("chunk_id", "paragraph").agg(joined.alias("s"))
    text = paragraphs.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "s"))), lambda x: x["s"]), "\n\n").alias("text"))
    wrong = noise.where("kind = 'char'").groupBy("chunk_id").agg(F.collect_set(F.struct("wrong", "right")).alias("wrong"))

    def right(acc, c):
        for case in (F.lower, F.initcap, F.upper):
            acc = F.regexp_replace(acc, F.concat(F.lit(r"(?U)\b"), case(c["wrong"]), F.lit(r"\b")), case(c["right"]))
        return acc

    return text.join(wrong, "chunk_id", "left").select("chunk_id", F.when(F.col("wrong").isNull(), F.col("text")).otherwise(F.aggregate("wrong", F.col("text"), right)).alias("text"))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_bit(x, y) for x, y in zip(b.column("lang").to_pylist(), b.column("word").to_pylist(), strict=True)], pa.int32())], ["bit"])


def _kept(df: DataFrame) -> DataFrame:
    """A narrow result that several steps read, written once to the shared folder."""
    from ..session import cut

    return cut(df)
