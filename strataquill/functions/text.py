"""Column expressions on texts. All stay in the JVM; null in gives null out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words left out of sparse vectors (fixed values).
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "this", "but", "they", "have",
    "had", "what", "when", "where", "who", "which", "why", "how",
]
#: Modulus of token hashes and the name of the empty bucket (fixed values).
SPARSE_DIM = 131071


def normalize_text(t: Column) -> Column:
    """LF line ends, no outer whitespace, one kind of bullet, single blanks."""
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*[-*•][ \t]+", "- ")
    return F.regexp_replace(t, r"[ \t]+", " ")


def fold_case(t: Column) -> Column:
    """Lower case, with one form of the letter sigma, wherever it stands in a word."""
    return F.replace(F.lower(t), F.lit("ς"), F.lit("σ"))  # translate goes letter by letter, at several times the cost


def strip(t: Column) -> Column:
    """The text without outer whitespace of any kind."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def words(t: Column) -> Column:
    """The words between whitespace, in order; an empty array for blank text."""
    return F.array_remove(F.split(t, r"\s+"), "")


def pieces_of(df: DataFrame, keep: list[str], pieces: Column, at: str, piece: str) -> DataFrame:
    """(keep, `at`, `piece`): a row for each element of an array, numbered from 0.

    The outer form, for before a plain explode Spark works out the array a second time to leave out empty ones.
    """
    return df.select(*keep, F.posexplode_outer(pieces).alias(at, piece)).where(F.col(piece).isNotNull())


def approx_tokens(t: Column) -> Column:
    """The token estimate of policies: 1.3 tokens a word, rounded down."""
    return F.floor(F.size(words(t)) * F.lit(1.3)).cast("int")


def quarter_tokens(t: Column) -> Column:
    """The other estimate: a token for four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(t) / 4)).cast("int")


def query_tokens(t: Column) -> Column:
    """Runs of three or more ASCII letters or digits in lower case."""
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]{3,}"), F.lit(0))


def token_index(token: Column) -> Column:
    """The sparse dimension of a token: its SHA-1 prefix modulo the dimension; 0 becomes 1."""
    i = F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("bigint") % SPARSE_DIM
    return F.when(i == 0, F.lit(1).cast("bigint")).otherwise(i)


def query_key(q: Column) -> Column:
    """A query in lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(q), r"\s+", " "))


def cache_key(q: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the normalised query."""
    return F.left(F.sha2(query_key(q), 256), F.lit(16))


def slugify(t: Column, fallback: str = "section", limit: int = 64) -> Column:
    """Lower case with runs of other than letters and digits as single hyphens, cut to `limit`; `fallback` if nothing is left."""
    s = F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "-"))
    s = F.regexp_replace(F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(limit)), "-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def first_sentence(t: Column, limit: int = 200) -> Column:
    """The text up to its first sentence end, cut to `limit` characters."""
    return F.left(F.element_at(F.split(strip(t), r"(?<=[.!?])\s+"), 1), F.lit(limit))


def snippet(summary: Column, text: Column, limit: int = 200) -> Column:
    """The summary if there is one, else the start of the text."""
    return F.coalesce(F.nullif(summary, F.lit("")), F.left(text, F.lit(limit)))


def page_span(first: Column, last: Column) -> Column:
    """`first-last` as a citation writes pages."""
    return F.concat(first.cast("string"), F.lit("-"), last.cast("string"))


def is_caps(t: Column) -> Column:
    """Whether a text has letters and all of them are capitals."""
    return (t == F.upper(t)) & (t != F.lower(t))


#: Markup characters that Markdown text escapes (fixed values).
MARKUP_MINIMAL = r"([\\`*_])"
MARKUP_FULL = r"([\\`*_{}\[\]()#+\-.!|>~])"


def markdown_escape(t: Column, full: bool = False) -> Column:
    """Markup characters with a backslash before them."""
    return F.regexp_replace(t, MARKUP_FULL if full else MARKUP_MINIMAL, r"\\$1")


def markdown_heading(t: Column, level: Column) -> Column:
    """A heading line, its level between 1 and 6."""
    return F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), level))), F.lit(" "), F.trim(t))


def markdown_row(*cells: Column) -> Column:
    """A table row; bars in cells are escaped and nulls are empty."""
    safe = [F.coalesce(F.replace(F.replace(c.cast("string"), F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit(" ")), F.lit("")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |"))


def strip_markdown(t: Column) -> Column:
    """Text without emphasis, code marks, heading marks and link targets."""
    for pattern, by in ((r"(?m)^#{1,6}\s+", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(\*\*|__|`+|~~)", ""), (r"(?<![\w*])[*_](\S(?:[^*_\n]*\S)?)[*_](?![\w*])", "$1")):
        t = F.regexp_replace(t, pattern, by)
    return t


#: Content types by signature or name (fixed values).
TYPES = {
    "pdf": "application/pdf", "html": "text/html", "htm": "text/html", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "doc": "application/msword", "png": "image/png", "jpg": "image/jpeg", "zip": "application/zip",
}


def content_type(payload: Column, name: Column) -> Column:
    """The content type of a binary payload: by file name, signature, then the look of its start."""
    extension = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    by_name = reduce(lambda c, kv: c.when(extension == kv[0], F.lit(kv[1])), list(TYPES.items())[1:], F.when(extension == "pdf", F.lit(TYPES["pdf"])))
    head = F.hex(F.substring(payload, 1, 4096))
    holds = lambda s: F.contains(head, F.lit(s.encode().hex().upper()))
    start = F.lower(F.decode(F.substring(payload, 1, 256), "ISO-8859-1"))
    office = F.when(holds("word/"), TYPES["docx"]).when(holds("ppt/"), TYPES["pptx"]).when(holds("xl/"), TYPES["xlsx"]).otherwise(TYPES["zip"])
    by_bytes = F.when(head.startswith(b"%PDF-".hex().upper()), TYPES["pdf"]).when(head.startswith(b"PK\x03\x04".hex().upper()), office)
    looks = F.when(start.rlike(r"^\s*(<!doctype html|<html)") | F.contains(start, F.lit("<html")) | F.contains(start, F.lit("<body")), TYPES["html"]).when(start.rlike(r"^[\x20-\x7e\t\n\r]*$"), TYPES["txt"])
    return F.coalesce(by_name, by_bytes, looks, F.lit("application/octet-stream"))


def parser_for(kind: Column) -> Column:
    """The parser of a content type; null for types without one. The order of the tests matters."""
    k = F.lower(kind)
    has = lambda *s: reduce(lambda a, b: a | b, (F.contains(k, F.lit(x)) for x in s))
    return (
        F.when(has("pdf"), "pdf").when(has("html"), "html").when(has("word"), "docx").when(has("presentation", "powerpoint"), "pptx")
        .when(has("excel", "spreadsheet"), "xlsx").when(k.startswith("text/"), "plain_text")
    )


def base64_document(t: Column) -> Column:
    """The bytes of a text that is a base64-coded PDF, ZIP or OLE file; null for all other texts."""
    raw = F.try_to_binary(F.regexp_replace(t, r"\s+", ""), F.lit("base64"))
    magic = F.hex(F.substring(raw, 1, 4))
    plausible = (F.length(t) >= 100) & F.left(t, F.lit(1000)).rlike(r"^[A-Za-z0-9+/=\s]+$")
    return F.when(plausible & magic.isin("25504446", "504B0304", "D0CF11E0"), raw)
