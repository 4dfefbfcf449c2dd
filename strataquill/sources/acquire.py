"""Raw documents as rows: inline, files, URLs.

All give (document_id, content BINARY, content_type, parser, uri). Rows that cannot be acquired keep their id and an `error` instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as ft

KINDS = ("inline", "upload", "local", "s3", "url")


def inline(submissions: DataFrame) -> DataFrame:
    """Content that came with the submission; base64-coded documents are decoded. Unknown kinds and missing content are errors."""
    kind = F.lower(F.trim("source_type"))
    raw = F.coalesce(ft.base64_document(F.col("content")), F.encode("content", "UTF-8"))
    error = F.when(~kind.isin(*KINDS) | kind.isNull(), "unsupported source type").when(kind.isin("inline", "upload") & F.col("content").isNull(), "no content").when(~kind.isin("inline", "upload") & F.col("content_uri").isNull(), "no uri")
    typed = ft.content_type(raw, F.element_at(F.split("content_uri", "/"), -1))
    return submissions.select("document_id", raw.alias("content"), typed.alias("content_type"), F.coalesce("parser_hint", ft.parser_for(typed), F.lit("plain_text")).alias("parser"), F.col("content_uri").alias("uri"), error.alias("error"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder of any file system Spark reads, s3a included."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    typed = ft.content_type(F.col("content"), F.element_at(F.split("path", "/"), -1))
    return f.select(F.sha2("path", 256).alias("document_id"), "content", typed.alias("content_type"), F.coalesce(ft.parser_for(typed), F.lit("plain_text")).alias("parser"), F.col("path").alias("uri"), F.lit(None).cast("string").alias("error"))


def choose_parser(df: DataFrame, *candidates: str, default: str = "plain_text") -> DataFrame:
    """`parser`, the first candidate column that holds one, and `parser_source`, its name."""
    value = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates), F.lit(default))
    source = F.coalesce(*(F.when(F.nullif(F.trim(c), F.lit("")).isNotNull(), F.lit(c)) for c in candidates), F.lit("default"))
    return df.withColumn("parser", value).withColumn("parser_source", source)


class UrlSource(DataSource):
    """`spark.read.format("urls").option("urls", "a\\nb").load()`: one row for each URL, fetched in the tasks."""

    @classmethod
    def name(cls) -> str:
        return "urls"

    def schema(self) -> str:
        return "uri string, content binary, content_type string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _UrlReader(self.options)


class _UrlReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.size = int(options.get("partition", "50"))
        self.timeout = float(options.get("timeout", "30"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)] or [InputPartition([])]

    def read(self, partition: InputPartition):
        import urllib.request

        for u in partition.value:
            try:
                with urllib.request.urlopen(u, timeout=self.timeout) as r:  # noqa: S310
                    yield (u, r.read(), r.headers.get_content_type(), None)
            except Exception as e:  # a URL that fails is a row with its error
                yield (u, None, None, f"{type(e).__name__}: {e}"[:500])
