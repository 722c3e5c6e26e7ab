"""Files as sources: discovery, identity, and a parser that the caller plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundstone.functions.identity import document_id

PAGE = "id string, document_id string, pdf_page_index int, text string, char_count int"

#: bytes of a file to the text of its pages
Parser = Callable[[bytes], list[str]]


def plain_text(content: bytes) -> list[str]:
    """A parser for text files: pages are separated by form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def discover(spark: SparkSession, root: str, dataset: str = "all", suffix: str = ".pdf", streaming: bool = False) -> DataFrame:
    """Files under ``root`` with path, content and size; ``dataset`` is part of a folder's name, or
    ``all`` or ``*``.  Nothing is listed twice and content is read only where it is used."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary") if streaming else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(root)
    if dataset not in ("all", "*"):
        folder = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
        files = files.where(F.contains(F.lower(folder), F.lit(dataset.lower())))
    return files


def datasets(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """Folders that hold at least one file."""
    return discover(spark, root, suffix=suffix).select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("dataset")).distinct().orderBy("dataset")


def identified(files: DataFrame) -> DataFrame:
    """Hash, document id, name, title and size of every file; the title is made from the name."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    sha = F.sha2("content", 256)
    title = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[-_]", " ")
    return files.select(document_id(sha).alias("id"), sha.alias("content_sha256"), name.alias("filename"), F.col("path").alias("source_path"), title.alias("title"), F.col("length").alias("byte_size"), "content")


def parsed(files: DataFrame, parser: Parser = plain_text) -> DataFrame:
    """Pages of identified files.  The parser runs in Arrow batches, after whatever anti-join the
    caller put before it; files of one content are parsed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{i}:p{n}", i, n, t, len(t)) for i, c in zip(b.id, b.content) for n, t in enumerate(parser(bytes(c)))]
            yield pd.DataFrame(rows, columns=["id", "document_id", "pdf_page_index", "text", "char_count"])

    return files.dropDuplicates(["id"]).select("id", "content").mapInPandas(run, PAGE)
