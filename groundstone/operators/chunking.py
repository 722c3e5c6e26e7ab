"""Chunks with exact offsets into their page."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from groundstone.functions.identity import chunk_id
from groundstone.functions.text import numeric_density, strip, token_estimate
from groundstone.operators.ordinals import sums_before
from groundstone.options import DEFAULTS, Options

#: Separators from the strongest to the weakest.
SEPARATORS = [re.compile(p) for p in (r"\n[ \t]*\n", r"(?<=[.!?:;])[ \t]*\n|(?<=[.!?])[ \t]+", r"\n")]


def spans(text: str, most: int) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters: neighbours are packed greedily between the strongest
    separators; a span that is still too long is taken apart by the next weaker one, and cut hard
    when none is left.  Only separators are lost."""
    if len(text) <= most:
        return [(0, len(text))]

    def apart(a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        if b - a <= most:
            yield a, b
            return
        if level == len(SEPARATORS):
            for s in range(a, b, most):
                yield s, min(s + most, b)
            return
        body, held, at = text[a:b], None, 0
        cuts = [(m.start(), m.end()) for m in SEPARATORS[level].finditer(body)] + [(len(body), len(body))]
        for s, e in cuts:
            if s > at:
                lo, hi = a + at, a + s
                if held and hi - held[0] <= most:
                    held = held[0], hi
                else:
                    if held:
                        yield from apart(*held, level + 1)
                    held = lo, hi
            at = e
        if held:
            yield from apart(*held, level + 1)
        else:
            yield from apart(a, b, level + 1)

    return list(apart(0, len(text), 0))


def _finished(pages: DataFrame, role: str, options: Options) -> DataFrame:
    """Pieces of pages that have ``spans``: texts, measures, dense ordinals per document and ids.

    A piece's ordinal is its place on the page after all pieces of earlier pages; those are counted
    over rows without texts, in stretches, so neither texts nor a whole document are sorted.
    """
    piece = lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"])
    kept = F.filter("spans", lambda s: F.length(strip(piece(s))) >= options.min_chunk_chars)
    pages = pages.select("document_id", F.col("id").alias("page_id"), "pdf_page_index", "printed_page_label", "text", kept.alias("spans")).where(F.size("spans") > 0)
    counted = sums_before(pages.select("document_id", "page_id", "pdf_page_index", F.size("spans").alias("n")), "document_id", "pdf_page_index", "page_id", "n").select("page_id", "before")
    out = pages.join(counted, "page_id").select("*", F.posexplode("spans").alias("at", "span")).drop("spans")
    out = out.select("document_id", "page_id", "pdf_page_index", "printed_page_label", (F.col("before") + F.col("at")).cast("int").alias("ordinal"), F.col("span.start").alias("char_start"), F.col("span.end").alias("char_end"), piece(F.col("span")).alias("text"))
    return out.select(chunk_id(F.col("document_id"), F.lit(role), F.col("ordinal")).alias("id"), "document_id", "page_id", "pdf_page_index", "printed_page_label", F.lit(role).alias("role"), F.lit("prose").alias("kind"), "ordinal", "char_start", "char_end", "text", token_estimate(F.col("text")).alias("token_estimate"), F.round(numeric_density(F.col("text")), 4).alias("numeric_density"))


def _written(pages: DataFrame) -> DataFrame:
    return pages.where(F.length(strip(F.col("text"))) > 0)


def retrieval_windows(pages: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Overlapping windows over every page; all in Spark's own expressions.

    The last window is the first that reaches the page's end.  Windows whose stripped text is shorter
    than the least are dropped.  Null and blank pages have none.
    """
    size = options.retrieval_window
    stride = max(1, size - min(options.retrieval_overlap, max(0, size - 1)))
    length = F.length("text")
    last = F.greatest(F.ceil((length - size) / stride), F.lit(0)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * stride).cast("int").alias("start"), F.least(k * stride + size, length).cast("int").alias("end")))
    return _finished(_written(pages).withColumn("spans", spans), "retrieval", options)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _packed(most: int):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in spans(t, most)])

    return F.pandas_udf(run, SPANS)


def extraction_chunks(pages: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One chunk a page, or several where the page is too long.

    The text of pages within the limit never leaves the JVM; only longer ones are packed in Arrow
    batches, since greedy packing is sequential.
    """
    most = options.max_extraction_chars
    base = _written(pages)
    cut = base.withColumn("packed", _packed(most)(F.when(F.length("text") > most, F.col("text"))))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    return _finished(cut.withColumn("spans", F.coalesce("packed", whole)).drop("packed"), "extraction", options)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Per document: extraction, retrieval and table chunks."""
    return chunks.groupBy("document_id").agg(F.count_if(F.col("role") == "extraction").alias("extraction"), F.count_if(F.col("role") == "retrieval").alias("retrieval"), F.count_if(F.col("kind") == "table").alias("tables"))
