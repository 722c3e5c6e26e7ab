"""The engine's functions under names that SQL can call."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T

from groundstone.operators import chunking, factcells, grounding
from groundstone.options import DEFAULTS

#: Names and what they give: ``select gs_period('FY 2024-25')``, ``select * from gs_spans(text, 3600)``.
SCALARS = ("gs_slug", "gs_period", "gs_number", "gs_date", "gs_yes_no", "gs_ground")
TABLES = ("gs_spans",)


def _each(f, kind: T.DataType):
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None or x != x else f(x)).astype(object)

    return F.pandas_udf(run, kind)


def _number(text: str) -> float | None:
    found = factcells.quantity(text)
    return found[0] if found else None


def _ground(source: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """start, end and mode of a quote in its source by the tiers that fold and rebuild."""
    rows = []
    for s, q in zip(source, quote):
        hit, mode = None, None
        if s and q:
            hit, mode = grounding.loose(s, q, DEFAULTS.min_quote_chars), "normalised_chars"
            if hit is None:
                hit, mode = grounding.rebuilt(s, q, DEFAULTS.max_span_chars), "reconstructed_span"
        rows.append((*hit, mode) if hit else (None, None, None))
    return pd.DataFrame(rows, columns=["start", "end", "mode"]).astype({"start": "Int32", "end": "Int32"})


class Spans:
    """Spans of at most so many characters between natural boundaries: span_start, span_end."""

    def eval(self, text: str, most: int) -> Iterator[tuple[int, int]]:
        if text is not None and most is not None and most > 0:
            yield from chunking.spans(text, most)


def register(spark: SparkSession) -> list[str]:
    """Register all functions in a session; a null argument gives null or no rows."""
    spark.udf.register("gs_slug", _each(factcells.slug, T.StringType()))
    spark.udf.register("gs_period", _each(factcells.period, T.StringType()))
    spark.udf.register("gs_number", _each(_number, T.DoubleType()))
    spark.udf.register("gs_date", _each(factcells.real_date, T.DateType()))
    spark.udf.register("gs_yes_no", _each(factcells.yes_no, T.BooleanType()))
    spark.udf.register("gs_ground", F.pandas_udf(_ground, grounding.MATCH))
    spark.udtf.register("gs_spans", F.udtf(Spans, returnType="span_start int, span_end int"))
    return [*SCALARS, *TABLES]
