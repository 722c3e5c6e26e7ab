"""Reading the store: fact details, filters, pages of results, reports.

Every function takes DataFrames and returns one; a page of results is an order and a slice of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundstone.functions.identity import blank_to, page_label
from groundstone.functions.payload import attribute, field
from groundstone.functions.text import strip

MOST_ROWS = 500


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and rows of every table, each counted in its own scan of no columns."""
    parts = [d.agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n, d in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_evidence(evidence: DataFrame) -> DataFrame:
    """One evidence row a fact, of the smallest id."""
    cols = ["id", "quote", "pdf_page_index", "printed_page_label", "match_mode", "quote_char_start", "quote_char_end", "chunk_id"]
    best = evidence.where("fact_id is not null").groupBy("fact_id").agg(F.min_by(F.struct(*cols), "id").alias("e"))
    return best.select("fact_id", F.col("e.id").alias("evidence_id"), *[F.col(f"e.{c}").alias(c) for c in cols[1:]])


def fact_details(facts: DataFrame, documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every fact of a known document with its payload's fields, its document and its evidence."""
    p = F.col("payload_json")
    e = first_evidence(evidence).drop("chunk_id").withColumnRenamed("fact_id", "id")
    d = facts.join(documents.select(F.col("id").alias("document_id"), "filename", F.col("title").alias("document_title")), "document_id").join(e, "id", "left")
    return d.select("id", "document_id", F.col("filename").alias("document"), "document_title", *[field(p, k).alias(k) for k in ("subject", "value", "time_scope", "qualifier")], field(p, "unit").alias("stated_unit"), attribute(p).alias("attribute"), "fact_type", "value_num", F.col("unit").alias("normalised_unit"), "confidence", "extractor", "quote", "pdf_page_index", "printed_page_label", page_label(F.col("printed_page_label"), F.col("pdf_page_index")).alias("page_label"), "match_mode", "quote_char_start", "quote_char_end")


def holds(c: Column, text: str) -> Column:
    """Substring without regard to letter case; ``%`` and ``_`` stand for themselves."""
    return F.contains(F.lower(c), F.lit(text.lower()))


def fact_filter(facts: DataFrame, min_confidence: float = 0.0, document: str | None = None, fact_type: str | None = None, numeric: bool = False, text: str | None = None) -> DataFrame:
    """All conditions that are given; a null confidence never passes."""
    keep = F.col("confidence") >= min_confidence
    if document:
        keep &= F.col("document_id") == document
    if fact_type:
        keep &= F.col("fact_type") == fact_type
    if numeric:
        keep &= F.col("value_num").isNotNull()
    if text:
        keep &= holds(F.col("canonical_text"), text) | holds(F.col("payload_json"), text)
    return facts.where(keep)


def relation_filter(relationships: DataFrame, relation_type: str | None = None, reason: str | None = None, unrelated: bool = False) -> DataFrame:
    keep = F.lit(True)
    if relation_type:
        keep = F.col("relation_type") == relation_type.upper()
    elif not unrelated:
        keep = F.col("relation_type") != "UNRELATED"
    if reason:
        keep &= F.col("reason_tag") == reason
    return relationships.where(keep)


def page_of(df: DataFrame, order: Sequence[Column | str], limit: int = 50, offset: int = 0) -> DataFrame:
    """A slice of an ordered result; the order should end in a key, so that pages don't overlap."""
    return df.orderBy(*order).offset(offset).limit(min(limit, MOST_ROWS))


def documents_with_counts(documents: DataFrame, facts: DataFrame, chunks: DataFrame, progress: DataFrame) -> DataFrame:
    """Every document with its facts, extraction chunks and chunks that were tried."""
    n = lambda df, name: df.groupBy("document_id").agg(F.count("*").alias(name)).withColumnRenamed("document_id", "id")
    tried = progress.join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id")
    out = documents
    for part, name in ((facts, "fact_count"), (chunks.where("role = 'extraction'"), "chunk_count"), (tried, "chunks_done")):
        out = out.join(n(part, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def oriented(relationships: DataFrame) -> DataFrame:
    """Every relationship from both its ends: fact_id, other_id.  A loop is seen once."""
    cols = [c for c in relationships.columns if c not in ("fact_a_id", "fact_b_id")]
    there = relationships.select(F.col("fact_a_id").alias("fact_id"), F.col("fact_b_id").alias("other_id"), *cols)
    back = relationships.where(~F.col("fact_a_id").eqNullSafe(F.col("fact_b_id"))).select(F.col("fact_b_id").alias("fact_id"), F.col("fact_a_id").alias("other_id"), *cols)
    return there.unionByName(back)


def context(evidence: DataFrame, chunks: DataFrame, pages: DataFrame, documents: DataFrame, window: int = 400) -> DataFrame:
    """Every piece of evidence inside its page: what stands before, in and after it, and whether the
    stored offsets still hold the stored quote.  Without offsets these are null."""
    window = min(window, 4_000)
    d = evidence.join(chunks.select(F.col("id").alias("chunk_id"), "page_id"), "chunk_id").join(pages.select(F.col("id").alias("page_id"), "text"), "page_id").join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id")
    s, e = F.col("quote_char_start"), F.col("quote_char_end")
    low = F.greatest(s - window, F.lit(0))
    ok = s.isNotNull() & e.isNotNull()
    part = lambda a, b: F.when(ok, F.substring("text", a + 1, b - a))
    return d.select("id", "fact_id", "filename", "pdf_page_index", "printed_page_label", "match_mode", "quote", part(low, s).alias("before"), part(s, e).alias("highlight"), part(e, F.least(e + window, F.length("text"))).alias("after"), F.when(ok, F.substring("text", s + 1, e - s) == F.col("quote")).alias("offsets_verified"))


def examples(relationships: DataFrame, details: DataFrame, kinds: Sequence[str], limit: int = 3) -> DataFrame:
    """The most legible cross-document relationships of every kind, ranked.

    Of each kind, five times as many as wanted (fifteen at least) are taken by confidence and
    similarity and ranked again: both quotes substantial, few rebuilt spans, printed page labels, the
    shorter quote's length.  Ties go to the smaller id.
    """
    side = lambda s: details.select(*[F.col(c).alias(f"{s}_{c}") for c in ("document_id", "quote", "match_mode", "printed_page_label")], F.col("id").alias(f"fact_{s}_id"))
    r = relationships.where(F.col("relation_type").isin(*kinds) & (F.col("cross_document") == 1) & (F.coalesce(F.trim("explanation"), F.lit("")) != ""))
    d = r.join(side("a"), "fact_a_id").join(side("b"), "fact_b_id").where("a_document_id != b_document_id")
    by = Window.partitionBy("relation_type").orderBy(F.desc_nulls_last("confidence"), F.desc_nulls_last("similarity_score"), "id")
    d = d.withColumn("n", F.row_number().over(by)).where(F.col("n") <= max(5 * limit, 15))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    d = d.where(some("a_quote") & some("b_quote"))
    shorter = F.least(F.length("a_quote"), F.length("b_quote"))
    one = lambda t: F.when(t, 1).otherwise(0)
    d = d.withColumns({"substantial": one(shorter >= 30), "rebuilt": one(F.col("a_match_mode").eqNullSafe("reconstructed_span")) + one(F.col("b_match_mode").eqNullSafe("reconstructed_span")), "labelled": one(some("a_printed_page_label")) + one(some("b_printed_page_label")), "shorter": shorter})
    best = Window.partitionBy("relation_type").orderBy(F.desc("substantial"), "rebuilt", F.desc("labelled"), F.desc("shorter"), F.desc_nulls_last("confidence"), F.desc_nulls_last("similarity_score"), "id")
    d = d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return d.select("relation_type", "rank", "id", "fact_a_id", "fact_b_id", "reason_tag", "confidence", "similarity_score", "substantial", "rebuilt", "labelled", "shorter")


def failures(progress: DataFrame, repairs: DataFrame) -> DataFrame:
    """One row: chunks tried, failed and barren, and the rates of repair and failure among them."""
    runs = progress.agg(F.count("*").alias("attempted"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if((F.col("status") == "done") & (F.col("facts") == 0)).alias("barren"))
    of = lambda *o: F.count_distinct(F.when(F.col("outcome").isin(*o), F.struct("outcome", "chunk_id")))
    log = repairs.where("stage = 'extraction'").join(progress.select("chunk_id").distinct(), "chunk_id", "left_semi")
    runs = runs.withColumns({"repaired": log.agg(of("ok_after_reprompt", "ok_after_repair")).scalar(), "json_failed": log.agg(of("failed")).scalar()})
    most = F.greatest("attempted", F.lit(1))
    return runs.select("attempted", "failed", "barren", (F.col("repaired") + F.col("json_failed")).alias("needing_repair"), (F.col("repaired") / most).alias("repair_rate"), (F.col("json_failed") / most).alias("failure_rate"))


def name_or_title(title: Column, filename: Column) -> Column:
    return blank_to(strip(F.coalesce(title, F.lit(""))), filename)
