"""From proposed records to facts with evidence, and the registry of what payloads hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from groundstone.functions import identity
from groundstone.functions.quantity import normalised
from groundstone.functions.text import clean, strip
from groundstone.operators.grounding import located
from groundstone.options import DEFAULTS, Options


def stored(records: DataFrame, chunks: DataFrame, pages: DataFrame, known: DataFrame | None = None, options: Options = DEFAULTS) -> DataFrame:
    """Every record with its ``outcome``: stored, rejected_invalid, rejected_ungrounded or
    rejected_duplicate; stored ones carry id, keys, magnitude and the span that grounds them.

    A record needs a subject or an attribute, and a quote.  Records of one content are one fact: the
    first by chunk and place stays, and none stays whose id ``known`` has.
    """
    place = chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_id", F.col("text").alias("chunk_text"), "char_start", "pdf_page_index", "printed_page_label")
    d = records.join(place, "chunk_id").join(pages.select(F.col("id").alias("page_id"), F.col("text").alias("page_text")), "page_id", "left")
    some = lambda c: F.length(strip(F.coalesce(F.col(c).cast("string"), F.lit("")))) > 0
    d = d.withColumn("valid", (some("subject") | some("attribute")) & some("source_quote"))
    d = located(d, "page_text", "chunk_text", "char_start", "source_quote", options)
    d = normalised(d, "value", "unit", "value_num", "norm_unit")
    origin = F.when(F.col("char_start").isNull(), F.col("chunk_text")).otherwise(F.col("page_text"))
    d = d.withColumn("quote", F.when(F.col("match.start").isNotNull(), F.substring(origin, F.col("match.start") + 1, F.col("match.end") - F.col("match.start"))))
    d = d.withColumn("id", identity.fact_id(F.col("document_id"), F.col("chunk_id"), F.col("subject"), F.col("attribute"), F.col("value"), F.col("time_scope"), F.coalesce("quote", F.lit(""))))
    grounded = F.col("valid") & F.col("match.start").isNotNull()
    first = F.row_number().over(Window.partitionBy("id").orderBy("chunk_id", "n"))
    d = d.withColumn("again", F.when(grounded, first > 1).otherwise(False))
    if known is not None:
        d = d.join(known.select("id", F.lit(True).alias("_known")).distinct(), "id", "left").withColumn("again", F.col("again") | F.coalesce("_known", F.lit(False))).drop("_known")
    outcome = F.when(~F.col("valid"), "rejected_invalid").when(F.col("match.start").isNull(), "rejected_ungrounded").when(F.col("again"), "rejected_duplicate").otherwise("stored")
    subject, attribute, value, unit, scope = (clean(F.coalesce(F.col(c), F.lit(""))) for c in ("subject", "attribute", "value", "unit", "time_scope"))
    return d.select(
        "id", "document_id", "chunk_id", "subject", "attribute", "value", "unit", "time_scope", identity.confidence(F.col("confidence")).alias("confidence"), "value_num", "norm_unit",
        identity.fact_type(attribute).alias("fact_type"), identity.canonical_key(subject, attribute).alias("canonical_key"), identity.canonical_text(subject, attribute, value, unit, scope).alias("canonical_text"),
        "quote", F.col("match.start").alias("quote_char_start"), F.col("match.end").alias("quote_char_end"), F.col("match.mode").alias("match_mode"), "pdf_page_index", "printed_page_label", outcome.alias("outcome"),
    )


def outcome_counts(records: DataFrame) -> DataFrame:
    """One row: records by outcome and the share that was stored (0 of none)."""
    kinds = ["stored", "rejected_invalid", "rejected_ungrounded", "rejected_duplicate"]
    counts = records.agg(F.count("*").alias("proposed"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])
    return counts.withColumn("grounding_rate", F.when(F.col("proposed") == 0, 0.0).otherwise(F.col("stored") / F.col("proposed")))


def registry(facts: DataFrame) -> DataFrame:
    """Per fact type: first document, first and last time, facts, the union of payload keys, a sample.

    Keys are gathered one row per distinct (type, key), so a type of any number of facts combines
    before the shuffle; a type's distinct keys are as many as its payloads have names.
    """
    base = facts.where("fact_type is not null")
    order = F.struct("created_at", "id")
    main = base.groupBy("fact_type").agg(F.min_by("document_id", order).alias("first_document_id"), F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"), F.count("*").alias("fact_count"), F.min_by("id", order).alias("sample_fact_id"))
    keys = base.select("fact_type", F.explode(F.json_object_keys("payload_json")).alias("key")).distinct().groupBy("fact_type").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("observed_keys"))
    return main.join(keys, "fact_type", "left")
