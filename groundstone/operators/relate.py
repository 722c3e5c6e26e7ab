"""Pairs of facts classified by rules, with a model's verdict checked against arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundstone.functions import identity
from groundstone.functions.payload import attribute, field
from groundstone.functions.quantity import agree, general, normalised
from groundstone.functions.text import clean, strip

# The labels of a relation.
LABELS = ["CORROBORATES", "CONTRADICTS", "CONTEXT_RECONCILED", "UNRELATED"]


def views(facts: DataFrame) -> DataFrame:
    """What the rules compare, once per fact: key, magnitude, unit, period and qualifier from the payload."""
    p = F.col("payload_json")
    d = facts.select("id", "document_id", *[field(p, k).alias(k) for k in ("subject", "value", "unit", "time_scope", "qualifier")], attribute(p).alias("attribute"))
    d = d.withColumns({"_s": clean(F.coalesce("subject", F.lit(""))), "_a": clean(F.coalesce("attribute", F.lit("")))})
    d = normalised(d, "value", "unit")
    return d.select("id", "document_id", identity.canonical_key(F.col("_s"), F.col("_a")).alias("key"), "norm_value", "norm_unit", identity.period(F.col("time_scope")).alias("period"), F.lower(strip(F.coalesce("qualifier", F.lit("")))).alias("qualifier"))


def _differ(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (a != b)


def by_rules(tolerance: float = 0.01) -> Column:
    """struct(relation_type, reason_tag, confidence) of columns a_* and b_*; the first rule that holds counts."""
    c = lambda n: (F.col(f"a_{n}"), F.col(f"b_{n}"))
    same = agree(*c("norm_value"), tolerance)
    verdict = lambda kind, tag, conf: F.struct(F.lit(kind).alias("relation_type"), F.lit(tag).alias("reason_tag"), F.lit(conf).alias("confidence"))
    return (
        F.when(c("key")[0] != c("key")[1], verdict("UNRELATED", "different_attribute", 0.5))
        .when(_differ(*c("norm_unit")), verdict("CONTEXT_RECONCILED", "units_differ", 0.5))
        .when(same.isNull(), verdict("UNRELATED", "non_numeric", 0.3))
        .when(same, verdict("CORROBORATES", "same_value", 0.7))
        .when(c("period")[0] != c("period")[1], verdict("CONTEXT_RECONCILED", "different_period", 0.6))
        .when(c("qualifier")[0] != c("qualifier")[1], verdict("CONTEXT_RECONCILED", "different_scope", 0.6))
        .otherwise(verdict("CONTRADICTS", "value_mismatch", 0.6))
    )


def explained(tag: Column) -> Column:
    """In words why the rules gave a reason tag, from the columns a_* and b_*."""
    both = lambda n: F.concat(F.coalesce(F.col(f"a_{n}"), F.lit("none")), F.lit(" / "), F.coalesce(F.col(f"b_{n}"), F.lit("none")))
    values = F.concat(general(F.col("a_norm_value")), F.lit(" / "), general(F.col("b_norm_value")))
    return (
        F.when(tag == "different_attribute", F.concat(F.lit("keys differ: "), both("key")))
        .when(tag == "units_differ", F.concat(F.lit("units differ: "), both("norm_unit")))
        .when(tag == "non_numeric", "a side has no magnitude")
        .when(tag == "same_value", F.concat(F.lit("magnitudes agree: "), values))
        .when(tag == "different_period", F.concat(values, F.lit(" in different periods: "), both("period")))
        .when(tag == "different_scope", F.concat(values, F.lit(" in different scopes: "), both("qualifier")))
        .when(tag == "value_mismatch", F.concat(F.lit("magnitudes differ: "), values))
    )


def checked(model: str = "model_type", model_tag: str = "model_tag", model_confidence: str = "model_confidence", tolerance: float = 0.01) -> Column:
    """A model's verdict where it is valid, corrected by arithmetic; the rules' verdict elsewhere.

    A contradiction between different periods or units is context; context or no relation between
    equal magnitudes of one period is corroboration.
    """
    said = F.upper(strip(F.col(model)))
    a, b = (lambda n: F.col(f"a_{n}")), (lambda n: F.col(f"b_{n}"))
    periods, units = _differ(a("period"), b("period")), _differ(a("norm_unit"), b("norm_unit"))
    lifted = (a("period") != "") & (a("period") == b("period")) & ~units & F.coalesce(agree(a("norm_value"), b("norm_value"), tolerance), F.lit(False))
    conf = F.least(F.greatest(F.coalesce(F.col(model_confidence).cast("double"), F.lit(0.6)), F.lit(0.0)), F.lit(1.0))
    out = lambda kind, tag: F.struct(kind.alias("relation_type"), tag.alias("reason_tag"), conf.alias("confidence"))
    context = F.lit("CONTEXT_RECONCILED")
    return (
        F.when(said.isNull() | ~said.isin(LABELS), by_rules(tolerance))
        .when((said == "CONTRADICTS") & periods, out(context, F.lit("different_period")))
        .when((said == "CONTRADICTS") & units, out(context, F.lit("units_differ")))
        .when(said.isin("CONTEXT_RECONCILED", "UNRELATED") & lifted, out(F.lit("CORROBORATES"), F.lit("same_value")))
        .otherwise(out(said, F.substring(F.coalesce(F.nullif(F.col(model_tag), F.lit("")), F.lit("unspecified")), 1, 60)))
    )


def classified(pairs: DataFrame, facts: DataFrame, model: bool = False, explain: bool = False) -> DataFrame:
    """fact_a_id, fact_b_id and the verdict, with the rules' explanation if asked; pairs with an end that is no fact have status ``failed``.

    Magnitudes and periods are computed once per fact, before the pairs meet them.
    """
    v = views(facts)
    side = lambda s: v.select(*[F.col(c).alias("fact_a_id" if s == "a" and c == "id" else "fact_b_id" if c == "id" else f"{s}_{c}") for c in v.columns])
    d = pairs.join(side("a"), "fact_a_id", "left").join(side("b"), "fact_b_id", "left")
    there = F.col("a_key").isNotNull() & F.col("b_key").isNotNull()
    d = d.withColumn("_v", F.when(there, checked() if model else by_rules()))
    if explain:
        d = d.withColumn("explanation", F.when(there, explained(by_rules()["reason_tag"])))
    return d.select("fact_a_id", "fact_b_id", "_v.*", F.when(there, "ok").otherwise("failed").alias("status"), *(["explanation"] if explain else []))
