"""Scalar normalisation, the registry and pair rules as queries over the facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundstone.functions import identity, payload, quantity, text
from groundstone.operators import facts as fact_ops, relate
from groundstone.plans import sqltext as q
from groundstone.tables import once, table

def _p():
    return F.col("payload_json")



def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "facts"), "id")


def _fields(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder).select("id", *[payload.field(_p(), k).alias(k) for k in ("subject", "value", "unit", "time_scope")], payload.attribute(_p()).alias("attribute"), F.coalesce(F.nullif(payload.field(_p(), "time_scope"), F.lit("")), payload.field(_p(), "period")).alias("scope"))


_FIELDS = f"fields as (select id, {', '.join(f'{q.field(k)} as {k}' for k in ('subject', 'value', 'unit', 'time_scope'))}, {q.attribute()} as attribute, coalesce(nullif({q.field('time_scope')}, ''), {q.field('period')}) as scope from facts1)"


def normalize_value(spark: SparkSession, folder: str) -> DataFrame:
    """Magnitude and canonical unit of every payload's value and unit."""
    return quantity.normalised(_fields(spark, folder), "value", "unit").select("id", F.round("norm_value", 6).alias("norm_value"), "norm_unit")


def scalar_parts(spark: SparkSession, folder: str) -> DataFrame:
    """F5-F9 apart: number, scale, currency, ratio unit and leftover words of every value."""
    d = _fields(spark, folder).withColumn("v", text.clean(F.coalesce("value", F.lit(""))))
    low = F.lower("v")
    return d.select("id", quantity.number(F.col("v")).alias("number"), quantity.scale(low).alias("scale"), quantity.currency(low).alias("currency"), quantity.ratio(low).alias("ratio"), quantity.leftover_words(low).cast("bigint").alias("words"), F.col("v").rlike(quantity.CODE).alias("is_code"))


def canonical_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Key, embedded text, fact type and period of every payload."""
    d = _fields(spark, folder)
    d = d.withColumns({f"c_{c}": text.clean(F.coalesce(c, F.lit(""))) for c in ("subject", "attribute", "value", "unit")})
    scope = F.col("scope")
    s, a, v, u = (F.col(f"c_{c}") for c in ("subject", "attribute", "value", "unit"))
    return d.select("id", identity.canonical_key(s, a).alias("canonical_key"), identity.fact_type(a).alias("fact_type"), identity.canonical_text(s, a, v, u, text.clean(F.coalesce(scope, F.lit("")))).alias("canonical_text"), identity.period(F.col("time_scope")).alias("period"))


def periods(spark: SparkSession, folder: str) -> DataFrame:
    """F16 over the column: facts by canonical period."""
    return _facts(spark, folder).groupBy(identity.period(F.col("time_scope")).alias("period")).agg(F.count("*").alias("facts"))


def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids made from content, and the confidence as a number from 0 to 1."""
    d = _facts(spark, folder)
    f = lambda k: payload.field(_p(), k)
    made = identity.fact_id(F.col("document_id"), F.col("chunk_id"), f("subject"), payload.attribute(_p()), f("value"), f("time_scope"), F.coalesce(f("source_quote"), F.lit("")))
    return d.select("id", made.alias("content_id"), identity.evidence_id(F.col("id")).alias("evidence_id"), identity.confidence(f("confidence")).alias("payload_confidence"))


def fact_type_registry(spark: SparkSession, folder: str) -> DataFrame:
    """A1: what every fact type's payloads turned out to hold."""
    return fact_ops.registry(_facts(spark, folder))


def registry_total(spark: SparkSession, folder: str) -> DataFrame:
    """The registry's counts add up to the facts that have a type."""
    d = _facts(spark, folder)
    total = fact_ops.registry(d).agg(F.sum("fact_count").alias("registered"))
    return total.withColumn("typed", d.agg(F.count("fact_type")).scalar()).withColumn("complete", F.col("registered") == F.col("typed"))


def emergent_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Payload keys beyond the core, with how many facts have them."""
    return _facts(spark, folder).select(F.explode(payload.emergent_keys(_p())).alias("key")).groupBy("key").agg(F.count("*").alias("facts"))


def json_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads through the guard, as they are, fenced, wrapped and cut off."""
    d = _facts(spark, folder).select("id", _p().alias("p"))
    forms = F.explode(F.array(*[F.struct(F.lit(n).alias("form"), x.alias("raw")) for n, x in (
        ("plain", F.col("p")), ("fenced", F.concat(F.lit("```json\n"), "p", F.lit("\n```"))), ("wrapped", F.concat(F.lit('{"facts": ['), "p", F.lit("]}"))), ("cut", F.concat(F.lit("["), "p", F.lit(', {"subject": "x'))), ("empty", F.lit("  ")), ("words", F.lit("no facts here")),
    )])).alias("x")
    g = d.select(forms).select("x.form", payload.guarded(F.col("x.raw")).alias("g"))
    return g.groupBy("form", F.col("g.outcome").alias("outcome")).agg(F.count("*").alias("texts"), F.sum(F.size("g.records")).alias("records"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "relationships"), "id").select("id", "fact_a_id", "fact_b_id", F.col("relation_type").alias("model_type"), F.col("reason_tag").alias("model_tag"), F.col("confidence").alias("model_confidence"))


def classify_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored pair by the rules."""
    pairs = _pairs(spark, folder).select("fact_a_id", "fact_b_id").distinct()
    return relate.classified(pairs, _facts(spark, folder))


def pair_explanations(spark: SparkSession, folder: str) -> DataFrame:
    """In words why every stored pair has its verdict."""
    pairs = _pairs(spark, folder).select("fact_a_id", "fact_b_id").distinct()
    return relate.classified(pairs, _facts(spark, folder), explain=True).select("fact_a_id", "fact_b_id", "explanation")


def checked_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored verdicts as if a model had given them, corrected by arithmetic; counts by outcome."""
    d = relate.classified(_pairs(spark, folder), _facts(spark, folder), model=True)
    return d.groupBy("relation_type", "reason_tag", "status").agg(F.count("*").alias("pairs"), F.round(F.sum("confidence"), 6).alias("confidence"))


def values_agree(spark: SparkSession, folder: str) -> DataFrame:
    """F11 over neighbouring facts of a key: agreeing, differing and incomparable pairs."""
    d = _pairs(spark, folder).select("fact_a_id", "fact_b_id")
    v = _facts(spark, folder).select("id", "value_num")
    d = d.join(v.select(F.col("id").alias("fact_a_id"), F.col("value_num").alias("a")), "fact_a_id").join(v.select(F.col("id").alias("fact_b_id"), F.col("value_num").alias("b")), "fact_b_id")
    return d.groupBy(quantity.agree(F.col("a"), F.col("b")).alias("agree")).agg(F.count("*").alias("pairs"))


_VIEWS = f"""with {q.FACTS},
 fields as (select id, document_id, {', '.join(f'{q.field(k)} as {k}' for k in ('subject', 'value', 'unit', 'time_scope', 'qualifier'))}, {q.attribute()} as attribute from facts1),
{q.normalised('fields', '*')},
 views as (select id, {q.canonical_key(q.clean("coalesce(subject, '')"), q.clean("coalesce(attribute, '')"))} as key, norm_value, norm_unit, {q.period('time_scope')} as period, lower({q.strip("coalesce(qualifier, '')")}) as qualifier from normed)"""
_AGREE = "(case when a.{v} is null or b.{v} is null then null when a.{v} = b.{v} then true else abs(a.{v} - b.{v}) / nullif(greatest(abs(a.{v}), abs(b.{v})), 0) <= 0.01 end)"
_UNITS = "(coalesce(a.norm_unit, '') <> '' and coalesce(b.norm_unit, '') <> '' and a.norm_unit <> b.norm_unit)"
_PERIODS = "(a.period <> '' and b.period <> '' and a.period <> b.period)"


def _rules(column: int) -> str:
    same = _AGREE.format(v="norm_value")
    rows = [("a.key <> b.key", ("'UNRELATED'", "'different_attribute'", "0.5")), (_UNITS, ("'CONTEXT_RECONCILED'", "'units_differ'", "0.5")), (f"{same} is null", ("'UNRELATED'", "'non_numeric'", "0.3")), (same, ("'CORROBORATES'", "'same_value'", "0.7")), ("a.period <> b.period", ("'CONTEXT_RECONCILED'", "'different_period'", "0.6")), ("a.qualifier <> b.qualifier", ("'CONTEXT_RECONCILED'", "'different_scope'", "0.6"))]
    last = ("'CONTRADICTS'", "'value_mismatch'", "0.6")[column]
    return f"case {' '.join(f'when {t} then {v[column]}' for t, v in rows)} else {last} end"


def _checked(column: int) -> str:
    said = f"upper({q.strip('p.model_type')})"
    conf = "least(greatest(coalesce(p.model_confidence, 0.6), 0), 1)"
    lifted = f"(a.period <> '' and a.period = b.period and not {_UNITS} and coalesce({_AGREE.format(v='norm_value')}, false))"
    rows = [
        (f"{said} is null or {said} not in ('CORROBORATES', 'CONTRADICTS', 'CONTEXT_RECONCILED', 'UNRELATED')", _rules(column)),
        (f"{said} = 'CONTRADICTS' and {_PERIODS}", ("'CONTEXT_RECONCILED'", "'different_period'", conf)[column]),
        (f"{said} = 'CONTRADICTS' and {_UNITS}", ("'CONTEXT_RECONCILED'", "'units_differ'", conf)[column]),
        (f"{said} in ('CONTEXT_RECONCILED', 'UNRELATED') and {lifted}", ("'CORROBORATES'", "'same_value'", conf)[column]),
    ]
    last = (said, "substr(coalesce(nullif(p.model_tag, ''), 'unspecified'), 1, 60)", conf)[column]
    return f"case {' '.join(f'when {t} then {v}' for t, v in rows)} else {last} end"


_THERE = "a.id is not null and b.id is not null"
_MODEL_PAIRS = "(select distinct id, fact_a_id, fact_b_id, relation_type as model_type, reason_tag as model_tag, confidence as model_confidence from relationships)"
_JOINED = "left join views a on a.id = p.fact_a_id left join views b on b.id = p.fact_b_id"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    normalize_value, scalar_parts, canonical_identity, periods, content_ids, fact_type_registry, registry_total, emergent_keys, json_guard, classify_pairs, pair_explanations, checked_verdicts, values_agree,
)}

SQL: dict[str, str] = {
    "normalize_value": f"with {q.FACTS}, {_FIELDS}, {q.normalised('fields', 'id, value, unit')} select id, round(norm_value, 6) as norm_value, norm_unit from normed",
    "scalar_parts": f"""with {q.FACTS}, {_FIELDS}, c as (select id, {q.clean("coalesce(value, '')")} v from fields), l as (select *, lower(v) low from c)
 select id, {q.number('v')} as number, {q.scale('low')} as scale, {q.currency('low')} as currency, {q.ratio('low')} as ratio, {q.leftover_words('low')} as words, {q.code('v')} as is_code from l""",
    "canonical_identity": f"""with {q.FACTS}, {_FIELDS}, c as (select id, time_scope, {', '.join(f'{q.clean(f"coalesce({k}, {chr(39) * 2})")} as {k}' for k in ('subject', 'attribute', 'value', 'unit'))}, {q.clean("coalesce(scope, '')")} as scope from fields)
 select id, {q.canonical_key('subject', 'attribute')} as canonical_key, coalesce(nullif({q.slug("coalesce(nullif(attribute, ''), 'unspecified')")}, ''), 'unspecified') as fact_type,
 coalesce(nullif(array_to_string(list_filter([subject, attribute], lambda x: x <> ''), ' - '), ''), 'unknown fact') || (case when value = '' and unit = '' then '' else ': ' || array_to_string(list_filter([value, unit], lambda x: x <> ''), ' ') end) || (case when scope = '' then '' else ' [' || scope || ']' end) as canonical_text,
 {q.period('time_scope')} as period from c""",
    "periods": f"with {q.FACTS} select {q.period('time_scope')} as period, count(*) as facts from facts1 group by 1",
    "content_ids": f"""with {q.FACTS} select id, 'fact_' || substr(sha1(concat_ws('|', document_id, chunk_id, coalesce({q.field('subject')}, 'None'), coalesce({q.attribute()}, 'None'), coalesce({q.field('value')}, 'None'), coalesce({q.field('time_scope')}, 'None'), substr(coalesce({q.field('source_quote')}, ''), 1, 160))), 1, 16) as content_id,
 'ev_' || regexp_replace(id, '^fact_', '') as evidence_id, least(greatest(coalesce(try_cast({q.field('confidence')} as double), 0.5), 0), 1) as payload_confidence from facts1""",
    "fact_type_registry": f"""with {q.FACTS}, b as (select * from facts1 where fact_type is not null),
 k as (select fact_type, string_agg(key, ',' order by key) as observed_keys from (select distinct fact_type, unnest(json_keys(payload_json)) as key from b) group by 1),
 m as (select fact_type, arg_min(document_id, (created_at, id)) as first_document_id, min(created_at) as first_seen_at, max(created_at) as last_seen_at, count(*) as fact_count, arg_min(id, (created_at, id)) as sample_fact_id from b group by 1)
 select m.*, observed_keys from m left join k using (fact_type)""",
    "registry_total": f"with {q.FACTS} select (select sum(n)::bigint from (select count(*) n from facts1 where fact_type is not null group by fact_type)) as registered, count(fact_type) as typed, (select sum(n)::bigint from (select count(*) n from facts1 where fact_type is not null group by fact_type)) = count(fact_type) as complete from facts1",
    "emergent_keys": f"with {q.FACTS} select key, count(*) as facts from (select unnest(json_keys(payload_json)) as key from facts1) where key not in ('subject', 'attribute', 'predicate', 'value', 'unit', 'time_scope', 'qualifier', 'confidence', 'source_quote') group by 1",
    "json_guard": f"""with {q.FACTS}, forms as (select unnest([{{'form': 'plain', 'raw': p}}, {{'form': 'fenced', 'raw': '```json' || chr(10) || p || chr(10) || '```'}}, {{'form': 'wrapped', 'raw': '{{"facts": [' || p || ']}}'}}, {{'form': 'cut', 'raw': '[' || p || ', {{"subject": "x'}}, {{'form': 'empty', 'raw': '  '}}, {{'form': 'words', 'raw': 'no facts here'}}]) as x from (select payload_json as p from facts1)),
 t as (select x.form as form, trim(regexp_replace(x.raw, '^```json\\s*|\\s*```$', '', 'g')) as raw from forms),
 w as (select form, raw, json_valid(raw) as whole, case when raw like '[%' then regexp_replace(raw, ',[^,]*$', '') || ']' end as mended from t),
 g as (select form, case when raw = '' or whole then 'ok_first_try' when json_valid(mended) then 'ok_after_repair' else 'failed' end as outcome, case when raw = '' then null when whole then raw::json when json_valid(mended) then mended::json end as j from w)
 select form, outcome, count(*) as texts, sum(case when j is null then 0 when json_type(j) = 'ARRAY' then json_array_length(j) when json_type(j, '$.facts') = 'ARRAY' then json_array_length(j, '$.facts') else 1 end)::bigint as records from g group by 1, 2""",
    "classify_pairs": f"""{_VIEWS} select p.fact_a_id, p.fact_b_id, case when {_THERE} then {_rules(0)} end as relation_type, case when {_THERE} then {_rules(1)} end as reason_tag, case when {_THERE} then {_rules(2)} end::double as confidence, case when {_THERE} then 'ok' else 'failed' end as status
 from (select distinct fact_a_id, fact_b_id from relationships) p {_JOINED}""",
    "pair_explanations": f"""{_VIEWS}, t as (select p.fact_a_id, p.fact_b_id, case when {_THERE} then {_rules(1)} end as tag, format('{{:g}} / {{:g}}', a.norm_value, b.norm_value) as v, coalesce(a.key, 'none') || ' / ' || coalesce(b.key, 'none') as k, coalesce(a.norm_unit, 'none') || ' / ' || coalesce(b.norm_unit, 'none') as u, coalesce(a.period, 'none') || ' / ' || coalesce(b.period, 'none') as t, coalesce(a.qualifier, 'none') || ' / ' || coalesce(b.qualifier, 'none') as q
 from (select distinct fact_a_id, fact_b_id from relationships) p {_JOINED})
 select fact_a_id, fact_b_id, case tag when 'different_attribute' then 'keys differ: ' || k when 'units_differ' then 'units differ: ' || u when 'non_numeric' then 'a side has no magnitude' when 'same_value' then 'magnitudes agree: ' || v when 'different_period' then v || ' in different periods: ' || t when 'different_scope' then v || ' in different scopes: ' || q when 'value_mismatch' then 'magnitudes differ: ' || v end as explanation from t""",
    "checked_verdicts": f"""{_VIEWS}, v as (select case when {_THERE} then {_checked(0)} end as relation_type, case when {_THERE} then {_checked(1)} end as reason_tag, case when {_THERE} then {_checked(2)} end::double as confidence, case when {_THERE} then 'ok' else 'failed' end as status from {_MODEL_PAIRS} p {_JOINED})
 select relation_type, reason_tag, status, count(*) as pairs, round(sum(confidence), 6) as confidence from v group by all""",
    "values_agree": f"with {q.FACTS}, p as (select distinct id, fact_a_id, fact_b_id from relationships) select {_AGREE.format(v='value_num')} as agree, count(*) as pairs from p join facts1 a on a.id = p.fact_a_id join facts1 b on b.id = p.fact_b_id group by 1",
}
