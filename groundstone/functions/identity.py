"""Names under which facts meet: keys, texts, periods and content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from groundstone.functions.text import SPACES

# Words that carry no identity in a key.
STOPWORDS = "the a an of for in on at to and s total overall".split()


def blank_to(c: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), default)


def slug(cleaned: Column) -> Column:
    """Of cleaned text: lower case, letters digits and % only, stopwords dropped, joined by ``_``."""
    words = F.split(F.regexp_replace(F.lower(cleaned), "[^a-z0-9%]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(STOPWORDS)), "_")


def canonical_key(subject: Column, attribute: Column) -> Column:
    return F.concat(slug(blank_to(F.coalesce(subject, F.lit("")), F.lit("unknown"))), F.lit("::"), slug(blank_to(F.coalesce(attribute, F.lit("")), F.lit("unknown"))))


def fact_type(attribute: Column) -> Column:
    return blank_to(slug(blank_to(F.coalesce(attribute, F.lit("")), F.lit("unspecified"))), F.lit("unspecified"))


def canonical_text(subject: Column, attribute: Column, value: Column, unit: Column, scope: Column) -> Column:
    """``subject - attribute: value unit [scope]`` without the parts that are missing."""
    here = lambda c: F.coalesce(c, F.lit(""))
    joined = lambda sep, *cs: F.array_join(F.filter(F.array(*[here(c) for c in cs]), lambda x: x != ""), sep)
    head, tail = joined(" - ", subject, attribute), joined(" ", value, unit)
    head = F.when(head == "", "unknown fact").otherwise(head)
    return F.concat(head, F.when(tail == "", "").otherwise(F.concat(F.lit(": "), tail)), F.when(here(scope) == "", "").otherwise(F.concat(F.lit(" ["), scope, F.lit("]"))))


# Fixed value: a period without white space and points: part of a year, fiscal mark, year or span of years, or other words.
PERIOD = r"^(?:(q[1-4]|h[12])[-/]?)?(fy)?(?:([0-9]{2,4})(?:[-/]([0-9]{2,4}))?|(.*))$"
FISCAL_WORDS = ["financialyear", "fiscalyear"]


def period(raw: Column) -> Column:
    """Canonical period: spellings of one fiscal year are one, a bare year stays a calendar year."""
    t = F.replace(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), SPACES, ""), F.lit("."), F.lit(""))
    t = F.regexp_replace(t, "|".join(FISCAL_WORDS), "fy")
    part, fiscal, first, last, other = (F.regexp_extract(t, PERIOD, i) for i in range(1, 6))
    year = F.nullif(first, F.lit("")).cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    end = F.nullif(last, F.lit("")).cast("int")
    near = year - year % 100 + end
    end = F.when(F.length(last) > 2, end).otherwise(F.when(near <= year, near + 100).otherwise(near))
    name = F.when((part != "") | (fiscal != "") | (last != ""), "fy").otherwise("cy")
    return F.concat(F.when(part == "", "").otherwise(F.concat(part, F.lit("-"))), F.when(first == "", other).otherwise(F.concat(name, F.coalesce(end, year).cast("string"))))


def shown(c: Column) -> Column:
    """A missing field as ids write it."""
    return F.coalesce(c, F.lit("None"))


def fact_id(document: Column, chunk: Column, subject: Column, attribute: Column, value: Column, scope: Column, quote: Column) -> Column:
    basis = F.concat_ws("|", document, chunk, shown(subject), shown(attribute), shown(value), shown(scope), F.substring(quote, 1, 160))
    return F.concat(F.lit("fact_"), F.substring(F.sha1(basis), 1, 16))


def evidence_id(fact: Column) -> Column:
    return F.concat(F.lit("ev_"), F.regexp_replace(fact, "^fact_", ""))


def relationship_id(a: Column, b: Column) -> Column:
    short = lambda c: F.substring(F.regexp_replace(c, "^fact_", ""), 1, 8)
    return F.concat(F.lit("rel_"), short(a), F.lit("_"), short(b))


def document_id(sha256: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(sha256, 1, 16))


def page_id(document: Column, index: Column) -> Column:
    return F.concat(document, F.lit(":p"), index.cast("string"))


def chunk_id(document: Column, role: Column, ordinal: Column) -> Column:
    return F.concat(document, F.lit(":"), F.substring(role, 1, 1), ordinal.cast("string"))


def page_label(printed: Column, index: Column) -> Column:
    return blank_to(printed, F.concat(F.lit("pdf#"), F.coalesce(index.cast("string"), F.lit("None"))))


def confidence(c: Column) -> Column:
    """Any stated confidence as a number from 0 to 1, 0.5 if it is none."""
    return F.least(F.greatest(F.coalesce(c.try_cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))

