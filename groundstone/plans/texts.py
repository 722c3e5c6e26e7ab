"""Pages, chunks and quotes as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundstone.functions import identity, text
from groundstone.operators import chunking, facts as fact_ops, grounding, incremental, pages as page_ops, proposer
from groundstone.plans import sqltext as q
from groundstone.tables import once, table


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "pages"), "id")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "chunks"), "id")


def retrieval_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping windows of every page with measures and ids."""
    w = chunking.retrieval_windows(_pages(spark, folder))
    return w.select("id", "page_id", "ordinal", "char_start", "char_end", F.md5("text").alias("text_md5"), "token_estimate", "numeric_density")


def extraction_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every page in one piece, or packed between natural boundaries."""
    return chunking.extraction_chunks(_pages(spark, folder)).select("id", "page_id", "ordinal", "char_start", "char_end", "token_estimate", "numeric_density")


def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks per document by role and kind."""
    return chunking.chunk_counts(_chunks(spark, folder))


def chunk_measures(spark: SparkSession, folder: str) -> DataFrame:
    """token estimate and digit density of every stored chunk, computed anew."""
    c = F.col("text")
    return _chunks(spark, folder).select("id", text.token_estimate(c).alias("tokens"), F.round(text.numeric_density(c), 6).alias("density"))


def page_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The printed label of every page, agreed between neighbours."""
    return page_ops.page_labels(_pages(spark, folder)).select("id", "label")


def tabular_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of figures on every page, and whether it may hold a table."""
    c = F.col("text")
    return _pages(spark, folder).select("id", page_ops.figure_lines(c).alias("figure_lines"), page_ops.looks_tabular(c).alias("tabular"))


def corpus_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables in corpus texts rendered as markdown, with the span of their cells."""
    d = table(spark, folder, "documents").where("text is not null")
    rows = F.transform(F.filter(text.lines(F.col("text")), lambda x: F.contains(x, F.lit(" | "))), lambda x: F.split(x, " \\| "))
    d = d.withColumn("rows", rows).where(F.size("rows") >= 2)
    span = page_ops.located_span(F.col("text"), F.flatten("rows"))
    return d.select("doc_id", F.size("rows").alias("n_rows"), F.md5(page_ops.markdown(F.col("rows"))).alias("markdown_md5"), span["start"].alias("span_start"), span["end"].alias("span_end"))


def label_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled pages of every document, and whether it looks scanned."""
    return page_ops.label_coverage(_pages(spark, folder)).withColumn("coverage", F.round("coverage", 6))


def label_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """A10: pages with and without a label."""
    return _pages(spark, folder).groupBy(F.col("printed_page_label").isNotNull().alias("labelled")).agg(F.count("*").alias("pages"))


def content_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Hash and document id of every text; texts of one content are one document."""
    d = table(spark, folder, "documents").where("text is not null").withColumn("sha", F.sha2(F.col("text"), 256))
    return d.groupBy(F.col("sha").alias("content_sha256"), identity.document_id(F.col("sha")).alias("id")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id"))


def ingest_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What an ingest of the register's files does, with the parsed ones known."""
    reg = table(spark, folder, "doc_register")
    plan = incremental.ingest_plan(reg, reg.where("status != 'parsed'"))
    return plan.groupBy("action").agg(F.count("*").alias("documents"))


def ground_exact(spark: SparkSession, folder: str) -> DataFrame:
    """T8, first tier: evidence whose quote stands on its page as it is, with the first place."""
    return _quotes(spark, folder).where("match.mode = 'exact'").select("id", F.col("match.start").alias("start"), F.col("match.end").alias("end"))


def ground_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """T8, T8b, all tiers: evidence by how its quote is found on its page."""
    return _quotes(spark, folder).select("id", F.col("match.start").alias("start"), F.col("match.end").alias("end"), F.col("match.mode").alias("mode"))


def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    ev = once(table(spark, folder, "evidence"), "id").where("quote is not null").select("id", "document_id", "pdf_page_index", "quote")
    pg = _pages(spark, folder).select("document_id", "pdf_page_index", "text")
    return grounding.grounded(ev.join(pg, ["document_id", "pdf_page_index"]), "text", "quote")


def propose_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts proposed from every extraction chunk by patterns."""
    return proposer.proposed(_titled(spark, folder))


def _titled(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "doc_register").select(F.col("id").alias("document_id"), F.coalesce("title", "filename").alias("title"))
    return _chunks(spark, folder).where("role = 'extraction'").join(titles, "document_id", "left").select("id", "text", "title")


def store_records(spark: SparkSession, folder: str) -> DataFrame:
    """The proposed facts grounded, normalised and stored, with their outcome."""
    chunks, pages = _chunks(spark, folder), _pages(spark, folder)
    done = fact_ops.stored(proposer.proposed(_titled(spark, folder)), chunks, pages)
    return done.select("id", "chunk_id", "fact_type", "canonical_key", "value_num", "norm_unit", "quote_char_start", "quote_char_end", "match_mode", "outcome")


def extraction_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Proposed facts by outcome, and the share that grounds."""
    return fact_ops.outcome_counts(store_records(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    retrieval_windows, extraction_chunks, chunk_counts, chunk_measures, page_labels, tabular_pages, corpus_tables, label_coverage, label_histogram, content_identity, ingest_plan, ground_exact, ground_quotes, propose_facts, store_records, extraction_outcomes,
)}

_STRIPPED = q.strip("text")
_DENSITY = f"case when len(regexp_extract_all(text, '{q.WORD}')) = 0 then 0.0 else len(regexp_extract_all(text, '\\p{{Nd}}')) / len(regexp_extract_all(text, '{q.WORD}')) end"
_LINES = "(case when list_extract(string_split_regex(text, '{e}'), -1) = '' then string_split_regex(text, '{e}')[:-2] else string_split_regex(text, '{e}') end)".format(e=text.LINE_END)
_TOKENS = f"list_filter(string_split_regex(l, '{q.SPACES}'), lambda t: t <> '')"
_HITS = f"len(list_filter({_TOKENS}, lambda t: regexp_matches(t, '{page_ops.FIGURE}')))"
_FIGURES = f"len(list_filter({_LINES}, lambda l: {_HITS} > 0 and {_HITS} >= greatest(1, len({_TOKENS}) // 2)))"
_BARE = q.strip("quote")
_BARE = f"case when regexp_matches({_BARE}, '(?s)^[\"''“‘].*[\"''”’]$') and length({_BARE}) >= 2 then {q.strip(f'substr({_BARE}, 2, length({_BARE}) - 2)')} else {_BARE} end"

_WORTH = " ".join(f"when '{k}' then {v}" for k, v in page_ops.ROMAN.items())
_ROMAN = f"(select list_sum([case when w[i] < coalesce(list_max(w[i + 1:]), 0) then -w[i] else w[i] end for i in range(1, len(w) + 1)]) from (select list_transform(string_split(lower(label), ''), lambda c: case c {_WORTH} end) as w))"
_SCAN = f"list_concat(list_slice({_LINES}, 1, {page_ops.SCAN_LINES}), list_slice({_LINES}, greatest(len({_LINES}) - {page_ops.SCAN_LINES - 1}, 1), len({_LINES})))"
_TOKEN = f"case when length(l) <= {page_ops.ALONE_CHARS} and regexp_extract(l, '{page_ops.ALONE}', 1) <> '' then regexp_extract(l, '{page_ops.ALONE}', 1) when length(l) <= {page_ops.EDGE_CHARS} then regexp_extract(l, '{page_ops.EDGE}', 1) || regexp_extract(l, '{page_ops.EDGE}', 2) else '' end"

SQL: dict[str, str] = {
    "page_labels": f"""with p as (select distinct id, document_id, pdf_page_index as page, text from pages),
 l as (select id, document_id, page, {q.strip('s')} as l from (select id, document_id, page, unnest({_SCAN}) as s from p)),
 t as (select distinct id, document_id, page, {_TOKEN} as label from l),
 v as (select *, case when regexp_full_match(label, '[0-9]+') then try_cast(label as bigint) else {_ROMAN} end as value from t where label <> ''),
 k as (select * from v where value between 1 and 9999),
 s as (select id, value, max(label) as label from k a where exists (select 1 from k b where b.document_id = a.document_id and ((b.page = a.page + 1 and b.value in (a.value + 1, a.value + 2)) or (b.page = a.page - 1 and b.value in (a.value - 1, a.value - 2)))) group by 1, 2),
 i as (select *, value - row_number() over (partition by id order by value) as island from s),
 r as (select id, count(*) as n, min(value) as low, arg_min(label, value) as first, arg_max(label, value) as last from i group by id, island),
 b as (select distinct on (id) * from r order by id, n desc, low)
 select p.id, case when b.n > 1 then b.first || '-' || b.last else b.first end as label from p left join b using (id)""",
    "retrieval_windows": f"""with p as (select distinct * from pages where length({_STRIPPED}) > 0),
 w as (select document_id, id as page_id, pdf_page_index, unnest(range(0, greatest(ceil((length(text) - 900) / 750.0)::bigint, 0) + 1)) as k, text as page from p),
 t as (select document_id, page_id, pdf_page_index, (k * 750)::bigint as char_start, least(k * 750 + 900, length(page)) as char_end, substr(page, k * 750 + 1, 900) as text from w),
 o as (select *, row_number() over (partition by document_id order by pdf_page_index, char_start) - 1 as ordinal from t where length({_STRIPPED}) >= 80)
 select document_id || ':r' || ordinal as id, page_id, ordinal, char_start, char_end, md5(text) as text_md5, greatest(1, length(text) // 4) as token_estimate, round({_DENSITY}, 4) as numeric_density from o""",
    "chunk_counts": f"select document_id, count(*) filter (role = 'extraction') as extraction, count(*) filter (role = 'retrieval') as retrieval, count(*) filter (kind = 'table') as tables from {q.once('chunks')} group by 1",
    "chunk_measures": f"select id, greatest(1, length(text) // 4) as tokens, round({_DENSITY}, 6) as density from {q.once('chunks')}",
    "tabular_pages": f"select id, {_FIGURES} as figure_lines, {_FIGURES} >= 4 as tabular from {q.once('pages')}",
    "label_coverage": f"select document_id, count(*) as pages, count(*) filter (coalesce(printed_page_label, '') <> '') as labelled, round(count(*) filter (coalesce(printed_page_label, '') <> '') / count(*), 6) as coverage, sum(length(coalesce(text, ''))) / count(*) < 120 as probably_scanned from {q.once('pages')} group by 1",
    "label_histogram": f"select printed_page_label is not null as labelled, count(*) as pages from {q.once('pages')} group by 1",
    "content_identity": "select sha256(text) as content_sha256, 'doc_' || substr(sha256(text), 1, 16) as id, count(*) as copies, min(doc_id) as first_doc_id from documents where text is not null group by 1, 2",
    "ingest_plan": "select action, count(*) as documents from (select r.content_sha256, case when max(k.parser_version) is null then 'new' when max(k.parser_version) <> '1' then 'stale' else 'skip' end as action from (select distinct content_sha256 from doc_register) r left join (select * from doc_register where status <> 'parsed') k using (content_sha256) group by 1) group by 1",
    "ground_exact": f"""with e as (select distinct id, document_id, pdf_page_index, {_BARE} as q from evidence where quote is not null), p as (select distinct document_id, pdf_page_index, text from pages)
 select id, strpos(text, q) - 1 as start, strpos(text, q) - 1 + length(q) as end from e join p using (document_id, pdf_page_index) where length(q) >= 12 and strpos(text, q) > 0""",
}
