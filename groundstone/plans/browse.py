"""The read side as queries: documents, facts, relationships, evidence, reports, work queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundstone.operators import incremental, store, vectors
from groundstone.options import DEFAULTS
from groundstone.plans import sqltext as q
from groundstone.session import cut
from groundstone.tables import once, table


class Store:
    """The tables of a folder, each row once.  What the test tables lack is derived from them: a run's
    progress and its repair log."""

    def __init__(self, spark: SparkSession, folder: str):
        self.read = lambda name, *keys: once(table(spark, folder, name), *keys)
        self.documents = table(spark, folder, "doc_register")

    def __getattr__(self, name: str) -> DataFrame:
        return self.read(name, "fact_id" if name == "fact_embeddings" else "id")

    @property
    def progress(self) -> DataFrame:
        """Chunks of documents that were extracted; one without facts failed if the document isn't linked."""
        n = self.facts.groupBy(F.col("chunk_id").alias("id")).agg(F.count("*").alias("facts"), F.max("created_at").alias("processed_at"))
        tried = self.chunks.where("role = 'extraction'").select("id", "document_id").join(self.documents.where("status != 'parsed'").select(F.col("id").alias("document_id"), "status"), "document_id")
        facts = F.coalesce("facts", F.lit(0))
        return tried.join(n, "id", "left").select(F.col("id").alias("chunk_id"), F.when((F.col("status") == "extracted") & (facts == 0), "failed").otherwise("done").alias("status"), facts.alias("facts"), "processed_at")

    @property
    def repairs(self) -> DataFrame:
        """One row for every chunk with evidence that wasn't found as it stands."""
        m = self.evidence.groupBy("chunk_id").agg(F.max(F.when(F.col("match_mode").isNull(), 3).when(F.col("match_mode") == "reconstructed_span", 2).when(F.col("match_mode") == "normalised_chars", 1).otherwise(0)).alias("w"))
        return m.where("w > 0").select("chunk_id", F.lit("extraction").alias("stage"), F.when(F.col("w") == 3, "failed").when(F.col("w") == 2, "ok_after_repair").otherwise("ok_after_reprompt").alias("outcome"))

    @property
    def details(self) -> DataFrame:
        return store.fact_details(self.facts, self.documents, self.evidence)


def store_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A2, Q1: rows of every table."""
    s = Store(spark, folder)
    return store.counts({"documents": s.documents, **{n: getattr(s, n) for n in ("pages", "chunks", "facts", "evidence", "relationships", "fact_embeddings")}})


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their counts and the fields of their meta data."""
    s = Store(spark, folder)
    d = store.documents_with_counts(s.documents, s.facts, s.chunks, s.progress)
    meta = lambda k, t: F.get_json_object("meta_json", f"$.{k}").try_cast(t)
    return d.select("id", "filename", "status", "fact_count", "chunk_count", "chunks_done", meta("printed_label_coverage", "double").alias("label_coverage"), meta("probably_scanned", "boolean").alias("scanned"), meta("detected_tables", "bigint").alias("tables"))


def delete_document(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every table after the document of the most facts is deleted."""
    s = Store(spark, folder)
    gone = s.facts.groupBy("document_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document_id").limit(1).select(F.col("document_id").alias("id"))
    left = incremental.without_documents({"documents": s.documents, **{n: getattr(s, n) for n in ("pages", "chunks", "facts", "evidence", "relationships", "fact_embeddings")}}, gone)
    return store.counts(left)


def list_facts(spark: SparkSession, folder: str) -> DataFrame:
    """A page of numeric facts of a text and a confidence, with the total."""
    s = Store(spark, folder)
    hits = store.fact_filter(s.facts, 0.6, numeric=True, text="Revenue")
    page = store.page_of(hits, [F.desc("confidence"), "id"], 50, 10).select("id", "confidence", "value_num", "canonical_text")
    return page.withColumn("total", hits.agg(F.count("*")).scalar())


def fact_details(spark: SparkSession, folder: str) -> DataFrame:
    """Every fact with document and evidence."""
    return Store(spark, folder).details


def fact_relationships(spark: SparkSession, folder: str) -> DataFrame:
    """Every fact's relationships from its own side, with the other fact."""
    s = Store(spark, folder)
    r = store.oriented(s.relationships.select("id", "fact_a_id", "fact_b_id", "relation_type", "reason_tag", "confidence"))
    other = s.facts.select(F.col("id").alias("other_id"), F.col("canonical_text").alias("other_text"))
    return s.facts.select(F.col("id").alias("fact_id")).join(r, "fact_id").join(other, "other_id", "left").select("fact_id", "id", "other_id", "relation_type", "reason_tag", "confidence", "other_text")


def list_fact_types(spark: SparkSession, folder: str) -> DataFrame:
    """Fact types by number of facts, with the file that had one first."""
    s = Store(spark, folder)
    first = s.facts.where("fact_type is not null").groupBy("fact_type").agg(F.min_by("document_id", F.struct("created_at", "id")).alias("document_id"), F.count("*").alias("fact_count"))
    d = first.join(s.documents.select(F.col("id").alias("document_id"), "filename"), "document_id", "left")
    return d.select("fact_type", "fact_count", F.col("filename").alias("first_seen_document")).orderBy(F.desc("fact_count"), "fact_type")


def list_relationships(spark: SparkSession, folder: str) -> DataFrame:
    """A page of relationships but unrelated ones, both facts with them."""
    s = Store(spark, folder)
    page = store.page_of(store.relation_filter(s.relationships), [F.desc("confidence"), F.desc("similarity_score"), "id"], 50, 20)
    side = lambda x: s.facts.select(F.col("id").alias(f"fact_{x}_id"), F.col("canonical_text").alias(f"text_{x}"))
    return page.join(side("a"), "fact_a_id", "left").join(side("b"), "fact_b_id", "left").select("id", "relation_type", "reason_tag", "confidence", "similarity_score", "text_a", "text_b")


def relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A3: relationships by type as stored, over all rows."""
    return Store(spark, folder).relationships.groupBy("relation_type").agg(F.count("*").alias("n"))


def match_modes(spark: SparkSession, folder: str) -> DataFrame:
    """A3: evidence by match mode."""
    return Store(spark, folder).evidence.groupBy("match_mode").agg(F.count("*").alias("n"))


def showcase(spark: SparkSession, folder: str) -> DataFrame:
    """The best examples of every relation type."""
    s = Store(spark, folder)
    return store.examples(s.relationships, s.details, ["CORROBORATES", "CONTRADICTS", "CONTEXT_RECONCILED"])


def failure_report(spark: SparkSession, folder: str) -> DataFrame:
    """What a run tried, what failed and what had to be repaired."""
    s = Store(spark, folder)
    f = store.failures(s.progress, s.repairs)
    return f.withColumns({c: F.round(c, 6) for c in ("repair_rate", "failure_rate")})


def barren_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The latest chunks that ran and gave no fact (a sample for the report)."""
    s = Store(spark, folder)
    d = s.progress.where("status = 'done' and facts = 0").join(s.chunks.select(F.col("id").alias("chunk_id"), "printed_page_label", "text"), "chunk_id")
    return d.orderBy(F.desc_nulls_last("processed_at"), "chunk_id").limit(10).select("chunk_id", "printed_page_label", F.substring("text", 1, 500).alias("text"))


def rebuilt_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The longest rebuilt spans (a sample for the report)."""
    s = Store(spark, folder)
    d = s.evidence.where("match_mode = 'reconstructed_span'").join(s.facts.select(F.col("id").alias("fact_id"), "canonical_text"), "fact_id").join(s.documents.select(F.col("id").alias("document_id"), "filename"), "document_id")
    return d.orderBy(F.desc(F.length("quote")), "id").limit(10).select("id", "fact_id", "canonical_text", "filename", F.substring("quote", 1, 400).alias("stored_span"))


def evidence_context(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of evidence inside its page."""
    s = Store(spark, folder)
    d = store.context(s.evidence, s.chunks, s.pages, s.documents)
    return d.select("id", "filename", F.md5("before").alias("before_md5"), "highlight", F.md5("after").alias("after_md5"), "offsets_verified")


def pending_round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks still to do, interleaved over documents."""
    s = Store(spark, folder)
    return incremental.pending(s.chunks, s.documents, s.progress).select("id", "document_id", "doc_rank")


def runtime_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Q20: chunks still to do and the seconds they take on four workers."""
    s = Store(spark, folder)
    n = incremental.pending(s.chunks, s.documents, s.progress, ordered=False).agg(F.count("*").alias("chunks"))
    return n.select("chunks", F.round(F.col("chunks") * DEFAULTS.seconds_per_chunk / 4, 6).alias("seconds"))


def browse_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of documents by part of their file's name, by part of their type."""
    s = Store(spark, folder)
    d = s.facts.join(s.evidence.select(F.col("fact_id").alias("id"), "quote", "match_mode"), "id").join(s.documents.select(F.col("id").alias("document_id"), "filename"), "document_id")
    return d.where(store.holds(F.col("filename"), "REPORT") & store.holds(F.col("fact_type"), "margin") & F.col("value_num").isNotNull()).select("id", "filename", "fact_type", "value_num", "match_mode", "quote")


def browse_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Contradictions with both facts; a side that is no fact has no text."""
    s = Store(spark, folder)
    r = store.relation_filter(s.relationships, "contradicts")
    side = lambda x: s.facts.select(F.col("id").alias(f"fact_{x}_id"), F.col("canonical_text").alias(f"text_{x}"))
    return r.join(side("a"), "fact_a_id", "left").join(side("b"), "fact_b_id", "left").select("id", "reason_tag", "confidence", "text_a", "text_b")


def browse_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with the title of their document and the label of their page."""
    s = Store(spark, folder)
    d = s.chunks.join(s.documents.select(F.col("id").alias("document_id"), "filename", "title"), "document_id").join(s.pages.select(F.col("id").alias("page_id"), F.col("printed_page_label").alias("page_printed")), "page_id")
    return d.select("id", "role", "ordinal", store.name_or_title(F.col("title"), F.col("filename")).alias("name"), "page_printed", F.substring("text", 1, 160).alias("head"))


def unembedded_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with a text and without a vector."""
    s = Store(spark, folder)
    return incremental.unembedded(s.facts, s.fact_embeddings).select("id")


def derived_status(spark: SparkSession, folder: str) -> DataFrame:
    """How far every document has come, from what it has."""
    s = Store(spark, folder)
    return incremental.statuses(s.documents, s.facts, s.relationships)


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    s = Store(spark, folder)
    v = vectors.proper(s.fact_embeddings.where("model = 'encoder-s64'"), 64)
    return v.join(s.facts.select(F.col("id").alias("fact_id"), "document_id"), "fact_id").select("fact_id", "document_id", "vector")


def vector_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of facts across documents that are alike, exactly."""
    return vectors.cross_document_pairs(_vectors(spark, folder)).withColumn("similarity", F.round("similarity", 6))


def link_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Alike pairs that aren't related yet."""
    found = vectors.cross_document_pairs(_vectors(spark, folder))
    return incremental.new_pairs(found, Store(spark, folder).relationships).select("fact_a_id", "fact_b_id", F.round("similarity", 6).alias("similarity"))


def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """V1, V2: squared length before and after normalising, of every proper vector."""
    d = _vectors(spark, folder).withColumn("u", vectors.unit(F.col("vector")))
    doubles = F.transform("vector", lambda x: x.cast("double"))
    return d.select("fact_id", F.round(vectors.dot(doubles, doubles), 4).alias("square"), F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("unit_square"))


def recent_documents(spark: SparkSession, folder: str) -> DataFrame:
    """L4, Q2: a page of documents, the latest ingested first."""
    return store.page_of(Store(spark, folder).documents, [F.desc_nulls_last("ingested_at"), "id"], 30, 5).select("id", "filename", "status", "ingested_at")


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The first pages of documents by part of their file's name."""
    s = Store(spark, folder)
    d = s.pages.join(s.documents.where(store.holds(F.col("filename"), "report")).select(F.col("id").alias("document_id"), "filename"), "document_id")
    return d.orderBy("document_id", "pdf_page_index", "id").limit(100).select("id", "filename", "pdf_page_index", "printed_page_label", F.substring("text", 1, 1000).alias("head"))


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The first chunks of a document by ordinal, those of extraction only."""
    s = Store(spark, folder)
    one = s.documents.orderBy("id").limit(3).select(F.col("id").alias("document_id"))
    d = s.chunks.where("role = 'extraction'").join(one, "document_id", "left_semi")
    return d.orderBy("document_id", "ordinal", "id").limit(60).select("id", "ordinal", "char_start", "char_end", F.substring("text", 1, 220).alias("head"))


def repair_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The latest chunks whose answer failed or had to be repaired."""
    s = Store(spark, folder)
    d = s.repairs.where(F.col("outcome").isin("failed", "ok_after_repair")).join(s.chunks.select(F.col("id").alias("chunk_id"), "document_id", "text"), "chunk_id")
    return d.orderBy(F.desc("chunk_id")).limit(10).select("chunk_id", "document_id", "outcome", F.substring("text", 1, 2000).alias("text"))


def showcase_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Q8: relationships by type, how many lie across documents and are explained, and whether every
    type of the showcase has an example."""
    s = Store(spark, folder)
    kinds = ["CORROBORATES", "CONTRADICTS", "CONTEXT_RECONCILED"]
    shown = showcase(spark, folder).groupBy("relation_type").agg(F.count("*").alias("examples"))
    told = F.coalesce(F.trim("explanation"), F.lit("")) != ""
    all_ = s.relationships.where(F.col("relation_type").isin(kinds)).groupBy("relation_type").agg(F.count("*").alias("total"), F.count_if(F.col("cross_document") == 1).alias("across"), F.count_if((F.col("cross_document") == 1) & told).alias("explained"))
    d = all_.join(shown, "relation_type", "left").withColumn("examples", F.coalesce("examples", F.lit(0)))
    return d.crossJoin(d.agg((F.count_if(F.col("examples") > 0) == len(kinds)).alias("complete")))


def one_fact(spark: SparkSession, folder: str) -> DataFrame:
    """The fact with the most relationships, looked up by its id, with them, the surest first."""
    s = Store(spark, folder)
    r = store.oriented(s.relationships.select("id", "fact_a_id", "fact_b_id", "relation_type", "reason_tag", "confidence", "similarity_score"))
    top = r.join(s.facts.select(F.col("id").alias("fact_id")), "fact_id", "left_semi").groupBy("fact_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fact_id").first()
    wanted = top.fact_id if top else ""
    fact = s.details.where(F.col("id") == wanted).select(F.col("id").alias("fact_id"), "document", "attribute", "value", "quote")
    other = s.facts.select(F.col("id").alias("other_id"), F.col("canonical_text").alias("other_text"))
    d = fact.join(r.where(F.col("fact_id") == wanted), "fact_id").join(other, "other_id", "left")
    return d.orderBy(F.desc_nulls_last("confidence"), F.desc_nulls_last("similarity_score"), "id").select("fact_id", "document", "attribute", "value", "quote", "id", "other_id", "relation_type", "confidence", "other_text")


def relationship_totals(spark: SparkSession, folder: str) -> DataFrame:
    """How many relationships a filter keeps, beside the counts by type over all rows."""
    s = Store(spark, folder)
    kept = store.relation_filter(s.relationships).agg(F.count("*").alias("total"))
    return s.relationships.groupBy("relation_type").agg(F.count("*").alias("n")).crossJoin(kept)


def list_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Extraction as a job of every document: its progress and status, the latest first."""
    s = Store(spark, folder)
    tried = s.progress.join(s.chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id")
    n = tried.groupBy("document_id").agg(F.count("*").alias("tried"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("facts").alias("facts"), F.max("processed_at").alias("updated_at"))
    total = s.chunks.where("role = 'extraction'").groupBy("document_id").agg(F.count("*").alias("chunks"))
    d = total.join(n, "document_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tried", "failed", "facts")})
    status = F.when(F.col("tried") == 0, "queued").when(F.col("failed") > 0, "failed").when(F.col("tried") < F.col("chunks"), "running").otherwise("done")
    return d.withColumn("status", status).orderBy(F.desc_nulls_last("updated_at"), "document_id").limit(20).select("document_id", "status", "chunks", "tried", "failed", "facts", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def best_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates of a dry run of linking, the most alike first."""
    return link_candidates(spark, folder).orderBy(F.desc("similarity"), "fact_a_id", "fact_b_id").limit(20)


def similar_facts(spark: SparkSession, folder: str) -> DataFrame:
    """V3: the six nearest facts of every fact whose number is divisible by 50, by exact search."""
    v = cut(_vectors(spark, folder).select("fact_id", "vector"), "vectors")
    asked = v.where(F.conv(F.right("fact_id", F.lit(4)), 16, 10).cast("int") % 50 == 0)
    return vectors.search(asked, v, DEFAULTS.candidate_top_k).select("query_id", "fact_id", "rank", F.round("cosine", 6).alias("cosine"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    store_counts, list_documents, delete_document, list_facts, fact_details, fact_relationships, list_fact_types, list_relationships, relation_counts, match_modes, showcase, failure_report, barren_chunks, rebuilt_spans,
    evidence_context, pending_round_robin, runtime_estimate, browse_facts, browse_relations, browse_chunks, unembedded_facts, derived_status, vector_pairs, link_candidates, unit_vectors,
    recent_documents, document_pages, document_chunks, repair_samples, showcase_totals, one_fact, relationship_totals, list_jobs, best_candidates, similar_facts,
)}

_ONCE = ", ".join(f"{n}1 as (select distinct * from {n})" for n in ("pages", "chunks", "facts", "evidence", "relationships", "fact_embeddings"))
_STORE = f"""with {_ONCE},
 progress as (select c.id as chunk_id, case when d.status = 'extracted' and coalesce(n.facts, 0) = 0 then 'failed' else 'done' end as status, coalesce(n.facts, 0) as facts, n.processed_at
   from chunks1 c join doc_register d on d.id = c.document_id and d.status <> 'parsed' left join (select chunk_id, count(*) as facts, max(created_at) as processed_at from facts1 group by 1) n on n.chunk_id = c.id where c.role = 'extraction'),
 repairs as (select chunk_id, case w when 3 then 'failed' when 2 then 'ok_after_repair' else 'ok_after_reprompt' end as outcome from (select chunk_id, max(case when match_mode is null then 3 when match_mode = 'reconstructed_span' then 2 when match_mode = 'normalised_chars' then 1 else 0 end) as w from evidence1 group by 1) where w > 0),
 ev as (select distinct on (fact_id) * from evidence1 where fact_id is not null order by fact_id, id)"""
_COUNTED = ["documents", "pages", "chunks", "facts", "evidence", "relationships", "fact_embeddings"]
_PENDING = "select c.id, c.document_id, row_number() over (partition by c.document_id order by c.ordinal, c.id) as doc_rank from chunks1 c join doc_register d on d.id = c.document_id where c.role = 'extraction' and c.numeric_density >= 0.02 and not exists (select 1 from progress p where p.chunk_id = c.id and p.status = 'done')"
_DETAILS = f"""select f.id, f.document_id, d.filename as document, d.title as document_title, {', '.join(f"{q.field(k, 'f.payload_json')} as {k}" for k in ('subject', 'value', 'time_scope', 'qualifier'))}, {q.field('unit', 'f.payload_json')} as stated_unit, {q.attribute('f.payload_json')} as attribute,
 f.fact_type, f.value_num, f.unit as normalised_unit, f.confidence, f.extractor, e.quote, e.pdf_page_index, e.printed_page_label, coalesce(nullif(e.printed_page_label, ''), 'pdf#' || coalesce(e.pdf_page_index::varchar, 'None')) as page_label, e.match_mode, e.quote_char_start, e.quote_char_end
 from facts1 f join doc_register d on d.id = f.document_id left join ev e on e.fact_id = f.id"""
_FINE = "(select * from fact_embeddings1 where model = 'encoder-s64' and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0)"
_ALIKE = f"""v0 as (select e.fact_id, f.document_id, e.vector::double[] as v from {_FINE} e join facts1 f on f.id = e.fact_id),
 v1 as (select fact_id, document_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from v0),
 s as (select a.fact_id as qid, b.fact_id as pid, list_dot_product(a.v, b.v) as sim from v1 a join v1 b on a.document_id <> b.document_id),
 k as (select *, row_number() over (partition by qid order by sim desc, pid) as r from s where sim >= 0.82),
 alike as (select least(qid, pid) as fact_a_id, greatest(qid, pid) as fact_b_id, round(max(sim), 6) as similarity from k where r <= 6 group by 1, 2)"""
_GONE = "gone as (select document_id as id from facts1 group by 1 order by count(*) desc, 1 limit 1), lost as (select id from facts1 where document_id in (select id from gone))"

_SHOWN = f"""{_STORE}, det as ({_DETAILS}),
 j as (select r.*, a.quote as qa, b.quote as qb, a.match_mode as ma, b.match_mode as mb, a.printed_page_label as la, b.printed_page_label as lb from relationships1 r join det a on a.id = r.fact_a_id join det b on b.id = r.fact_b_id
   where r.relation_type in ('CORROBORATES', 'CONTRADICTS', 'CONTEXT_RECONCILED') and r.cross_document = 1 and a.document_id <> b.document_id and coalesce(trim(r.explanation, ' '), '') <> ''),
 n as (select *, row_number() over (partition by relation_type order by confidence desc nulls last, similarity_score desc nulls last, id) as n from j),
 m as (select *, least(length(qa), length(qb)) as shorter, case when least(length(qa), length(qb)) >= 30 then 1 else 0 end as substantial, (case when ma = 'reconstructed_span' then 1 else 0 end) + (case when mb = 'reconstructed_span' then 1 else 0 end) as rebuilt, (case when coalesce(la, '') <> '' then 1 else 0 end) + (case when coalesce(lb, '') <> '' then 1 else 0 end) as labelled from n where n <= 15 and coalesce(qa, '') <> '' and coalesce(qb, '') <> ''),
 r as (select *, row_number() over (partition by relation_type order by substantial desc, rebuilt, labelled desc, shorter desc, confidence desc nulls last, similarity_score desc nulls last, id) as rank from m)"""

SQL: dict[str, str] = {
    "store_counts": _STORE + " " + " union all ".join(f"select '{n}' as name, count(*) as rows from {'doc_register' if n == 'documents' else n + '1'}" for n in _COUNTED),
    "list_documents": f"""{_STORE} select d.id, d.filename, d.status, (select count(*) from facts1 f where f.document_id = d.id) as fact_count, (select count(*) from chunks1 c where c.document_id = d.id and c.role = 'extraction') as chunk_count,
 (select count(*) from progress p join chunks1 c on c.id = p.chunk_id where c.document_id = d.id) as chunks_done, try_cast(meta_json ->> '$.printed_label_coverage' as double) as label_coverage, try_cast(meta_json ->> '$.probably_scanned' as boolean) as scanned, try_cast(meta_json ->> '$.detected_tables' as bigint) as tables from doc_register d""",
    "delete_document": f"""{_STORE}, {_GONE} select 'documents' as name, count(*) as rows from doc_register where id not in (select id from gone) union all """ + " union all ".join(f"select '{n}', count(*) from {n}1 where document_id not in (select id from gone)" for n in ("pages", "chunks", "facts", "evidence")) + " union all select 'relationships', count(*) from relationships1 r where not exists (select 1 from lost where id = r.fact_a_id) and not exists (select 1 from lost where id = r.fact_b_id) union all select 'fact_embeddings', count(*) from fact_embeddings1 e where not exists (select 1 from lost where id = e.fact_id)",
    "list_facts": f"{_STORE}, h as (select * from facts1 where confidence >= 0.6 and value_num is not null and (contains(lower(canonical_text), 'revenue') or contains(lower(payload_json), 'revenue'))) select id, confidence, value_num, canonical_text, (select count(*) from h) as total from h order by confidence desc, id limit 50 offset 10",
    "fact_details": f"{_STORE} {_DETAILS}",
    "fact_relationships": f"""{_STORE}, o as (select fact_a_id as fact_id, fact_b_id as other_id, * from relationships1 union all select fact_b_id, fact_a_id, * from relationships1 where fact_a_id is distinct from fact_b_id)
 select f.id as fact_id, o.id, o.other_id, o.relation_type, o.reason_tag, o.confidence, x.canonical_text as other_text from facts1 f join o on o.fact_id = f.id left join facts1 x on x.id = o.other_id""",
    "list_fact_types": f"{_STORE}, t as (select fact_type, arg_min(document_id, (created_at, id)) as document_id, count(*) as fact_count from facts1 where fact_type is not null group by 1) select fact_type, fact_count, d.filename as first_seen_document from t left join doc_register d on d.id = t.document_id",
    "list_relationships": f"""{_STORE}, p as (select * from relationships1 where relation_type <> 'UNRELATED' order by confidence desc nulls last, similarity_score desc nulls last, id limit 50 offset 20)
 select p.id, p.relation_type, p.reason_tag, p.confidence, p.similarity_score, a.canonical_text as text_a, b.canonical_text as text_b from p left join facts1 a on a.id = p.fact_a_id left join facts1 b on b.id = p.fact_b_id""",
    "relation_counts": f"{_STORE} select relation_type, count(*) as n from relationships1 group by 1",
    "match_modes": f"{_STORE} select match_mode, count(*) as n from evidence1 group by 1",
    "showcase": f"""{_SHOWN} select relation_type, rank, id, fact_a_id, fact_b_id, reason_tag, confidence, similarity_score, substantial, rebuilt, labelled, shorter from r where rank <= 3""",
    "failure_report": f"""{_STORE}, l as (select count(distinct chunk_id) filter (outcome = 'ok_after_reprompt') + count(distinct chunk_id) filter (outcome = 'ok_after_repair') as repaired, count(distinct chunk_id) filter (outcome = 'failed') as json_failed from repairs where chunk_id in (select chunk_id from progress)),
 p as (select count(*) as attempted, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'done' and facts = 0) as barren from progress)
 select attempted, failed, barren, repaired + json_failed as needing_repair, round(repaired / greatest(attempted, 1), 6) as repair_rate, round(json_failed / greatest(attempted, 1), 6) as failure_rate from p, l""",
    "barren_chunks": f"{_STORE} select p.chunk_id, c.printed_page_label, substr(c.text, 1, 500) as text from progress p join chunks1 c on c.id = p.chunk_id where p.status = 'done' and p.facts = 0 order by p.processed_at desc nulls last, p.chunk_id limit 10",
    "rebuilt_spans": f"{_STORE} select e.id, e.fact_id, f.canonical_text, d.filename, substr(e.quote, 1, 400) as stored_span from evidence1 e join facts1 f on f.id = e.fact_id join doc_register d on d.id = e.document_id where e.match_mode = 'reconstructed_span' order by length(e.quote) desc nulls last, e.id limit 10",
    "evidence_context": f"""{_STORE}, j as (select e.*, p.text, d.filename, quote_char_start as s, quote_char_end as z from evidence1 e join chunks1 c on c.id = e.chunk_id join pages1 p on p.id = c.page_id join doc_register d on d.id = e.document_id)
 select id, filename, md5(substr(text, greatest(s - 400, 0) + 1, s - greatest(s - 400, 0))) as before_md5, substr(text, s + 1, z - s) as highlight, md5(substr(text, z + 1, least(z + 400, length(text)) - z)) as after_md5, substr(text, s + 1, z - s) = quote as offsets_verified from j""",
    "pending_round_robin": f"{_STORE} {_PENDING}",
    "runtime_estimate": f"{_STORE} select count(*) as chunks, round(count(*) * 0.02 / 4, 6) as seconds from ({_PENDING})",
    "browse_facts": f"{_STORE} select f.id, d.filename, f.fact_type, f.value_num, e.match_mode, e.quote from facts1 f join evidence1 e on e.fact_id = f.id join doc_register d on d.id = f.document_id where contains(lower(d.filename), 'report') and contains(lower(f.fact_type), 'margin') and f.value_num is not null",
    "browse_relations": f"{_STORE} select r.id, r.reason_tag, r.confidence, a.canonical_text as text_a, b.canonical_text as text_b from relationships1 r left join facts1 a on a.id = r.fact_a_id left join facts1 b on b.id = r.fact_b_id where r.relation_type = 'CONTRADICTS'",
    "browse_chunks": f"""{_STORE} select c.id, c.role, c.ordinal, coalesce(nullif({q.strip("coalesce(d.title, '')")}, ''), d.filename) as name, p.printed_page_label as page_printed, substr(c.text, 1, 160) as head from chunks1 c join doc_register d on d.id = c.document_id join pages1 p on p.id = c.page_id""",
    "unembedded_facts": f"{_STORE} select id from facts1 where canonical_text is not null and id not in (select fact_id from fact_embeddings1)",
    "derived_status": f"""{_STORE}, l as (select fact_a_id as id from relationships1 union select fact_b_id from relationships1) select d.id, case when exists (select 1 from facts1 f join l on l.id = f.id where f.document_id = d.id) then 'linked' when exists (select 1 from facts1 f where f.document_id = d.id) then 'extracted' else 'parsed' end as derived_status from doc_register d""",
    "vector_pairs": f"{_STORE}, {_ALIKE} select * from alike",
    "link_candidates": f"{_STORE}, {_ALIKE} select * from alike a where not exists (select 1 from relationships1 r where least(r.fact_a_id, r.fact_b_id) = a.fact_a_id and greatest(r.fact_a_id, r.fact_b_id) = a.fact_b_id)",
    "unit_vectors": f"{_STORE}, v as (select e.fact_id, e.vector::double[] as v from {_FINE} e join facts1 f on f.id = e.fact_id), u as (select *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from v) select fact_id, round(list_dot_product(v, v), 4) as square, round(list_dot_product(u, u), 6) as unit_square from u",
    "recent_documents": "select id, filename, status, ingested_at from doc_register order by ingested_at desc nulls last, id limit 30 offset 5",
    "document_pages": f"{_STORE} select p.id, d.filename, p.pdf_page_index, p.printed_page_label, substr(p.text, 1, 1000) as head from pages1 p join doc_register d on d.id = p.document_id where contains(lower(d.filename), 'report') order by p.document_id, p.pdf_page_index nulls first, p.id limit 100",
    "document_chunks": f"{_STORE} select c.id, c.ordinal, c.char_start, c.char_end, substr(c.text, 1, 220) as head from chunks1 c where c.role = 'extraction' and c.document_id in (select id from doc_register order by id limit 3) order by c.document_id, c.ordinal nulls first, c.id limit 60",
    "repair_samples": f"{_STORE} select r.chunk_id, c.document_id, r.outcome, substr(c.text, 1, 2000) as text from repairs r join chunks1 c on c.id = r.chunk_id where r.outcome in ('failed', 'ok_after_repair') order by r.chunk_id desc limit 10",
    "showcase_totals": f"""{_SHOWN}, sh as (select relation_type, count(*) as examples from r where rank <= 3 group by 1),
 t as (select relation_type, count(*) as total, count(*) filter (cross_document = 1) as across, count(*) filter (cross_document = 1 and coalesce(trim(explanation, ' '), '') <> '') as explained from relationships1 where relation_type in ('CORROBORATES', 'CONTRADICTS', 'CONTEXT_RECONCILED') group by 1),
 u as (select t.*, coalesce(sh.examples, 0) as examples from t left join sh using (relation_type))
 select *, (select count(*) filter (examples > 0) = 3 from u) as complete from u""",
    "one_fact": f"""{_STORE}, det as ({_DETAILS}), o as (select fact_a_id as fact_id, fact_b_id as other_id, * exclude (fact_a_id, fact_b_id) from relationships1 union all select fact_b_id, fact_a_id, * exclude (fact_a_id, fact_b_id) from relationships1 where fact_a_id is distinct from fact_b_id),
 top as (select fact_id from o where fact_id in (select id from facts1) group by 1 order by count(*) desc, 1 limit 1)
 select f.id as fact_id, f.document, f.attribute, f.value, f.quote, o.id, o.other_id, o.relation_type, o.confidence, x.canonical_text as other_text from det f join top on top.fact_id = f.id join o on o.fact_id = f.id left join facts1 x on x.id = o.other_id""",
    "relationship_totals": f"{_STORE} select relation_type, count(*) as n, (select count(*) from relationships1 where relation_type <> 'UNRELATED') as total from relationships1 group by 1",
    "list_jobs": f"""{_STORE}, t as (select c.document_id, count(*) as tried, count(*) filter (p.status = 'failed') as failed, sum(p.facts)::bigint as facts, max(p.processed_at) as updated_at from progress p join chunks1 c on c.id = p.chunk_id group by 1),
 n as (select document_id, count(*) as chunks from chunks1 where role = 'extraction' group by 1)
 select document_id, case when coalesce(tried, 0) = 0 then 'queued' when failed > 0 then 'failed' when tried < chunks then 'running' else 'done' end as status, chunks, coalesce(tried, 0) as tried, coalesce(failed, 0) as failed, coalesce(facts, 0) as facts, strftime(updated_at, '%Y-%m-%d %H:%M:%S') as updated_at
 from n left join t using (document_id) order by t.updated_at desc nulls last, document_id limit 20""",
    "best_candidates": f"{_STORE}, {_ALIKE} select * from alike a where not exists (select 1 from relationships1 r where least(r.fact_a_id, r.fact_b_id) = a.fact_a_id and greatest(r.fact_a_id, r.fact_b_id) = a.fact_b_id) order by similarity desc, fact_a_id, fact_b_id limit 20",
    "similar_facts": f"""{_STORE}, v0 as (select e.fact_id, e.vector::double[] as v from {_FINE} e join facts1 f on f.id = e.fact_id), v1 as (select fact_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from v0),
 s as (select a.fact_id as query_id, b.fact_id, list_dot_product(a.v, b.v) as cosine from v1 a join v1 b on a.fact_id <> b.fact_id where ('0x' || right(a.fact_id, 4))::int % 50 = 0),
 k as (select *, row_number() over (partition by query_id order by cosine desc, fact_id) as rank from s where cosine >= 0) select query_id, fact_id, rank, round(cosine, 6) as cosine from k where rank <= 6""",
}
