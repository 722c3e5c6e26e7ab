"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundstone.functions.text import WORD
from groundstone.llm import components, glyphs, languages, leaks, neighbours, packing, pieces, records
from groundstone.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that are copies: the smallest id of the set and the copy's own."""
    found = records.copy_groups(table(spark, folder, "facts"))
    return found.where("id != first_id").select("first_id", F.col("id").alias("copy_id"))


def p1_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    return records.distinct_records(table(spark, folder, "facts"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Facts joined by corroboration: the smallest id of the group and the fact's own."""
    links = components.corroborating(table(spark, folder, "relationships"), table(spark, folder, "facts"))
    return components.components(links, "fact_a_id", "fact_b_id").where("id != first_id").select("first_id", F.col("id").alias("fact_id"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every fact with its group."""
    return components.fact_groups(table(spark, folder, "relationships"), table(spark, folder, "facts"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence whose quote looks like its page's text but is coded differently."""
    return glyphs.coded_differently(table(spark, folder, "evidence"), table(spark, folder, "pages"))


def p5_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Every quote in one form."""
    return table(spark, folder, "evidence").select("id", glyphs.folded("quote").alias("quote")).dropDuplicates(["id"])


def p5_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's text in one form."""
    return table(spark, folder, "pages").select("id", glyphs.folded("text").alias("text")).dropDuplicates(["id"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of facts of cosine 0.82 or more, one among the other's five nearest."""
    near = neighbours.nearest(table(spark, folder, "fact_embeddings"), 5, floor=0.82)
    return near.select(F.least("fact_id", "other_id").alias("fact_a_id"), F.greatest("fact_id", "other_id").alias("fact_b_id")).distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every fact whose id is divisible by 50, among all facts."""
    return neighbours.nearest(table(spark, folder, "fact_embeddings"), 5, every=50)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Long pages whose stored pieces aren't a sound cut."""
    return pieces.unsound_pages(table(spark, folder, "pages"), table(spark, folder, "chunks"))


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every long page in pieces."""
    return pieces.pieces_of(table(spark, folder, "pages")).select("page_id", "ordinal", "char_start", "char_end")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text."""
    return packing.containers(table(spark, folder, "documents"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.fill(packing.containers(table(spark, folder, "documents")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share at least 15 words in a row with a test item."""
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("item_id", "doc_id")


def p9_near(spark: SparkSession, folder: str) -> DataFrame:
    """Test items and documents with a near copy of a passage: windows of shingle similarity 0.8."""
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), least=leaks.SIMILAR)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose language label is missing or wrong or that hold several languages."""
    docs = table(spark, folder, "documents")
    return languages.mislabelled(languages.labels(docs, languages.fit(docs, table(spark, folder, "lang_checked"))))


def p10_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language with a confidence."""
    docs = table(spark, folder, "documents")
    return languages.labels(docs, languages.fit(docs, table(spark, folder, "lang_checked"))).drop("old_code")


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch in one language with a confidence."""
    docs = table(spark, folder, "documents")
    return languages.segments(docs, languages.fit(docs, table(spark, folder, "lang_checked")))


_ALL = (
    p1_found, p1_distinct, p2_found, p2_groups, p4_found, p4_neighbours, p5_found, p5_quotes, p5_pages, p6_found, p6_pieces,
    p8_containers, p8_fill, p9_found, p9_near, p10_found, p10_documents, p10_segments,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_GROUPS = """with recursive f as (select distinct id from facts),
 e as (select distinct fact_a_id as a, fact_b_id as b from relationships where regexp_replace(upper(relation_type), '[^A-Z]', '', 'g') = 'CORROBORATES' and fact_a_id <> fact_b_id and fact_a_id in (from f) and fact_b_id in (from f)),
 n as (select a, b from e union select b, a from e),
 r(id, seen) as (select a, a from n union select n.b, r.seen from r join n on n.a = r.id),
 g as (select id, min(seen) as first_id from r group by 1)"""

SQL: dict[str, str] = {
    "p2_found": f"{_GROUPS} select first_id, id as fact_id from g where id <> first_id",
    "p2_groups": f"{_GROUPS} select f.id as fact_id, coalesce(g.first_id, f.id) as group_id from f left join g using (id)",
    "p6_found": f"""with p as (select distinct id as page_id, text from pages where length(text) > 1200 and id is not null),
 c as (select distinct coalesce(id, '?') as chunk_id, page_id, coalesce(ordinal, 0) as ordinal, char_start as s, char_end as e from chunks where role = 'retrieval' and char_start is not null and char_end is not null),
 j as (select p.page_id, p.text, s, e, lag(s) over w as ps, lag(e) over w as pe, coalesce(max(e) over (partition by p.page_id order by s, e rows between unbounded preceding and 1 preceding), 0) as reach from p join c using (page_id) window w as (partition by p.page_id order by ordinal, chunk_id)),
 x as (select page_id, text, unnest([s, e]) as spot from j),
 r as (select page_id, length(regexp_extract(substr(text, 1, spot), '{WORD}$')) as a, length(regexp_extract(substr(text, spot + 1), '^{WORD}')) as b from x)
 select page_id from p where page_id not in (select page_id from c where page_id is not null)
 union select page_id from j where e - s > 1200 or (ps is not null and least(e, pe) - greatest(s, ps) not between 100 and 220) or (s > reach and regexp_matches(substr(text, reach + 1, s - reach), '{WORD}'))
 union select page_id from (select page_id, text, max(e) as z from j group by 1, 2) where z < length(text) and regexp_matches(substr(text, z + 1), '{WORD}')
 union select page_id from r where a > 0 and b > 0 and a + b <= 1200""",
}
