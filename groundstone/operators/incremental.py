"""Idempotent, resumable processing: what is new, what is pending, what a delete takes with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundstone.functions.identity import document_id
from groundstone.operators.ordinals import sums_before
from groundstone.options import DEFAULTS, Options
from groundstone.session import NEW, settled

#: Tables that belong to a document, with the column that says to which.
OWNED = {"pages": "document_id", "chunks": "document_id", "facts": "document_id", "evidence": "document_id"}


def ingest_plan(incoming: DataFrame, known: DataFrame, options: Options = DEFAULTS, force: bool = False) -> DataFrame:
    """content_sha256, id and action of every distinct incoming content: new, stale, skip or force.

    Content is known by its hash; known content is parsed again if its parser version is older, or on
    demand.  ``known``: content_sha256, parser_version.
    """
    seen = known.groupBy("content_sha256").agg(F.max("parser_version").alias("parser_version"))
    d = incoming.where("content_sha256 is not null").select("content_sha256").distinct().join(seen, "content_sha256", "left")
    action = F.when(F.col("parser_version").isNull(), "new").when(F.lit(force), "force").when(F.col("parser_version") != options.parser_version, "stale").otherwise("skip")
    return d.select("content_sha256", document_id(F.col("content_sha256")).alias("id"), action.alias("action"))


def pending(chunks: DataFrame, documents: DataFrame, progress: DataFrame, options: Options = DEFAULTS, document: str | None = None, ordered: bool = True) -> DataFrame:
    """Chunks still to be extracted, interleaved: the first of every document, then the second, and so on.

    Done chunks are left out, failed ones come again.  Ranks count pending rows only, in stretches,
    so a document of any size is no task of its own.  Without ``ordered`` the rows come unsorted.
    """
    todo = chunks.where((F.col("role") == "extraction") & (F.col("numeric_density") >= options.min_numeric_density))
    if document is not None:
        todo = todo.where(F.col("document_id") == document)
    done = progress.where("status = 'done'").select(F.col("chunk_id").alias("id"))
    todo = todo.join(done, "id", "left_anti").join(documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title")), "document_id")
    places = sums_before(todo.select("id", "document_id", "ordinal", F.lit(1).alias("n")), "document_id", "ordinal", "id", "n")
    todo = todo.join(places.select("id", (F.col("before") + 1).cast("int").alias("doc_rank")), "id")
    return todo.orderBy("doc_rank", "document_id") if ordered else todo


def unembedded(facts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Facts with a text that have no vector yet."""
    return facts.where("canonical_text is not null").join(embeddings.select(F.col("fact_id").alias("id")), "id", "left_anti")


def new_pairs(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidate pairs that aren't stored, whichever way round."""
    a, b = F.least("fact_a_id", "fact_b_id"), F.greatest("fact_a_id", "fact_b_id")
    return candidates.join(stored.select(a.alias("fact_a_id"), b.alias("fact_b_id")).distinct(), ["fact_a_id", "fact_b_id"], "left_anti")


def without_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The store after documents (id) are deleted, with everything that belongs to them.

    Pages, chunks, facts and evidence go with their document; relationships and vectors go with their
    facts.
    """
    ids = gone.select("id").distinct()
    out = {"documents": tables["documents"].join(ids, "id", "left_anti")}
    for name, owner in OWNED.items():
        if name in tables:
            out[name] = tables[name].join(ids.withColumnRenamed("id", owner), owner, "left_anti")
    lost = tables["facts"].join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_semi").select("id")
    if "relationships" in tables:
        out["relationships"] = tables["relationships"].join(lost.withColumnRenamed("id", "fact_a_id"), "fact_a_id", "left_anti").join(lost.withColumnRenamed("id", "fact_b_id"), "fact_b_id", "left_anti")
    if "fact_embeddings" in tables:
        out["fact_embeddings"] = tables["fact_embeddings"].join(lost.withColumnRenamed("id", "fact_id"), "fact_id", "left_anti")
    return out


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; columns in ``keep`` stay as they were."""
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
        new = new.join(before, keys, "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else c for c in new.columns])
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replaced(df: DataFrame, path: str) -> None:
    """Overwrite a parquet table that ``df`` may have been read from.

    The new table is whole before the old one moves: a crash leaves the old table, the new one or
    both beside the path, and ``session.settled`` puts the right one in place before the next use.
    """
    settled(df.sparkSession, path)
    df.write.mode("overwrite").parquet(path + NEW)
    settled(df.sparkSession, path)


def statuses(documents: DataFrame, facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """id and status derived from what a document has: linked, extracted or parsed."""
    has_fact = facts.select("document_id", "id").distinct()
    linked = relationships.select(F.col("fact_a_id").alias("id")).union(relationships.select("fact_b_id")).distinct()
    linked = has_fact.join(linked, "id", "left_semi").select("document_id").distinct().withColumn("l", F.lit(True))
    some = has_fact.select("document_id").distinct().withColumn("f", F.lit(True))
    d = documents.select("id").join(some.withColumnRenamed("document_id", "id"), "id", "left").join(linked.withColumnRenamed("document_id", "id"), "id", "left")
    return d.select("id", F.when(F.col("l"), "linked").when(F.col("f"), "extracted").otherwise("parsed").alias("derived_status"))
