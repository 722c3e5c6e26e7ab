"""The whole run over a store of parquet tables: ingest files, extract facts, link them.

Every step is incremental and idempotent: it anti-joins what the store has, computes the rest in one
plan and appends it.  A step that is run again after a failure does what is left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundstone.functions import identity
from groundstone.operators import chunking, facts as fact_ops, incremental, pages as page_ops, proposer, relate, vectors
from groundstone.options import DEFAULTS, Options
from groundstone.session import cut, scratch
from groundstone.sources import files, models
from groundstone.streaming.streams import _maybe

Proposer = Callable[[DataFrame], DataFrame]


class Run:
    """A store at ``path``; parser, proposer and embedder are the caller's or the defaults."""

    def __init__(self, spark: SparkSession, path: str, options: Options = DEFAULTS, parser: files.Parser = files.plain_text, propose: Proposer = proposer.proposed, embedder: models.Embedder = models.hashed_ngrams):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.parser, self.propose, self.embedder = parser, propose, embedder

    def table(self, name: str) -> DataFrame | None:
        return _maybe(self.spark, f"{self.path}/{name}")

    def _append(self, name: str, rows: DataFrame, *keys: str) -> None:
        """Rows whose keys the table doesn't have; written aside first, so that the plan runs once."""
        old = self.table(name)
        new = rows if old is None else rows.join(old.select(*keys), list(keys), "left_anti")
        cut(new, name).write.mode("append").parquet(f"{self.path}/{name}")

    def _upsert(self, name: str, rows: DataFrame, keys: list[str], keep: list[str] | None = None) -> None:
        """Rows put in by key; columns in ``keep`` stay as they were."""
        old = self.table(name)
        if old is None:
            cut(rows, name).write.mode("append").parquet(f"{self.path}/{name}")
        else:
            incremental.replaced(incremental.upserted(old, cut(rows, name), keys, keep), f"{self.path}/{name}")

    @contextmanager
    def job(self, kind: str) -> Iterator[dict]:
        """A row in ``jobs`` when a step begins and another when it is done or failed; what the step
        puts into the dictionary is the last row's detail.  Its cuts go with it."""
        name, detail = f"job_{uuid.uuid4().hex[:12]}", {}

        def said(status: str, text: str | None) -> None:
            row = self.spark.createDataFrame([(name, kind, status, text)], "id string, kind string, status string, detail string")
            row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/jobs")

        said("running", None)
        try:
            with scratch(self.spark):
                yield detail
        except BaseException as e:
            said("failed", str(e)[:300])
            raise
        said("done", json.dumps(detail, sort_keys=True))

    def jobs(self, limit: int = 20) -> DataFrame:
        """The latest jobs: id, kind, status, when they started and when they last said something."""
        rows = self.table("jobs")
        last = F.struct(F.when(F.col("status") == "running", 0).otherwise(1), "at")
        found = rows.groupBy("id", "kind").agg(F.max_by("status", last).alias("status"), F.max_by("detail", last).alias("detail"), F.min("at").alias("started_at"), F.max("at").alias("updated_at"))
        return found.orderBy(F.desc("started_at"), "id").limit(limit)

    def delete(self, gone: DataFrame) -> None:
        """Documents (id) and all that belongs to them; the documents go last, so that a delete that was
        broken off is found and done again."""
        tables = {n: t for n in ("documents", "pages", "chunks", "facts", "evidence", "relationships", "fact_embeddings", "progress") if (t := self.table(n)) is not None}
        if "documents" not in tables:
            return
        gone = cut(gone.select("id").distinct(), "gone")
        known = tables if "facts" in tables else tables | {"facts": self.spark.createDataFrame([], "id string, document_id string")}
        left = incremental.without_documents(known, gone)
        if "progress" in tables and "chunks" in tables:
            chunks = tables["chunks"].join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_semi")
            left["progress"] = tables["progress"].join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
        if (linked := self.table("linked")) is not None:
            tables["linked"] = linked
            lost = known["facts"].join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_semi")
            left["linked"] = linked.join(lost.select(F.col("id").alias("fact_id")), "fact_id", "left_anti")
        for name in ("linked", "relationships", "fact_embeddings", "evidence", "facts", "progress", "chunks", "pages", "documents"):
            if name in tables and name in left:
                incremental.replaced(left[name], f"{self.path}/{name}")

    def ingest(self, root: str, dataset: str = "all", suffix: str = ".txt", force: bool = False) -> None:
        """New files become documents with labelled pages and chunks.

        Known content is skipped, unless an older parser read it or ``force`` asks for it again: such
        documents go with all that belongs to them and come anew.
        """
        with self.job("ingest") as detail:
            found = files.identified(files.discover(self.spark, root, dataset, suffix)).dropDuplicates(["id"])
            known = self.table("documents")
            known = known.select("content_sha256", "parser_version") if known is not None else self.spark.createDataFrame([], "content_sha256 string, parser_version string")
            plan = cut(incremental.ingest_plan(found, known, self.options, force), "plan")
            detail.update({r.action: r["count"] for r in plan.groupBy("action").count().collect()})
            if detail.keys() & {"stale", "force"}:
                self.delete(plan.where("action in ('stale', 'force')"))
            found = found.join(plan.where("action != 'skip'").select("id"), "id", "left_semi")
            pages = cut(files.parsed(found, self.parser), "pages").withColumn("printed_page_label", F.lit(None).cast("string"))
            labels = page_ops.page_labels(pages).select("id", "label")
            pages = cut(pages.join(labels, "id").withColumn("printed_page_label", F.col("label")).drop("label"), "labelled")
            chunks = chunking.extraction_chunks(pages, self.options).unionByName(chunking.retrieval_windows(pages, self.options))
            self._append("pages", pages, "id")
            self._append("chunks", chunks, "id")
            # the document comes last: it says that its pages and chunks are whole
            self._append("documents", found.drop("content").withColumn("parser_version", F.lit(self.options.parser_version)), "id")

    def extract(self, document: str | None = None, limit: int | None = None, redo: bool = False) -> None:
        """Pending chunks, interleaved over documents, become facts with evidence.

        Failed chunks come again, with ``redo`` all of them (of ``document``).  A proposer may give an
        ``outcome``: chunks with ``failed`` are tried again next time.
        """
        with self.job("extract") as detail:
            none = self.spark.createDataFrame([], "chunk_id string, status string, facts bigint")
            progress = self.table("progress")
            documents, chunks = self.table("documents"), self.table("chunks")
            todo = incremental.pending(chunks, documents, none if redo or progress is None else progress, self.options, document, ordered=limit is not None)
            todo = cut(todo.limit(limit) if limit is not None else todo, "pending")
            proposed = self.propose(todo.select("id", "text", F.col("document_title").alias("title")))
            failed = none.select("chunk_id")
            if "outcome" in proposed.columns:
                proposed = cut(proposed, "proposed")
                failed = proposed.where("outcome = 'failed'").select("chunk_id").distinct()
                proposed = proposed.where("outcome is distinct from 'failed'").drop("outcome")
            known = self.table("facts")
            done = cut(fact_ops.stored(proposed, chunks, self.table("pages"), None if known is None else known.select("id"), self.options), "outcomes")
            new = done.where("outcome = 'stored'").withColumn("created_at", F.current_timestamp())
            self._append("evidence", new.select(identity.evidence_id(F.col("id")).alias("id"), F.col("id").alias("fact_id"), "document_id", "chunk_id", "pdf_page_index", "printed_page_label", "quote", "quote_char_start", "quote_char_end", "match_mode"), "id")
            body = F.to_json(F.create_map(*[x for c in ("subject", "attribute", "value", "unit", "time_scope") for x in (F.lit(c), F.col(c))], F.lit("confidence"), F.col("confidence").cast("string"), F.lit("source_quote"), F.col("quote")))
            self._append("facts", new.select("id", "document_id", "chunk_id", body.alias("payload_json"), "fact_type", "canonical_key", "canonical_text", "value_num", F.col("norm_unit").alias("unit"), "time_scope", "confidence", "created_at"), "id")
            held = self.table("facts").groupBy("chunk_id").agg(F.count("*").alias("facts"))
            ran = todo.select(F.col("id").alias("chunk_id")).join(failed.withColumn("status", F.lit("failed")), "chunk_id", "left")
            ran = ran.join(held, "chunk_id", "left").select("chunk_id", F.coalesce("status", F.lit("done")).alias("status"), F.coalesce("facts", F.lit(0)).cast("bigint").alias("facts"))
            self._upsert("progress", ran, ["chunk_id"])
            detail.update({r.outcome: r["count"] for r in done.groupBy("outcome").count().collect()}, chunks=todo.count())

    def candidates(self, fresh: DataFrame | None = None, limit: int | None = None) -> DataFrame:
        """Pairs of facts across documents that are alike and not related yet, the most alike first;
        with ``fresh`` (fact_id) those that have such a fact."""
        facts = self.table("facts")
        v = self.table("fact_embeddings").join(facts.select(F.col("id").alias("fact_id"), "document_id"), "fact_id")
        pairs = vectors.cross_document_pairs(v.where("exists(vector, x -> x != 0)"), self.options, fresh)
        old = self.table("relationships")
        pairs = pairs if old is None else incremental.new_pairs(pairs, old)
        return pairs if limit is None else pairs.orderBy(F.desc("similarity"), "fact_a_id", "fact_b_id").limit(limit)

    def link(self, limit: int | None = None, again: bool = False) -> None:
        """New facts get vectors; pairs that are alike and not related yet get a relationship.

        Only new vectors are compared, with all; with ``again`` all with all, also those that are
        related, whose verdicts are renewed.
        """
        with self.job("link") as detail:
            facts, have = self.table("facts"), self.table("fact_embeddings")
            fresh = facts.where("canonical_text is not null") if have is None else incremental.unembedded(facts, have)
            fresh = cut(fresh.select(F.col("id").alias("fact_id"), models.embedded(F.col("canonical_text"), self.embedder).alias("vector")), "vectors")
            linked = self.table("linked")
            self._append("fact_embeddings", fresh, "fact_id")
            todo = self.table("fact_embeddings").select("fact_id")
            if linked is not None and not again:
                todo = todo.join(linked.select("fact_id"), "fact_id", "left_anti")
            todo = cut(todo, "unlinked")
            pairs = cut(self.candidates(None if again else todo, limit), "pairs")
            if again and (old := self.table("relationships")) is not None:
                pairs = cut(pairs.unionByName(old.select("fact_a_id", "fact_b_id", F.col("similarity_score").alias("similarity"))), "pairs")
            said = relate.classified(pairs.select("fact_a_id", "fact_b_id"), facts).where("status = 'ok'").drop("status")
            rows = said.join(pairs.withColumnRenamed("similarity", "similarity_score"), ["fact_a_id", "fact_b_id"])
            rows = rows.select(identity.relationship_id(F.col("fact_a_id"), F.col("fact_b_id")).alias("id"), "*", F.lit("rules").alias("model"), F.lit(1).alias("cross_document"), F.current_timestamp().alias("created_at"))
            self._upsert("relationships", rows, ["fact_a_id", "fact_b_id"], ["id", "created_at", "cross_document"])
            if limit is None:  # what a limit left out is compared again
                self._append("linked", todo, "fact_id")
            detail.update(vectors=fresh.count(), pairs=pairs.count())

    def reset(self) -> None:
        """Forget the whole store."""
        from groundstone.session import forget

        forget(self.spark, self.path)
