"""The whole run, twice, and what it left."""

import pytest

from groundstone.options import Options
from groundstone.plans.pipeline import Run

ONE = "101\nAcme Freight Ltd reported revenue of INR 8,142 crore in FY2025, ahead of plan and of the year before.\f102\nMargins at Acme Freight Ltd rose to 17.9 per cent in FY2025 although fuel was dearer than before."
TWO = "Acme Freight Ltd reported revenue of INR 81,420 million in FY2025, ahead of plan and of the year before."


@pytest.fixture
def landing(tmp_path):
    (tmp_path / "in/set").mkdir(parents=True)
    (tmp_path / "in/set/one.txt").write_text(ONE)
    (tmp_path / "in/set/two.txt").write_text(TWO)
    (tmp_path / "in/set/same.txt").write_text(TWO)
    return tmp_path


def test_run_is_idempotent_and_grounded(spark, landing):
    run = Run(spark, str(landing / "store"), Options(similarity_threshold=0.6))

    def counts():
        return {n: run.table(n).count() for n in ("documents", "pages", "chunks", "facts", "evidence", "progress", "fact_embeddings", "relationships")}

    for _ in range(2):
        run.ingest(str(landing / "in"))
        run.extract()
        run.link()
    first = counts()
    assert (first["documents"], first["pages"], first["facts"]) == (2, 3, 3) and first["evidence"] == first["fact_embeddings"] == 3
    assert [r.printed_page_label for r in run.table("pages").orderBy("char_count").collect()].count(None) == 1
    pages = {r.id: r.text for r in run.table("pages").collect()}
    page_of = {r.id: r.page_id for r in run.table("chunks").collect()}
    for e in run.table("evidence").collect():
        assert pages[page_of[e.chunk_id]][e.quote_char_start : e.quote_char_end] == e.quote
    r = run.table("relationships").collect()
    # the proposer's attributes are the words before the number, so only facts of equal words can agree
    assert r and len({(x.fact_a_id, x.fact_b_id) for x in r}) == len(r) and all(x.similarity_score >= 0.6 for x in r)
    (landing / "in/set/three.txt").write_text("Nothing of number here, only words that go on for long enough to be a chunk of their own.\nRevenue of Beta Ports Ltd was INR 5 crore.")
    run.ingest(str(landing / "in"))
    run.extract(limit=10)
    assert run.table("documents").count() == 3 and run.table("facts").count() >= 4
    run.reset()
    assert run.table("facts") is None


def test_stale_forced_and_redone(spark, landing):
    at, root = str(landing / "store"), str(landing / "in")
    run = Run(spark, at, Options(similarity_threshold=0.6))
    run.ingest(root)
    run.extract()
    run.link()
    n = {t: run.table(t).count() for t in ("documents", "pages", "chunks", "facts", "evidence", "relationships")}
    newer = Run(spark, at, Options(similarity_threshold=0.6, parser_version="2"))
    newer.ingest(root)
    assert newer.table("facts").count() == newer.table("relationships").count() == newer.table("progress").count() == 0
    assert {r.parser_version for r in newer.table("documents").collect()} == {"2"} and newer.table("pages").count() == n["pages"]
    newer.extract(limit=1)
    newer.extract()
    newer.extract(redo=True)
    assert newer.table("facts").count() == n["facts"] and newer.table("progress").groupBy("chunk_id").count().where("count > 1").count() == 0
    newer.ingest(root, force=True)
    assert newer.table("facts").count() == newer.table("linked").count() == 0
    newer.extract()
    newer.link(limit=1)
    assert newer.table("relationships").count() == min(1, n["relationships"])
    newer.link(again=True)
    assert {t: newer.table(t).count() for t in n} == n and newer.table("relationships").select("id").distinct().count() == n["relationships"]
    jobs = newer.jobs().collect()
    assert {(j.kind, j.status) for j in jobs} == {("ingest", "done"), ("extract", "done"), ("link", "done")} and len(jobs) == 11
    with pytest.raises(Exception):
        Run(spark, at, propose=lambda d: d.select("nothing")).extract(redo=True)
    assert newer.jobs(1).first().status == "failed"


def test_failed_chunks_come_again(spark, landing):
    from pyspark.sql import functions as F

    from groundstone.operators import proposer

    run = Run(spark, str(landing / "store"), propose=lambda d: proposer.proposed(d.where("id like 'x'")).withColumn("outcome", F.lit(None).cast("string")).unionByName(d.select(F.col("id").alias("chunk_id"), F.lit("failed").alias("outcome")), allowMissingColumns=True))
    run.ingest(str(landing / "in"))
    run.extract()
    assert {r.status for r in run.table("progress").collect()} == {"failed"} and run.table("facts").count() == 0
    Run(spark, str(landing / "store")).extract()
    assert {r.status for r in run.table("progress").collect()} == {"done"} and run.table("facts").count() == 3
