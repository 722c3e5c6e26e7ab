"""Files, models, streams and the entry module."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from groundstone.operators.skew import heavy_keys, salted_join
from groundstone.session import cut, shared_dir
from groundstone.sources import files, models
from groundstone.streaming import streams

TINY = Path("/root/testdata/sf0.001")


@pytest.fixture
def landing(tmp_path):
    for name, text in (("alpha/one-report.txt", "page one\fpage two"), ("alpha/copy.txt", "page one\fpage two"), ("Beta_Set/two.txt", "x"), ("Beta_Set/skip.md", "y")):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path


def test_files(spark, landing, rows):
    found = files.discover(spark, str(landing / "in"), suffix=".txt")
    assert found.count() == 3
    assert files.discover(spark, str(landing / "in"), "beta", ".txt").count() == 1
    assert rows(files.datasets(spark, str(landing / "in"), ".txt")) == [("Beta_Set",), ("alpha",)]
    known = files.identified(found)
    assert rows(known.where("filename like 'one%'"), "title") == [("one report",)]
    assert files.parsed(known).count() == 3


def test_uploads_are_ingested_once(spark, landing, rows):
    run = lambda: streams.ingest_uploads(spark, str(landing / "in"), str(landing / "store"), str(landing / "cp")).awaitTermination()
    run()
    assert spark.read.parquet(str(landing / "store/pages")).count() == 3
    (landing / "in/alpha/third.txt").write_text("page one\fpage two")
    (landing / "in/alpha/fourth.txt").write_text("new")
    run()
    docs = spark.read.parquet(str(landing / "store/documents"))
    assert docs.count() == docs.select("content_sha256").distinct().count() == 3
    assert spark.read.parquet(str(landing / "store/pages")).count() == 4


def test_running_registry_equals_batch(spark, facts, tmp_path, rows):
    d = facts(("a", "{}", {"fact_type": "x"}), ("b", "{}", {"fact_type": "x"}), ("c", "{}", {"fact_type": "y"}), ("n", "{}", {"fact_type": None}))
    at = str(tmp_path)
    d.write.parquet(f"{at}/in")
    run = lambda: streams.running_registry(spark, f"{at}/in", d.schema, f"{at}/t", f"{at}/cp").awaitTermination()
    run()
    d.limit(2).unionByName(facts(("z", "{}", {"fact_type": "y"}))).write.mode("append").parquet(f"{at}/in")
    run()
    assert rows(streams.latest(spark, f"{at}/t"), "fact_type", "fact_count") == [("x", 2), ("y", 2)]


def test_windows_of_a_stream_equal_those_of_the_batch(spark, tmp_path, rows):
    import datetime as dt

    t = lambda day, hour: dt.datetime(2024, 1, day, hour)
    d = spark.createDataFrame([(1, t(1, 1), "a"), (2, t(1, 23), "a"), (3, t(2, 5), "b"), (4, t(3, 0), "a")], "event_id bigint, ts timestamp, event_type string")
    d.write.parquet(str(tmp_path / "in"))
    stream = streams.windowed_counts(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("windows")) == rows(streams.windowed_counts(d)) and len(rows(d)) == 4
    assert streams.progress(spark, q).count() >= 1


def test_embedder(spark):
    d = spark.createDataFrame([("revenue of Acme",), ("revenue of acme",), (None,), ("",)], "t string")
    v = [r.v for r in d.select(models.embedded(F.col("t")).alias("v")).collect()]
    assert v[2] is None and np.linalg.norm(v[0]) == pytest.approx(1, abs=1e-6) and v[0] == v[1]


def test_models(spark, rows):
    def make():
        def broken(_):
            raise RuntimeError

        seen = []
        return models.Chain([broken, lambda p: (seen.append(p), "[]" if p == "empty" else "no" if p == "never" or seen.count(p) == 1 else '[{"a": 1}]')[1]])

    d = spark.createDataFrame([("empty",), ("second",), ("never",)], "p string").coalesce(1)
    assert rows(models.asked(d, "p", make), "p", "outcome", "attempts") == [("empty", "ok_first_try", 1), ("never", "failed", 2), ("second", "ok_after_reprompt", 2)]
    with pytest.raises(RuntimeError):
        models.Chain([])("x")


def test_salted_join_equals_join(spark, monkeypatch, rows):
    import groundstone.operators.skew as skew

    monkeypatch.setattr(skew, "HEAVY_ROWS", 10)
    many = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), "id")
    one = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "k string, v int")
    heavy = heavy_keys(many.groupBy("k").agg(F.count("*").alias("n")), ["k"])
    assert rows(heavy) == [("hot",)]
    for how in ("inner", "left"):
        assert rows(salted_join(many, one, ["k"], F.col("id"), heavy, how), "k", "id", "v") == rows(many.join(one, "k", how), "k", "id", "v")


def test_cut_is_shared_and_whole(spark, rows):
    d = spark.range(5)
    assert rows(cut(d, "t")) == rows(d)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_entry_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p3_found", "p7_found", "normalize_value"} <= set(entry.queries())


@pytest.mark.skipif(not TINY.exists(), reason="no test tables here")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in TINY.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    flat = lambda v: None if v is None or v != v else float(f"{v:.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    queries, wrong = entry.queries(), []
    for name, sql in entry.oracle_sql().items():
        got = queries[name](spark, str(TINY))
        columns = sorted(got.columns)
        found = con.execute(sql)
        at = [[d[0] for d in found.description].index(c) for c in columns]
        a = sorted(([flat(r[c]) for c in columns] for r in got.collect()), key=repr)
        b = sorted(([flat(r[i]) for i in at] for r in found.fetchall()), key=repr)
        if a != b:
            wrong.append(name)
    assert not wrong


@pytest.mark.skipif(not TINY.exists(), reason="no test tables here")
def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert json.dumps(entry.entry(spark).schema.jsonValue())


def test_upload_that_failed_between_the_writes(spark, landing, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    whole, store = DataFrameWriter.parquet, str(landing / "store")

    def broken(self, path, *a, **k):
        if path == f"{store}/documents":
            raise OSError("lost")
        return whole(self, path, *a, **k)

    run = lambda: streams.ingest_uploads(spark, str(landing / "in"), store, str(landing / "cp")).awaitTermination()
    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", broken)
        with pytest.raises(Exception):
            run()
    assert spark.read.parquet(f"{store}/pages").count() == 3
    done = []
    streams.ingest_uploads(spark, str(landing / "in"), store, str(landing / "cp"), then=lambda: done.append(1)).awaitTermination()
    assert spark.read.parquet(f"{store}/pages").count() == 3 and spark.read.parquet(f"{store}/documents").count() == 2 and done


def test_replacement_that_was_broken_off(spark, tmp_path, rows):
    from groundstone.operators.incremental import replaced
    from groundstone.session import NEW, OLD, settled

    at = str(tmp_path / "t")
    spark.range(3).write.parquet(at)
    replaced(spark.read.parquet(at).where("id > 0"), at)
    assert rows(spark.read.parquet(at)) == [(1,), (2,)] and settled(spark, at)
    spark.range(9).write.parquet(at + NEW)  # whole, not moved yet
    (tmp_path / "t").rename(tmp_path / f"t{OLD}")
    assert settled(spark, at) and spark.read.parquet(at).count() == 9 and not (tmp_path / f"t{OLD}").exists()
    (tmp_path / f"t{NEW}").mkdir()  # broken off while it was written
    assert settled(spark, at) and spark.read.parquet(at).count() == 9 and not (tmp_path / f"t{NEW}").exists()
    assert not settled(spark, str(tmp_path / "none"))


def test_scratch_deletes_its_cuts(spark):
    from groundstone.session import scratch

    with scratch(spark):
        d = cut(spark.range(3), "inner")
        path = d.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        kept = cut(spark.range(2), "outer", keep=True)
        assert __import__("os").path.exists(path)
    assert not __import__("os").path.exists(path) and kept.count() == 2


def test_functions_in_sql(spark):
    from groundstone.functions import sql

    assert set(sql.register(spark)) == {*sql.SCALARS, *sql.TABLES}
    r = spark.sql("select gs_slug('The Net Profit') a, gs_period('FY 2024-25') b, gs_number('about 9.168,5 kg') c, gs_date('12/06/1971') d, gs_yes_no('Y') e, gs_number(null) f, gs_ground('Up from “last year”—a record', 'UP FROM \"LAST YEAR\"-A') g").first()
    assert (r.a, r.b, r.c, str(r.d), r.e, r.f, r.g.mode) == ("net_profit", "fy2025", 9168.5, "1971-06-12", True, None, "normalised_chars")
    assert [tuple(x) for x in spark.sql("select * from gs_spans('aaaa. bbbb. cc', 6)").collect()] == chunking_spans("aaaa. bbbb. cc", 6)


def chunking_spans(text, most):
    from groundstone.operators.chunking import spans

    return spans(text, most)
