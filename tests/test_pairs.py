"""Pair rules, exact vectors, and what is new or pending."""

import json
import math
import operator
import tracemalloc
from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundstone.operators import incremental, relate, store, vectors
from groundstone.options import Options


def fact(**k):
    return json.dumps({"subject": "Acme", "attribute": "revenue", "value": None, "unit": None, "time_scope": None, "qualifier": None} | k)


CASES = [
    (fact(value="8142", unit="INR crore"), fact(value="1200", unit="USD million"), "CONTEXT_RECONCILED", "units_differ"),
    (fact(value="6.4", unit="%", time_scope="FY25"), fact(value="7.2", unit="%", time_scope="FY25"), "CONTRADICTS", "value_mismatch"),
    (fact(value="6.4", unit="%", time_scope="FY25"), fact(value="7.2", unit="%", time_scope="FY24"), "CONTEXT_RECONCILED", "different_period"),
    (fact(value="8,142", unit="INR crore"), fact(value="81,420", unit="INR million"), "CORROBORATES", "same_value"),
    (fact(value="5"), fact(attribute="headcount", value="5"), "UNRELATED", "different_attribute"),
    (fact(value="5", qualifier="standalone"), fact(value="9", qualifier=" Consolidated"), "CONTEXT_RECONCILED", "different_scope"),
    (fact(value="market leader"), fact(value="5"), "UNRELATED", "non_numeric"),
    (fact(value="6.4", unit="%", time_scope="FY24"), fact(value="6.4", unit="%", time_scope="FY25"), "CORROBORATES", "same_value"),
]


def test_rules(spark, facts, rows):
    all_facts = facts(*[(f"{s}{i}", c[k], {}) for i, c in enumerate(CASES) for k, s in ((0, "a"), (1, "b"))])
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(len(CASES))] + [("a0", "gone"), (None, "b0")], "fact_a_id string, fact_b_id string")
    got = {r.fact_a_id: r for r in relate.classified(pairs, all_facts).where("status = 'ok'").collect()}
    for i, c in enumerate(CASES):
        assert (got[f"a{i}"].relation_type, got[f"a{i}"].reason_tag) == c[2:], c
    assert relate.classified(pairs, all_facts).where("status = 'failed'").count() == 2
    assert relate.classified(pairs.limit(0), all_facts).count() == 0


MODEL = [
    (fact(value="100", time_scope="FY24"), fact(value="120", time_scope="FY23"), "contradicts", ("CONTEXT_RECONCILED", "different_period")),
    (fact(value="100", unit="INR crore", time_scope="FY24"), fact(value="120", unit="INR crore", time_scope="FY24"), "CONTRADICTS", ("CONTRADICTS", "model")),
    (fact(value="6.4", time_scope="FY25"), fact(value="6.5", time_scope="2024-25"), "CONTRADICTS", ("CONTRADICTS", "model")),
    (fact(value="6.5", unit="%", time_scope="2024-25"), fact(value="6.5", unit="percent", time_scope="FY2024/25"), "CONTEXT_RECONCILED", ("CORROBORATES", "same_value")),
    (fact(value="5"), fact(value="5"), "nonsense", ("CORROBORATES", "same_value")),
    (fact(value="5"), fact(value="5"), None, ("CORROBORATES", "same_value")),
]


def test_model_verdicts(spark, facts):
    all_facts = facts(*[(f"{s}{i}", c[k], {}) for i, c in enumerate(MODEL) for k, s in ((0, "a"), (1, "b"))])
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}", c[2], "model", 2.0) for i, c in enumerate(MODEL)], "fact_a_id string, fact_b_id string, model_type string, model_tag string, model_confidence double")
    got = {r.fact_a_id: (r.relation_type, r.reason_tag) for r in relate.classified(pairs, all_facts, model=True).collect()}
    assert [got[f"a{i}"] for i in range(len(MODEL))] == [c[3] for c in MODEL]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 8))
    x = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 8))])
    data = [(f"f{i:03}", f"d{i % 7}", [float(v) for v in row]) for i, row in enumerate(x)]
    return x / np.linalg.norm(x, axis=1, keepdims=True), spark.createDataFrame(data, "fact_id string, document_id string, vector array<float>")


@pytest.mark.parametrize("block", [4096, 13])
def test_cross_document_pairs(cloud, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    x, d = cloud
    s = x @ x.T
    doc = np.arange(len(x)) % 7
    want = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if doc[i] != doc[j] and s[i, j] >= 0.82), key=lambda j: (-s[i, j], j))[:3]
        want |= {(f"f{min(i, j):03}", f"f{max(i, j):03}") for j in order}
    got = vectors.cross_document_pairs(d, Options(candidate_top_k=3)).collect()
    assert {(r.fact_a_id, r.fact_b_id) for r in got} == want and len(got) == len(want) > 10


def test_search(cloud):
    x, d = cloud
    got = vectors.search(d.where("fact_id < 'f003'"), d, 4).collect()
    for q in range(3):
        s = x @ x[q]
        want = [f"f{j:03}" for j in np.argsort(-s) if j != q and s[j] >= 0][:4]
        assert [r.fact_id for r in sorted((r for r in got if r.query_id == f"f{q:03}"), key=lambda r: r["rank"])] == want
    assert vectors.search(d.limit(0), d).count() == 0


def test_search_has_no_most_queries(spark):
    d = spark.range(10_001).select(F.format_string("f%05d", "id").alias("fact_id"), F.array(F.cos("id"), F.sin("id")).cast("array<float>").alias("vector"))
    got = vectors.search(d, d, 1)
    assert got.count() == got.select("query_id").distinct().count() == 10_001  # more than 10,000 queries were an error


@pytest.mark.parametrize("queries, part", [(65536, 16384), (7, 16)])
def test_search_in_blocks_and_parts_with_ties(spark, cloud, queries, part, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_ROWS", queries)
    monkeypatch.setattr(vectors, "PART_ROWS", part)
    x, _ = cloud
    y = np.concatenate([x, x[:30], 2 * x[:30], x[:10], np.repeat(x[:1], 20, axis=0)]).astype(np.float32)
    d = spark.createDataFrame([(f"f{i:03}", [float(v) for v in row]) for i, row in enumerate(y)], "fact_id string, vector array<float>")
    asked = [0, 3, 11, 35, 42, 79, 80, 111, 130, 149, 150, 169]
    got = vectors.search(d.where(F.col("fact_id").isin([f"f{q:03}" for q in asked])), d, 4, 0.2).collect()
    in_order = lambda a, b: reduce(operator.add, map(operator.mul, a, b))
    u = [[a / math.sqrt(in_order(row, row)) for a in row] for row in y.tolist()]
    for q in asked:
        s = [in_order(u[q], v) for v in u]
        want = sorted((j for j in range(len(y)) if j != q and s[j] >= 0.2), key=lambda j: (-s[j], j))[:4]
        assert [(r.fact_id, r.cosine) for r in sorted((r for r in got if r.query_id == f"f{q:03}"), key=lambda r: r["rank"])] == [(f"f{j:03}", s[j]) for j in want]


def test_search_keeps_a_task_small():
    rng = np.random.default_rng(5)
    x = (rng.standard_normal(16) + 1e-6 * rng.standard_normal((9_000, 16))).astype(np.float32)  # as alike as can be told apart
    x[:4000] = rng.standard_normal((4000, 16))
    frame = lambda side, rows: pd.DataFrame({"side": side, "fact_id": [f"f{i:05}" for i in rows], "vector": list(x[rows])})
    tracemalloc.start()
    got = pd.concat(vectors.k_best(iter([frame(0, range(0, 9_000, 3)), frame(1, range(5_000)), frame(1, range(5_000, 9_000))]), 6, 0.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 18_000 and peak < 400e6  # of 27,000,000 pairs


def test_proper_and_unit(spark):
    d = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0]), ("e", [float("nan"), 1.0]), ("f", [None, 1.0])], "fact_id string, vector array<float>")
    assert [r.fact_id for r in vectors.proper(d, 2).collect()] == ["a"]
    assert [r.u for r in d.limit(2).select(vectors.unit(F.col("vector")).alias("u")).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]


def test_pending_covers_all_documents(spark):
    chunks = spark.createDataFrame([(f"{d}{i}", d, "extraction", i, 1.0) for d in "abc" for i in range(10)] + [("x", "a", "retrieval", 0, 1.0), ("y", "a", "extraction", 99, 0.0)], "id string, document_id string, role string, ordinal int, numeric_density double")
    docs = spark.createDataFrame([(d, d.upper()) for d in "abc"], "id string, title string")
    done = spark.createDataFrame([("a0", "done"), ("b0", "failed")], "chunk_id string, status string")
    got = [(r.id, r.doc_rank) for r in incremental.pending(chunks, docs, done).collect()]
    assert got[:3] == [("a1", 1), ("b0", 1), ("c0", 1)] and len(got) == 29
    assert incremental.pending(chunks, docs, done.limit(0), document="b").count() == 10


def test_ingest_and_delete(spark, rows):
    sha = "content_sha256 string, parser_version string"
    known = spark.createDataFrame([("k", "1"), ("old", "0")], sha)
    new = spark.createDataFrame([("k", "1"), ("old", "1"), ("n", "1"), ("n", "1"), (None, "1")], sha)
    assert rows(incremental.ingest_plan(new, known), "content_sha256", "action") == [("k", "skip"), ("n", "new"), ("old", "stale")]
    assert rows(incremental.ingest_plan(new, known, force=True).groupBy("action").count()) == [("force", 2), ("new", 1)]
    f = spark.createDataFrame([("f1", "d1"), ("f2", "d2"), ("f3", "d2")], "id string, document_id string")
    r = spark.createDataFrame([("r1", "f1", "f2"), ("r2", "f2", "f3")], "id string, fact_a_id string, fact_b_id string")
    d = spark.createDataFrame([("d1",), ("d2",)], "id string")
    left = incremental.without_documents({"documents": d, "facts": f, "relationships": r}, d.where("id = 'd1'"))
    assert {n: [x.id for x in t.orderBy("id").collect()] for n, t in left.items()} == {"documents": ["d2"], "facts": ["f2", "f3"], "relationships": ["r2"]}


def test_upsert_and_new_pairs(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, born string")
    new = spark.createDataFrame([("b", 9, "z"), ("c", 3, "w")], "k string, v int, born string")
    assert rows(incremental.upserted(old, new, ["k"], keep=["born"])) == [("a", 1, "x"), ("b", 9, "y"), ("c", 3, "w")]
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "fact_a_id string, fact_b_id string")
    seen = spark.createDataFrame([("b", "a")], "fact_a_id string, fact_b_id string")
    assert rows(incremental.new_pairs(pairs, seen)) == [("a", "c")]


def test_replaced(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    incremental.replaced(spark.read.parquet(path).where("id > 0"), path)
    assert rows(spark.read.parquet(path)) == [(1,), (2,)]


def test_filters_and_pages(facts, rows):
    d = facts(*[(f"f{i}", '{"note": "100%_x"}' if i == 3 else "{}", {"confidence": c, "canonical_text": f"GDP {i}", "value_num": v, "document_id": "d"}) for i, (c, v) in enumerate([(0.9, 1.0), (0.9, None), (None, 2.0), (0.2, 3.0)])])
    assert store.fact_filter(d).count() == 3
    assert rows(store.fact_filter(d, 0.5, numeric=True), "id") == [("f0",)]
    assert rows(store.fact_filter(d, text="%_X"), "id") == [("f3",)]
    assert store.fact_filter(d, document="other").count() == 0
    assert [r.id for r in store.page_of(d, [F.desc("confidence"), "id"], 2, 1).collect()] == ["f1", "f3"]


def test_or_join_has_no_nested_loop(spark, facts):
    r = spark.createDataFrame([("r", "a", "b", "X"), ("s", "a", "a", "X")], "id string, fact_a_id string, fact_b_id string, relation_type string")
    o = store.oriented(r)
    assert sorted((x.fact_id, x.other_id, x.id) for x in o.collect()) == [("a", "a", "s"), ("a", "b", "r"), ("b", "a", "r")]
    d = facts(("a", "{}", {})).select(F.col("id").alias("fact_id")).join(o, "fact_id")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
