"""Labels, tables, chunks and quotes."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from groundstone.functions.text import strip
from groundstone.operators import chunking, facts as fact_ops, grounding, pages, proposer

PAGE = "id string, document_id string, pdf_page_index int, printed_page_label string, text string"


def labels(spark, texts):
    d = spark.createDataFrame([(f"p{i}", "d", i, None, t) for i, t in enumerate(texts)], PAGE)
    return [r.label for r in pages.page_labels(d).orderBy("pdf_page_index").collect()]


def test_labels(spark):
    assert labels(spark, [f"Header\n{n}\nbody text" for n in range(100, 104)]) == ["100", "101", "102", "103"]
    assert labels(spark, ["7\nx", "no number", "93\ny"]) == [None] * 3
    assert labels(spark, [f"{2 * n}\nbody\n{2 * n + 1}" for n in range(40, 43)]) == ["80-81", "82-83", "84-85"]
    assert labels(spark, [f"{n}\nbody" for n in (10, 11, 12, 90, 91, 92)]) == ["10", "11", "12", "90", "91", "92"]
    assert labels(spark, ["iv\nx", "v\ny", "INTERNATIONAL FUND 6\nz"]) == ["iv", "v", "6"]
    assert labels(spark, [None, "", "  \n "]) == [None] * 3
    assert labels(spark, []) == []


def test_labels_of_two_documents_and_repeated_pages(spark):
    d = spark.createDataFrame([(f"{k}{i}", k, i, None, f"{n + i}\nx") for k, n in (("a", 5), ("b", 70)) for i in range(3)], PAGE)
    got = {r.id: r.label for r in pages.page_labels(d).collect()}
    assert got == {"a0": "5", "a1": "6", "a2": "7", "b0": "70", "b1": "71", "b2": "72"}


def test_roman(spark):
    d = spark.createDataFrame([("iv",), ("xiv",), ("mcmxc",), ("q",), ("",)], "v string")
    assert [r.x for r in d.select(pages.roman(F.col("v")).alias("x")).collect()] == [4, 14, 1990, None, None]


def test_tables(spark):
    d = spark.createDataFrame([("a 1\n2 3\n(4) 5%\n6.5\nwords only here",), ("1\n2\n3\nx",), (None,)], "t string")
    assert [r.x for r in d.select(pages.looks_tabular(F.col("t")).alias("x")).collect()] == [True, False, None]
    d = spark.createDataFrame([([["a|b", None], ["c\nd"]],), ([],), ([[]],)], "r array<array<string>>")
    assert [r.x for r in d.select(pages.markdown(F.col("r")).alias("x")).collect()] == ["| a\\|b |  |\n|---|---|\n| c d |  |", "", ""]


TEXTS = ["", "short", "a" * 500, "One sentence. Another one! A third?\n\nNew paragraph here.\nA line\nand more. " * 8, "no breaks at all " * 40, "x\n\n\n\ny" * 60]


@pytest.mark.parametrize("most", [50, 200, 1000])
@pytest.mark.parametrize("text", TEXTS)
def test_spans(text, most):
    got = chunking.spans(text, most)
    assert all(b - a <= most for a, b in got)
    assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))
    lost = text[: got[0][0]] + "".join(text[b:c] for (_, b), (c, _) in zip(got, got[1:])) + text[got[-1][1] :]
    assert not lost.strip()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab.!? \n\t", max_size=300), st.integers(5, 60))
def test_spans_lose_separators_only(text, most):
    got = chunking.spans(text, most)
    assert all(0 <= b - a <= most for a, b in got)
    kept = "".join(text[a:b] for a, b in got)
    assert re.sub(r"\s", "", kept) == re.sub(r"\s", "", text)


def test_chunks(spark):
    rows = [("d:p0", "d", 0, "1", "word " * 900), ("d:p1", "d", 1, None, None), ("d:p2", "d", 2, "3", " " * 2000), ("d:p3", "d", 3, "4", "x" * 79), ("d:p4", "d", 4, "5", "y" * 80), ("e:p0", "e", 0, None, "z" * 1650)]
    d = spark.createDataFrame(rows, PAGE)
    w = [(r.id, r.char_start, r.char_end) for r in chunking.retrieval_windows(d).orderBy("document_id", "ordinal").collect()]
    assert w == [("d:r0", 0, 900), ("d:r1", 750, 1650), ("d:r2", 1500, 2400), ("d:r3", 2250, 3150), ("d:r4", 3000, 3900), ("d:r5", 3750, 4500), ("d:r6", 0, 80), ("e:r0", 0, 900), ("e:r1", 750, 1650)]
    e = chunking.extraction_chunks(d).collect()
    text = {r[0]: r[4] for r in rows}
    assert all(r.text == text[r.page_id][r.char_start : r.char_end] and len(r.text) <= 3600 for r in e)
    assert sorted(r.id for r in e) == ["d:e0", "d:e1", "d:e2", "e:e0"]
    assert chunking.retrieval_windows(d.limit(0)).count() == chunking.extraction_chunks(d.limit(0)).count() == 0


SOURCE = "Revenue for the year\nwas ₹8,142 crore, up from “last year”—a record.\nTotal equity\n59,798.47\nINR million Assets 12 34 56 78 90 Other words follow here."
QUOTES = {
    "was ₹8,142 crore": "exact", "Revenue for the year was ₹8,142 crore": "normalised_whitespace", 'UP FROM "LAST YEAR"-A RECORD': "normalised_chars", "“was ₹8,142 crore, up”": "exact",
    "was ₹8,143 crore today": None, "short": None, "Total equity 59,798.47 INR million": "normalised_whitespace", "equity total 59,798.47 million": "reconstructed_span", "12 34 56 78 90 words": None, None: None, "": None,
    "words without any figure": None, "a\\E.b*c (quoted) pattern": None,
}


def test_grounding(spark):
    d = spark.createDataFrame([(i, SOURCE, q) for i, q in enumerate(QUOTES)] + [(99, None, "was ₹8,142 crore")], "i int, s string, q string")
    got = {r.i: r.match for r in grounding.grounded(d, "s", "q").collect()}
    for i, (q, mode) in enumerate(QUOTES.items()):
        m = got[i]
        assert m.mode == mode, q
        if mode:
            assert 0 <= m.start < m.end <= len(SOURCE)
    assert got[99].mode is None
    w = got[1]
    assert " ".join(SOURCE[w.start : w.end].split()) == "Revenue for the year was ₹8,142 crore"


def test_grounding_in_page_offsets(spark):
    page = "Front matter. " + SOURCE
    d = spark.createDataFrame([(page, SOURCE, 14, "was ₹8,142 crore"), (page, "other chunk", 0, "was ₹8,142 crore"), (page, "other", 0, "equity total 59,798.47 million")], "p string, c string, s int, q string")
    got = [r.match for r in grounding.located(d, "p", "c", "s", "q").collect()]
    assert [page[m.start : m.end] if m.mode else None for m in got] == ["was ₹8,142 crore", "was ₹8,142 crore", None]


CHUNK = "id string, document_id string, page_id string, pdf_page_index int, printed_page_label string, role string, kind string, ordinal int, char_start int, char_end int, text string, title string"
PROSE = "Acme Freight Ltd reported revenue of INR 8,142 crore in FY2025. Nothing here. Margins at Acme Freight Ltd rose to 17.9 per cent in FY2025."


def test_proposer_and_store(spark, rows):
    chunks = spark.createDataFrame([("c0", "d", "p", 0, None, "extraction", "prose", 0, 0, len(PROSE), PROSE, "T"), ("c1", "d", "p", 0, None, "extraction", "prose", 1, 0, 4, "none", None), ("c2", "d", "p", 0, None, "extraction", "prose", 2, 0, 0, None, None)], CHUNK)
    page = spark.createDataFrame([("p", "d", 0, None, PROSE)], PAGE)
    found = proposer.proposed(chunks)
    assert rows(found, "chunk_id", "n", "subject", "attribute", "value", "unit", "time_scope") == [
        ("c0", 0, "Acme Freight Ltd", "INR", "8,142", "crore", "in FY2025"),
        ("c0", 1, "Acme Freight Ltd", "Acme Freight Ltd", "17.9", "per cent", "in FY2025"),
    ]
    bad = spark.createDataFrame([("c0", "s", "a", "1", None, None, None, 2.0, "this is nowhere on the page", 90), ("c0", None, " ", "1", None, None, None, None, "Nothing here.", 91), ("c0", "s", "a", "1", None, None, None, None, " ", 92)], found.schema)
    done = fact_ops.stored(found.unionByName(found).unionByName(bad), chunks, page)
    assert rows(done.groupBy("outcome").count()) == [("rejected_duplicate", 2), ("rejected_invalid", 2), ("rejected_ungrounded", 1), ("stored", 2)]
    for r in done.where("outcome = 'stored'").collect():
        assert PROSE[r.quote_char_start : r.quote_char_end] == r.quote
    counts = fact_ops.outcome_counts(done).first()
    assert (counts.proposed, counts.stored, counts.grounding_rate) == (7, 2, pytest.approx(2 / 7))
    again = fact_ops.stored(found, chunks, page, known=done.where("outcome = 'stored'").select("id"))
    assert rows(again.select("outcome").distinct()) == [("rejected_duplicate",)]
    assert fact_ops.outcome_counts(done.limit(0)).first().grounding_rate == 0.0


def test_registry(facts, rows):
    import datetime as dt

    t = lambda n: dt.datetime(2024, 1, n)
    d = facts(("f1", '{"b": 1, "a": 2}', {"fact_type": "x", "document_id": "d1", "created_at": t(2)}), ("f0", '{"c": 1}', {"fact_type": "x", "document_id": "d2", "created_at": t(3)}), ("f2", None, {"fact_type": None}), ("f3", "no json", {"fact_type": "y", "created_at": t(1)}))
    assert rows(fact_ops.registry(d), "fact_type", "first_document_id", "fact_count", "observed_keys", "sample_fact_id") == [("x", "d1", 2, "a,b,c", "f1"), ("y", None, 1, None, "f3")]


def test_strip_is_not_trim(spark):
    d = spark.createDataFrame([(" a ",)], "v string")
    assert d.select(strip(F.col("v")).alias("x")).first().x == "a"
