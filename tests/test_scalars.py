"""Numbers, units, names and periods against tables of known results."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from groundstone.functions import identity, payload, quantity, text
from groundstone.operators import factcells


def one(spark, values, expr, *more):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in d.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


NUMBERS = {"8142": 8142, "2024": 2024, "81.42": 81.42, "1,234,567": 1234567, "12,34,567": 1234567, "8,142": 8142, ".5": 0.5, "(1,234)": -1234, "no digits here": None, "−5": -5, "": None, "+91 124 6225602": 91124622}


def test_number(spark):
    got = one(spark, NUMBERS, lambda c: quantity.number(text.clean(c)))
    assert got == [None if v is None else pytest.approx(v) for v in NUMBERS.values()]


QUANTITIES = {
    ("Rs 8,142 crore", None): (8.142e10, "INR"), ("8142", "₹ crore"): (8.142e10, "INR"), ("INR 81.42 billion", None): (8.142e10, "INR"), ("$1.2 billion", None): (1.2e9, "USD"),
    ("17.9", "per cent"): (17.9, "%"), ("6.4%", None): (6.4, "%"), ("45", "bps"): (45, "bps"), ("1.2 million", "shipments"): (1.2e6, "shipments"), ("market leader", None): (None, None),
    ("U63090DL2011PLC221234", None): (None, None), ("N24-N34, S24-S34, Air Cargo Logistics Centre-II", None): (None, None), ("Plot 5, Sector 44, Gurugram 122002 Haryana, India", None): (None, None),
    ("Sunil Kumar Bansal", None): (None, None), ("www.delhivery.com", None): (None, None), ("1.2 million %", None): (1.2, "%"), (None, None): (None, None), ("5 m", None): (5e6, None), ("8142crore", None): (None, None),
}


def test_normalised(spark):
    d = spark.createDataFrame([(i, v, u) for i, (v, u) in enumerate(QUANTITIES)], "i int, value string, unit string")
    got = [(r.norm_value, r.norm_unit) for r in quantity.normalised(d, "value", "unit").orderBy("i").collect()]
    for g, (key, want) in zip(got, QUANTITIES.items()):
        assert g == (want[0] if want[0] is None else pytest.approx(want[0]), want[1]), key


def test_agree(spark):
    d = spark.createDataFrame([(None, 5.0), (5.0, 5.0), (5.0, 50.0), (100.0, 100.5), (0.0, 0.0)], "a double, b double")
    assert [r.x for r in d.select(quantity.agree(F.col("a"), F.col("b")).alias("x")).collect()] == [None, True, False, True, True]


PERIODS = {
    **dict.fromkeys(["FY25", "FY2025", "FY2024-25", "2024-25", "2024/25", "FY2024/25", "FY 2024-25", "financial year 2024-25", "fy2025"], "fy2025"),
    "2024": "cy2024", "cy2024": "cy2024", "FY24": "fy2024", "Q4 FY24": "q4-fy2024", "Q4FY2023-24": "q4-fy2024", "q4-fy2024": "q4-fy2024", "H1-FY25": "h1-fy2025", "99-00": "fy2100", "123": "cy123", "": "", "31 March": "31march",
}


def test_period(spark):
    assert one(spark, PERIODS, identity.period) == list(PERIODS.values())
    assert one(spark, [None], identity.period) == [""]
    assert [factcells.period(p) for p in PERIODS] == list(PERIODS.values())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.from_regex(r"\A(?:Q[1-4]|H[12]|)[ -]?(?:FY|fy|financial year|CY|)[ ]?(?:[0-9]{2,4})?(?:[-/][0-9]{2,4})?\Z"), min_size=1, max_size=30))
def test_period_column_equals_function(spark, raw):
    raw = [r for r in raw if r.strip().lower() not in factcells.PLACEHOLDERS]
    assert one(spark, raw, identity.period) == [factcells.period(r) for r in raw]


def test_keys(spark):
    assert one(spark, ["The Delhivery Limited", "delhivery limited"], lambda c: identity.slug(text.clean(c))) == ["delhivery_limited"] * 2
    assert one(spark, ["Real GDP growth", "", None, "the"], lambda c: identity.fact_type(text.clean(c))) == ["real_gdp_growth", "unspecified", "unspecified", "unspecified"]
    d = spark.createDataFrame([("A", None, "5", "kg", "2024"), (None, None, None, None, None), ("A", "b", "", "", "")], "s string, a string, v string, u string, t string")
    got = [r.x for r in d.select(identity.canonical_text(*[F.col(c) for c in "savut"]).alias("x")).collect()]
    assert got == ["A: 5 kg [2024]", "unknown fact", "A - b"]


def test_ids(spark):
    import hashlib

    d = spark.createDataFrame([("d", "c", None, "a", "5", None, "q" * 300)], "d string, c string, s string, a string, v string, t string, q string")
    want = "fact_" + hashlib.sha1("|".join(["d", "c", "None", "a", "5", "None", "q" * 160]).encode()).hexdigest()[:16]
    assert d.select(identity.fact_id(*[F.col(x) for x in "dcsavtq"]).alias("x")).first().x == want
    assert one(spark, ["0.4", "7", "-1", "high", None], identity.confidence) == [0.4, 1.0, 0.0, 0.5, 0.5]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="aZ9 \t\n\x0b\x1c\x85   .é५", max_size=30), min_size=1, max_size=20))
def test_spaces_and_lines_equal_python(spark, texts):
    assert one(spark, texts, text.strip) == [t.strip() for t in texts]
    assert one(spark, texts, text.lines) == [t.splitlines() or ([] if not t else [""]) for t in texts]
    import re

    words = lambda t: len(re.findall(r"\S+", t))
    assert one(spark, texts, text.numeric_density) == [pytest.approx(len(re.findall(r"\d", t)) / words(t)) if words(t) else 0.0 for t in texts]


def test_guard(spark):
    raw = ['[{"a": 1}]', '```json\n[{"a": 1}]\n```', '[{"a": 1}, {"a": 2}, {"a"', "no json", "", None, '{"facts": [{"a": 1}, 3]}', "{}", '{"a": 1}', "5", '[{"a": "x] \\" y"}, {"b']
    got = [(r.o.outcome, len(r.o.records)) for r in spark.createDataFrame(list(enumerate(raw)), "i int, v string").select("i", payload.guarded(F.col("v")).alias("o")).orderBy("i").collect()]
    assert got == [("ok_first_try", 1), ("ok_first_try", 1), ("ok_after_repair", 2), ("failed", 0), ("ok_first_try", 0), ("ok_first_try", 0), ("ok_first_try", 1), ("ok_first_try", 0), ("ok_first_try", 1), ("failed", 0), ("ok_after_repair", 1)]


def test_stored_payload(spark):
    d = spark.createDataFrame([({"subject": "s", "unit": None, "note": None, "extra": "x", "source_quote": "old"},)], "r map<string,string>")
    import json

    assert json.loads(d.select(payload.stored(F.col("r"), F.lit("new")).alias("x")).first().x) == {"subject": "s", "unit": None, "extra": "x", "source_quote": "new"}


def test_general_format(spark):
    values = [0.0, 5.0, -5.5, 100000.0, 1234567.0, 8.142e10, 0.0001, 0.00001234, 123.456789, -2.5e-7, 1e300, 999999.5, None]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r.x for r in d.select("i", quantity.general(F.col("v")).alias("x")).orderBy("i").collect()] == [None if v is None else f"{v:g}" for v in values]
