"""Wide tables and common units, with what can be wrong in their input."""

import datetime as dt
import json

import pytest

from groundstone.operators import factcells, units, wide

CATALOG = "attribute string, label string, value_type string"
UNIT = "unit_name string, dimension string, base_unit string, factor double, offset_value double, symbol string"


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame([("revenue", "R", "double"), ("headcount", "H", "bigint"), ("record_date", "D", "date"), ("audited", "A", "boolean"), ("office", "O", "string"), (None, None, "double")], CATALOG)


@pytest.fixture
def reference(spark):
    return spark.createDataFrame([("INR crore", "money_inr", "INR", 1e7, 0.0, ""), ("INR million", "money_inr", "INR", 1e6, 0.0, ""), ("USD million", "money_usd", "USD", 1e6, 0.0, ""), ("kilogram", "mass", "kilogram", 1.0, 0.0, ""), ("tonne", "mass", "kilogram", 1e3, 0.0, ""), ("million tonne", "mass", "kilogram", 1e9, 0.0, ""), ("degree Celsius", "temperature", "kelvin", 1.0, 273.15, ""), ("kelvin", "temperature", "kelvin", 1.0, None, ""), ("percent", "ratio", "percent", 1.0, 0.0, "%"), ("basis point", "ratio", "percent", 0.01, 0.0, "")], UNIT)


def body(attribute, value, **k):
    return json.dumps({"subject": "The Acme Ltd", "attribute": attribute, "value": value} | k)


def test_wide(facts, catalog, rows):
    d = facts(
        ("f1", body("Revenue (INR crore)", "c. 1,234.5", time_scope="FY2024-25"), {"confidence": 0.9}),
        ("f1", body("Revenue (INR crore)", "c. 1,234.5", time_scope="FY2024-25"), {"confidence": 0.9}),
        ("f2", body("Revenue", "9"), {"canonical_key": " ACME_LTD :: REVENUE", "time_scope": "fy25", "confidence": 0.1}),
        ("f3", '{"SUBJECT": "acme ltd", "Attribute": "headcount", "VALUE": 12, "Period": "2024"}', {}),
        ("f4", body("record date", "31/02/2020"), {}), ("f5", body("record date", "29 February 2020"), {}),
        ("f6", body("audited", "Y"), {}), ("f7", body("audited", "withheld", period="FY24"), {}),
        ("f8", body("office", "see note 14"), {}), ("f9", body("office", " 'Plot 5' "), {"confidence": None}),
        ("g1", "no json", {}), ("g2", None, {}), ("g3", body("elsewhere", "5"), {}), ("g4", body("headcount", "1.5", period="FY24"), {}), (None, body("revenue", "5", period="FY23"), {}),
        extra="entity",
    )
    got = {(r.entity, r.period): r.asDict() for r in wide.wide_table(d, catalog).collect()}
    assert set(got) == {("acme_ltd", "fy2025"), ("acme_ltd", "cy2024"), ("acme_ltd", "")}
    assert got["acme_ltd", "fy2025"]["revenue"] == 1234.5
    assert got["acme_ltd", "cy2024"]["headcount"] == 12
    none = got["acme_ltd", ""]
    assert (none["record_date"], none["audited"], none["office"], none["revenue"]) == (dt.date(2020, 2, 29), True, "Plot 5", None)
    kinds = wide.catalog_of(catalog)
    assert rows(wide.filled_cells(wide.wide_table(d, catalog), kinds)) == [("acme_ltd", "", "audited"), ("acme_ltd", "", "office"), ("acme_ltd", "", "record_date"), ("acme_ltd", "cy2024", "headcount"), ("acme_ltd", "fy2025", "revenue")]


def test_wide_of_nothing(facts, catalog):
    d = facts(("f", body("revenue", "1"), {}))
    assert wide.wide_table(d.limit(0), catalog).count() == 0
    assert wide.wide_table(d, catalog.limit(0)).columns == ["entity", "period"]


def test_wide_rows_stay_whole_over_batches(spark, facts, catalog):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        d = facts(*[(f"{p}{a}", body(a, v, period=str(2000 + p)), {}) for p in range(30) for a, v in (("revenue", "5"), ("headcount", "7"), ("office", "x y"), ("audited", "no"))])
        got = wide.wide_table(d, catalog).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 30 and all((r.revenue, r.headcount, r.office, r.audited) == (5.0, 7, "x y", False) for r in got)


@pytest.mark.parametrize("value, kind, want", [
    ("1,23,456", "double", 123456.0), ("~ -5 deg F", "double", -5.0), ("(9)", "double", 9.0), ('"9 bps"', "double", 9.0), ("US$ 5 mn", "double", 5.0), ("#REF!", "double", None), ("see note 4", "double", None), ("..", "double", None), (True, "double", None),
    ("4417", "bigint", 4417), ("4.5", "bigint", None), ("12/06/1971", "date", dt.date(1971, 6, 12)), ("1971-06-12", "date", dt.date(1971, 6, 12)), ("June 12, 1971", "date", dt.date(1971, 6, 12)), ("12-Jun-1971", "date", dt.date(1971, 6, 12)), ("June 12; 1971", "date", dt.date(1971, 6, 12)), ("06/31/1971", "date", None),
    ("N", "boolean", False), (False, "boolean", False), ("maybe", "boolean", None), ("—", "string", None), ("AA- (stable)", "string", "AA- (stable)"), (None, "string", None), ({"a": 1}, "string", None),
])
def test_typed(value, kind, want):
    assert factcells.typed(value, kind) == want


FOUND = {
    "in the value": (body("revenue", "5 Rs. crores"), {}, "INR crore"), "before and after": (body("revenue", "US$ 5 mn"), {}, "USD million"), "payload": (body("freight", "5", unit="metric tons"), {}, "tonne"), "column": (body("freight", "5"), {"unit": "Mt"}, "million tonne"),
    "column keeps case": (body("freight", "5", unit="MT"), {"unit": "Mt"}, "million tonne"), "bracket": (body("revenue (in INR mn)", "5"), {}, "INR million"), "qualifier": (body("margin", "5", qualifier="all amounts in per cent"), {}, "percent"),
    "unless": (body("margin", "5", qualifier="basis points unless stated otherwise"), {}, "basis point"), "quote": (body("revenue", "5", source_quote="Revenue came to 5 Rs crore in FY25, not 15 mn."), {}, "INR crore"), "wrapped": (body("freight", "[5]", unit="'kilogrammes'"), {}, "kilogram"),
    "none": (body("revenue", "5"), {}, None), "no number": (body("revenue", "NA", unit="Rs crore"), {}, None), "not a unit": (body("revenue", "5", unit="widgets"), {}, None), "degrees": (body("cold", "-3", unit="°C"), {}, "degree Celsius"),
}


def test_units(facts, reference):
    d = facts(*[(k, p, more) for k, (p, more, _) in FOUND.items()], *[(k, p, more) for k, (p, more, _) in FOUND.items()], (None, FOUND["payload"][0], {}), ("bad", "no json", {}), ("null", None, {}), extra="dimension")
    got = {r.id: r for r in units.in_base_units(d, reference).collect()}
    assert {k: got[k].unit_name if k in got else None for k in FOUND} == {k: v[2] for k, v in FOUND.items()}
    assert got["degrees"].base_value == pytest.approx(270.15)
    assert units.in_base_units(d.limit(0), reference).count() == units.in_base_units(d, reference.limit(0)).count() == 0


def test_same_measure_against_all_pairs(spark, rows):
    import itertools
    import random

    rnd = random.Random(5)
    data = [(f"f{i:03}", "e", "a", rnd.choice(["", "fy25"]), "mass", rnd.choice(["kilogram", "tonne"]), v) for i, v in enumerate([0.0, 0.0, -100.0, -100.4, 100.0, 100.5, 100.51, *(1000 * 1.002**k for k in range(40)), *(rnd.uniform(1, 1.2) for _ in range(60))])] + [("n", "e", "a", "", "mass", "tonne", None), ("x", "e", "a", "", "mass", "tonne", float("nan"))]
    q = spark.createDataFrame(data, "id string, entity string, attribute string, period string, dimension string, unit_name string, base_value double")
    near = lambda x, y: abs(x - y) <= 0.005 * max(abs(x), abs(y))
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(sorted(data[:-2]), 2) if a[3] == b[3] and a[5] != b[5] and near(a[6], b[6]))
    assert rows(units.same_measure(q)) == want


def test_too_many_units_are_refused(spark, reference, monkeypatch):
    monkeypatch.setattr(units, "MAX_UNITS", 3)
    with pytest.raises(ValueError):
        units.unit_rows(reference)


@pytest.mark.parametrize("printed, want", [("1,234", 1234.0), ("1,23,456", 123456.0), ("9.168,5", 9168.5), ("1.234.567", 1234567.0), ("1.234.567,8", 1234567.8), ("1,6952", 1.6952), ("12,5", 12.5), ("0,861", 0.861), ("1,234.5", 1234.5), ("1 234,5", 1234.5), (".5", 0.5)])
def test_number_of(printed, want):
    assert factcells.number_of(printed) == want
    assert factcells.quantity(f"about {printed} tonnes")[0] == want


def test_long_texts_keep_their_quantity(facts, reference):
    said = "5 (in millions of metric tonnes, excluding exports and whatever the subsidiaries abroad reported late)"
    far = "The figure of " + "very " * 50 + "many pages comes last: revenue of the company in millions of rupees, 5 million pounds weight."
    d = facts(("a", body("freight", said), {}), ("b", body("freight", "9.168,5", unit="kg"), {}), ("c", body("freight", "1,234", unit="kg"), {"value_num": 1.234}), ("d", body("freight", "5", source_quote=far), {}))
    got = {r.id: (r.unit_name, r.value) for r in units.in_base_units(d, reference).collect()}
    assert got["a"] == ("million tonne", 5.0) and got["b"] == ("kilogram", 9168.5) and got["c"] == ("kilogram", 1.234) and "d" in got


def test_spelling_of_two_dimensions_takes_the_attributes_usual_one(spark, facts):
    table = spark.createDataFrame([("pound", "mass", "pound", 1.0, 0.0), ("Pound", "money", "Pound", 1.0, 0.0), ("kilogram", "mass", "pound", 2.2, 0.0)], "unit_name string, dimension string, base_unit string, factor double, offset_value double")
    d = facts(*[(f"k{i}", body("freight", "5", unit="kg"), {}) for i in range(3)], ("p", body("freight", "7", unit="pounds"), {}), ("q", body("freight", "7", unit="pound"), {}))
    got = {r.id: r.unit_name for r in units.in_base_units(d, table).collect()}
    assert got["q"] == "pound" and got["p"] == "pound"


def test_copies_of_one_measure_are_one_class(spark, rows, monkeypatch):
    from groundstone.operators import skew

    monkeypatch.setattr(skew, "HEAVY_ROWS", 10)
    data = [(f"a{i:03}", "e", "x", "", "mass", "kilogram", 1000.0) for i in range(40)] + [(f"b{i:03}", "e", "x", "", "mass", "tonne", 1001.0) for i in range(15)]
    q = spark.createDataFrame(data, "id string, entity string, attribute string, period string, dimension string, unit_name string, base_value double")
    assert rows(units.same_measure(q)) == [(f"a{i:03}", f"b{j:03}") for i in range(40) for j in range(15)]
