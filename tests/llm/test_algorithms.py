"""Copies, groups, neighbours and containers."""

import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import groundstone.operators.skew as skew
from groundstone.llm import components, neighbours, packing, records

# ---- copies

SAME = [
    ("Acme - Revenue: 5.5 [FY25]", {"subject": "Acme", "value": "5.5", "detail": {"row": 1, "tags": ["A b", "c"]}}),
    ("ACME  -  revenue : 5.5 (fy25)", {"Detail": {"TAGS": ["a B", "C."], "row": 1.0}, "VALUE": " '5.5';", "sub-ject": "acme"}),
]
OTHER = [
    ("Acme - Revenue: 55 [FY25]", SAME[0][1]), (SAME[0][0], SAME[0][1] | {"value": "-5.5"}), (SAME[0][0], SAME[0][1] | {"value": "5.5%"}), (SAME[0][0], SAME[0][1] | {"value": "₹5.5"}), (SAME[0][0], SAME[0][1] | {"unit": None}),
    (SAME[0][0], SAME[0][1] | {"detail": {"row": 1, "tags": ["c", "A b"]}}), (None, SAME[0][1]), (SAME[0][0], None),
]


def test_leaf_text():
    for a, b in (("A-b, (c)", "abc"), ("2023-24", "202324"), ("x: -5", "x-5"), ("-$5", "-$5"), ("5 . 5", "55"), ("1,234.5", "1234.5"), ("É", "é"), ("5%", "5%"), ("–", ""), ("AA+", "aa+"), ("end.", "end")):
        assert records.leaf_text(a) == b


def test_leaf_text_ignores_all_punctuation():
    for a, b in (("甲，乙（丙）：丁；戊！己？", "甲乙丙丁戊己"), ("ا، ب", "اب"), ("5．5，", "5.5"), ("x－5", "x5"), ("x: －5", "x-5"), ("5％", "5％"), ("end．", "end"), ("€5 + £3", "€5+£3")):
        assert records.leaf_text(a) == b
    every = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "P" and chr(c) not in "%％﹪٪"]
    assert not records.leaf_text(" ".join(every))


def test_copies(facts, rows):
    every = [(t, json.dumps(p, indent=i) if p is not None else None) for i, (t, p) in enumerate([*SAME, *OTHER])]
    data = [(f"f{i}", p, {"canonical_text": t}) for i, (t, p) in enumerate(every)]
    data += [("f0", every[0][1], {"canonical_text": every[0][0]}), ("z1", "not json {", {"canonical_text": "t"}), ("z2", "NOT JSON", {"canonical_text": "T."}), ("z3", None, {}), ("z4", None, {}), (None, every[0][1], {"canonical_text": every[0][0]}), ("deep", "[" * 5000 + "]" * 5000, {})]
    d = facts(*data, extra="digest")
    assert rows(records.copy_groups(d), "first_id", "id") == [("f0", "f0"), ("f0", "f1"), ("z1", "z1"), ("z1", "z2"), ("z3", "z3"), ("z3", "z4")]
    got = {r.first_id: r.copies for r in records.distinct_records(d).collect()}
    assert got["f0"] == got["z1"] == got["z3"] == 2 and got["f2"] == got["deep"] == 1 and sum(got.values()) == 15
    assert records.copy_groups(d.limit(0)).count() == records.distinct_records(d.limit(0)).count() == 0


def test_one_digest_for_two_structures_is_told_apart(facts, rows, monkeypatch, spark):
    d = facts(*[(f"f{i}", json.dumps({"v": i % 2}), {}) for i in range(6)])
    clash = records.rooted(d).withColumn("digest", F.lit(b"same"))
    monkeypatch.setattr(records, "rooted", lambda _: clash)
    assert rows(records.copy_groups(d), "first_id", "id") == [("f0", "f0"), ("f0", "f2"), ("f0", "f4"), ("f1", "f1"), ("f1", "f3"), ("f1", "f5")]


def test_hot_group_of_copies(facts, rows, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 5)
    d = facts(*[(f"f{i:03}", json.dumps({"v": -1 if i % 3 == 0 else i}), {}) for i in range(90)])
    assert rows(records.copy_groups(d), "first_id", "id") == [("f000", f"f{i:03}") for i in range(0, 90, 3)]


# ---- groups

def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return sorted((x, root(x)) for x in up)


def graph(kind):
    rnd = random.Random(kind)
    name = lambda i: f"f{i:04}"
    if kind == "chain":
        order = list(range(60))
        rnd.shuffle(order)
        return [(name(a), name(b)) for a, b in zip(order, order[1:])]
    if kind == "star":
        return [(name(50), name(i)) for i in range(100) if i != 50]
    return [(name(rnd.randrange(150)), name(rnd.randrange(150))) for _ in range(90)]


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, rows, kind, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 20)
    pairs = [(a, b) for a, b in graph(kind) if a != b]
    d = spark.createDataFrame([*pairs, *pairs[:5], *((b, a) for a, b in pairs[:5]), ("f9999", "f9999"), (None, "f0001"), ("f0001", None)], "a string, b string")
    assert rows(components.components(d, "a", "b"), "id", "first_id") == union_find(pairs)


def test_no_links(spark):
    d = spark.createDataFrame([("x", "x"), (None, None)], "a string, b string")
    assert components.components(d, "a", "b").count() == 0
    assert components.components(d.limit(0), "a", "b").columns == ["id", "first_id"]


def test_fact_groups(spark, facts, rows):
    f = facts(*[(i, "{}", {}) for i in "abcdef"], ("a", "{}", {}), (None, "{}", {}))
    rel = [("b", "a", " Corroborates "), ("b", "c", "CORROBORATES"), ("c", "gone", "CORROBORATES"), ("gone", "d", "CORROBORATES"), ("d", "e", "CONTRADICTS"), ("e", "e", "CORROBORATES"), ("e", "f", None), ("f", None, "CORROBORATES")]
    r = spark.createDataFrame([(*x, 1) for x in rel], "fact_a_id string, fact_b_id string, relation_type string, id int")
    assert rows(components.fact_groups(r, f), "fact_id", "group_id") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "f")]
    assert components.fact_groups(r.limit(0), f).count() == 6 and components.fact_groups(r, f.limit(0)).count() == 0


# ---- neighbours

def exact(ids, x, k, floor=-2.0, every=1):
    out = {}
    for i in range(0, len(ids), every):
        s = np.round(x @ x[i], 6)
        s[i] = -2
        near = sorted((-s[j], ids[j]) for j in np.argsort(-s)[: 4 * k].tolist() if s[j] >= floor)
        out[ids[i]] = [b for _, b in near[:k]]
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    base = rng.standard_normal((3000, 16))
    near = base[rng.integers(0, 3000, 900)] + 0.15 * rng.standard_normal((900, 16))
    x = np.concatenate([base, near])
    return [f"fact_{i:016x}" for i in range(len(x))], x / np.linalg.norm(x, axis=1, keepdims=True)


SCHEMA = "fact_id string, model string, vector array<float>, cosine int"


def frame(spark, ids, x):
    return spark.createDataFrame([(i, "m", [float(v) for v in row], 0) for i, row in zip(ids, x)], SCHEMA)


def test_recall_with_a_floor(spark, cloud, monkeypatch):
    ids, x = cloud
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 64)
    want = {(a, b) for a, near in exact(ids, x, 5, 0.9).items() for b in near}
    got = neighbours.nearest(frame(spark, ids, x), 5, "m", 16, floor=0.9).collect()
    pairs = {(r.fact_id, r.other_id) for r in got}
    assert len(want & pairs) / len(want) >= 0.95 and len(want) > 500
    s = {i: k for k, i in enumerate(ids)}
    assert all(abs(r.cosine - x[s[r.fact_id]] @ x[s[r.other_id]]) < 1e-5 and r.cosine >= 0.9 - 1e-6 for r in got)


def test_recall_without_a_floor(spark, cloud):
    ids, x = cloud
    got = {}
    for r in neighbours.nearest(frame(spark, ids, x), 5, "m", 16, every=50).collect():
        got.setdefault(r.fact_id, set()).add(r.other_id)
    assert set(got) == {i for k, i in enumerate(ids) if k % 50 == 0}
    want = exact(ids, x, 5, every=50)
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in got]) >= 0.9


@pytest.mark.parametrize("top", [64, 4])
def test_recall_across_cells(spark, cloud, monkeypatch, top):
    """Sixteen cells, in one level and in two, and several tasks a cell."""
    ids, x = cloud
    monkeypatch.setattr(neighbours, "CELL_ROWS", 250)
    monkeypatch.setattr(neighbours, "TOP_CELLS", top)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 400)
    d = frame(spark, ids, x)
    rows = neighbours.proper_vectors(d, "m", 16).where("vec is not null")
    tree = neighbours.fit_cells(rows, len(x), 16)
    assert tree.count == 16 and len(tree.below) == (4 if top == 4 else 0)
    points = x.astype(np.float32) @ neighbours.projection(16)
    home = tree.of(points)
    assert np.bincount(home, minlength=16).min() > 100 and np.bincount(home).max() < 450
    reached = {(c, r) for c, held in tree.reached(points, np.zeros(len(points), np.float32)) for r in held.tolist()}
    assert {(c, r) for r, c in enumerate(home.tolist())} <= reached
    want = {(a, b) for a, near in exact(ids, x, 5, 0.9).items() for b in near}
    pairs = {(r.fact_id, r.other_id) for r in neighbours.nearest(d, 5, "m", 16, floor=0.9).collect()}
    apart = {(a, b) for a, b in want if home[int(a[5:], 16)] != home[int(b[5:], 16)]}
    assert len(want & pairs) / len(want) >= 0.95 and len(apart & pairs) / len(apart) >= 0.95 and len(apart) > 200
    got = {}
    for r in neighbours.nearest(d, 5, "m", 16, every=50).collect():
        got.setdefault(r.fact_id, set()).add(r.other_id)
    open_ = exact(ids, x, 5, every=50)
    assert set(got) == set(open_) and np.mean([len(got[i] & set(open_[i])) / 5 for i in got]) >= 0.95


def test_copies_and_improper_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = {"a": [1.0, 0.0], "b": [2.0, 0.0], "c": [1.0, 0.0], "d": [3.0, 0.1], "e": [0.0, 1.0], "f": [-1.0, 0.0]}
    rows = [(k, "m", v, 0) for k, v in good.items()] + [("a", "m", [1.0, 0.0], 0), ("z0", "m", [0.0, 0.0], 0), ("z1", "m", [nan, 1.0], 0), ("z2", "m", [inf, 1.0], 0), ("z3", "m", [1.0], 0), ("z4", "m", None, 0), ("z5", "other", [1.0, 0.0], 0), (None, "m", [1.0, 0.0], 0), ("z6", "m", [None, 1.0], 0), ("z7", None, [1.0, 0.0], 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in sorted(neighbours.nearest(d, 2, "m", 2, floor=0.5).collect(), key=lambda r: (-r.cosine, r.other_id)):
        got.setdefault(r.fact_id, []).append(r.other_id)
    assert got == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"], "d": ["a", "b"]}
    everyone = neighbours.nearest(d, 10, "m", 2).collect()
    assert len(everyone) == 30 and {r.fact_id for r in everyone} == set(good)
    assert neighbours.nearest(d.limit(0), 2, "m", 2, floor=0.5).count() == neighbours.nearest(d.limit(0), 2, "m", 2).count() == 0


def test_a_third_of_all_rows_is_one_vector(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 50)
    rng = np.random.default_rng(2)
    ids = [f"fact_{i:016x}" for i in range(600)]
    x = rng.standard_normal((600, 8))
    x[::3] = x[0]
    got = {}
    for r in neighbours.nearest(frame(spark, ids, x), 5, "m", 8, floor=0.99).collect():
        got.setdefault(r.fact_id, set()).add(r.other_id)
    hot = ids[::3]
    assert all(got[i] == set([h for h in hot if h != i][:5]) for i in hot)


def test_chi_square():
    for p, dof, want in ((0.95, 1, 3.841), (0.95, 2, 5.991), (0.95, 12, 21.03), (0.5, 8, 7.344)):
        assert neighbours.chi_square_quantile(p, dof) == pytest.approx(want, rel=2e-3)


# ---- containers

def test_solve_equals_a_known_mix():
    columns = np.array([[3, 1, 0], [2, 2, 0], [2, 1, 1], [4, 0, 0]])
    wanted = np.array([0.0, 7, 4, 5, 2])
    x = packing.solve(columns, wanted, np.ones(5))
    got = np.zeros(5)
    for row, n in zip(columns, x):
        for c in row:
            if c:
                got[c] += n
    assert np.abs(got - wanted).max() < 1e-6 and (x >= 0).all()


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_text(seed):
    rng = np.random.default_rng(seed)
    bins = 64
    h = np.zeros(bins + 1, np.int64)
    for c, n in zip(*np.unique(np.clip(rng.geometric(0.04 * (seed + 1), 3000), 1, bins), return_counts=True)):
        h[c] = n
    if seed == 7:
        h[:] = 0
        h[40] = 1000
    plan = packing.plan(h, bins)
    placed = np.zeros(bins + 1, np.int64)
    for pattern, n in plan:
        assert n > 0 and sum(c * k for c, k in pattern) <= bins
        for c, k in pattern:
            placed[c] += k * n
    assert (placed == h).all()
    boxes, least = sum(n for _, n in plan), -(-int((np.arange(bins + 1) * h).sum()) // bins)
    assert boxes <= least * 1.05 + 2 or seed == 7 and boxes == 1000
    assert packing.plan(np.zeros(bins + 1, np.int64), bins) == []


def test_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_CELL", 20)
    rnd = random.Random(3)
    texts = {i: " ".join(rnd.choice(["alpha", "beta", "gamma ray", "déjà"]) for _ in range(rnd.choice([5, 5, 40, 200, 700]))) for i in range(150)}
    texts |= {1000: None, 1001: "", 1002: "word " * 900, 1003: texts[0]}
    d = spark.createDataFrame([*texts.items(), *list(texts.items())[:20], (None, "x")], "doc_id bigint, text string").withColumn("piece", F.lit(9)).withColumn("class", F.lit(1))
    n = {r.doc_id: r.n_tokens for r in packing.token_counts(d).collect()}
    got = packing.containers(d, capacity=256, quantum=4).collect()
    by, boxes = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        if r.container_id:
            boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
    assert set(by) == set(texts) and max(boxes.values()) <= 256
    for i, parts in by.items():
        assert sum(p.n_tokens for p in parts) == n[i]
        assert [p.token_start for p in sorted(parts, key=lambda p: p.piece)] == [256 * k for k in range(len(parts))]
        assert (len(parts) == 1) == (n[i] <= 256) and (parts[0].container_id is None) == (n[i] == 0)
    assert sum(boxes.values()) / (256 * len(boxes)) > 0.9
    again = packing.containers(d, capacity=256, quantum=4).collect()
    assert sorted((r.doc_id, r.piece, r.container_id or "") for r in got) == sorted((r.doc_id, r.piece, r.container_id or "") for r in again)
    assert packing.containers(d.limit(0)).count() == 0
    assert packing.fill(packing.containers(d.limit(0))).first().containers == 0


def test_vocabulary_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_VOCABULARY", 10)
    with pytest.raises(ValueError):
        packing.token_counts(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))


def test_short_texts_go_through_the_solver():
    bins = 256
    h = np.bincount(np.random.default_rng(1).integers(5, 60, 20_000), minlength=bins + 1)
    columns, times = packing.combinations(bins, h > 0)
    assert len(columns) and ((columns * times).sum(1) <= bins).all() and (columns.astype(bool) * times).max() > 3
    x = packing.solve(columns, h.astype(float), np.sqrt(np.arange(bins + 1.0)), times=times)
    plan = packing.plan(h, bins)
    used = sum(n for _, n in plan)
    assert x.sum() > 0.9 * used and (h * np.arange(bins + 1)).sum() / (used * bins) > 0.99
