"""One text form, pieces, leaks and languages."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from groundstone.llm import glyphs, languages, leaks, pieces

LIKE = {"ﬁnance": "finance", "Ｆｕｌｌ　ｗｉｄｔｈ": "Full width", "café": "café", "Ångstrom": "Ångstrom", "zero​wid⁠th": "zerowidth", "no break": "no break", "РЕТЕ": "PETE", "К": "K", "K": "K", "soft­hyphen": "softhyphen", "a‑b": "a-b", " \t x\n\ny ": "x y", "ё": "ë", "": "", "​": "", "q̣̇": "q̣̇", "q̣̇": "q̣̇"}


def test_fold_known():
    assert glyphs.fold_texts(list(LIKE)) == list(LIKE.values())
    assert glyphs.fold_texts([None, "a", None]) == [None, "a", None]
    assert glyphs.fold_texts([]) == []


def test_visible_differences_stay():
    for a, b in (("m²", "m2"), ("½", "1/2"), ("É", "E"), ("A", "a"), ("—", "-"), ("①", "1"), ("x", "×"), ("ſ", "s")):
        assert glyphs.fold_texts([a])[0] != glyphs.fold_texts([b])[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeoAE ̧̣́̈̊éèåçñśệﬁﬂＡ０　 ​﻿\n\t-‐ΑοВсё漢हि한가"), max_size=12), max_size=6))
def test_fold_is_stable_and_per_text(texts):
    once = glyphs.fold_texts(texts)
    assert glyphs.fold_texts(once) == once
    assert once == [glyphs.fold_texts([t])[0] for t in texts]
    assert once == glyphs.fold_texts([unicodedata.normalize("NFD", t) for t in texts])
    assert all(t == unicodedata.normalize("NFC", t) for t in once)


def test_parts(monkeypatch):
    monkeypatch.setattr(glyphs, "PART", 10)
    assert glyphs.parts([4, 4, 4, 30, 0, 1]) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert glyphs.parts([]) == []
    assert glyphs.fold_texts(["x" * 7, None, "é" * 30, "y"]) == ["x" * 7, None, "é" * 30, "y"]


def test_coded_differently(spark):
    page = "Total équity of Kragonax  Ports was 5 INR\nin 2024. m² and more"
    ev = [
        ("same", "Total équity", 0, 12), ("spaces", "Kragonax Ports", 16, 31), ("accent", "Total équity", 0, 12), ("other accent", "Total equity", 0, 12), ("wide", "５ INR in", 36, 44), ("raised", "m2", 54, 56), ("somewhere", "Krago​nax Ports", None, None),
        ("somewhere as it is", "Kragonax Ports", None, None), ("nowhere", "Kragonix", None, None), ("half null", "Tоtal", 0, None), ("past end", "x", 400, 500), ("invisible", "​", None, None), ("null", None, 0, 1), ("empty", "", 0, 1),
    ]
    rows = [(i, "d", 0, q, s, e, 1) for i, q, s, e in ev]
    e = spark.createDataFrame([*rows, *rows, ("lost", "d", 9, "x", 0, 1, 1), (None, "d", 0, "ｘ", 0, 1, 1)], "id string, document_id string, pdf_page_index int, quote string, quote_char_start int, quote_char_end int, text int")
    p = spark.createDataFrame([("d", 0, page), ("d", 0, page), ("d", 1, None), (None, 0, page)], "document_id string, pdf_page_index int, text string")
    assert sorted(r.evidence_id for r in glyphs.coded_differently(e, p).collect()) == ["accent", "half null", "somewhere", "wide"]
    assert glyphs.coded_differently(e.limit(0), p).count() == glyphs.coded_differently(e, p.limit(0)).count() == 0


# ---- pieces

def naive_unsound(t, ps, limit=1200, least=100, most=220):
    if not ps or any(b - a > limit for a, b in ps):
        return True
    covered = {i for a, b in ps for i in range(a, min(b, len(t)))}
    if any(i not in covered and not c.isspace() for i, c in enumerate(t)):
        return True
    if any(not least <= min(b, d) - max(a, c) <= most for (a, b), (c, d) in zip(ps, ps[1:])):
        return True
    runs = [m.span() for m in re.finditer(r"\S+", t) if m.end() - m.start() <= limit]
    return any(x < p < y for x, y in runs for a, b in ps for p in (a, b))


def prose(rnd, n):
    out = []
    while sum(map(len, out)) + len(out) < n:
        out.append("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 12))) + rnd.choice(["", "", "", ".", "\n\n", "\n", "  "]))
    return " ".join(out)


@pytest.mark.parametrize("seed", range(25))
def test_pieces_are_sound(seed):
    rnd = random.Random(seed)
    t = prose(rnd, rnd.randint(1201, 9000))
    if seed % 3 == 0:
        t = t[:700] + " " + "x" * rnd.randint(1201, 5000) + " " + t[700:]
    if seed % 4 == 0:
        t = "\n " * 50 + t + " \t" * 900
    got = pieces.cut_page(t)
    assert not naive_unsound(t, got) and not pieces.unsound(t, got)


def test_pieces_that_cannot_be_sound_still_cover():
    t = " ".join("y" * 400 for _ in range(12))
    got = pieces.cut_page(t)
    assert all(b - a <= 1200 for a, b in got) and not set(range(len(t))) - {i for a, b in got for i in range(a, b)} - {i for i, c in enumerate(t) if c == " "}
    assert pieces.cut_page("") == pieces.cut_page(" \n" * 2000) == []
    assert pieces.cut_page("z" * 5000)[-1][1] == 5000 and not naive_unsound("z" * 5000, pieces.cut_page("z" * 5000))
    assert pieces.cut_page("short text") == [(0, 10)]


def test_audit_equals_naive():
    rnd = random.Random(1)
    seen = set()
    for _ in range(300):
        t = prose(rnd, rnd.randint(1300, 4000))
        ps = pieces.cut_page(t)
        k = rnd.randrange(len(ps))
        kind = rnd.choice(["keep", "shift", "drop", "extend"])
        if kind == "shift":
            ps[k] = (max(0, ps[k][0] + rnd.randint(-60, 60)), ps[k][1])
        elif kind == "drop":
            del ps[k]
        elif kind == "extend":
            ps[k] = (ps[k][0], min(len(t), ps[k][1] + rnd.randint(1, 200)))
        assert pieces.unsound(t, ps) == naive_unsound(t, ps), (kind, ps)
        seen.add((kind, pieces.unsound(t, ps)))
    assert len(seen) > 5


def test_unsound_pages(spark):
    rnd = random.Random(2)
    texts = {f"p{i}": prose(rnd, 3000) for i in range(4)} | {"short": "a" * 1200, "null": None}
    good = [(f"{p}:{n}", p, "retrieval", n, a, b, 1) for p in ("p0", "p1", "p3") for n, (a, b) in enumerate(pieces.cut_page(texts[p]))]
    bad = [c if c[0] != "p1:1" else (*c[:4], c[4] + 1, *c[5:]) for c in good] + [("p3:x", "p3", "retrieval", 99, None, None, 1), ("p2:e", "p2", "extraction", 0, 0, 3000, 1), ("lost", "nowhere", "retrieval", 0, 0, 5, 1)]
    ch = spark.createDataFrame(bad + bad, "id string, page_id string, role string, ordinal int, char_start int, char_end int, text int")
    pg = spark.createDataFrame(list(texts.items()) * 2, "id string, text string")
    assert sorted(r.page_id for r in pieces.unsound_pages(pg, ch).collect()) == ["p1", "p2"]
    assert sorted(r.page_id for r in pieces.unsound_pages(pg, ch.limit(0)).collect()) == ["p0", "p1", "p2", "p3"]
    assert pieces.unsound_pages(pg.limit(0), ch).count() == pieces.pieces_of(pg.limit(0)).count() == 0
    got = pieces.pieces_of(pg).collect()
    assert {r.page_id for r in got} == {"p0", "p1", "p2", "p3"} and all(texts[r.page_id][r.char_start : r.char_end] == r.text for r in got)


# ---- leaks

def words_of(t):
    return re.findall(r"[^\W_]+", glyphs.fold_texts([t])[0].lower())


def test_words_equal_pattern():
    texts = ["A b-c 39.1 per cent, “X”!", "", "ﬁne Ｗｏｒｄ zero​width", "a", "a b", "Ôstrand été"]
    h, owner, length = leaks.words(texts)
    plain = [w for t in texts for w in words_of(t)]
    assert [len(w) for w in plain] == length.tolist()
    assert owner.tolist() == [i for i, t in enumerate(texts) for _ in words_of(t)]
    same = {}
    for w, x in zip(plain, h.tolist()):
        assert same.setdefault(w, x) == x
    assert len(set(same.values())) == len(same)


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = ["w" + "".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randint(10, 80))) for i in range(25)]
    docs = []
    for d in range(120):
        body = text(rnd.randint(0, 300))
        if d % 3 == 0:
            w = rnd.choice(items)[1].split()
            k = rnd.randint(12, 20)
            a = rnd.randrange(max(1, len(w) - k))
            body = f"{body} {', '.join(w[a : a + k]).upper()} {text(5)}"
        docs.append((d, body))
    docs += [(500, None), (501, ""), (502, items[3][1].replace("a", "а")), (502, items[3][1].replace("a", "а"))]
    want = set()
    for i, t in items:
        w = words_of(t)
        grams = {tuple(w[k : k + 15]) for k in range(len(w) - 14)}
        for d, b in docs:
            x = words_of(b) if b else []
            if any(tuple(x[k : k + 15]) in grams for k in range(len(x) - 14)):
                want.add((i, d))
    dd = spark.createDataFrame([(*d, 0) for d in docs] + [(None, items[0][1], 0)], "doc_id bigint, text string, item_id int")
    ii = spark.createDataFrame([*items, *items, (99, None), (None, "x")], "item_id bigint, text string")
    got = leaks.leaks(dd, ii)
    assert {(r.item_id, r.doc_id) for r in got.collect()} == want and got.count() == len(want) > 15
    assert leaks.leaks(dd.limit(0), ii).count() == leaks.leaks(dd, ii.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 100)
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    ii = spark.createDataFrame([(k, text(k)) for k in range(6)], "item_id bigint, text string")
    dd = spark.createDataFrame([(k, "before " + text(k)) for k in range(6)], "doc_id bigint, text string")
    assert sorted((r.item_id, r.doc_id) for r in leaks.leaks(dd, ii).collect()) == [(k, k) for k in range(6)]


def test_all_fingerprints_in_the_radius_are_found():
    rng = np.random.default_rng(1)
    index = leaks.BlockIndex([1, 2], [" ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))], 15, 3)
    probes = index.prints[rng.integers(0, len(index.prints), 400)].copy()
    for k in range(len(probes)):
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(b)
    want = {(i, j) for i in range(len(probes)) for j in range(len(index.prints)) if int(probes[i] ^ index.prints[j]).bit_count() <= 3}
    assert {(int(i), int(j)) for who, item in index.candidates(probes) for i, j in zip(who, item)} == want


def test_near_copies(spark):
    item = " ".join(f"word{i}" for i in range(30))
    near = item.split()
    near[14] = "other"
    dd = spark.createDataFrame([(1, item), (2, " ".join(near)), (3, "nothing of it")], "doc_id bigint, text string")
    got = {r.doc_id: r.similarity for r in leaks.leaks(dd, spark.createDataFrame([(7, item)], "item_id bigint, text string"), least=0.8).collect()}
    assert got[1] == 1.0 and 3 not in got


def shares(item, doc):
    """Best share of every document window that is near one of the item's, by plain sets."""

    def windows(t):
        w = words_of(t)
        return [{tuple(w[k + j : k + j + 5]) for j in range(11)} for k in range(len(w) - 14)]

    weigh = lambda s: sum(len(w) for g in s for w in g)
    theirs = windows(item)
    best = [max((weigh(x & y) / weigh(x | y) for y in theirs), default=0) for x in windows(doc)]
    return [x for x in best if x >= 0.8]


def test_near_copies_equal_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefg") for _ in range(rnd.choice([1, 2, 5, 12]))) for _ in range(300)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [text(rnd.randint(10, 60)) for _ in range(12)] + [["ha"] * 8 + text(12) + ["ha"] * 9, [*"abcab" * 5]]
    docs = []
    for d in range(160):
        w = rnd.choice(items)
        k = rnd.choice([13, 14, 14, 15, 25])
        a = rnd.randrange(max(1, len(w) - k))
        part = w[a : a + k]
        if d % 4 == 0:
            part[rnd.choice([0, -1, len(part) // 2])] = "other"
        docs.append((d, " ".join([*text(rnd.randint(0, 20)), *part, *text(rnd.randint(0, 20))])))
    docs += [(900, " ".join(["ha"] * 20)), (901, " ".join("abc" * 9)), (902, ""), (903, " ".join(items[0]) + " " + " ".join(items[1]))]
    want = {(i, d): (len(s), round(max(s), 9)) for i, w in enumerate(items) for d, t in docs if (s := shares(" ".join(w), t))}
    dd = spark.createDataFrame(docs, "doc_id bigint, text string")
    ii = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {(r.item_id, r.doc_id): (r.windows, round(r.similarity, 9)) for r in leaks.leaks(dd, ii, least=0.8).collect()}
    assert got == want and sum(s < 1 for _, s in want.values()) > 20


# ---- languages

TEMPLATES = {
    "en": "The board of {n} approved the sale of {k} vehicles during the year.|Shareholders of {n} rejected the plan to add {k} wagons.|Output at {n} fell by {k} per cent after the strike.",
    "de": "Der Vorstand von {n} genehmigte den Verkauf von {k} Fahrzeugen im Geschäftsjahr.|Die Aktionäre der {n} lehnten den Plan ab, {k} Wagen zu kaufen.|Die Produktion von {n} sank nach dem Streik um {k} Prozent.",
    "fr": "Le conseil de {n} a approuvé la vente de {k} véhicules au cours de l'exercice.|Les actionnaires de {n} ont rejeté le projet d'achat de {k} wagons.|La production de {n} a baissé de {k} pour cent après la grève.",
    "ru": "Совет директоров {n} одобрил продажу {k} автомобилей в отчётном году.|Акционеры {n} отклонили план покупки {k} вагонов.|Выпуск {n} снизился на {k} процента после забастовки.",
    "zh": "报告期内,{n}董事会批准购买{k}辆货车,用于扩大仓储网络。|据审计师称,{n}的库存增加到{k}件,相当于数周的销售量。",
}


def sentence(rnd, lang):
    name = "".join(rnd.choice(["Kra", "Bo", "Ves", "Dun", "Tor"]) for _ in range(3)) + rnd.choice([" Ltd", " AG", " PLC"])
    return rnd.choice(TEMPLATES[lang].split("|")).format(n=name, k=rnd.randint(2, 9999))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(6)
    rows, truth = [], {}
    for d in range(250):
        lang = rnd.choice(list(TEMPLATES))
        body = " ".join(sentence(rnd, lang) for _ in range(rnd.randint(3, 12)))
        label, held = lang, [lang]
        if d % 9 == 0:
            label = rnd.choice([x for x in TEMPLATES if x != lang])
        elif d % 9 == 1:
            label = rnd.choice([None, "", "und", "??"])
        elif d % 9 == 2:
            other = rnd.choice([x for x in TEMPLATES if x != lang])
            body += "\n\n" + " ".join(sentence(rnd, other) for _ in range(2))
            held = sorted([lang, other])
        elif d % 9 == 3:
            label = {"en": "en-GB", "de": "German", "fr": "fra", "ru": "RU", "zh": "zh_CN"}[lang]
        if d % 9 in (0, 1, 2):
            truth[d] = held
        rows.append((d, body, label, 1))
    rows += [(900, "2020 | 1,234 | 5.6%\n2021 | 2 | 7.0%", "de", 1), (901, None, None, 1), (902, "", "en", 1), (903, "“Perspectives et risques”. " + " ".join(sentence(rnd, "en") for _ in range(4)), "en", 1)]
    truth |= {900: ["und"], 902: ["und"]}
    return rows, truth


def test_mislabelled(spark, corpus):
    rows, truth = corpus
    d = spark.createDataFrame(rows + [(None, "x", "en", 1)], "doc_id bigint, text string, lang string, languages int")
    checked = spark.createDataFrame([(1, "en")], "doc_id bigint, lang string").limit(0)
    samples = languages.fit(d, checked)
    assert set(samples) == set(TEMPLATES)
    got = {}
    for r in languages.mislabelled(languages.labels(d, samples)).collect():
        got.setdefault(r.doc_id, []).append(r.lang)
    assert {k: sorted(v) for k, v in got.items()} == truth
    text = {r[0]: r[1] for r in rows}
    seg = languages.segments(d, samples).collect()
    for k, t in text.items():
        mine = sorted((r.char_start, r.char_end) for r in seg if r.doc_id == k)
        if t is not None:
            assert mine[0][0] == 0 and mine[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
    assert all(0 <= r.confidence <= 1 for r in seg)
    empty = languages.labels(d, {})
    assert {r.lang for r in empty.select("lang").distinct().collect()} == {"und"}
    assert languages.fit(d.limit(0)) == {} and languages.mislabelled(languages.labels(d.limit(0), samples)).count() == 0


def held(text):
    got = list(languages.sentences(text))
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    return [" ".join(x[2][1]) for x in got if x[2]]


def test_quoted_sentences_count_and_titles_do_not():
    french = "nous avons vendu toutes nos usines"
    for a, b in ("“”", "„“", "«»", '""'):
        assert held(f"The chair spoke first. {a}Nous avons vendu toutes nos usines.{b} The meeting closed at noon.") == ["the chair spoke first", french, "the meeting closed at noon"]
        assert held(f"The chair told all of them: {a}Nous avons vendu toutes nos usines.{b}") == ["the chair told all of them", french]
        assert held(f"The book {a}Nous avons vendu{b} sold well in May.") == ["the book sold well in may"]
    assert held("He read “Quo vadis?” on the train home.") == ["on the train home"]
    assert held('"We sold all of our plants." "Did you really sell them?"') == ["we sold all of our plants", "did you really sell them"]


def test_words_and_closing_marks_of_other_scripts():
    assert held("यह मेरी किताब है। वह कल घर आएंगे॥") == ["यह मेरी किताब है", "वह कल घर आएंगे"]
    assert held("یہ میری کتاب ہے۔ هل قرأت هذا الكتاب؟") == ["یہ میری کتاب ہے", "هل قرأت هذا الكتاب"]
    assert held("Πού πάμε όλοι αύριο; Δεν ξέρω τίποτα.") == ["πού πάμε όλοι αύριο", "δεν ξέρω τίποτα"]
    assert held("কাল আমরা বাড়ি যাব।") == ["কাল আমরা বাড়ি যাব"]
    assert held("a; b à c; d.") == []


def test_label_notations():
    assert [languages.code_of(x) for x in ("en", "EN", "eng", "English", "en_IN", "en-GB", "Deutsch", "ger", " fr ", "pt-BR", "Français")] == ["en"] * 6 + ["de", "de", "fr", "pt", "fr"]
    assert [languages.code_of(x) for x in (None, "", "und", "??", "xx", "unknown", "n/a")] == [None] * 7
    assert languages.code_of("klingon") == "klingon"


def test_undetermined_is_right_for_figures_and_capitals_tell_nothing(spark, corpus):
    rows, _ = corpus
    figures = "2020 | 1,234 | 5.6%\n2021 | 2 | 7.0%"
    rnd = random.Random(8)
    d = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    samples = languages.fit(d)
    more = [(1, figures, "und"), (2, figures, " UND "), (3, figures, None), (4, figures, "fr"), (5, " ".join(sentence(rnd, "en") for _ in range(3)), "und")]
    more += [(100 + k, " ".join(sentence(rnd, lang) for _ in range(3)).upper(), lang) for k, lang in enumerate(list(TEMPLATES) * 8)]
    got = languages.mislabelled(languages.labels(spark.createDataFrame(more, "doc_id bigint, text string, lang string"), samples)).collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(3, "und"), (4, "und"), (5, "en")]


def test_margin_is_over_all_languages():
    rnd = random.Random(9)
    c = languages.Classifier({lang: [sentence(rnd, lang).lower() for _ in range(60)] for lang in TEMPLATES})
    asked = [languages._whole(sentence(rnd, lang)) for lang in TEMPLATES for _ in range(20)]
    got, margin = c.best(asked)
    for s, lang, m in zip(asked, got, margin):
        data = s[0].encode()
        sizes = {level: sorted((max(len(f(data)) - 6, 1), code) for f, code in zip(held, c.codes)) for level, held in (("quick", c.quick), ("fine", c.fine))}
        share = {k: (v[1][0] - v[0][0]) / v[0][0] for k, v in sizes.items()}
        level = "fine" if share["quick"] < languages.CLOSE else "quick"
        assert m == share[level] and lang in {x for n, x in sizes[level] if n == sizes[level][0][0]}


def test_look_alikes_of_more_scripts_and_all_planes():
    pairs = {"νοvα": "vova", "ραpa": "papa", "ӀBM": "IBM", "Үork": "York", "օffice": "office", "ᎠᎪᏟ": "DAC", "ꓓꓮꓚ": "DAC", "\U0002f800": "丽", "\U0001109a": "\U00011099\U000110ba", "\U0001d7ce": "0", "한국": "한국"}
    for a, b in pairs.items():
        one, two = glyphs.fold_texts([a, b])
        assert one == two, (a, b)
    assert glyphs.fold_texts(["к", "π", "λ", "é", "E", "²"]) == ["к", "π", "λ", "é", "E", "²"]
    h, owner, _ = leaks.words(["한국 2", "한국 2"])
    assert h[0] == h[2] and h[1] == h[3] and owner.tolist() == [0, 0, 1, 1]


def test_many_blocks_give_what_one_gives(spark, monkeypatch):
    rnd = random.Random(12)
    text = lambda n: " ".join(f"w{rnd.randrange(300)}" for _ in range(n))
    items = [(k, text(30)) for k in range(40)]
    docs = [(d, f"{text(40)} {' '.join(items[d % 40][1].split()[5:25])} {text(9)}" if d % 2 else text(60)) for d in range(100)]
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for least in (1.0, 0.8):
        one = sorted(map(tuple, leaks.leaks(dd, ii, least=least).collect()))
        with monkeypatch.context() as m:
            m.setattr(leaks, "BLOCK_CHARS", 700)
            m.setattr(leaks, "PARTS_TOGETHER", 2)
            assert sorted(map(tuple, leaks.leaks(dd, ii, least=least).collect())) == one and len(one) >= 50
