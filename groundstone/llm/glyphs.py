"""One consistent form for text that looks the same but is coded differently (problem 5).

A batch of texts becomes one array of code points with their positions.  A mapping table, held by
each Python worker, decomposes every code point and replaces look-alikes; combining marks are
ordered by class, recomposed with their base, and the strings are rebuilt.  The tables are made
from Unicode's own data by rule, so none is stored here.

Folded: full-width and half-width forms, ligatures, compatibility letters, canonical equivalents
(combining accents, the Kelvin sign), spaces of any width, invisible characters, hyphens that look
alike, single letters of other scripts that have the shape of a Latin letter.  Kept apart, because
they look different: letter case, accents, superscripts and subscripts, fractions, circled forms,
dashes longer than a hyphen.  White space is collapsed to single spaces and stripped at the ends.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from groundstone.operators.skew import weighed_keys, salted_join

# Single letters with the shape of a Latin letter, by script, and the Latin letters in the same order.
_SHAPED = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТХУԚԜаеорсухѕіјһԁԛԝӀӏҮүѴѵ", "ABESIJKMHOPCTXYQWaeopcyxsijhdqwIlYyVv"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϲοϳαινρυ", "ABEZHIKMNOPTYXCcojaivpu"),
    "Armenian": ("ՕՏԼՍօսհոյցզ", "OSLUouhnjgq"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏔᏕᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZWSVSLCPKB"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Latin": ("ɡɑʏ", "gaY"),
}
LOOK_ALIKES = {x: to for letters, latin in _SHAPED.values() for x, to in zip(letters, latin, strict=True)}
# Hyphens and slashes that look like the plain ones.
LOOK_ALIKES |= dict.fromkeys("‐‑‒−˗﹣", "-") | dict.fromkeys("⁄∕", "/") | {"․": ".", "ː": ":", "∶": ":", "‚": ","}

#: Kinds of compatibility mapping that change how a character looks.
_VISIBLE = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")
#: Letters that show nothing.
_FILLERS = (0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5)
_JAMO = re.compile("[\u1100-\u11ff]")
_TOP = 0x110000
_DROP, _SPACE = 0, 32


def _parts(ch: str) -> str:
    """Full decomposition of one character, look-alikes replaced."""
    if ch.isspace() or unicodedata.category(ch) == "Zs":
        return " "
    kind = unicodedata.category(ch)
    cp = ord(ch)
    if kind in ("Cf", "Cc") or cp == 0x34F or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or cp in _FILLERS or 0xE0000 <= cp <= 0xE0FFF:
        return ""
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    d = unicodedata.decomposition(ch)
    if not d or d.startswith(_VISIBLE) or ch == "ſ":
        return ch
    codes = d.split()
    if codes[0].startswith("<"):
        if 0xAC <= cp <= 0xBF and cp != 0xB5 or ch in "¨¯´¸‗‾":
            return ch  # spacing accents: a space before a mark would change the look
        codes = codes[1:]
    return "".join(_parts(chr(int(c, 16))) for c in codes)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(how many code points each becomes, the first of them, row of the long table, the long table,
    combining class, sorted pairs base and mark with what they compose to: two arrays in one, row of
    the long table that has the character's full decomposition, 0 if it has none)."""
    count, first, row = np.ones(_TOP, np.int8), np.arange(_TOP, dtype=np.uint32), np.zeros(_TOP, np.int32)
    ccc, apart = np.zeros(_TOP, np.uint8), np.zeros(_TOP, np.int32)
    long: list[str] = [""]
    pairs: dict[int, int] = {}
    # all of Unicode but ideographs and syllables, which stand for themselves, and surrogates
    for cp in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)]:
        ch = chr(cp)
        ccc[cp] = unicodedata.combining(ch)
        d = unicodedata.decomposition(ch)
        if not d and unicodedata.category(ch) in ("Lo", "Cn", "Co", "So") and ch not in LOOK_ALIKES and cp not in _FILLERS:
            continue
        if d and d[0] != "<" and " " in d:
            a, b = (int(x, 16) for x in d.split())
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                pairs[a << 21 | b] = cp
        if d and d[0] != "<" and (full := unicodedata.normalize("NFD", ch)) != ch:
            apart[cp] = len(long)
            long.append(full)
        new = unicodedata.normalize("NFC", _parts(ch))
        if new == ch:
            continue
        count[cp] = len(new)
        if len(new) == 1:
            first[cp] = ord(new)
        elif new:
            row[cp] = len(long)
            long.append(new)
    width = max(map(len, long))
    table = np.zeros((len(long), max(width, 1)), np.uint32)
    for i, s in enumerate(long):
        table[i, : len(s)] = [ord(c) for c in s]
    keys = np.array(sorted(pairs), np.int64)
    return count, first, row, table, ccc, np.stack([keys, np.array([pairs[k] for k in keys.tolist()], np.int64)]), apart


def _positioned(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a batch, and the text each belongs to."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])


def _long(flat: np.ndarray, owner: np.ndarray, at: np.ndarray, rows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put rows of the long table in place of the code points at ``at``."""
    size = np.ones(len(flat), np.int64)
    size[at] = (table[rows] != 0).sum(1)
    out = np.repeat(flat, size)
    start = np.cumsum(size)[at] - size[at]
    for j in range(table.shape[1]):
        has = size[at] > j
        out[start[has] + j] = table[rows[has], j]
    return out, np.repeat(owner, size)


def _ordered(flat: np.ndarray, owner: np.ndarray, ccc: np.ndarray) -> None:
    """Sort each run of combining marks by class, stably, in place."""
    marks = np.flatnonzero(ccc[flat])
    if len(marks) < 2:
        return
    run = np.cumsum((np.diff(marks, prepend=-5) != 1) | (np.diff(owner[marks], prepend=-5) != 0))
    flat[marks] = flat[marks[np.lexsort((ccc[flat[marks]], run))]]


def _composed(flat: np.ndarray, owner: np.ndarray, ccc: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Recompose: the n-th mark of every run is tried in the n-th pass."""
    marks = np.flatnonzero(ccc[flat])
    if not len(marks):
        return flat, owner
    flat = flat.copy()
    new = np.flatnonzero((np.diff(marks, prepend=-5) != 1) | (np.diff(owner[marks], prepend=-5) != 0))
    size = np.diff(np.append(new, len(marks)))
    start = marks[new]
    base = start - 1
    ok = (base >= 0) & (owner[np.maximum(base, 0)] == owner[start])
    last = np.zeros(len(start), np.int16)  # class of the last mark that stayed
    gone = np.zeros(len(flat), bool)
    for n in range(int(size.max())):
        live = np.flatnonzero((size > n) & ok)
        at = start[live] + n
        key = flat[base[live]].astype(np.int64) << 21 | flat[at]
        found = np.minimum(np.searchsorted(pairs[0], key), pairs.shape[1] - 1)
        own = ccc[flat[at]].astype(np.int16)
        fits = (pairs[0][found] == key) & (own > last[live])
        flat[base[live[fits]]] = pairs[1][found[fits]].astype(np.uint32)
        gone[at[fits]] = True
        last[live[~fits]] = own[~fits]
    return flat[~gone], owner[~gone]


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the consistent forms of a batch, and where each text starts (n + 1 offsets)."""
    count, first, row, table, ccc, pairs, apart = tables()
    # jamo compose by arithmetic, not by the table
    flat, owner = _positioned([t if t.isascii() or not _JAMO.search(t) else unicodedata.normalize("NFC", t) for t in texts])
    n = count[flat]
    if not (n == 1).all():
        keep = n > 0
        flat, owner, n = flat[keep], owner[keep], n[keep]
    many = np.flatnonzero(n > 1)
    rows = row[flat[many]]
    flat = first[flat]
    if len(many):
        flat, owner = _long(flat, owner, many, rows, table)
    if len(flat) and ccc[flat].any():
        # a composed letter with a further mark is taken apart, so that all its marks are ordered
        marked = np.flatnonzero(ccc[flat][1:].astype(bool) & (apart[flat[:-1]] > 0) & (owner[1:] == owner[:-1]))
        if len(marked):
            flat, owner = _long(flat, owner, marked, apart[flat[marked]], table)
        _ordered(flat, owner, ccc)
        flat, owner = _composed(flat, owner, ccc, pairs)
    space = flat == _SPACE
    if space.any():
        edge = np.flatnonzero(np.diff(owner, prepend=-1))
        before = np.empty(len(flat), bool)
        before[0], before[1:] = True, space[:-1]
        before[edge] = True  # a space at the start of a text goes, as does one after a space
        keep = ~(space & before)
        flat, owner = flat[keep], owner[keep]
        end = np.flatnonzero(np.diff(owner, append=-1))
        keep = np.ones(len(flat), bool)
        keep[end[flat[end] == _SPACE]] = False
        flat, owner = flat[keep], owner[keep]
    return flat, np.searchsorted(owner, np.arange(len(texts) + 1))


def fold_texts(texts: list[str | None]) -> list[str | None]:
    """The consistent form of each text; null stays null, and a text of nothing visible becomes ''."""
    out: list[str | None] = []
    for a, b in parts([len(t) if t else 0 for t in texts]):
        flat, at = fold(["" if t is None else t for t in texts[a:b]])
        whole = flat.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        out += [None if t is None else whole[x:y] for t, x, y in zip(texts[a:b], at[:-1].tolist(), at[1:].tolist())]
    return out


#: Characters that are worked on at a time; one longer text is a part of its own.
PART = 1 << 20


def parts(sizes: list[int]) -> list[tuple[int, int]]:
    """Ranges of texts of at most PART characters together, so that memory doesn't follow a batch's size."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > PART:
            out.append((start, i))
            start, held = i, 0
        held += n
    return [*out, (start, len(sizes))] if sizes else []


def _fold_series(texts: pd.Series) -> pd.Series:
    return pd.Series(fold_texts([None if t is None or t != t else t for t in texts]), dtype=object)


def folded(c: Column | str) -> Column:
    """Column function: the consistent form."""
    return F.pandas_udf(_fold_series, T.StringType())(c)


def _looks_alike():
    """Column function (quote, shown, placed): is the quote's form the slice's, or in the page's?

    One function over all three, so that it runs after the join, on the rows that differ.  A quote
    of nothing visible is in every page and shows nothing.
    """

    def same(quote: pd.Series, shown: pd.Series, placed: pd.Series) -> pd.Series:
        forms = zip(fold_texts(quote.tolist()), fold_texts(shown.tolist()), placed)
        return pd.Series([bool(a) and (a == b if p else a in b) for a, b, p in forms], dtype=bool)

    return F.pandas_udf(same, T.BooleanType())


def plain_spaces(c: Column) -> Column:
    """Runs of plain spaces, tabs and line ends as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "[ \t\r\n]+", " "))


def coded_differently(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Ids of evidence whose quote looks like its page's text but differs from it in characters.

    The page's text is what stands between the offsets, or the whole page if an offset is null.
    Quotes that are equal as they stand are settled by Spark's own expressions and never reach
    Python; only the differing slices do.  Evidence without a quote or without its page is no case.
    An evidence row delivered twice counts once.  One page may hold any share of the evidence: such
    pages are salted.
    """
    key = ["document_id", "pdf_page_index"]
    ev = evidence.where("id is not null and quote is not null and document_id is not null and pdf_page_index is not null")
    ev = ev.select(F.col("id").alias("evidence_id"), *key, "quote", F.col("quote_char_start").alias("s"), F.col("quote_char_end").alias("e"))
    pg = pages.where("text is not null and document_id is not null and pdf_page_index is not null").select(*key, "text")
    heavy = weighed_keys(ev.groupBy(*key).agg(F.count("*").alias("n")), key)
    both = salted_join(ev, pg, key, F.col("evidence_id"), heavy)
    placed = F.col("s").isNotNull() & F.col("e").isNotNull()
    shown = F.when(placed, F.substring("text", F.greatest(F.col("s"), F.lit(0)) + 1, F.greatest(F.col("e") - F.greatest(F.col("s"), F.lit(0)), F.lit(0)))).otherwise(F.col("text"))
    both = both.select("evidence_id", "quote", placed.alias("placed"), shown.alias("shown")).where(F.col("quote") != F.col("shown"))
    quote, shown = plain_spaces(F.col("quote")), plain_spaces(F.col("shown"))
    both = both.where(F.when(F.col("placed"), quote != shown).otherwise(~F.contains(shown, quote)))
    return both.where(_looks_alike()("quote", "shown", "placed")).select("evidence_id").distinct()
