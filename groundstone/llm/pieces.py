"""Pages cut into overlapping pieces at natural boundaries, and the audit of stored cuts (problem 6).

A page becomes sorted arrays of offsets: where its runs of non-space characters start and end
(prefix sums of their lengths and gaps), and which ends close a sentence or a paragraph.  The
cutter looks the last boundary under the limit up by binary search, steps back by the overlap to a
run's start, and cuts hard only inside a run that is itself longer than the limit.  The audit reads
stored pieces against the same arrays.  Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT, LEAST_SHARED, MOST_SHARED = 1_200, 100, 220

_RUN = re.compile(r"\S+")
_CLOSES = re.compile(r"[.!?।。！？…][\"'”’)\]»]*$")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")


@dataclass
class Boundaries:
    """Sorted offsets of one text."""

    size: int
    starts: np.ndarray
    ends: np.ndarray
    sentence: np.ndarray  # of each run: does it close a sentence?
    paragraph: np.ndarray  # of each run: does a blank line, or the text's end, follow?

    def inside_run(self, at: np.ndarray, limit: int) -> np.ndarray:
        """Does a position fall inside a run that isn't longer than the limit?"""
        if not len(self.starts):
            return np.zeros(len(at), bool)
        k = np.maximum(np.searchsorted(self.starts, at, "left") - 1, 0)
        return (self.starts[k] < at) & (at < self.ends[k]) & (self.ends[k] - self.starts[k] <= limit)


def boundaries(text: str) -> Boundaries:
    runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
    starts, ends = (np.array([r[i] for r in runs], np.int64) for i in (0, 1))
    sentence = np.array([bool(_CLOSES.search(text, max(a, b - 6), b)) for a, b in runs], bool)
    paragraph = np.zeros(len(runs), bool)
    if runs:
        for m in _BLANK_LINE.finditer(text):
            k = int(np.searchsorted(ends, m.start(), "right")) - 1
            if k >= 0:
                paragraph[k] = True
        paragraph[-1] = True
    return Boundaries(len(text), starts, ends, sentence, paragraph)


def cut_page(text: str, limit: int = LIMIT, least: int = LEAST_SHARED, most: int = MOST_SHARED) -> list[tuple[int, int]]:
    """Pieces (start, end) of a text: at most ``limit`` long, sharing ``least`` to ``most`` characters.

    A text within the limit is one piece; a text of white space only has none.  An end counts only
    if a run starts ``least`` to ``most`` before it (or a longer run than the limit lies there), so
    that the next piece can begin between words.  Paragraph ends go before sentence ends, and these
    before word ends, as long as the piece is filled to half.  Where runs are so long that no cut
    shares enough without splitting one, words stay whole and the overlap gives way.
    """
    b = boundaries(text)
    if not len(b.starts):
        return []
    long_run = b.ends - b.starts > limit
    pieces: list[tuple[int, int]] = []
    start, last = int(b.starts[0]), int(b.ends[-1])
    # an end is good if some run starts within the overlap before it
    good = np.searchsorted(b.starts, b.ends - least, "right") > np.searchsorted(b.starts, b.ends - most, "left")
    while True:
        if last - start <= limit:
            pieces.append((start, last))
            return pieces
        lo, hi = np.searchsorted(b.ends, start + most, "right"), np.searchsorted(b.ends, start + limit, "right")
        run = int(np.searchsorted(b.starts, start + limit, "left")) - 1
        end = None
        if run >= 0 and long_run[run] and b.starts[run] <= max(start, start + limit - 2 * most):
            end = start + limit  # inside a run longer than the limit
        else:
            half = np.searchsorted(b.ends, start + limit // 2, "right")
            for mask, first in ((b.paragraph, half), (b.sentence, half), (None, lo)):
                ok = good[first:hi] if mask is None else good[first:hi] & mask[first:hi]
                hit = np.flatnonzero(ok)
                if len(hit):
                    end = int(b.ends[first + hit[-1]])
                    break
            if end is None:
                end = int(b.ends[hi - 1]) if hi > 0 and b.ends[hi - 1] > start else start + limit
        pieces.append((start, end))
        i, j = np.searchsorted(b.starts, end - most, "left"), np.searchsorted(b.starts, end - least, "right")
        run = int(np.searchsorted(b.starts, end - (least + most) // 2, "right")) - 1
        if j > i and b.starts[j - 1] > start:
            choice = [k for k in range(i, j) if k and b.sentence[k - 1] and b.starts[k] > start]
            nxt = int(b.starts[choice[-1] if choice else i if b.starts[i] > start else j - 1])
        elif run >= 0 and long_run[run] and b.ends[run] > end - least and end - (least + most) // 2 > start:
            nxt = end - (least + most) // 2
        else:  # no start shares enough: the nearest one that moves on
            before = np.searchsorted(b.starts, end - least, "right") - 1
            after = int(np.searchsorted(b.starts, end, "left"))
            nxt = int(b.starts[before]) if before >= 0 and b.starts[before] > start and b.starts[before] >= end - limit // 2 else (int(b.starts[after]) if after < len(b.starts) else end)
            if nxt < end and last - nxt > limit and nxt <= start:
                nxt = end
        start = nxt


def unsound(text: str, pieces: list[tuple[int, int]], limit: int = LIMIT, least: int = LEAST_SHARED, most: int = MOST_SHARED) -> bool:
    """Are the pieces (in order) no sound cut of a text longer than the limit?"""
    if not pieces:
        return True
    s, e = (np.array(x, np.int64) for x in zip(*pieces))
    if (e - s > limit).any():
        return True
    shared = np.minimum(e[1:], e[:-1]) - np.maximum(s[1:], s[:-1])
    if ((shared < least) | (shared > most)).any():
        return True
    b = boundaries(text)
    if b.inside_run(np.concatenate([s, e]), limit).any():
        return True
    order = np.argsort(s, kind="stable")
    reach = np.maximum.accumulate(e[order])
    gaps = [(0, int(s[order[0]])), *zip(reach[:-1].tolist(), s[order][1:].tolist()), (int(reach[-1]), len(text))]
    return any(a < z and not text[max(a, 0) : z].isspace() for a, z in gaps if text[max(a, 0) : z])


def pieces_of(pages: DataFrame, limit: int = LIMIT, least: int = LEAST_SHARED, most: int = MOST_SHARED) -> DataFrame:
    """page_id, ordinal, char_start, char_end and text of the pieces of every page over the limit.

    Null texts and pages within the limit give no rows; a page delivered twice counts once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, n, s, e, t[s:e]) for i, t in zip(b.id, b.text) for n, (s, e) in enumerate(cut_page(t, limit, least, most))]
            yield pd.DataFrame(out, columns=["page_id", "ordinal", "char_start", "char_end", "text"])

    long = pages.where(F.length("text") > limit).select("id", "text").dropDuplicates(["id"])
    return long.mapInPandas(run, "page_id string, ordinal int, char_start int, char_end int, text string")


def unsound_pages(pages: DataFrame, chunks: DataFrame, limit: int = LIMIT, least: int = LEAST_SHARED, most: int = MOST_SHARED) -> DataFrame:
    """Ids of pages over the limit whose stored retrieval pieces are neither the cutter's nor another
    sound cut.

    Pages and pieces are brought together by one shuffle and sorted by page, then ordinal, so that a
    task streams over them: a page's text comes first, its pieces follow in order.  Nothing is
    collected per page but its offsets.  A piece without offsets counts as none.  Rows delivered
    twice stand together and count once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, text, held, seen = None, None, [], None
        found: list[str] = []

        def done() -> None:
            # pieces that are the cutter's own need no audit; any others may still be a sound cut
            if text is not None and held != cut_page(text, limit, least, most) and unsound(text, held, limit, least, most):
                found.append(page)

        for b in batches:
            for p, t, c, s, e in zip(b.page_id, b.text, b.chunk_id, b.s.tolist(), b.e.tolist()):
                if p != page:
                    done()
                    page, text, held, seen = p, None, [], None
                if c == "":
                    text = t
                elif c != seen and text is not None:
                    seen = c
                    held.append((int(s), int(e)))
            if found:
                yield pd.DataFrame({"page_id": found})
                found.clear()
        done()
        yield pd.DataFrame({"page_id": found}, dtype=object)

    none = F.lit(None).cast("int")
    long = pages.where((F.length("text") > limit) & F.col("id").isNotNull()).select(F.col("id").alias("page_id"), "text", F.lit("").alias("chunk_id"), F.lit(-1).alias("ordinal"), F.lit(0).alias("s"), F.lit(0).alias("e"))
    stored = chunks.where("role = 'retrieval' and page_id is not null and char_start is not null and char_end is not null")
    stored = stored.select("page_id", F.lit(None).cast("string").alias("text"), F.coalesce(F.col("id"), F.lit("?")).alias("chunk_id"), F.coalesce(F.col("ordinal").cast("int"), none, F.lit(0)).alias("ordinal"), F.col("char_start").cast("int").alias("s"), F.col("char_end").cast("int").alias("e"))
    both = long.unionByName(stored).repartition("page_id").sortWithinPartitions("page_id", "ordinal", "chunk_id")
    return both.mapInPandas(run, "page_id string").distinct()
