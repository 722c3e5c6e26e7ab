"""Evaluation passages inside a corpus (problem 9).

Words are runs of letters and digits of the consistent text form (``glyphs``) in lower case.  Every
window of ``WINDOW`` words, of items and corpus alike, gets a SimHash: each of its 64 bits is the
majority of that bit over the window's word hashes.  A corpus window and an item window within the
Hamming radius agree in at least one of radius + 1 blocks of bits, so looking every block up in an
index of the items' blocks finds them all.  Candidates are verified by the weighted similarity of
their five-word shingles.  Where a passage counts only if its words are the item's, an exact check
follows; windows of the same words have the same SimHash and the same shingles, so it misses none.

Near copies have no such radius: one edge word of fifteen flips about seven bits.  Their candidates
come from the five-word shingles themselves.  Shared shingles weigh at least ``least`` of a window's,
so any of its shingles that weigh more than the rest together hold a shared one: the shingles that
fewest items have are looked up until they do, and no pair is missed.

A window is as long as the shortest passage that counts, so any longer passage holds one.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from groundstone.llm.glyphs import fold, parts

WINDOW, RADIUS, SHINGLE, SIMILAR = 15, 3, 5, 0.8
#: Items are the query set: they are sent to the tasks in blocks of at most so many characters.
BLOCK_CHARS = 4_000_000
#: Parts of documents (of a million characters) that go through the blocks together, if there are several.
PARTS_TOGETHER = 8
#: Words that are fingerprinted at a time.
_CHUNK = 1 << 15
_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of every code point of the first planes, and whether it is a letter or digit."""
    lower, alnum = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for cp in [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x32000)]:
        ch = chr(cp)
        low = ch.lower()
        if len(low) == 1:
            lower[cp] = ord(low)
        alnum[cp] = ch.isalnum() or unicodedata.category(ch) in ("Mn", "Mc")
    return lower, alnum


class Powers:
    """Powers that grow on demand."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, _BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, inverse, np.uint64)]))


_POWERS = Powers()


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, text each belongs to, its length) for a batch of texts."""
    flat, at = fold(texts)
    lower, alnum = _tables()
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    flat = lower[flat]
    is_word = alnum[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], is_word[:-1]])
    start = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.concatenate([is_word[1:], [False]])
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    _POWERS.upto(len(flat))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(flat)])])
    h = (total[end] - total[start]) * _POWERS.down[start]
    h ^= (end - start).astype(np.uint64) << np.uint64(56)
    for shift, mul in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(mul)
    h ^= h >> np.uint64(33)
    owner = np.searchsorted(at, start, "right") - 1
    return h, owner.astype(np.int32), end - start


def fingerprints(h: np.ndarray, window: int) -> np.ndarray:
    """SimHash of the window that starts at each word (the last window - 1 words have none)."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, _CHUNK):
        part = h[a : min(a + _CHUNK, n) + window - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        run = np.zeros((len(part) + 1, 64), np.uint16)
        np.cumsum(bits, axis=0, dtype=np.uint16, out=run[1:])
        ones = (run[window:] - run[:-window]) * 2 > window
        out[a : a + len(ones)] = np.packbits(ones, axis=1).view(np.uint64).ravel()
    return out


def same_text(owner: np.ndarray, window: int) -> np.ndarray:
    """Starts of windows that lie in one text."""
    n = len(owner) - window + 1
    return np.flatnonzero(owner[:n] == owner[window - 1 :]) if n > 0 else np.zeros(0, np.int64)


class BlockIndex:
    """Item windows by each of radius + 1 blocks of their fingerprint's bits."""

    def __init__(self, ids: list[int], texts: list[str], window: int, radius: int):
        self.window, self.radius = window, radius
        self.h, owner, self.length = words(texts)
        self.at = same_text(owner, window)
        self.ids = np.array(ids, np.int64)[owner[self.at]] if len(self.at) else np.zeros(0, np.int64)
        self.prints = fingerprints(self.h, window)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.key, self.weight = shingles(self.h, self.length)
        edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
        self.blocks = []
        for lo, hi in zip(edges, edges[1:]):
            value = self.block(self.prints, lo, hi)
            order = np.argsort(value, kind="stable")
            self.blocks.append((lo, hi, value[order], order))

    @staticmethod
    def block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return prints << np.uint64(lo) >> np.uint64(64 - (hi - lo)) if hi - lo < 64 else prints

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into prints, item window) of all pairs within the radius; a pair may come again."""
        for lo, hi, value, order in self.blocks:
            if not len(value):
                return
            for a in range(0, len(prints), 1 << 18):
                mine = self.block(prints[a : a + (1 << 18)], lo, hi)
                left, right = np.searchsorted(value, mine, "left"), np.searchsorted(value, mine, "right")
                hit = np.flatnonzero(right > left)
                n = right[hit] - left[hit]
                who = np.repeat(hit, n)
                pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left[hit], n)
                item = order[pos]
                near = np.bitwise_count(prints[a + who] ^ self.prints[item]) <= self.radius
                yield a + who[near], item[near]


def _matches(index: BlockIndex | ShingleIndex, h: np.ndarray, length: np.ndarray, at: np.ndarray, prints: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, item window, weighted share of five-word shingles) of verified candidates.

    With ``least`` 1 a verified candidate must also have the same words in the same order.
    """
    if least < 1:
        yield from index.near(h, length, at, least)
        return
    words_of, cells_of = np.arange(index.window), np.arange(max(index.window - SHINGLE + 1, 0))
    key = weight = None
    for who, item in index.candidates(prints):
        if len(who) and key is None:
            key, weight = shingles(h, length)
        for k in range(0, len(who), 1 << 14):
            w, i = who[k : k + (1 << 14)], item[k : k + (1 << 14)]
            a, b = at[w], index.at[i]
            mine, theirs = a[:, None] + cells_of, b[:, None] + cells_of
            share = _shingle_share(key[mine], _once(key[mine], weight[mine]), index.key[theirs], _once(index.key[theirs], index.weight[theirs]))
            near = np.flatnonzero(share >= SIMILAR)
            same = near[(h[a[near][:, None] + words_of] == index.h[b[near][:, None] + words_of]).all(1)]
            yield w[same], i[same], share[same]


def shingles(h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, characters) of the five-word shingle that starts at each word, over ends of texts too."""
    n = max(len(h) - SHINGLE + 1, 0)
    key, weight = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for j in range(SHINGLE):
        key = key * np.uint64(_BASE) + h[j : j + n]
        weight += length[j : j + n]
    return key, weight


def _once(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of rows of shingles, 0 for one that stands in its row before."""
    before = np.tri(key.shape[1], k=-1, dtype=bool)
    return np.where(((key[:, :, None] == key[:, None, :]) & before).any(2), 0, weight)


class ShingleIndex:
    """Item windows by their five-word shingles."""

    def __init__(self, ids: list[int], texts: list[str], window: int):
        self.window = window
        h, owner, length = words(texts)
        self.at = same_text(owner, window)
        self.ids = np.array(ids, np.int64)[owner[self.at]] if len(self.at) else np.zeros(0, np.int64)
        self.key, self.weight = shingles(h, length)
        # every shingle of every window, so that a lookup gives windows
        held = self.key[self.at[:, None] + np.arange(window - SHINGLE + 1)].ravel()
        order = np.argsort(held, kind="stable")
        self.windows = order // (window - SHINGLE + 1)
        self.keys, self.first, self.many = np.unique(held[order], return_index=True, return_counts=True)

    def found(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in keys, how many item windows hold it) of shingles."""
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return place, np.where(self.keys[place] == key, self.many[place], 0)

    def near(self, h: np.ndarray, length: np.ndarray, at: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(index into at, item window, share) of all pairs whose share of shingles reaches ``least``."""
        if not len(self.at) or not len(at):
            return
        size = self.window - SHINGLE + 1
        step = np.arange(size)
        key, weight = shingles(h, length)
        place, many = self.found(key)
        # shares that can't be reached go by sums over runs; a window that repeats a shingle, which counts once, stays
        known, total = (np.concatenate([[0], np.cumsum(v)]) for v in (weight * (many > 0), weight))
        enough = known[at + size] - known[at] >= (least - 1e-9) * (total[at + size] - total[at])
        again = np.zeros(len(key), bool)
        for d in range(1, size):
            again[d:] |= key[d:] == key[:-d]
        held = [np.concatenate([[0], np.cumsum(v)]) for v in (many > 0, again)]
        some, repeats = (c[at + size] > c[at] for c in held)
        live = np.flatnonzero(some & (enough | repeats))
        for k in range(0, len(live), 1 << 14):
            who = live[k : k + (1 << 14)]
            cell = at[who][:, None] + step
            own = _once(key[cell], weight[cell])
            n = np.where(own > 0, many[cell], 0)
            rare = np.argsort(n, axis=1, kind="stable")
            sorted_own = np.take_along_axis(own, rare, 1)
            before = np.cumsum(sorted_own, axis=1) - sorted_own
            look = np.zeros(cell.shape, bool)
            np.put_along_axis(look, rare, before <= (1 - least + 1e-9) * own.sum(1)[:, None], 1)
            row, col = np.nonzero(look & (n > 0))
            yield from self._verified(who, key[cell], own, row, place[cell][row, col], n[row, col], least)

    def _verified(self, who: np.ndarray, key: np.ndarray, own: np.ndarray, row: np.ndarray, place: np.ndarray, n: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs of rows and of the item windows that hold a shingle looked up, if they are near; a pair may come again."""
        step = np.arange(self.window - SHINGLE + 1)
        ends = np.cumsum(n)
        # lookups that give many windows are taken in parts
        for a in range(0, int(n.sum()), 1 << 16):
            pos = np.arange(a, min(a + (1 << 16), int(ends[-1])))
            hit = np.searchsorted(ends, pos, "right")
            item = self.windows[self.first[place[hit]] + pos - (ends - n)[hit]]
            pair = np.unique(row[hit] * len(self.at) + item)
            r, item = pair // len(self.at), pair % len(self.at)
            cell = self.at[item][:, None] + step
            share = _shingle_share(key[r], own[r], self.key[cell], _once(self.key[cell], self.weight[cell]))
            ok = share >= least
            yield who[r[ok]], item[ok], share[ok]


def _shingle_share(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of five-word shingles, each weighing as many as it has characters."""
    shared = (wa * (a[:, :, None] == b[:, None, :]).any(2)).sum(1)
    return shared / np.maximum(wa.sum(1) + wb.sum(1) - shared, 1e-9)


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, radius: int = RADIUS, least: float = 1.0) -> DataFrame:
    """item_id, doc_id, windows and similarity: which items are in which documents.

    ``windows`` counts the document's windows that match the item, ``similarity`` is the best of
    them.  With ``least`` 1 a match is a window of the same words; below 1, any whose weighted
    shingle similarity reaches it, whatever the radius.  Null and empty texts, and items
    shorter than the window, match nothing.  Items and documents given twice count once in pairs.
    Items are the query set: they are sent out in blocks of bounded size, which the driver holds one
    at a time, and every task takes its documents through all of them in one scan.
    """
    spark = documents.sparkSession
    item_rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").dropDuplicates(["item_id"])
    size = item_rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    shared = []
    for k in range(blocks):
        rows = sorted((r.item_id, r.text) for r in item_rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect())
        shared.append(spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows])))
    together = 1 if blocks == 1 else PARTS_TOGETHER

    def fingerprinted(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for first, last in parts(batch.text.str.len().tolist()):
                h, owner, length = words(batch.text.iloc[first:last].tolist())
                at = same_text(owner, window)
                if len(at):
                    yield batch.doc_id.to_numpy()[first:last], h, owner, length, at, fingerprints(h, window)[at] if least >= 1 else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def built(k: int) -> BlockIndex | ShingleIndex:
            return BlockIndex(*shared[k].value, window, radius) if least >= 1 else ShingleIndex(*shared[k].value, window)

        only = built(0) if blocks == 1 else None
        texts_ahead = fingerprinted(batches)
        while held := list(islice(texts_ahead, together)):
            for k in range(blocks):
                index = only or built(k)
                for doc, h, owner, length, at, prints in held if len(index.at) else ():
                    got = [(at[who], index.ids[item], share) for who, item, share in _matches(index, h, length, at, prints, least) if len(who)]
                    if not got:
                        continue
                    pos, item, share = (np.concatenate([g[i] for g in got]) for i in range(3))
                    found = pd.DataFrame({"item_id": item, "doc_id": doc[owner[pos]], "pos": pos, "similarity": share})
                    found = found.groupby(["item_id", "doc_id", "pos"], as_index=False).similarity.max()
                    yield found.groupby(["item_id", "doc_id"], as_index=False).agg(windows=("pos", "size"), similarity=("similarity", "max"))

    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = texts.mapInPandas(run, "item_id bigint, doc_id bigint, windows bigint, similarity double")
    return out.groupBy("item_id", "doc_id").agg(F.max("windows").alias("windows"), F.max("similarity").alias("similarity"))
