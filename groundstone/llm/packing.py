"""Texts packed into containers of fixed capacity in tokens (problem 8).

The plan is made on the histogram of lengths, whose size the capacity bounds: shallow combinations
of length classes that fill a window are enumerated, non-negative least squares solve how often to
repeat each, the counts are rounded down to what the histogram allows, and what is left is packed
greedily, best fit first, again on the histogram.  Every text then finds its container from its
length class and its rank among the texts of that class; ranks are prefix sums over small cells, so
a length that a third of all texts have is no hot key.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from groundstone.session import cut

CAPACITY = 2_048
#: Lengths are planned in steps of so many tokens; a container loses less than a step per text.
QUANTUM = 8
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how that vocabulary splits text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The vocabulary is sent to every task; a larger file is refused.
MAX_VOCABULARY = 64 << 20
ROWS_PER_CELL = 50_000


@cache
def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every text; null and empty texts have none (0)."""
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError("the vocabulary file is too large")
    shared = texts.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(shared.value).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "n_tokens": [len(encode(t)) if t else 0 for t in b.text]})

    return texts.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_tokens bigint")


def combinations(bins: int, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of up to three length classes (0 for none) and how often each is taken: those of three
    texts or fewer that fill a window of ``bins`` exactly, plus every class repeated as often as it
    fits, three times or more, with the largest class that fits into the rest."""
    here = np.flatnonzero(present)
    out = []
    for a in here[here > 0]:
        if a == bins:
            out.append((a, 0, 0))
        if bins - a <= a and bins - a > 0 and present[bins - a]:
            out.append((a, bins - a, 0))
        b = here[(here <= a) & (here > 0)]
        c = bins - a - b
        ok = (c > 0) & (c <= b)
        ok[ok] &= present[c[ok]]
        out += [(a, x, y) for x, y in zip(b[ok].tolist(), c[ok].tolist())]
    once = len(out)
    repeated = [(a, bins // a) for a in here[here > 0].tolist() if bins // a > 2]
    out += [(a, int(here[np.searchsorted(here, bins - a * n, "right") - 1]) if bins - a * n >= here[0] else 0, 0) for a, n in repeated]
    columns = np.array(out, np.int64).reshape(-1, 3)
    times = np.ones_like(columns)
    times[once:, 0] = [n for _, n in repeated]
    return columns, times


def solve(columns: np.ndarray, wanted: np.ndarray, weight: np.ndarray, rounds: int = 2_000, times: np.ndarray | None = None) -> np.ndarray:
    """Non-negative least squares by active sets: how often to repeat each combination.

    ``columns`` has one row of classes per combination; a class counts as often as it occurs, each
    time as often as ``times`` says (once by default).
    """
    times = np.ones_like(columns) if times is None else times
    n, m = len(columns), len(wanted)
    x = np.zeros(n)
    if not n:
        return x
    target = wanted * weight
    active: list[int] = []
    a = np.zeros((m, 0))

    def gradient(r: np.ndarray) -> np.ndarray:
        rw = np.append(r * weight, 0.0)
        rw[0] = 0.0
        return (rw[columns] * times).sum(1)

    residual = target.copy()
    scale = max(1.0, float(np.abs(target).max()))
    used = np.zeros(n, bool)
    for _ in range(rounds):
        g = gradient(residual)
        g[used] = -1
        k = int(g.argmax())
        if g[k] <= 1e-7 * scale * float(weight.max()):
            break
        used[k] = True
        active.append(k)
        col = np.zeros(m)
        for c, n_c in zip(columns[k], times[k]):
            if c:
                col[c] += weight[c] * n_c
        a = np.column_stack([a, col])
        while True:
            z, *_ = np.linalg.lstsq(a, target, rcond=None)
            if (z > 1e-9).all():
                x[active] = z
                break
            now = x[active]
            bad = z <= 1e-9
            step = float(np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-12)))
            now = now + step * (z - now)
            keep = now > 1e-9
            if keep.all():
                keep[np.flatnonzero(bad)[0]] = False
            x[active] = 0
            for i in np.flatnonzero(~keep):
                used[active[i]] = len(active) - 1 == i  # the newest may not come back at once
            active = [k for k, ok in zip(active, keep) if ok]
            a = a[:, keep]
            x[active] = now[keep]
            if not active:
                break
        residual = target - (a @ x[active] if active else 0)
    return x


def plan(histogram: np.ndarray, bins: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((class, how many), ...) with how many containers have each; every text is in one."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []
    columns, times = combinations(bins, left > 0)
    weight = np.sqrt(np.arange(bins + 1, dtype=float))
    x = solve(columns, left.astype(float), weight, times=times)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        need = np.zeros(bins + 1, np.int64)
        np.add.at(need, columns[k], times[k])
        classes = np.flatnonzero(need[1:]) + 1
        many = need[classes]
        n = int(min(round(x[k]), (left[classes] // many).min()))
        if n > 0:
            left[classes] -= many * n
            out.append((tuple(zip(classes.tolist(), many.tolist())), n))
    # the residual: longest first into the fullest container that still has room
    room: dict[int, dict[tuple[tuple[int, int], ...], int]] = defaultdict(dict)
    for size in range(bins, 0, -1):
        need = int(left[size])
        while need:
            space = next((s for s in range(size, bins) if room.get(s)), bins)
            if space == bins:
                each = min(bins // size, need)
                n = need // each
                pattern, n = ((size, each),), n
            else:
                pattern, n = next(iter(room[space].items()))
                each = min(space // size, need)
                n = min(n, need // each)
                rest = room[space].pop(pattern) - n
                if rest:
                    room[space][pattern] = rest
                if not room[space]:
                    del room[space]
                pattern = (*pattern, (size, each))
            need -= each * n
            free = space - size * each
            room[free][pattern] = room[free].get(pattern, 0) + n
    out += [(p, n) for held in room.values() for p, n in held.items()]
    return out


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (class << 40 | first rank), texts per container, and the first container."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, n in patterns:
        for c, many in pattern:
            rows.append((c << 40 | taken[c], many, base))
            taken[c] += many * n
        base += n
    rows.sort()
    keys, many, first = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    return keys, many, first


def containers(texts: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, quantum: int = QUANTUM) -> DataFrame:
    """doc_id, piece, token_start, n_tokens and container_id of every text.

    A text over the capacity is split: full pieces have a container each (``F<doc_id>-<piece>``),
    its rest is packed like any other text (``P<number>``).  Texts without tokens have one row and a
    null container.  A doc_id given twice counts once, with its longer text; null ids give no row.
    """
    spark = texts.sparkSession
    counted = cut(token_counts(texts, vocabulary).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    n = counted.count()
    cells = max(1, n // ROWS_PER_CELL)
    full = F.floor(F.col("n_tokens") / capacity).cast("int")
    parts = counted.select("doc_id", F.explode(F.sequence(F.lit(0), F.when(F.col("n_tokens") % capacity == 0, F.greatest(full - 1, F.lit(0))).otherwise(full))).alias("piece"), "n_tokens")
    parts = parts.select("doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"))
    whole = parts.where(f"n_tokens = {capacity}").withColumn("container_id", F.concat(F.lit("F"), "doc_id", F.lit("-"), "piece"))
    empty = parts.where("n_tokens <= 0").withColumn("container_id", F.lit(None).cast("string"))
    bins = capacity // quantum
    rest = parts.where(f"n_tokens > 0 and n_tokens < {capacity}")
    rest = rest.withColumn("class", F.ceil(F.col("n_tokens") / quantum).cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int"))
    counts = cut(rest.groupBy("class", "cell").agg(F.count("*").alias("n")), "length-cells")
    histogram = np.zeros(bins + 1, np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most one row per class
        histogram[min(r["class"], bins)] += r.n
    keys, many, first = slots(plan(histogram, bins))
    before = counts.select("class", "cell", (F.sum("n").over(Window.partitionBy("class").orderBy("cell")) - F.col("n")).alias("before"))
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("class", "cell").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["class", "cell"]).withColumn("rank", F.col("rank") + F.col("before"))
    shared = spark.sparkContext.broadcast((keys, many, first))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, many, first = shared.value
        for b in batches:
            key = b["class"].to_numpy(np.int64) << 40 | b["rank"].to_numpy(np.int64)
            i = np.searchsorted(keys, key, "right") - 1
            box = first[i] + (key - keys[i]) // many[i]
            yield b[["doc_id", "piece", "token_start", "n_tokens"]].assign(container_id=[f"P{x}" for x in box.tolist()])

    packed = ranked.mapInPandas(assign, "doc_id bigint, piece int, token_start bigint, n_tokens bigint, container_id string")
    return packed.unionByName(whole).unionByName(empty)


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens and the share of the containers that is filled."""
    boxes = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), (F.sum("t") / (F.count("*") * capacity)).alias("filled"))
