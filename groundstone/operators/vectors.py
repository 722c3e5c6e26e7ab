"""Exact vector search: queries against all vectors, and all pairs across documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from groundstone.options import DEFAULTS, Options

#: A task of ``search`` holds so many queries at most and reads so many vectors at least.
QUERY_ROWS = 65_536
PART_ROWS = 16_384
#: Cosines that a task of ``search`` has at a time, and pairs of which it sums up exact ones.
TILE_PAIRS = 1 << 22
EXACT_PAIRS = 1 << 16
BLOCK_ROWS = 4_096


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def proper(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite numbers that aren't all zero."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return vectors.where((F.size("vector") == dim) & fine)


def search(queries: DataFrame, vectors: DataFrame, k: int = 6, threshold: float = 0.0) -> DataFrame:
    """query_id, fact_id and cosine of the k best vectors of at least ``threshold`` for each query.

    Exact: every block of queries meets every part of the vectors, in a task of its own, which holds
    the queries and reads the vectors batch by batch, so its memory depends on neither's number; it
    hands on its k best of every query.  The work grows with queries times vectors.  A query's own
    fact is left out; ties go to the smaller id.  Both frames, counted first: fact_id (once), vector.
    """
    asked, there = queries.count(), vectors.count()
    blocks = max(-(-asked // QUERY_ROWS), 1)
    # queries go to all parts, their k best come from all: no more of that than of the vectors
    parts = max(min(there // max(2 * asked, 1), there // PART_ROWS), 1)
    of = lambda many: F.pmod(F.xxhash64("fact_id"), F.lit(many)).cast("int")
    row = of(blocks) * parts
    left = queries.select("fact_id", "vector", F.lit(0).alias("side"), F.explode(F.sequence(row, row + (parts - 1))).alias("cell"))
    right = vectors.select("fact_id", "vector", F.lit(1).alias("side"), F.explode(F.sequence(of(parts), of(parts) + (blocks - 1) * parts, F.lit(parts))).alias("cell"))
    spread = left.unionByName(right).repartitionById(blocks * parts, "cell").sortWithinPartitions("side", "fact_id").drop("cell")
    found = spread.mapInPandas(lambda batches: k_best(batches, k, threshold), "query_id string, fact_id string, cosine double")
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "fact_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def k_best(batches: Iterator[pd.DataFrame], k: int, threshold: float) -> Iterator[pd.DataFrame]:
    """One task of ``search``: side, fact_id and vector, queries (side 0) first, both sides by fact_id."""
    asked: list[pd.DataFrame] = []
    best: _Best | None = None
    for b in batches:
        own = b.side.to_numpy() == 0
        if own.any():
            asked.append(b[own])
        if asked and not own.all():
            if best is None:
                queries = pd.concat(asked)
                best = _Best(queries.fact_id.to_numpy(object), _units(queries.vector), k, threshold)
            rest = b[~own]
            best.meet(rest.fact_id.to_numpy(object), _units(rest.vector))
    if best is not None:
        yield best.rows()


class _Best:
    """The k best of every query among the vectors so far, which come by id."""

    def __init__(self, names: np.ndarray, asked: np.ndarray, k: int, threshold: float):
        self.names, self.asked, self.k, self.threshold = names, asked, k, threshold
        self.seen = 0
        #: Query, cosine, place in the order of ids, and id.
        self.kept = (np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0, object))
        #: What a cosine must reach.
        self.least = np.full(len(names), threshold, float)

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        # of equal vectors the first k + 1 are enough, one of which may be a query's own
        same = pd.Series([x.tobytes() for x in v])
        place = np.flatnonzero(same.groupby(same).cumcount().to_numpy() <= self.k)
        v, found = v[place], [self.kept]
        near = {kind: v.T.astype(kind) for kind in (np.float32, np.float64)}
        step = max(TILE_PAIRS // len(v), 1)
        for start in range(0, len(self.names), step):
            a = self.asked[start : start + step]
            i, j = self._likely(a, near, self.least[start : start + step])
            value = _cosines(a, i, v, j)
            fit = np.flatnonzero((value >= self.threshold) & (self.names[start + i] != ids[place[j]]))
            i, j = i[fit], place[j[fit]]
            found.append(self._first(start + i, value[fit], self.seen + j, ids[j]))
        self.seen += len(ids)
        self.kept = self._first(*(np.concatenate(x) for x in zip(*found, strict=True)))
        many = np.bincount(self.kept[0], minlength=len(self.names))
        self.least[many == self.k] = self.kept[1][np.cumsum(many)[many == self.k] - 1]

    def _likely(self, a: np.ndarray, near: dict, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs, none missing, that may be among the k best: by single precision, by double where that leaves many."""
        few = 4 * (self.k + 1) * len(a)
        for kind, v in near.items():
            margin = 2 * (len(v) + 4) * np.finfo(kind).eps  # twice what a sum can be wrong by
            s, low = a.astype(kind) @ v, (least - margin).astype(kind)
            hit = s >= low[:, None]
            if v.shape[1] > self.k and np.count_nonzero(hit) > few:
                hit = s >= np.fmax(low, np.partition(s, -self.k - 1, axis=1)[:, -self.k - 1] - kind(margin))[:, None]
            if np.count_nonzero(hit) <= few:
                break
        return np.nonzero(hit)

    def _first(self, i: np.ndarray, value: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
        """The k best of each query, sorted."""
        order = np.lexsort((rest[0], -value, i))
        first = np.flatnonzero(np.diff(i[order], prepend=-1))
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        return tuple(x[order[rank < self.k]] for x in (i, value, *rest))

    def rows(self) -> pd.DataFrame:
        i, value, _, names = self.kept
        return pd.DataFrame({"query_id": self.names[i], "fact_id": names, "cosine": value})


def _units(vectors: pd.Series) -> np.ndarray:
    """What ``unit`` gives, to the last bit: cumsum adds in order."""
    x = np.stack(vectors.to_numpy()).astype(float)
    norm = np.sqrt(np.cumsum(x * x, axis=1)[:, -1:])
    return x / np.where(norm == 0, 1.0, norm)


def _cosines(a: np.ndarray, i: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs, what ``dot`` gives: a matrix product's last bits depend on a row's place, and equal vectors must tie."""
    cuts = range(0, len(i), EXACT_PAIRS)
    return np.concatenate([np.zeros(0), *(0.0 + np.cumsum(a[i[c : c + EXACT_PAIRS]] * v[j[c : c + EXACT_PAIRS]], axis=1)[:, -1] for c in cuts)])


def cross_document_pairs(vectors: DataFrame, options: Options = DEFAULTS, fresh: DataFrame | None = None) -> DataFrame:
    """fact_a_id < fact_b_id and similarity: pairs across documents of at least the threshold, where
    one is among the other's k best.

    Exact: every block of rows meets every other once, in a task of its own, and each hands on its k
    best of every row only.  The work grows with the square of the collection; the approximate search
    for large collections is another operator.  Columns: fact_id, document_id, vector.

    With ``fresh`` (fact_id) only pairs that have such a fact: they lie in blocks of their own, and
    only pairs of blocks with one of these meet, so the work grows with fresh times all.
    """
    k, threshold = options.candidate_top_k, options.similarity_threshold
    base = vectors.select("fact_id", "document_id", unit(F.col("vector")).alias("v"))
    new = F.lit(True)
    if fresh is not None:
        base = base.join(fresh.select("fact_id").distinct().withColumn("new", F.lit(True)), "fact_id", "left")
        new = F.coalesce("new", F.lit(False))
    n = base.agg(F.count("*").alias("all"), F.count_if(new).alias("new")).first()
    first, rest = -(-n.new // BLOCK_ROWS), -(-(n.all - n.new) // BLOCK_ROWS)
    block = lambda start, many: (F.pmod(F.xxhash64("fact_id"), F.lit(max(many, 1))) + start).cast("int")
    own = F.when(new, block(0, first)).otherwise(block(first, rest))
    # a row goes to every pair of blocks that its own block is in and that has a fresh one
    most = F.when(new, F.lit(first + rest)).otherwise(F.lit(first))
    others = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
    spread = base.withColumn("own", own).withColumn("other", F.explode(others)).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("new")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        x, y = b.x.iloc[0], b.y.iloc[0]
        left, right = b[b.own == x], b[b.own == y]
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "p": [], "similarity": []})
        s = np.stack(left.v.to_numpy()) @ np.stack(right.v.to_numpy()).T
        i, j = np.nonzero(s >= threshold)
        apart = left.document_id.to_numpy()[i] != right.document_id.to_numpy()[j]
        i, j = i[apart], j[apart]
        value, a, c = s[i, j], left.fact_id.to_numpy(), right.fact_id.to_numpy()
        out = [best(i, j, value, a, c)]
        if x != y:
            out.append(best(j, i, value, c, a))
        return pd.concat(out)

    def best(i: np.ndarray, j: np.ndarray, value: np.ndarray, a: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        """The k best of each row; rows come sorted by id, so ties go to the smaller one."""
        order = np.lexsort((j, -value, i))
        i, j, value = i[order], j[order], value[order]
        start = np.flatnonzero(np.diff(i, prepend=-1))
        few = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) < k
        return pd.DataFrame({"q": a[i[few]], "p": c[j[few]], "similarity": value[few]})

    found = spread.groupBy("x", "y").applyInPandas(lambda b: run(b.sort_values("fact_id")), "q string, p string, similarity double")
    best = Window.partitionBy("q").orderBy(F.desc("similarity"), "p")
    kept = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return kept.select(F.least("q", "p").alias("fact_a_id"), F.greatest("q", "p").alias("fact_b_id"), "similarity").groupBy("fact_a_id", "fact_b_id").agg(F.max("similarity").alias("similarity"))
