"""The most similar vectors of every vector (problem 4).

Vectors are projected to a few coordinates by a Gaussian (2-stable) random matrix: the squared
projected distance over the squared distance is chi-square distributed with as many degrees of
freedom as there are coordinates.  A kd-tree over the projected coordinates cuts the collection into
cells of bounded rows, and each cell into leaves.  A search takes the leaves in the order of their
projected distance and verifies their vectors by exact cosine, until the chi-square test holds: a
vector still closer than the k-th found (or than the asked least cosine) has a projected distance
beyond the next leaf's with a probability below 1 - STOP only.

Equal vectors are one class: a class is searched once and its members are joined to it afterwards,
so a vector that a third of all rows have costs one search.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from hashlib import blake2b
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from groundstone.operators.skew import salted_join, weighed_keys
from groundstone.session import cut

#: Projected coordinates, and the probability of the stopping test.
PROJECTED, STOP, SEED = 6, 0.90, 20_24
#: Rows of a cell (their number grows with the collection), rows of a leaf, and the queries that
#: search a cell in one task (a cell with more is sent to several tasks).
CELL_ROWS, LEAF_ROWS, QUERY_ROWS = 50_000, 256, 80_000
#: Cells that the first level of the tree has at most, and rows of each sample that fits a level.
TOP_CELLS, SAMPLE_ROWS = 512, 20_000
#: Queries that take their leaves together, and directed pairs held in a task before they are cut
#: back to the k best of each vector.
_TOGETHER, _HELD = 16_384, 2_000_000


def chi_square_quantile(p: float, dof: int) -> float:
    """Exact for one and two degrees of freedom, Wilson and Hilferty's approximation above."""
    if dof == 1:
        return NormalDist().inv_cdf((1 + p) / 2) ** 2
    if dof == 2:
        return -2 * math.log(1 - p)
    c = 2 / (9 * dof)
    return dof * (1 - c + NormalDist().inv_cdf(p) * math.sqrt(c)) ** 3


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTED)).astype(np.float32)


def proper_vectors(table: DataFrame, model: str, dim: int) -> DataFrame:
    """fact_id, class (a digest of the direction) and the unit vector of every proper vector.

    Proper: of the model, with ``dim`` finite numbers that aren't all zero.  Within an Arrow batch
    the vector is sent once per class and null otherwise, so copies are thinned before any shuffle.
    """
    schema = pa.schema([("fact_id", pa.string()), ("class", pa.binary()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(1)
            x = np.asarray(column.flatten().cast(pa.float64()).fill_null(float("nan")), np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            unit = (x[ok] / norm[ok][:, None]).astype(np.float32)
            unit += 0.0  # no negative zeros
            data = [v.tobytes() for v in unit]
            digest = [blake2b(v, digest_size=16).digest() for v in data]
            seen: set[bytes] = set()
            first = [not (d in seen or seen.add(d)) for d in digest]
            ids = b.column(0).filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([ids, pa.array(digest, pa.binary()), pa.array([v if f else None for v, f in zip(data, first)], pa.binary())], schema=schema)

    proper = table.where((F.col("model") == model) & (F.size("vector") == dim) & F.col("fact_id").isNotNull())
    return proper.select("fact_id", F.col("vector").cast("array<float>")).mapInArrow(run, "fact_id string, class binary, vec binary")


class Cells:
    """A kd-tree whose leaves are cells: boxes that cover the projected space."""

    def __init__(self, sample: np.ndarray, count: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # coordinate, value, below, above; leaves are ~cell
        self.count = 0
        self.root = self._split(sample, int(math.log2(count)) if len(sample) >= 2 * count else 0)

    def _split(self, points: np.ndarray, depth: int) -> int:
        if depth == 0 or len(points) < 2:
            self.count += 1
            return ~(self.count - 1)
        c = int(points.std(0).argmax())
        value = float(np.median(points[:, c]))
        me = len(self.nodes)
        self.nodes.append((c, value, 0, 0))
        below = self._split(points[points[:, c] < value], depth - 1)
        self.nodes[me] = (c, value, below, self._split(points[points[:, c] >= value], depth - 1))
        return me

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        for cell, rows, _ in self.reached(points, np.zeros(len(points), np.float32), None):
            out[rows] = cell
        return out

    def reached(self, points: np.ndarray, most: np.ndarray, apart: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(cell, rows, their gaps) of the cells whose squared projected distance is ``most`` at most,
        found down the tree.  ``apart``: the gap by coordinate that rows have already; without it
        every row goes to its own cell only."""
        stack = [(self.root, np.arange(len(points)), apart)]
        while stack:
            node, rows, gaps = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows, gaps
                continue
            c, value, below, above = self.nodes[node]
            off = points[rows, c] - np.float32(value)
            for side, kid in ((off < 0, below), (off >= 0, above)):
                if gaps is None:
                    stack.append((kid, rows[side], None))
                    continue
                mine = gaps.copy()
                mine[~side, c] = np.maximum(mine[~side, c], np.abs(off[~side]))
                near = (mine * mine).sum(1) <= most[rows]
                stack.append((kid, rows[near], mine[near]))


class Tree:
    """Two levels of cells: the first fitted on one sample, each of its cells on a sample of its own."""

    def __init__(self, top: Cells, below: dict[int, Cells]):
        self.top, self.below = top, below
        self.start = np.zeros(top.count + 1, np.int64)
        for i in range(top.count):
            self.start[i + 1] = self.start[i] + (below[i].count if i in below else 1)
        self.count = int(self.start[-1])

    def of(self, points: np.ndarray) -> np.ndarray:
        first = self.top.of(points)
        out = self.start[first]
        for i in np.unique(first).tolist():
            if i in self.below:
                rows = np.flatnonzero(first == i)
                out[rows] += self.below[i].of(points[rows])
        return out

    def reached(self, points: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows) of the cells that a search may not skip."""
        for i, rows, gaps in self.top.reached(points, most, np.zeros_like(points)):
            if i not in self.below:
                yield int(self.start[i]), rows
                continue
            for cell, inner, _ in self.below[i].reached(points[rows], most[rows], gaps):
                yield int(self.start[i]) + cell, rows[inner]


class Leaves:
    """The leaves of one cell's kd-tree: tight bounds of the projected points, and their rows together."""

    def __init__(self, vectors: np.ndarray, a: np.ndarray):
        points = vectors @ a
        parts: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF_ROWS:
                parts.append(rows)
                continue
            p = points[rows]
            order = np.argpartition(p[:, int((p.max(0) - p.min(0)).argmax())], len(rows) // 2)
            stack += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.rows = parts
        self.low = np.array([points[r].min(0) for r in parts])
        self.high = np.array([points[r].max(0) for r in parts])
        self.blocks = [np.ascontiguousarray(vectors[r].T) for r in parts]

    def rounds(self, points: np.ndarray, square: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, int]]:
        """(queries, leaf): every query's leaves by projected distance, nearest first, until the test
        stops it.  ``square``, the squared distance that is still sought, may shrink meanwhile.  A
        round takes the next leaf, then the next two, four and so on, so that queries share leaves."""
        gap = np.zeros((len(points), len(self.rows)), np.float32)
        for c in range(points.shape[1]):
            x = points[:, c, None]
            off = np.maximum(np.maximum(self.low[:, c] - x, x - self.high[:, c]), 0)
            gap += off * off
        order = np.argsort(gap, axis=1).astype(np.int32)
        gap = np.take_along_axis(gap, order, 1)
        going, at, width = np.arange(len(points)), 0, 1
        while at < len(self.rows) and len(going):
            near = gap[going, at : at + width] <= limit * square[going, None]
            q, c = np.nonzero(near)
            leaf = order[going[q], at + c]
            by = np.argsort(leaf, kind="stable")
            edges = np.flatnonzero(np.diff(leaf[by], prepend=-1, append=len(self.rows)))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                yield going[q[by[lo:hi]]], int(leaf[by[lo]])
            going, at, width = going[near[:, -1]], at + width, 2 * width


def best(q: np.ndarray, p: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each q, ties by p."""
    order = np.lexsort((p, -s, q))
    q, p, s = q[order], p[order], s[order]
    start = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    keep = rank < k
    return q[keep], p[keep], s[keep]


def _kept(top_s: np.ndarray, top_p: np.ndarray, square: np.ndarray, q: np.ndarray, s: np.ndarray, p: np.ndarray) -> None:
    """Merge cosines ``s`` of vectors ``p`` into the k best of queries ``q``; the k-th sets what is sought."""
    k = top_s.shape[1]
    all_s, all_p = np.concatenate([top_s[q], s], 1), np.concatenate([top_p[q], np.broadcast_to(p, s.shape)], 1)
    pick = np.argpartition(-all_s, k - 1, axis=1)[:, :k]
    top_s[q], top_p[q] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_p, pick, 1)
    kth = top_s[q].min(1)
    square[q] = np.minimum(square[q], np.where(kth > -2, 2 - 2 * kth, 4))


def search_cell(own: np.ndarray, asked: np.ndarray, visiting: np.ndarray, k: int, floor: float | None, stop: float, a: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed pairs (q, p, cosine) of one cell; rows of ``own`` count from 0, visitors after them.

    ``asked`` rows of the cell and visitors search it.  The distance sought is that of ``floor``, of
    ``bound`` (the k-th best that a visitor has elsewhere) and of the k-th best so far.  With
    ``floor`` a visitor's pair counts for both its ends, since the cell's rows don't visit the
    visitor's: then only ``floor`` limits it.
    """
    leaves = Leaves(own, a)
    limit = chi_square_quantile(stop, a.shape[1])
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    for all_queries, all_names in ((own[asked], asked), (visiting, np.arange(len(visiting)) + len(own))):
        guests = all_queries is visiting
        for first in range(0, len(all_queries), _TOGETHER):
            queries, names = all_queries[first : first + _TOGETHER], all_names[first : first + _TOGETHER]
            square = np.full(len(queries), 4.0 if floor is None else 2 - 2 * floor, np.float32)
            if guests and bound is not None:
                square = np.minimum(square, np.maximum(2 - 2 * bound[first : first + _TOGETHER], 0)).astype(np.float32)
            top_s, top_p = np.full((len(queries), k), -2.0, np.float32), np.full((len(queries), k), -1, np.int64)
            for q, leaf in leaves.rounds(queries @ a, square, limit):
                rows, s = leaves.rows[leaf], queries[q] @ leaves.blocks[leaf]
                if floor is None:
                    if not guests:
                        s[names[q][:, None] == rows[None, :]] = -2
                    _kept(top_s, top_p, square, q, s, rows)
                    continue
                if s.max() < floor:
                    continue
                i, j = np.nonzero(s >= floor)
                x, y, v = names[q[i]], rows[j], s[i, j]
                real = x != y
                x, y, v, i, j = x[real], y[real], v[real], i[real], j[real]
                if not len(x):
                    continue
                got.append((x, y, v))
                held += len(x)
                if guests:
                    got.append((y, x, v))
                else:
                    hit = np.unique(i)
                    found = np.where(s[hit] >= floor, s[hit], -2).astype(np.float32)
                    found[names[q[hit]][:, None] == rows[None, :]] = -2
                    _kept(top_s, top_p, square, q[hit], found, rows)
                if held > _HELD:
                    got, held = [best(*(np.concatenate([g[c] for g in got]) for c in range(3)), k)], 0
            if floor is None:
                i, j = np.nonzero(top_p >= 0)
                real = top_s[i, j] > -2
                got.append((names[i[real]], top_p[i[real], j[real]], top_s[i[real], j[real]]))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return best(*(np.concatenate([g[c] for g in got]) for c in range(3)), k)


def fit_cells(classes: DataFrame, total: int, dim: int) -> Tree:
    """Cells of CELL_ROWS rows at most on average, as many as the collection needs.

    Each level is fitted on at most SAMPLE_ROWS rows; the second, for collections beyond TOP_CELLS
    cells, in one task per cell of the first, and only its splits come back.
    """
    a = projection(dim)
    count = 1 << max(0, math.ceil(math.log2(max(1.0, total / CELL_ROWS))))
    first = min(count, TOP_CELLS)

    def project(vec: pd.Series) -> pd.Series:
        return pd.Series([p.tobytes() for p in _unpacked(vec, dim) @ a])

    def sampled(share: int) -> DataFrame:
        rows = classes.where(F.pmod(F.xxhash64("class"), F.lit(max(1, share))) == 0)
        return rows.select(F.pandas_udf(project, "binary")("vec").alias("point"))

    rows = sampled(total // SAMPLE_ROWS).limit(SAMPLE_ROWS).collect() if count > 1 else []
    top = Cells(_unpacked([bytes(r.point) for r in rows], PROJECTED), first)
    if count == first:
        return Tree(top, {})

    def cell_of(point: pd.Series) -> pd.Series:
        return pd.Series(top.of(_unpacked(point, PROJECTED)))

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": b.cell.iloc[:1], "splits": [pickle.dumps(Cells(_unpacked(b.point.head(SAMPLE_ROWS), PROJECTED), count // first))]})

    second = sampled(total // (SAMPLE_ROWS * first)).withColumn("cell", F.pandas_udf(cell_of, "int")("point")).groupBy("cell").applyInPandas(fit, "cell int, splits binary").collect()
    return Tree(top, {r.cell: pickle.loads(bytes(r.splits)) for r in second})


def _unpacked(vec: list[bytes] | pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vec), np.float32).reshape(-1, dim)


_PLACED = "cell bigint, part int, role int, class binary, vec binary, bound float"
_PAIR = "q binary, p binary, cosine double"


def class_neighbours(classes: DataFrame, total: int, k: int, dim: int, floor: float | None = None, asked: DataFrame | None = None, stop: float = STOP) -> DataFrame:
    """q, p and cosine: for every class of vectors (or those in ``asked``) its k nearest others.

    ``classes`` has class, vec and perhaps repeats.  A cell's rows are sent to as many tasks as its
    queries, counted before, need.
    """
    a = projection(dim)
    tree = fit_cells(classes, total, dim)
    limit = chi_square_quantile(stop, PROJECTED)
    Guests = Callable[[pd.DataFrame, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]

    def once(b: pd.DataFrame, points: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Cells that a row must visit; a pair of cells meets once, so that all get as many guests."""
        for c, rows in tree.reached(points, np.full(len(b), (2 - 2 * floor) * limit, np.float32)):
            h = home[rows]
            yield c, rows[(h != c) & ((h < c) == ((h + c) % 2 == 1))]

    def others(b: pd.DataFrame, points: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Cells other than its own that may hold a vector nearer than the k-th found at home."""
        square = (2 - 2 * b.bound.to_numpy(np.float32)).clip(0)
        for c, rows in tree.reached(points, square * np.float32(limit)):
            yield c, rows[home[rows] != c]

    def nobody(b: pd.DataFrame, points: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        return iter(())

    def tasks(queries: DataFrame, guests: Guests, at_home: bool) -> np.ndarray:
        """Tasks of every cell, from the number of its queries."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = np.zeros(tree.count, np.int64)
            for b in batches:
                if len(b):
                    points = _unpacked(b.vec, dim) @ a
                    home = tree.of(points)
                    if at_home:
                        np.add.at(n, home[b.role.to_numpy() == 1], 1)
                    for c, rows in guests(b, points, home):
                        n[c] += len(rows)
            held = np.flatnonzero(n)
            yield pd.DataFrame({"cell": held, "n": n[held]})

        out = np.ones(tree.count, np.int64)
        for r in queries.mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r.cell] = -(-r.n // QUERY_ROWS)
        return out

    def spread(guests: Guests, parts: np.ndarray, own: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Own rows to every task of their cell, as a query in one of them; guests to one task of each cell."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                points = _unpacked(b.vec, dim) @ a
                home = tree.of(points)
                turn = np.frombuffer(b"".join(x[:4] for x in b["class"]), np.uint32).astype(np.int64)
                out = []
                if own:
                    times = parts[home]
                    row = np.repeat(np.arange(len(b)), times)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    role = (b.role.to_numpy()[row] == 1) & (turn[row] % parts[home[row]] == part)
                    out.append(b.iloc[row][["class", "vec", "bound"]].assign(cell=home[row], part=part, role=role.astype(int)))
                for c, rows in guests(b, points, home):
                    out.append(b.iloc[rows][["class", "vec", "bound"]].assign(cell=c, part=turn[rows] % parts[c], role=2))
                if out:
                    yield pd.concat(out)[["cell", "part", "role", "class", "vec", "bound"]]

        return run

    def in_cell(b: pd.DataFrame) -> pd.DataFrame:
        guests = b[b.role == 2].drop_duplicates("class")
        mine = b[b.role < 2].sort_values("role", ascending=False, kind="stable").drop_duplicates("class")
        if not len(mine):
            return pd.DataFrame({"q": [], "p": [], "cosine": []})
        names = np.concatenate([mine["class"].to_numpy(object), guests["class"].to_numpy(object)])
        visiting = _unpacked(guests.vec, dim) if len(guests) else np.zeros((0, dim), np.float32)
        q, p, s = search_cell(_unpacked(mine.vec, dim), np.flatnonzero(mine.role == 1), visiting, k, floor, stop, a, guests.bound.to_numpy(np.float32) if floor is None else None)
        return pd.DataFrame({"q": names[q], "p": names[p], "cosine": s.astype(np.float64)})

    def searched(placed: DataFrame) -> DataFrame:
        return placed.groupBy("cell", "part").applyInPandas(in_cell, _PAIR)

    free = F.lit(-1.0).cast("float").alias("bound")
    if floor is not None:
        everyone = classes.select("class", "vec", F.lit(1).alias("role"), free)
        found = searched(everyone.mapInPandas(spread(once, tasks(everyone, once, True), True), _PLACED))
    else:
        marked = cut(classes.join(asked.select("class", F.lit(1).alias("role")), "class", "left").select("class", "vec", F.coalesce("role", F.lit(0)).alias("role"), free), "marked")
        near = cut(searched(marked.mapInPandas(spread(nobody, tasks(marked, nobody, True), True), _PLACED)), "near")
        kth = near.groupBy("q").agg(F.min("cosine").alias("kth"), F.count("*").alias("n")).withColumnRenamed("q", "class")
        again = marked.where("role = 1").dropDuplicates(["class"]).join(kth, "class", "left").select("class", "vec", "role", F.when(F.col("n") >= k, F.col("kth")).otherwise(-1.0).cast("float").alias("bound"))
        again = cut(again, "again")
        parts = tasks(again, others, False)
        far = marked.withColumn("role", F.lit(0)).mapInPandas(spread(nobody, parts, True), _PLACED).unionByName(again.mapInPandas(spread(others, parts, False), _PLACED))
        found = near.unionByName(searched(far))
    order = Window.partitionBy("q").orderBy(F.desc("cosine"), "p")
    return found.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def nearest(table: DataFrame, k: int = 5, model: str = "encoder-s64", dim: int = 64, floor: float | None = None, every: int = 1, stop: float = STOP) -> DataFrame:
    """fact_id, other_id and cosine: the k facts whose vectors point most nearly the same way.

    Ties go to the smaller fact id.  ``floor`` asks only for neighbours of at least that cosine;
    ``every`` n takes as queries the facts whose id, read as a number, is divisible by n, against all.
    Improper vectors are neither queries nor results; a fact delivered twice counts once.
    """
    rows = cut(proper_vectors(table, model, dim), "vectors")
    members = rows.select("fact_id", "class").distinct()
    classes = rows.where("vec is not null").select("class", "vec")
    total = classes.count()
    queries = members
    if every > 1:
        # ids of another shape are numbered by their hash
        digits = F.coalesce(F.nullif(F.regexp_extract("fact_id", "^fact_0*([0-9a-f]{1,16})$", 1), F.lit("")), F.substring(F.sha2("fact_id", 256), 1, 15))
        low, high = F.right(digits, F.lit(8)), F.substring(F.lpad(digits, 16, "0"), 1, 8)
        parts = [F.conv(c, 16, 10).cast("bigint") % every for c in (high, low)]
        number = (parts[0] * (2**32 % every) + parts[1]) % every
        queries = members.where(number == 0)
    asked = queries.select("class").distinct() if floor is None else None
    pairs = cut(class_neighbours(classes, total, k, dim, floor, asked, stop), "class-pairs")
    few = Window.partitionBy("class").orderBy("fact_id")
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    tops = members.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).drop("r")
    others = pairs.join(tops.withColumnRenamed("class", "p"), "p").select(F.col("q").alias("class"), F.col("fact_id").alias("other_id"), "cosine")
    own = tops.join(sizes.where("n > 1").select("class"), "class").select("class", F.col("fact_id").alias("other_id"), F.lit(1.0).alias("cosine"))
    rank = Window.partitionBy("class").orderBy(F.desc("cosine"), "other_id")
    shortlist = others.unionByName(own).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1).drop("r")
    heavy = weighed_keys(sizes, ["class"])
    both = salted_join(queries, shortlist, ["class"], F.col("fact_id"), heavy).where("fact_id != other_id")
    last = Window.partitionBy("fact_id").orderBy(F.desc("cosine"), "other_id")
    return both.withColumn("r", F.row_number().over(last)).where(F.col("r") <= k).select("fact_id", "other_id", F.least("cosine", F.lit(1.0)).alias("cosine"))
