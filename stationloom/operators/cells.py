"""Balanced cells over vectors, and neighbour searches and distance statistics on them.

A binary tree cuts the data at medians of its widest coordinate; equal coordinates are told apart by a hash of the
vector, so a cell stays small even where all data lie on a line. The coordinates are either the vectors' own, or their
distances to pivots: then the tree is a metric index, and the triangle inequality bounds the distance to a cell. Every
node knows the exact box of its data, from one aggregate. The tree is small (its leaves are limited) and travels with
the functions; larger cells are dealt into parts on both sides, so no task grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET = 2_000          # distinct vectors of a cell
LEAVES = 1 << 13        # cells of a tree, at most
SAMPLE = 32             # vectors brought to the driver for each cell
ASKED, HELD = 20_000, 8_000     # queries and data of one part of a cell
BLOCK = 1 << 20         # distances held at once by a task
PIVOT_SAMPLE = 4_096


def vector(*columns: str) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def rows_of(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column as rows of one array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(-1, width)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, coordinate by coordinate: equal differences give equal distances."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[:, j]) ** 2
    return np.sqrt(total)


@dataclass
class Cells:
    """A complete binary tree in heap order: node i has children 2i + 1 and 2i + 2."""

    width: int
    pivots: np.ndarray | None
    depth: int
    axis: np.ndarray
    cut: np.ndarray
    tie: np.ndarray
    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray           # data of each leaf

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return vectors if self.pivots is None else distances(vectors, self.pivots)

    def locate(self, coords: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Leaf of each row, 0 to 2**depth - 1."""
        node, at = np.zeros(len(coords), np.int64), np.arange(len(coords))
        for _ in range(self.depth):
            value, cut = coords[at, self.axis[node]], self.cut[node]
            node = 2 * node + 1 + ((value > cut) | (value == cut) & (ties > self.tie[node]))
        return node - (2 ** self.depth - 1)

    def bound(self, coords: np.ndarray, node: np.ndarray) -> np.ndarray:
        """No vector of the node is closer to the row than this."""
        gap = np.maximum(np.maximum(self.low[node] - coords, coords - self.high[node]), 0)
        # a pivot's difference is a bound of its own; own coordinates add up
        return gap.max(axis=1) if self.pivots is not None else np.sqrt((gap * gap).sum(axis=1))

    def visit(self, coords: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that may hold a vector within the row's radius."""
        reach = radius * (1 + 1e-9) + 1e-12 * (1 + np.abs(coords).max(axis=1, initial=0))
        row, node = np.arange(len(coords)), np.zeros(len(coords), np.int64)
        for level in range(self.depth + 1):
            near = self.bound(coords[row], node) <= reach[row]
            row, node = row[near], node[near]
            if level < self.depth:
                row, node = np.repeat(row, 2), np.stack([2 * node + 1, 2 * node + 2], axis=1).reshape(-1)
        return row, node - (2 ** self.depth - 1)


def _far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots: each the vector farthest from those before it."""
    chosen = [sample[np.argmax(((sample - sample.mean(axis=0)) ** 2).sum(axis=1))]]
    least = distances(sample, chosen[0][None])[:, 0]
    while len(chosen) < count and least.max() > 0:
        chosen.append(sample[np.argmax(least)])
        least = np.minimum(least, distances(sample, chosen[-1][None])[:, 0])
    return np.array(chosen)


def fit_cells(data: DataFrame, width: int, target: int = TARGET, pivots: int = 0) -> Cells:
    """Cells over the distinct vectors ``_w`` of ``data``, which is read three times and should be stored.

    A bounded hash sample places the cuts; the boxes come from all data.
    """
    tie = F.xxhash64("_w")
    size = data.count()
    depth = max(0, int(np.ceil(np.log2(max(1, min(size / target, LEAVES))))))
    wanted = max(SAMPLE << depth, PIVOT_SAMPLE)
    keep = max(1, min(1 << 20, (wanted << 20) // max(size, 1)))
    picked = data.select("_w", tie.alias("_t")).where(F.pmod("_t", F.lit(1 << 20)) < keep).toArrow()
    sample, ties = rows_of(picked["_w"], width), picked["_t"].to_numpy()
    chosen = None
    if pivots and len(sample):
        few = sample[np.argsort(ties, kind="stable")[:PIVOT_SAMPLE]]
        chosen = _far_apart(few, pivots)
    inner = 2 ** depth - 1
    m = width if chosen is None else len(chosen)
    cells = Cells(width, chosen, depth, np.zeros(inner, np.int64), np.zeros(inner), np.zeros(inner, np.int64),
                  np.full((2 * inner + 1, m), np.inf), np.full((2 * inner + 1, m), -np.inf), np.zeros(inner + 1, np.int64))
    coords, members = cells.project(sample), {0: np.arange(len(sample))}
    for node in range(inner):
        own = members.pop(node)
        if not len(own):
            members[2 * node + 1] = members[2 * node + 2] = own
            continue
        axis = int(np.argmax(np.ptp(coords[own], axis=0)))
        order = own[np.lexsort((ties[own], coords[own, axis]))]
        last = order[(len(order) - 1) // 2]
        cells.axis[node], cells.cut[node], cells.tie[node] = axis, coords[last, axis], ties[last]
        members[2 * node + 1], members[2 * node + 2] = order[:(len(order) - 1) // 2 + 1], order[(len(order) - 1) // 2 + 1:]

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            here = cells.project(rows_of(batch.column(0), width))
            leaf = cells.locate(here, batch.column(1).to_numpy())
            order = np.argsort(leaf, kind="stable")
            found, start, count = np.unique(leaf[order], return_index=True, return_counts=True)
            low, high = (f.reduceat(here[order], start, axis=0) for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count), pa.array(list(low)), pa.array(list(high))],
                                             ["leaf", "n", "low", "high"])

    parts = data.select("_w", tie.alias("_t")).mapInArrow(boxes, "leaf long, n long, low array<double>, high array<double>")
    total = parts.groupBy("leaf").agg(F.sum("n").alias("n"), F.array(*[F.min(F.col("low")[j]) for j in range(m)]).alias("low"),
                                      F.array(*[F.max(F.col("high")[j]) for j in range(m)]).alias("high")).toArrow()
    if total.num_rows:
        leaf = total["leaf"].to_numpy()
        cells.counts[leaf] = total["n"].to_numpy()
        cells.low[inner + leaf], cells.high[inner + leaf] = rows_of(total["low"], m), rows_of(total["high"], m)
    for node in range(inner - 1, -1, -1):
        cells.low[node] = np.minimum(cells.low[2 * node + 1], cells.low[2 * node + 2])
        cells.high[node] = np.maximum(cells.high[2 * node + 1], cells.high[2 * node + 2])
    return cells


def with_cell(df: DataFrame, cells: Cells) -> DataFrame:
    """``_cell`` of every row, from ``_w``."""
    width = cells.width

    @F.pandas_udf("long")
    def locate(w, t):
        return _series(cells.locate(cells.project(np.array(w.tolist(), float).reshape(-1, width)), t.to_numpy()))

    return df.withColumn("_cell", locate("_w", F.xxhash64("_w")))


def _series(values: np.ndarray):
    import pandas as pd
    return pd.Series(values)


def with_visited(df: DataFrame, cells: Cells, own: bool = True) -> DataFrame:
    """A row for each cell within ``_r`` of ``_w``, as ``_cell``; without ``own`` the row's own cell is written as -1."""
    names = df.columns

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coords = cells.project(rows_of(batch["_w"], cells.width))
            for start in range(0, batch.num_rows, 2_000):
                part = slice(start, start + 2_000)
                row, leaf = cells.visit(coords[part], np.asarray(batch["_r"], float)[part])
                if not own:
                    leaf = np.where(leaf == cells.locate(coords[part], np.asarray(batch["_t"])[part])[row], -1, leaf)
                taken = batch.slice(start, 2_000).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(taken[c] for c in names), pa.array(leaf)], [*names, "_cell"])

    rows = df.withColumn("_t", F.xxhash64("_w"))
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return rows.mapInArrow(visit, f"{fields}, _cell long")


def on_cells(asked: DataFrame, held: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
             asked_key: str, held_key: str, keep_empty: bool = False) -> DataFrame:
    """``fn(queries, data)`` once per part of a cell; every query of a cell meets all its data, in one part or another.

    Both sides of a cell are dealt into as many parts as their numbers ask for, by a hash of their key. With
    ``keep_empty`` queries of a cell without data are handed on too.
    """
    def parts(df: DataFrame, most: int, name: str) -> DataFrame:
        return df.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias(name))

    load = parts(asked, ASKED, "_aparts").join(parts(held, HELD, "_hparts"), "_cell", "left" if keep_empty else "inner").select(
        "_cell", "_aparts", F.coalesce("_hparts", F.lit(1)).alias("_hparts"))
    left = asked.join(load, "_cell").withColumn("_a", F.pmod(F.xxhash64(F.lit(1), asked_key), F.col("_aparts")).cast("int")).withColumn(
        "_h", F.explode(F.sequence(F.lit(0), F.col("_hparts") - 1))).drop("_aparts", "_hparts")
    right = held.join(load, "_cell").withColumn("_h", F.pmod(F.xxhash64(F.lit(2), held_key), F.col("_hparts")).cast("int")).withColumn(
        "_a", F.explode(F.sequence(F.lit(0), F.col("_aparts") - 1))).drop("_aparts", "_hparts")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])       # fresh ids: both may come from one frame
    by = ("_cell", "_a", "_h")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: fn(a, b), schema)


def best(asked: np.ndarray, held: np.ndarray, k: int, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``count, place, distance``: for each row of ``asked`` up to k of ``held`` within its radius, the nearest first and
    at equal distance in the order given."""
    count, place, far = np.zeros(len(asked), np.int64), [np.zeros(0, np.int64)], [np.zeros(0)]
    step = max(1, BLOCK // max(len(held), 1))
    for start in range(0, len(asked) if len(held) else 0, step):
        d = distances(asked[start:start + step], held)
        last = min(k, d.shape[1]) - 1
        limit = np.minimum(np.partition(d, last, axis=1)[:, last], radius[start:start + step])
        row, col = np.nonzero(d <= limit[:, None])
        value = d[row, col]
        order = np.lexsort((col, value, row))
        each = np.bincount(row, minlength=len(d))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        order = order[rank < k]
        place.append(col[order])
        far.append(value[order])
        count[start:start + step] = np.minimum(each, k)
    return count, np.concatenate(place), np.concatenate(far)


def _search(k: int, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``qid, dists, ids`` of a part: the k nearest within ``_r``, or what the query brought along as ``_dists, _ids``."""
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if "_dists" in left.column_names and not right.num_rows:
            return pa.table([left["qid"], left["_dists"], left["_ids"]], ["qid", "dists", "ids"])
        right = right.sort_by("did")
        radius = np.asarray(left["_r"], float) if "_r" in left.column_names else np.full(left.num_rows, np.inf)
        count, place, far = best(rows_of(left["_w"], width), rows_of(right["_w"], width), k, radius)
        bounds = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
        names = right["did"].combine_chunks().take(pa.array(place))
        return pa.table([left["qid"], pa.ListArray.from_arrays(bounds, pa.array(far)),
                         pa.ListArray.from_arrays(bounds, names)], ["qid", "dists", "ids"])

    return search


def _merged(parts: DataFrame, k: int) -> DataFrame:
    pairs = F.arrays_zip(F.col("dists").alias("dist"), F.col("ids").alias("id"))      # k entries per part at most
    return parts.groupBy("qid").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, k).alias("near"))


def _found(queries: DataFrame, data: DataFrame) -> str:
    kinds = dict(queries.dtypes) | dict(data.dtypes)
    return f"qid {kinds['qid']}, dists array<double>, ids array<{kinds['did']}>"


def nearest(queries: DataFrame, data: DataFrame, k: int, cells: Cells) -> DataFrame:
    """``qid, near array<struct<dist,id>>``: the k nearest ``data`` (``did, _w``) of each query (``qid, _w``), by distance
    and then id.

    A query's own cell gives an upper bound of its k-th distance; the second pass visits the other cells within it.
    """
    schema, search = _found(queries, data), _search(k, cells.width)
    held = with_cell(data.select("did", "_w"), cells)
    own = _merged(on_cells(with_cell(queries.select("qid", "_w"), cells), held, search, schema, "qid", "did", True), k)
    bound = F.when(F.size("near") >= k, F.col("near")[k - 1]["dist"]).otherwise(F.lit(float("inf")))
    wide = queries.select("qid", "_w").join(own.select(
        "qid", F.col("near.dist").alias("_dists"), F.col("near.id").alias("_ids"), bound.alias("_r")), "qid")
    return _merged(on_cells(with_visited(wide, cells, own=False), held, search, schema, "qid", "did", True), k)


def nearest_within(queries: DataFrame, data: DataFrame, k: int, cells: Cells) -> DataFrame:
    """Like ``nearest``, of the data within ``_r`` of each query, in one pass; queries that reach no cell have no row."""
    held = with_cell(data.select("did", "_w"), cells)
    return _merged(on_cells(with_visited(queries, cells), held, _search(k, cells.width), _found(queries, data), "qid", "did"), k)


class Summary:
    """What a tree knows of each node: weight, centre, spread, radius."""

    def __init__(self, cells: Cells, weight: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        inner, d = 2 ** cells.depth - 1, cells.width
        self.cells, self.weight = cells, np.zeros(2 * inner + 1)
        self.sums, self.squares = np.zeros((2 * inner + 1, d)), np.zeros((2 * inner + 1, d, d))
        self.weight[inner:], self.sums[inner:], self.squares[inner:] = weight, sums, squares
        for node in range(inner - 1, -1, -1):
            for own in (self.weight, self.sums, self.squares):
                own[node] = own[2 * node + 1] + own[2 * node + 2]
        some = np.maximum(self.weight, 1)
        self.centre = self.sums / some[:, None]
        self.spread = self.squares / some[:, None, None] - self.centre[:, :, None] * self.centre[:, None, :]
        reach = np.maximum(np.abs(cells.low - self.centre), np.abs(cells.high - self.centre))
        self.radius = np.where(self.weight > 0, np.sqrt((np.where(np.isfinite(reach), reach, 0) ** 2).sum(axis=1)), 0)


def summary(data: DataFrame, cells: Cells, middle: np.ndarray) -> Summary:
    """Weights and moments of every cell from ``_w`` and ``_n``, around ``middle``; tasks send sums per cell."""
    width = cells.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, n = rows_of(batch.column(0), width), np.asarray(batch.column(2), float)
            leaf, found = np.unique(cells.locate(cells.project(w), batch.column(1).to_numpy()), return_inverse=True)
            w = w - middle
            moments = np.concatenate([n[:, None], n[:, None] * w, (n[:, None, None] * w[:, :, None] * w[:, None, :]).reshape(
                len(w), -1)], axis=1)
            total = np.zeros((len(leaf), moments.shape[1]))
            np.add.at(total, found, moments)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(list(total))], ["leaf", "m"])

    parts = data.select("_w", F.xxhash64("_w").alias("_t"), "_n").mapInArrow(run, "leaf long, m array<double>")
    size = 1 + width + width * width
    added = parts.groupBy("leaf").agg(F.array(*[F.sum(F.col("m")[j]) for j in range(size)]).alias("m")).toArrow()
    m = np.zeros((2 ** cells.depth, size))
    if added.num_rows:
        m[added["leaf"].to_numpy()] = rows_of(added["m"], size)
    return Summary(cells, m[:, 0], m[:, 1:1 + width], m[:, 1 + width:].reshape(-1, width, width))


def _bounds(a: Cells, b: Cells, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance that vectors of two boxes can have."""
    apart = np.maximum(np.maximum(a.low[i] - b.high[j], b.low[j] - a.high[i]), 0)
    wide = np.maximum(np.abs(a.high[i] - b.low[j]), np.abs(b.high[j] - a.low[i]))
    return np.sqrt((apart * apart).sum(axis=1)), np.sqrt((wide * wide).sum(axis=1))


def _split(a: Summary, b: Summary, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs one level down: the larger node of each is halved, a leaf never."""
    first = (i < 2 ** a.cells.depth - 1) & ((a.radius[i] >= b.radius[j]) | (j >= 2 ** b.cells.depth - 1))
    left = np.concatenate([2 * i[first] + 1, 2 * i[first] + 2, i[~first], i[~first]])
    right = np.concatenate([j[first], j[first], 2 * j[~first] + 1, 2 * j[~first] + 2])
    return left, right


@dataclass
class PairPlan:
    """Which pairs of cells are compared vector by vector, and what the other pairs of nodes add up to."""

    near: np.ndarray             # leaf pairs whose distances are added one by one
    looked: np.ndarray           # further leaf pairs that may hold the least or the largest distance
    far_sum: float
    far_error: float


def plan_pairs(a: Summary, b: Summary, tolerance: float, zero: float) -> PairPlan:
    """Descend both trees together. A pair of nodes far enough apart adds its centres' distance, corrected by the
    spreads; the error of that is at most ``rho**3 / (2 * (r - rho)**2)`` a pair of vectors, with r between the centres
    and rho the sum of the radii, and is accepted up to ``tolerance * r``."""
    ends = 2 ** a.cells.depth - 1, 2 ** b.cells.depth - 1
    i = j = np.zeros(1, np.int64)
    near, total, error = [np.zeros((0, 2), np.int64)], 0.0, 0.0
    while len(i):
        real = (a.weight[i] > 0) & (b.weight[j] > 0)
        i, j = i[real], j[real]
        way = a.centre[i] - b.centre[j]
        r, rho = np.sqrt((way * way).sum(axis=1)), a.radius[i] + b.radius[j]
        gap = r - rho
        miss = rho ** 3 / (2 * np.where(gap > 0, gap, np.inf) ** 2)
        far = (gap > zero) & (miss <= tolerance * r)
        if tolerance > 0 and far.any():
            x, y, u = i[far], j[far], way[far] / r[far, None]
            spread = a.spread[x] + b.spread[y]
            across = np.trace(spread, axis1=1, axis2=2) - np.einsum("ni,nij,nj->n", u, spread, u)
            pairs = a.weight[x] * b.weight[y]
            total += float((pairs * (r[far] + across / (2 * r[far]))).sum())
            error += float((pairs * miss[far]).sum())
            i, j = i[~far], j[~far]
        leaf = (i >= ends[0]) & (j >= ends[1])
        near.append(np.stack([i[leaf], j[leaf]], axis=1))
        i, j = _split(a, b, i[~leaf], j[~leaf])
    looked = []
    for largest in (True, False):
        i, j, known, found = np.zeros(1, np.int64), np.zeros(1, np.int64), -np.inf if largest else np.inf, []
        while len(i):
            real = (a.weight[i] > 0) & (b.weight[j] > 0)
            i, j = i[real], j[real]
            low, high = _bounds(a.cells, b.cells, i, j)
            # some pair is as far apart as the centres are, and some pair no farther than the boxes allow
            between = np.sqrt(((a.centre[i] - b.centre[j]) ** 2).sum(axis=1)) * (1 - 1e-9)
            known = max(known, between.max(initial=-np.inf)) if largest else min(known, high.min(initial=np.inf))
            open_ = high >= known if largest else low <= known
            leaf = open_ & (i >= ends[0]) & (j >= ends[1])
            found.append(np.stack([i[leaf], j[leaf]], axis=1))
            i, j = _split(a, b, i[open_ & ~leaf], j[open_ & ~leaf])
        pairs = np.concatenate(found)
        if len(pairs):
            low, high = _bounds(a.cells, b.cells, pairs[:, 0], pairs[:, 1])
            looked.append(pairs[high >= known if largest else low <= known])
    shift, near = np.array(ends), np.concatenate(near)
    extra = np.concatenate(looked) if looked else np.zeros((0, 2), np.int64)
    extra = np.array(sorted({tuple(p) for p in extra.tolist()} - {tuple(p) for p in near.tolist()}), np.int64).reshape(-1, 2)
    return PairPlan(near - shift, extra - shift, total, error)
