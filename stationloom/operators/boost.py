"""Histogram boosting of the models of all folds at once.

A fold is a group of rows that its model must not see. The trees see bins alone, so rows with the same bins are one
place: they are sorted next to each other and packed into chunks, and every chunk carries the predictions of its places
under the model of each fold. A tree looks at the rows once, to add up those drawn for it by place and group; its levels
look at places. One aggregate a level gives the gradient histograms of every (fold, node, feature, bin), without the rows
of the fold's own group, and the best split of every node of every fold; so the number of Spark jobs depends on trees and
depth alone, not on the number of groups. Missing values have a bin of their own, and each split learns to which side
they go. Folds are dealt into blocks, so a chunk never holds more than a block's predictions. Only the splits of the tree
that is growing are on the driver; kept columns wait apart until the trees have grown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.functions.scalar import known
from stationloom.operators.normalize import category_codes
from stationloom.session import ensure_checkpoint_dir

BINS = 32               # and one for missing values
CHUNK, BLOCK = 4_096, 64        # places after which a chunk ends, folds of a block
ROWS = 65_536           # rows after which a chunk ends
SPREAD = 4_000_000      # rows of a partition of chunks, times the folds of a block; smaller ones where cores would idle
CUT = 10                # trees between two checkpoints, the others are persisted
HELD = 16               # blocks whose histograms a task keeps at a time


@dataclass(frozen=True)
class Settings:
    """``share`` of the rows is drawn for each tree by a hash of the row."""

    trees: int = 60
    rate: float = 0.17
    depth: int = 5
    share: float = 1.0
    least: int = 2          # rows on each side of a split
    first: float | None = None      # rate of the first tree, where it is another
    fill: bool = False      # missing features get the mean of the fold's rows instead of a side of their own


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of the bins of every feature but the last: its quantiles, from one sketch per feature."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(c, probs, 20_000).alias(c) for c in columns]).first()
    return [np.unique(np.array(row[c] or [], float)) for c in columns]


def _drawn(seeds: np.ndarray, tree: int, share: float) -> np.ndarray:
    x = (seeds ^ np.uint64(tree * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)) * 2.0 ** -53 < share


@dataclass
class Tree:
    """Splits of one tree for all folds, in heap order; a node without a split has feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, folds: int, depth: int) -> Tree:
        nodes = 2 ** (depth + 1) - 1
        return cls(np.full((folds, nodes), -1, np.int16), np.zeros((folds, nodes), np.int16),
                   np.zeros((folds, nodes), bool), np.zeros((folds, nodes)))

    def of(self, start: int, stop: int) -> Tree:
        return Tree(self.feature[start:stop], self.bin[start:stop], self.missing_left[start:stop], self.value[start:stop])

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """For each fold and node the feature to look at, and for each of its bins the next node."""
        folds, nodes = self.feature.shape
        value = np.arange(BINS + 1)
        left = np.where(value == BINS, self.missing_left[..., None], value <= self.bin[..., None])
        at = np.arange(nodes)[None, :, None]
        after = np.where(self.feature[..., None] >= 0, 2 * at + 2 - left, at)
        return np.maximum(self.feature, 0).astype(np.int64), after.reshape(folds, -1)


def walk(feature: np.ndarray, after: np.ndarray, x: np.ndarray, level: int) -> np.ndarray:
    """Node of every place (column of ``x``) in one fold after so many levels; it stays at a node without a split."""
    node = np.zeros(x.shape[1], np.int64)
    flat, at, first = x.reshape(-1), np.arange(x.shape[1]), feature * x.shape[1]
    for _ in range(level):
        node = after.take(node * (BINS + 1) + flat.take(at + first.take(node)))
    return node


def best_split(hist: np.ndarray, least: int) -> tuple[float, int, int, bool, np.ndarray] | None:
    """``gain, feature, bin, missing_left, (n, sum) of left and right`` of one node; ``hist`` is feature x bin x (n, sum)."""
    total = hist[0].sum(axis=0)
    below = np.cumsum(hist[:, :BINS], axis=1)[:, :-1]
    best = None
    for missing_left in (False, True):
        left = below + hist[:, BINS:] * missing_left
        right = total - left
        good = (left[..., 0] >= least) & (right[..., 0] >= least)
        gain = np.where(good, left[..., 1] ** 2 / np.maximum(left[..., 0], 1) + right[..., 1] ** 2 / np.maximum(
            right[..., 0], 1) - total[1] ** 2 / max(total[0], 1), -np.inf)
        at = int(np.argmax(gain))
        if gain.flat[at] > 1e-9 * max(1.0, abs(total[1])) and (best is None or gain.flat[at] > best[0] * (1 + 1e-9)):
            f, b = np.unravel_index(at, gain.shape)
            best = (float(gain[f, b]), int(f), int(b), missing_left, np.stack([left[f, b], right[f, b]]))
    return best


@dataclass
class Opener:
    """Reads the parts of a chunk. A lot is the rows of a place in one group; lots are in the order of places."""

    start: np.ndarray           # mean label of each fold's rows
    width: int
    fills: np.ndarray | None    # bin of each fold's missing values, by feature

    def folds(self, row: dict) -> tuple[int, int]:
        """The first fold and the one after the last."""
        return row["block"] * BLOCK, min((row["block"] + 1) * BLOCK, len(self.start))

    def bins(self, row: dict) -> Callable[[int], np.ndarray]:
        """The places' bins as the model of a fold sees them, feature x place."""
        x = np.ascontiguousarray(np.frombuffer(row["x"], np.uint8).reshape(-1, self.width).T).astype(np.int64)
        missing = x == BINS
        if self.fills is None or not missing.any():
            return lambda fold: x
        return lambda fold: np.where(missing, self.fills[fold][:, None], x)

    def pred(self, row: dict) -> np.ndarray:
        """Predictions, fold x place."""
        first, last = self.folds(row)
        if row["pred"]:
            return np.frombuffer(row["pred"]).reshape(last - first, -1)
        return np.repeat(self.start[first:last, None], len(row["x"]) // self.width, axis=1)

    def left(self, row: dict, pred: np.ndarray, tree: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Number and summed residuals of each place's rows drawn for a tree, without those of the fold; fold x place."""
        first, last = self.folds(row)
        rows, place, code = (np.frombuffer(row[c], k) for c, k in (("rows", "<i4"), ("place", "<i4"), ("code", "<i8")))
        lot, y = np.repeat(np.arange(len(rows)), rows), np.frombuffer(row["y"])
        if share < 1:
            drawn = np.flatnonzero(_drawn(np.frombuffer(row["seed"], "<u8"), tree, share))
            lot, y = lot[drawn], y[drawn]
        n, s = np.bincount(lot, minlength=len(rows)), np.bincount(lot, y, len(rows))
        left_n = np.repeat(np.bincount(place, n, pred.shape[1])[None].astype("<i4"), last - first, axis=0)
        left_s = np.repeat(np.bincount(place, s, pred.shape[1])[None], last - first, axis=0)
        own = np.flatnonzero((code >= first) & (code < last))
        at = code[own] - first, place[own]
        left_n[at] -= n[own].astype("<i4")
        left_s[at] -= s[own]
        return left_n, np.where(left_n > 0, left_s - left_n * pred, 0.0)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One by one, as a row is large."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        yield {c: batch[j][i].as_py() for j, c in enumerate(names)}


class Boosting:
    """The growing models of all folds over a stored table of chunks."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, group: str | None, keep: Sequence[str],
                 settings: Settings, whole: bool = True) -> None:
        ensure_checkpoint_dir(df.sparkSession)
        self.settings, self.width, self.keep = settings, len(features), list(dict.fromkeys([*keep, *([group] if group else [])]))
        names = [f"_f_{c}" for c in features]
        rows = df.where(known(F.col(label)).isNotNull()).select(
            *self.keep, F.col(label).cast("double").alias("_y"), *[known(F.col(c).cast("double")).alias(n) for c, n in zip(features, names)])
        rows = category_codes(rows, group, "_code") if group else rows.withColumn("_code", F.lit(-1))
        rows = rows.withColumn("_seed", F.xxhash64("_y", *names, *self.keep)).checkpoint()
        edges = bin_edges(rows, names)
        known_sums = [c for f in names for c in (F.count(f), F.coalesce(F.sum(f), F.lit(0.0)))]
        sums = {r["_code"]: np.array([r["n"], r["s"], *r["f"]], float) for r in rows.groupBy("_code").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.array(*[c.cast("double") for c in known_sums]).alias("f")).collect()}
        total = sum(sums.values(), np.zeros(2 + 2 * self.width))
        self.whole = whole or not group                        # then the last fold sees all rows
        self.folds = len(sums) + self.whole if group else 1
        left = [total - sums.get(f, 0) if group and f < len(sums) else total for f in range(self.folds)]
        fills = None
        if settings.fill:
            fills = np.array([[np.searchsorted(e, v[3 + 2 * j] / v[2 + 2 * j]) if v[2 + 2 * j] else BINS
                               for j, e in enumerate(edges)] for v in left], np.int64).reshape(self.folds, self.width)
        self.opener = Opener(np.array([v[1] / v[0] if v[0] else 0.0 for v in left]), self.width, fills)
        self.gains = np.zeros(self.width)

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [np.asarray(batch[c], float) for c in names]
                x = np.stack([np.where(np.isnan(v), BINS, np.searchsorted(e, v)) for e, v in zip(edges, values)], axis=1).astype(np.uint8)
                bins = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(names)), len(x), [None, pa.py_buffer(x.tobytes())])
                yield pa.RecordBatch.from_arrays([bins.cast(pa.binary()), *(batch[c] for c in ("_keep", "_y", "_code", "_seed", "_at"))],
                                                 ["x", "keep", "y", "code", "seed", "at"])

        def bins_of(part: pa.RecordBatch | pa.Table) -> np.ndarray:
            return np.frombuffer(b"".join(part["x"].to_pylist()), np.uint8).reshape(part.num_rows, -1)

        def chunk(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            part = pa.Table.from_batches(parts).combine_chunks()
            x, y, code, seed = bins_of(part), part["y"].to_numpy(), part["code"].to_numpy(), part["seed"].to_numpy()
            other = np.r_[True, (x[1:] != x[:-1]).any(axis=1)]
            lots = np.flatnonzero(other | np.r_[True, code[1:] != code[:-1]])
            rows = np.diff(np.r_[lots, len(x)])
            keep = part["keep"].combine_chunks()
            return pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays([0, len(x)], keep.chunk(0) if isinstance(keep, pa.ChunkedArray) else keep),
                *(pa.array([v.tobytes()], pa.binary()) for v in (
                    x[other], (np.cumsum(other)[lots] - 1).astype("<i4"), code[lots].astype("<i8"), rows.astype("<i4"),
                    y.astype("<f8"), seed.astype("<i8")))], ["keep", "x", "place", "code", "rows", "y", "seed"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, places, rows = [], 0, 0
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    x = bins_of(part)
                    held.append(part)
                    places, rows = places + 1 + int((x[1:] != x[:-1]).any(axis=1).sum()), rows + part.num_rows
                    if places >= CHUNK or rows >= ROWS:
                        yield chunk(held)
                        held, places, rows = [], 0, 0
            if held:
                yield chunk(held)

        cores = df.sparkSession.sparkContext.defaultParallelism
        self.tasks = max(1, min(self.folds, max(cores, -(-self.folds // BLOCK))))
        ready = rows.select(F.struct(*[F.col(c) for c in self.keep], F.lit(0).alias("_")).alias("_keep"), "_y", "_code", "_seed",
                            F.monotonically_increasing_id().alias("_at"), *names)
        kind = ready.schema["_keep"].dataType.simpleString()
        parts = int(max(min(cores, -(-total[0] // CHUNK)), -(-total[0] * min(self.folds, BLOCK) // SPREAD), 1))
        parts = -(-parts // cores) * cores if parts > cores else parts         # no core waits for a last round
        # places in order, a crowded one over several partitions
        placed = ready.mapInArrow(binned, f"x binary, keep {kind}, y double, code long, seed long, at long").repartitionByRange(
            parts, "x", "at").sortWithinPartitions("x", "code", "at").drop("at")
        fields = "x binary, place binary, code binary, rows binary, y binary, seed binary"
        packed = placed.mapInArrow(pack, f"keep array<{kind}>, {fields}").withColumn("chunk", F.monotonically_increasing_id()).checkpoint()
        self.kept = packed.select("chunk", "keep")
        blocks = -(-self.folds // BLOCK)
        blocked = packed.drop("keep").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        self.chunks = blocked.withColumns({c: F.lit(None).cast("binary") for c in ("pred", "n", "rest")})
        self.kind, self.stored, self.passed = kind, None, None
        self._keep(self._moved(None, 0))

    def _moved(self, tree: Tree | None, number: int) -> DataFrame:
        """The chunks with their predictions after a tree and what the next one, of this number, has to look at."""
        opened, settings = self.opener, self.settings
        rate = settings.rate if number > 1 or settings.first is None else settings.first

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            feature, after = tree.steps() if tree else (None, None)
            for batch in batches:
                made = {"pred": [], "n": [], "rest": []}
                for row in _rows(batch):
                    pred, bins, first = opened.pred(row), opened.bins(row), opened.folds(row)[0]
                    if tree:
                        pred = np.stack([pred[c] + rate * tree.value[first + c].take(walk(
                            feature[first + c], after[first + c], bins(first + c), settings.depth)) for c in range(len(pred))])
                    found = pred, *(opened.left(row, pred, number, settings.share) if number < settings.trees else (None, None))
                    for values, value in zip(made.values(), found):
                        values.append(None if value is None else value.tobytes())
                for name, values in made.items():
                    batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(values, pa.binary()))
                yield batch

        return self.chunks.mapInArrow(move, self.chunks.schema)

    def _level(self, tree: Tree, level: int) -> None:
        """Split every node of one level of every fold."""
        p, least, opened = self.width, self.settings.least, self.opener
        begin, count = 2 ** level - 1, 2 ** level

        def sent(first: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
            for fold in range(len(total)):
                some = np.flatnonzero(total[fold, :, 0, :, 0].sum(axis=1))
                if len(some):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(some), first + fold, np.int32)), pa.array(some.astype(np.int32)),
                        pa.array([total[fold, k].tobytes() for k in some], pa.binary())], ["fold", "node", "hist"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            feature, after = tree.steps()
            size = count * (BINS + 1)
            for batch in batches:
                for row in _rows(batch):
                    (first, last), bins = opened.folds(row), opened.bins(row)
                    f = last - first
                    left, rest = np.frombuffer(row["n"], "<i4").reshape(f, -1), np.frombuffer(row["rest"]).reshape(f, -1)
                    if first not in held and len(held) == HELD:         # what a task holds is bounded
                        oldest = next(iter(held))
                        yield from sent(oldest, held.pop(oldest))
                    total = held.setdefault(first, np.zeros((f, count, p, BINS + 1, 2)))
                    for c in range(f):
                        x, n, r = bins(first + c), left[c].astype(float), rest[c]
                        node = walk(feature[first + c], after[first + c], x, level) - begin
                        if node.min() < 0:                              # places at a node without a split
                            use = np.flatnonzero(node >= 0)
                            x, n, r, node = x[:, use], n[use], r[use], node[use]
                        slot = node * (BINS + 1)
                        for j in range(p):
                            key = slot + x[j]
                            total[c, :, j, :, 0] += np.bincount(key, n, size).reshape(count, BINS + 1)
                            total[c, :, j, :, 1] += np.bincount(key, r, size).reshape(count, BINS + 1)
            for first, total in held.items():
                yield from sent(first, total)

        def choose(table: pa.Table) -> pa.Table:
            rows = {}
            # in the order of the parts' bytes, so sums do not depend on which task was first
            for node, hist in sorted(zip(table["node"].to_pylist(), table["hist"].to_pylist())):
                rows[node] = rows.get(node, 0) + np.frombuffer(hist).reshape(p, BINS + 1, 2)
            out = []
            for node, hist in rows.items():
                n, s = hist[0].sum(axis=0)
                found = best_split(hist, least)
                own = dict(zip(("gain", "feature", "bin", "missing_left"), found[:4] if found else (0.0, -1, 0, False)))
                sides = found[4] if found else np.zeros((2, 2))
                out.append({"fold": table["fold"][0].as_py(), "node": node, **own, "value": s / n if n else 0.0,
                            "left": float(sides[0, 1] / max(sides[0, 0], 1)), "right": float(sides[1, 1] / max(sides[1, 0], 1))})
            return pa.Table.from_pylist(out, pa.schema([
                ("fold", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32()),
                ("missing_left", pa.bool_()), ("value", pa.float64()), ("left", pa.float64()), ("right", pa.float64())]))

        schema = ("fold int, node int, gain double, feature int, bin int, missing_left boolean, value double, left double, "
                  "right double")
        found = self.chunks.select("x", "n", "rest", "block").mapInArrow(
            add, "fold int, node int, hist binary").repartition(self.tasks, "fold").groupBy("fold").applyInArrow(
            choose, schema).toPandas()
        fold, node = found["fold"].to_numpy(), found["node"].to_numpy() + begin
        tree.feature[fold, node], tree.bin[fold, node] = found["feature"], found["bin"]
        tree.missing_left[fold, node], tree.value[fold, node] = found["missing_left"], found["value"]
        tree.value[fold, 2 * node + 1], tree.value[fold, 2 * node + 2] = found["left"], found["right"]
        if self.whole:
            own = found[(found["fold"] == self.folds - 1) & (found["feature"] >= 0)]
            np.add.at(self.gains, own["feature"].to_numpy(), own["gain"].to_numpy())

    def _keep(self, moved: DataFrame, cut: bool = False) -> None:
        """Persisted until the next tree has read it, so the disk holds a few tables at a time; a checkpoint now and then
        bounds what a lost executor costs. The first level of the next tree fills what is persisted."""
        self.passed, self.stored = self.stored, None
        if cut:
            self.chunks = moved.checkpoint()
            self._pass()
        else:
            self.chunks = self.stored = moved.persist()

    def _pass(self) -> None:
        if self.passed is not None:
            self.passed.unpersist()
            self.passed = None

    def grow(self) -> Boosting:
        for number in range(1, self.settings.trees + 1):
            tree = Tree.empty(self.folds, self.settings.depth)
            for level in range(self.settings.depth):
                self._level(tree, level)
                self._pass()
            self._keep(self._moved(tree, number), number % CUT == 0 or number == self.settings.trees)
        return self

    def held_out(self) -> DataFrame:
        """``keep columns, fold code, y_true, y_pred``: every row under the model that never saw its group; with no group,
        under the model of all rows."""
        opened, alone = self.opener, self.folds == 1

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in _rows(batch):
                    first, last = opened.folds(row)
                    rows, place = (np.frombuffer(row[c], "<i4") for c in ("rows", "place"))
                    code, place = np.repeat(np.frombuffer(row["code"], "<i8"), rows), np.repeat(place, rows)
                    at = np.flatnonzero((code >= first) & (code < last)) if not alone else np.arange(len(code))
                    if len(at):
                        column = code[at] - first if not alone else np.zeros(len(at), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]]), *(pa.array([v.tobytes()], pa.binary()) for v in (
                            at, np.frombuffer(row["y"])[at], opened.pred(row)[column, place[at]]))], ["chunk", "at", "y", "pred"])

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    at, y, pred = (np.frombuffer(batch[c][i].as_py(), k) for c, k in (("at", "<i8"), ("y", "<f8"), ("pred", "<f8")))
                    yield pa.RecordBatch.from_arrays([batch["keep"][i].values.take(pa.array(at)), pa.array(y), pa.array(pred)],
                                                     ["keep", "y_true", "y_pred"])

        made = self.chunks.select("chunk", "rows", "place", "code", "y", "x", "block", "pred").mapInArrow(own, "chunk long, at binary, y binary, pred binary")
        found = self.kept.join(made, "chunk").mapInArrow(unpack, f"keep {self.kind}, y_true double, y_pred double")
        return found.select(*[F.col("keep")[c].alias(c) for c in self.keep], "y_true", "y_pred")


def boosted_cross_validation(df: DataFrame, features: Sequence[str], label: str, group: str, keep: Sequence[str] = (),
                             **settings) -> tuple[DataFrame, DataFrame]:
    """Predictions of every labelled row by a model that never saw its group (``group, keep, fold, y_true, y_pred``), and
    ``feature, importance`` of the model of all rows: its shares of the gain.

    Rows without a group are one group. Missing features are not filled. Copies of a row are drawn together where
    ``share`` is below one.
    """
    model = Boosting(df, features, label, group, keep, Settings(**settings)).grow()
    total = model.gains.sum()
    table = df.sparkSession.createDataFrame([(f, float(g / total) if total else 0.0) for f, g in zip(features, model.gains)],
                                            "feature string, importance double")
    return model.held_out().withColumn("fold", F.col(group)), table
