"""Hierarchical clustering with Ward's criterion, by merging reciprocal nearest neighbours.

Merging two clusters that are each other's nearest never changes which merges a greedy search would make, so all such
pairs of a round merge at once; what is left is searched again. A cluster is its centre and its weight, which is all
that the Lance-Williams update of Ward's criterion needs. The number of rounds grows with the logarithm of the clusters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.operators import cells as cellular
from stationloom.operators.cells import rows_of
from stationloom.operators.features import scale_like
from stationloom.operators.normalize import row_ids
from stationloom.operators.spatial import connected_components
from stationloom.session import ensure_checkpoint_dir, stored

FINISH = 2_000          # clusters whose remaining merges one small matrix decides


def costs(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Growth of the squared error when clusters with these centres and weights merge."""
    d = cellular.distances(a, b)
    return d * d * (n[:, None] * m / (n[:, None] + m))


def nearest_clusters(state: DataFrame, width: int, target: int = cellular.TARGET) -> DataFrame:
    """``node, best, cost`` of every cluster of ``node, _w, _n``: the cheapest to merge with, the smaller name at a tie.

    The cheapest inside the own cell bounds the distance that a cheaper one can have, whatever its weight.
    """
    kind = dict(state.dtypes)["node"]
    schema = f"node {kind}, best {kind}, cost double"
    # centres of two clusters may coincide: cells are made of distinct ones
    index = cellular.fit_cells(state.select("_w").distinct(), width, target)
    lightest = F.lit(float(state.agg(F.min("_n")).first()[0]))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("node")
        a, b = rows_of(left["_w"], width), rows_of(right["_w"], width)
        n, m = (t["_n"].to_numpy().astype(float) for t in (left, right))
        names = right["node"].combine_chunks()
        own = pc.index_in(left["node"].combine_chunks(), names).to_numpy(zero_copy_only=False)
        place, cost = np.zeros(len(a), np.int64), np.full(len(a), np.inf)
        step = max(1, cellular.BLOCK // len(b))
        for start in range(0, len(a), step):
            part = slice(start, start + step)
            c = costs(a[part], n[part], b, m)
            mine = np.nan_to_num(own[part].astype(float), nan=-1).astype(np.int64)
            c[np.flatnonzero(mine >= 0), mine[mine >= 0]] = np.inf
            place[part], cost[part] = c.argmin(axis=1), c.min(axis=1)
        return pa.table([left["node"], names.take(pa.array(place)), pa.array(cost)], ["node", "best", "cost"])

    # both passes read the cells, and the second reads what the first found, more than once
    held = stored(cellular.with_cell(state.select("node", "_w", "_n"), index))
    first = stored(cellular.on_cells(held, held, search, schema, "node", "node").groupBy("node").agg(F.min("cost").alias("_u")))
    # cost >= distance**2 * n * lightest / (n + lightest)
    reach = F.sqrt(F.col("_u") * (F.col("_n") + lightest) / (F.col("_n") * lightest))
    asked = cellular.with_visited(state.select("node", "_w", "_n").join(first, "node").withColumn("_r", reach).drop("_u"), index)
    found = cellular.on_cells(asked.drop("_r"), held, search, schema, "node", "node").where(F.col("cost") < float("inf"))
    return found.groupBy("node").agg(F.min(F.struct("cost", "best")).alias("_b")).select("node", "_b.best", "_b.cost")


def _cheapest(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest cluster to merge with, the first at a tie, and the cost; some rows of the matrix at a time."""
    best, cost = np.zeros(len(w), np.int64), np.zeros(len(w))
    step = max(1, (cellular.BLOCK >> 2) // len(w))
    for start in range(0, len(w), step):
        part = slice(start, start + step)
        c = costs(w[part], n[part], w, n)
        c[np.arange(len(c)), np.arange(start, start + len(c))] = np.inf
        best[part], cost[part] = c.argmin(axis=1), c.min(axis=1)
    return best, cost


def _merge_rest(state: list, turn: int) -> list[tuple]:
    """All further merges ``a, b, height, turn`` of a bounded number of clusters, by the same rounds on the driver."""
    names = np.array([r["node"] for r in state], object)
    order = np.argsort(names, kind="stable")
    names = names[order]
    w, n = np.array([r["_w"] for r in state])[order], np.array([r["_n"] for r in state], float)[order]
    height, merges = np.array([r["_h"] for r in state])[order], []
    while len(names) > 1:
        best, cost = _cheapest(w, n)
        a = np.flatnonzero((best[best] == np.arange(len(best))) & (np.arange(len(best)) < best))
        if not len(a):                        # equal costs in a ring: the first of the cheapest pairs
            i = cost.argmin()
            j = best[i]
            a, best = np.array([min(i, j)]), best.copy()
            best[a], cost[a] = max(i, j), cost[i]
        b = best[a]
        height[a] = np.maximum(np.maximum(height[a], height[b]), cost[a])
        merges += [(names[i], names[j], float(height[i]), turn) for i, j in zip(a, b)]
        w[a] = (w[a] * n[a, None] + w[b] * n[b, None]) / (n[a] + n[b])[:, None]
        n[a] += n[b]
        keep = np.setdiff1d(np.arange(len(names)), b)
        names, w, n, height, turn = names[keep], w[keep], n[keep], height[keep], turn + 1
    return merges


def merges(places: DataFrame, width: int, target: int = cellular.TARGET, finish: int = FINISH) -> DataFrame:
    """The whole tree over ``node, _w, _n``: ``a, b, height, turn``, where b is merged into a."""
    spark, kind = places.sparkSession, dict(places.dtypes)["node"]
    state, done, turn = stored(places.withColumn("_h", F.lit(0.0))), None, 0
    while (count := state.count()) > max(finish, 1):
        near = stored(nearest_clusters(state, width, target))
        back = near.select(F.col("node").alias("_b"), F.col("best").alias("_a"))
        pairs = stored(near.join(back, (F.col("node") == F.col("_a")) & (F.col("best") == F.col("_b"))).where(
            F.col("node") < F.col("best")).select(F.col("node").alias("a"), F.col("best").alias("b"), "cost"))
        if pairs.isEmpty():                    # equal costs in a ring
            pairs = stored(near.orderBy("cost", F.least("node", "best"), F.greatest("node", "best")).limit(1).select(
                F.least("node", "best").alias("a"), F.greatest("node", "best").alias("b"), "cost"))
        into = pairs.select(F.col("b").alias("node"), F.col("a").alias("_into"), "cost").unionByName(
            pairs.select(F.col("a").alias("node"), F.col("a").alias("_into"), "cost"))
        own = state.join(into, "node", "left").withColumn("_into", F.coalesce("_into", "node"))
        centre = F.array(*[F.sum(F.col("_w")[j] * F.col("_n")) / F.sum("_n") for j in range(width)])
        state = stored(own.groupBy(F.col("_into").alias("node")).agg(
            centre.alias("_w"), F.sum("_n").alias("_n"), F.greatest(F.max("_h"), F.coalesce(F.max("cost"), F.lit(0.0))).alias(
                "_h")))
        made = pairs.select("a", "b", "cost").join(state.select(F.col("node").alias("a"), F.col("_h").alias("height")), "a").select(
            "a", "b", "height", F.lit(turn).alias("turn"))
        done = made if done is None else done.unionByName(made)
        turn += 1
        if turn % 8 == 0:
            done = stored(done)
    rest = spark.createDataFrame(_merge_rest(state.collect(), turn) if count > 1 else [], f"a {kind}, b {kind}, height double, turn int")
    return rest if done is None else done.unionByName(rest)


def ward_clusters(df: DataFrame, features: Sequence[str], k: int, key: str = "id", standardise: bool = True,
                  target: int = cellular.TARGET, finish: int = FINISH) -> DataFrame:
    """``key, cluster``: the partition into k clusters, numbered in the order of their smallest key.

    Rows with a missing feature are left out. Equal rows are one weighted place, as their merges cost nothing; with
    fewer different rows than k every place is a cluster.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = [f"_v{i}" for i in range(len(features))]
    raw = df.dropna(subset=[key, *features]).select(key, *[F.col(f).cast("double").alias(v) for f, v in zip(features, kept)])
    rows = scale_like(raw, raw, kept, "standard", epsilon=0.0) if standardise else raw
    rows = rows.select(key, F.array(*[F.coalesce(F.when(~F.isnan(v), F.col(v)), F.lit(0.0)) + F.lit(0.0) for v in kept]).alias(
        "_w")).checkpoint()
    places = rows.groupBy("_w").agg(F.min(key).alias("node"), F.count(F.lit(1)).alias("_n")).checkpoint()
    tree = merges(places, len(features), target, finish).checkpoint()
    top = tree.orderBy(F.desc("height"), F.desc("turn"), "a").limit(max(k - 1, 0)).select("a", "b")
    kept_merges = tree.join(top, ["a", "b"], "left_anti").select("a", "b")
    labels = connected_components(kept_merges)
    named = places.join(labels, "node", "left").select("_w", F.coalesce("label", "node").alias("_label"))
    numbers = row_ids(named.select("_label").distinct(), "_label", "cluster")
    return rows.join(named.join(numbers, "_label").select("_w", "cluster"), "_w").select(
        key, F.col("cluster").cast("bigint").alias("cluster"))
