"""Mix sources to target weights by pivotal dependent rounding.

A document of a source gets ``floor(r)`` copies for sure and one more with probability ``r - floor(r)``, where r is
the source's target over its size. These probabilities are not drawn one by one: two documents at a time, words are
moved at random from one to the other until the copy of one is certain or ruled out, which keeps each document's
expected copies and the expected words of the pair exactly. The one left open of each bucket goes up a tree of
buckets until a source has a single open document. So a source's words miss its target by less than the size of one
document. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationloom.llm.common import stored, text_of, words_of
from stationloom.operators.normalize import category_codes

FAN_IN = 1024                  # open documents rounded together by one bucket: enough to settle a very long one
WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3.0                    # times its source's size that a target may reach


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
                   limit: float = LIMIT) -> DataFrame:
    """``source, source_size, _n, target`` from one row per document with ``source, size``.

    Sources in code point order, NULL last, weigh ``weights`` in turn and split ``share`` of all words. A target stops
    at ``limit`` times its source's size and the excess is shared again by weight: each round is one aggregate of the
    sources, until no further source is stopped.
    """
    per_source = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")))
    place = (F.col("_code") % len(weights)).cast("int")
    coded = stored(category_codes(per_source, "source", "_code").withColumn(
        "_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place)))
    most = F.col("source_size") * float(limit)
    wanted = float(coded.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:
        full = most <= F.col("_weight") * level
        row = coded.agg(F.count_if(full), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("_weight")))).first()
        if row[0] == stopped:
            break
        stopped = row[0]
        level = (wanted - (row[1] or 0.0)) / row[2] if row[2] else float("inf")
    return coded.select("source", "source_size", "_n", F.least(most, F.col("_weight") * level).alias("target"))


def _uniform(*columns: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") * 2.0 ** -53


def _round_bucket(rows: Column) -> Column:
    """Round an array of ``struct(_order, _h, _key, _k, size, _p)`` in turn: ``settled`` array and ``open`` row.

    The longest documents come first, so the one left open at the end is a short one.
    """

    def moved(row: Column, p: Column) -> Column:
        # words moved in floating point stop next to 0 and 1, not on them
        exact = F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)
        return F.struct(row["_order"].alias("_order"), row["_h"].alias("_h"), row["_key"].alias("_key"), row["_k"].alias("_k"),
                        row["size"].alias("size"), exact.alias("_p"))

    def step(state: Column, row: Column) -> Column:
        held = state["open"]
        a, b = held["_p"] * held["size"], row["_p"] * row["size"]                   # words each may give away
        up, down = F.least(held["size"] - a, b), F.least(a, row["size"] - b)
        # a move of `up` words to the held row has chance down / (up + down), so nothing is gained or lost on average
        gain = F.when(_uniform(held["_h"], row["_h"]) * (up + down) < down, up).otherwise(-down)
        first, second = moved(held, held["_p"] + gain / held["size"]), moved(row, row["_p"] - gain / row["size"])
        pair = F.struct(first.alias("first"), second.alias("second"))
        # the row that is certain now leaves
        return F.transform(F.array(pair), lambda p: F.when(
            p["first"]["_p"].isin(0.0, 1.0), F.struct(
                F.array_append(state["settled"], p["first"]).alias("settled"), p["second"].alias("open"))).otherwise(
            F.struct(F.array_append(state["settled"], p["second"]).alias("settled"), p["first"].alias("open"))))[0]

    start = F.struct(F.slice(rows, 1, 0).alias("settled"), rows[0].alias("open"))
    return F.aggregate(F.slice(rows, F.lit(2), F.size(rows)), start, step)


def copy_counts(items: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, limit: float = LIMIT,
                fan_in: int = FAN_IN) -> DataFrame:
    """``_key, source, size, source_size, target, copies`` per row of ``_key, source, size``.

    Rows equal in all three columns are interchangeable and numbered ``_k``. A document without words takes the
    certain copies only. Reruns agree: every draw is a hash of the rows it concerns.
    """
    targets = stored(source_targets(items, weights, share, limit))
    counted = items.groupBy("source", "_key", "size").agg(F.count(F.lit(1)).alias("_m"))
    each = counted.select("source", "_key", "size", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias("_k"))
    known = targets.withColumnRenamed("source", "_source")
    joined = each.join(known, each["source"].eqNullSafe(known["_source"])).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit))))
    base = joined.withColumn("_r", F.coalesce(ratio, F.lit(0.0))).select(
        "source", "_key", "size", "_k", "source_size", "target", F.floor("_r").cast("int").alias("_base"),
        (F.col("_r") - F.floor("_r")).alias("_p"), F.ceil(F.col("_n") / fan_in).alias("_buckets"),
        F.xxhash64("_key", "_k", "size").alias("_h"))
    certain = (F.col("size") == 0) | (F.col("_p") < 1e-9) | (F.col("_p") > 1 - 1e-9)
    same_for_all = ["source", "source_size", "target", "_base"]
    done = base.where(certain).select(*same_for_all, "_key", "_k", "size", F.round("_p").alias("_p"))
    fields = ["_h", "_key", "_k", "size", "_p"]
    level, rows = 0, base.where(~certain).select(*same_for_all, "_buckets", *fields)
    while True:
        bucket = F.pmod(F.xxhash64("_h", F.lit(level)), F.col("_buckets"))
        packed = rows.groupBy(*same_for_all, "_buckets", bucket.alias("_bucket")).agg(
            F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("_order"), *fields))).alias("_rows"))
        rounded = stored(packed.select(*same_for_all, "_buckets", _round_bucket(F.col("_rows")).alias("_out")))
        settled = rounded.select(*same_for_all, F.explode("_out.settled").alias("_x")).select(
            *same_for_all, "_x._key", "_x._k", "_x.size", "_x._p")
        last = rounded.where("_buckets = 1").select(
            *same_for_all, "_out.open._key", "_out.open._k", "_out.open.size",
            (_uniform("_out.open._h", F.lit(-1)) < F.col("_out.open._p")).cast("double").alias("_p"))
        done = done.unionByName(settled).unionByName(last)
        rows = rounded.where("_buckets > 1").select(
            *same_for_all, F.ceil(F.col("_buckets") / fan_in).alias("_buckets"), "_out.open.*").drop("_order")
        level += 1
        if rows.isEmpty():
            break
    return done.select("_key", "source", "size", "_k", "source_size", "target",
                       (F.col("_base") + F.col("_p")).cast("int").alias("copies"))


def word_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(key).alias("_key"), F.col(source).alias("source"),
                       F.size(words_of(text_of(text))).cast("bigint").alias("size"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, limit: float = LIMIT,
             key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, size, source_size, target, taken`` per input row; ``taken`` counts a document's words once per copy.

    NULL text has size 0, NULL keys and sources are values like others, an empty table gives no rows.
    """
    counts = copy_counts(stored(word_sizes(docs, key, text, source)), weights, share, limit)
    return counts.select(F.col("_key").alias(key), "size", "source_size", "target",
                         (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, limit: float = LIMIT,
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents themselves, each as many times as the plan says, with their columns as they are.

    NULL and empty texts have no words and are never taken; NULL keys and sources are values like others. Repeated rows
    are rows of their own, and of rows equal in key, source and size a hash of the text settles which gets which
    copies. An empty table gives no rows.
    """
    plan = stored(copy_counts(stored(word_sizes(docs, key, text, source)), weights, share, limit))
    lists = plan.groupBy(F.struct("_key", "source", "size").alias("_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_k", "copies"))), lambda c: c["copies"]).alias("_copies"))
    ident = F.struct(F.col(key).alias("_key"), F.col(source).alias("source"),
                     F.size(words_of(text_of(text))).cast("bigint").alias("size"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), ident.alias("_id"), F.xxhash64(text).alias("_print"))
    # one shuffle of the documents: the place of a row among those with its key, source and size picks its copies
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("_print"))
    taken = rows.join(lists, "_id").withColumn("_times", F.get("_copies", rank - 1)).where("_times > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("_row.*")
