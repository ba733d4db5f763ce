"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed length. All different blocks are sorted and get integer names; then the
names of adjacent blocks are paired and every different pair gets a name, again and again until one name is
left. Two texts have the same ``(level, name)`` exactly when they are equal: names come from comparing
contents, and a hash only says which task compares them, so no collision can merge two texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.llm.common import lower_ascii, stored, text_of

BLOCK_CHARS = 2048


def _block_lists(docs: DataFrame, key: str, text: str, block_chars: int) -> DataFrame:
    """``_key, _sha, _blocks`` per row; an empty or NULL text is one empty block."""
    norm = docs.select(F.col(key).alias("_key"), lower_ascii(text_of(text)).alias("_norm"))
    cut = F.regexp_extract_all("_norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return norm.select("_key", F.sha2("_norm", 256).alias("_sha"),
                       F.when(F.col("_norm") == "", F.array(F.lit(""))).otherwise(cut).alias("_blocks"))


def _names(content: DataFrame, by: list[str]) -> DataFrame:
    """Number the different rows of ``by``: each task sorts its own contents and counts on.

    Which contents a task holds depends on their hash alone, so a repeated task gives the same numbers.
    """
    ordered = content.select(*by).distinct().sortWithinPartitions(*by)
    return ordered.select(*by, F.monotonically_increasing_id().alias("_name"))


def _name_blocks(lists: DataFrame) -> DataFrame:
    """``_hash, _block, _name``; the block itself is kept only where two different blocks share a hash."""
    blocks = lists.select(F.explode("_blocks").alias("_block")).select(F.xxhash64("_block").alias("_hash"), "_block")
    # copies are merged before the shuffle; the set holds one block unless hashes collide
    sets = blocks.groupBy("_hash").agg(F.sort_array(F.collect_set("_block")).alias("_set"))
    named = sets.select("_hash", F.size("_set").alias("_n"), F.explode("_set").alias("_block")).sortWithinPartitions(
        "_block")
    return named.select("_hash", F.when(F.col("_n") > 1, F.col("_block")).alias("_block"),
                        F.monotonically_increasing_id().alias("_name"))


def text_names(docs: DataFrame, key: str = "doc_id", text: str = "text",
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``_key, _sha, _copies, _level, _name``: one row per different ``(key, normalised text)``.

    ``(_level, _name)`` is the identity of the text. ``_sha`` only tells rows with the same key apart.
    """
    lists = _block_lists(docs, key, text, block_chars)
    hashed = lists.select("_key", "_sha", F.transform("_blocks", lambda b: F.xxhash64(b)).alias("_hashes"))
    keys = stored(hashed.groupBy("_key", "_sha").agg(F.count(F.lit(1)).alias("_copies"),
                                                     F.first("_hashes").alias("_hashes")))
    names = stored(_name_blocks(lists))

    placed = keys.select("_key", "_sha", F.posexplode("_hashes").alias("_pos", "_hash"))
    parts = placed.join(names.where("_block is null").drop("_block"), "_hash").select("_key", "_sha", "_pos", "_name")
    collided = names.where("_block is not null")
    if not collided.isEmpty():
        shared = collided.select("_hash").distinct()
        full = lists.select("_key", "_sha", F.posexplode("_blocks").alias("_pos", "_block")).withColumn(
            "_hash", F.xxhash64("_block")).join(shared, "_hash", "left_semi")
        parts = parts.unionByName(full.join(collided, ["_hash", "_block"]).select("_key", "_sha", "_pos", "_name"))

    def gathered(rows: DataFrame) -> DataFrame:
        # a set: rows repeated whole bring the same (position, name) twice
        return rows.groupBy("_key", "_sha").agg(
            F.transform(F.array_sort(F.collect_set(F.struct("_pos", "_name"))), lambda p: p["_name"]).alias("_names"))

    done, level = [], 0
    open_rows = stored(gathered(parts))
    while True:
        done.append(open_rows.where(F.size("_names") == 1).select(
            "_key", "_sha", F.lit(level).alias("_level"), F.get("_names", F.lit(0)).alias("_name")))
        rest = open_rows.where(F.size("_names") > 1)
        if rest.isEmpty():
            break
        level += 1
        half = F.sequence(F.lit(0), F.ceil(F.size("_names") / 2).cast("int") - 1)
        pairs = rest.select("_key", "_sha", F.posexplode(F.transform(half, lambda i: F.struct(
            F.get("_names", 2 * i).alias("_left"),
            F.coalesce(F.get("_names", 2 * i + 1), F.lit(-1)).alias("_right")))).alias("_pos", "_pair")).select(
            "_key", "_sha", "_pos", "_pair.*")
        pair_names = stored(_names(pairs, ["_left", "_right"]))
        open_rows = stored(gathered(pairs.join(pair_names, ["_left", "_right"])))

    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    counted = keys.drop("_hashes")
    return counted.join(identity.withColumnsRenamed({"_key": "_k", "_sha": "_s"}),
                        F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_sha") == F.col("_s"))).drop("_k", "_s")


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256``: one row per input row.

    Texts are equal when identical after A-Z are lower-cased; NULL counts as empty. The row with the largest key
    stays; a NULL key is smaller than all others. Of rows that share text and key exactly one is marked as kept.
    An empty table gives no rows; other columns are not read.
    """
    named = stored(text_names(docs, key, text, block_chars))
    # stored, so that the join below reads two plain shuffles and a large group is split at run time
    groups = stored(named.groupBy("_level", "_name").agg(F.max("_key").alias("_keep"), F.sum("_copies").alias("_size")))
    joined = named.join(groups, ["_level", "_name"])
    each = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return each.select(F.col("_key").alias(key), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
                       (F.col("_key").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 1)).alias("kept"),
                       F.col("_sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows that stay, with all their columns, under the rules of ``duplicate_groups``.

    Of rows that share key and normalised text one stays whole; which one is settled by their other columns.
    """
    named = stored(text_names(docs, key, text, block_chars))
    best = stored(named.groupBy("_level", "_name").agg(
        F.max(F.struct("_key", "_sha", "_copies")).alias("_best")).select("_best.*"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_k"),
                       F.sha2(lower_ascii(text_of(text)), 256).alias("_s"))
    staying = rows.join(best, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_s") == F.col("_sha")))
    single = staying.where("_copies = 1").select("_row")
    # repeated keys are rare: only they are compared row by row
    repeated = staying.where("_copies > 1").groupBy("_k", "_s").agg(F.min("_row").alias("_row")).select("_row")
    return single.unionByName(repeated).select("_row.*")
