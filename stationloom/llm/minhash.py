"""MinHash fingerprints of whole texts, likeness of fingerprints, and near duplicates by bands of the signature.

The shingles of a text are the five words that end at each of its words; in front of the first word stand empty places,
so every text with a word has as many shingles as words. A shingle is hashed to 32 bits; permutation k maps it to the
upper half of ``a[k] * x + b[k]`` modulo 2**64, which is strongly universal, and the signature keeps the smallest value
of each permutation. All of this is done on arrays: different words are hashed once, shingles are sums of shifted rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationloom.llm.common import slices, stored
from stationloom.operators.spatial import connected_components

WORDS, SIZE = 5, 128
BANDS = 32                      # of four values: a pair of likeness 0.8 shares none in one of 20 million cases
CHUNK_BYTES = 4_000_000         # text handled at once
RUN = 16_384                    # shingles permuted at once: they stay in a core's cache
STEP = np.uint64(0x9E3779B97F4A7C15)


def permutations(size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the universal hash functions."""
    rng = np.random.Generator(np.random.PCG64(20))
    return rng.integers(0, 1 << 64, size, np.uint64), rng.integers(0, 1 << 64, size, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts in a row, and how many each text has. A-Z count as a-z."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.string())))
    coded = lists.flatten().dictionary_encode()
    different, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    real = np.fromiter(map(bool, different), bool, len(different))
    keep = real[place] if len(place) else np.zeros(0, bool)         # splitting leaves empty words at the ends
    sizes = np.diff(np.concatenate([[0], np.cumsum(keep)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, different), np.uint64, len(different))
    word = _mixed(hashes)[place[keep]]
    behind = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)      # words before it in its text
    total, factor = word.copy(), STEP
    for back in range(1, words):
        total[back:] += np.where(behind[back:] >= back, word[:-back] * factor, np.uint64(0))
        factor = np.uint64(int(factor) * int(STEP) % (1 << 64))
    return _mixed(total), sizes


def signatures(hashes: np.ndarray, sizes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A row per text: the smallest 32-bit value of each permutation; all bits set where there is no shingle."""
    factors, summands = permutations(size)
    found = np.full((len(sizes), size), (1 << 64) - 1, np.uint64)
    ends = np.cumsum(sizes)
    for at in range(0, len(hashes), RUN):
        part = hashes[at:at + RUN] >> np.uint64(32)
        first, last = np.searchsorted(ends, [at, at + len(part) - 1], side="right")
        own = first + np.nonzero(sizes[first:last + 1])[0]
        begin = np.maximum(ends[own] - sizes[own] - at, 0)
        value, least = np.empty_like(part), np.empty((size, len(own)), np.uint64)
        for k in range(size):
            np.multiply(part, factors[k], out=value)
            value += summands[k]
            np.minimum.reduceat(value, begin, out=least[k])
        found[own] = np.minimum(found[own], least.T)
    return (found >> np.uint64(32)).astype(np.uint32)


def fingerprints(texts: list[str | None], words: int = WORDS, size: int = SIZE) -> np.ndarray:
    """The lower 16 bits of every signature value, enough to tell values apart."""
    out = [np.zeros((0, size), np.uint16)]
    for start, stop in slices([len(t or "") for t in texts], CHUNK_BYTES):
        out.append(signatures(*shingles(texts[start:stop], words), size).astype(np.uint16))
    return np.concatenate(out)


def edited(text: str | None, following: str | None) -> str:
    """The text with its last quarter of code points replaced by as many from the beginning of the following text."""
    text, n = text or "", len(text or "") // 4
    return text[:len(text) - n] + (following or "")[:n]


def _binary(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in prints.astype(">u2")], pa.binary())


FIELDS = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(texts: list, following: list, prints: np.ndarray, next_prints: np.ndarray, words: int, size: int) -> list:
    """The columns of ``FIELDS``."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    other = fingerprints(changed, words, size)
    return [pa.array([len(t or "") for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            _binary(prints), _binary(other), pa.array((prints == other).mean(axis=1)),
            pa.array((prints == next_prints).mean(axis=1))]


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                  size: int = SIZE) -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row.

    Documents stand in ascending order of their key, NULL first, then of a hash of their text; after the last comes the
    first. Rows that repeat key and text are one document there, and all get its result. NULL is an empty text; texts
    without words are alike among themselves and unlike any other. An empty table gives no rows; other columns are
    not read.

    One exchange deals the rows into ranges of that order, a repeated row into several if need be. A task compares the
    neighbours inside its range; the last document of each range is compared afterwards, when the beginnings of all
    ranges are known.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
                       F.col(text).alias("_text")).withColumn("_spread", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(F.col("_key").asc_nulls_first(), "_hash", "_spread").sortWithinPartitions(
        F.col("_key").asc_nulls_first(), "_hash").select("_key", "_hash", "_text")
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def ends(key_type: pa.DataType, key_, hash_, text_, count: int, role: int) -> pa.RecordBatch:
        """A document at an end of a range, with its text."""
        blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([
            pa.array([key_], key_type), pa.array([hash_], pa.int64()), pa.array([text_], pa.string()),
            pa.array([count], pa.int64()), pa.array([role], pa.int32()), *blank],
            ["_key", "_hash", "_text", "_count", "_role", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_print, met, key_type = None, None, 0, None       # the document that waits for the next one
        for batch in batches:
            key_type = batch.column(0).type
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for start, stop in slices([len(t or "") for t in columns[2]], CHUNK_BYTES):
                new = []
                for key_, hash_, text_ in zip(*(c[start:stop] for c in columns)):
                    before = new[-1] if new else last
                    if before is not None and before[0] == key_ and before[1] == hash_:
                        before[3] += 1
                    else:
                        new.append([key_, hash_, text_, 1])
                if not new:
                    continue
                for document in new[:max(0, 2 - met)]:
                    yield ends(key_type, *document[:3], 0, 1)
                met += len(new)
                prints = fingerprints([d[2] for d in new], words, size)
                if last is not None:
                    new, prints = [last, *new], np.concatenate([last_print[None], prints])
                done = new[:-1]
                if done:
                    count = np.array([d[3] for d in done])
                    columns_ = _compared([d[2] for d in done], [d[2] for d in new[1:]], prints[:-1], prints[1:], words, size)
                    each, n = pa.array(np.repeat(np.arange(len(done)), count)), int(count.sum())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([d[0] for d in done], key_type).take(each), pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.string()), pa.array(np.ones(n, np.int64)), pa.array(np.zeros(n, np.int32)),
                        *(c.take(each) for c in columns_)], ["_key", "_hash", "_text", "_count", "_role", *names])
                last, last_print = new[-1], prints[-1]
        if last is not None:
            yield ends(key_type, *last, 2)

    made = stored(ordered.mapInArrow(
        run, f"_key {kind}, _hash long, _text string, _count long, _role int, {FIELDS}"), codec="zstd")
    # two or three rows per range; only their keys and hashes are put in order
    border = made.where("_role > 0").select("_key", "_hash").distinct()
    order = Window.orderBy(F.col("_key").asc_nulls_first(), "_hash")
    this = F.struct("_key", "_hash")
    follows = border.select("_key", "_hash", F.coalesce(F.lead(this).over(order), F.first(this).over(order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).alias("_next"))
    open_ = made.where("_role = 2").groupBy("_key", "_hash").agg(F.any_value("_text").alias("_text"),
                                                               F.sum("_count").alias("_count"))
    texts = made.where("_role > 0").groupBy("_key", "_hash").agg(F.any_value("_text").alias("_following")).select(
        F.struct("_key", "_hash").alias("_next"), "_following")
    paired = open_.join(follows.select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "_next"),
                        (F.col("_hash") == F.col("_h")) & F.col("_key").eqNullSafe(F.col("_k")))
    paired = paired.withColumn("_at", F.col("_next._hash")).join(
        texts.select(F.col("_next").alias("_n"), F.col("_next._hash").alias("_a"), "_following"),
        (F.col("_at") == F.col("_a")) & F.col("_next._key").eqNullSafe(F.col("_n._key")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_, following = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *_compared(
                texts_, following, fingerprints(texts_, words, size), fingerprints(following, words, size), words, size)],
                ["_key", "_count", *names])

    rest = paired.select("_key", "_text", "_count", "_following").mapInArrow(finish, f"_key {kind}, _count long, {FIELDS}")
    rest = rest.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_count"))).select("_key", *names)
    return made.where("_role = 0").select("_key", *names).unionByName(rest).select(
        F.col("_key").alias(key), "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, size: int = SIZE,
                 bands: int = BANDS) -> DataFrame:
    """``_key, _set, _shingles, _bands`` per row: the different shingles in order, a name of that set, a hash per band."""
    import xxhash

    kind, depth = dict(docs.dtypes)[key], size // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in slices([len(t or "") for t in texts], CHUNK_BYTES):
                hashes, sizes = shingles(texts[start:stop], words)
                sign = signatures(hashes, sizes, size)
                rows = [np.unique(s) for s in np.split(hashes.view(np.int64), np.cumsum(sizes)[:-1])]
                band = np.array([[xxhash.xxh64_intdigest(part.tobytes(), b) for b, part in enumerate(row)]
                                 for row in sign.reshape(-1, bands, depth)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    keys.slice(start, stop - start), pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in rows]),
                    pa.array(rows, pa.list_(pa.int64())), pa.array(list(band), pa.list_(pa.int64()))],
                    ["_key", "_set", "_shingles", "_bands"])

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"_key {kind}, _set binary, _shingles array<long>, _bands array<long>")


def _alike(pairs: DataFrame, points: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of sets whose Jaccard similarity is high enough, by their shingles."""
    left, right = (points.select(F.col("_set").alias(c), F.col("_shingles").alias(f"_{c}")) for c in "ab")
    shared = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(left, "a").join(right, "b").where(
        shared / (F.size("_a") + F.size("_b") - shared) >= similarity).select("a", "b")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text",
                    words: int = WORDS, size: int = SIZE, bands: int = BANDS) -> DataFrame:
    """``key, component_id``: the smallest key reached through texts of at least that Jaccard similarity of shingles.

    Texts with the same set of shingles are one point from the start. Points meet where a band of their signatures is
    equal. First each is verified against the smallest point of its places, which joins the large groups of copies by
    one pair a member; then the pairs of points that meet and are still in different groups are verified. So the pairs
    inside a large group are never listed, and no pair that meets is lost between groups. Texts without words are one
    point. NULL keys are linked but name a group only if it has no other. An empty table gives no rows.
    """
    rows = stored(shingle_sets(docs, key, text, words, size, bands), codec="zstd")
    points = stored(rows.groupBy("_set").agg(F.min("_key").alias("_first"), F.any_value("_bands").alias("_bands"),
                                             F.any_value("_shingles").alias("_shingles")), codec="zstd")
    places = points.select(F.col("_set").alias("_point"), F.posexplode("_bands").alias("_band", "_value"))
    least = places.groupBy("_band", "_value").agg(F.min("_point").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = stored(places.join(least, ["_band", "_value"]).select("_band", "_value", "_point", "a"))
    edges = stored(_alike(met.where("_point <> a").select("a", F.col("_point").alias("b")).distinct(), points, similarity))
    labels = stored(connected_components(edges))
    grouped = met.join(labels, F.col("_point") == F.col("node"), "left").select(
        "_band", "_value", "_point", F.coalesce("label", "_point").alias("_group"))
    several = grouped.groupBy("_band", "_value").agg(F.min("_group").alias("_l"), F.max("_group").alias("_h")).where("_l <> _h")
    open_ = stored(grouped.join(several.select("_band", "_value"), ["_band", "_value"]))
    one, two = (open_.withColumnsRenamed({"_point": p, "_group": f"_g{p}"}) for p in "ab")
    late = one.join(two, (one["_band"] == two["_band"]) & (one["_value"] == two["_value"])
                    & (F.col("_ga") < F.col("_gb"))).select("a", "b").distinct()
    labels = stored(connected_components(stored(edges.unionByName(_alike(late, points, similarity)))))
    named = points.join(labels, F.col("_set") == F.col("node"), "left").select(
        "_set", "_first", F.coalesce("label", "_set").alias("_group"))
    smallest = named.groupBy("_group").agg(F.min("_first").alias("component_id"))
    return rows.select("_key", "_set").join(named.join(smallest, "_group").select("_set", "component_id"), "_set").select(
        F.col("_key").alias(key), "component_id")
