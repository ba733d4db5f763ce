"""Near duplicates by SimHash fingerprints, linked through a table of distances to reference fingerprints.

Every fingerprint gets its Hamming distances to fixed references: zero, and one reference per pair of bits. A bit that
differs moves a distance by one, so two fingerprints within ``bits`` of each other differ by no more than ``bits`` in
any distance. The distance to zero and that to a reference tell how many bits of its pair are set; differing bits touch
as many pairs at most, so of the pairs dealt into ``bits + 4`` groups some four groups agree wholly. Fingerprints
meet where four groups agree, are discarded by their largest difference of distances, and the survivors are compared
bit by bit. Nothing within ``bits`` is lost.

Fingerprints that meet too many others go another way, exact as well: two fingerprints are within two bits exactly when
flipping one bit or none in each can make them equal, so each is dealt to its 65 neighbours and linked to the smallest
it finds there. Work grows with the fingerprints, never with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.llm.common import slices, stored
from stationloom.operators.spatial import connected_components

WORDS, BITS = 3, 2
CROWD = 256                    # fingerprints that may meet at one place before the other way is taken
PAIRS = 32
CHUNK_BYTES = 4_000_000
CHUNK_HASHES = 200_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits: bit i is set where more than half of the shingles' hashes have it set; no word, no bit."""
    import xxhash

    found = (text or "").encode().lower().split()          # of bytes: A-Z only, and exactly the six white spaces
    if not found:
        return 0
    width = min(words, len(found))
    shingles = map(b" ".join, zip(*[found[i:] for i in range(width)]))
    n = len(found) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), "<u8", n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK_HASHES):
        bits = np.unpackbits(hashes[at:at + CHUNK_HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_key, _fp`` per row; the 64 bits are held in a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = [len(v) if v is not None else 0 for v in texts.cast(pa.large_binary()).to_pylist()]
            for start, stop in slices(sizes, CHUNK_BYTES):
                part = [fingerprint(t.as_py(), words) for t in texts.slice(start, stop - start)]
                yield pa.RecordBatch.from_arrays([
                    keys.slice(start, stop - start), pa.array(np.array(part, np.uint64).view(np.int64))],
                    ["_key", "_fp"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, _fp long")


def references() -> list[int]:
    """The reference fingerprints, as signed longs: zero and one per pair of bits."""
    return [0] + [int(np.uint64(3 << 2 * i).astype(np.int64)) for i in range(PAIRS)]


def distance_table(prints: DataFrame, bits: int) -> DataFrame:
    """``_fp, _far, _place``: a row for each meeting place of a fingerprint, with its distances to the references.

    A place is one choice of four groups and the pair counts of these groups, written in base three.
    """
    groups = [list(range(g, PAIRS, bits + 4)) for g in range(bits + 4)]
    choices, known = list(combinations(range(bits + 4), 4)), np.array(references(), np.int64).view(np.uint64)
    base = 3 ** max(map(len, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints_ = batch.column(0).to_numpy().view(np.uint64)
            far = np.bitwise_count(prints_[:, None] ^ known).astype(np.int8)
            set_bits = (far[:, :1].astype(np.int64) - far[:, 1:] + 2) // 2        # of each pair: 0, 1 or 2
            digits = [sum(set_bits[:, i] * 3 ** k for k, i in enumerate(group)) for group in groups]
            places = np.stack([((digits[a] * base + digits[b]) * base + digits[c]) * base + digits[d] + n * base ** 4
                               for n, (a, b, c, d) in enumerate(choices)], axis=1)
            rows = len(prints_) * len(choices)
            each = np.repeat(np.arange(len(prints_)), len(choices))
            flat = pa.array(far[each].reshape(-1))
            yield pa.RecordBatch.from_arrays([
                pa.array(prints_[each].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * far.shape[1], pa.int32()), flat),
                pa.array(places.reshape(-1))], ["_fp", "_far", "_place"])

    return prints.select("_fp").mapInArrow(run, "_fp long, _far array<tinyint>, _place long")


def links(prints: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """``a, b``: enough links between different fingerprints to join all that are within ``bits`` of each other."""
    if not 1 <= bits <= 2:
        raise ValueError("bits must be 1 or 2")
    placed = stored(distance_table(prints, bits))
    sizes = placed.groupBy("_place").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = stored(placed.join(sizes, "_place"))
    few = met.where(F.col("_n") <= crowd).select("_place", "_fp", "_far")
    left, right = few.withColumnsRenamed({"_fp": "a", "_far": "_fa"}), few.withColumnsRenamed({"_fp": "b", "_far": "_fb"})
    near = F.forall(F.zip_with("_fa", "_fb", lambda x, y: F.abs(x - y)), lambda d: d <= bits)
    checked = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    found = left.join(right, (left["_place"] == right["_place"]) & (F.col("a") < F.col("b")) & near & checked).select(
        "a", "b")
    many = met.where(F.col("_n") > crowd).select("_fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(int(np.uint64(1 << i).astype(np.int64))) for i in range(64)])
    spread = many.select(F.col("_fp").alias("a"), F.explode(F.transform(
        flips, lambda f: F.col("_fp").bitwiseXOR(f))).alias("_near"))
    lowest = spread.groupBy("_near").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if bits == 1:               # fingerprints that share a neighbour may be two apart
        crowded = spread.join(many.select(F.col("_fp").alias("_near")), "_near").select("a", F.col("_near").alias("b"))
    else:
        crowded = spread.join(lowest, "_near").select("a", "b")
    return found.unionByName(crowded.where("a <> b")).distinct()


def near_groups(docs: DataFrame, words: int = WORDS, bits: int = BITS, key: str = "doc_id", text: str = "text",
                crowd: int = CROWD) -> DataFrame:
    """``key, fingerprint, component_id`` per row.

    ``component_id`` is the smallest key reached through links of at most ``bits`` differing bits, the row's own
    included. Texts are compared with A-Z lower-cased; a text of fewer than ``words`` words is one shingle; a text
    without words (NULL too) has fingerprint zero and is linked like any other. Repeated rows are kept; NULL keys are
    linked but never name a group unless it has no other. An empty table gives no rows; other columns are not read.
    """
    rows = stored(fingerprints(docs, words, key, text))
    # equal fingerprints are one point from here on, however many documents share them
    points = stored(rows.groupBy("_fp").agg(F.min("_key").alias("_first")))
    edges = stored(links(points.select("_fp"), bits, crowd))
    labels = stored(connected_components(edges))
    labelled = points.join(labels, points["_fp"] == labels["node"], "left").select(
        "_fp", "_first", F.coalesce("label", "_fp").alias("_label"))
    smallest = labelled.groupBy("_label").agg(F.min("_first").alias("component_id"))
    named = stored(labelled.join(smallest, "_label").select("_fp", "component_id"))
    return rows.join(named, "_fp").select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias(
        "fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose key names their group, with their columns; groups without any key keep all their rows.

    Rows that repeat the naming key are all kept: exact duplicates are another operator's work.
    """
    groups = near_groups(docs, words, bits, key, text)
    chosen = groups.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_kept")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_k"))
    return rows.join(chosen, F.col("_k").eqNullSafe(F.col("_kept")), "left_semi").select("_row.*")
