"""Token ids in files: ids renumbered by frequency, one to four bytes each, their lengths in separate control bytes.

A control byte holds the byte lengths of four ids, two bits each, so a reader finds all positions of a block with one
table lookup and one running sum. The commonest 256 ids take one byte. A file is a Parquet part whose rows are blocks:
``part, block, keys, lengths, control, data``; documents stand in ascending order of their key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationloom.llm.common import slices, stored, worker_memo

CHUNK_BYTES = 16_000_000       # text handled at once by a task
BLOCK_TOKENS = 500_000         # ids of a block; a longer document is a block of its own
CACHED_WORDS = 600_000         # words whose ids a worker remembers
#: How the vocabulary file splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LENGTHS = np.stack([(np.arange(256) >> shift & 3) + 1 for shift in (0, 2, 4, 6)], axis=1).astype(np.uint8)


class WordEncoder:
    """Ids of a text, word by word, with the vocabulary's own library.

    This vocabulary drops white space and never joins two words, so the ids of a text are those of its words in turn,
    and every different word is encoded once. A text that contains one of the vocabulary's special strings is given
    to the library whole.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS) -> None:
        import unicodedata

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.limit, self.words, self.pieces = limit, {}, {}
        self._pieces_of, self._compose = regex.compile(SPLIT).findall, unicodedata.normalize

    def _split(self, word: str) -> list[str]:
        """Pieces of a word: lower-cased letters, single digits, runs of other signs."""
        if word.isascii():
            if word.isalpha():
                return [word.lower()]
            if word[-1:] in (",", ".") and word[:-1].isalpha():
                return [word[:-1].lower(), word[-1]]
        text = self._compose("NFC", word)
        # one character at a time: no rule of the end of a word applies
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return self._pieces_of(text)

    def _learn(self, new: list[str]) -> list[bytes]:
        split = list(map(self._split, new))
        pieces = self.pieces
        unknown = list(set(chain.from_iterable(split)).difference(pieces))
        fresh = {}
        for at in range(0, len(unknown), 2000):
            part = unknown[at:at + 2000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            packed, start = np.fromiter(chain.from_iterable(ids), "<u4").tobytes(), 0
            for piece, own in zip(part, ids):
                fresh[piece] = packed[start:start + 4 * len(own)]
                start += 4 * len(own)
        if len(pieces) < self.limit:
            pieces.update(fresh)
            find = pieces.__getitem__
        else:                          # a full cache keeps its pieces, which are the common ones
            def find(piece: str) -> bytes:
                own = fresh.get(piece)
                return pieces[piece] if own is None else own
        return [find(ps[0]) if len(ps) == 1 else b"".join(map(find, ps)) for ps in split]

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        whole = {i: self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(odd).tolist()}
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", texts) if whole else texts)
        coded = lists.flatten().dictionary_encode()
        words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        values = list(map(self.words.get, words))
        missing = [i for i, v in enumerate(values) if v is None]
        if missing:
            new = [words[i] for i in missing]
            learned = self._learn(new)
            for i, value in zip(missing, learned):
                values[i] = value
            if len(self.words) < self.limit:
                self.words.update(zip(new, learned))
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        start = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(values), "<u4")
        taken = size[place]
        ends = np.cumsum(taken)
        total = int(ends[-1]) if len(ends) else 0
        joined = ids[np.repeat(start[place] - (ends - taken), taken) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        counts = np.diff(bounds)
        if whole:
            rows = np.split(joined, bounds[1:-1])
            for i, own in whole.items():
                rows[i], counts[i] = np.array(own, "<u4"), len(own)
            joined = np.concatenate(rows)
        return joined, counts


def token_table(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_key, _ids, _counts``: the ids of every whole text (NULL: empty) with the end id, as packed integers. Written once.

    The last row of a task has no ids; it holds how often each id occurs in the task.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_memo(f"word-encoder {tokenizer}", lambda: WordEncoder(tokenizer))
        vocabulary = max(encoder.size, end_id + 1)
        width = _width(vocabulary)
        end, total, kind_of = np.array([end_id], width).tobytes(), np.zeros(vocabulary, np.int64), None
        for batch in batches:
            texts, keys, kind_of = batch.column(1).fill_null(""), batch.column(0), batch.column(0).type
            for start, stop in slices(pc.binary_length(texts).to_pylist(), CHUNK_BYTES):
                ids, counts = encoder.encode(texts.slice(start, stop - start))
                total += np.bincount(ids, minlength=vocabulary)
                total[end_id] += len(counts)
                packed, bounds = ids.astype(width).tobytes(), np.cumsum(counts) * len(end)
                ids = [packed[b - n * len(end):b] + end for b, n in zip(bounds.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([keys.slice(start, stop - start), pa.array(ids, pa.binary()),
                                                  pa.nulls(len(ids), pa.binary())], ["_key", "_ids", "_counts"])
        if kind_of is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind_of), pa.nulls(1, pa.binary()), pa.array([total.tobytes()])],
                                             ["_key", "_ids", "_counts"])

    kind = dict(docs.dtypes)[key]
    return stored(docs.select(key, text).mapInArrow(encode, f"_key {kind}, _ids binary, _counts binary"), codec="zstd")


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def frequency_order(table: DataFrame, vocabulary: int) -> np.ndarray:
    """All ids of the vocabulary, the commonest first, ties by id. Only the counts of the tasks are read, never the ids."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.frombuffer(packed.as_py(), np.int64)
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    parts = table.where(F.col("_counts").isNotNull()).select("_counts")
    for row in parts.mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[row[0]] = row[1]
    return np.argsort(-counts, kind="stable").astype(np.uint32)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned numbers below 2**32."""
    numbers = numbers.astype("<u4")
    length = 1 + (numbers > 0xFF) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    codes = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    codes[:len(numbers)] = length - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    bytes_of = numbers.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), bytes_of[np.arange(4) < length[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers again: lengths from the table of control bytes, positions from their running sum."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for i in (1, 2, 3):
        more = np.nonzero(length > i)[0]
        out[more] |= raw[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def write_files(table: DataFrame, order: np.ndarray, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks in ascending key order (NULL first), written to the shared folder and read back.

    Rows with equal keys may be spread over tasks; they stand in the order of a hash of their ids.
    """
    width = _width(len(order))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    kind = dict(table.dtypes)["_key"]
    schema = f"part int, block int, n_tokens long, keys array<{kind}>, lengths array<int>, control binary, data binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            sizes = [len(v.as_py()) // np.dtype(width).itemsize for v in ids]
            for start, stop in slices(sizes, block_tokens):
                joined = np.frombuffer(b"".join(ids.slice(start, stop - start).to_pylist()), width)
                control, data = pack(rank[joined])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()),
                    "n_tokens": pa.array([len(joined)], pa.int64()),
                    "keys": pa.ListArray.from_arrays([0, stop - start], keys.slice(start, stop - start)),
                    "lengths": pa.array([sizes[start:stop]], pa.list_(pa.int32())),
                    "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary())})
                number += 1

    tied = table.where(F.col("_ids").isNotNull()).withColumn("_tie", F.xxhash64("_ids"))
    ordered = tied.repartitionByRange("_key", "_tie").sortWithinPartitions("_key", "_tie").select("_key", "_ids")
    return stored(ordered.mapInArrow(blocks, schema), codec="zstd")


def read_files(files: DataFrame, order: np.ndarray, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every document, from its file alone.

    ``start`` counts the ids of all documents before it: only block sizes are added up, inside a part and then over
    the parts.
    """
    kind = dict(files.dtypes)["keys"][6:-1]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                lengths = np.asarray(row["lengths"][0].values)
                ids = order[unpack(row["control"][0].as_py(), row["data"][0].as_py(), int(lengths.sum()))].astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                crc = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([
                    row["keys"][0].values, pa.array(ends - lengths), pa.array(lengths.astype(np.int64)),
                    pa.array(crc, pa.int64()), pa.array(np.full(n, row["part"][0].as_py(), np.int32)),
                    pa.array(np.full(n, row["block"][0].as_py(), np.int32))],
                    ["_key", "_at", "n_tokens", "ids_crc32", "_part", "_block"])

    rows = files.select("part", "block", "keys", "lengths", "control", "data").mapInArrow(
        decode, f"_key {kind}, _at long, n_tokens long, ids_crc32 long, _part int, _block int")
    sizes = files.select("part", "block", "n_tokens")
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part: as many as there were tasks
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(over_parts), F.lit(0)).alias("_before"))
    starts = sizes.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0))).join(
        parts, "part").select("part", "block", (F.col("_before") + F.col("_inside")).alias("_start"))
    return rows.join(starts, (F.col("_part") == F.col("part")) & (F.col("_block") == F.col("block"))).select(
        F.col("_key").alias(key), (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text",
                block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write the ids of all documents and read the files back: ``key, start, n_tokens, ids_crc32``.

    NULL and empty texts are a single end id. Repeated rows are written as often as they occur. An empty table gives
    no rows; other columns are not read.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    table = token_table(docs, tokenizer, end_id, key, text)
    order = frequency_order(table, vocabulary)
    return read_files(write_files(table, order, block_tokens), order, key)
