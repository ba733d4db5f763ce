"""SentencePiece ids whose pieces point back to the bytes of the original text, and decoding.

A text is first normalised here: at every position the longest prefix found in the model's compiled character map is
replaced, and each byte written remembers the position it came from. The library then cuts the normalised text with a
copy of the model whose own normaliser is switched off, and the remembered positions turn every piece into a span of
original bytes. No piece of a usual vocabulary joins a word with a following space or crosses a line end, so the parts
between such places are cut once each and remembered.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.llm.common import slices, worker_memo

SPACE = "▁"
CHUNK_BYTES = 500_000          # text handled at once by a task
CACHED_PARTS = 150_000         # parts of texts whose ids a worker remembers
BYTE, USER, NORMAL = 6, 4, 1   # fixed values: piece types of the model file


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at:at + size]
        at += size


class Normaliser:
    """The model's normalisation with source positions. ``rules`` is the compiled map: a trie and its replacements."""

    def __init__(self, rules: bytes = b"", dummy_prefix: bool = True, trim: bool = True, escape: bool = True,
                 symbols: tuple[str, ...] = ()) -> None:
        self.dummy_prefix, self.trim, self.space = dummy_prefix, trim, (SPACE if escape else " ").encode()
        self.trie, self.texts = np.zeros(0, np.uint32), b""
        if rules:
            size = struct.unpack_from("<I", rules)[0]
            self.trie, self.texts = np.frombuffer(rules, "<u4", size // 4, 4), rules[4 + size:]
        self._units = self.trie.tolist()
        kept = sorted((s.encode() for s in symbols), key=len, reverse=True)
        self.symbols = re.compile(b"|".join(map(re.escape, kept))) if kept else None

    def _longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest rule that starts here and its replacement; length 0 if there is none."""
        units, node, best = self._units, 0, (0, b"")
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.texts[start:self.texts.index(b"\0", start)])
        return best

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        if self.symbols is not None and (hit := self.symbols.match(text, at)):
            return hit[0], len(hit[0])
        size, new = self._longest(text, at) if self._units else (0, b"")
        if size:
            return new, size
        first = text[at]
        size = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return text[at:at + size], size

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the offset of its source byte."""
        raw = text.encode()
        if not raw:
            return b"", np.zeros(1, np.int32)
        if not self._units and not self.trim:
            return self._plain(raw)
        out, source, at = bytearray(), [], 0
        if self.trim:
            while at < len(raw):
                new, size = self._prefix(raw, at)
                if new != b" ":
                    break
                at += size
            if at == len(raw):
                return b"", np.array([at], np.int32)
        if self.dummy_prefix:
            out += self.space
            source += [at] * len(self.space)
        after_space = self.trim
        while at < len(raw):
            new, size = self._prefix(raw, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                after_space = self.trim and new.endswith(b" ")
                new = new.replace(b" ", self.space)
                out += new
                source += [at] * len(new)
            at += size
        if self.trim:
            while out.endswith(self.space):
                at = source[len(out) - len(self.space)]
                del out[-len(self.space):]
                del source[len(out):]
        source.append(at)
        return bytes(out), np.array(source, np.int32)

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """No rules and no trimming: only spaces change."""
        bytes_of = np.frombuffer(raw, np.uint8)
        # bytes inside a character belong to its first byte
        begin = np.maximum.accumulate(np.where(bytes_of & 0xC0 != 0x80, np.arange(len(raw), dtype=np.int32), 0))
        wide = np.where(bytes_of == 0x20, len(self.space), 1)
        source = np.repeat(begin, wide)
        head = len(self.space) if self.dummy_prefix else 0
        new = raw.replace(b" ", self.space)
        return (self.space if head else b"") + new, np.concatenate(
            [np.zeros(head, np.int32), source, np.array([len(raw)], np.int32)])


class PieceCodec:
    """Ids and spans of whole texts, with the library's own results."""

    def __init__(self, path: str, limit: int = CACHED_PARTS) -> None:
        import sentencepiece

        with open(path, "rb") as file:
            data = file.read()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        # a later normaliser message overrides the fields of the first: no rules, no prefix, no trimming, no escaping
        off = b"\x12\x00\x18\x00\x20\x00\x28\x00"
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=data + b"\x1a" + bytes([len(off)]) + off)
        pieces, kinds, spec = [], [], {2: b"", 3: 1, 4: 1, 5: 1}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                spec.update({k: v for k, v in _fields(value) if k in spec})
        user = tuple(p for p, k in zip(pieces, kinds) if k == USER)
        self.normalise = Normaliser(spec[2], bool(spec[3]), bool(spec[4]), bool(spec[5]), user)
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) if k in (NORMAL, USER) else 0
                               for p, k in zip(pieces, kinds)], np.uint16)
        real = [p for p, k in zip(pieces, kinds) if k in (NORMAL, USER)]
        spaces_lead = not any(SPACE in p.lstrip(SPACE) for p in real)
        lines_apart = not any("\n" in p for p in real)
        stop = (SPACE if spaces_lead else "") + ("\n" if lines_apart else "")
        heads = ([f"{SPACE}+[^{stop}]*"] if spaces_lead else []) + ([f"\n[^{stop}]*"] if lines_apart else [])
        self._parts = re.compile("|".join([*heads, f"[^{stop}]+"])).findall if stop else lambda text: [text] if text else []
        self.limit, self.known, self.unusual = limit, {}, {}

    def _learn(self, parts: list[str]) -> None:
        cut = self.cutter.encode(parts, num_threads=1)
        ids = np.fromiter(chain.from_iterable(cut), np.int32)
        all_ids, at = ids.tobytes(), 0
        for part, own in zip(parts, cut):
            n = at + len(own)
            self.known[part] = all_ids[4 * at:4 * n]
            at = n
        if not self.sizes[ids].all():  # an unknown piece is as long as the characters it stands for
            for part, own in zip(parts, cut):
                if not self.sizes[own].all():
                    surfaces = self.cutter.encode(part, return_type="proto").pieces
                    self.unusual[part] = np.array([len(p.surface.encode()) for p in surfaces], np.uint16)

    def _sizes(self, ids: np.ndarray, parts: list[str], found: list[bytes]) -> np.ndarray:
        """Bytes of each piece."""
        sizes = self.sizes[ids]
        if sizes.all():
            return sizes
        return np.concatenate([self.unusual[p] if p in self.unusual else self.sizes[np.frombuffer(f, np.int32)]
                               for p, f in zip(parts, found)])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: ids, and the first and the last-but-one byte offsets of their spans in the UTF-8 text."""
        normal = [self.normalise(t) for t in texts]
        split = [self._parts(n.decode()) for n, _ in normal]
        seen = set().union(*split)
        new = seen.difference(self.known)
        if new and len(self.known) + len(new) > self.limit:
            self.known.clear()
            self.unusual.clear()
            new = seen
        if new:
            self._learn(list(new))
        get, out = self.known.__getitem__, []
        for (_, source), parts in zip(normal, split):
            found = list(map(get, parts))
            ids = np.frombuffer(b"".join(found), np.int32)
            ends = np.cumsum(self._sizes(ids, parts, found), dtype=np.int64)
            last = source[ends]
            first = source[np.concatenate([[0], ends[:-1]])] if len(ends) else last
            out.append((ids, first, last))
        return out


def codec(path: str) -> PieceCodec:
    return worker_memo(f"piece-codec {path}", lambda: PieceCodec(path))


def encode_documents(docs: DataFrame, model: str, end_id: bool = True, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """``key, ids, begins, ends, decoded``: the ids of every whole text (NULL: empty), spans and the text decoded.

    Piece i covers the bytes ``begins[i] ... ends[i] - 1`` of the UTF-8 text; inside a character that falls apart into
    byte pieces, the spans of all but its last piece are empty. The end id has an empty span at the end of the text.
    ``decoded`` is the library's decoding of the ids. Repeated rows and NULL keys are kept, an empty table gives no
    rows, other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model)
        stop = pieces.model.eos_id()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            sizes = pc.binary_length(texts.fill_null("")).to_pylist()
            for start, end in slices(sizes, CHUNK_BYTES):
                rows = pieces.encode([t or "" for t in texts.slice(start, end - start).to_pylist()])
                if end_id:
                    rows = [(np.append(i, np.int32(stop)), np.append(b, np.int32(n)), np.append(e, np.int32(n)))
                            for (i, b, e), n in zip(rows, sizes[start:end])]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _, _ in rows])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[k] for r in rows]), pa.int32()))
                         for k in range(3)]
                decoded = pa.array([pieces.model.decode(i.tolist()) for i, _, _ in rows], pa.string())
                yield pa.RecordBatch.from_arrays([keys.slice(start, end - start), *lists, decoded],
                                                 ["_key", "ids", "begins", "ends", "decoded"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"_key {kind}, ids array<int>, begins array<int>, ends array<int>, decoded string").withColumnRenamed(
        "_key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256, covered_bytes``; the last is the end of the last span."""
    return encoded.select(
        key, F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("bigint").alias("covered_bytes"))
