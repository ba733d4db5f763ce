"""Language-model scores of whole texts, with a unigram baseline over all words of the corpus.

Texts are handled in blocks of some megabytes. A block numbers its different words once and keeps, for each document,
the packed word numbers; the corpus counts of all words then come from one shuffle of (word, block) rows, so a word
that stands everywhere is one row per block. The counts return to their block, where baseline and attention model
score its documents.

The attention model learns from all training texts: what stands before each id is counted over all of them, and its
weights come from all their windows, unless the caller asks for a share, which is drawn by hash. The windows are dealt into groups; in each round a task per group goes on from the common weights, which are then averaged.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.llm import attention
from stationloom.llm.attention import Model, Stream, Vocabulary
from stationloom.llm.common import crc_class, slices, stored, worker_memo
from stationloom.llm.token_files import pack, unpack

BLOCK_BYTES = 12_000_000       # text of a block; a longer document is a block of its own
SCORE_WORDS = 200_000          # words scored at once
BATCH = 64                     # windows of a training step
ROUNDS = 10                    # how often the weights of all groups are averaged
GROUP_WINDOWS, LOTS = 65_536, 128      # windows of a training group; groups are added up in so many lots


@dataclass(frozen=True)
class Settings:
    vocabulary: str            # ranks of a byte-level vocabulary
    pattern: str               # how that vocabulary splits a text
    window_share: float = 1.0      # share of the training windows that the weights are learned from: all;
    window_bytes: int = 4_000_000  # with less, windows of this much text at least, or all there are
    steps: int = 1200              # least number of training steps; more where a group has more windows
    unigram: float = 0.4       # share of the baseline in a word's probability
    folds: int = 5
    held_out: int = 1


class Subwords:
    """Ids of a word with a space in front."""

    def __init__(self, settings: Settings) -> None:
        import tiktoken

        with open(settings.vocabulary, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.coding = tiktoken.Encoding("subwords", pat_str=settings.pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1

    def encode(self, words: list[str]) -> list[list[int]]:
        encode = self.coding.encode_ordinary
        return [encode(" " + w) for w in words]


def _subwords(settings: Settings) -> Subwords:
    return worker_memo(f"subwords {settings.vocabulary}", lambda: Subwords(settings))


def _lower(texts: pa.Array) -> pa.Array:
    """A-Z only."""
    return pc.ascii_lower(texts.fill_null(""))


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64"""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _streams(sizes: np.ndarray, place: np.ndarray, ids: np.ndarray, parts: np.ndarray, end: int):
    """``start, stop, own, each, upto, stream``: runs of documents, their words, ids a word, and the ids with their ends."""
    begin, ends = np.cumsum(parts) - parts, np.cumsum(sizes)
    for start, stop in slices(sizes.tolist(), SCORE_WORDS):
        own = place[ends[start] - sizes[start]:ends[stop - 1]]
        each = parts[own]
        last = np.cumsum(each)
        flat = ids[np.repeat(begin[own] - (last - each), each) + np.arange(int(each.sum()))].astype(np.int64)
        upto = ends[start:stop] - (ends[start] - sizes[start])         # words up to the end of each text
        cut = np.concatenate([[0], last])[upto]
        length = np.diff(np.concatenate([[0], cut])) + 1
        yield start, stop, own, each, upto, Stream(np.insert(flat, cut, end), np.cumsum(length) - length, length, end)


def window_share(docs: DataFrame, settings: Settings, text: str = "text") -> float:
    """Share of the windows to draw: ``window_share``, or more where the table is small."""
    if settings.window_share >= 1:
        return 1.0
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return min(1.0, max(settings.window_share, settings.window_bytes / max(size, 1)))


def word_blocks(docs: DataFrame, settings: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block: its documents, their packed words, its different words with training counts and ids, the hashes
    of the drawn training windows, which windows are drawn (a bit each), and the end id."""
    share = window_share(docs, settings, text)
    kind = dict(docs.dtypes)[key]
    schema = (f"block long, keys array<{kind}>, held array<boolean>, sizes array<int>, control binary, data binary, "
              "words array<string>, train array<long>, ids binary, parts binary, marks binary, drawn binary, end int")

    def draw(sizes, place, ids, parts, seeds, end) -> tuple[np.ndarray, np.ndarray]:
        marks, drawn = [np.zeros(0, "<i8")], [np.zeros(0, bool)]
        for start, stop, _, _, _, stream in _streams(sizes, place, ids, parts, end):
            of, first, _ = attention.windows(stream.lengths)
            mark = _mixed(seeds[start:stop].view(np.uint64)[of] + first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            chosen = (mark >> np.uint64(11)) * 2.0 ** -53 < share
            marks.append(mark[chosen].view("<i8"))
            drawn.append(chosen)
        return np.concatenate(marks), np.packbits(np.concatenate(drawn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = _subwords(settings), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(2)
            lengths = pc.binary_length(texts.fill_null("")).to_pylist()
            for start, stop in slices(lengths, BLOCK_BYTES):
                lists = pc.ascii_split_whitespace(_lower(texts.slice(start, stop - start)))
                bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                coded = lists.flatten().dictionary_encode()
                words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                real = np.fromiter(map(bool, words), bool, len(words))
                keep = real[place] if len(place) else np.zeros(0, bool)      # splitting leaves empty words at the ends
                sizes = np.diff(np.concatenate([[0], np.cumsum(keep)])[bounds])
                place = place[keep]
                held = batch.column(1).slice(start, stop - start)
                learned = np.repeat(~held.to_numpy(zero_copy_only=False), sizes)
                train = np.bincount(place[learned], minlength=len(words))
                # the commonest words get the smallest numbers, which take one byte
                order = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")
                order = order[real[order]]
                rank = np.zeros(len(words), np.int64)
                rank[order] = np.arange(len(order))
                control, data = pack(rank[place])
                listed = [words[i] for i in order]
                ids = coder.encode(listed)
                parts, ids = np.fromiter(map(len, ids), "<u4", len(ids)), np.fromiter(chain.from_iterable(ids), "<u4")
                mine = ~held.to_numpy(zero_copy_only=False)
                seeds = batch.column(3).slice(start, stop - start).to_numpy(zero_copy_only=False)[mine].astype(np.int64)
                marks, drawn = draw(sizes[mine], rank[place[learned]], ids, parts.astype(np.int64), seeds, coder.end)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([part << 32 | number], pa.int64()),
                    "keys": pa.ListArray.from_arrays([0, stop - start], batch.column(0).slice(start, stop - start)),
                    "held": pa.array([held.to_pylist()], pa.list_(pa.bool_())),
                    "sizes": pa.array([sizes], pa.list_(pa.int32())),
                    "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary()),
                    "words": pa.array([listed], pa.list_(pa.string())),
                    "train": pa.array([train[order]], pa.list_(pa.int64())),
                    "ids": pa.array([ids.astype("<u2" if coder.size <= 1 << 16 else "<u4").tobytes()], pa.binary()),
                    "parts": pa.array([parts.tobytes()], pa.binary()),
                    "marks": pa.array([marks.tobytes()], pa.binary()),
                    "drawn": pa.array([drawn.tobytes()], pa.binary()), "end": pa.array([coder.end], pa.int32())})
                number += 1

    rows = docs.select(F.col(key).alias("_key"), (crc_class(key, settings.folds) == settings.held_out).alias("_held"),
                       F.col(text).alias("_text"), F.xxhash64(key, text).alias("_seed"))
    return stored(rows.mapInArrow(run, schema), codec="zstd", large_rows=True)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one by one: a block has megabytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _training(row: dict):
    """What ``_streams`` gives, of the training texts of a block."""
    sizes, mine = np.array(row["sizes"], np.int64), ~np.array(row["held"], bool)
    place = unpack(row["control"], row["data"], int(sizes.sum())).astype(np.int64)[np.repeat(mine, sizes)]
    parts = np.frombuffer(row["parts"], "<u4").astype(np.int64)
    ids = np.frombuffer(row["ids"], "<u2" if row["end"] < 1 << 16 else "<u4")
    return _streams(sizes[mine], place, ids, parts, row["end"])


def word_counts(blocks: DataFrame) -> DataFrame:
    """``block, place, count, first``: the training count of each word of each block.

    ``first`` marks one row per different word, so sums over it count words.
    """
    rows = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("place", "_w")).select(
        "block", "place", "_w.words", "_w.train")
    # summed before the shuffle: a word of every block is a row per task
    total = rows.groupBy("words").agg(F.sum("train").alias("count"), F.min("block").alias("_block"))
    return stored(rows.join(total, "words").select(
        "block", "place", "count", (F.col("block") == F.col("_block")).alias("first")))


def subword_counts(blocks: DataFrame, settings: Settings) -> np.ndarray:
    """Training counts of all ids; blocks send sums, never words."""
    size, width = Subwords(settings).size, "<u2" if Subwords(settings).size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = np.frombuffer(batch.column(2)[i].as_py(), "<u4")
                weights = np.repeat(np.asarray(batch.column(0)[i].values), parts)
                total = np.bincount(np.frombuffer(batch.column(1)[i].as_py(), width), weights, size).astype(np.int64)
                found = np.nonzero(total)[0]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    counts = np.zeros(size)
    for row in blocks.select("train", "ids", "parts").mapInArrow(run, "id long, n long").groupBy("id").agg(
            F.sum("n")).collect():
        counts[row[0]] = row[1]
    return counts


def neighbour_counts(blocks: DataFrame, counts: np.ndarray) -> np.ndarray:
    """What stands before each id in all training texts; tasks send sums, never words."""
    classes, size = attention.own_classes(counts), len(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = None
        for row in _each(batches):
            near = attention.neighbours(size) if near is None else near
            for *_, stream in _training(row):
                attention.add_neighbours(near, stream.ids, stream.lengths, classes)
        if near is not None:
            at, before = np.nonzero(near)
            for k in range(0, len(at), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(at[part].astype(np.int32)), pa.array(before[part].astype(
                    np.int32)), pa.array(near[at[part], before[part]].astype(np.int64))], ["id", "before", "n"])

    sums = blocks.select("sizes", "held", "control", "data", "ids", "parts", "end").mapInArrow(
        run, "id int, before int, n long").groupBy("id", "before").agg(F.sum("n").alias("n")).toArrow()
    near = np.zeros((size, attention.CLASSES - attention.GROUPS), np.float32)
    near[sums["id"].to_numpy(), sums["before"].to_numpy()] = sums["n"].to_numpy()
    return near


def group_count(blocks: DataFrame) -> int:
    """Groups that the drawn windows are dealt into."""
    total = blocks.agg(F.sum(F.octet_length("marks").cast("long"))).first()[0] or 0
    return max(1, -(-total // 8 // GROUP_WINDOWS))


def largest_group(blocks: DataFrame) -> int:
    """Windows of the largest group, 0 if no window is drawn."""
    groups = group_count(blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            found, n = np.unique(np.mod(np.frombuffer(row["marks"], "<i8"), groups), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["group", "n"])

    return blocks.select("marks").mapInArrow(count, "group long, n long").groupBy("group").agg(F.sum("n").alias("n")).agg(
        F.max("n")).first()[0] or 0


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of two bytes, compressed: the lower bytes, then the upper ones, which are alike."""
    return pa.compress(np.ascontiguousarray(numbers.reshape(-1).view(np.uint8).reshape(-1, 2).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 2 * count, "zstd", asbytes=True), np.uint8).reshape(2, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u2")


def window_groups(blocks: DataFrame, turn_windows: int | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``group, n, windows``: the drawn windows dealt into groups by their hash, in the order of their hash.

    With ``vocabulary`` the windows are those of ``attention.coded``, and ``_unpacked`` reads them: training needs no
    more, and they take a third of the room of ids.

    With ``turn_windows`` the windows of each of the ``ROUNDS`` turns are a column of their own, ``turn0, turn1, ...``,
    so a turn reads no others: as many windows each, which go on where the turn before ends and start again after the
    last; a group with fewer is whole in each turn.
    """
    groups, wide = group_count(blocks), attention.WINDOW + 1
    names = ["windows"] if turn_windows is None else [f"turn{t}" for t in range(ROUNDS)]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group that has windows in a block; ids take two bytes where they fit, -1 is then 65535."""
        for row in _each(batches):
            kind = "<u2" if vocabulary or row["end"] < (1 << 16) - 1 else "<i4"
            marks, drawn, at, found = np.frombuffer(row["marks"], "<i8"), np.frombuffer(row["drawn"], np.uint8), 0, []
            drawn = np.unpackbits(drawn).astype(bool)
            for *_, stream in _training(row):
                of, first, _ = attention.windows(stream.lengths)
                chosen = drawn[at:at + len(of)]
                rows = stream.rows(of[chosen], first[chosen])
                found.append(attention.coded(rows, row["end"], vocabulary) if vocabulary else rows.astype(kind))
                at += len(of)
            if not len(marks):
                continue
            group = np.mod(marks, groups)
            order = np.argsort(group, kind="stable")
            own, n = np.unique(group, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(n)])
            marks, windows = marks[order], np.concatenate(found)[order]
            for start in range(0, len(n), 64):
                runs = [slice(ends[i], ends[i + 1]) for i in range(start, min(start + 64, len(n)))]
                yield pa.RecordBatch.from_pydict({
                    "group": pa.array(own[start:start + 64].astype(np.int32)),
                    "marks": pa.array([marks[run].tobytes() for run in runs], pa.binary()),
                    "windows": pa.array([_packed(windows[run]) if kind == "<u2" else windows[run].tobytes() for run in runs],
                                        pa.binary()),
                    "small": pa.array([kind == "<u2"] * len(runs))})

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.frombuffer(b"".join(rows["marks"]), "<i8")
        windows = np.concatenate([
            _unpacked(data, len(mark) // 8 * wide) if small else np.frombuffer(data, "<i4")
            for mark, data, small in zip(rows["marks"], rows["windows"], rows["small"])]).reshape(-1, wide)
        if not vocabulary and windows.dtype == np.uint16:
            windows = windows.astype("<i4")
            windows[windows == (1 << 16) - 1] = -1
        order = np.argsort(marks, kind="stable")
        if (np.diff(marks[order]) == 0).any():
            order = np.array(sorted(range(len(marks)), key=lambda i: (marks[i], windows[i].tobytes())))
        n = len(order)
        if turn_windows is None:
            turns = [order]
        else:
            turns = [order[np.arange(t * turn_windows, t * turn_windows + min(turn_windows, n)) % n] for t in range(ROUNDS)]
        return pd.DataFrame({"group": [int(rows["group"].iloc[0])], "n": [n]} | {
            name: [_packed(windows[turn]) if vocabulary else windows[turn].tobytes()] for name, turn in zip(names, turns)})

    dealt = blocks.select("sizes", "held", "control", "data", "ids", "parts", "marks", "drawn", "end").mapInArrow(
        split, "group int, marks binary, windows binary, small boolean")
    return stored(dealt.groupBy("group").applyInPandas(
        join, "group int, n long, " + ", ".join(f"{name} binary" for name in names)), codec="zstd", large_rows=True)


def train_model(blocks: DataFrame, settings: Settings, counts: np.ndarray) -> tuple[Model, Vocabulary]:
    """The attention model and its classes, from all training texts. Weights and moments of the groups are averaged in
    the order of the groups, so the model does not depend on how the table is split."""
    vocabulary, model, end = Vocabulary.of(counts, neighbour_counts(blocks, counts)), Model(), len(counts) - 1
    largest = largest_group(blocks)
    if not largest:
        model.unlearned(vocabulary, counts)
        return model, vocabulary
    model.close_empty(vocabulary)

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        states = [np.frombuffer(s, np.float32) for s in rows.sort_values("group")["state"]]
        return pd.DataFrame({"lot": [int(key[0])], "n": [len(states)],
                             "state": [np.sum(states, axis=0, dtype=np.float64).tobytes()]})

    each = -(-max(settings.steps, -(-largest // BATCH)) // ROUNDS)
    groups, state, begin = window_groups(blocks, each * BATCH, vocabulary), model.state(), int(vocabulary.inputs[end])
    for turn in range(ROUNDS):
        def run(batches: Iterator[pa.RecordBatch], state=state, turn=turn) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                codes = _unpacked(row["windows"], min(row["n"], each * BATCH) * (attention.WINDOW + 1))
                after = Model().advance_coded(state, codes.reshape(-1, attention.WINDOW + 1), begin, turn * each,
                                              (turn + 1) * each, ROUNDS * each, BATCH)
                yield pa.RecordBatch.from_pydict({"group": pa.array([row["group"]], pa.int32()),
                                                  "state": pa.array([after.tobytes()], pa.binary())})

        states = groups.select("group", "n", F.col(f"turn{turn}").alias("windows")).mapInArrow(run, "group int, state binary")
        found = states.groupBy(F.pmod("group", F.lit(LOTS)).alias("lot")).applyInPandas(
            add, "lot int, n int, state binary").collect()
        state = (np.sum([np.frombuffer(r["state"]) for r in sorted(found, key=lambda r: r["lot"])], axis=0) / sum(
            r["n"] for r in found)).astype(np.float32)
    model.take(state)
    return model, vocabulary


def score_texts(docs: DataFrame, settings: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Tokens are the words with A-Z lower-cased, and one end. ``base_score`` is the log10-probability under smoothed
    training counts. For ``score`` the attention model reads the subword ids of the whole text; a word's probability
    mixes that of its ids with its baseline. NULL and empty texts are the end alone. NULL keys are in the training part. Repeated rows are kept and counted, an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    blocks = word_blocks(docs, settings, key, text)
    counts = word_counts(blocks)
    words = counts.where("first").agg(F.sum("count"), F.count_if(F.col("count") > 0)).first()
    learned = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    train_tokens, different = int(words[0] or 0) + learned, int(words[1] or 0) + (learned > 0)
    by_id = subword_counts(blocks, settings)
    coder_size, end = len(by_id), len(by_id) - 1
    by_id[end] = learned
    model, vocabulary = train_model(blocks, settings, by_id)
    below, width = train_tokens + 0.5 * (different + 1), "<u2" if coder_size <= 1 << 16 else "<u4"
    tail = np.log10((learned + 0.5) / below)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples(index=False):
            keys = row.keys
            sizes = np.asarray(row.sizes, np.int64)
            place = unpack(row.control, row.data, int(sizes.sum())).astype(np.int64)
            parts = np.frombuffer(row.parts, "<u4").astype(np.int64)
            count = np.zeros(len(parts))
            count[right["place"].to_numpy()] = right["count"].to_numpy()
            base = np.concatenate([[0.0], np.cumsum(np.log10((count[place] + 0.5) / below))])
            known = np.concatenate([[0], np.cumsum(count[place] > 0)])
            ends = np.cumsum(sizes)
            frame = {"_key": keys, "held_out": row.held, "n_tokens": sizes + 1,
                     "n_known": known[ends] - known[ends - sizes] + (learned > 0), "train_tokens": train_tokens,
                     "base_score": base[ends] - base[ends - sizes] + tail}
            # equal texts of a block have equal words in equal order: each is scored once
            begin = ends - sizes
            seen: dict[bytes, int] = {}
            copy = np.array([seen.setdefault(place[b:e].tobytes(), n) for n, (b, e) in enumerate(zip(begin.tolist(), ends.tolist()))],
                            np.int64)
            once = np.flatnonzero(copy == np.arange(len(copy)))
            results = np.zeros(len(sizes))
            words = place[np.repeat(copy == np.arange(len(copy)), sizes)]
            for start, stop, own, each, upto, stream in _streams(sizes[once], words, np.frombuffer(row.ids, width), parts, end):
                scored = model.score(stream, vocabulary)
                # a word's probability is that of its ids; the end of a text is a word of one id
                unit = np.insert(each, upto, 1)
                word = np.add.reduceat(scored, np.cumsum(unit) - unit)
                plain = np.insert(np.log((count[own] + 0.5) / below), upto, tail * np.log(10))
                mixed = np.logaddexp(word + np.log(1 - settings.unigram), plain + np.log(settings.unigram))
                units = np.diff(np.concatenate([[0], upto])) + 1
                results[once[start:stop]] = np.add.reduceat(mixed, np.cumsum(units) - units) / np.log(10)
            frame["score"] = results[copy]
            out.append(pd.DataFrame(frame))
        return pd.concat(out) if out else pd.DataFrame(
            {c: [] for c in ("_key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    scored = blocks.drop("words", "train", "marks", "drawn", "end").groupBy("block").cogroup(counts.select("block", "place", "count").groupBy(
        "block")).applyInPandas(run, f"_key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double")
    return scored.withColumnRenamed("_key", key)
