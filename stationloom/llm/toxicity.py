"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens get the log-odds of toxic against clean training texts under a Dirichlet prior that follows the tokens' overall
frequency; only significant ones count, all others weigh slightly below zero. One linear scan finds every maximal
segment of a text. Its significance follows the extreme-value law of such maxima: a text of n tokens is expected to
hold ``k * n * exp(-decay * s)`` segments of score s by chance. A document's score is a logistic function of its
most significant segment and the rest, fitted on training documents that were left out of the log-odds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.llm.common import crc_class, slices, stored

CHUNK_BYTES = 4_000_000
EDGE = ".,;:!?\"'()[]"


@dataclass(frozen=True)
class Settings:
    train_docs: int = 20_000       # expected labelled documents of each class in the log-odds, and again in the fit
    prior: float = 0.01            # weight of the Dirichlet prior as a share of the training texts
    significance: float = 5.0      # likelihood ratio a token needs beyond what the number of tokens explains
    tokens: int = 50_000           # tokens kept, the most significant first
    drift: float = 0.05            # taken from every token's score: a passage ends where evidence stops
    expected: float = 0.01         # a passage is significant if fewer than this are expected by chance
    start: int = 4                 # letters of a word's beginning, which stands in for words not counted themselves


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 0.1
    start: int = 4
    decay: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def weight(self, word: str) -> float:
        word = word.strip(EDGE)
        own = self.weights.get(word)
        if own is None and len(word) > self.start:
            own = self.weights.get(word[:self.start] + "*")
        return (own or 0.0) - self.drift

    def evidence(self, scores: list[float], n: int) -> float:
        """Minus the log of the number of such segments expected by chance, the strongest first and whole, the
        others by what they add."""
        if not scores:
            return 0.0
        base = self.log_k + np.log(max(n, 1))
        each = sorted((self.decay * s - base for s in scores), reverse=True)
        return max(each[0], 0.0) + sum(e for e in each[1:] if e > 0)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.offset, -30, 30)))


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` of a sequence, in one pass.

    Runs of values that are not positive only move the running total, so the loop sees the positive ones alone.
    """
    hits = np.nonzero(values > 0)[0]
    if not len(hits):
        return []
    total = np.cumsum(values)
    found: list[list[float]] = []          # first, last, total before the first, total after the last
    for i in hits.tolist():
        item = [i, i, total[i] - values[i], total[i]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j -= 1
            if j < 0 or found[j][3] >= item[3]:
                found.append(item)
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            del found[j:]
    return [(int(f), int(t), float(b - a)) for f, t, a, b in found]


def _words(texts: pa.Array) -> pa.ListArray:
    """Lower-cased words between white space of any kind, for training and scanning alike."""
    return pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))


def _tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words, the place of each word among them, and the bounds of the texts."""
    lists = _words(texts)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def scan(texts: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """Words and maximal segments of each text; segments count words from 0."""
    words, place, bounds = _tokens(texts)
    weights = np.fromiter(map(model.weight, words), np.float64, len(words))
    blank = np.fromiter((not w for w in words), bool, len(words))
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = place[first:last]
        own = own[~blank[own]] if len(own) else own
        yield len(own), segments(weights[own]) if len(own) else []


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int]]:
    yield from slices([len(v) if v is not None else 0 for v in batch.column(column).cast(pa.large_binary()).to_pylist()],
                      CHUNK_BYTES)


def log_odds(counts: pd.DataFrame, toxic_texts: int, clean_texts: int, settings: Settings,
             tried: int | None = None) -> dict[str, float]:
    """Log-odds of the tokens that toxic texts hold significantly more often. ``counts``: ``token, toxic, clean``,
    the numbers of different texts with the token.

    The prior of a token follows its share of all texts. A likelihood ratio decides what is significant; its bound
    rises with the number of tokens ``tried``, those of ``counts`` unless told.
    """
    toxic, clean = counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float)
    everything = toxic_texts + clean_texts
    prior = max(2.0, settings.prior * everything)
    alpha = prior * (toxic + clean) / everything
    odds = (np.log((toxic + alpha) / np.maximum(toxic_texts + prior - toxic - alpha, 0.5))
            - np.log((clean + alpha) / np.maximum(clean_texts + prior - clean - alpha, 0.5)))
    even = toxic_texts / everything
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(toxic > 0, toxic * np.log(toxic / ((toxic + clean) * even)), 0)
                     + np.where(clean > 0, clean * np.log(clean / ((toxic + clean) * (1 - even))), 0))
    table = pd.DataFrame({"token": counts["token"], "odds": odds, "ratio": ratio})
    bound = 2 * np.log(max(tried or len(table), 1)) + settings.significance
    table = table[(ratio > bound) & (odds > settings.drift)].sort_values(["ratio", "token"], ascending=[False, True])
    return dict(zip(table["token"].head(settings.tokens), table["odds"].head(settings.tokens)))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Model | None:
    """Fold 0 gives the log-odds, fold 2 the chance law and the logistic fit; None if a class is missing."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        (F.max(label) > 0).cast("int").alias("_label")).withColumn("_fold", crc_class(key, 3)).where("_fold <> 1")
    size = {row[0]: row[1] for row in known.groupBy("_label").count().collect()}
    if not size:
        return None
    # rare toxic texts are all taken while their number allows it; the fit allows for the classes' shares
    share = {label_: min(1.0, 2.0 * settings.train_docs / n) for label_, n in size.items()}
    u = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(7)), 11).cast("double") * 2.0 ** -53
    picked = known.where(u < F.when(F.col("_label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))).withColumnRenamed(
        key, "_id")
    # the sample is bounded by train_docs, whatever the size of the tables
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    sample = stored(texts.join(F.broadcast(picked), F.col("_key") == F.col("_id")).select("_text", "_label", "_fold"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen, texts = {0: Counter(), 1: Counter()}, [0, 0]
            for listed, label_ in zip(_words(pa.array(batch["_text"], pa.string())).to_pylist(), batch["_label"]):
                words = {x.strip(EDGE) for x in listed} - {""}
                seen[int(label_)].update(words | {w[:settings.start] + "*" for w in words if len(w) > settings.start})
                texts[int(label_)] += 1
            tokens = sorted(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"token": ["", *tokens], "toxic": [texts[1], *(seen[1][t] for t in tokens)],
                                "clean": [texts[0], *(seen[0][t] for t in tokens)]})

    # copies of a text count once
    once = sample.where("_fold = 0 and _text is not null").groupBy("_text").agg(F.max("_label").alias("_label"))
    counted = stored(once.mapInPandas(count, "token string, toxic long, clean long").groupBy("token").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    sizes = counted.where("token = ''").first()
    if sizes is None or not sizes["toxic"] or not sizes["clean"]:
        return None
    tokens = counted.where("token <> '' and toxic > 0")
    tried, even = tokens.count(), sizes["toxic"] / (sizes["toxic"] + sizes["clean"])
    both = F.col("toxic") + F.col("clean")
    ratio = 2 * (F.col("toxic") * F.log(F.col("toxic") / (both * even)) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - even)))).otherwise(0.0))
    # only tokens that may be significant reach the driver, the most significant first
    bound = 2 * float(np.log(max(tried, 1))) + settings.significance
    shared = tokens.withColumn("_ratio", ratio).where((F.col("_ratio") > bound - 1e-6) & (
        F.col("toxic") > both * even)).orderBy(F.desc("_ratio"), "token").limit(2 * settings.tokens).toPandas()
    weights = log_odds(shared, sizes["toxic"], sizes["clean"], settings, tried)
    model = Model(weights, settings.drift, settings.start)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _chunks(batch, 0):
                found = list(scan(batch.column(0).slice(first, last - first), model))
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(first, last - first), pa.array([n for n, _ in found], pa.int64()),
                    pa.array([[s for _, _, s in f] for _, f in found], pa.list_(pa.float64()))], ["_label", "n", "scores"])

    seen = sample.where("_fold = 2").select("_text", "_label").mapInArrow(
        measure, "_label int, n long, scores array<double>").toPandas()
    fitted = _calibrate(model, seen)
    # the odds of the sample hold more toxic texts than those of the table where only the clean ones were thinned
    return replace(fitted, offset=fitted.offset - float(np.log(share.get(1, 1.0) / share.get(0, 1.0))))


def _calibrate(model: Model, seen: pd.DataFrame) -> Model:
    """Chance law from clean documents, then a logistic fit of the labels on the evidence."""
    clean = seen[seen["_label"] == 0]
    scores = np.concatenate([np.zeros(0), *[np.asarray(s) for s in clean["scores"]]])
    # exponential tail of chance scores, kept proper by one pseudo-segment per unit of score
    decay = (len(scores) + 1) / (scores.sum() + 1) if len(scores) else 1.0
    log_k = float(np.log((len(scores) + 1) / (clean["n"].sum() + 1)))
    model = replace(model, decay=float(min(decay, 2.0)), log_k=log_k)
    x = np.log1p([model.evidence(list(s), n) for s, n in zip(seen["scores"], seen["n"])])
    y = (seen["_label"].to_numpy() > 0).astype(float)
    if not len(x) or y.min() == y.max():
        return model
    scale = x.std() or 1.0
    a, b = 1.0, -1.0
    for _ in range(60):                # damped Newton steps with a slight pull of the slope to one
        p = 1 / (1 + np.exp(-np.clip(a * x / scale + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x / scale).sum() + 0.5 * (a - 1), (p - y).sum()])
        h = np.array([[(w * (x / scale) ** 2).sum() + 0.5, (w * x / scale).sum()], [(w * x / scale).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return replace(model, slope=float(a / scale), offset=float(b))


def find_passages(docs: DataFrame, model: Model | None, settings: Settings = Settings(), key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """``key, score, passages`` per row; a passage is ``first, last`` word, its score and the number expected by
    chance. Without a model every score is 0."""
    passage = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()),
                                  ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _chunks(batch, 1):
                texts = batch.column(1).slice(start, stop - start)
                evidence, spans = np.zeros(stop - start), [[] for _ in range(stop - start)]
                if model is not None:
                    for i, (n, found) in enumerate(scan(texts, model)):
                        evidence[i] = model.evidence([s for _, _, s in found], n)
                        listed = [(f, t, s, float(np.exp(min(50.0, model.log_k + np.log(n) - model.decay * s))))
                                  for f, t, s in found]
                        spans[i] = [dict(zip(("first", "last", "score", "expected"), p)) for p in listed
                                    if p[3] < settings.expected]
                score = model.probability(evidence) if model is not None else evidence
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(score),
                                                  pa.array(spans, passage)], ["_key", "score", "passages"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"_key {kind}, score double, "
        "passages array<struct<first:int,last:int,score:double,expected:double>>").withColumnRenamed("_key", key)


def rate(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.7,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted, n_passages`` per row.

    Labels are read only for ids outside fold 1, and only the text is scored. NULL and empty texts have no evidence.
    Repeated rows are kept, several labels of an id count as toxic if one is, NULL ids are never held out, an empty
    table gives no rows.
    """
    found = find_passages(docs, train(docs, labels, settings, key, text), settings, key, text)
    return found.select(key, (crc_class(key, 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"),
                        F.size("passages").cast("bigint").alias("n_passages"))
