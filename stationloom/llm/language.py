"""Language identification with interpolated Kneser-Ney character models.

Each language has a model over four characters. All models share sorted arrays of n-gram keys, one array per order,
with one column of log-probabilities per language, so a text is scored for all languages by one search per character.
The language with the lowest cross-entropy per character wins. Scores and the rejection bound are calibrated on
training documents that were left out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.llm.common import crc_class, slices, stored

ORDER = 4
CHUNK_BYTES = 1_000_000
MASK = [0, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFF]
UNDECIDED = "und"


@dataclass(frozen=True)
class Settings:
    train_docs: int = 2000         # expected documents per language in the counts, and again in the calibration
    grams: int = 300_000           # 4-grams kept per language, the commonest first
    languages: int = 64            # languages learned, those with most documents
    reject_sigmas: float = 4.0     # a text this far above its language's usual cross-entropy is rejected


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)


def symbols(text: str, letters: np.ndarray) -> np.ndarray:
    """Lower-cased letters as 16-bit codes, one space for anything between them, a space at both ends.

    Characters beyond 16 bits are folded into them. Empty if there is no letter.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    wide = codes > 0xFFFF
    if wide.any():
        is_letter = letters[np.where(wide, 0, codes)]
        is_letter[wide] = [chr(c).isalpha() for c in codes[wide]]
        codes = (codes ^ codes >> 16) & 0xFFFF
    else:
        is_letter = letters[codes]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    codes = np.where(is_letter, codes, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    kept = codes[keep].astype(np.uint64)
    return np.concatenate([[32], kept, [32]] if kept[-1] != 32 else [[32], kept]).astype(np.uint64)


def keys_of(codes: np.ndarray) -> np.ndarray:
    """Key of the 4-gram that ends at each symbol after the first; the text is preceded by spaces."""
    padded = np.concatenate([np.full(ORDER - 2, 32, np.uint64), codes])
    key = padded[ORDER - 1:].copy()
    for back in range(1, ORDER):
        key |= padded[ORDER - 1 - back:-back] << np.uint64(16 * back)
    return key


class Models:
    """Kneser-Ney log2-probabilities of all languages in sorted key arrays.

    ``keys[n]`` and ``logp[n]`` hold the n-grams seen in any language, ``contexts[n]`` and ``backoff[n]`` the log2 of
    the mass a context of n symbols leaves to the shorter model (0 where a language has not seen the context).
    """

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = languages
        self.keys, self.logp, self.contexts, self.backoff = {}, {}, {}, {}
        size = len(languages)
        # counts of order n-1 are the numbers of different left neighbours in order n
        by_order: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for key, n in counts:
            orders = {ORDER: (key, n.astype(np.int64))}
            for order in range(ORDER - 1, 0, -1):
                orders[order] = np.unique(orders[order + 1][0] & np.uint64(MASK[order]), return_counts=True)
            by_order.append(orders)
        for order in range(1, ORDER + 1):
            self.keys[order] = np.unique(np.concatenate([o[order][0] for o in by_order]))
            self.contexts[order - 1] = np.unique(self.keys[order] >> np.uint64(16))
            self.logp[order] = np.zeros((len(self.keys[order]), size), np.float32)
            self.backoff[order - 1] = np.zeros((len(self.contexts[order - 1]), size), np.float32)
        alphabet = len(self.keys[1]) + 1
        self.floor = float(-np.log2(alphabet * 4.0))
        for column, orders in enumerate(by_order):
            lower = np.full(len(self.keys[1]), 1.0 / alphabet)
            for order in range(1, ORDER + 1):
                key, n = orders[order]
                union, contexts = self.keys[order], self.contexts[order - 1]
                count = np.zeros(len(union))
                count[np.searchsorted(union, key)] = n
                once, twice = (count == 1).sum(), (count == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                at = np.searchsorted(contexts, union >> np.uint64(16))
                total = np.bincount(at, count, len(contexts))
                kinds = np.bincount(at, count > 0, len(contexts))
                seen = total > 0
                left = np.where(seen, discount * kinds / np.maximum(total, 1), 1.0)
                if order > 1:
                    below = self.keys[order - 1]
                    lower = lower_all[np.searchsorted(below, union & np.uint64(MASK[order - 1]))]
                p = np.maximum(count - discount, 0) / np.maximum(total[at], 1) + left[at] * lower
                lower_all = p
                self.logp[order][:, column] = np.log2(p)
                self.backoff[order - 1][:, column] = np.log2(left)

    def score(self, key: np.ndarray) -> np.ndarray:
        """log2-probabilities of each 4-gram's last symbol, one column per language."""
        out = np.empty((len(key), len(self.languages)), np.float32)
        rest, order = np.arange(len(key)), ORDER
        carried = None
        while len(rest):
            own = key[rest] & np.uint64(MASK[order])
            table = self.keys[order]
            at = np.searchsorted(table, own)
            at[at == len(table)] = 0
            hit = table[at] == own
            found = self.logp[order][at[hit]]
            out[rest[hit]] = found if carried is None else found + carried[hit]
            miss = ~hit
            rest = rest[miss]
            left = np.zeros((len(rest), out.shape[1]), np.float32) if carried is None else carried[miss]
            if order == 1:
                out[rest] = left + self.floor
                break
            context = own[miss] >> np.uint64(16)
            place = np.searchsorted(self.contexts[order - 1], context)
            place[place == len(self.contexts[order - 1])] = 0
            known = self.contexts[order - 1][place] == context
            left[known] += self.backoff[order - 1][place[known]]
            carried, order = left, order - 1
        return out

    def entropies(self, texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols scored and cross-entropies in bits per symbol; no symbols, no letters."""
        keys = []
        for text in texts:
            codes = symbols(text, letters)
            keys.append(keys_of(codes) if len(codes) else np.zeros(0, np.uint64))
        n = np.array([len(k) for k in keys], np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        if n.sum():
            scored = self.score(np.concatenate(keys))
            rows = np.nonzero(n)[0]
            starts = (np.cumsum(n) - n)[rows]
            out[rows] = -np.add.reduceat(scored, starts, axis=0, dtype=np.float64) / n[rows, None]
        return n, out


def _sample(docs: DataFrame, shares: dict[str, float], fold: int, key: str, text: str, lang: str) -> DataFrame:
    """About ``train_docs`` documents of each language from one training fold, chosen by a hash of the id."""
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col(lang))
    u = F.shiftrightunsigned(F.xxhash64(key, F.lit(fold)), 11).cast("double") * 2.0 ** -53
    picked = docs.where(F.col(lang).isin(list(shares)) & F.col(text).isNotNull() & (crc_class(key, 3) == fold))
    return picked.where(u < share).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    letters = _letters()
    for batch in batches:
        for lang, group in batch.groupby("_lang"):
            sizes = [len(t) for t in group["_text"]]
            for start, stop in slices(sizes, CHUNK_BYTES):
                found = [keys_of(c) for t in group["_text"].iloc[start:stop] if len(c := symbols(t, letters))]
                if found:
                    key, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"_lang": lang, "_key": key.view(np.int64), "_n": n})


def train(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text",
          lang: str = "lang") -> tuple[Models, dict] | None:
    """Models from fold 0 and their calibration from fold 2; None if nothing can be learned.

    A language whose documents are all in fold 2 is learned from these and not calibrated.
    Counting is distributed and counts are summed before they reach the driver, where the bounded sample leaves at
    most ``grams`` rows for each language.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    fold = crc_class(key, 3)
    per_lang = usable.where(fold != 1).groupBy(lang).agg(F.count_if(fold == 0).alias("first"), F.count(F.lit(1)).alias(
        "all")).orderBy(F.desc("all"), lang).limit(settings.languages).collect()
    early = {r[0]: min(1.0, settings.train_docs / r["first"]) for r in per_lang if r["first"]}
    late = {r[0]: min(1.0, settings.train_docs / r["all"]) for r in per_lang if not r["first"]}
    shares = {**early, **late}
    if not shares:
        return None
    rows = [_sample(docs, part, of, key, text, lang) for part, of in ((early, 0), (late, 2)) if part]
    counted = stored(reduce(DataFrame.unionByName, rows).mapInPandas(
        _count, "_lang string, _key long, _n long").groupBy("_lang", "_key").agg(F.sum("_n").alias("_n")))
    tables, names = [], []
    for name in sorted(shares):
        table = counted.where(F.col("_lang") == name).orderBy(F.desc("_n"), "_key").limit(settings.grams).select(
            "_key", "_n").toPandas()
        if len(table):
            keys = table["_key"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(keys)
            names.append(name)
            tables.append((keys[order], table["_n"].to_numpy()[order]))
    if not names:
        return None
    models = Models(names, tables)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        for batch in batches:
            sizes = [len(t) for t in batch["_text"]]
            for start, stop in slices(sizes, CHUNK_BYTES):
                n, bits = models.entropies(batch["_text"].iloc[start:stop].tolist(), letters)
                yield pd.DataFrame({"_lang": batch["_lang"].iloc[start:stop].to_numpy(), "_n": n, "_bits": list(bits)})

    seen = _sample(docs, {k: v for k, v in early.items() if k in names} or shares, 2, key, text, lang).mapInPandas(
        measure, "_lang string, _n long, _bits array<double>").where("_n > 0").toPandas()
    return models, _calibrate(seen, names)


def _posterior(bits: np.ndarray, n: np.ndarray, sharpness: float) -> np.ndarray:
    """Probabilities of the languages; evidence grows with the length, slower than the length itself."""
    logit = -bits * (sharpness * np.sqrt(n))[:, None]
    logit -= logit.max(axis=1, keepdims=True)
    p = np.exp(logit)
    return p / p.sum(axis=1, keepdims=True)


def _calibrate(seen: pd.DataFrame, names: list[str]) -> dict:
    """Sharpness of the scores with the best likelihood, and the usual cross-entropy of each language."""
    usual = {name: (np.inf, 0.0) for name in names}
    if not len(seen):
        return {"sharpness": 1.0, "usual": usual}
    bits, n = np.vstack(seen["_bits"].to_numpy()), seen["_n"].to_numpy(float)
    truth = np.array([names.index(x) for x in seen["_lang"]])
    likelihood = {s: np.log(np.maximum(_posterior(bits, n, s)[np.arange(len(n)), truth], 1e-9)).mean()
                  for s in (0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2)}
    own = bits[np.arange(len(n)), truth]
    for i, name in enumerate(names):
        values = own[truth == i]
        if len(values) > 1:
            usual[name] = (float(np.median(values)), float(1.4826 * np.median(np.abs(values - np.median(values)))))
    return {"sharpness": max(likelihood, key=likelihood.get), "usual": usual}


def identify(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """``key, held_out, lang_pred, score, bits, rejected`` per row.

    Only text and language of rows outside fold 1 are learned from, and only the text is scored. ``lang_pred`` is
    ``und`` with score 0 where the text is NULL or has no letter, or nothing could be learned. ``bits`` is the
    cross-entropy per symbol; ``rejected`` marks texts unlike the language that fits best, and halves their score.
    Repeated rows are kept, NULL ids are never held out, an empty table gives no rows.
    """
    learned = train(docs, settings, key, text, lang)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            texts = batch.column(2)
            sizes = [len(v) if v is not None else 0 for v in texts.cast(pa.large_binary()).to_pylist()]
            for start, stop in slices(sizes, CHUNK_BYTES):
                size = stop - start
                names, scores = np.full(size, UNDECIDED, object), np.zeros(size)
                bits, rejected = np.full(size, np.nan), np.zeros(size, bool)
                if learned is not None:
                    models, calibration = learned
                    n, entropy = models.entropies([t or "" for t in texts.slice(start, size).to_pylist()], letters)
                    has = n > 0
                    best = entropy.argmin(axis=1)
                    sure = _posterior(entropy, n.astype(float), calibration["sharpness"])[np.arange(size), best]
                    middle, spread = np.array([calibration["usual"][x] for x in models.languages]).T
                    names[has] = np.array(models.languages, object)[best[has]]
                    bits[has] = entropy[np.arange(size), best][has]
                    rejected[has] = (bits > middle[best] + settings.reject_sigmas * np.maximum(spread[best], 0.05))[has]
                    scores[has] = np.where(rejected, sure / 2, sure)[has]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, size), batch.column(1).slice(start, size), pa.array(names, pa.string()),
                    pa.array(scores), pa.array(bits, from_pandas=True), pa.array(rejected)],
                    ["_key", "held_out", "lang_pred", "score", "bits", "rejected"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("_key"), (crc_class(key, 3) == 1).alias("held_out"), F.col(text).alias(
        "_text")).mapInArrow(predict, f"_key {kind}, held_out boolean, lang_pred string, score double, bits double, "
                             "rejected boolean").withColumnRenamed("_key", key)
