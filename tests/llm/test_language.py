import math
import random
import zlib
from collections import Counter

import numpy as np
from odd_rows import TEXTS
from pyspark.sql import functions as F

from stationloom.llm import language


def plain_model(counts, alphabet):
    """Interpolated Kneser-Ney over strings, straight from its definition."""
    orders = {language.ORDER: counts}
    for n in range(language.ORDER - 1, 0, -1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    discount, total, kinds = {}, {}, {}
    for n, table in orders.items():
        once, twice = (sum(v == k for v in table.values()) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once and twice else 0.5
        total[n], kinds[n] = Counter(), Counter()
        for g, c in table.items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / alphabet
        lower = p(gram[1:])
        if not total[n][gram[:-1]]:
            return lower
        mass = total[n][gram[:-1]]
        return max(orders[n][gram] - discount[n], 0) / mass + discount[n] * kinds[n][gram[:-1]] / mass * lower

    return p


def grams(text):
    codes = language.symbols(text, language._letters())
    keys = language.keys_of(codes)
    return [tuple(int(k) >> 16 * i & 0xFFFF for i in (3, 2, 1, 0)) for k in keys], keys


def test_probabilities_by_definition():
    texts = {"x": "abra cadabra abra banana bandana " * 3, "y": "thin think thing this that then " * 3}
    tables = []
    for t in texts.values():
        keys, n = np.unique(grams(t)[1], return_counts=True)
        tables.append((keys, n))
    models = language.Models(list(texts), tables)
    alphabet = len(models.keys[1]) + 1
    plain = [plain_model(Counter(grams(t)[0]), alphabet) for t in texts.values()]
    for probe in ("abra thing", "banthi xaq", "cadet"):
        found = models.score(grams(probe)[1])
        for gram, row in zip(grams(probe)[0], found):
            for column, p in enumerate(plain):
                if gram[-1:] in {g[-1:] for t in texts.values() for g in grams(t)[0]}:
                    assert math.isclose(row[column], math.log2(p(gram)), abs_tol=1e-3)


def test_held_out_accuracy(given):
    rows = language.identify(given).join(given.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(odd, empty):
    found = language.identify(odd).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        assert r.lang_pred in ("en", "de", "fr", "es", "und")
    none = {t for _, t, _, _ in TEXTS if not any(c.isalpha() for c in t or "")}
    assert sum(r.lang_pred == "und" for r in found) == sum(t in none for _, t, _, _ in TEXTS)
    assert language.identify(empty).count() == 0
    unknown = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}


def test_labels_of_held_out_rows_are_not_read(given):
    other = given.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise(
        F.col("lang")))
    def view(df):
        return sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.identify(df).collect())
    assert view(given) == view(other)


def test_language_of_one_fold_only(spark):
    def fold(i):
        return zlib.crc32(str(i).encode()) % 3

    rng = random.Random(2)
    words = {"aa": ["river", "house", "green", "stone", "water"], "bb": ["fluss", "haus", "stein", "wasser", "baum"],
             "cc": ["joki", "talo", "kivi", "vesi", "puuta"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for i in range(900) for lang in [("aa", "bb", "cc")[i // 300]]
            if lang != "cc" or fold(i) != 0]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert {r.lang_pred for r in held} == {"aa", "bb", "cc"}
