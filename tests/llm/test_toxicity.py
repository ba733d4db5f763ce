import random
import zlib

import numpy as np
from odd_rows import TEXTS
from pyspark.sql import functions as F

from stationloom.llm import toxicity


def plain_segments(values):
    """Maximal segments by their definition: the best segment, then those of what is left on both sides."""
    best = None
    for i in range(len(values)):
        for j in range(i, len(values)):
            s = sum(values[i:j + 1])
            if s > 0 and (best is None or s > best[2] + 1e-12):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    right = [(a + j + 1, b + j + 1, c) for a, b, c in plain_segments(values[j + 1:])]
    return [*plain_segments(values[:i]), best, *right]


def test_segments():
    rng = random.Random(4)
    for _ in range(300):
        values = [rng.choice([-7, -3, -2, -1, 1, 2, 3, 5]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        found = toxicity.segments(np.array(values))
        want = plain_segments(values)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for _, _, s in found], [s for _, _, s in want])


def fixture(spark):
    rng = random.Random(6)
    plain = ["the", "house", "river", "is", "green", "and", "calm", "over", "there", "with", "trees"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "rotten", "wretch"]) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxic_passages_are_found(spark):
    docs, labels = fixture(spark)
    rows = toxicity.rate(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    model = toxicity.train(docs, labels)
    assert {"vilest", "rotten", "wretch"} <= set(model.weights)
    spans = toxicity.find_passages(docs.where("doc_id = 0"), model).first().passages
    text = docs.where("doc_id = 0").first().text.split()
    inside = [w.strip(",.") for s in spans for w in text[s.first:s.last + 1]]
    assert set(inside) & {"vilest", "rotten", "wretch"}


def test_held_out_labels_are_not_read(spark):
    docs, labels = fixture(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    def view(found):
        return sorted((r.doc_id, round(r.score, 9)) for r in toxicity.rate(docs, found).collect())
    assert view(labels) == view(other)


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (9, 1), (999, 1)], "doc_id long, toxic int")
    assert toxicity.rate(odd, labels).count() == len(TEXTS)
    assert toxicity.rate(empty, labels).count() == 0
    none = toxicity.rate(odd, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}


def test_any_white_space_parts_words(spark):
    docs, labels = fixture(spark)
    model = toxicity.train(docs, labels)
    odd = docs.withColumn("text", F.translate("text", " ", "\u00a0"))
    scores = [{r.doc_id: r.score for r in toxicity.find_passages(d, model).collect()} for d in (docs, odd)]
    assert scores[0] == scores[1]
    assert {r.doc_id: r.predicted for r in toxicity.rate(odd, labels).collect()} == {
        r.doc_id: r.predicted for r in toxicity.rate(docs, labels).collect()}


def test_tokens_of_two_toxic_texts_count_where_these_are_rare(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    toxic = [i for i in range(6000, 6100) if fold(i) == 0][:2] + [i for i in range(6000, 6100) if fold(i) == 2][:2]
    rows = [(i, f"plain words about house number {i}") for i in range(6000)]
    rows += [(i, f"plain words with vilest thing number {i}") for i in toxic]
    labels = spark.createDataFrame([(i, int(i >= 6000)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, toxicity.Settings(train_docs=1000))
    assert "vilest" in model.weights and "words" not in model.weights
