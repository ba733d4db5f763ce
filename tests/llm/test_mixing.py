from collections import Counter

import pytest
from pyspark.sql import functions as F

from stationloom.llm import mixing

from odd_rows import TEXTS


def targets(sizes, weights=(5.0, 2.0, 1.0), limit=3.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        scale = sum(weight[s] for s in sizes if s not in full)
        out = {s: limit * sizes[s] if s in full else rest * weight[s] / scale for s in sizes}
        more = {s for s in sizes if s not in full and out[s] >= limit * sizes[s]}
        if not more or len(full | more) == len(sizes):
            return {s: min(v, limit * sizes[s]) for s, v in out.items()}
        full |= more


def size_of(text):
    return len((text or "").encode().split())


def test_plan_of_odd_rows(odd):
    sizes = Counter()
    for _, t, _, s in TEXTS:
        sizes[s] += size_of(t)
    want = targets(sizes)
    rows = mixing.mix_plan(odd).collect()
    assert sorted(((r.doc_id, r["size"]) for r in rows), key=repr) == sorted(((i, size_of(t)) for i, t, _, _ in TEXTS), key=repr)
    by_size = {v: want[s] for s, v in sizes.items()}
    for r in rows:
        assert r.target == pytest.approx(by_size[r.source_size])
        assert r.taken % r["size"] == 0 if r["size"] else r.taken == 0
        assert r.taken <= 3 * r["size"]
    assert sorted(map(repr, mixing.mix_plan(odd.repartition(5)).collect())) == sorted(map(repr, rows))


def test_words_near_target(given):
    docs = given.select("doc_id", "text", "source")
    rows = mixing.copy_counts(mixing.word_sizes(docs), fan_in=8).collect()
    assert len(rows) == given.count()
    taken, target, longest = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r["size"])
        assert 0 <= r.copies <= 3
    for s in target:
        assert abs(taken[s] - target[s]) < longest[s]


def test_expected_copies_are_kept(spark):
    """Over many draws each document is taken about as often as its probability says."""
    base = spark.range(400).select(F.col("id").alias("_key"), F.lit("s").alias("source"), (5 + F.col("id") % 40).alias("size"))
    rows = mixing.copy_counts(base, weights=(1.0,), share=0.3, fan_in=16).collect()
    words = sum(r["size"] * r.copies for r in rows)
    assert words == pytest.approx(rows[0].target, abs=45)
    assert 0.2 < sum(r.copies for r in rows) / 400 < 0.4
    small = [r.copies for r in rows if r["size"] < 20]
    large = [r.copies for r in rows if r["size"] >= 30]
    assert abs(sum(small) / len(small) - sum(large) / len(large)) < 0.2


def test_documents_as_often_as_planned(odd, empty):
    plan = Counter()
    for r in mixing.mix_plan(odd).collect():
        plan[(r.doc_id, r["size"])] += r.taken // r["size"] if r["size"] else 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    found = Counter((r.doc_id, size_of(r.text)) for r in mixed.collect())
    assert {k: v for k, v in found.items() if k[1]} == {k: v for k, v in plan.items() if v}
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0
