import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from odd_rows import TEXTS
from pyspark.sql import functions as F

from stationloom.llm import attention, scoring

SETTINGS = scoring.Settings(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, steps=40)


def test_gradients():
    rng = np.random.default_rng(0)
    model = attention.Model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids = rng.integers(0, 100, (3, attention.WINDOW))
    scored = rng.random((3, attention.WINDOW)) < 0.6
    target = rng.integers(0, attention.CLASSES, scored.sum())
    grads = model.gradients(ids, scored, target)[1]
    for name, value in model.p.items():
        at = (ids[0, 3], 2) if name == "embed" else tuple(s // 2 for s in value.shape)
        value[at] += 1e-5
        up = model.gradients(ids, scored, target)[0]
        value[at] -= 2e-5
        down = model.gradients(ids, scored, target)[0]
        value[at] += 1e-5
        assert math.isclose((up - down) / 2e-5, grads[name][at], rel_tol=1e-3, abs_tol=1e-7)


@pytest.mark.parametrize("scale", [1.0, 600.0])     # at the second one the exponents are too large for a float
def test_fast_gradients_equal_careful_ones(scale):
    rng, model, room = np.random.default_rng(4), attention.Model(2), attention.Room()
    model.p["up0"][:] = rng.standard_normal(attention.HIDDEN)
    model.p["out0"][:] = rng.standard_normal(attention.CLASSES)
    model.p["out"] *= np.float32(scale)
    for n in (5, 64, 3):                            # the room of a larger batch serves a smaller one
        ids = rng.integers(0, len(model.p["embed"]), (n, attention.WINDOW))
        scored = rng.random(ids.shape) < 0.7
        target = rng.integers(0, attention.CLASSES, int(scored.sum()))
        loss, grads = model.gradients(ids, scored, target, room)
        want_loss, want = model.careful_gradients(ids, scored, target)
        assert math.isclose(loss, want_loss, rel_tol=1e-4) and set(grads) == set(model.p)
        for name, value in want.items():
            assert grads[name].dtype == np.float32
            np.testing.assert_allclose(grads[name], value, rtol=1e-3, atol=1e-5 * np.abs(value).max())


def test_a_step_makes_no_large_arrays():
    """The arrays of a training step stay for the next one; each step asks for little besides."""
    rng, model, room = np.random.default_rng(6), attention.Model(), attention.Room()
    ids = rng.integers(0, len(model.p["embed"]), (64, attention.WINDOW))
    scored = np.ones(ids.shape, bool)
    target = rng.integers(0, attention.CLASSES, ids.size)
    model.gradients(ids, scored, target, room)
    tracemalloc.start()
    model.gradients(ids, scored, target, room)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_500_000                         # 5.5 MB before


def test_windows_score_each_position_once():
    lengths = np.array([0, 1, 31, 32, 33, 56, 57, 500])
    text, start, first = attention.windows(lengths)
    seen = Counter((t, s + k) for t, s, f in zip(text, start, first) for k in range(f, attention.WINDOW) if s + k < lengths[t])
    assert seen == Counter((t, i) for t, n in enumerate(lengths) for i in range(n))


def test_scores_are_a_distribution_and_causal():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50, 400).astype(float)
    texts = [rng.integers(0, 400, n) for n in (5, 40, 90)]
    vocabulary = attention.Vocabulary.learn(counts, texts)
    model = attention.Model()
    assert model.fit(texts, vocabulary, 399, steps=30)[-1] < 10
    total = 0.0
    for last in range(400):
        text = np.append(texts[1][:20], last)
        total += math.exp(model.score(attention.Stream.of([text], 399), vocabulary)[20])
    assert math.isclose(total, 1.0, rel_tol=1e-3)
    long, other = texts[2].copy(), texts[2].copy()
    other[60:] = 7
    a, b = (model.score(attention.Stream.of([t], 399), vocabulary) for t in (long, other))
    assert np.allclose(a[:60], b[:60], atol=1e-4) and not np.allclose(a[60:], b[60:])
    # texts side by side do not see each other
    both = model.score(attention.Stream.of([texts[0], long], 399), vocabulary)
    assert np.allclose(both[5:], a, atol=1e-4)


def check(rows, texts):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in texts}
    words = {(i, t): [*(t or "").encode().lower().split(), None] for i, t in texts}
    counts = Counter(w for i, t in texts if not held[i] for w in words[i, t])
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held[i], len(words[i, t]), sum(counts[w] > 0 for w in words[i, t]), n, round(sum(
        math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words[i, t]), 4)) for i, t in texts), key=repr)
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows), key=repr)
    assert found == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_odd_rows(odd, empty):
    check(scoring.score_texts(odd, SETTINGS).collect(), [(i, t) for i, t, _, _ in TEXTS])
    assert scoring.score_texts(empty, SETTINGS).count() == 0


def test_given_table_in_small_blocks(given, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 40_000)
    rows = scoring.score_texts(given, SETTINGS).collect()
    check(rows, [(r.doc_id, r.text) for r in given.collect()])


def test_learns_from_texts_of_any_length(spark):
    line = "a red fox runs over the old stone wall and the dog sleeps near an open door while it rains . "
    rows = [(f"d{i}", line.lower() * 700) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert min(len(t) for _, t in rows) > 50_000
    settings = scoring.Settings(SETTINGS.vocabulary, SETTINGS.pattern, steps=200)
    got = scoring.score_texts(docs, settings).collect()
    assert all(r.score > 0.8 * r.base_score for r in got)          # random weights: far below the baseline
    again = scoring.score_texts(docs.repartition(5), settings).collect()
    assert np.allclose([r.score for r in sorted(got)], [r.score for r in sorted(again)], rtol=1e-6)


def test_weights_learn_from_all_windows_of_a_large_table(spark, given, monkeypatch):
    docs = spark.range(200).select(F.expr("repeat('a red fox ', 100000)").alias("text"))       # 200 MB of text
    assert scoring.window_share(docs, SETTINGS) == 1.0
    # more groups than lots, each of them enters the average
    monkeypatch.setattr(scoring, "GROUP_WINDOWS", 700)
    blocks = scoring.word_blocks(given, SETTINGS)
    counts, states = scoring.subword_counts(blocks, SETTINGS), []
    for lots in (2, 128):
        monkeypatch.setattr(scoring, "LOTS", lots)
        states.append(scoring.train_model(blocks, SETTINGS, counts)[0].state())
    assert scoring.window_groups(blocks).count() > 2
    assert np.allclose(*states, rtol=1e-3, atol=1e-4)


def test_training_windows_and_counts_follow_the_table(given, monkeypatch):
    settings = scoring.Settings(SETTINGS.vocabulary, SETTINGS.pattern, window_share=0.2, window_bytes=0)
    coder = scoring.Subwords(settings)
    learned = [r.text or "" for r in given.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    texts = [np.array([i for w in coder.encode([w.decode() for w in t.encode().lower().split()]) for i in w] + [coder.end])
             for t in learned]
    want = len(attention.windows(np.array([len(t) for t in texts]))[0])
    blocks = scoring.word_blocks(given, settings)
    drawn = sum(len(r.marks) // 8 for r in blocks.collect())
    assert abs(drawn / want - 0.2) < 0.03
    all_windows = scoring.word_blocks(given, scoring.Settings(SETTINGS.vocabulary, SETTINGS.pattern))
    monkeypatch.setattr(scoring, "GROUP_WINDOWS", 700)
    groups = scoring.window_groups(all_windows).collect()
    assert len(groups) > 1 and sum(r.n for r in groups) == want
    scored = sum((attention.inputs_of(np.frombuffer(r.windows, "<i4").reshape(-1, attention.WINDOW + 1), coder.end,
                                      attention.Vocabulary.learn(np.ones(coder.size), []))[1]).sum() for r in groups)
    assert scored == sum(map(len, texts))          # each position once
    counts = scoring.subword_counts(blocks, settings)
    near = np.zeros((len(counts), attention.CLASSES - attention.GROUPS), np.int64)
    classes = attention.own_classes(counts)
    for t in texts:
        for i in range(len(t)):
            for j in range(max(0, i - 4), i):
                if classes[t[i]] >= near.shape[1] > classes[t[j]]:
                    near[t[i], classes[t[j]]] += 1
    # the end is no word and is counted apart
    assert (scoring.neighbour_counts(blocks, counts)[:-1] == near[:-1]).all()


def test_a_turn_reads_its_own_windows_only(given, monkeypatch):
    monkeypatch.setattr(scoring, "GROUP_WINDOWS", 700)
    blocks = scoring.word_blocks(given, SETTINGS)
    assert "windows" not in blocks.columns         # they are made from the words, not kept beside them
    whole = {r.group: np.frombuffer(r.windows, "<i4").reshape(-1, attention.WINDOW + 1) for r in scoring.window_groups(blocks).collect()}
    assert scoring.largest_group(blocks) == max(map(len, whole.values())) and len(whole) > 2
    for each in (100, 5000):                       # fewer than a group has, and more
        for r in scoring.window_groups(blocks, each).collect():
            n = len(whole[r.group])
            for t in range(scoring.ROUNDS):
                want = whole[r.group][np.arange(t * each, t * each + min(each, n)) % n]
                assert r.n == n and r[f"turn{t}"] == want.tobytes()
    # steps over the slice of a turn are those over the whole group
    counts = scoring.subword_counts(blocks, SETTINGS)
    vocabulary, rows = attention.Vocabulary.of(counts, scoring.neighbour_counts(blocks, counts)), whole[0]
    begin = np.arange(2 * 192, 2 * 192 + 192) % len(rows)
    a, b = (attention.Model().advance(attention.Model().state(), r, vocabulary, len(counts) - 1, 6, 9, 30)
            for r in (np.roll(rows, -2 * 192, axis=0), rows[begin]))
    assert np.array_equal(a, b)


def test_training_reads_coded_windows(given, monkeypatch):
    monkeypatch.setattr(scoring, "GROUP_WINDOWS", 700)
    blocks = scoring.word_blocks(given, SETTINGS)
    counts = scoring.subword_counts(blocks, SETTINGS)
    vocabulary, end, wide = attention.Vocabulary.of(counts, scoring.neighbour_counts(blocks, counts)), len(counts) - 1, attention.WINDOW + 1
    by_id, by_code = ({r.group: r for r in scoring.window_groups(blocks, 100, v).collect()} for v in (None, vocabulary))
    assert list(sorted(by_id)) == list(sorted(by_code)) and len(by_id) > 2
    room = [0, 0]
    for group, r in by_id.items():
        for t in range(scoring.ROUNDS):
            rows, data = np.frombuffer(r[f"turn{t}"], "<i4").reshape(-1, wide), by_code[group][f"turn{t}"]
            codes = scoring._unpacked(data, min(r.n, 100) * wide).reshape(-1, wide)
            ids, scored, target = attention.inputs_of(rows, end, vocabulary)
            found = attention.inputs_of_codes(codes, vocabulary.inputs[end])
            assert all(np.array_equal(a, b) for a, b in zip(found, (ids, scored, vocabulary.classes[target])))
            room[0], room[1] = room[0] + rows.size, room[1] + len(data)
    assert room[1] < 1.25 * room[0]                 # bytes an id, four before


def plain_log_prob(model: attention.Model, ids: list[int], at: int, target: int) -> float:
    """One position of one window by loops: attend to the places up to ``at``, then the dense part, then the classes."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    rows = [p["embed"][i] + p["place"][place] for place, i in enumerate(ids[:at + 1])]
    scores = [rows[at] @ p["q"] @ (row @ p["k"]) / np.sqrt(attention.WIDTH) for row in rows]
    weights = [math.exp(s - max(scores)) for s in scores]
    mixed = sum(w * (row @ p["v"]) for w, row in zip(weights, rows)) / sum(weights)
    h = rows[at] + mixed @ p["o"]
    top = h + np.maximum(h @ p["up"] + p["up0"], 0) @ p["down"]
    logits = top @ p["out"] + p["out0"]
    return logits[target] - logits.max() - math.log(sum(math.exp(z - logits.max()) for z in logits))


@pytest.mark.parametrize("scale", [1.0, 60.0])      # at the second one the exponents are too large for a float
def test_log_probs_equal_loops(scale):
    rng, model = np.random.default_rng(5), attention.Model(3)
    model.p["up0"][:] = rng.standard_normal(attention.HIDDEN)
    model.p["out0"][:] = rng.standard_normal(attention.CLASSES)
    model.p["out"] *= np.float32(scale)
    ids = rng.integers(0, len(model.p["embed"]), (3, attention.WINDOW))
    scored = rng.random(ids.shape) < 0.7
    target = rng.integers(0, attention.CLASSES, int(scored.sum()))
    room = attention.Room()
    found = [model.log_probs(ids, scored, target, room) for _ in range(2)]
    wanted = [plain_log_prob(model, ids[w].tolist(), at, t) for (w, at), t in zip(np.argwhere(scored), target)]
    for result in found:
        np.testing.assert_allclose(result, wanted, rtol=1e-3, atol=1e-3)
