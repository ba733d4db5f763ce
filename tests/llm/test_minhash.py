import hashlib

import numpy as np
import xxhash

from stationloom.llm import minhash

from odd_rows import LONG, SCHEMA, TEXTS, rows_of

MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_shingles(text, words=5):
    """One at a time: the hashes of the words that end at each word, in sequence."""
    found = [mixed(xxhash.xxh64_intdigest(w)) for w in (text or "").encode().lower().split()]
    step = int(minhash.STEP)
    return [mixed(sum(found[i - b] * step ** b for b in range(min(words, i + 1))) & MASK) for i in range(len(found))]


def plain_signature(text):
    a, b = minhash.permutations()
    own = [s >> 32 for s in plain_shingles(text)]
    return [min(((int(f) * x + int(s)) & MASK for x in own), default=MASK) >> 32 for f, s in zip(a, b)]


def test_signatures_one_by_one():
    texts = ["", None, "one", "One two", "a b c d e f g", "x " * 30, "É naïve 世界 \x1c b\xa0c\n\nd e", " lead and trail \t"]
    hashes, sizes = minhash.shingles(texts)
    assert hashes.tolist() == [s for t in texts for s in plain_shingles(t)]
    assert minhash.signatures(hashes, sizes).tolist() == [plain_signature(t) for t in texts]


def test_long_text_in_runs(monkeypatch):
    texts = [LONG[:20_000], "", "tail of it", LONG[:9_000]]
    whole = minhash.signatures(*minhash.shingles(texts))
    monkeypatch.setattr(minhash, "RUN", 37)
    assert (minhash.signatures(*minhash.shingles(texts)) == whole).all()


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    off = []
    for share in (0.1, 0.5, 0.9):
        a = rng.choice(words, 400).tolist()
        b = a[:int(400 * share)] + rng.choice(words, 400 - int(400 * share)).tolist()
        p = minhash.fingerprints([" ".join(a), " ".join(b)])
        x, y = set(plain_shingles(" ".join(a))), set(plain_shingles(" ".join(b)))
        off.append((p[0] == p[1]).mean() - len(x & y) / len(x | y))
    assert max(map(abs, off)) < 0.15


def plain_likeness(rows):
    """Rows in order; those that repeat id and text are one document."""
    order = sorted({(i is not None, i or 0, xxhash.xxh64_intdigest((t or "").encode(), 42) - (1 << 64) * (
        xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63), t or "") for i, t in rows})
    out = {}
    for at, (real, i, _, text) in enumerate(order):
        following = order[(at + 1) % len(order)][3]
        n = len(text) // 4
        changed = text[:len(text) - n] + following[:n]
        p, e, f = (np.array(plain_signature(t)) & 0xFFFF for t in (text, changed, following))
        digits = lambda v: "".join(f"{x:04x}" for x in v.tolist())
        out[(i if real else None, text)] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), digits(p), digits(e),
                                            float((p == e).mean()), float((p == f).mean()))
    return sorted(((i, *out[(i, t or "")]) for i, t in rows), key=repr)


def test_edit_likeness(spark, odd, empty):
    # the very long texts would take the plain version minutes
    short = [(i, (t or "")[:4000] if t else t, lang, s) for i, t, lang, s in TEXTS]
    want = plain_likeness([(i, t) for i, t, _, _ in short])
    for parts in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = minhash.edit_likeness(spark.createDataFrame(rows_of(short), SCHEMA).repartition(3))
            assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                     "near_edited", "near_next"]
            assert sorted([tuple(r) for r in found.collect()], key=repr) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert minhash.edit_likeness(odd).count() == len(TEXTS)
    assert minhash.edit_likeness(empty).count() == 0


def test_repeated_row_over_many_ranges(spark):
    rows = [(5, "the same row again and again and again"), (9, "the last one of them")]
    table = spark.createDataFrame([rows[0]] * 400 + [rows[1], (1, "the first one of them")], "doc_id long, text string")
    found = minhash.edit_likeness(table.repartition(8)).collect()
    assert len(found) == 402 and len({tuple(r) for r in found}) == 3
    want = plain_likeness([(1, "the first one of them"), *rows])
    assert sorted({tuple(r) for r in found}, key=repr) == sorted(want, key=repr)


def test_one_document_is_its_own_next(spark):
    row = minhash.edit_likeness(spark.createDataFrame([(1, "one two three four five")], "doc_id long, text string")).first()
    changed = "one two three fourone t"
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()


def plain_groups(rows, similarity=0.8):
    sets = [set(plain_shingles(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / union if union else 1) >= similarity:
                parent[root(i)] = root(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(key)
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in ids.items()}
    return sorted(((k, least[root(i)]) for i, (k, _) in enumerate(rows)), key=repr)


def test_near_duplicates(spark, odd, empty):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(6):                        # chains: each text differs a little from the one before
        text = rng.choice(words, 120).tolist()
        for step in range(15):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for at in rng.integers(0, 120, 1 + step % 4):
                text[at] = str(rng.choice(words))
    rows += [(1000 + i, rows[3][1].upper()) for i in range(20)] + [(2000, ""), (2001, None), (None, rows[0][1])]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted([tuple(r) for r in found.collect()], key=repr) == plain_groups(rows)
    assert minhash.near_duplicates(odd).count() == len(TEXTS) and minhash.near_duplicates(empty).count() == 0
