import math
from collections import Counter

from stationloom.llm import quality

from odd_rows import TEXTS


def counts(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts(odd, given):
    want = sorted(((i, *counts(t)) for i, t, _, _ in TEXTS), key=repr)
    assert sorted([tuple(r) for r in quality.judge(odd).select("doc_id", *COLUMNS).collect()], key=repr) == want
    texts = {r.doc_id: r.text for r in given.collect()}
    for r in quality.judge(given).collect():
        assert tuple(r[c] for c in COLUMNS) == counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def distance(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    part = [sum(a * math.log2(a / c) for a, c in zip(x, m) if a > 0) for x in (p, q)]
    return math.sqrt(max(0.0, sum(part) / 2))


def test_distances_by_hand(given):
    limits = quality.Limits()
    rows = [(r.doc_id, r.text or "", r.lang) for r in given.collect()]
    top = {}
    for lang in {x for _, _, x in rows if x}:
        seen = Counter(w for _, t, x in rows if x == lang for w in (b.decode() for b in t.encode().split())
                       if len(w) <= limits.common_chars)
        top[lang] = dict(sorted(seen.items(), key=lambda x: (-x[1], x[0].encode()))[:limits.common])
    total = {lang: sum(counts(t)[0] for _, t, x in rows if x == lang) for lang in top}
    vocabulary = sorted({w for table in top.values() for w in table})
    got = {r.doc_id: r for r in quality.judge(given).collect()}
    for key, text, _ in rows:
        words = [b.decode() for b in text.encode().split()]
        if len(words) < limits.word_words:
            assert got[key].word_distance is None
            continue
        own = Counter(w for w in words if w in set(vocabulary))
        p = [own[w] / len(words) for w in vocabulary]
        each = []
        for lang in top:
            q = [top[lang].get(w, 0) / total[lang] for w in vocabulary]
            each.append(distance([*p, max(0, 1 - sum(p))], [*q, max(0, 1 - sum(q))]))
        assert min(abs(d - got[key].word_distance) for d in each) < 2e-4


def test_rows_that_are_good(odd, empty):
    good = quality.keep_good(odd)
    assert good.columns == odd.columns
    verdict = Counter((r.doc_id,) for r in quality.judge(odd).where("kept").collect())
    assert Counter((r.doc_id,) for r in good.collect()) == verdict
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_without_languages(odd):
    from pyspark.sql import functions as F

    r = quality.judge(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(r) == len(TEXTS) and all(x.char_distance is None and x.kept == (not x.base_failed) for x in r)


def test_every_language_has_a_reference(spark):
    letters = "αβγδεζηθ"

    def text(k, size):
        words = ["".join(chr(ord(c) + 0) for c in (letters[i % 8], letters[i // 8], "abcdefghij"[k % 10])) for i in range(40)] \
            if k == 40 else [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}{chr(97 + k % 26)}{chr(97 + k // 26)}" for i in range(40)]
        return " ".join(words[(i * i + 3 * i) % 37] + ("" if i % 7 else str(i)) for i in range(size))

    rows = [(f"{k}-{n}", text(k, 300 if k < 40 else 80), f"l{k:02}") for k in range(41) for n in range(2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert got["40-0"].char_distance < 0.1           # by the references of 32 languages: far above 0.25
    assert [(i, r.kept) for i, r in got.items() if r.kept == r.base_failed] == []


def test_text_without_common_words_goes(spark, given):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    made = [(f"g{i}", " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
                               for _ in range(300)), None) for i in range(5)]
    docs = given.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang").union(
        spark.createDataFrame(made, "doc_id string, text string, lang string"))
    got = quality.judge(docs).collect()
    made_up = [r for r in got if r.doc_id.startswith("g")]
    assert len(made_up) == 5 and not any(r.kept or r.base_failed for r in made_up)
    clean = [r for r in got if not r.doc_id.startswith("g") and r.n_symbols == 0 and not r.base_failed]
    assert len(clean) > 50 and all(r.kept for r in clean)
