import hashlib
from collections import defaultdict

from stationloom.llm import exact_dedup

from odd_rows import TEXTS


def lowered(text):
    return (text or "").encode().lower().decode()


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in sorted(ids, key=lambda x: x != keep):
            out.append((i, keep, len(ids), i == keep and left > 0, hashlib.sha256(norm.encode()).hexdigest()))
            left -= i == keep
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=repr)


def test_groups_of_odd_rows(odd):
    want = expected([(i, t) for i, t, _, _ in TEXTS])
    assert got(exact_dedup.duplicate_groups(odd)) == want
    # blocks of three characters: many rounds of pairs
    assert got(exact_dedup.duplicate_groups(odd.where("length(coalesce(text, '')) < 500"), block_chars=3)) == [
        r for r in expected([(i, t) for i, t, _, _ in TEXTS if len(t or "") < 500])]


def test_rows_that_stay(odd):
    stay = exact_dedup.drop_duplicates(odd)
    assert stay.columns == odd.columns
    assert sorted(lowered(r.text) for r in stay.select("text").collect()) == sorted({lowered(t) for _, t, _, _ in TEXTS})


def test_hash_collisions_do_not_merge(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.pmod(real(c), F.lit(2)))
    df = spark.createDataFrame([(i, "abcdefgh"[i % 8] * 5 + "x" * (i % 3)) for i in range(48)], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(exact_dedup.duplicate_groups(df, block_chars=2)) == expected(rows)


def test_empty(empty):
    assert exact_dedup.duplicate_groups(empty).count() == 0
    assert exact_dedup.drop_duplicates(empty).count() == 0
