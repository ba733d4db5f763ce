import hashlib
import math
import zlib
from collections import Counter, defaultdict

from stationloom.llm import sharding

from odd_rows import TEXTS


def score(key, shard, weight=1.0):
    n = int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16)
    return -math.log((n + 0.5) / 2 ** 52) / weight


def winner(key, weights):
    return min((score(key, s, w), s) for s, w in enumerate(weights) if w > 0)[1]


def test_rows_and_shards(odd):
    rows = sharding.assign_shards(odd, [1.0] * 8).collect()
    want = []
    for i, t, _, _ in TEXTS:
        key, raw = "null" if i is None else str(i), (t or "").encode()
        want.append((i, len(raw) + 1, zlib.crc32(raw), "key", winner(key, [1.0] * 8), winner(key, [1.0] * 9)))
    names = ("doc_id", "size", "text_crc32", "law", "shard", "grown_shard")
    assert sorted([tuple(r[n] for n in names) for r in rows], key=repr) == sorted(want, key=repr)
    assert all(r.grown_shard in (r.shard, 8) for r in rows)


def test_slots_have_no_gaps(spark):
    df = spark.range(3000).selectExpr("if(id % 7 = 0, null, id div 2) as doc_id", "'t' as text")
    rows = sharding.assign_shards(df, [1.0, 2.0, 0.0, 4.0], rows_per_task=50).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == {0, 1, 3}


def test_shares_follow_weights(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "'' as text")
    n = Counter(r.shard for r in sharding.assign_shards(df, [1.0, 2.0, 1.0]).select("shard").collect())
    assert abs(n[1] / 20000 - 0.5) < 0.02 and abs(n[0] / 20000 - 0.25) < 0.02


def test_empty(empty):
    assert sharding.assign_shards(empty, [1.0] * 8).count() == 0
