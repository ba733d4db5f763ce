import xxhash
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from stationloom.llm import simhash

from odd_rows import TEXTS


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(points, bits=2):
    """Smallest id of each point's group, by comparing all pairs."""
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if bin(points[i][1] ^ points[j][1]).count("1") <= bits:
                parent[root(i)] = root(j)
    ids = {}
    for i, (key, _) in enumerate(points):
        ids.setdefault(root(i), []).append(key)
    smallest = {r: min((k for k in keys if k is not None), default=None) for r, keys in ids.items()}
    return [smallest[root(i)] for i in range(len(points))]


@settings(max_examples=60, deadline=None)
@cases(st.text(alphabet="aAbB .\n\té你", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_odd_rows(odd):
    points = [(i, plain_print(t)) for i, t, _, _ in TEXTS]
    want = sorted(((k, f"{p:016x}", c) for (k, p), c in zip(points, components(points))), key=repr)
    found = simhash.near_groups(odd).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted([tuple(r) for r in found], key=repr) == want


def near_points():
    import random

    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(20)]
    out = []
    for v in values:
        for _ in range(12):                      # chains of small steps, pairs at two bits, a crowd
            v ^= 1 << rng.randrange(64)
            out.append(v)
            out.append(v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    crowd = rng.getrandbits(64)
    return sorted({*out, *(crowd ^ (1 << i) for i in range(40)), 0, 3, (1 << 64) - 1})


def test_links_lose_nothing(spark):
    from stationloom.operators.spatial import connected_components

    values = near_points()
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "_fp long")
    for bits, crowd in ((2, 1000), (2, 3), (1, 1000), (1, 3)):
        edges = simhash.links(prints, bits, crowd)
        pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in edges.collect()]
        assert all(bin(a ^ b).count("1") <= bits for a, b in pairs) or bits == 2 and crowd == 3
        assert all(bin(a ^ b).count("1") <= 2 for a, b in pairs)
        label = {r.node % (1 << 64): r.label for r in connected_components(edges).collect()}
        want = components([(v, v) for v in values], bits)
        groups = {}
        for v, w in zip(values, want):
            groups.setdefault(w, set()).add(v)
        found = {}
        for v in values:
            found.setdefault(label.get(v, ("own", v)), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_one_of_each_group_stays(odd, empty):
    points = [(i, plain_print(t)) for i, t, _, _ in TEXTS]
    want = sorted([k for (k, _), c in zip(points, components(points)) if k == c], key=repr)
    stay = simhash.keep_one(odd)
    assert stay.columns == odd.columns
    assert set(want) <= {r.doc_id for r in stay.select("doc_id").collect()}
    assert simhash.near_groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0
