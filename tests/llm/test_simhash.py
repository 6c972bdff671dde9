import random

import xxhash

from sigmill.llm import simhash as S

from .helpers import DOCS, ODD, docs, got, prose


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints(spark):
    rng = random.Random(1)
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(50 + i, prose(rng, i)) for i in range(1, 40)]
    found = dict(got(S.fingerprints(docs(spark, rows)), "doc_id", "fp"))
    assert {i: x % (1 << 64) for i, x in found.items()} == {i: slow_fingerprint(t) for i, t in rows}


def star_table(spark, fps):
    nodes = spark.createDataFrame([(S._signed(f),) for f in set(fps.values())], "fp long")
    links = S.links(nodes)
    pairs = {tuple(r) for r in links.collect()}
    assert all(a != b for a, b in pairs)
    return S.components(links)


def test_links_match_brute_force(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(60)] + [0, 1, 3, 7, 15, (1 << 64) - 1, (1 << 63)]
    for v in values[:40]:
        for _ in range(4):
            for _ in range(rng.randint(1, 3)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    base = rng.getrandbits(64)
    values += [base ^ sum(1 << b for b in rng.sample(range(16), 3)) for _ in range(300)]  # a full posting list
    fps = dict(enumerate(dict.fromkeys(values)))
    want = slow_components(fps)
    root = {r["a"]: r["b"] for r in star_table(spark, fps).collect()}
    mine = {}
    for i, f in fps.items():
        mine.setdefault(root.get(S._signed(f), S._signed(f)), set()).add(i)
    theirs = {}
    for i, r in want.items():
        theirs.setdefault(r, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_long_chain(spark):
    fps = {i: ((1 << i) - 1) for i in range(0, 65)}
    root = {r["a"]: r["b"] for r in star_table(spark, fps).collect()}
    assert len(root) == 64 and len(set(root.values())) == 1


def test_clusters(spark):
    rng = random.Random(3)
    long = prose(rng, 3000, 3000)
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(20, long), (21, long.upper()), (22, long + " end"), (23, prose(rng, 300))]
    rows += [(5, "a"), (5, "a")]
    found = got(S.clusters(docs(spark, rows)), "doc_id", "component_id")
    fps = {i: slow_fingerprint(t) for i, t in rows}
    want = slow_components(fps)
    assert found == sorted([(i, want[i]) for i, _ in rows], key=repr)
    assert want[21] == want[22] == 20


def test_near_dedup(spark):
    rows = [(9, "one two three"), (4, "One two  three"), (7, "else"), (None, None), (3, ""), (3, "")]
    d = docs(spark, rows).withColumnRenamed("n_chars", "_key")
    out = S.near_dedup(d)
    assert out.columns == d.columns
    assert got(out, "doc_id") == [(3,), (4,), (7,)]


def test_near_dedup_null_and_repeated_keys(spark):
    rng = random.Random(4)
    x, y, z, u, v, w = (prose(rng, 80) for _ in range(6))
    rows = [(1, x), (None, x.upper()), (None, y), (None, z), (2, u), (2, v), (3, x + " "), (3, w), (4, w), (4, w)]
    out = got(S.near_dedup(docs(spark, rows)), "doc_id", "text")
    assert out == sorted([(1, x), (None, y), (None, z), (2, u), (2, v), (3, w)], key=repr)


def test_empty_table(spark):
    d = spark.createDataFrame([], DOCS)
    assert S.clusters(d).count() == 0 and S.near_dedup(d).count() == 0
