import random

from sigmill.llm import jaccard as J
from sigmill.llm import simhash

from .helpers import DOCS, ODD, docs, got, prose


def grams(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def slow_kept(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    best = {}
    for (k, _), r in zip(rows, root, strict=True):
        best[r] = min(best.get(r, (True, 0)), (k is None, k or 0))
    return sorted(((None if z else k,) for z, k in best.values()), key=repr)


def changed(rng, text, n):
    words = text.split(" ")
    for at in rng.sample(range(len(words)), n):
        words[at] = f"other{rng.randrange(10**9)}"
    return " ".join(words)


def near_copies(rng):
    out = []
    for n in (40, 100, 400):
        for _ in range(6):
            out.append(prose(rng, n, 4000))
            out += [changed(rng, out[-1], rng.randint(1, max(1, n // 35))) for _ in range(4)]
    base = prose(rng, 60, 4000)
    out += [base] + [changed(rng, base, 1) for _ in range(80)]  # one large group
    common = prose(rng, 60, 4000)  # a passage that many texts have, none of them a copy
    out += [f"{common} {prose(rng, 120, 4000)}" for _ in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


def test_matches_brute_force(spark):
    rows = near_copies(random.Random(1))
    want = slow_kept(rows)
    assert got(J.near_dedup(docs(spark, rows)), "doc_id") == want
    assert len(want) < simhash.near_dedup(docs(spark, rows)).count() < len(rows)


def test_rounds_against_one_member(spark, monkeypatch):
    monkeypatch.setattr(J, "OPEN_PAIRS", 0)
    rows = near_copies(random.Random(2))
    assert got(J.near_dedup(docs(spark, rows)), "doc_id") == slow_kept(rows)


def test_null_and_repeated_keys(spark):
    rng = random.Random(3)
    x, y, z, u, v, w = (prose(rng, 80) for _ in range(6))
    rows = [(1, x), (None, changed(rng, x, 1)), (None, y), (None, z), (2, u), (2, v), (3, x + " end"), (3, w), (4, w), (4, w)]
    out = got(J.near_dedup(docs(spark, rows)), "doc_id", "text")
    assert out == sorted([(1, x), (None, y), (None, z), (2, u), (2, v), (3, w)], key=repr)


def test_odd_and_empty(spark):
    assert [k for (k,) in got(J.near_dedup(docs(spark, ODD)), "doc_id")] == [1, 4, 5, 7]
    assert J.near_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprints_find_near_copies_themselves(spark, monkeypatch):
    """The SimHash step does its part without the index of prefixes: whole groups of long texts with few changes."""
    rng = random.Random(4)
    base = [prose(rng, 400, 4000) for _ in range(5)]
    rows = [t for b in base for t in [b, *(changed(rng, b, rng.randint(1, 3)) for _ in range(20))]] + [prose(rng, 400, 4000) for _ in range(30)]
    rows = list(enumerate(rows))
    assert len(slow_kept(rows)) == 35
    entries = J._entries
    monkeypatch.setattr(J, "_entries", lambda sets, rarity: entries(sets, rarity).limit(0))
    assert 35 <= J.near_dedup(docs(spark, rows)).count() <= 40


def test_links_of_fingerprints_are_similar(spark):
    rows = near_copies(random.Random(5))
    sets = J.token_sets(docs(spark, rows), "text", "doc_id").dropDuplicates(["sid"]).cache()
    own = {r["sid"]: grams(rows[r["doc_id"]][1]) for r in sets.collect()}
    near, found = J.by_fingerprint(sets, J._bitmaps(sets))
    near, found = ({(r["a"], r["b"]) for r in x.collect()} for x in (near, found))
    assert found and found == {(a, b) for a, b in near if similar(own[a], own[b])}


def test_arrow_batches_are_as_before_afterwards(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    J.near_dedup(docs(spark, [(1, "a b"), (2, "c d")]))
    assert spark.conf.get(name) == was


def test_small_tables_have_few_files(spark, monkeypatch):
    """Each file costs an executor a process; a table of a few rows is not split into one for each shuffle partition."""
    from sigmill.llm import common

    files, real = {}, common.written

    def counted(df, hint="t", *size):
        out = real(df, hint, *size)
        files.setdefault(hint, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common, "written", counted)
    monkeypatch.setattr(J, "written", counted)
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(40)]
    rows = [(i, base[i % 40] + (" one" if i % 3 else "")) for i in range(160)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert got(J.near_dedup(docs(spark, rows)), "doc_id") == slow_kept(rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {k: max(files[k]) for k in ("sids", "star", "best", "kept", "gone")} == dict.fromkeys(("sids", "star", "best", "kept", "gone"), 1), files
    assert files["cc"][-1] == 1
