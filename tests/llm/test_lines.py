import random
import re

import pytest

from sigmill.llm import lines as L
from sigmill.llm.queries import op5_line_dedup

from .helpers import DOCS, ODD, docs, got, prose


def brute(rows):
    own = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(x for x in re.split(r"[\x20\x09-\x0D]+", line) if x)
            if s:
                own.append(((i is None, i or 0, k), i, s))
    out, sets = {}, {s for _, _, s in own}
    linked = {s: {t for t in sets if 5 * len(s & t) >= 4 * len(s | t)} for s in sets}
    first = {}
    for at, _, s in own:
        first[s] = min(first.get(s, at), at)
    for at, i, s in own:
        removed, n = out.setdefault(i, (set(), 0))
        if min(first[t] for t in linked[s]) < at:
            removed.add(at[2])
        out[i] = (removed, n + len(linked[s]) - 1)
    return {i: (sorted(r), n) for i, (r, n) in out.items()}


def same(spark, rows):
    found = {r["doc_id"]: (r["removed"], r["n_links"]) for r in L.later_matches(docs(spark, rows)).collect()}
    assert found == brute(rows)


def edited(rng, line):
    w = line.split()
    for _ in range(rng.randint(0, max(1, len(w) // 6))):
        w[rng.randrange(len(w))] = rng.choice(["new", "word", "x"])
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = prose(rng, 60, 30 if seed == 1 else 300).replace("\n", " ").split()
    known, rows = [], []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 8)):
            if known and rng.random() < 0.5:
                own.append(edited(rng, rng.choice(known)))
            else:
                own.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))))
        known += [x for x in own if x]
        rows.append((i, "\n".join(own)))
    same(spark, rows)


def test_every_short_set(spark):
    """All sets of up to 5 of 6 words: the filters lose no pair at any length."""
    from itertools import combinations

    sets = [" ".join(c) for n in range(1, 6) for c in combinations("abcdef", n)]
    same(spark, list(enumerate(sets)))


def test_rarity_order_does_not_change_results(spark, monkeypatch):
    rows = [(1, "a b c d e f g h i j\nk"), (2, "a b c d e f g h i x"), (3, "j i h g f e d c b a"), (4, "k k\tk")]
    same(spark, rows)
    monkeypatch.setattr(L, "_rarity", lambda rows: bytes([1] * L.CELLS))
    same(spark, rows)


def test_odd_rows_and_empty_table(spark):
    same(spark, [r for r in ODD if r[0] != 5] + [(8, "a\n\na"), (9, " a \r\n")])
    assert L.later_matches(spark.createDataFrame([], DOCS)).count() == 0
    assert L.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_without_removed_lines(spark):
    d = docs(spark, [(1, "one two\nthree"), (2, "three\n\nfour"), (2, "three\n\nfour"), (3, None), (None, "two one")]).withColumnRenamed("lang", "_removed").withColumnRenamed("source", "line")
    out = L.dedup_lines(d)
    assert out.columns == d.columns
    assert got(out, "doc_id", "text") == sorted([(1, "one two\nthree"), (2, "\nfour"), (2, "\nfour"), (3, None), (None, "")], key=repr)


def test_rows_of_one_key_keep_their_own_lines(spark):
    d = docs(spark, [(1, "x y z"), (5, "x y z\nown a"), (5, "p q r\nown b")])
    assert got(L.dedup_lines(d), "doc_id", "text") == [(1, "x y z"), (5, "own a"), (5, "p q r\nown b")]


def test_classes(spark):
    d = docs(spark, [(1, "a b\nc"), (2, "b  a\n\nc\td"), (None, "c")])
    found = {r["doc_id"]: [(x["doc_id"], x["line"]) for x in r["classes"]] for r in L.later_matches(d).collect()}
    assert found == {1: [(1, 0), (1, 1)], 2: [(1, 0), (2, 2)], None: [(1, 1)]}


def test_a_group_of_near_copies(spark):
    """Every pair of a group is a link; what one word tells apart are different sets."""
    words = [f"w{k}" for k in range(30)]
    same(spark, [(i, " ".join([*words[:i], f"own{i}", *words[i + 1 :]])) for i in range(25)])


def near_lines(seed):
    rng = random.Random(seed)
    out = []
    for size, n in ((40, 60), (19, 25), (60, 40)):
        base = [f"b{size}x{k}" for k in range(size)]
        for _ in range(n):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3, 5])):
                own[rng.randrange(size)] = rng.choice(["the", "of", f"own{rng.randrange(10**6)}"])
            out.append(" ".join(own[rng.choice([0, 0, 1]) :]))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("group", [2, 16])
def test_near_copies_by_distance_to_a_pivot(spark, monkeypatch, group):
    monkeypatch.setattr(L, "NEAR_SIZE", 2 if group == 2 else L.NEAR_SIZE)
    monkeypatch.setattr(L, "NEAR_GROUP", group)
    same(spark, near_lines(1))
    same(spark, [(i, " ".join(f"w{k}" for k in range(i, i + 24))) for i in range(40)])


def test_pairs_of_a_large_group_are_not_made(spark):
    """A few words changed in each of many copies of a line: nearly all pairs are links, few of them rows."""
    words = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(words)), (500, " ".join(words)), *((i, " ".join([*words[: i % 60], f"own{i}", *words[i % 60 + 1 :]])) for i in range(1, 200))]
    found = {r["doc_id"]: r["n_links"] for r in L.later_matches(docs(spark, rows)).collect()}
    assert set(found.values()) == {199}
    sets = L.token_sets(docs(spark, rows)).cache()
    groups = L.near_groups(sets)
    assert L._candidates(L.with_groups(sets, groups), L._rarity(sets)).count() < 0.2 * 200 * 199 / 2


def test_a_group_has_no_false_candidates(spark):
    """Copies that differ from their pivot nearly by what is allowed: the join leaves those pairs of them that match."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(words)), (500, " ".join(words))]
    for i in range(1, 120):
        own = list(words)
        for k in rng.sample(range(60), 4):
            own[k] = f"own{i}x{k}" if rng.random() < 0.5 else f"the{k}"
        rows.append((i, " ".join(own)))
    sets = L.token_sets(docs(spark, rows)).cache()
    groups = L.near_groups(sets)
    pairs = L._candidates(L.with_groups(sets, groups), L._rarity(sets)).collect()
    tokens, pivot = {x["uid"]: set(x["tokens"]) for x in sets.collect()}, {x["uid"]: x["pivot"] for x in groups.collect()}
    inside = [(tokens[a], tokens[b]) for a, b, _ in pairs if a in pivot and pivot[a] == pivot.get(b)]
    assert len(inside) == sum(x["sure"] for x in pairs) > 100 and all(5 * len(a & b) >= 4 * len(a | b) for a, b in inside)
    same(spark, rows)


def test_tables_of_known_size_have_few_files(spark, monkeypatch):
    """Each file costs an executor and the driver a process; few rows are not split into one for each shuffle partition."""
    files, real = {}, L.written

    def counted(df, hint="t", *size):
        out = real(df, hint, *size)
        files[hint] = max(files.get(hint, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(L, "written", counted)
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        same(spark, near_lines(2) + [(1000 + i, f"line {i}\nline  {i}") for i in range(40)])
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    few = ("same", "more", "placed", "first", "best", "ids", "bitmaps")
    assert {k: files[k] for k in few} == dict.fromkeys(few, 1)


def test_long_lines_of_common_words(spark):
    """Long lines share many words without being alike; they are not paired, and near copies about WIDE words are."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(700)]
    long = [" ".join(rng.sample(words, 150)) for _ in range(150)]
    sets = L.token_sets(docs(spark, list(enumerate(long)))).cache()
    assert L._candidates(L.with_groups(sets, L.near_groups(sets)), L._rarity(sets)).count() < 50
    base = rng.sample(words, L.WIDE + 4)
    near = [" ".join(w for w in base if w not in rng.sample(base, rng.randint(0, 12))) for _ in range(12)]
    same(spark, list(enumerate([*long[:20], *near])))


def test_query_joins_no_texts(spark, tmp_path):
    """Lines are counted before the join with what was found, so that no text is shuffled for it."""
    docs(spark, [(1, "a\nb"), (2, None), (3, "b\nc\n"), (4, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    found = op5_line_dedup(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not re.search(r"Project \[(?:[^\n]*, )?text#\d+(?:, [^\n]*)?\]", plan)
    assert got(found, "doc_id", "n_lines") == [(1, 2), (2, 0), (3, 3), (4, 1)]


def test_query(spark, tmp_path):
    docs(spark, [(1, "a\nb"), (2, None), (3, "b\nc")]).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(op5_line_dedup(spark, str(tmp_path)), "doc_id", "n_lines", "n_removed", "removed", "n_links") == [(1, 2, 0, "", 0), (2, 0, 0, "", 0), (3, 2, 1, "0", 0)]
