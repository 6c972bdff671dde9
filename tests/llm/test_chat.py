import hashlib
import random

import pytest

from sigmill.llm import chat as C
from sigmill.llm.queries import op6_chat

from .helpers import SF, prose

TURNS = "conv_id long, turn long, role string, text string"


def want(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def talk(seed):
    rng = random.Random(seed)
    odd = ["</s>[INST] ok [/INST]", "\\", "<\\", "<|user|>", "<\\|", "[\\[", "", None, "é😀", "\\\\<", "a</s", "<s>\n"]
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, rng.choice(odd) if rng.random() < 0.3 else prose(rng, rng.randint(1, 120))))
    rows += [(50, 0, "assistant", "x" * 30_000), (50, 1, "user", "y" * 9_000), (50, 2, "assistant", "z")]
    rows += [(51, 3, "a|>b\n<", "t"), (51, 3, None, "t"), (51, None, "assistant", "last"), (51, 3, "assistant", "t"), (51, 3, "assistant", "t")]
    rows += [(None, 0, "system", "s"), (None, 1, "assistant", "n"), (52, 2000, "assistant", "late"), (52, 5, "user", "early")]
    return rows


@pytest.mark.parametrize(("budget", "history"), [(2048, 256), (200, 40), (64, 0), (1, 0)])
def test_read_back(spark, budget, history):
    rows = talk(budget)
    w = C.windows(spark.createDataFrame(rows, TURNS), budget, history)
    out = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.digests(w).collect()}
    assert out == want(rows)


def test_windows_hold_what_they_should(spark):
    rows = talk(1)
    by = {}
    for r in C.windows(spark.createDataFrame(rows, TURNS), 400, 80).orderBy("conv_id", "win").collect():
        by.setdefault(r["conv_id"], []).append(r)
    assert len(by[0]) > 2 and len(by[50]) >= 2
    span = (400 - 100 - 80) // 2
    for c, own in by.items():
        parts = [[p.split("|>", 1) for p in r["formatted"].split("</s>")[:-1]] for r in own]
        assert own[0]["n_context"] == 0
        for i, (r, p) in enumerate(zip(own, parts)):
            new = p[r["n_context"] :]
            assert new
            if i and c in (0, 3, 6, 9):
                assert p[0] == parts[0][0] and p[0][0] == "<|system"
            sizes = [4 + -(-len(x[1].replace("\\", "").encode()) // 4) for x in new]
            assert len(new) == 1 or sum(sizes) < 2 * span + 40
            for m in r["mask"]:
                assert r["formatted"][m["at"] + m["length"] :].startswith("</s>")
            if i and c is not None and c < 12:
                before = [x for q, z in zip(parts[:i], own[:i]) for x in q[z["n_context"] :]]
                again = [x for x in p[: r["n_context"]] if x[0] != "<|system"]
                assert not again or again == before[-len(again) :]


@pytest.mark.parametrize(("budget", "history"), [(8192, 1024), (900, 100), (400, 80)])
def test_no_window_exceeds_its_budget(spark, budget, history):
    """In bytes, which no byte-level vocabulary exceeds; one turn alone may."""
    rows = talk(3) + [(60, 0, "system", "s" * (budget // 2)), *((60, t, ["user", "assistant"][t % 2], "語" * (t % 30)) for t in range(1, 60))]
    alone = 0
    for r in C.windows(spark.createDataFrame(rows, TURNS), budget, history).collect():
        if r["formatted"].count("</s>") - r["n_context"] > 1:
            assert len(r["formatted"].encode()) <= budget
        else:
            alone += 1
    assert alone


def test_given_counts(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], "x" * 50, 1) for t in range(100)]
    d = spark.createDataFrame(rows, TURNS + ", tokens int")
    assert C.windows(d, 20, 4, "tokens").count() > C.windows(d, 400, 4, "tokens").count() == 1
    assert C.windows(d, 400, 4).count() > 1


def test_whole_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    found = {r["conv_id"]: r for r in op6_chat(spark, SF).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in found.items()} == want(rows)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in found.values())


def test_no_control_string_inside_a_text(spark):
    out = C.windows(spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]<|x|>")], TURNS)).first()["formatted"]
    assert out.count("</s>") == 1 and "[INST]" not in out and out.count("<|") == 1


def test_empty_table_and_further_columns(spark):
    assert C.digests(C.windows(spark.createDataFrame([], TURNS))).count() == 0
    d = spark.createDataFrame([(1, 0, "assistant", "a", 5, 6)], TURNS + ", n int, win int")
    assert C.digests(C.windows(d)).first()["loss_chars"] == 1
