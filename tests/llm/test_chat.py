import hashlib
import random

import pytest

from reviewloom.llm import chat


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        said = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own)
        target = "".join(text or "" for _, role, text in own if role == "assistant")
        out[conv] = (len(own), digest(said), len(target), digest(target))
    return out


def conversations(seed):
    rng, rows = random.Random(seed), []
    parts = ["\\", "### ", "</turn>\n", "\\h", "\\l", "<", "#", ":\n", "words and words ", "你", "\n", "Assistant"]
    for conv in range(12):
        turn = 0
        if conv % 2:
            rows.append((conv, 0, "system", "".join(rng.choices(parts, k=9))))
        for turn in range(1, rng.randrange(2, 30)):
            rows.append((conv, turn, ["user", "assistant"][turn % 2], "".join(rng.choices(parts, k=rng.randrange(60)))))
    rows += [(None, 1, "user", "x"), (None, None, None, None), (50, 3, "assistant", ""), (51, 1, "system", "only")]
    return rows + [(7, 3, "assistant", "again"), (7, 3, "assistant", "again"), (60, -5, "assistant", "neg"), (60, 700, "user", "far")]


@pytest.mark.parametrize("budget,history", [(512, 128), (64, 16), (1, 0), (40, 200)])
def test_read_back(spark, budget, history):
    rows = conversations(budget)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, size string")
    windows = chat.windows(df, budget, history)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(windows).collect()}
    assert got == want(rows)


def test_windows_keep_system_turn_and_repeat_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, ["assistant", "user"][i % 2], f"turn {i} " + "x" * 60) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.windows(df, 200, 60).orderBy("window").collect()
    assert len(windows) > 3
    for w in windows:
        assert w.formatted.startswith("### system:\nbe kind</turn>\n")
        assert len(w.formatted) <= 4 * 200
    assert all(w.repeated >= 2 for w in windows[1:]) and windows[0].repeated == 0


def test_native_and_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.digests(chat.windows(df))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("system", [0, 300, 1500])
def test_budget_is_kept(spark, system):
    """Windows of turns that fit beside the system turn stay within the budget."""
    rng = random.Random(system)
    rows = []
    for conv in range(40):
        if system:
            rows.append((conv, 0, "system", "s" * system))
        most = 4 * 512 - system - 60
        rows += [(conv, i, ["user", "assistant"][i % 2], "x" * rng.choice([rng.randrange(most), most, 9])) for i in range(1, 30)]
    rows += [(99, 1, "user", "y" * 4000), (99, 2, "assistant", "z" * 1500), (99, 3, "user", "z" * 1980)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(df).collect()
    assert all(len(w.formatted) <= 4 * 512 for w in made if w.conv_id != 99)
    assert sorted(len(w.formatted) > 4 * 512 for w in made if w.conv_id == 99) == [False, False, True]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.windows(df)).collect()}
    assert got == want(rows)


def test_roles_with_marks(spark):
    rows = [(1, 1, "a:\n### b", "hi"), (1, 2, "assistant", "x:\ny"), (1, 3, ":\\c:", "\\c:"), (2, 1, "system:\n", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.windows(df)).collect()}
    assert got == want(rows)
