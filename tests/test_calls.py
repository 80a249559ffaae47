"""Calls in flight, list clients, coroutines, failing prompts."""

import asyncio
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reviewloom.operators.calls import Window, infer_batched, listed
from reviewloom.operators.inference import store_answers, with_prompt_key
from reviewloom.session import configure


def _client(folder, kind):
    """Answers the prompts' lengths; notes each call with the number of calls in flight."""

    def build():
        import asyncio
        import threading
        import time
        from uuid import uuid4

        lock, flying = threading.Lock(), [0]

        def begin(prompts):
            with lock:
                flying[0] += 1
                with open(f"{folder}/{uuid4().hex}", "w") as call:
                    call.write(f"{flying[0]} {len(prompts)}")
            if any(p.startswith("bad") for p in prompts):
                flying[0] -= 1
                raise RuntimeError("refused")

        def end(prompts):
            with lock:
                flying[0] -= 1
            return [{"content": f"answer {len(p)}", "tokens_used": len(p)} for p in prompts]

        def plain(prompts):
            begin(prompts)
            time.sleep(0.02)
            return end(prompts)

        async def coroutine(prompts):
            begin(prompts)
            await asyncio.sleep(0.02)
            return end(prompts)

        return plain if kind == "list" else coroutine

    return build


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def _noted(folder: Path):
    return [tuple(map(int, path.read_text().split())) for path in folder.iterdir()]


@pytest.mark.parametrize("kind", ["list", "coroutine"])
def test_bound_order_and_isolation(spark, calls, kind):
    texts = [("bad" if i % 10 == 7 else "x") + "y" * i for i in range(60)]
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [(60, None, "kept")]
    df = spark.createDataFrame(rows, "i int, prompt string, content2 string").coalesce(1)
    out = infer_batched(df, _client(str(calls), kind), "m", "p", keep=("i",), batch_size=4, in_flight=3)
    got = out.collect()
    assert [r.i for r in got] == list(range(61))
    for r, text in zip(got, texts):
        if text.startswith("bad"):
            assert r.content is None and r.error == "RuntimeError: refused"
        else:
            assert (r.content, r.tokens_used, r.error) == (f"answer {len(text)}", len(text), None)
    assert tuple(got[60])[1:] == (None, "m", "p", None, None, None, None)
    noted = _noted(calls)
    # 15 calls of four; each of the six failing ones is taken apart into four
    assert sorted(n for _, n in noted) == [1] * 24 + [4] * 15
    # apart ones are asked one by one, while at most the window is in flight
    assert 2 <= max(flying for flying, _ in noted) <= 4


def test_failures_fail_the_task_when_asked_to(spark, calls):
    df = spark.createDataFrame([("k", "bad")], "prompt_hash string, prompt string")
    with pytest.raises(Exception, match="refused"):
        infer_batched(df, _client(str(calls), "list"), "m", "p", isolate=False).collect()
    with pytest.raises(ValueError, match="1 or more"):
        infer_batched(df, _client(str(calls), "list"), "m", "p", in_flight=0)
    with pytest.raises(ValueError, match="nope"):
        infer_batched(df, _client(str(calls), "list"), "m", "p", keep=("nope",))


def test_wrong_number_of_answers_and_empty_input(spark):
    def build():
        return lambda prompts: ["only one"]

    df = spark.createDataFrame([(str(i), f"p{i}") for i in range(3)], "prompt_hash string, prompt string").coalesce(1)
    got = infer_batched(df, build, "m", "p", batch_size=3).collect()
    assert [(r.prompt_hash, r.content) for r in got] == [(str(i), "only one") for i in range(3)]
    assert infer_batched(df.limit(0), build, "m", "p").count() == 0


@pytest.mark.parametrize("rows, size", [(3_000, 10), (300, 100_000)])
def test_batches_are_bounded_by_rows_and_by_bytes(spark, rows, size):
    """A client that answers with the rows and characters of the Arrow batch its task holds."""

    def build():
        import sys

        task = sys._getframe(1)

        def client(prompts):
            batch = task.f_locals["batch"]
            return [f"{len(batch)} {batch['prompt'].str.len().sum()}" for _ in prompts]

        return client

    configure(spark)
    texts = F.repeat(F.lit("x"), size).alias("prompt")
    prompts = spark.range(0, rows, 1, 1).select("id", texts)
    got = infer_batched(prompts, build, "m", "p", keep=("id",), batch_size=8, in_flight=4)
    got = got.select("id", "content", "error").collect()
    assert [r.id for r in got] == list(range(rows)) and not any(r.error for r in got)
    held = [tuple(map(int, r.content.split())) for r in got]
    assert max(n for n, _ in held) <= 512
    assert max(characters for _, characters in held) <= 5 * 1024**2


def test_window_runs_calls_at_the_same_time():
    gate = threading.Barrier(3, timeout=10)

    def client(prompts):
        gate.wait()
        return prompts

    window = Window(client, 3)
    done = [t for i in range(6) for t, _ in window.add(i, [str(i)])] + [t for t, _ in window.drain()]
    window.close()
    assert done == list(range(6))


def test_single_clients_become_list_clients():
    async def one(prompt):
        await asyncio.sleep(0.05)
        return prompt

    each = listed(lambda: one)()
    started = time.perf_counter()
    assert asyncio.run(each(["a"] * 10)) == ["a"] * 10
    assert time.perf_counter() - started < 0.4
    assert listed(lambda: str.upper)()(["a", "b"]) == ["A", "B"]


def test_failed_prompts_are_asked_in_the_next_run(spark, calls, tmp_path):
    df = spark.createDataFrame([(i, f"{'bad' if i < 2 else 'p'}{i}") for i in range(9)], "i int, prompt string")
    keyed = with_prompt_key(df, "m")
    client = _client(str(calls), "list")
    for runs in (1, 2):
        stored = store_answers(keyed, str(tmp_path / "s"), None, "m", "p", list_client=client, batch_size=3, tasks=1)
        assert stored.count() == 7
        if runs == 1:
            before = len(_noted(calls))
    assert sorted(n for _, n in _noted(calls))[-1] == 3 and len(_noted(calls)) - before == 3
