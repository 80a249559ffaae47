"""M1 to M4, M7 to M9, J1 to J3, A11, A12, F9."""

import hashlib
import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import inference, prompts, sentiment
from reviewloom.schema import RESPONSE
from reviewloom.session import configure
from reviewloom.sources.response_cache import read_responses


def counting_client(folder):
    """A client that leaves one file per call and answers with the prompt's length."""

    def build():
        from uuid import uuid4

        def client(prompt):
            with open(f"{folder}/{uuid4().hex}", "w") as call:
                call.write(prompt)
            return {"content": f"answer {len(prompt)}", "tokens_used": len(prompt), "cost": 0.5}

        return client

    return build


def _calls(folder):
    return Counter(path.read_text() for path in Path(folder).iterdir())


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return str(folder)


@pytest.fixture(scope="module")
def reviews(spark):
    """A third of the rows share one prompt; one has none."""
    texts = [(i, "same" if i % 3 == 0 else f"text {i}") for i in range(60)] + [(60, None)]
    return spark.createDataFrame(texts, "review_id int, prompt string").repartition(4)


def batch_measuring_client():
    """Answers with the rows and characters of the Arrow batch that its prompt came in."""

    def build():
        import sys

        def client(prompt):
            batch = sys._getframe(1).f_locals["batch"]
            return f"{len(batch)} {batch['prompt'].str.len().sum()}"

        return client

    return build


@pytest.mark.parametrize("rows, size", [(3_000, 10), (300, 100_000)])
def test_batches_are_bounded_by_rows_and_by_bytes(spark, rows, size):
    """Packs of long prompts reach the model a few megabytes at a time, and none is lost."""
    configure(spark)
    texts = F.repeat(F.lit("x"), size).alias("prompt")
    packed = spark.range(0, rows, 1, 1).select(F.col("id").alias("prompt_hash"), texts)
    got = inference.infer(packed, batch_measuring_client(), "m", "p").select("prompt_hash", "content").collect()
    assert sorted(r.prompt_hash for r in got) == list(range(rows))
    held = [tuple(map(int, r.content.split())) for r in got]
    assert max(n for n, _ in held) <= 512
    assert max(characters for _, characters in held) <= 5 * 1024**2


def test_render(spark):
    df = spark.createDataFrame([("it's {odd} \"x\"", 4.5)], "comment string, rating double")
    row = prompts.render(df, prompts.SENTIMENT_PROMPT, feedback="comment").first()
    assert row.prompt == prompts.SENTIMENT_PROMPT.format(feedback=row.comment)
    row = prompts.render(df, "{a} is {{b}} {c}", "out", a="rating", c="comment").first()
    assert row.out == "4.5 is {b} " + row.comment
    with pytest.raises(ValueError, match="feedback"):
        prompts.render(df, prompts.SENTIMENT_PROMPT, comment="comment")
    with pytest.raises(ValueError, match="nope"):
        prompts.render(df, prompts.SENTIMENT_PROMPT, feedback="nope")


def test_prompt_key(spark):
    df = spark.createDataFrame([("é x",)], "prompt string")
    assert inference.with_prompt_key(df, "m").first().prompt_hash == hashlib.md5("m:é x".encode()).hexdigest()
    row = inference.with_prompt_key(df, "m", "Be kind.").first()
    assert row.prompt == "Be kind.\n\né x"
    assert row.prompt_hash == hashlib.md5("m:Be kind.\n\né x".encode()).hexdigest()


def test_infer(reviews, calls):
    df = inference.infer(reviews, counting_client(calls), "m", "p", keep=("review_id",))
    assert [f.name for f in df.schema] == ["review_id", *RESPONSE.names]
    rows = df.collect()
    assert len(rows) == 61 and _calls(calls)["same"] == 20
    by_id = {r.review_id: r for r in rows}
    assert by_id[60].content is None
    row = by_id[1]
    assert (row.content, row.model, row.provider, row.tokens_used, row.cost) == ("answer 6", "m", "p", 6, 0.5)
    assert row.response_time >= 0


def test_infer_with_plain_text_answers(spark):
    df = inference.infer(spark.range(1).selectExpr("id", "'x' as prompt"), lambda: str.upper, "m", "p", keep=("id",))
    row = df.first()
    assert (row.content, row.tokens_used, row.cost) == ("X", None, None)


def test_failing_client_fails_the_job(spark):
    def build():
        def client(prompt):
            raise RuntimeError("no answer")

        return client

    df = inference.infer(spark.range(1).selectExpr("id", "'x' as prompt"), build, "m", "p", keep=("id",))
    with pytest.raises(Exception, match="no answer"):
        df.collect()


def test_each_prompt_is_sent_once(reviews, calls, tmp_path, spark):
    path = str(tmp_path / "cache")
    keyed = inference.with_prompt_key(reviews, "m")
    stored = inference.store_answers(keyed, path, counting_client(calls), "m", "p")
    distinct = {r.prompt for r in reviews.collect()} - {None}
    assert _calls(calls) == Counter(distinct)
    stored.count()
    inference.cache_lookup(keyed, stored, ("review_id",)).collect()
    inference.store_answers(keyed, path, counting_client(calls), "m", "p", tasks=2)
    assert sum(_calls(calls).values()) == len(distinct)

    more = reviews.union(spark.createDataFrame([(99, "new")], reviews.schema))
    again = inference.store_answers(inference.with_prompt_key(more, "m"), path, counting_client(calls), "m", "p")
    assert _calls(calls) == Counter(distinct | {"new"})
    assert again.count() == len(distinct) + 1
    inference.store_answers(inference.with_prompt_key(reviews, "other"), path, counting_client(calls), "other", "p")
    assert _calls(calls)["same"] == 2


def test_lookup_gives_every_row_its_answer(reviews, calls, tmp_path):
    keyed = inference.with_prompt_key(reviews, "m")
    stored = inference.store_answers(keyed, str(tmp_path / "cache"), counting_client(calls), "m", "p")
    found = {r.review_id: r.content for r in inference.cache_lookup(keyed, stored, ("review_id",)).collect()}
    expected = {r.review_id: r.prompt and f"answer {len(r.prompt)}" for r in reviews.collect()}
    assert found == expected
    per_prompt = inference.answers_per_prompt(keyed, stored).collect()
    assert sum(r.n_rows for r in per_prompt) == 60 and max(r.n_rows for r in per_prompt) == 20
    assert len(per_prompt) == 41


def test_empty_answers_are_asked_again(reviews, tmp_path, spark, calls):
    path = str(tmp_path / "cache")
    keyed = inference.with_prompt_key(reviews, "m")
    inference.store_answers(keyed, path, lambda: lambda prompt: "", "m", "p")
    assert read_responses(spark, path).count() == 0
    assert inference.store_answers(keyed, path, counting_client(calls), "m", "p").count() == 41


def test_cache_stats(reviews, spark, tmp_path, calls):
    keyed = inference.with_prompt_key(reviews.where("prompt is not null"), "m")
    half = keyed.where("review_id % 3 = 0 or review_id < 10")
    path = str(tmp_path / "cache")
    inference.store_answers(half, path, counting_client(calls), "m", "p")
    row = inference.cache_stats(keyed, spark.read.parquet(path)).first()
    assert tuple(row) == (26, 34, 60, 43.3, 7)
    nothing = inference.cache_stats(keyed.where("false"), spark.read.parquet(path)).first()
    assert tuple(nothing) == (0, 0, 0, 0.0, 7)


def test_model_timing(reviews, calls):
    df = inference.infer(reviews.where("review_id < 3"), counting_client(calls), "m", "p", keep=("review_id",))
    row = inference.model_timing(df).first()
    assert (row.provider, row.model, row.calls, row.tokens_used, row.cost) == ("p", "m", 3, 16, 1.5)


def test_provider_choice():
    clients = {"one": 1, "two": 2}
    assert inference.choose_client(clients, "two") == ("two", 2)
    assert inference.choose_client(clients, "three") == ("one", 1)
    assert inference.choose_client(clients, None) == ("one", 1)
    with pytest.raises(ValueError):
        inference.choose_client({}, "one")


@pytest.mark.parametrize("rows_per_bucket", [7, 10_000])
def test_packing_keeps_every_prompt(spark, rows_per_bucket):
    df = spark.range(53).selectExpr("md5(string(id)) as prompt_hash", "concat('p ', id) as prompt").repartition(3)
    packed = prompts.pack_prompts(df, 5, rows_per_bucket=rows_per_bucket).collect()
    keys = [key for row in packed for key in row["keys"]]
    assert Counter(keys) == Counter(r.prompt_hash for r in df.collect())
    assert len({row.batch_id for row in packed}) == len(packed)
    texts = {r.prompt_hash: r.prompt for r in df.collect()}
    for row in packed:
        assert 1 <= len(row["keys"]) <= 5
        body = "".join(f"{i}. {texts[key]}\n" for i, key in enumerate(row["keys"], 1))
        assert row.prompt == prompts.PACKED_HEADING + body
    if rows_per_bucket == 10_000:
        assert sorted(len(row["keys"]) for row in packed) == [3, *[5] * 10]


def test_unpacking(spark):
    answers = [
        ("b1", ["k1", "k2", "k3"], json.dumps([{"sentiment": "positive", "confidence": 1}, {"sentiment": "negative"}])),
        ("b2", ["k4"], "Mock response"),
        ("b3", ["k5", "k6"], "[5, " + json.dumps({"sentiment": "negative", "confidence": 0.2}) + "]"),
        ("b4", ["k7"], None),
        ("b5", ["k8"], json.dumps([{"sentiment": "positive", "confidence": 0.3}] * 3)),
    ]
    df = spark.createDataFrame(answers, "batch_id string, keys array<string>, content string")
    parsed = sentiment.parse_sentiments(inference.unpack_answers(df, "batch_id")).collect()
    found = {r.prompt_hash: (r.batch_id, r.position, r.sentiment, r.confidence) for r in parsed}
    assert found == {
        "k1": ("b1", 0, "positive", 1.0),
        "k2": ("b1", 1, "negative", None),
        "k3": ("b1", 2, "neutral", 0.5),
        "k4": ("b2", 0, "neutral", 0.5),
        "k5": ("b3", 0, "neutral", 0.5),
        "k6": ("b3", 1, "negative", 0.2),
        "k7": ("b4", 0, "neutral", 0.5),
        "k8": ("b5", 0, "positive", 0.3),
    }


def test_rounds_keep_what_was_answered_before_a_failure(reviews, spark, tmp_path, calls):
    keyed = inference.with_prompt_key(reviews, "m")
    path = str(tmp_path / "cache")
    keys = sorted(r.prompt_hash for r in keyed.where("prompt is not null").distinct().collect())
    last = {r.prompt for r in keyed.where(F.col("prompt_hash") == keys[-1]).collect()}.pop()
    asked = counting_client(calls)

    def build():
        client = asked()

        def failing(prompt):
            if prompt == last:
                raise RuntimeError("gone")
            return client(prompt)

        return failing

    with pytest.raises(Exception, match="gone"):
        inference.store_answers(keyed, path, build, "m", "p", rounds=4)
    kept = {r.prompt_hash for r in read_responses(spark, path).collect()}
    assert kept == {key for key in keys if key < "c"}
    before = _calls(calls)
    stored = inference.store_answers(keyed, path, asked, "m", "p", rounds=3)
    assert stored.count() == len(set(keys))
    again = _calls(calls) - before
    assert sum(again.values()) == len({key for key in keys if key >= "c"})


def test_packed_calls_store_one_answer_per_prompt(reviews, spark, tmp_path):
    (tmp_path / "calls").mkdir()
    folder = str(tmp_path / "calls")

    def build():
        import json
        from uuid import uuid4

        def client(prompt):
            with open(f"{folder}/{uuid4().hex}", "w") as call:
                call.write(prompt)
            lines = [line for line in prompt.split("\n") if line[:1].isdigit()]
            answers = [{"sentiment": "positive", "reasoning": line.split(". ")[1]} for line in lines]
            # A request with a full batch gets one answer too few.
            return {"content": json.dumps(answers[: 4 if len(answers) == 5 else 5]), "tokens_used": 100}

        return client

    keyed = inference.with_prompt_key(reviews, "m")
    path = str(tmp_path / "cache")
    stored = inference.store_answers(keyed, path, build, "m", "p", batch_size=5)
    found = sentiment.parse_sentiments(inference.cache_lookup(keyed, stored, ("review_id",)))
    answered = {r.review_id: r.reasoning for r in found.collect() if r.sentiment == "positive"}
    texts = {r.review_id: r.prompt for r in reviews.collect()}
    assert answered and all(texts[i] == reasoning for i, reasoning in answered.items())
    # 41 prompts: eight full requests lack one answer each, one request has a single prompt.
    assert stored.count() == 8 * 4 + 1
    assert stored.agg(F.sum("tokens_used")).first()[0] == 900
    assert len(list((tmp_path / "calls").iterdir())) == 9
    # What was not answered is asked again: two requests, of five and of three.
    assert inference.store_answers(keyed, path, build, "m", "p", batch_size=5).count() == 33 + 4 + 3


def test_misses_are_distinct(reviews, spark):
    keyed = inference.with_prompt_key(reviews, "m")
    cache = keyed.where("prompt = 'same'").select("prompt_hash").distinct()
    misses = inference.cache_misses(keyed, cache).collect()
    assert len(misses) == 40 and len({r.prompt for r in misses}) == 40
    assert all(r.prompt_hash == hashlib.md5(f"m:{r.prompt}".encode()).hexdigest() for r in misses)
    assert keyed.where(F.col("prompt_hash").isNull()).count() == 1
