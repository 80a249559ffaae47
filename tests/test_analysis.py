"""R1 to R5, S4, S5."""

import json

import pytest
from pyspark.sql import functions as F

from querybook.standin import standin_client
from reviewloom.operators.prompts import SUMMARY_PROMPT
from reviewloom.plans.analysis import analyze, save_results
from reviewloom.plans.report import generate_report, report_prompt
from reviewloom.schema import RAW_REVIEWS
from test_inference import _calls, counting_client


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [
        (f"t{i}", f"c{i}", f"{1 + i % 5}.0 out of 5", f"on {1 + i % 9} May 2018", f"cat{i % 2}",
         "same words" if i % 3 == 0 else f"word {'x' * i}", "One person found this helpful")
        for i in range(30)
    ]
    return spark.createDataFrame(rows, RAW_REVIEWS)


def test_report_prompt(spark):
    one = spark.range(1)
    data, mood, topics = (one.select(F.lit(n).alias(n), F.lit(None).alias("empty")) for n in "abc")
    prompt = report_prompt(data, mood, topics).first().prompt
    assert prompt == SUMMARY_PROMPT.format(
        data_summary='{"a":"a","empty":null}',
        sentiment_results='{"b":"b","empty":null}',
        topic_results='{"c":"c","empty":null}',
    )


def test_report_comes_from_the_store_the_second_time(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    client = counting_client(str(tmp_path / "calls"))
    prompt = spark.range(1).select(F.lit("Summarise").alias("prompt"))
    for _ in range(2):
        row = generate_report(prompt, str(tmp_path / "cache"), client, "m", "p", "priorities").first()
        assert (row.insight_type, row.report, row.model_used) == ("priorities", "answer 9", "m")
        assert row.response_time_seconds >= 0 and row.message.endswith("successfully.")
    assert sum(_calls(tmp_path / "calls").values()) == 1
    with pytest.raises(ValueError, match="gossip"):
        generate_report(prompt, str(tmp_path / "cache"), client, "m", "p", "gossip")


def test_full_analysis(reviews, spark, tmp_path):
    result = analyze(reviews, str(tmp_path), {"standin": standin_client, "spare": None}, "m", provider="unknown")
    data = result.data_summary.first()
    assert data.total_records == 30 and data.average_rating == 3.0
    mood = result.sentiment_analysis.first()
    assert mood.total_comments == 30
    assert mood.positive_count + mood.negative_count + mood.neutral_count == 30
    assert result.topic_extraction.first().total_topics_extracted == 60
    assert {r.metric for r in result.statistics.collect()} >= {"count", "word_frequency"}
    meta = result.metadata.first()
    assert meta.primary_llm == "standin" and meta.available_providers == ["standin", "spare"]

    json_path, text_path = save_results(result, str(tmp_path / "out"))
    saved = json.loads(spark.read.text(json_path).first()[0])
    assert saved["data_summary"]["categories"] == {"cat0": 15, "cat1": 15}
    assert saved["sentiment_analysis"]["total_comments"] == 30
    assert saved["statistics"]["lines"][0]["metric"] == "avg_length"
    text = "\n".join(r[0] for r in spark.read.text(text_path).collect())
    assert text.endswith(saved["final_summary"]["report"]) and "Report on" in text


def test_analysis_of_a_few_and_a_second_run(reviews, tmp_path):
    (tmp_path / "calls").mkdir()
    client = counting_client(str(tmp_path / "calls"))
    for _ in range(2):
        result = analyze(reviews, str(tmp_path), {"p": client}, "m", first_n=4, order=("title",))
        mood = result.sentiment_analysis.first()
        # Four reviews; what the client says is no JSON, so all are neutral.
        assert (mood.total_comments, mood.neutral_count, mood.average_confidence) == (4, 4, 0.5)
        assert result.data_summary.first().total_records == 30
        assert result.topic_extraction.first().total_topics_extracted == 0
    sent = _calls(tmp_path / "calls")
    assert max(sent.values()) == 1
    # Titles t0, t1, t10, t11: four comments, each in two prompts, and one report.
    assert len(sent) == 9


def test_nothing_to_analyse(reviews, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        analyze(reviews.where("false"), str(tmp_path), {"p": standin_client}, "m")


def _packing_client(folder, short):
    """Answers each item of a request as a prompt of its own, but not the last ones."""

    def build():
        import json
        import re
        from uuid import uuid4

        def client(prompt):
            with open(f"{folder}/{uuid4().hex}", "w") as call:
                call.write(prompt)
            items = re.split(r"(?m)^\d+\. (?=Analyze|Extract)", prompt)[1:]
            if not items:
                return json.dumps({"sentiment": "negative", "main_topics": ["alone"]})
            answers = [{"sentiment": "positive", "main_topics": [f"t{len(i)}"]} for i in items]
            return json.dumps(answers[: max(0, len(answers) - short)])

        return client

    return build


@pytest.mark.parametrize("short, calls", [(0, 10), (1, 12)])
def test_packed_requests(reviews, tmp_path, short, calls):
    """21 different comments: five packs of each kind, and one of what five answers lack."""
    folder = tmp_path / "calls"
    folder.mkdir()
    client = {"a": _packing_client(str(folder), short)}
    work = dict(model="m", system_prompt="Be brief.", batch_size=5)
    result = analyze(reviews, str(tmp_path), client, **work)
    mood = result.sentiment_analysis.first()
    # what two packed requests did not answer was asked alone
    assert (mood.total_comments, mood.neutral_count) == (30, 0)
    assert (mood.negative_count > 0) == (short > 0)
    sent = [path.read_text() for path in folder.iterdir()]
    packs = [text for text in sent if "as a JSON array" in text]
    assert all(text.count("Be brief.") == 1 and text.startswith("Be brief.") for text in packs)
    assert all(("Analyze the" in text) != ("Extract key" in text) for text in packs)
    assert len(packs) == calls
    # the second run finds everything stored, the report too
    before = len(sent)
    analyze(reviews, str(tmp_path), client, **work)
    assert len(list(folder.iterdir())) == before
