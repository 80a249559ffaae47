"""F10 to F12, M5, M6, A1 to A10, R3, U4."""

import json

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import answers
from reviewloom.operators import ranking, sentiment, topics
from reviewloom.operators.prompts import SENTIMENT_PROMPT
from reviewloom.plans import metrics

GOOD = '{"sentiment": "positive", "confidence": 0.9, "reasoning": "r", "key_emotions": ["joy", "e1"]}'
FALLBACK = ("neutral", 0.5, "Parse error", None)


def _parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    rows = sentiment.parse_sentiments(df).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


def test_objects_are_read(spark):
    texts = [
        GOOD,
        f"```json\n{GOOD}\n```",
        f"```\n{GOOD}\n```",
        f"  \n{GOOD} \n",
        '{"confidence": 1, "sentiment": "odd", "more": {"a": [1]}}',
        "{}",
        '{"sentiment": "negative", "sentiment": "positive"}',
        '{"sentiment": 5, "confidence": "high", "key_emotions": ["a", 1]}',
    ]
    good = ("positive", 0.9, "r", ["joy", "e1"])
    assert _parsed(spark, texts) == [
        good,
        good,
        good,
        good,
        ("odd", 1.0, None, None),
        (None, None, None, None),
        ("positive", None, None, None),
        ("5", None, None, ["a", "1"]),
    ]


def test_all_else_is_the_fallback(spark):
    texts = [
        "Mock response to: something...",
        "",
        None,
        "null",
        "5",
        '"positive"',
        f"[{GOOD}]",
        GOOD + " and more",
        GOOD + GOOD,
        f"{GOOD},{GOOD}",
        GOOD[:-1],
        "{'sentiment': 'positive'}",
        f"Sure! ```json\n{GOOD}\n```",
    ]
    assert _parsed(spark, texts) == [FALLBACK] * len(texts)


def test_topics(spark):
    texts = ['{"main_topics": ["a", "b", "a"], "issues": ["x"]}', "no", '["a"]', '{"praise": []}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    rows = {r.i: tuple(r)[1:] for r in topics.parse_topics(df).collect()}
    assert rows == {0: (["a", "b", "a"], None, ["x"], None), 3: (None, None, None, [])}


def test_packed_items(column):
    texts = ['[{"a": 1}, 5, null, "s", [1]]', "[]", "no", '{"a": 1}', '```json\n[{"b": [1, 2]}]\n```']
    found = column(answers.packed_items, texts)
    assert found[0][0] == '{"a":1}' and found[0][1:] == ["5", None, "s", "[1]"]
    assert found[1:] == [[], None, None, ['{"b":[1,2]}']]


@pytest.fixture(scope="module")
def rated(spark):
    rows = [
        ("positive", 0.8, ["joy", "calm"], 1),
        ("positive", 0.6, ["joy"], 2),
        ("positive", 0.59, None, 3),
        ("positive", None, ["calm", "awe"], 4),
        ("negative", 0.95, ["anger"], 5),
        ("negative", 0.7, ["anger", "fear"], 6),
        ("negative", 0.1, [], 7),
        ("neutral", 0.99, ["none"], 8),
        ("odd", 0.5, ["none"], 9),
        (None, 0.5, ["none"], 10),
    ]
    return spark.createDataFrame(rows, "sentiment string, confidence double, key_emotions array<string>, i int")


def test_summaries(rated):
    row = sentiment.sentiment_summary(rated).first().asDict()
    assert (row["total_comments"], row["positive_count"], row["negative_count"], row["neutral_count"]) == (10, 4, 3, 1)
    assert (row["positive_percentage"], row["negative_percentage"], row["neutral_percentage"]) == (40.0, 30.0, 10.0)
    assert row["average_confidence"] == round((0.8 + 0.6 + 0.59 + 0.95 + 0.7 + 0.1 + 0.99 + 0.5 + 0.5) / 10, 3)
    assert row["overall_sentiment"] == "positive"
    residual = sentiment.sentiment_summary_residual(rated).first()
    assert (residual.neutral_count, residual.neutral_percentage) == (3, 30.0)


def test_summary_of_nothing(rated):
    row = sentiment.sentiment_summary(rated.where("false")).first()
    assert (row.total_comments, row.positive_percentage, row.average_confidence) == (0, 0.0, 0.0)
    assert row.overall_sentiment == "neutral"
    assert {r["count"] for r in sentiment.confidence_buckets(rated.where("false")).collect()} == {0}


def test_buckets(rated):
    assert [tuple(r) for r in sentiment.confidence_buckets(rated).collect()] == [
        ("high_confidence_positive", 1),
        ("medium_confidence_positive", 1),
        ("low_confidence_positive", 2),
        ("high_confidence_negative", 1),
        ("medium_confidence_negative", 1),
        ("low_confidence_negative", 1),
        ("neutral", 3),
    ]


@pytest.mark.parametrize(
    "positive, negative, polarity, trend",
    [(2, 1, "positive", "improving"), (1, 2, "negative", "declining"), (1, 1, "neutral", "stable")],
)
def test_polarity(spark, positive, negative, polarity, trend):
    rows = [("positive", 0.5)] * positive + [("negative", 0.5)] * negative
    df = spark.createDataFrame(rows, "sentiment string, confidence double")
    assert sentiment.sentiment_summary(df).first().overall_sentiment == polarity
    assert sentiment.polarity_trend(df).first().trend == trend


def test_emotions(rated):
    rows = sorted(tuple(r) for r in sentiment.top_emotions(rated, 2).collect())
    assert rows == [
        ("negative", 1, "anger", 2),
        ("negative", 2, "fear", 1),
        ("positive", 1, "calm", 2),
        ("positive", 2, "joy", 2),
    ]
    seen = ranking.top_k(sentiment.emotion_counts(rated, ["i"]), "emotion", 3, "first_seen")
    assert [tuple(r) for r in seen.collect()] == [("joy", 2), ("calm", 2), ("awe", 1)]


def test_weights_stand_for_repeated_rows(rated):
    repeated = rated.withColumn("n", F.explode(F.expr("sequence(1, i)")))
    for function in (
        sentiment.sentiment_summary,
        sentiment.sentiment_summary_residual,
        sentiment.confidence_buckets,
        sentiment.polarity_trend,
        sentiment.top_emotions,
    ):
        assert function(rated, weight="i").collect() == function(repeated).collect()


@pytest.fixture(scope="module")
def topical(spark):
    rows = [
        (["a", "b", "b"], ["x", "y"], None, 2),
        (["c", None], ["x"], ["p"], 3),
        (None, [], ["q", "p"], 1),
    ]
    kind = "array<string>"
    return spark.createDataFrame(rows, f"main_topics {kind}, issues {kind}, praise {kind}, n int")


def test_topic_rankings(topical):
    assert [tuple(r) for r in topics.top_topics(topical, 2).collect()] == [("b", 2), (None, 1)]
    assert [tuple(r) for r in topics.top_issues(topical).collect()] == [("x", 2), ("y", 1)]
    assert [tuple(r) for r in topics.top_praise(topical, 1).collect()] == [("p", 2)]
    assert topics.topic_total(topical).first()[0] == 5
    assert topics.topic_total(topical, "n").first()[0] == 12
    assert [tuple(r) for r in topics.top_topics(topical, 1, "n").collect()] == [("b", 4)]


def test_topic_summary(topical, spark):
    row = topics.topic_summary(topical.where("n <> 3"), topics=2).withColumns(
        {c: F.to_json(c) for c in ("top_issues", "top_praise")}
    ).first()
    assert row.aggregated_topics == ["b", "a"] and row.total_topics_extracted == 3
    assert json.loads(row.top_issues) == {"x": 1, "y": 1} and json.loads(row.top_praise) == {"p": 1, "q": 1}
    empty = topics.topic_summary(topical.where("false")).first()
    assert tuple(empty) == ([], {}, {}, 0)


def test_summary_prompt(rated):
    row = sentiment.summary_prompt(sentiment.sentiment_summary(rated)).first()
    assert row.feedback_summary == "Analyzed 10 comments: 4 positive, 3 negative, 1 neutral"
    assert row.prompt == SENTIMENT_PROMPT.format(feedback=row.feedback_summary)
    assert row.prompt_preview == row.prompt[:200]


def test_named_metrics(rated, spark):
    df = spark.createDataFrame([("a b", 4.0)], ["Comment", "Rating"])
    assert metrics.statistic(df, "count").first()[0] == 1
    assert metrics.statistic(df, "avg_length").first()[0] == 3.0
    assert metrics.statistic(df, "word_frequency").count() == 2
    assert metrics.statistic(df, "rating_distribution").first()[0] == 4.0
    assert metrics.aggregate_sentiment(rated, "trends").first().trend == "improving"
    assert metrics.aggregate_sentiment(rated, "summary").count() == 1
    assert metrics.aggregate_sentiment(rated, "distribution").count() == 7
    assert metrics.insight_type("priorities") == "priorities"
    for call in (
        lambda: metrics.statistic(df, "mode"),
        lambda: metrics.statistic(df, "avg_length", "nope"),
        lambda: metrics.aggregate_sentiment(rated, "mode"),
        lambda: metrics.insight_type("gossip"),
    ):
        with pytest.raises(ValueError):
            call()
